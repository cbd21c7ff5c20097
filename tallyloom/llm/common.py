"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import cut_lineage, scratch_dir, ship_package

__all__ = ["cut_lineage", "given", "joined_with_groups", "mapped", "scratch_dir", "ship_package", "table", "written"]

#: Groups whose summary rows go to all tasks: 4096 thin rows at most.
LARGEST = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def given(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named input columns, under the operator's own names: other columns cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in cols.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: a cut that outlives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_with_groups(rows: DataFrame, groups: DataFrame, on: list[str], members: str, largest: int = LARGEST) -> DataFrame:
    """``rows`` inner-joined with the summary row of their group; ``groups`` should be written, as it is read twice.

    The summaries of the ``largest`` groups, a bounded number of thin rows, are broadcast, so rows of large groups stay where they are.
    The other groups hold at most one in ``largest`` of all rows each and are joined by a shuffle.
    """
    top = groups.orderBy(F.desc(members), *on).limit(largest)
    tried = rows.join(F.broadcast(top), on, "left")
    rest = tried.filter(F.col(members).isNull()).select(*rows.columns).join(groups, on)
    return tried.filter(F.col(members).isNotNull()).unionByName(rest)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` after shipping the package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
