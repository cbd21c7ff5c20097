"""Registered queries, each with the SQL it is checked against (where SQL can say it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import ship_package

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Timestamps and dates leave as ISO text, so engines agree on their printed form."""
    cols = [
        F.col(f"`{n}`").cast("timestamp_ntz").cast("string").alias(n) if t.startswith("timestamp")
        else F.col(f"`{n}`").cast("string").alias(n) if t == "date"
        else F.col(f"`{n}`")
        for n, t in df.dtypes
    ]
    return df.select(*cols)


class Tables:
    """The given tables of one folder, read lazily by attribute name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(slug: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return plain(fn(Tables(spark, folder)))

        run.__name__, run.__doc__ = slug, fn.__doc__
        if slug in QUERIES:
            raise KeyError(slug)
        QUERIES[slug] = run
        if sql is not None:
            ORACLES[slug] = sql
        return fn

    return deco
