"""Unions and duplicate handling.  Keep-first is a rank filter, which Spark prunes per map task,
so a huge group of copies sends one row per task through the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Ordered, first_per, position


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        d = df.withColumn("source_type", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def dedup_record_id(df: DataFrame, rid: str, ts: str, order: list) -> DataFrame:
    ok = (F.coalesce(F.trim(F.col(rid).cast("string")), F.lit("")) != "") & F.col(ts).isNotNull()
    return first_per(df.filter(ok), [rid], order)


def dedup_composite(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return first_per(df, keys, order)


def dedup_timestamp(df: DataFrame, ts: str, order: list) -> DataFrame:
    return first_per(df, [ts], order)


def dedup_content(df: DataFrame, content_hash: Column, text: Column, rid: str, order: list) -> DataFrame:
    """First row per content hash, else per text, else the row stands for itself."""
    key = F.coalesce(F.nullif(content_hash, F.lit("")), F.sha2(F.nullif(text, F.lit("")), 256), F.col(rid).cast("string"))
    return first_per(df.withColumn("__key", key), ["__key"], order).drop("__key")


def new_pairs(files: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key pair (file hash, model or parameters) is not stored yet."""
    return files.join(stored.select(*keys).distinct(), keys, "left_anti")


def duplicate_groups(df: DataFrame, keys: list[str], sid: str) -> DataFrame:
    """Groups of two or more: one row per member with the size of its group."""
    n = df.groupBy(*keys).agg(F.count("*").alias("members")).filter("members > 1")
    return df.select(*keys, sid).join(n, keys)


def remove_duplicates(df: DataFrame, sid: str, start: str, end: str, order: list) -> DataFrame:
    """Keep the first row per id, then the first per exact time range."""
    return first_per(first_per(df, [sid], order), [start, end], order)


def scope_leak(requested: Column, response: Column) -> tuple[Column, Column]:
    """(is_isolated, leaked ids) for one request."""
    leak = F.array_except(response, requested)
    return F.size(leak) == 0, leak


def registry_upsert(registry: DataFrame, incoming: DataFrame, name: str, hash_: str, order: list) -> DataFrame:
    """Registry after adding documents: a known hash adds nothing, a new hash under a known name
    gets the next version and makes the older ones obsolete."""
    new = first_per(incoming, [hash_], order).join(registry.select(hash_), hash_, "left_anti")
    top = registry.groupBy(name).agg(F.max("version").alias("__v"))
    added = Ordered(new, [name], order).add(__step=position()).rows().join(top, name, "left").withColumn("version", F.coalesce("__v", F.lit(0)) + F.col("__step"))
    allv = registry.select(name, hash_, "version").unionByName(added.select(name, hash_, "version"))
    last = allv.groupBy(name).agg(F.max("version").alias("__last"))
    return allv.join(last, name).withColumn("obsolete", F.col("version") < F.col("__last")).drop("__last")
