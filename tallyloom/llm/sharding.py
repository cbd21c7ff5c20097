"""Shards by extendible hashing: a directory over hash prefixes whose oversized buckets split on one more bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, given, scratch_dir, text_or_empty, written

SHARD_BYTES = 64 << 20
KEY_BITS = 56
TAIL_BITS = 24
STEP = 14


def _bits(value: Column, width: int) -> Column:
    return F.lpad(F.bin(value), width, "0")


def key_bits(key: Column) -> Column:
    """The first 56 bits of the MD5 of a key's text, as a string of 0 and 1; a null key counts as empty."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return _bits(F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long"), KEY_BITS)


def directory(rows: DataFrame, max_bytes: int) -> DataFrame:
    """``(shard, depth, shard_bytes, shard_rows, size)`` from rows ``(bits, size)``: the leaves.

    A prefix is a leaf when its bytes fit and its parent's did not.  Prefixes are summed ``STEP`` bits
    at a time, with map-side combining; only what is still too large goes on to the next bits.
    Prefixes that still do not fit at the last bit are leaves too (single rows above the limit).
    """
    last = KEY_BITS + TAIL_BITS
    start, leaves, open_rows = 0, None, rows.select("bits", "size")
    while start <= last:
        stop = min(start + STEP, last)
        sums = open_rows.groupBy(F.substring("bits", 1, stop).alias("p")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        levels = sums.select("size", "n", F.explode(F.expr(f"transform(sequence({start}, {stop}), d -> substring(p, 1, d))")).alias("shard")) \
            .groupBy("shard").agg(F.sum("size").alias("shard_bytes"), F.sum("n").alias("shard_rows")) \
            .withColumn("depth", F.length("shard"))
        levels = cut_lineage(levels)
        large = levels.filter(F.col("shard_bytes") > max_bytes).select(F.col("shard").alias("parent"))
        if start == 0:
            top = levels.filter(f"depth = 0 AND shard_bytes <= {max_bytes}")
            leaves = top
        fits = levels.filter(f"depth > {start} AND (shard_bytes <= {max_bytes} OR depth = {last})")
        found = fits.withColumn("parent", F.expr("substring(shard, 1, depth - 1)")).join(large, "parent").select(levels.columns)
        leaves = leaves.unionByName(found)
        deeper = levels.filter((F.col("depth") == stop) & (F.col("shard_bytes") > max_bytes)).select(F.col("shard").alias("p"))
        if stop == last or deeper.isEmpty():
            break
        open_rows = open_rows.withColumn("p", F.substring("bits", 1, stop)).join(deeper, "p", "left_semi").select("bits", "size")
        start = stop
    return leaves


def _placed(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Each row with its leaf.  Depths in use are few (80 at most).

    Leaves are disjoint, so a row is found once.
    """
    out = rows.limit(0).withColumns({"shard": F.lit(""), "shard_bytes": F.lit(0).cast("long"), "shard_rows": F.lit(0).cast("long"), "depth": F.lit(0)})
    for depth in sorted(r[0] for r in leaves.select("depth").distinct().collect()):  # a pass over thin rows for each depth in use
        here = rows.withColumn("shard", F.expr(f"substring(bits, 1, {depth})")).join(leaves.filter(f"depth = {depth}"), "shard")
        out = out.unionByName(here)
    return out


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(id_col, size, shard, depth, shard_bytes, shard_rows)`` for every row of ``docs``.

    Rows are placed by hash bits of their id; a bucket whose texts (UTF-8 bytes) exceed
    ``max_bytes`` splits on the next bit, others stay whole.  Rows that share an id share all those
    bits: further bits, from the row's place in the input, split them, so a hot id is no limit.  A
    single text above the limit is a shard of its own, the only kind that exceeds it.

    A null id counts as an empty one, a null text as empty (size 0).  Further columns are ignored.  An
    empty table gives an empty result.
    """
    base = given(docs, id=id_col, text=text_col)
    tail = _bits(F.expr(f"pmod(xxhash64(monotonically_increasing_id(), 5), {1 << TAIL_BITS}L)"), TAIL_BITS)
    rows = written(base.select("id", F.octet_length(text_or_empty()).cast("long").alias("size"), F.concat(key_bits(F.col("id")), tail).alias("bits")), "shard-rows")
    leaves = directory(rows, max_bytes)
    return _placed(rows, leaves).select(F.col("id").alias(id_col), "size", "shard", "depth", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``docs`` as Parquet under ``path``, one folder ``shard_bits=...`` per shard with one file; returns the directory.

    The text is shuffled once, by shard.  All columns are written; the added one is named apart from them.
    """
    name = "shard_bits"
    while name in docs.columns:
        name += "_"
    tail = _bits(F.expr(f"pmod(xxhash64(monotonically_increasing_id(), 5), {1 << TAIL_BITS}L)"), TAIL_BITS)
    keyed = docs.withColumn(name, F.concat(key_bits(F.col(f"`{id_col}`")), tail))
    keyed_path = scratch_dir(docs.sparkSession, "keyed")
    keyed.write.parquet(keyed_path)
    keyed = docs.sparkSession.read.parquet(keyed_path)
    rows = keyed.select(F.col(name).alias("bits"), F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long").alias("size"))
    leaves = directory(rows, max_bytes)
    out = keyed.withColumn("__leaf", F.lit("")).limit(0)
    for depth in sorted(r[0] for r in leaves.select("depth").distinct().collect()):
        mine = leaves.filter(f"depth = {depth}").select(F.col("shard").alias("__leaf"))
        here = keyed.withColumn("__leaf", F.expr(f"substring(`{name}`, 1, {depth})")).join(mine, "__leaf")
        out = out.unionByName(here)
    out = out.withColumn(name, F.concat(F.lit("b"), "__leaf")).drop("__leaf")
    out.repartition(name).write.partitionBy(name).parquet(path)
    return leaves
