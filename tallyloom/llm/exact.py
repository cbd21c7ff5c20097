"""Exact duplicates by refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given, joined_with_groups, text_or_empty, written

PREFIX = 256
FILTER_BITS = 1 << 24


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """A bitmap of fixed size over hashed keys: at most ``bits / 32768`` rows of 4 KB, whatever the input."""
    slot = F.expr(f"pmod(key, {bits}L) + 1")
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def _bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (position % 8).cast("int"))) > 0


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX,
                 filter_bits: int = FILTER_BITS, all_hashes: bool = False) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Rows are grouped by length in bytes; rows of shared lengths by a hash of their first ``prefix``
    characters; only rows that share both have their full text hashed (SHA-256).  Which rows these
    are is told to the second scan by a bitmap of ``filter_bits`` bits, so no text is shuffled; a
    chance hit in the bitmap costs one needless hash and changes nothing.  Of equal texts the
    largest id stays.  Counts are combined before each shuffle, and the rows of large groups of copies meet
    their summary row without one.

    ``text_sha256`` is null where the full text was not needed, unless ``all_hashes``.  A null text
    counts as empty; empty texts are copies of each other.  A group whose ids are all null keeps
    them; otherwise null ids go.  Rows that repeat id and text are all counted and share ``kept``.
    Further columns are ignored.  An empty table gives an empty result.
    """
    base = given(docs, id=id_col, text=text_col).withColumn("text", text_or_empty()) \
        .withColumns({"size": F.octet_length("text"), "head": F.xxhash64(F.substring("text", 1, prefix))})
    thin = base.select("size", "head")
    shared = thin.groupBy("size", "head").agg(F.count(F.lit(1)).alias("c"))
    lengths = shared.groupBy("size").agg(F.sum("c").alias("n")).filter("n > 1").select("size")
    heads = shared.join(lengths, "size", "left_semi").filter("c > 1").select(F.xxhash64("size", "head").alias("key"))
    bitmap = _bitmap(heads, filter_bits)

    slot = F.pmod(F.xxhash64("size", "head"), F.lit(filter_bits).cast("long")) + 1
    at = base.withColumns({"bucket": F.bitmap_bucket_number(slot), "position": F.bitmap_bit_position(slot)})
    marked = at.join(F.broadcast(bitmap), "bucket", "left")
    needed = F.coalesce(_bit(F.col("bits"), F.col("position")), F.lit(False))
    hashed = written(marked.select(
        "id", "size", needed.alias("shared"),
        (F.sha2("text", 256) if all_hashes else F.when(needed, F.sha2("text", 256))).alias("sha")), "hashed")

    again = hashed.filter("shared")
    groups = written(again.groupBy("size", "sha").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("members")), "groups")
    out = joined_with_groups(again.select("size", "sha", "id"), groups, ["size", "sha"], "members").select("id", "keep", "members", "sha").unionByName(
        hashed.filter("NOT shared").select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("members"), "sha"))
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("members").alias("group_size"),
                      F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))
