"""A Merkle manifest of a dataset whose versions copy paths and share all other nodes."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import given, ship_package, written

FANOUT = 3
#: Levels of an aligned block; a block has FANOUT ** HEIGHT nodes at most and is one group of one task.
HEIGHT = 8
NODES = "key string, idx long, n long, digest string"
PATHS = "key string, idx long, path array<string>, subroot string, root string"
PROOFS = "doc long, leaf string, subroot string, root string, proof string, folded string, copied array<string>"


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


class Block:
    """The base nodes of an aligned block.  Versions of it are paths: what they don't copy they share."""

    def __init__(self, digests: list[str], levels: int):
        self.rows = [digests]
        for _ in range(levels):
            last = self.rows[-1]
            self.rows.append([_hash("".join(last[i:i + FANOUT])) for i in range(0, len(last), FANOUT)])

    @property
    def top(self) -> str:
        return self.rows[-1][0]

    def path(self, at: int) -> list[str]:
        """Siblings on the way up: what stands left and right of the node and its ancestors, level by level."""
        out = []
        for row in self.rows[:-1]:
            start = at - at % FANOUT
            out += ["".join(row[start:at]), "".join(row[at + 1:start + FANOUT])]
            at //= FANOUT
        return out


def copied(digest: str, path: list[str]) -> list[str]:
    """The ancestors that a version with this digest at the path's foot has of its own, root last."""
    out = []
    for left, right in zip(path[::2], path[1::2]):
        digest = _hash(left + digest + right)
        out.append(digest)
    return out


class Blocks:
    """What tasks do with an aligned block of ``height`` levels."""

    def __init__(self, height: int):
        self.height, self.size = height, FANOUT ** height

    def _read(self, rows: pa.Table) -> tuple[Block, pa.Table]:
        rows = rows.sort_by("idx")
        return Block(rows.column("digest").to_pylist(), min(self.height, levels_of(rows.column("n")[0].as_py()))), rows

    def grouped(self, nodes: DataFrame):
        return nodes.withColumn("block", F.floor(F.col("idx") / F.lit(self.size)).cast("long")).groupBy("key", "block")

    def top(self, rows: pa.Table) -> pa.Table:
        block, rows = self._read(rows)
        n = -(-rows.column("n")[0].as_py() // self.size)
        return pa.table({"key": rows.column("key")[:1], "idx": rows.column("block")[:1], "n": pa.array([n], pa.int64()), "digest": [block.top]})

    def paths(self, rows: pa.Table, above: pa.Table) -> pa.Table:
        block, rows = self._read(rows)
        up = above.column("path")[0].as_py()
        paths = [block.path(k) + up for k in range(rows.num_rows)]
        same = {c: pa.array([above.column(c)[0].as_py()] * len(paths), pa.string()) for c in ("subroot", "root")}
        return pa.table({"key": rows.column("key"), "idx": rows.column("idx"), "path": pa.array(paths, pa.list_(pa.string())), **same})

    def proofs(self, rows: pa.Table, above: pa.Table) -> pa.Table:
        """Each row's proof and, through its own path, the root that its version leads to."""
        block, rows = self._read(rows)
        up, subroot, root = (above.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        leaves, tampered = block.rows[0], rows.column("tampered").to_pylist()
        proof, folded, own = [], [], []
        for k, (leaf, other) in enumerate(zip(leaves, tampered)):
            path = block.path(k) + up
            ancestors = copied(other or leaf, path)
            proof.append(_hash("".join(path)))
            folded.append(ancestors[-1] if ancestors else other or leaf)
            own.append(ancestors if other and other != leaf else [])
        many = len(leaves)
        return pa.table({"doc": rows.column("doc"), "leaf": rows.column("digest"), "subroot": [subroot] * many, "root": [root] * many,
                         "proof": proof, "folded": folded, "copied": pa.array(own, pa.list_(pa.string()))})


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 of each row in its key, and ``n``, the rows of the key.

    One range sort by key and order, written; a key may span many tasks.  What crosses tasks is a summary of a row per
    task and key.
    """
    ids = F.monotonically_increasing_id()  # task number above row number: it rises along the sort
    placed = written(rows.sort(key, *order).withColumn("seq", ids), "sorted").withColumn("task", F.shiftright("seq", 33))
    parts = placed.groupBy(F.col(key).alias("k"), F.col("task").alias("t")).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("here"))
    of_key = W.partitionBy("k")
    parts = parts.select("k", "t", "first", F.sum("here").over(of_key).alias("n"),
                         F.coalesce(F.sum("here").over(of_key.orderBy("t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined = placed.join(parts, (F.col(key) == F.col("k")) & (F.col("task") == F.col("t")))
    return joined.withColumn("idx", F.col("before") + F.col("seq") - F.col("first")).select(*rows.columns, "idx", "n")


def _climb(nodes: DataFrame, blocks: Blocks) -> list[DataFrame]:
    """The given nodes, the tops of their blocks, the tops of the blocks of these, until each key has one."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tops = blocks.grouped(out[-1].select("key", "idx", "n", "digest")).applyInArrow(lambda rows: blocks.top(rows), NODES)
        out.append(written(tops, "tops"))
        most = -(-most // blocks.size)
        if most <= 1:
            return out


def _descend(levels: list[DataFrame], paths: DataFrame, blocks: Blocks, last, kind: str) -> DataFrame:
    """Paths of the tops handed down to the first level; there ``last`` sees each block with the path above it."""
    for k, nodes in reversed(list(enumerate(levels[:-1]))):
        each = blocks.grouped(nodes).cogroup(paths.withColumnRenamed("idx", "block").groupBy("key", "block"))
        if k == 0:
            return each.applyInArrow(lambda rows, above: last(rows, above), kind)
        paths = each.applyInArrow(lambda rows, above: blocks.paths(rows, above), PATHS)


def leaf_digest(values: list[Column]) -> Column:
    """Each value as byte count, ``:`` and value, or ``-`` for null, hashed."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text",
             columns: tuple = ("doc_id", "source", "lang", "n_chars", "text"), height: int = HEIGHT) -> DataFrame:
    """One row per document: leaf, subroot of its group, root, proof, and the root of its tampered version.

    Leaves hash ``columns``; they ascend by id within a group, nulls first, equal ids by digest.  Every three consecutive
    nodes become one until one remains, first in each group, then over the groups (null first, by bytes).  Where 2
    divides crc32 of the decimal id, a version of the tree has the line breaks of that text removed; a null id or text has none.

    Aligned blocks of 3^``height`` nodes are one group each: a first pass up leaves the top of every block, and so on over the tops, in
    as many rounds as the largest group needs.  The pass down hands each block the siblings above it, so a version
    is worked out in its own block: it copies the leaf's ancestors (``copied``, foot to root, empty where nothing changed)
    and shares all others.  No group is larger than a block, whatever the size of a source.

    Repeated rows are leaves of their own.  Further columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    base = given(docs, doc=id_col, grp=group_col, txt=text_col, **{f"c{k}": c for k, c in enumerate(columns)})
    values = [F.col(f"c{k}") for k in range(len(columns))]
    changed = [F.replace("txt", F.lit("\n"), F.lit("")) if c == text_col else v for c, v in zip(columns, values)]
    leaf = leaf_digest(values)
    tamper = (F.crc32(F.col("doc").cast("string")) % 2 == 0) & F.col("txt").contains("\n")
    leaves = base.select(
        F.col("doc").cast("long"), F.coalesce(F.concat(F.lit("g"), F.col("grp").cast("string")), F.lit("")).alias("key"),
        leaf.alias("digest"), F.when(tamper, leaf_digest(changed)).alias("tampered"))
    leaves = written(numbered(leaves, "key", ["doc", "digest"]), "leaves")

    blocks = Blocks(height)
    groups = _climb(leaves, blocks)
    subroots = groups[-1].select(F.lit("").alias("key"), F.col("key").alias("grp"), "digest")
    subroots = written(numbered(subroots, "key", ["grp"]), "subroots")
    upper = _climb(subroots, blocks)
    tops = upper[-1].select("key", "idx", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    down = _descend(upper, tops, blocks, blocks.paths, PATHS).select("idx", "path", "root")
    down = subroots.join(down, "idx").select(F.col("grp").alias("key"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"), "root")
    out = _descend(groups, down, blocks, blocks.proofs, PROOFS)
    return out.select(F.col("doc").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"),
                      F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"), "copied")
