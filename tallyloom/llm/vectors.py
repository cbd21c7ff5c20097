"""Embedding near-duplicates by E8 lattice hashing, confirmed by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, given, mapped, written
from .graph import components, thinned
from .lattice import minimal_vectors, nearest

TABLES = 12
BLOCKS = 2
PROBES = 8
SCALE = 5.0
MEMBERS = 512


class Hasher:
    """Cells of unit vectors in several tables.  A cell is ``blocks`` E8 points, each of eight random projections."""

    def __init__(self, size: int, threshold: float, tables: int, blocks: int, probes: int, scale: float):
        rng = np.random.default_rng([8, size])
        self.blocks, self.probes = blocks, probes
        self.scale = scale * math.sqrt(size / 64) * math.sqrt(0.05 / max(1e-6, 1 - threshold))
        self.maps = [self._projection(rng, size, 8 * blocks) for _ in range(tables)]
        self.weights = rng.integers(0, 1 << 63, (tables, 8 * blocks), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, tables, dtype=np.uint64)
        self.near = minimal_vectors()

    @staticmethod
    def _projection(rng, size: int, wide: int) -> np.ndarray:
        raw = rng.normal(size=(size, wide))
        return np.linalg.qr(raw)[0] if size >= wide else raw / math.sqrt(size)

    def _name(self, points: np.ndarray, table: int) -> np.ndarray:
        twice = np.rint(2 * points).astype(np.int64).view(np.uint64)
        x = (twice * self.weights[table]).sum(axis=-1, dtype=np.uint64) + self.salt[table]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))).view(np.int64)

    def cells(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cells (n, tables) and the neighbouring cells whose points come next (n, tables * probes)."""
        homes, around = [], []
        rows = np.arange(len(units))
        for t, projection in enumerate(self.maps):
            y = self.scale * (units @ projection)
            home = np.concatenate([nearest(y[:, 8 * b:8 * b + 8]) for b in range(self.blocks)], axis=1)
            homes.append(self._name(home, t))
            gain = np.concatenate([(y - home)[:, 8 * b:8 * b + 8] @ self.near.T for b in range(self.blocks)], axis=1)
            order = np.argsort(-gain, axis=1, kind="stable")[:, :self.probes]
            for p in range(self.probes):
                block, step = order[:, p] // 240, self.near[order[:, p] % 240]
                moved = home.reshape(-1, self.blocks, 8).copy()
                moved[rows, block] += step
                around.append(self._name(moved.reshape(len(units), -1), t))
        return np.stack(homes, axis=1), np.stack(around, axis=1)


def _units(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _valid(kind: str):
    """Vectors as bytes; null where a vector can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v"):
                raw = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    raw = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    raw = raw.tobytes() if np.isfinite(raw).all() and raw.any() else None
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "raw"])

    return run


def _celled(kind: str, settings: tuple):
    def run(batches):
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            sizes = np.array([len(r) for r in raws])
            homes, around = [None] * len(raws), [None] * len(raws)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                units = _units(np.frombuffer(b"".join(raws[i] for i in at), kind).reshape(len(at), -1))
                hasher = hashers.setdefault(size, Hasher(units.shape[1], *settings))
                for part in range(0, len(at), 2048):
                    h, a = hasher.cells(units[part:part + 2048])
                    for i, x, y in zip(at[part:part + 2048], h, a):
                        homes[i], around[i] = x, y
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(homes, pa.list_(pa.int64())), pa.array(around, pa.list_(pa.int64()))], ["id", "homes", "around"])

    return run


def _links(kind: str, threshold: float):
    """Rows sorted by (cell, i, j): links inside each group, unless an earlier table holds both in one home cell."""

    def group(rows: list[tuple], out: list) -> None:
        home = np.array([r[4] for r in rows])
        if not home.any() or len(rows) < 2 or len({r[3] for r in rows}) < 2:
            return
        ids, tab, side = np.array([r[3] for r in rows]), rows[0][5], np.array([r[8] for r in rows])
        sizes = {len(r[6]) for r in rows}
        for size in sizes:
            at = np.array([k for k, r in enumerate(rows) if len(r[6]) == size])
            units = _units(np.frombuffer(b"".join(rows[k][6] for k in at), kind).reshape(len(at), -1))
            near = units @ units.T >= threshold
            near &= home[at][:, None] | home[at][None, :]
            near &= ids[at][:, None] < ids[at][None, :]
            s = side[at]
            near &= ((s[:, None] == 0) & (s[None, :] == 0)) | ((s[:, None] > 0) & (s[None, :] > 0) & (s[:, None] != s[None, :]))
            for a, b in zip(*np.nonzero(near)):
                x, y = rows[at[a]], rows[at[b]]
                if not any(p == q for p, q in zip(x[7][:tab], y[7][:tab])):
                    out.append((x[3], y[3], x[9], y[9]))

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "i", "j", "id", "home", "tab", "raw", "homes", "side", "m"))):
                if rows and row[:3] != rows[-1][:3]:
                    group(rows, out)
                    rows = []
                rows.append(row)
            yield _pairs(out)
        out = []
        group(rows, out) if rows else None
        yield _pairs(out)

    return run


def _pairs(out: list) -> pa.RecordBatch:
    cols = list(zip(*sorted(set(out)))) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "ma", "mb"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                 tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row: links are pairs of cosine >= ``threshold``.

    Every vector stands in its home cell of each table; two vectors meet where one's home is the other's home or
    among its ``probes`` nearest neighbouring cells.  A pair at the threshold meets in some table with
    probability above 0.99, closer pairs more surely; no pair below it is linked.  Cells are
    thin rows; vectors travel only to cells with at least two of them, and large cells are cut into blocks of
    about ``MEMBERS``.  For more than some millions of vectors use ``blocks=3`` and twice the tables.

    Equal vectors are one node with a count.  Null, empty, zero, non-finite vectors and those with null
    components link with nothing, nor do null ids (component null, kept).  Vectors of different length never
    link.  Rows that repeat an id each count as a vector; a row's ``component_id`` is the smallest id reachable.
    Further columns are ignored.  An empty table gives an empty result.
    """
    wide = dict(vectors.select(F.col(f"`{vector_col}`").alias("v")).dtypes)["v"] != "array<float>"
    kind = "<f8" if wide else "<f4"
    base = given(vectors, id=id_col, v=vector_col).select(F.col("id").cast("long"), F.col("v").cast("array<double>" if wide else "array<float>").alias("v"))
    raw = mapped(base, _valid(kind), "id long, raw binary")
    raw = written(raw.withColumns({"f1": F.xxhash64("raw"), "f2": F.xxhash64(F.lit(3), "raw")}), "vectors")
    live = raw.filter("raw IS NOT NULL AND id IS NOT NULL")
    nodes = written(live.groupBy("f1", "f2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"), F.first("raw").alias("raw")), "nodes")

    settings = (threshold, tables, blocks, probes, scale)
    celled = written(mapped(nodes.select("id", "raw"), _celled(kind, settings), "id long, homes array<long>, around array<long>"), "cells")
    entries = celled.select("id", F.posexplode("homes").alias("tab", "cell"), F.lit(True).alias("home")).unionByName(
        celled.select("id", F.posexplode("around").alias("tab", "cell"), F.lit(False).alias("home"))
        .withColumn("tab", F.floor(F.col("tab") / probes).cast("int")))
    cells = cut_lineage(entries.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.max("home").alias("home")).filter("members > 1 AND home").select("cell", "members"))
    met = entries.join(cells, "cell") \
        .withColumn("parts", F.ceil(F.col("members") / MEMBERS).cast("int")) \
        .withColumn("mine", F.expr("pmod(xxhash64(id, 9), parts)").cast("int")) \
        .withColumn("with", F.explode(F.expr("sequence(0, parts - 1)"))) \
        .select("cell", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "id", "home", "tab",
                F.expr("CASE WHEN mine = with THEN 0 WHEN mine < with THEN 1 ELSE 2 END").alias("side"))
    full = met.join(nodes.select("id", "m", "raw").join(celled.select("id", "homes"), "id"), "id")
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = full.repartition(width, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    links = written(mapped(full, _links(kind, threshold), "a long, b long, ma long, mb long").distinct(), "links")

    more = links.select(F.col("a").alias("id"), F.col("mb").alias("n")).unionByName(links.select(F.col("b").alias("id"), F.col("ma").alias("n"))) \
        .groupBy("id").agg(F.sum("n").alias("n"))
    found = components(thinned(links)).withColumnRenamed("node", "id")
    classes = nodes.select("f1", "f2", "id", "m").join(more, "id", "left").join(found, "id", "left") \
        .select("f1", "f2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component"))
    classes = cut_lineage(classes)
    linked = live.select("id", "f1", "f2").join(classes, ["f1", "f2"]).select("id", "n", "component")
    alone = raw.filter("raw IS NULL OR id IS NULL").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))
