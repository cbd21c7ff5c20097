"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import mapped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours.  Edges point down (a > b)."""
    ends = edges.select(F.col("b").alias("c"), F.col("b").alias("m")).unionByName(edges.select(F.col("a").alias("c"), F.col("b").alias("m")))
    low = ends.groupBy("c").agg(F.min("m").alias("m"))
    return edges.join(low, F.col("b") == F.col("c")).select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of these.  Edges point down (a > b)."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return out.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and a checksum that the same job observes."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
    return out, (seen.get["n"], seen.get["sum"])


def thinned(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Of the edges ``(a, b)`` of each task only those that join what it has not joined yet: the components stay the same.

    A task holds ``most`` nodes at a time, then begins anew; edges without ends pass.
    """

    def run(batches):
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = root[x]
            return x

        for batch in batches:
            if len(root) > most:
                root.clear()
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                joined = False
                if a is not None and b is not None:
                    x, y = top(a), top(b)
                    joined = x == y
                    root[max(x, y)] = min(x, y)
                keep.append(not joined)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return mapped(edges.select("a", "b"), run, "a long, b long")


def components(edges: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component = smallest reachable node.

    ``stars``: components found before, as this function returns them; the edges are added to these.

    One round is a large-star and a small-star, aggregated before each shuffle; a node with many links is split by the
    adaptive join.  Rounds grow with the logarithm of the number of nodes.  The only figures that
    reach the driver are a count and a checksum per round, taken by the job that writes the round; a task run twice can
    make them differ once more than needed, which costs a round.
    Null ends and self-links are ignored; an empty input gives an empty table.
    """
    edges = edges.select("a", "b")
    if stars is not None:
        edges = edges.unionByName(stars.select(F.col("node").alias("a"), F.col("component").alias("b")))
    now, before = _kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    while before[0]:
        now, after = _kept(_small_star(_large_star(now)))
        if after == before:
            break
        before = after
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
