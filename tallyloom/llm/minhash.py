"""MinHash near-duplicates: banded minima, signature test, exact test, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, given, joined_with_groups, mapped, written
from .graph import components
from .shingles import U, mix, shingle_set, text_bytes

ROWS = 6
MISS = 1e-6
BLOCK = 256
GROUP = 64


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands after which a pair at the threshold stays unseen with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def sketcher(bands: int, rows: int, width: int):
    """Per text: set size, 128-bit fingerprint of the set, one key per band, one byte per minimum."""
    rng = np.random.default_rng(7)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * U(2) + U(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    weight = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * U(2) + U(1)
    other = U(0xD6E8FEB86659FD93)

    def minima(x: np.ndarray) -> np.ndarray:
        low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(x), 512):
            part = x[None, i:i + 512] * mul[:, None]
            part += add[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        return low >> U(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, keys, sigs = [], [], [], [], []
            for data in text_bytes(batch.column("text")):
                x = shingle_set(data, width)
                sizes.append(len(x))
                one.append(int(mix(x).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0)
                two.append(int(mix(x ^ other).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0)
                if not len(x):
                    keys.append([])
                    sigs.append(b"")
                    continue
                low = minima(x)
                keys.append(mix((low.reshape(bands, rows) * weight).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64))
                sigs.append((low & U(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["id", "n", "f1", "f2", "keys", "sig"])

    return run


def slack(threshold: float, minima: int) -> float:
    """Share of equal minima below which a pair at the threshold lies five standard deviations off."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / minima)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from one byte per minimum: one in 256 unequal minima agrees by chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) * 256 / 255


def _signature_test(least: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                yield batch.select(["a", "b"])
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array(alike(a, b) >= least))

    return run


def _open_pairs(t: pa.Table, least: float, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row by row, the rows of the other side that may link with it: another component, sizes and signatures
    that allow the threshold, and this bucket the first that the two share (so a pair is looked at once)."""
    ids, comp, n, side = (t.column(c).to_numpy() for c in ("id", "comp", "n", "side"))
    key = t.column("key")[0].as_py()
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
    keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    right = np.flatnonzero(side != 1)
    for i in np.flatnonzero(side != 2).tolist():
        js = right[right > i] if side[i] == 0 else right
        js = js[(comp[js] != comp[i]) & (den * np.minimum(n[js], n[i]) >= num * np.maximum(n[js], n[i]))]
        if len(js):
            js = js[alike(sig[js], sig[i]) >= least]
            js = js[keys[i][(keys[js] == keys[i]).argmax(axis=1)] == key]
        if len(js):
            yield i, js


def _marked(least: float, num: int, den: int):
    """Of the rows of two blocks of a bucket, those that have a partner to be tested: never more rows than came."""

    def run(group: pa.Table) -> pa.Table:
        hit = np.zeros(group.num_rows, bool)
        for i, js in _open_pairs(group, least, num, den):
            hit[i] = True
            hit[js] = True
        return group.filter(pa.array(hit))

    return run


def _linked(least: float, num: int, den: int, width: int):
    """Full sets of the marked rows: links between components, one spanning forest a task."""

    def run(group: pa.Table) -> pa.Table:
        sets = [shingle_set(d, width) for d in text_bytes(group.column("text").combine_chunks())]
        comp, ids, root, out = group.column("comp").to_numpy(), group.column("id").to_numpy(), {}, []

        def top(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        for i, js in _open_pairs(group, least, num, den):
            for j in js.tolist():
                one, two = top(comp[i]), top(comp[j])
                if one == two:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    root[max(one, two)] = min(one, two)
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _exact_test(num: int, den: int, width: int):
    """Rows sorted so that the text of ``a`` (b null) stands before its partners' texts."""

    def run(batches):
        holder, mine = None, []
        for batch in batches:
            a, b, salt = (batch.column(c).to_pylist() for c in ("a", "b", "salt"))
            keep = []
            for i, data in enumerate(text_bytes(batch.column("text"))):
                x = shingle_set(data, width)
                if b[i] is None:
                    mine = [*mine, x] if holder == (a[i], salt[i]) else [x]
                    holder = (a[i], salt[i])
                elif holder == (a[i], salt[i]):
                    for own in mine:
                        both = len(np.intersect1d(own, x, assume_unique=True))
                        if both and den * both >= num * (len(own) + len(x) - both):
                            keep.append(i)
                            break
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _confirmed(docs: DataFrame, pairs: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold.

    A document's partners are dealt to groups of about ``GROUP``; its text goes once to each group,
    every partner's text to its own, and only one set is held at a time.
    """
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("fan"))
    dealt = pairs.join(fan, "a").select("a", "b", F.expr("pmod(xxhash64(b), fan)").cast("int").alias("salt"))
    dealt = cut_lineage(dealt)
    wanted = dealt.select(F.col("b").alias("id"), "a", "b", "salt").unionByName(
        dealt.select("a", "salt").distinct().select(F.col("a").alias("id"), "a", F.lit(None).cast("long").alias("b"), "salt"))
    rows = wanted.join(docs, "id").select("a", "salt", "b", "text")
    rows = rows.repartition(*_many(rows), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return mapped(rows, _exact_test(num, den, width), "a long, b long").distinct()


def _many(df: DataFrame) -> list[int]:
    return [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100,
                    width: int = 5, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` for every row of ``docs``.

    Two documents are linked when ``den * |A & B| >= num * |A | B|`` on their sets of ``width``-word
    shingles.  Bands are so many that a linked pair escapes all of them with probability ``miss``
    at most; every pair that a band shows and that could join two components is tested, first by
    signature, then on the full sets.

    Equal sets are one node, so copies make no pairs.  In each bucket all nodes are paired with the
    smallest; pairs of others are looked at only where the bucket still holds two components after
    that, block by block inside tasks, which hand on links between components and no other pairs.

    Null or blank texts have no shingles and link with nothing.  A null id links with nothing:
    its component is null and it is kept.  Rows that repeat an id are versions of one document: a link of one counts.
    Further columns of ``docs`` are ignored.  An empty table gives an empty result.
    """
    bands = band_count(num / den, rows, miss)
    least = slack(num / den, bands * rows)
    base = given(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    sketch = written(mapped(base, sketcher(bands, rows, width), "id long, n long, f1 long, f2 long, keys array<long>, sig binary"), "minhash")

    sets = sketch.filter("n > 0 AND id IS NOT NULL")
    nodes = written(sets.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.min_by(F.struct("keys", "sig"), "id").alias("s"))
                    .select("id", "f1", "f2", "n", "s.keys", "s.sig"), "nodes")
    sigs = nodes.select("id", "n", "sig")

    buckets = nodes.select(F.explode("keys").alias("key"), "id")
    heads = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    in_bucket = cut_lineage(joined_with_groups(buckets, written(heads, "heads"), ["key"], "members"))
    stars = in_bucket.filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    fits = F.expr(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
    with_sigs = (stars.join(sigs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
                 .join(sigs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
                 .filter(fits).select("a", "b", "sa", "sb"))
    tried = cut_lineage(mapped(with_sigs, _signature_test(least), "a long, b long"))
    links = cut_lineage(_confirmed(base, tried, num, den, width))
    found = components(links)

    # What the smallest member could not decide: buckets that still hold more than one component.
    placed = in_bucket.filter("members > 2").join(found.withColumnRenamed("node", "id"), "id", "left") \
        .select("key", "id", "members", F.coalesce("component", "id").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    rest = placed.join(open_keys, "key").join(nodes.select("id", "n", "sig", "keys"), "id") \
        .withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")) \
        .withColumn("mine", F.expr("pmod(xxhash64(id), blocks)").cast("int")) \
        .withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))) \
        .select("key", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "id", "comp", "n", "sig", "keys",
                F.expr("CASE WHEN mine = with THEN 0 WHEN mine < with THEN 1 ELSE 2 END").alias("side"))
    marked = cut_lineage(rest.groupBy("key", "i", "j").applyInArrow(_marked(least, num, den), rest.schema))
    if not marked.isEmpty():
        more = marked.join(base, "id").groupBy("key", "i", "j").applyInArrow(_linked(least, num, den, width), "a long, b long")
        found = components(more, found)

    classes = nodes.select("f1", "f2", "n", "id").join(found.withColumnRenamed("node", "id"), "id", "left") \
        .select("f1", "f2", "n", F.coalesce("component", "id").alias("component"))
    out = sketch.select("id", "n", "f1", "f2", F.expr("n > 0 AND id IS NOT NULL").alias("linked"))
    joined = out.filter("linked").join(classes, ["f1", "f2", "n"]).select("id", "n", F.least("component", "id").alias("component"))
    alone = out.filter("NOT linked").select("id", "n", F.col("id").alias("component"))
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))
