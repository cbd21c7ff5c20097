"""Sentences and their chunks against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import chunks as C

CASES = {
    "One. Two! Three?": ["One.", "Two!", "Three?"],
    "Dr. Smith met Mr. J. Jansen. They left.": ["Dr. Smith met Mr. J. Jansen.", "They left."],
    'He said "Stop!" and left. "Why?" She asked.': ['He said "Stop!" and left.', '"Why?"', "She asked."],
    "It costs 3.50 euro. E.g. this, i.e. that, etc. Next one… Then": ["It costs 3.50 euro.", "E.g. this, i.e. that, etc. Next one…", "Then"],
    "(See fig. 3.) “Quoted.”  \n\tEnd": ["(See fig. 3.)", "“Quoted.”", "End"],
    "no end at all": ["no end at all"], "": [], " \n ": [], "...": ["..."], "a.b.c www.x.y": ["a.b.c www.x.y"],
}


def test_sentence_boundaries(spark):
    df = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "t string")
    got = {r.t: r.s for r in df.select("t", C.sentences("t").alias("s")).collect()}
    assert {k: got[k] for k in CASES} == CASES and got[None] is None


def pack(sizes, budget, overlap):
    out, at = [], 0
    while at < len(sizes):
        end = at
        while end + 1 < len(sizes) and sum(sizes[at:end + 2]) <= budget:
            end += 1
        out.append((at, end))
        if end + 1 == len(sizes):
            break
        again = end + 1
        while again - 1 > at and sum(sizes[again - 1:end + 1]) <= min(overlap, budget - sizes[end + 1]):
            again -= 1
        at = again
    return out


@pytest.mark.parametrize("budget,overlap", [(10, 3), (10, 0), (5, 9), (40, 12)])
def test_packing_equals_a_plain_loop(spark, budget, overlap):
    rng = random.Random(budget)
    rows = []
    for k in range(80):
        sizes = [rng.randrange(1, 15 if k % 3 else 4) for _ in range(rng.randrange(0, 40))]
        rows.append((k, sizes, " ".join(" ".join([f"W{i}x{j}" for j in range(n - 1)] + [f"W{i}end."]) for i, n in enumerate(sizes))))
    df = spark.createDataFrame([(k, t) for k, _, t in rows], "k long, t string").withColumn("chunks_before", F.lit(1))
    got = {r.k: r.chunks for r in C.sentence_chunks(df, "t", budget, overlap).collect()}
    for k, sizes, t in rows:
        s = [x + "." for x in t.split(".")[:-1]]
        s = [x.strip() for x in s]
        assert got[k] == [" ".join(s[a:b + 1]) for a, b in pack(sizes, budget, overlap)]


def test_a_long_text_and_no_worker(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(40_000))
    df = C.sentence_chunks(spark.createDataFrame([(text,), (None,), ("",)], "t string"), "t", 100, 20)
    assert "Python" not in df._jdf.queryExecution().toString()
    chunks = [r.chunks for r in df.collect()]
    assert chunks[1:] == [[], []] and len(chunks[0]) == 2500 and all(c.startswith("Sentence") and c.endswith("here.") for c in chunks[0])
