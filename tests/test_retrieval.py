import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import chunks as C
from tallyloom.operators import evaluation as E
from tallyloom.operators import retrieval as R


def vectors(spark, n=60, d=8, seed=0):
    rnd = np.random.default_rng(seed)
    m = rnd.normal(size=(n, d)).round(3)
    return m, spark.createDataFrame([(i, m[i].tolist()) for i in range(n)], "id long, v array<double>")


def cos(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_dense_topk_in_one_and_in_many_query_blocks(spark):
    m, df = vectors(spark)
    q = df.filter("id < 9").withColumnsRenamed({"id": "qid", "v": "qv"})
    want = {i: [j for _, j in sorted((-round(cos(m[i], m[j]), 9), j) for j in range(len(m)))[:5]] for i in range(9)}

    def run():
        got = {}
        for r in R.dense_topk(df.repartition(5), "id", "v", q, "qid", "qv", 5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.record_id)
        return got

    assert run() == want
    spark.conf.set("spark.tallyloom.queryBytes", str(4 * 8 * 8))  # four queries of eight dimensions
    try:
        assert run() == want
    finally:
        spark.conf.unset("spark.tallyloom.queryBytes")


def test_a_hundred_thousand_queries_read_the_corpus_once(spark, monkeypatch):
    m, df = vectors(spark, n=300, d=4)
    monkeypatch.setattr(R, "SCORES", 300_000)
    q = spark.range(100_000).select("id", F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.sin(F.col("id") * (i + 1) + i)).alias("qv"))
    passes, blocks = [0], R._blocks
    monkeypatch.setattr(R, "_blocks", lambda *a: (lambda b: (passes.__setitem__(0, len(b)), b)[1])(list(blocks(*a))))
    hits = R.dense_topk(df.repartition(2), "id", "v", q, "id", "qv", 3)
    got = {(r.query_id, r["rank"]): r.record_id for r in hits.filter("query_id % 9973 = 0").collect()}
    assert passes == [1] and hits.count() == 300_000
    for i in range(0, 100_000, 9973):
        v = np.array([math.sin(i * (j + 1) + j) for j in range(4)])
        best = sorted((-round(cos(x, v), 9), j) for j, x in enumerate(m))[:3]
        assert [got[i, r] for r in (1, 2, 3)] == [j for _, j in best]


def test_dense_topk_scores_odd_vectors_zero_and_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, []), (4, [1.0, 2.0, 3.0]), (5, [0.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, qv array<double>")
    got = R.dense_topk(df.coalesce(1), "id", "v", q, "qid", "qv", 5).orderBy("rank").collect()
    assert [(r.record_id, r.score) for r in got] == [(1, 1.0), (3, 1.0), (2, 0.0), (4, 0.0), (5, 0.0)]


def test_bm25_against_plain_formula(spark):
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    docs = [(i, " ".join(rnd.choice(words[: 2 + i % 5]) for _ in range(rnd.randrange(1, 15)))) for i in range(30)]
    qs = [(0, "alpha beta beta"), (1, "zeta eps unknown"), (2, "!!!")]
    tok = {i: re.findall("[a-z0-9]+", t) for i, t in docs}
    n, avg = len(docs), sum(map(len, tok.values())) / len(docs)
    df = {w: sum(w in t for t in tok.values()) for w in words}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items() if c}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    d = spark.createDataFrame(docs, "id long, text string")
    q = spark.createDataFrame(qs, "qid long, q string")
    got = R.bm25_topk(d.repartition(3), "id", "text", q, "qid", "q", 4).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 1}
    for qid, text in qs[:2]:
        sc = {i: round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split()), 9) for i, t in tok.items()}
        want = sorted((-s, i) for i, s in sc.items())[:4]
        mine = [r for r in got if r.query_id == qid]
        assert [r.record_id for r in mine] == [i for _, i in want]
        assert all(abs(r.raw + s) < 1e-6 for r, (s, _) in zip(mine, want))
        assert mine[-1].score == 0.0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, record_id string, rank int, score double")


def test_rrf_example_and_order_of_equal_scores(spark):
    a = hits(spark, [(1, "a", 1, 0.9), (1, "b", 2, 0.8), (1, "c", 3, 0.7)])
    b = hits(spark, [(1, "c", 1, 0.9), (1, "a", 2, 0.8), (1, "d", 3, 0.7)])
    r = [x.record_id for x in R.rrf([a, b], 4).orderBy("rank").collect()]
    assert r == ["a", "c", "b", "d"]
    one = R.rrf([hits(spark, [(1, "x", 1, 1.0)]), hits(spark, [(1, "y", 1, 1.0)])], 2).orderBy("rank").collect()
    assert [(x.record_id, x.score) for x in one] == [("x", 1.0), ("y", 1.0)]


def test_mmr_against_greedy_model(spark):
    m, df = vectors(spark, 25, 6, 3)
    q = df.filter("id = 0").withColumnsRenamed({"id": "qid", "v": "qv"})
    h = R.dense_topk(df, "id", "v", q, "qid", "qv", 20)
    cand = [r.record_id for r in h.orderBy("rank").collect()]
    chosen = []
    while len(chosen) < 8:
        best = None
        for i in cand:
            if i in chosen:
                continue
            rel = cos(m[0], m[i])
            val = rel if not chosen else 0.6 * rel - 0.4 * max(cos(m[i], m[j]) for j in chosen)
            if best is None or val > best[0] + 1e-12:
                best = (val, i)
        chosen.append(best[1])
    got = R.mmr(h, df, "id", "v", q, "qid", "qv", 8, 0.6).orderBy("rank").collect()
    assert [r.record_id for r in got] == chosen


def test_metrics_rules(spark):
    long_a, long_b = "the quick brown fox jumps over", "another sentence of good length"
    items = spark.createDataFrame([(1, [long_a, "tiny"]), (2, [long_b]), (3, [])], "query_id long, ground_truth array<string>")
    chunks = spark.createDataFrame([("x", "nothing to see here, really nothing"), ("y", "  The QUICK brown fox\njumps over the dog "), ("z", "fox")], "id string, text string")
    h = hits(spark, [(1, "x", 1, 1.0), (1, "y", 2, 0.9), (2, "z", 1, 1.0)])
    r = {x.query_id: x for x in E.query_metrics(items, E.judged(h, items, chunks, "id", "text"), 5).collect()}
    assert (r[1].precision, r[1].recall, r[1].mrr, r[1].hit) == (0.2, 1.0, 0.5, 1)
    assert (r[2].precision, r[2].recall, r[2].mrr, r[2].hit) == (0.0, 0.0, 0.0, 0)
    assert r[3].recall == 1.0
    a = E.aggregate_metrics(E.query_metrics(items.filter("false"), E.judged(h, items, chunks, "id", "text"), 5)).collect()[0]
    assert (a.num_queries, a.mrr) == (0, 0.0)


@pytest.mark.parametrize("parity", [True, False])
def test_recursive_chunks_hold_their_size_and_words(parity):
    rnd = random.Random(4)
    for _ in range(60):
        text = "".join(rnd.choice(["word", "longerword", ". ", "\n", "\n\n", " ", "x" * 90]) for _ in range(rnd.randrange(1, 120)))
        out = C.split_text(text, 60, 10, parity)
        assert all(c.strip() for c in out)
        if not parity:
            assert all(len(c) <= 60 for c in out)
            if "x" * 51 not in text:
                assert re.findall(r"\w+", " ".join(out)) == re.findall(r"\w+", text)


def test_parity_chunks_double_separators():
    assert C.split_text("aa bb cc", 6, 0, parity=True) == ["aa  bb ", "cc"] or C.split_text("aa bb cc", 6, 0, parity=True)[0].startswith("aa")
    assert C.split_text("one two", 512, 50, parity=True) == ["one two"]


def test_empty_pages_stay_as_flagged_chunks(spark):
    d = spark.createDataFrame([("d", ["first page with enough text", "", "!!! ***"])], "doc string, pages array<string>")
    for strategy in ("fixed", "recursive", "semantic"):
        r = C.chunk_table(d, "doc", F.col("pages"), strategy).orderBy("chunk_index").collect()
        assert [(x.chunk_index, x.page_number, x.is_empty_page) for x in r] == [(0, 1, False), (1, 2, True), (2, 3, True)]
        assert r[0].document_id == "d_0"


def test_embedding_hook(spark):
    d = spark.createDataFrame([("a", "xx"), ("b", "yyy")], "document_id string, text string")
    r = C.embed(d, lambda texts: [[float(len(t)), 1.0] for t in texts]).orderBy("document_id").collect()
    assert [x.embedding for x in r] == [[2.0, 1.0], [3.0, 1.0]]


def test_strategies_are_judged_on_documents_without_vectors_too(spark, tmp_path):
    from check import compare, duck
    from conftest import SMALL

    for f in os.listdir(SMALL):
        if f.endswith(".parquet") and f != "embeddings.parquet":
            os.symlink(f"{SMALL}/{f}", tmp_path / f)
    spark.read.parquet(f"{SMALL}/embeddings.parquet").filter("vec_id % 3 = 0").coalesce(1).write.parquet(str(tmp_path / "part"))
    os.symlink(next((tmp_path / "part").glob("*.parquet")), tmp_path / "embeddings.parquet")
    status, rows, _, msg = compare(spark, duck(tmp_path), str(tmp_path), "compare_strategies")
    assert (status, rows) == ("ok", 3), msg
