"""Strategies are searched and judged in one pass each."""

import math

from pyspark.sql import functions as F

from tallyloom.operators import evaluation as E
from tallyloom.operators import retrieval as R

TEXTS = ["Alpha beta, gamma alpha and what follows.", None, "", "beta beta ---", "gamma DELTA café and what follows here", "alpha"]


def _corpus(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "id long, body string").write.parquet(f"{tmp_path}/c")
    return spark.read.parquet(f"{tmp_path}/c")


def test_chunks_are_read_once_for_all_strategies(spark, tmp_path):
    c = _corpus(spark, tmp_path)
    items = spark.createDataFrame([(1, ["alpha beta, gamma alpha and what follows."]), (2, ["café and what follows here", "short"]), (3, [])], "query_id long, ground_truth array<string>")
    ddl = "query_id long, record_id long, rank int"
    lists = {"a": spark.createDataFrame([(1, 4, 1), (1, 0, 2), (2, 4, 6)], ddl), "b": spark.createDataFrame([(2, 4, 1), (2, 99, 2), (3, 0, 1)], ddl), "c": spark.createDataFrame([], ddl)}
    got = E.compare_strategies(items, lists, c, "id", "body", 5)
    leaves = got._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sum("body" in leaves.apply(i).toString() for i in range(leaves.size())) == 1
    assert got.columns == ["query_id", "precision", "recall", "mrr", "hit", "strategy"]
    want = [(*r, n) for n, h in lists.items() for r in E.query_metrics(items, E.judged(h, items, c, "id", "body"), 5).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 9
    assert {(r.strategy, r.query_id): r.mrr for r in got.collect() if r.mrr} == {("a", 1): 0.5, ("a", 2): 1 / 6, ("b", 2): 1.0}


def test_texts_are_counted_in_one_pass(spark, tmp_path):
    _, totals, terms = R.bm25_stats(_corpus(spark, tmp_path), "id", "body")
    for d in (totals, terms):
        leaves = d._jdf.queryExecution().optimizedPlan().collectLeaves()
        assert not any("body" in leaves.apply(i).toString() for i in range(leaves.size()))
    n, avgdl = totals.first()
    assert n == 6 and math.isclose(avgdl, (7 + 0 + 2 + 7 + 1) / 5)
    assert {r.term: r.df for r in terms.collect()} == {"alpha": 2, "beta": 2, "gamma": 2, "delta": 1, "caf": 1, "and": 2, "what": 2, "follows": 2, "here": 1}
    none = spark.createDataFrame([], "id long, body string")
    assert tuple(R.bm25_stats(none, "id", "body")[1].first()) == (0, None)
    q = spark.createDataFrame([(1, "alpha")], "q long, t string")
    assert R.bm25_topk(none, "id", "body", q, "q", "t", 3).count() == 0


def test_a_longer_list_holds_the_shorter(spark, tmp_path):
    c = _corpus(spark, tmp_path)
    q = spark.createDataFrame([(1, "alpha beta"), (2, "delta follows")], "q long, t string")
    long, short = R.bm25_topk(c, "id", "body", q, "q", "t", 5), R.bm25_topk(c, "id", "body", q, "q", "t", 2)
    want = sorted(map(tuple, short.collect()))
    assert sorted(map(tuple, R.first_hits(R.written(long), 2).select(*short.columns).collect())) == want and len(want) == 4
