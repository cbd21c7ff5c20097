"""Retrieval quality against benchmark questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_match
from .retrieval import written

MIN_MATCH = 20  # fixed value: shorter texts never match


def gt_match(chunk: Column, truth: Column) -> Column:
    """Normalised shorter text lies inside the longer one; both need 20 characters."""
    c, t = normalize_match(chunk), normalize_match(truth)
    shorter = F.when(F.length(c) <= F.length(t), F.contains(t, c)).otherwise(F.contains(c, t))
    return (F.length(c) >= MIN_MATCH) & (F.length(t) >= MIN_MATCH) & shorter


def judged(hits: DataFrame, items: DataFrame, chunks: DataFrame, rid: str, text: str, keys: tuple = ()) -> DataFrame:
    """(query_id, truth_no, rank, matched): each hit against each truth of its own question.
    ``items`` has query_id and ground_truth (array of text).  Further ``keys`` of the hits come first."""
    t = items.select("query_id", F.posexplode("ground_truth").alias("truth_no", "truth"))
    h = hits.select(*keys, "query_id", "record_id", "rank").join(
        chunks.select(F.col(rid).alias("record_id"), F.col(text).alias("__text")), "record_id")
    return h.join(t, "query_id").select(*keys, "query_id", "truth_no", "rank", gt_match(F.col("__text"), F.col("truth")).alias("matched"))


def query_metrics(items: DataFrame, judged_hits: DataFrame, k: int, keys: tuple = ()) -> DataFrame:
    """precision@k, recall@k, reciprocal rank and hit@k per question, zero-hit questions included.
    A question has at most (hits x truths) judged rows, so they are gathered per question once.  ``keys`` of items and hits
    tell apart several runs of a question."""
    j = judged_hits.groupBy(*keys, "query_id").agg(F.collect_list(F.struct("rank", "truth_no", "matched")).alias("h"))
    d = items.join(j, [*keys, "query_id"], "left").withColumn("good", F.filter(F.coalesce("h", F.array()), lambda x: x["matched"]))
    ranks = F.array_distinct(F.transform("good", lambda x: x["rank"]))
    hits = F.size(F.filter(ranks, lambda r: r <= k))
    covered = F.transform("ground_truth", lambda g, i: (F.length(normalize_match(g)) < MIN_MATCH) | F.exists(
        "good", lambda x: (x["truth_no"] == i) & (x["rank"] <= k)))
    n = F.size("ground_truth")
    recall = F.when(n > 0, F.size(F.filter(covered, lambda c: c)) / n).otherwise(1.0)
    return d.select("query_id", (hits / k if k > 0 else F.lit(0.0)).alias("precision"), recall.alias("recall"),
                    F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0)).alias("mrr"), F.when(hits > 0, 1).otherwise(0).alias("hit"), *keys)


def aggregate_metrics(per_query: DataFrame, keys: list[str] = ()) -> DataFrame:
    def mean(c):
        return F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c)

    return per_query.groupBy(*keys).agg(F.count("*").alias("num_queries"), *[mean(c) for c in ("precision", "recall", "mrr", "hit")])


def compare_strategies(items: DataFrame, hits_by_strategy: dict[str, DataFrame], chunks: DataFrame, rid: str, text: str, k: int) -> DataFrame:
    """Per-question metrics of every strategy, one table; the chunks are read once for the hits of all."""
    run, hits = "strategy", None
    for name, found in hits_by_strategy.items():
        h = found.select(F.lit(name).alias(run), "query_id", "record_id", "rank")
        hits = h if hits is None else hits.unionByName(h)
    each = items.withColumn(run, F.explode(F.array(*[F.lit(n) for n in hits_by_strategy])))
    return query_metrics(each, judged(written(hits), items, chunks, rid, text, (run,)), k, (run,))
