"""Search over a corpus for a set of queries: dense, lexical (BM25), fused, re-ranked.

Queries travel to the data.  Each task scores its part of the corpus against a block of
queries with matrix products and keeps only its own best k, so a query costs k rows per task
in the one shuffle, whatever the corpus size; no (query, document) pairs are emitted.  Dense queries
come in blocks of bounded bytes (a hundred thousand of 64 dimensions are one block), lexical ones in blocks of bounded rows;
each block is one pass over the two columns of the corpus that are needed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx
from ..functions.vectors import TopK
from ..scale import DRIVER_ROWS, QUERY_BYTES, cut_lineage, first_per, scratch_dir, setting, spread

#: Scores that a task works out at a time.
SCORES = 4_000_000
_SQL_TYPES = {"bigint": pa.int64(), "int": pa.int64(), "string": pa.string()}


def _blocks(queries: DataFrame, qid: str, limit: int):
    """Query rows in blocks of about ``limit`` rows, small enough for the driver and a task."""
    rows = queries.limit(limit + 1).collect()
    if len(rows) <= limit:
        return [rows]
    n = math.ceil(1.1 * queries.count() / limit)
    part = F.pmod(F.xxhash64(qid), F.lit(n))
    return (queries.filter(part == i).collect() for i in range(n))


def _dense_rows(queries: DataFrame, vec: str) -> int:
    """Rows of a block of vectors: as many as the bytes allow."""
    width = queries.agg(F.max(F.size(vec))).first()[0] or 1
    return max(1, setting(queries.sparkSession, QUERY_BYTES) // (8 * max(width, 1)))


def _search(corpus: DataFrame, rid: str, col: str, queries: DataFrame, qid: str, k: int, prepare, score, block: int | None = None) -> DataFrame:
    spark = corpus.sparkSession
    block = block or setting(spark, DRIVER_ROWS)
    rtype, qtype = dict(corpus.dtypes)[rid], dict(queries.dtypes)[qid]
    id_type, out = _SQL_TYPES[rtype], None
    schema = f"query_id {qtype if qtype == 'string' else 'bigint'}, record_id {'string' if rtype == 'string' else 'bigint'}, score double"
    for rows in _blocks(queries, qid, block):
        if not rows:
            continue
        state = spark.sparkContext.broadcast(([r[0] for r in rows], prepare(rows)))  # bounded by the block size

        def task(batches, state=state):
            qids, prep = state.value
            top = TopK(len(qids), k)
            for b in batches:
                if b.num_rows:
                    for ids, scores in score(b.column(0).to_numpy(zero_copy_only=False), b.column(1), prep):
                        top.add(ids, scores)
            yield top.batch(qids, id_type)

        hits = corpus.select(rid, col).mapInArrow(task, schema)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    return first_per(out, ["query_id"], [F.desc("score"), F.asc("record_id")], k, rank="rank")


def _unit_rows(lists) -> np.ndarray:
    m = np.asarray(lists, dtype="float64")
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def dense_topk(corpus: DataFrame, rid: str, vec: str, queries: DataFrame, qid: str, qvec: str, k: int) -> DataFrame:
    """(query_id, record_id, score, rank) by cosine; ties by record id."""

    def prepare(rows):
        dim = len(rows[0][1])
        return dim, _unit_rows([r[1] for r in rows]).T

    def score(ids, col, prep):
        dim, q = prep
        lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
        fit = lens == dim
        if fit.all():
            m = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        else:
            m = np.zeros((len(ids), dim))
            for i in np.nonzero(fit)[0]:
                m[i] = col[int(i)].as_py()
        units = _unit_rows(m)
        step = max(1, SCORES // q.shape[1])
        for a in range(0, len(ids), step):
            yield ids[a:a + step], units[a:a + step] @ q

    queries = cut_lineage(queries.select(qid, qvec))  # read for their width and then block by block
    return _search(corpus, rid, vec, queries, qid, k, prepare, score, _dense_rows(queries, qvec))


# Term saturation, length weight, and the share of the mean idf given to terms
# found in more than half of the documents.
K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25_stats(corpus: DataFrame, rid: str, text: str):
    """(tokens table, one-row totals, term table) in one pass over the texts; give them to further searches of the corpus."""
    toks = spread(corpus.select(rid, text)).select(rid, tx.tokens(text).alias("tokens"))
    # no token is empty, so the empty term stands once in each document and sums up the documents
    once = F.concat(F.array(F.lit("")), F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>")))
    seen = toks.select(F.size("tokens").alias("len"), F.explode(once).alias("term"))
    counts = cut_lineage(seen.groupBy("term").agg(F.count("*").alias("df"), F.avg(F.when(F.col("term") == "", F.col("len"))).alias("avgdl")))
    totals = counts.filter("term = ''").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n"), F.max("avgdl").alias("avgdl"))
    return toks, totals, counts.filter("term <> ''").select("term", "df")


def bm25_topk(corpus: DataFrame, rid: str, text: str, queries: DataFrame, qid: str, qtext: str, k: int,
              stats=None) -> DataFrame:
    """Lexical ranking.  Adds ``raw`` (BM25) and ``score`` (min-max over the k hits of a query)."""
    toks, totals, terms = stats or bm25_stats(corpus, rid, text)
    n, avgdl = totals.first()
    q = queries.select(qid, tx.tokens(qtext).alias("qt")).filter(F.size("qt") > 0)
    idf = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = terms.withColumn("idf", idf)
    mean = terms.agg(F.avg("idf")).first()[0] or 0.0
    # each query carries the idf of its own words, so no list of all words is needed anywhere
    asked = q.select(qid, F.explode("qt").alias("term")).join(terms.select("term", "idf"), "term", "left")
    weighed = F.when(F.col("idf").isNotNull(), F.struct("term", "idf"))
    q = cut_lineage(asked.groupBy(qid).agg(F.sort_array(F.collect_list(weighed)).alias("qt")))

    def prepare(rows):
        words = sorted({t for r in rows for t, _ in r[1]})
        at = {w: i for i, w in enumerate(words)}
        c = np.zeros((len(words), len(rows)))
        for j, r in enumerate(rows):
            for w, v in r[1]:
                c[at[w], j] += v if v >= 0 else EPSILON * mean
        return words, c

    def score(ids, col, prep):
        words, c = prep
        if not words:
            yield ids, np.zeros((len(ids), c.shape[1]))
            return
        lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
        hit = pc.index_in(col.flatten(), value_set=pa.array(words)).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ids)), lens)
        ok = ~np.isnan(hit.astype("float64"))
        row, hit = row[ok], hit[ok].astype("int64")
        step = max(1, 4_000_000 // len(words))
        norm = K1 * (1 - B + B * lens / avgdl)
        for a in range(0, len(ids), step):
            b = min(a + step, len(ids))
            sel = (row >= a) & (row < b)
            tf = np.bincount((row[sel] - a) * len(words) + hit[sel], minlength=(b - a) * len(words)).reshape(b - a, -1)
            w = tf * (K1 + 1) / np.where(tf > 0, tf + norm[a:b, None], 1.0)
            yield ids[a:b], w @ c

    hits = _search(toks, rid, "tokens", q, qid, k, prepare, score)
    return minmax(hits.withColumnRenamed("score", "raw"), "raw")


def minmax(hits: DataFrame, raw: str, out: str = "score", flat: float = 0.0) -> DataFrame:
    """Per query, (x - min) / (max - min); ``flat`` when all are equal.  Hit lists are k rows each."""
    w = W.partitionBy("query_id")
    lo, hi = F.min(raw).over(w), F.max(raw).over(w)
    return hits.withColumn(out, F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(raw) - lo) / (hi - lo)))).otherwise(flat))


RRF_K = 60  # fixed value


def rrf(lists: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion; equal scores keep the order of first appearance."""
    u = None
    for i, h in enumerate(lists):
        d = h.select("query_id", "record_id", F.lit(i).alias("li"), "rank")
        u = d if u is None else u.unionByName(d)
    g = u.groupBy("query_id", "record_id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("raw"),
                                               F.min(F.struct("li", "rank")).alias("seen"))
    g = minmax(g.withColumn("raw", F.round("raw", 12)), "raw", flat=1.0)
    return first_per(g, ["query_id"], [F.desc("raw"), "seen"], k, rank="rank").drop("seen")


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Order by a pair score (built-in expression or pandas UDF), min-max over all candidates, first k."""
    d = minmax(hits.drop("score", "rank").withColumn("raw", score), "raw")
    return first_per(d, ["query_id"], [F.desc("raw"), "record_id"], k, rank="rank")


def mmr(hits: DataFrame, vectors: DataFrame, rid: str, vec: str, queries: DataFrame, qid: str, qvec: str,
        k: int, lam: float = 0.7) -> DataFrame:
    """Greedy relevance/diversity order of each query's hit list (at most a few hundred rows)."""
    d = hits.select("query_id", "record_id", "rank").join(
        vectors.select(F.col(rid).alias("record_id"), F.col(vec).alias("v")), "record_id").join(
        queries.select(F.col(qid).alias("query_id"), F.col(qvec).alias("qv")), "query_id")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        m = _unit_rows(list(pdf["v"]))
        rel = (m @ _unit_rows([pdf["qv"][0]])[0])
        worst, left, out = np.full(len(pdf), -np.inf), list(range(len(pdf))), []
        while left and len(out) < k:
            val = np.round(rel[left] if not out else lam * rel[left] - (1 - lam) * worst[left], 12)
            j = int(np.argmax(val))
            i = left.pop(j)
            out.append((pdf["query_id"][i], pdf["record_id"][i], len(out) + 1, float(min(1.0, max(0.0, val[j])))))
            worst = np.maximum(worst, m @ m[i])
        return pd.DataFrame(out, columns=["query_id", "record_id", "rank", "score"])

    t = dict(hits.dtypes)
    return d.groupBy("query_id").applyInPandas(pick, f"query_id {t['query_id']}, record_id {t['record_id']}, rank int, score double")


def first_hits(hits: DataFrame, k: int) -> DataFrame:
    """The list that a search for ``k`` gives, out of one for more; scores of lexical hits are scaled over the k again."""
    d = hits.filter(F.col("rank") <= k)
    return minmax(d, "raw") if "raw" in hits.columns else d


def written(hits: DataFrame) -> DataFrame:
    """Hits found once for all that use them, and read back with their true size, so that joins know them as small."""
    out = scratch_dir(hits.sparkSession, "hits")
    hits.write.parquet(out)
    return hits.sparkSession.read.schema(hits.schema).parquet(out)


def threshold_then_slice(hits: DataFrame, threshold: float, k: int) -> DataFrame:
    """Drop hits under the threshold (only when it is positive), then the first k that remain."""
    d = hits.filter(F.col("score") >= threshold) if threshold > 0 else hits
    return first_per(d.withColumnRenamed("rank", "__old"), ["query_id"], ["__old"], k, rank="rank").drop("__old")


def retrieve(strategy: str, dense, sparse, k: int, reranker=None, diversify=None, threshold: float = 0.0) -> DataFrame:
    """One ranked list by strategy name.  ``dense(n)`` and ``sparse(n)`` return n-hit lists."""
    n = 100 if reranker else k
    if strategy in ("sparse", "bm25"):
        hits = sparse(n)
    elif strategy == "hybrid":
        hits = rrf([dense(2 * n), sparse(2 * n)], n)
    else:
        hits = dense(n)
    if reranker:
        hits = reranker(hits, n)
    if diversify:
        hits = diversify(hits, k)
    return threshold_then_slice(hits, threshold, k)


def answer_context(queries: DataFrame, qid: str, hits: DataFrame, chunks: DataFrame, rid: str, name: str, page: str, text: str) -> DataFrame:
    """Per query: context block, sources, number of hits, mean score and band; queries without hits stay."""
    h = hits.join(chunks.select(F.col(rid).alias("record_id"), F.col(name).alias("name"), F.col(page).alias("page"), F.col(text).alias("text")), "record_id")
    block = F.concat(F.lit("Document: "), F.col("name").cast("string"), F.lit("\nContent: "), F.col("text"))
    g = h.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"),
        F.sort_array(F.collect_list(F.struct("rank", "name", "page", "score", tx.preview("text").alias("preview")))).alias("sources"),
        F.count("*").alias("chunks_retrieved"), F.avg("score").alias("average_similarity"))
    out = queries.select(F.col(qid).alias("query_id")).join(g, "query_id", "left").na.fill(0, ["chunks_retrieved", "average_similarity"])
    avg = F.col("average_similarity")
    return out.withColumn("context", F.coalesce(F.array_join(F.transform("bs", lambda b: b["b"]), "\n\n"), F.lit(""))) \
        .withColumn("confidence", F.when(avg > 0.8, "high").when(avg > 0.6, "medium").otherwise("low")).drop("bs")


def score_stability(before: DataFrame, after: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Full comparison of two hit lists: score change, rank move, and who is new or gone."""
    a = before.select("query_id", "record_id", F.col("score").alias("s0"), F.col("rank").alias("r0"))
    b = after.select("query_id", "record_id", F.col("score").alias("s1"), F.col("rank").alias("r1"))
    j = a.join(b, ["query_id", "record_id"], "full")
    status = F.when(F.col("r0").isNull(), "new").when(F.col("r1").isNull(), "gone").when(F.col("r0") != F.col("r1"), "moved").otherwise("same")
    return j.withColumn("abs_diff", F.abs(F.col("s0") - F.col("s1"))).withColumn("stable", F.coalesce(F.col("abs_diff") <= tol, F.lit(False))) \
        .withColumn("status", status)


def topk_prefix_check(short: DataFrame, long: DataFrame, k: int) -> DataFrame:
    """Per query: do the first k of the long list equal the short list?"""
    a = short.filter(F.col("rank") <= k).select("query_id", "rank", F.col("record_id").alias("a"))
    b = long.filter(F.col("rank") <= k).select("query_id", "rank", F.col("record_id").alias("b"))
    return a.join(b, ["query_id", "rank"], "full").groupBy("query_id").agg(
        F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("same"), F.count("*").alias("n"))
