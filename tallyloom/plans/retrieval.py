"""Dense, lexical and fused search, re-ranking and evaluation queries."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine
from ..operators import evaluation as E
from ..operators import retrieval as R
from .registry import query
from .text import norm_sql, toks_sql

K = 10

# queries = the mean vector of each label; corpus = every vector
CENTROIDS = """pv AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
 cm AS (SELECT label, i, avg(x) AS x FROM pv GROUP BY 1, 2), qv AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM cm GROUP BY 1),
 ev AS (SELECT vec_id AS record_id, label, embedding::DOUBLE[] AS v FROM embeddings)"""


def dense_sql(k, where="true", src="ev", out="dh"):
    return f"""{out} AS (SELECT * FROM (SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank
   FROM (SELECT qv.query_id, {src}.record_id, round(list_cosine_similarity(qv.v, {src}.v), 9) AS score FROM qv, {src} WHERE {where})) WHERE rank <= {k})"""


ROUGH = "rv AS (SELECT vec_id AS record_id, label, list_transform(embedding::DOUBLE[], lambda x: round(x, 1)) AS v FROM embeddings)"


def centroids(t):
    x = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    m = x.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def dense(t, k, corpus=None):
    return R.dense_topk(corpus if corpus is not None else t.embeddings, "vec_id", "embedding", centroids(t), "query_id", "v", k)


def shown(hits):
    return hits.select("query_id", "record_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


PICK = "SELECT query_id, record_id, rank, round(score, 6) AS score FROM"


@query("dense_retrieve", f"WITH {CENTROIDS}, {dense_sql(K)} {PICK} dh")
def _(t):
    return shown(dense(t, K))


@query("dense_topk", f"WITH {CENTROIDS}, {dense_sql(20)} {PICK} dh")
def _(t):
    return shown(dense(t, 20))


@query("cosine", f"""WITH {CENTROIDS} SELECT record_id, round(list_cosine_similarity(ev.v, qv.v), 6) AS score FROM ev JOIN qv ON ev.label = qv.query_id""")
def _(t):
    q = centroids(t)
    return t.embeddings.join(q, F.col("label") == F.col("query_id")).select(F.col("vec_id").alias("record_id"), F.round(cosine(F.col("embedding"), F.col("v")), 6).alias("score"))


@query("filtered_topk", f"""WITH {CENTROIDS}, {dense_sql(K, "ev.v[2] < 0.1 AND ev.v[1] >= 0")} SELECT query_id, record_id, rank, round(greatest(0, score), 6) AS score FROM dh""")
def _(t):
    c = t.embeddings.filter((F.get("embedding", F.lit(1)).cast("double") < 0.1) & (F.get("embedding", F.lit(0)) >= 0))
    return shown(dense(t, K, c)).withColumn("score", F.greatest(F.lit(0.0), "score"))


@query("own_plus_shared_topk", f"""WITH {CENTROIDS}, {dense_sql(K, "qv.query_id > 0 AND ev.label = qv.query_id", out="own")}, {dense_sql(K, "qv.query_id > 0 AND ev.label = 0", out="shr")},
 u AS (SELECT * FROM own UNION ALL SELECT * FROM shr) SELECT query_id, record_id, rank, round(score, 6) AS score FROM (SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM u) WHERE rank <= {K}""")
def _(t):
    """Requests of every role over its own store; role 0 is the shared one."""
    from ..operators.memory import own_plus_shared

    q, own = centroids(t).filter("query_id > 0"), None
    shared = R.dense_topk(t.embeddings.filter("label = 0"), "vec_id", "embedding", q, "query_id", "v", K)
    for (role,) in t.embeddings.filter("label > 0").select("label").distinct().orderBy("label").collect():  # roles are few
        mine = R.dense_topk(t.embeddings.filter(F.col("label") == role), "vec_id", "embedding", q.filter(F.col("query_id") == role), "query_id", "v", K)
        own = mine if own is None else own.unionByName(mine)
    return shown(own_plus_shared(own if own is not None else shared.limit(0), shared, K, allowed=True))


@query("threshold_then_slice", f"WITH {CENTROIDS}, {dense_sql(50)}, f AS (SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM dh WHERE score >= 0.2) {PICK} f WHERE rank <= 5")
def _(t):
    return shown(R.threshold_then_slice(dense(t, 50), 0.2, 5))


def bm25_ctes(k, docs="SELECT doc_id AS id, text FROM documents", qs="SELECT item_id AS q, text FROM benchmark", out="sh"):
    return f"""bd AS ({docs}), bt AS (SELECT id, unnest({toks_sql('text')}) AS t FROM bd), dl AS (SELECT id, len({toks_sql('text')}) AS dl FROM bd),
 cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), tf AS (SELECT id, t, count(*) AS tf FROM bt GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
 id0 AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, cs), idf AS (SELECT t, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM id0) ELSE idf END AS idf FROM id0),
 bq AS ({qs}), qt AS (SELECT q, t, count(*) AS c FROM (SELECT q, unnest({toks_sql('text')}) AS t FROM bq) GROUP BY 1, 2),
 sc AS (SELECT q, tf.id, sum(c * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM qt JOIN tf USING (t) JOIN idf USING (t) JOIN dl USING (id), cs GROUP BY 1, 2),
 al AS (SELECT qq.q AS query_id, bd.id AS record_id, round(coalesce(s, 0), 9) AS raw FROM (SELECT DISTINCT q FROM qt) qq CROSS JOIN bd LEFT JOIN sc ON sc.q = qq.q AND sc.id = bd.id),
 rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, record_id) AS rank FROM al) WHERE rank <= {k}),
 {out} AS (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY query_id) > min(raw) OVER (PARTITION BY query_id) THEN (raw - min(raw) OVER (PARTITION BY query_id)) / (max(raw) OVER (PARTITION BY query_id) - min(raw) OVER (PARTITION BY query_id)) ELSE 0.0 END AS score FROM rk)"""


def sparse(t, k):
    return R.bm25_topk(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", k)


@query("bm25", f"WITH {bm25_ctes(K)} SELECT query_id, record_id, rank, round(raw, 6) AS raw, round(score, 6) AS score FROM sh")
def _(t):
    return sparse(t, K).select("query_id", "record_id", F.col("rank").cast("long").alias("rank"), F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


@query("minmax_norm", """WITH a AS (SELECT user_id AS query_id, event_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 20)
 SELECT query_id, event_id, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END, 6) AS score FROM a""")
def _(t):
    from ..scale import first_per

    h = first_per(t.events.select(F.col("user_id").alias("query_id"), "event_id", "value"), ["query_id"], [F.desc("value"), "event_id"], 20)
    return R.minmax(h, "value").select("query_id", "event_id", F.round("score", 6).alias("score"))


# the lexical list covers every document, the dense one those that have a vector; each question looks from the mean vector of one label
HYB_DOCS = "SELECT doc_id AS id, text FROM documents"


def rrf_sql(k, lists, out="fz"):
    u = " UNION ALL ".join(f"SELECT query_id, record_id, {i} AS li, rank FROM {n}" for i, n in enumerate(lists))
    return f"""ru AS ({u}), rg AS (SELECT query_id, record_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS raw, min(li * 1000000 + rank) AS seen FROM ru GROUP BY 1, 2),
 rn AS (SELECT *, max(raw) OVER w AS hi, min(raw) OVER w AS lo FROM rg WINDOW w AS (PARTITION BY query_id)),
 {out} AS (SELECT * FROM (SELECT query_id, record_id, raw, CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 1.0 END AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, seen) AS rank FROM rn) WHERE rank <= {k})"""


HYB_SQL = f"""{CENTROIDS}, hq AS (SELECT item_id AS query_id, v FROM benchmark JOIN qv ON qv.query_id = item_id % 10), he AS (SELECT record_id, v FROM ev WHERE record_id IN (SELECT doc_id FROM documents)),
 hd AS (SELECT * FROM (SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM
   (SELECT hq.query_id, he.record_id, round(list_cosine_similarity(hq.v, he.v), 9) AS score FROM hq, he)) WHERE rank <= {{k2}}), {{sparse}}"""


def hybrid_sql(k):
    return HYB_SQL.format(k2=2 * k, sparse=bm25_ctes(2 * k, HYB_DOCS)) + ", " + rrf_sql(k, ["hd", "sh"])


def hybrid_parts(t):
    c = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).select("doc_id", "text", "embedding")
    q = t.benchmark.withColumn("l", F.col("item_id") % 10).join(centroids(t).withColumnRenamed("query_id", "l"), "l").select("item_id", "text", "v")
    return c, q, lambda n: R.dense_topk(c, "doc_id", "embedding", q, "item_id", "v", n), lambda n: R.bm25_topk(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", n)


@query("rrf", f"WITH {CENTROIDS}, {ROUGH}, {dense_sql(20)}, {dense_sql(20, src='rv', out='d2')}, {rrf_sql(20, ['dh', 'd2'])} {PICK} fz")
def _(t):
    return shown(R.rrf([dense(t, 20), dense(t, 20, _rough(t))], 20))


@query("hybrid", f"WITH {hybrid_sql(K)} {PICK} fz")
def _(t):
    _, _, d, s = hybrid_parts(t)
    return shown(R.retrieve("hybrid", d, s, K))


@query("strategy_dispatch", f"WITH {hybrid_sql(K)}, f AS (SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM fz WHERE score >= 0.3) {PICK} f")
def _(t):
    _, _, d, s = hybrid_parts(t)
    return shown(R.retrieve("hybrid", d, s, K, threshold=0.3))


@query("rerank", f"""WITH {bm25_ctes(30)}, jj AS (SELECT sh.query_id, sh.record_id, list_distinct({toks_sql('b.text')}) AS qt, list_distinct({toks_sql('d.text')}) AS dt FROM sh JOIN benchmark b ON b.item_id = sh.query_id JOIN documents d ON d.doc_id = sh.record_id),
 rs AS (SELECT query_id, record_id, round(len(list_intersect(qt, dt)) / (1.0 + len(dt)), 9) AS raw FROM jj), rm AS (SELECT *, max(raw) OVER w AS hi, min(raw) OVER w AS lo, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, record_id) AS rank FROM rs WINDOW w AS (PARTITION BY query_id))
 SELECT query_id, record_id, rank, round(CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 0.0 END, 6) AS score FROM rm WHERE rank <= {K}""")
def _(t):
    h = sparse(t, 30).join(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("qtext")), "query_id") \
        .join(t.documents.select(F.col("doc_id").alias("record_id"), F.col("text").alias("dtext")), "record_id")
    qt, dt = F.array_distinct(tx.tokens("qtext")), F.array_distinct(tx.tokens("dtext"))
    return shown(R.rerank(h, F.round(F.size(F.array_intersect(qt, dt)) / (1.0 + F.size(dt)), 9), K))


@query("mmr", f"""WITH RECURSIVE {CENTROIDS}, {dense_sql(50)},
 b AS (SELECT dh.query_id, dh.record_id, dh.rank, ev.v, list_cosine_similarity(qv.v, ev.v) AS rel FROM dh JOIN ev USING (record_id) JOIN qv USING (query_id)),
 c AS (SELECT x.query_id, x.record_id, x.rank, any_value(x.rel) AS rel, list(list_cosine_similarity(x.v, y.v) ORDER BY y.rank) AS s FROM b x JOIN b y USING (query_id) GROUP BY 1, 2, 3),
 m(query_id, step, picked, val) AS (
  SELECT query_id, 1, [first(rank ORDER BY round(rel, 12) DESC, rank)], max(round(rel, 12)) FROM c GROUP BY 1
  UNION ALL SELECT query_id, step + 1, list_append(picked, first(rank ORDER BY val DESC, rank)), max(val) FROM (
   SELECT m.query_id, m.step, m.picked, c.rank, round(0.7 * c.rel - 0.3 * list_max(list_transform(m.picked, lambda p: c.s[p])), 12) AS val
   FROM m JOIN c ON c.query_id = m.query_id WHERE m.step < {K} AND NOT list_contains(m.picked, c.rank)) GROUP BY query_id, step, picked)
 SELECT m.query_id, c.record_id, m.step::BIGINT AS rank, round(least(1, greatest(0, val)), 6) AS score FROM m JOIN c ON c.query_id = m.query_id AND c.rank = m.picked[m.step]""")
def _(t):
    q = centroids(t)
    return shown(R.mmr(dense(t, 50), t.embeddings, "vec_id", "embedding", q, "query_id", "v", K, 0.7))


@query("answer_context", f"""WITH {bm25_ctes(3)}, j AS (SELECT sh.*, d.source, d.text FROM sh JOIN documents d ON d.doc_id = sh.record_id)
 SELECT query_id, sha256(string_agg('Document: ' || source || chr(10) || 'Content: ' || text, chr(10) || chr(10) ORDER BY rank)) AS context, count(*) AS chunks_retrieved, round(avg(score), 6) AS average_similarity,
  CASE WHEN avg(score) > 0.8 THEN 'high' WHEN avg(score) > 0.6 THEN 'medium' ELSE 'low' END AS confidence,
  string_agg(record_id || ':' || CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, '|' ORDER BY rank) AS previews FROM j GROUP BY 1""")
def _(t):
    d = t.documents.select("doc_id", "source", F.col("doc_id").cast("string").alias("page"), "text")
    a = R.answer_context(t.benchmark, "item_id", sparse(t, 3), d, "doc_id", "source", "page", "text")
    return a.select("query_id", F.sha2("context", 256).alias("context"), "chunks_retrieved", F.round("average_similarity", 6).alias("average_similarity"), "confidence",
                    F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["page"], s["preview"])), "|").alias("previews"))


# -- evaluation ---------------------------------------------------------------------------------

def items(t):
    """Two ground truths per question: its own text, and one too short to count."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.array(F.col("text"), F.lit("short text")).alias("ground_truth"))


def match_sql(a, b):
    x, y = norm_sql(a), norm_sql(b)
    return f"(length({x}) >= 20 AND length({y}) >= 20 AND CASE WHEN length({x}) <= length({y}) THEN contains({y}, {x}) ELSE contains({x}, {y}) END)"


JUDGED = f"{bm25_ctes(K)}, jd AS (SELECT sh.query_id, sh.record_id, sh.rank, {match_sql('d.text', 'b.text')} AS m FROM sh JOIN documents d ON d.doc_id = sh.record_id JOIN benchmark b ON b.item_id = sh.query_id)"
METRICS = """mt AS (SELECT query_id, count(*) FILTER (m AND rank <= 5) / 5.0 AS precision, (coalesce(max(CASE WHEN m AND rank <= 5 THEN 1 ELSE 0 END), 0) + 1) / 2.0 AS recall,
   coalesce(1.0 / min(CASE WHEN m THEN rank END), 0) AS mrr, max(CASE WHEN m AND rank <= 5 THEN 1 ELSE 0 END) AS hit FROM jd GROUP BY 1)"""


def _judged(t):
    return E.judged(sparse(t, K), items(t), t.documents, "doc_id", "text")


def _metrics(t):
    return E.query_metrics(items(t), _judged(t), 5)


@query("gt_match", f"WITH {JUDGED} SELECT query_id, rank, m AS matched FROM jd")
def _(t):
    return _judged(t).filter("truth_no = 0").select("query_id", F.col("rank").cast("long").alias("rank"), "matched")


@query("precision_at_k", f"WITH {JUDGED}, {METRICS} SELECT query_id, CAST(precision AS DOUBLE) AS precision FROM mt")
def _(t):
    return _metrics(t).select("query_id", "precision")


@query("recall_at_k", f"WITH {JUDGED}, {METRICS} SELECT query_id, CAST(recall AS DOUBLE) AS recall FROM mt")
def _(t):
    return _metrics(t).select("query_id", "recall")


@query("mrr", f"WITH {JUDGED}, {METRICS} SELECT query_id, round(CAST(mrr AS DOUBLE), 6) AS mrr FROM mt")
def _(t):
    return _metrics(t).select("query_id", F.round("mrr", 6).alias("mrr"))


@query("hit_at_k", f"WITH {JUDGED}, {METRICS} SELECT query_id, hit FROM mt")
def _(t):
    return _metrics(t).select("query_id", "hit")


@query("eval_aggregate", f"WITH {JUDGED}, {METRICS} SELECT count(*) AS num_queries, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(hit), 4) AS hit FROM mt")
def _(t):
    return E.aggregate_metrics(_metrics(t))


CMP = f"""jd AS (SELECT 'sparse' AS strategy, query_id, record_id, rank FROM sh WHERE rank <= {K} UNION ALL SELECT 'dense', query_id, record_id, rank FROM hd WHERE rank <= {K} UNION ALL SELECT 'hybrid', query_id, record_id, rank FROM fz),
 jm AS (SELECT strategy, query_id, rank, {match_sql('d.text', 'b.text')} AS m FROM jd JOIN documents d ON d.doc_id = record_id JOIN benchmark b ON b.item_id = query_id),
 mt AS (SELECT strategy, query_id, count(*) FILTER (m AND rank <= 5) / 5.0 AS precision, (max(CASE WHEN m AND rank <= 5 THEN 1 ELSE 0 END) + 1) / 2.0 AS recall, coalesce(1.0 / min(CASE WHEN m THEN rank END), 0) AS mrr,
   max(CASE WHEN m AND rank <= 5 THEN 1 ELSE 0 END) AS hit FROM jm GROUP BY 1, 2)"""


@query("compare_strategies", f"WITH {hybrid_sql(K)}, {CMP} SELECT strategy, count(*) AS num_queries, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(hit), 4) AS hit FROM mt GROUP BY 1")
def _(t):
    _, _, d, s = hybrid_parts(t)
    dense, sparse = R.written(d(2 * K)), R.written(s(2 * K))  # the longest lists any strategy asks for, searched once
    lists = {n: R.retrieve(n, lambda k: R.first_hits(dense, k), lambda k: R.first_hits(sparse, k), K) for n in ("dense", "sparse", "hybrid")}
    return E.aggregate_metrics(E.compare_strategies(items(t), lists, t.documents, "doc_id", "text", 5), ["strategy"])


STAB = f"{CENTROIDS}, {ROUGH}, {dense_sql(20)}, {dense_sql(20, src='rv', out='d2')}"


def _rough(t):
    return t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 1)).alias("embedding"))


@query("score_stability", f"""WITH {STAB} SELECT query_id, record_id, round(abs(dh.score - d2.score), 6) AS abs_diff, coalesce(abs(dh.score - d2.score) <= 0.001, false) AS stable,
  CASE WHEN dh.rank IS NULL THEN 'new' WHEN d2.rank IS NULL THEN 'gone' WHEN dh.rank <> d2.rank THEN 'moved' ELSE 'same' END AS status FROM dh FULL JOIN d2 USING (query_id, record_id)""")
def _(t):
    s = R.score_stability(dense(t, 20), dense(t, 20, _rough(t)), 0.001)
    return s.select("query_id", "record_id", F.round("abs_diff", 6).alias("abs_diff"), "stable", "status")


@query("adjacent_trend", f"""WITH {STAB} SELECT query_id, record_id, dh.rank AS r0, d2.rank AS r1, dh.rank - d2.rank AS move FROM dh JOIN d2 USING (query_id, record_id) WHERE dh.rank <> d2.rank""")
def _(t):
    s = R.score_stability(dense(t, 20), dense(t, 20, _rough(t))).filter("status = 'moved'")
    return s.select("query_id", "record_id", F.col("r0").cast("long").alias("r0"), F.col("r1").cast("long").alias("r1"), (F.col("r0") - F.col("r1")).cast("long").alias("move"))


@query("topk_prefix_check", "SELECT DISTINCT CAST(label AS BIGINT) AS query_id, true AS same, CAST(5 AS BIGINT) AS n FROM embeddings")
def _(t):
    return R.topk_prefix_check(dense(t, 5), dense(t, 50), 5)
