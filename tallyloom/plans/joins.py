"""Interval, overlap, lookup and star-join queries."""

from pyspark.sql import functions as F

from ..functions import timecols as tc
from ..operators import intervals as I
from ..operators import joins as J
from . import fixtures as fx
from .fixtures import CLICKS_SQL, SESSIONS_SQL, WINDOWS_SQL, hrs, txt
from .registry import query

INSIDE = "c.ts BETWEEN s.s AND s.e"


def _ses(t):
    return fx.sessions(t).select("key", "start_id", "start", "end")


def _ses_named(t):
    return _ses(t).withColumn("session_id", F.concat_ws("_", "key", F.date_format(F.col("start").cast("timestamp"), "yyyyMMdd_HHmmss")))


@query("interval_join_longest", f"""WITH {SESSIONS_SQL}, {CLICKS_SQL},
 j AS (SELECT c.event_id, s.start_id, s.key, s.s, row_number() OVER (PARTITION BY c.event_id ORDER BY epoch_us(s.e) - epoch_us(s.s) DESC, s.s, s.key) AS rn
   FROM clk c LEFT JOIN ses s ON {INSIDE})
 SELECT event_id, start_id, key || '_' || strftime(s, '%Y%m%d_%H%M%S') AS session_id FROM j WHERE rn = 1""")
def longest(t):
    j = I.longest_cover(fx.clicks(t).select("event_id", "ts"), _ses_named(t), "ts", "start", "end", ["start_id", "session_id"])
    return j.select("event_id", "start_id", "session_id")


def _pairs(t, **kw):
    return I.stab_join(fx.clicks(t), _ses(t), "ts", "start", "end", [("user_id", "key")], **kw)


@query("interval_join_all", f"""WITH {SESSIONS_SQL}, {CLICKS_SQL}
 SELECT s.key, s.start_id, count(c.event_id) AS commit_count, coalesce(bool_or(c.value > 20), false) AS any_flag
 FROM ses s LEFT JOIN clk c ON c.user_id = s.key AND {INSIDE} GROUP BY 1, 2""")
def _(t):
    p = _pairs(t)
    return J.assignment_summary(_ses(t), p, "start_id", F.col("value") > 20).select("key", "start_id", "commit_count", "any_flag")


@query("interval_join_pairs", f"""WITH {SESSIONS_SQL}, {CLICKS_SQL} SELECT c.event_id, s.start_id FROM clk c JOIN ses s ON c.user_id = s.key AND {INSIDE}""")
def _(t):
    return _pairs(t).select("event_id", "start_id")


@query("interval_join_unassigned", f"""WITH {SESSIONS_SQL}, {CLICKS_SQL}
 SELECT {txt('c.ts::DATE')} AS date, count(*) AS n FROM clk c WHERE NOT EXISTS (SELECT 1 FROM ses s WHERE c.user_id = s.key AND {INSIDE}) GROUP BY 1""")
def _(t):
    return J.unassigned_by_date(fx.clicks(t), _pairs(t), "event_id", "ts")


@query("interval_join_buffered", f"""WITH {SESSIONS_SQL}, {CLICKS_SQL} SELECT c.event_id, s.start_id FROM clk c
 JOIN ses s ON c.user_id = s.key AND c.ts BETWEEN s.s - INTERVAL 5 MINUTE AND s.e + INTERVAL 5 MINUTE""")
def _(t):
    return _pairs(t, before="'5' MINUTE", after="'5' MINUTE").select("event_id", "start_id")


@query("interval_first_then_adjacent", f"""WITH {SESSIONS_SQL}, {CLICKS_SQL},
 f AS (SELECT c.event_id, arg_min(s.start_id, s.s) AS sid FROM clk c JOIN ses s ON c.user_id = s.key AND {INSIDE} GROUP BY 1),
 l AS (SELECT * FROM clk WHERE event_id NOT IN (SELECT event_id FROM f))
 SELECT event_id AS pid, sid, 'inside' AS how FROM f
 UNION ALL SELECT l.event_id, arg_max(s.start_id, s.e), 'previous' FROM l JOIN ses s ON l.user_id = s.key AND s.e < l.ts GROUP BY 1
 UNION ALL SELECT l.event_id, arg_min(s.start_id, s.s), 'next' FROM l JOIN ses s ON l.user_id = s.key AND s.s > l.ts GROUP BY 1""")
def _(t):
    s = _ses(t).withColumnRenamed("key", "user_id")
    return I.first_then_adjacent(fx.clicks(t), s, "user_id", "ts", "event_id", "start", "end", "start_id").select("pid", "sid", "how")


@query("same_day_interval_join", f"""WITH {SESSIONS_SQL}, {CLICKS_SQL} SELECT c.event_id, s.start_id FROM clk c
 JOIN ses s ON c.user_id = s.key AND c.ts::DATE = s.s::DATE AND {INSIDE}""")
def _(t):
    return J.same_day_join(fx.clicks(t), _ses(t), "ts", "start", "end", [("user_id", "key")]).select("event_id", "start_id")


@query("overlap_self_join", f"""WITH {WINDOWS_SQL},
 p AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b, {hrs('greatest(a.s, b.s)', 'least(a.e, b.e)')} AS h
   FROM win a JOIN win b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s < b.e AND b.s < a.e)
 SELECT a, b, round(h, 6) AS hours, CASE WHEN h > 1 THEN 'critical' ELSE 'warning' END AS severity FROM p""")
def _(t):
    p = J.overlap_pairs(fx.windows(t), "o_orderkey", "start", "end", ["o_custkey"], plain=True)
    return p.select(F.col("a_o_orderkey").alias("a"), F.col("b_o_orderkey").alias("b"), F.round("overlap_hours", 6).alias("hours"), "severity")


def _conf(t):
    w = fx.windows(t)
    new = w.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "start", "end")
    old = w.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("x_key"), F.col("o_custkey").alias("x_cust"),
                                                  F.col("start").alias("x_start"), F.col("end").alias("x_end"))
    return new, old, J.conflicts(new, old, "start", "end", "x_start", "x_end", [("o_custkey", "x_cust")])


CONF_SQL = f"""{WINDOWS_SQL}, cf AS (SELECT a.o_orderkey, b.o_orderkey AS x_key, {hrs('greatest(a.s, b.s)', 'least(a.e, b.e)')} AS h
  FROM win a JOIN win b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'F' AND b.o_orderstatus <> 'F' AND a.s < b.e AND b.s < a.e)"""


@query("overlap_cross_join", f"WITH {CONF_SQL} SELECT o_orderkey, x_key, round(h, 2) AS hours, CASE WHEN h < 2.0 THEN 'short' ELSE 'long' END AS conflict_size FROM cf")
def _(t):
    return _conf(t)[2].select("o_orderkey", "x_key", F.round("overlap_hours", 2).alias("hours"), "conflict_size")


@query("conflict_annotate", f"""WITH {CONF_SQL}, g AS (SELECT o_orderkey, count(*) AS n FROM cf GROUP BY 1)
 SELECT w.o_orderkey, coalesce(n, 0) AS conflict_count, n IS NOT NULL AS has_conflict FROM win w LEFT JOIN g USING (o_orderkey) WHERE w.o_orderstatus = 'F'""")
def _(t):
    new, _, c = _conf(t)
    return J.conflict_annotate(new, c, "o_orderkey").select("o_orderkey", "conflict_count", "has_conflict")


@query("conflict_rows", f"""WITH {CONF_SQL} SELECT o_orderkey, '{{"x_key":' || x_key || '}}' AS conflict FROM cf""")
def _(t):
    return J.conflict_rows(_conf(t)[2], "o_orderkey", ["x_key"])


def _batch(t):
    """Batch = events of a kind, keyed by (user, day); existing = the purchases."""
    e = t.events.select("event_id", "event_type", (F.col("user_id") % 60).alias("sid"),
                        F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("start"),
                        (F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz") + F.expr("INTERVAL '1' HOUR")).alias("end"))
    return e.filter("event_type <> 'purchase'").drop("event_type"), e.filter("event_type = 'purchase'").drop("event_type")


@query("dup_against_existing", """WITH e AS (SELECT event_id, event_type, user_id % 60 AS sid, date_trunc('hour', ts) AS s FROM events)
 SELECT event_id, 'id' AS "match" FROM e WHERE event_type <> 'purchase' AND sid IN (SELECT sid FROM e WHERE event_type = 'purchase')
 UNION ALL SELECT event_id, 'range' FROM e WHERE event_type <> 'purchase' AND s IN (SELECT s FROM e WHERE event_type = 'purchase')""")
def _(t):
    new, old = _batch(t)
    return J.duplicates_against(new, old, "sid", "start", "end").select("event_id", "match")


@query("upload_plan", """WITH b AS (SELECT o_orderkey AS o, o_custkey AS id, o_custkey % 700 AS r, o_orderstatus AS st, o_totalprice AS p FROM orders),
 ex AS (SELECT id, r FROM b WHERE st = 'P' AND p > 450000), nw AS (SELECT * FROM b WHERE NOT (st = 'P' AND p > 450000)),
 f AS (SELECT *, id IN (SELECT id FROM ex) AS ie, r IN (SELECT r FROM ex) AS re FROM nw),
 g AS (SELECT *, min(CASE WHEN NOT ie AND NOT re THEN o END) OVER (PARTITION BY r) AS win_o FROM f),
 h AS (SELECT *, max(CASE WHEN o = win_o THEN o END) OVER (PARTITION BY id) AS id_o FROM g)
 SELECT o AS o_orderkey, CASE WHEN ie THEN 'id_exists' WHEN id_o < o THEN 'id_repeated' WHEN re THEN 'range_exists' WHEN win_o < o THEN 'range_repeated' ELSE 'accepted' END AS status FROM h""")
def _(t):
    day0 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    r = F.make_dt_interval(F.lit(0), (F.col("o_custkey") % 700).cast("int"))
    b = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_custkey").alias("id"), (day0 + r).alias("start"),
                        (day0 + r + F.expr("INTERVAL '30' MINUTE")).alias("end"))
    old = b.filter("o_orderstatus = 'P' and o_totalprice > 450000")
    new = b.filter("not (o_orderstatus = 'P' and o_totalprice > 450000)").drop("o_orderstatus", "o_totalprice")
    return J.upload_plan(new, old, "id", "start", "end", "o_orderkey").select("o_orderkey", "status")


@query("star_join_category", """SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS hours, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END), 2) AS hours_urgent,
  round(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice ELSE 0 END), 2) AS hours_high
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1""")
def _(t):
    o = t.orders.filter("o_orderstatus = 'F' and o_orderdate >= timestamp_ntz'1996-01-01'")
    s = J.star_totals(o, t.customer, "o_custkey", "c_custkey", "c_mktsegment", F.col("o_totalprice"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return s.select("c_mktsegment", "n", F.round("hours", 2).alias("hours"), F.round("hours_1-URGENT", 2).alias("hours_urgent"),
                    F.round("hours_2-HIGH", 2).alias("hours_high"))


@query("star_join_repo", """SELECT n_nationkey, n_name, coalesce((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey), 0) AS sessions,
  round(coalesce((SELECT sum(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey), 0), 2) AS hours,
  coalesce((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey), 0) AS commits FROM nation""")
def _(t):
    return J.two_child_totals(t.nation.select("n_nationkey", "n_name"), "n_nationkey", t.supplier, "s_nationkey",
                              [F.count("*").alias("sessions"), F.round(F.sum("s_acctbal"), 2).alias("hours")],
                              t.customer, "c_nationkey", [F.count("*").alias("commits")])


@query("export_join", f"""SELECT o_orderkey, coalesce(c_name, '') AS category, coalesce(n_name, '') AS repository, coalesce(n, 0) AS commit_count FROM orders
 LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey
 LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    c = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    r = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.orders.join(c, "o_custkey", "left").join(r, "c_nationkey", "left").join(n, "o_orderkey", "left").select(
        "o_orderkey", F.coalesce("c_name", F.lit("")).alias("category"), F.coalesce("n_name", F.lit("")).alias("repository"),
        F.coalesce("n", F.lit(0)).alias("commit_count"))


@query("semi_count_distinct", """SELECT count(*) AS total, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS with_commits,
 round(100.0 * count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) / count(*), 6) AS rate FROM customer""")
def _(t):
    have = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(1))
    j = t.customer.select("c_custkey").join(have, "c_custkey", "left")
    return j.agg(F.count("*").alias("total"), F.count("has").alias("with_commits"), F.round(100.0 * F.count("has") / F.count("*"), 6).alias("rate"))


@query("dates_without", f"""SELECT {txt('l_shipdate::DATE')} AS date, count(*) AS n, count(DISTINCT l_returnflag) AS repos FROM lineitem
 WHERE l_shipdate::DATE NOT IN (SELECT o_orderdate::DATE FROM orders) GROUP BY 1""")
def _(t):
    return J.dates_without(t.lineitem, "l_shipdate", "l_returnflag", t.orders, "o_orderdate")


@query("daily_enrich", f"""WITH lg AS (SELECT o_orderdate::DATE AS date, count(*) * 0.5 AS logged FROM orders GROUP BY 1),
 ss AS (SELECT l_shipdate::DATE AS date, sum(l_quantity / 10) AS session_hours, count(*) AS session_count FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
 SELECT {txt('date')} AS date, round(logged, 6) AS logged, round(coalesce(session_hours, 0), 6) AS session_hours, coalesce(session_count, 0) AS session_count,
  round(CASE WHEN coalesce(session_hours, 0) > 0 THEN session_hours ELSE logged END, 6) AS final_hours FROM lg LEFT JOIN ss USING (date)""")
def _(t):
    lg = t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg((F.count("*") * 0.5).alias("logged"))
    ss = t.lineitem.filter("l_returnflag = 'A'").select(F.to_date("l_shipdate").alias("date"), (F.col("l_quantity") / 10).alias("h"))
    d = J.daily_enrich(lg, ss, "date", "logged", "h")
    return d.select("date", *[F.round(c, 6).alias(c) for c in ("logged", "session_hours", "final_hours")], "session_count")


@query("mapping_lookup_fallback", """SELECT p_partkey, coalesce(s_name, n_name, p_type) AS title FROM part
 LEFT JOIN supplier ON s_suppkey = p_partkey % 300 LEFT JOIN nation ON n_nationkey = p_size""")
def _(t):
    p = t.part.select("p_partkey", (F.col("p_partkey") % 300).alias("sub"), F.col("p_size").alias("act"), "p_type")
    subs = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    acts = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return J.title_fallback(p, "sub", "act", "p_type", subs, acts).select("p_partkey", "title")


CATALOGUE = [
    {"id": "A1", "keywords": ["red", "hot", "ring"], "sub_activities": [{"id": "A1.1", "keywords": ["ring", "economy"]}, {"id": "A1.2", "keywords": ["gear"]}]},
    {"id": "A2", "keywords": ["small", "bolt", "promo", "blue"], "sub_activities": [{"id": "A2.1", "keywords": ["bolt", "brand#1"]}]},
    {"id": "A3", "keywords": ["widget", "gizmo"], "sub_activities": []},
]


def _hits(col, words):
    return "(" + " + ".join(f"contains({col}, '{w}')::INT" for w in words) + ")"


def _mapping_sql():
    arms = []
    for a in CATALOGUE:
        n = len(a["keywords"])
        sc = f"least({_hits('d', a['keywords'])} / {n}.0, 1.0) + least({_hits('c', a['keywords'])} / {2 * n}.0, 1.0)"
        top = "2.0"
        if a["sub_activities"]:
            best = ", ".join(f"least({_hits('d', s['keywords'])} / {len(s['keywords'])}.0, 1.0)" for s in a["sub_activities"])
            sc, top = f"({sc} + 0.5 * greatest({best}))", "2.5"
        arms.append(f"SELECT p_partkey AS repo_name, '{a['id']}' AS activity_id, '' AS sub_activity_id, CAST(({sc}) / {top} AS DOUBLE) AS score FROM r WHERE ({sc}) / {top} >= 0.1")
        for s in a["sub_activities"]:
            rt = f"least({_hits('dc', s['keywords'])} / {len(s['keywords'])}.0, 1.0)"
            arms.append(f"SELECT p_partkey, '{a['id']}', '{s['id']}', CAST({rt} AS DOUBLE) FROM r WHERE ({sc}) / {top} >= 0.1 AND {rt} >= 0.1")
    return f"""WITH r AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS d, lower(p_brand) AS c, lower(p_name || ' ' || p_type || ' ' || p_brand) AS dc FROM part),
 m AS ({' UNION ALL '.join(arms)}), o AS (SELECT s_suppkey AS repo_name, 'A1' AS activity_id FROM supplier)
 SELECT repo_name, activity_id, sub_activity_id, round(score, 6) AS score, true AS auto,
  CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence
 FROM m WHERE NOT (sub_activity_id = '' AND activity_id = 'A1' AND repo_name IN (SELECT repo_name FROM o))
 UNION ALL SELECT repo_name, activity_id, '', NULL, false, 'medium' FROM o"""


@query("keyword_cross_join", _mapping_sql())
def _(t):
    over = t.supplier.select(F.col("s_suppkey").alias("repo_name"), F.lit("A1").alias("activity_id"),
                             F.lit(None).cast("string").alias("sub_activity_id"), F.lit(None).cast("string").alias("confidence"))
    m = J.activity_mappings(t.part, "p_partkey", F.concat_ws(" ", "p_name", "p_type"), F.col("p_brand"), CATALOGUE, over)
    return m.select("repo_name", "activity_id", F.coalesce("sub_activity_id", F.lit("")).alias("sub_activity_id"),
                    F.round("score", 6).alias("score"), "auto", "confidence")
