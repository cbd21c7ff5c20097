"""Hours reports and duplicate handling."""

from pyspark.sql import functions as F

from ..functions import timecols as tc
from ..operators import dedup as D
from ..operators import hours as H
from ..operators import intervals as I
from ..operators import sessions as S
from . import fixtures as fx
from .filters import CAL_SQL, COMPLETE_SQL, QUALITY_SQL, RANGE_SQL, TYPED_SQL, all_issues, calendar_rows
from .fixtures import CLICKS_SQL, SESSIONS_SQL, WINDOWS_SQL, hrs, kind, txt
from .registry import query

LH = "(l_quantity / 10)"


def lh():
    return F.col("l_quantity") / 10


def _resample_sql(b, spine):
    return f"""WITH e AS (SELECT {b.format('ts')} AS b, count(*) AS n, count(*) FILTER (event_type = 'view') AS ups, count(*) FILTER (event_type = 'purchase') AS downs, count(DISTINCT user_id) AS machines FROM events GROUP BY 1),
 c AS (SELECT {b.format('o_orderdate')} AS b, count(*) AS commits, count(*) FILTER (o_orderstatus = 'F') AS flagged, count(DISTINCT o_custkey) AS authors, avg(o_totalprice / 7) AS m, stddev_samp(o_totalprice / 7) AS sd FROM orders GROUP BY 1),
 sp AS (SELECT {spine.format('e')} UNION SELECT {spine.format('c')})
 SELECT {txt('sp.b')} AS bucket, coalesce(n, 0) AS n, coalesce(ups, 0) AS ups, coalesce(downs, 0) AS downs, coalesce(machines, 0) AS machines, coalesce(commits, 0) AS commits,
  coalesce(flagged, 0) AS flagged, coalesce(authors, 0) AS authors, round(coalesce(m, 0), 7) AS mean_len, round(coalesce(sd, 0), 7) AS std_len
 FROM sp LEFT JOIN e ON e.b = sp.b LEFT JOIN c ON c.b = sp.b"""


def _resample(t, p):
    e = [F.count("*").alias("n"), F.count_if(fx.view_()).alias("ups"), F.count_if(fx.buy_()).alias("downs"), F.countDistinct("user_id").alias("machines")]
    c = [F.count("*").alias("commits"), F.count_if(F.col("o_orderstatus") == "F").alias("flagged"), F.countDistinct("o_custkey").alias("authors"),
         F.avg(F.col("o_totalprice") / 7).alias("mean_len"), F.stddev_samp(F.col("o_totalprice") / 7).alias("std_len")]
    r = H.resample(t.events, "ts", e, t.orders, "o_orderdate", c, p)
    return r.withColumn("mean_len", F.round("mean_len", 7)).withColumn("std_len", F.round("std_len", 7))


SP = "CAST(unnest(generate_series((SELECT min(b) FROM {{0}}), (SELECT max(b) FROM {{0}}), INTERVAL {step})) AS TIMESTAMP) AS b"


@query("resample_period", _resample_sql("CAST(date_trunc('day', {0}) AS TIMESTAMP)", SP.format(step="1 DAY")))
def _(t):
    return _resample(t, "D")


@query("resample_period_hour", _resample_sql("CAST(date_trunc('hour', {0}) AS TIMESTAMP)", SP.format(step="1 HOUR")))
def _(t):
    return _resample(t, "H")


@query("resample_period_week", _resample_sql("CAST(date_trunc('week', {0}) + INTERVAL 6 DAY AS TIMESTAMP)", SP.format(step="7 DAY")))
def _(t):
    return _resample(t, "W")


@query("resample_period_month", _resample_sql("CAST(last_day({0}) AS TIMESTAMP)",
       "CAST(last_day(unnest(generate_series((SELECT date_trunc('month', min(b)) FROM {0}), (SELECT max(b) FROM {0}), INTERVAL 1 MONTH))) AS TIMESTAMP) AS b"))
def _(t):
    return _resample(t, "M")


@query("work_pattern_summary", f"""WITH {SESSIONS_SQL}, {CLICKS_SQL},
 j AS (SELECT c.event_id, c.user_id, c.value, row_number() OVER (PARTITION BY c.event_id ORDER BY epoch_us(s.e) - epoch_us(s.s) DESC, s.s) AS rn, s.start_id
   FROM clk c LEFT JOIN ses s ON c.user_id = s.key AND c.ts BETWEEN s.s AND s.e),
 p AS (SELECT user_id AS key, count(*) AS commits, count(start_id) AS in_session, count(*) FILTER (value > 20) AS flagged FROM j WHERE rn = 1 GROUP BY 1),
 g AS (SELECT key, count(*) AS sessions, sum({hrs('s', 'e')}) AS h, greatest(1, (max(epoch_us(e)) - min(epoch_us(s))) // 86400000000) AS days FROM ses GROUP BY 1)
 SELECT key, sessions, round(h, 4) AS total_hours, round(h / sessions, 4) AS avg_hours, CAST(days AS BIGINT) AS days, round(sessions / days, 6) AS sessions_per_day,
  coalesce(commits, 0) AS commits, coalesce(in_session, 0) AS in_session, round(CASE WHEN commits > 0 THEN 100.0 * in_session / commits ELSE 0 END, 6) AS in_session_pct,
  round(CASE WHEN commits > 0 THEN 100.0 * flagged / commits ELSE 0 END, 6) AS flagged_pct, round(CASE WHEN h > 0 THEN coalesce(in_session, 0) / h ELSE 0 END, 6) AS commits_per_hour
 FROM g LEFT JOIN p USING (key)""")
def work_pattern(t):
    s = fx.sessions(t).select("key", "start_id", "start", "end")
    p = I.longest_cover(fx.clicks(t), s.withColumnRenamed("key", "machine"), "ts", "start", "end", ["start_id"], [("user_id", "machine")])
    p = p.groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("commits"), F.count("start_id").alias("in_session"),
                                                     F.count_if(F.col("value") > 20).alias("flagged"))
    days = F.greatest(F.lit(1).cast("long"), F.floor((F.max(tc.micros("end")) - F.min(tc.micros("start"))) / 86_400_000_000))
    g = s.groupBy("key").agg(F.count("*").alias("sessions"), F.sum(tc.hours_between("start", "end")).alias("h"), days.alias("days"))
    j = g.join(p, "key", "left").na.fill(0, ["commits", "in_session", "flagged"])

    def ratio(a, b, f=1.0):
        return F.round(F.when(b > 0, a * f / b).otherwise(0.0), 6)

    return j.select("key", "sessions", F.round("h", 4).alias("total_hours"), F.round(F.col("h") / F.col("sessions"), 4).alias("avg_hours"), "days",
                    ratio(F.col("sessions"), F.col("days")).alias("sessions_per_day"), "commits", "in_session",
                    ratio(F.col("in_session"), F.col("commits"), 100.0).alias("in_session_pct"),
                    ratio(F.col("flagged"), F.col("commits"), 100.0).alias("flagged_pct"), ratio(F.col("in_session"), F.col("h")).alias("commits_per_hour"))


@query("hours_totals_conditional", f"""WITH a AS (SELECT count(*) AS sessions, sum({LH}) AS h, count(*) FILTER (l_returnflag = 'R') AS flagged, sum({LH}) FILTER (l_returnflag = 'R') AS fh,
  count(*) FILTER (l_linestatus = 'O') AS rl, sum({LH}) FILTER (l_linestatus = 'O') AS rh, count(*) FILTER (l_linestatus <> 'O') AS sy, sum({LH}) FILTER (l_linestatus <> 'O') AS sh FROM lineitem)
 SELECT sessions, round(h, 4) AS hours, flagged, round(fh, 4) AS flagged_hours, rl AS "real", round(rh, 4) AS real_hours, sy AS synthetic, round(sh, 4) AS synthetic_hours,
  round(fh / h * 100, 6) AS flagged_pct, round(rh / h * 100, 6) AS real_pct FROM a""")
def _(t):
    r = H.conditional_totals(t.lineitem, lh(), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return r.select("sessions", "flagged", "real", "synthetic", *[F.round(c, 4).alias(c) for c in ("hours", "flagged_hours", "real_hours", "synthetic_hours")],
                    *[F.round(c, 6).alias(c) for c in ("flagged_pct", "real_pct")])


@query("group_category", f"""SELECT l_returnflag, count(*) AS n, round(sum({LH}), 4) AS hours, round(sum(CASE WHEN l_linestatus = 'O' THEN {LH} ELSE 0 END), 4) AS hours_o,
  round(sum(CASE WHEN l_linestatus = 'F' THEN {LH} ELSE 0 END), 4) AS hours_f FROM lineitem GROUP BY 1""")
def _(t):
    g = H.by_group(t.lineitem, [F.col("l_returnflag")], lh(), F.col("l_linestatus"), ["O", "F"])
    return g.select("l_returnflag", "n", F.round("hours", 4).alias("hours"), F.round("hours_O", 4).alias("hours_o"), F.round("hours_F", 4).alias("hours_f"))


@query("group_month_category", f"""WITH a AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS c, count(*) AS n, sum({LH}) AS h FROM lineitem GROUP BY 1, 2)
 SELECT month, CAST(sum(n) AS BIGINT) AS n, round(sum(h), 4) AS hours, round(sum(h) FILTER (c = 'A'), 4) AS h_a, round(sum(h) FILTER (c = 'N'), 4) AS h_n, round(sum(h) FILTER (c = 'R'), 4) AS h_r FROM a GROUP BY 1""")
def _(t):
    m = H.month_category_map(t.lineitem, "l_shipdate", "l_returnflag", lh())
    return m.select("month", "n", F.round("hours", 4).alias("hours"), *[
        F.round(F.try_element_at("by_category", F.lit(c)), 4).alias(f"h_{c.lower()}") for c in "ANR"])


@query("group_week", f"""SELECT strftime(l_shipdate, '%G-W%V') AS iso, strftime(l_shipdate, '%Y-W%W') AS monday, strftime(date_trunc('week', l_shipdate), '%Y-W%U') AS sunday,
 strftime(l_shipdate, '%Y-W%V') AS calendar, count(*) AS n, round(sum({LH}), 4) AS hours FROM lineitem GROUP BY 1, 2, 3, 4""")
def _(t):
    keys = [tc.iso_week("l_shipdate").alias("iso"), tc.monday_week("l_shipdate").alias("monday"),
            tc.sunday_week_of_monday("l_shipdate").alias("sunday"), tc.calendar_year_iso_week("l_shipdate").alias("calendar")]
    return H.by_group(t.lineitem, keys, lh()).withColumn("hours", F.round("hours", 4))


@query("group_repo_apportioned", """WITH m AS (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS repo FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM m GROUP BY 1)
 SELECT coalesce(repo, 'No commits') AS repo, round(sum(o_totalprice / 1000 / coalesce(n, 1)), 4) AS hours, count(*) AS sessions
 FROM orders LEFT JOIN n ON n.l_orderkey = o_orderkey LEFT JOIN m ON m.l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_returnflag", "l_linestatus").alias("repo"))
    o = t.orders.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("h"))
    return H.apportion(o, "o_orderkey", "h", m, "repo").withColumn("hours", F.round("hours", 4))


@query("category_stats", f"""SELECT n_name, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS hours, round(coalesce(avg(o_totalprice), 0), 4) AS avg_hours,
  {txt('min(o_orderdate)')} AS first_start, {txt('max(o_orderdate)')} AS last_start FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
  LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    s = t.orders.join(c, "o_custkey").select("n_nationkey", "o_totalprice", "o_orderdate")
    r = H.category_stats(t.nation.select("n_nationkey", "n_name"), "n_nationkey", s, "o_totalprice", "o_orderdate")
    return r.drop("n_nationkey").withColumn("hours", F.round("hours", 2)).withColumn("avg_hours", F.round("avg_hours", 4))


@query("validation_rollup", f"""WITH {TYPED_SQL}, i AS (SELECT *, 'time' AS src FROM ({RANGE_SQL}) UNION ALL SELECT *, 'complete' FROM ({COMPLETE_SQL}) UNION ALL SELECT *, 'quality' FROM ({QUALITY_SQL})),
 a AS (SELECT count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (src = 'time') AS issues_time,
   count(*) FILTER (src = 'complete') AS issues_complete, count(*) FILTER (src = 'quality') AS issues_quality, count(DISTINCT CASE WHEN level = 'error' THEN o_orderkey END) AS invalid FROM i)
 SELECT *, (SELECT count(*) FROM ty) AS total, (SELECT count(*) FROM ty) - invalid AS valid, errors = 0 AS passed, errors = 0 AND warnings < 10 AS ready FROM a""")
def _(t):
    return H.validation_rollup(t.orders, "o_orderkey", all_issues(t))


@query("week_activity_grouping_sets", f"""SELECT coalesce(strftime(l_shipdate, '%G-W%V'), 'ALL') AS week, coalesce(p_brand, 'ALL') AS activity, coalesce(p_type, 'ALL') AS sub,
 CAST(grouping(strftime(l_shipdate, '%G-W%V'), p_brand, p_type) AS BIGINT) AS level, round(sum({LH}), 4) AS hours, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
 GROUP BY GROUPING SETS ((strftime(l_shipdate, '%G-W%V'), p_brand, p_type), (strftime(l_shipdate, '%G-W%V'), p_brand), (strftime(l_shipdate, '%G-W%V')), (p_brand, p_type), (p_brand), ())""")
def _(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        tc.iso_week("l_shipdate").alias("week"), F.col("p_brand").alias("activity"), F.col("p_type").alias("sub"), lh().alias("h"))
    r = H.week_activity_rollup(j, "week", "activity", "sub", "h")
    return r.select(*[F.coalesce(c, F.lit("ALL")).alias(c) for c in ("week", "activity", "sub")], F.col("level").cast("long").alias("level"),
                    F.round("hours", 4).alias("hours"), "n")


@query("week_title_pivot", f"""WITH {WINDOWS_SQL} SELECT strftime(s, '%G-W%V') AS week, o_orderpriority AS title, round(sum({hrs('s', 'e')}), 4) AS hours FROM win GROUP BY 1, 2""")
def _(t):
    g = H.by_group(fx.windows(t), [tc.iso_week("start").alias("week"), F.col("o_orderpriority").alias("title")], tc.hours_between("start", "end"))
    return g.select("week", "title", F.round("hours", 4).alias("hours"))


@query("week_title_activity_totals", f"""WITH {WINDOWS_SQL} SELECT o_orderpriority, round(sum({hrs('s', 'e')}), 4) AS hours, count(DISTINCT strftime(s, '%G-W%V')) AS active_weeks, count(*) AS n FROM win GROUP BY 1""")
def _(t):
    return H.title_totals(fx.windows(t), "o_orderpriority", tc.iso_week("start"), tc.hours_between("start", "end")).withColumn("hours", F.round("hours", 4))


@query("week_title_week_totals", f"""WITH {WINDOWS_SQL} SELECT strftime(s, '%G-W%V') AS week, round(sum({hrs('s', 'e')}), 4) AS hours, count(DISTINCT o_orderpriority) AS activities FROM win GROUP BY 1""")
def _(t):
    return H.week_totals(fx.windows(t), "o_orderpriority", tc.iso_week("start"), tc.hours_between("start", "end")).withColumn("hours", F.round("hours", 4))


@query("calendar_summary", f"""WITH {WINDOWS_SQL} SELECT count(*) AS n, count(DISTINCT s::DATE) AS days, round(sum({hrs('s', 'e')}), 2) AS hours, {txt('min(s)')} AS earliest, {txt('max(e)')} AS latest FROM win""")
def _(t):
    return H.calendar_summary(fx.windows(t), "start", "end")


@query("session_metrics", f"""WITH {SESSIONS_SQL}, h AS (SELECT s, {hrs('s', 'e')} AS h, {hrs('s', 'e')} * 0.9 AS w FROM ses), k AS (SELECT *, {kind('h')} AS kind FROM h)
 SELECT count(*) AS sessions, round(sum(h), 4) AS total_hours, round(sum(w), 4) AS work_hours, round(sum(w) / sum(h) * 100, 4) AS efficiency, round(avg(w), 4) AS avg_hours, count(DISTINCT s::DATE) AS days,
  {txt('min(s::DATE)')} AS first_day, {txt('max(s::DATE)')} AS last_day, count(*) FILTER (kind = 'full_day') AS n_full_day, count(*) FILTER (kind = 'half_day') AS n_half_day,
  count(*) FILTER (kind = 'short_session') AS n_short_session FROM k""")
def _(t):
    h = tc.hours_between("start", "end")
    s = fx.sessions(t).select("start", h.alias("h"), (h * 0.9).alias("w"), tc.session_type(h).alias("kind"))
    m = H.session_metrics(s, "start", "h", "w", "kind", ["full_day", "half_day", "short_session"])
    return m.withColumns({c: F.round(c, 4) for c in ("total_hours", "work_hours", "efficiency", "avg_hours")})


@query("assignment_rate", f"""WITH {SESSIONS_SQL}, {CLICKS_SQL}, a AS (SELECT DISTINCT c.event_id FROM clk c JOIN ses s ON c.user_id = s.key AND c.ts BETWEEN s.s AND s.e)
 SELECT (SELECT count(*) FROM clk) AS total, (SELECT count(*) FROM a) AS assigned, (SELECT count(*) FROM clk) - (SELECT count(*) FROM a) AS unassigned,
  round(100.0 * (SELECT count(*) FROM a) / (SELECT count(*) FROM clk), 1) AS rate""")
def _(t):
    ck = fx.clicks(t)
    s = fx.sessions(t).select("key", "start_id", "start", "end")
    hit = I.stab_join(ck, s, "ts", "start", "end", [("user_id", "key")]).select("event_id").distinct().withColumn("hit", F.lit(1))
    return ck.join(hit, "event_id", "left").agg(F.count("*").alias("total"), F.count("hit").alias("assigned")) \
        .withColumn("unassigned", F.col("total") - F.col("assigned")).withColumn("rate", F.round(100.0 * F.col("assigned") / F.col("total"), 1))


@query("coverage_summary", f"""WITH {WINDOWS_SQL}, a AS (SELECT *, {hrs('s', 'e')} AS h FROM win)
 SELECT count(DISTINCT s::DATE) AS days_with, date_diff('day', min(s::DATE), max(s::DATE)) + 1 AS days_in_range, round(100.0 * count(DISTINCT s::DATE) / (date_diff('day', min(s::DATE), max(s::DATE)) + 1), 6) AS coverage_pct,
  round(sum(h), 2) AS hours, round(510 - sum(h), 2) AS gap_to_target, round(sum(h) FILTER (o_orderstatus = 'F'), 2) AS hours_f, round(sum(h) FILTER (o_orderstatus = 'O'), 2) AS hours_o FROM a""")
def _(t):
    c = H.coverage(fx.windows(t), "start", tc.hours_between("start", "end"), "o_orderstatus", ["F", "O"], 510.0)
    return c.select("days_with", F.col("days_in_range").cast("long").alias("days_in_range"), F.round("coverage_pct", 6).alias("coverage_pct"), F.round("hours", 2).alias("hours"),
                    F.round("gap_to_target", 2).alias("gap_to_target"), F.round("hours_F", 2).alias("hours_f"), F.round("hours_O", 2).alias("hours_o"))


@query("date_range_profile", f"""WITH a AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS ts FROM events)
 SELECT 'events' AS source, count(*) AS rows, count(ts) AS parsed, count(*) - count(ts) AS errors, {txt('min(ts)::DATE')} AS first_day, {txt('max(ts)::DATE')} AS last_day, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS span_days FROM a
 UNION ALL SELECT 'orders', count(*), count(*), 0, {txt('min(o_orderdate)::DATE')}, {txt('max(o_orderdate)::DATE')}, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) FROM orders""")
def _(t):
    e = t.events.select(F.when(F.col("event_type") == "error", "not a time").otherwise(
        F.date_format(F.col("ts").cast("timestamp"), "M/d/yyyy h:mm:ss a")).alias("x"))
    o = t.orders.select(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("x"))
    return H.date_profile({"events": (e, "x"), "orders": (o, "x")})


@query("daily_activity_summary", f"""WITH {SESSIONS_SQL}, a AS (SELECT s::DATE AS day, sum({hrs('s', 'e')}) AS h, count(*) AS n FROM ses GROUP BY 1),
 c AS (SELECT ts::DATE AS day, count(*) AS commits, count(DISTINCT event_type) AS repos, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS l FROM events GROUP BY 1),
 b AS (SELECT min(day) AS lo, max(day) AS hi FROM (SELECT day FROM a UNION ALL SELECT day FROM c)),
 sp AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM b)
 SELECT {txt('sp.day')} AS day, round(coalesce(h, 0), 4) AS hours, coalesce(n, 0) AS sessions, coalesce(commits, 0) AS commits, coalesce(repos, 0) AS repos, coalesce(l, '') AS repo_list
 FROM sp LEFT JOIN a USING (day) LEFT JOIN c USING (day)""")
def _(t):
    d = H.daily_activity(fx.sessions(t), "start", tc.hours_between("start", "end"), t.events, "ts", "event_type")
    return d.withColumn("hours", F.round("hours", 4)).withColumn("repo_list", F.array_join("repo_list", ","))


@query("repo_work_days", """SELECT o_orderpriority, count(*) AS commits, count(DISTINCT o_orderdate::DATE) AS days, round(count(*) * 1.0 / count(DISTINCT o_orderdate::DATE), 6) AS per_day FROM orders GROUP BY 1""")
def _(t):
    g = H.commit_repositories(t.orders, "o_orderdate", "o_orderpriority", F.lit(True)).select("o_orderpriority", "commits", "days", F.round("per_day", 6).alias("per_day"))
    return g.orderBy(F.desc("commits"), "o_orderpriority")


@query("commit_metadata", f"""SELECT count(*) AS commits, count(*) FILTER (o_orderstatus = 'F') AS eligible, count(DISTINCT o_orderpriority) AS repositories,
 string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS repos, {txt('min(o_orderdate)')} AS first_ts, {txt('max(o_orderdate)')} AS last_ts FROM orders""")
def _(t):
    return H.commit_totals(t.orders, "o_orderdate", "o_orderpriority", F.col("o_orderstatus") == "F")


@query("commit_repositories", f"""SELECT o_custkey, count(*) AS commits, count(*) FILTER (o_orderstatus = 'F') AS eligible, count(DISTINCT o_orderdate::DATE) AS days,
 {txt('min(o_orderdate)')} AS first_ts, {txt('max(o_orderdate)')} AS last_ts, round(count(*) * 1.0 / count(DISTINCT o_orderdate::DATE), 6) AS per_day FROM orders GROUP BY 1""")
def _(t):
    return H.commit_repositories(t.orders, "o_orderdate", "o_custkey", F.col("o_orderstatus") == "F").withColumn("per_day", F.round("per_day", 6))


@query("calendar_category_stats", f"""WITH {CAL_SQL} SELECT CASE WHEN declarable THEN 'declarable' ELSE coalesce(conflict_type, '') END AS kind, category, count(*) AS n, round(sum(length(low)) / 1000.0, 4) AS hours FROM cc GROUP BY 1, 2""")
def _(t):
    r = calendar_rows(t)
    kind = F.when(F.col("declarable"), "declarable").otherwise(F.coalesce("conflict_type", F.lit("")))
    g = H.hours_by_kind(r, kind, "category", F.length(F.concat_ws(" ", "role", "text", "role")))
    return g.withColumn("hours", F.round(F.col("hours") / 1000.0, 4))


# -- unions and duplicates ------------------------------------------------------------

@query("union_sources", f"""SELECT CASE WHEN l_linestatus = 'O' THEN 'real' ELSE 'synthetic' END AS source_type, count(*) AS n, round(sum({LH}), 4) AS hours FROM lineitem WHERE l_linestatus IN ('O','F') GROUP BY 1""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linestatus", lh().alias("h"))
    u = D.union_sources({"real": li.filter("l_linestatus = 'O'").drop("l_linestatus"), "synthetic": li.filter("l_linestatus = 'F'")})
    return u.groupBy("source_type").agg(F.count("*").alias("n"), F.round(F.sum("h"), 4).alias("hours"))


COPIES = "(SELECT event_id, ts, user_id, event_type, 1 AS f FROM events UNION ALL SELECT event_id + 1, ts, user_id, event_type, 2 FROM events WHERE event_type <> 'error')"


def _copies(t):
    e = t.events.select("event_id", "ts", "user_id", "event_type")
    return e.withColumn("f", F.lit(1)).unionByName(e.filter("event_type <> 'error'").withColumn("event_id", F.col("event_id") + 1).withColumn("f", F.lit(2)))


@query("dedup_record_id", f"SELECT event_id, event_type, f FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY f, ts) AS rn FROM {COPIES}) WHERE rn = 1")
def _(t):
    return D.dedup_record_id(_copies(t), "event_id", "ts", ["f", "ts"]).select("event_id", "event_type", "f")


@query("dedup_composite", f"SELECT user_id, {txt('day')} AS day, event_type, event_id FROM (SELECT user_id, ts::DATE AS day, event_type, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE, event_type ORDER BY ts, event_id) AS rn FROM {COPIES}) WHERE rn = 1")
def _(t):
    c = _copies(t).withColumn("day", F.to_date("ts"))
    return D.dedup_composite(c, ["user_id", "day", "event_type"], ["ts", "event_id"]).select("user_id", "day", "event_type", "event_id")


@query("dedup_timestamp", f"SELECT {txt('l_shipdate')} AS ts, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def _(t):
    li = t.lineitem.select(F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return D.dedup_timestamp(li, "ts", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@query("dedup_content", "SELECT doc_id, sha256(text) AS h FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN text = '' THEN CAST(doc_id AS VARCHAR) ELSE sha256(text) END ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def _(t):
    d = t.documents.select("doc_id", "text")
    h = F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256))
    return D.dedup_content(d, h, F.col("text"), "doc_id", ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("h"))


@query("dedup_file_model", """WITH f AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, quality FROM documents LEFT JOIN labels USING (doc_id))
 SELECT doc_id, model FROM f WHERE quality IS NULL AND (h, model) NOT IN (SELECT (h, model) FROM f WHERE quality IS NOT NULL)""")
def _(t):
    f = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), F.when(F.col("doc_id") % 2 == 0, "m1").otherwise("m2").alias("model"))
    stored = f.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return D.new_pairs(f.join(t.labels.select("doc_id"), "doc_id", "left_anti"), stored, ["h", "model"]).select("doc_id", "model")


@query("find_duplicates", f"""SELECT o_orderkey, {txt('o_orderdate')} AS "start", members FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS members FROM orders) WHERE members > 1""")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("start"))
    return D.duplicate_groups(o, ["o_custkey", "start"], "o_orderkey").select("o_orderkey", "start", "members")


@query("remove_duplicates", f"""WITH {WINDOWS_SQL}, a AS (SELECT o_orderkey, o_custkey AS sid, s, e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r1 FROM win),
 b AS (SELECT *, row_number() OVER (PARTITION BY s, e ORDER BY o_orderkey) AS r2 FROM a WHERE r1 = 1) SELECT o_orderkey, sid FROM b WHERE r2 = 1""")
def _(t):
    w = fx.windows(t).select("o_orderkey", F.col("o_custkey").alias("sid"), "start", "end")
    return D.remove_duplicates(w, "sid", "start", "end", ["o_orderkey"]).select("o_orderkey", "sid")


@query("subset_check", """SELECT o_orderkey, NOT (o_custkey % 10 = 3 OR o_orderkey % 7 = 5) AS isolated, concat_ws(',', CASE WHEN o_custkey % 10 = 3 THEN 'c3' END, CASE WHEN o_orderkey % 7 = 5 THEN 'k5' END) AS leaked FROM orders""")
def _(t):
    req = F.array(*[F.concat(F.lit("c"), F.lit(i)) for i in range(10) if i != 3], *[F.concat(F.lit("k"), F.lit(i)) for i in range(7) if i != 5])
    res = F.array(F.concat(F.lit("c"), F.col("o_custkey") % 10), F.concat(F.lit("k"), F.col("o_orderkey") % 7))
    ok, leak = D.scope_leak(req, res)
    return t.orders.select("o_orderkey", ok.alias("isolated"), F.array_join(leak, ",").alias("leaked"))


@query("doc_registry_upsert", """WITH a AS (SELECT doc_id, source AS name, sha256(text) AS h, doc_id IN (SELECT doc_id FROM labels) AS old FROM documents),
 r AS (SELECT name, h, CAST(row_number() OVER (PARTITION BY name ORDER BY h) AS BIGINT) AS version FROM (SELECT DISTINCT name, h FROM a WHERE old)),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn FROM a WHERE NOT old) WHERE rn = 1 AND h NOT IN (SELECT h FROM r)),
 v AS (SELECT * FROM r UNION ALL SELECT n.name, n.h, coalesce(m.v, 0) + row_number() OVER (PARTITION BY n.name ORDER BY doc_id) FROM n LEFT JOIN (SELECT name, max(version) AS v FROM r GROUP BY 1) m USING (name))
 SELECT name, h, version, version < max(version) OVER (PARTITION BY name) AS obsolete FROM v""")
def _(t):
    from ..scale import Ordered, position

    a = t.documents.select("doc_id", F.col("source").alias("name"), F.sha2("text", 256).alias("h"))
    old = a.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("name", "h").distinct()
    reg = Ordered(old, ["name"], ["h"]).add(version=position()).rows()
    new = a.join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return D.registry_upsert(reg, new, "name", "h", ["doc_id"])
