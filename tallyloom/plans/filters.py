"""Projection, filter and validation queries."""

from pyspark.sql import functions as F

from ..functions import keywords as kw
from ..functions import timecols as tc
from ..operators import filters as P
from ..scale import first_per
from . import fixtures as fx
from .fixtures import SESSIONS_SQL, SHIFTED_SQL, TAGGED_SQL, WINDOWS_SQL, hrs, txt
from .registry import query

LO, HI = "2024-01-05 00:00:00", "2024-01-20 12:00:00"


@query("filter_time_range", f"SELECT event_id, {txt('ts')} AS ts, event_type FROM events WHERE ts BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'")
def _(t):
    return P.filter_time_range(t.events.select("event_id", "ts", "event_type"), "ts", LO, HI)


@query("filter_from_date", f"SELECT o_orderkey, {txt('o_orderdate')} AS o_orderdate FROM orders WHERE o_orderdate::DATE >= DATE '1998-06-01'")
def _(t):
    return P.filter_from_date(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "1998-06-01")


@query("filter_either_end_in_range", f"""WITH {WINDOWS_SQL} SELECT o_orderkey, {txt('s')} AS "start", {txt('e')} AS "end" FROM win
 WHERE s BETWEEN TIMESTAMP '1996-01-01 03:00:00' AND TIMESTAMP '1996-12-31 06:00:00' OR e BETWEEN TIMESTAMP '1996-01-01 03:00:00' AND TIMESTAMP '1996-12-31 06:00:00'""")
def _(t):
    w = fx.windows(t).select("o_orderkey", "start", "end")
    return P.filter_either_end_in_range(w, "start", "end", "1996-01-01 03:00:00", "1996-12-31 06:00:00")


@query("derive_event_flags", f"""SELECT event_id, coalesce(regexp_matches(event_type, '(?i)VIEW|signup'), false) AS is_startup,
 coalesce(regexp_matches(event_type, '(?i)purchase|logout'), false) AS is_shutdown, extract(hour FROM ts) AS hour,
 extract(isodow FROM ts) - 1 AS day_of_week, {txt('ts::DATE')} AS date, length(props) AS message_length FROM events""")
def _(t):
    f = P.event_flags(t.events, "ts", "event_type", "props", "VIEW|signup", "purchase|logout")
    return f.select("event_id", "is_startup", "is_shutdown", "hour", "day_of_week", "date", "message_length")


@query("tag_session_event", f"WITH {TAGGED_SQL} SELECT event_id, code, tag FROM tg")
def _(t):
    return fx.tagged(t).select("event_id", "code", P.session_tag(F.col("code"), F.col("message")).alias("tag"))


REASON_SQL = f"""{SHIFTED_SQL},
 f AS (SELECT *, CASE WHEN e < s THEN e + INTERVAL 1 DAY ELSE e END AS e2, extract(hour FROM s) * 60 + extract(minute FROM s) AS sm FROM sh),
 g AS (SELECT *, extract(hour FROM e2) * 60 + extract(minute FROM e2) AS em FROM f),
 r AS (SELECT *, CASE WHEN s IS NULL OR e IS NULL THEN 'invalid_datetime' WHEN s::DATE < DATE '1996-06-01' THEN 'before_target_start'
   WHEN e2 <= s THEN 'non_positive_duration'
   WHEN CASE WHEN s::DATE = e2::DATE THEN sm < 390 AND em > 60 ELSE sm < 390 OR em > 60 END THEN 'overlaps_night' END AS reject_reason FROM g)"""


@query("filter_work_sessions", f"""WITH {REASON_SQL} SELECT o_orderkey, {txt('s')} AS "start", {txt('e2')} AS "end" FROM r WHERE reject_reason IS NULL""")
def _(t):
    r = P.work_session_reasons(fx.shifted(t), "start", "end", "1996-06-01")
    return r.filter("reject_reason is null").select("o_orderkey", "start", "end")


@query("filter_work_sessions_reasons", f"WITH {REASON_SQL} SELECT reject_reason, count(*) AS n FROM r WHERE reject_reason IS NOT NULL GROUP BY 1")
def _(t):
    return P.reason_counts(P.work_session_reasons(fx.shifted(t), "start", "end", "1996-06-01"))


KIND_SQL = "CASE o_orderkey % 4 WHEN 0 THEN 'morning' WHEN 1 THEN 'afternoon' WHEN 2 THEN 'evening' ELSE 'full_day' END"


def _typed(t):
    k = F.col("o_orderkey") % 4
    return fx.shifted(t).withColumn("kind", F.when(k == 0, "morning").when(k == 1, "afternoon").when(k == 2, "evening").otherwise("full_day")) \
        .withColumn("work_hours", F.col("o_totalprice") / 20000).withColumn("duration_hours", tc.hours_between("start", "end")) \
        .withColumn("flag", F.col("o_orderstatus") == "F") \
        .withColumn("category", F.element_at(F.array(*[F.lit(c) for c in P.CATEGORY_CODES + ["OTHER", ""]]), (F.col("o_custkey") % 8 + 1).cast("int"))) \
        .withColumn("reason", F.when(F.col("o_custkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")))


CODE_LIST = "'" + "','".join(P.CATEGORY_CODES) + "'"
TYPED_SQL = f"""{SHIFTED_SQL}, ty AS (SELECT *, {KIND_SQL} AS kind, o_totalprice / 20000 AS wh, {hrs('s', 'e')} AS dh, o_orderstatus = 'F' AS flag,
   [{CODE_LIST},'OTHER',''][(o_custkey % 8 + 1)::INT] AS category, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE o_orderpriority END AS reason FROM sh)"""
RANGE_SQL = """SELECT o_orderkey, 'invalid_range' AS issue, 'error' AS level FROM ty WHERE s >= e
 UNION ALL SELECT o_orderkey, 'too_long', 'error' FROM ty WHERE dh > 24
 UNION ALL SELECT o_orderkey, 'crosses_midnight', 'warning' FROM ty WHERE s::DATE <> e::DATE AND kind NOT IN ('full_day','evening')"""
COMPLETE_SQL = f"""SELECT o_orderkey, 'missing_category' AS issue, 'error' AS level FROM ty WHERE flag AND category = ''
 UNION ALL SELECT o_orderkey, 'invalid_category', 'error' FROM ty WHERE flag AND category <> '' AND category NOT IN ({CODE_LIST})
 UNION ALL SELECT o_orderkey, 'missing_justification', 'error' FROM ty WHERE flag AND reason = ''"""
QUALITY_SQL = """SELECT o_orderkey, 'work_exceeds_duration' AS issue, 'error' AS level FROM ty WHERE wh > dh
 UNION ALL SELECT o_orderkey, 'type_morning_mismatch', 'warning' FROM ty WHERE kind = 'morning' AND NOT extract(hour FROM s) BETWEEN 6 AND 11
 UNION ALL SELECT o_orderkey, 'type_afternoon_mismatch', 'warning' FROM ty WHERE kind = 'afternoon' AND NOT extract(hour FROM s) BETWEEN 12 AND 17
 UNION ALL SELECT o_orderkey, 'type_evening_mismatch', 'warning' FROM ty WHERE kind = 'evening' AND NOT extract(hour FROM s) BETWEEN 18 AND 23"""


def all_issues(t):
    d = _typed(t)
    return {"time": P.time_range_issues(d, "o_orderkey", "start", "end", "kind"),
            "complete": P.completeness_issues(d, "o_orderkey", "flag", "category", "reason"),
            "quality": P.quality_issues(d, "o_orderkey", "start", "work_hours", "duration_hours", "kind")}


@query("validate_time_ranges", f"WITH {TYPED_SQL} {RANGE_SQL}")
def _(t):
    return all_issues(t)["time"]


@query("validate_completeness", f"WITH {TYPED_SQL} {COMPLETE_SQL}")
def _(t):
    return all_issues(t)["complete"]


@query("validate_quality", f"WITH {TYPED_SQL} {QUALITY_SQL}")
def _(t):
    return all_issues(t)["quality"]


@query("validate_session_row", f"""WITH {TYPED_SQL},
 e AS (SELECT o_orderkey, concat_ws(',', CASE WHEN category = '' THEN 'missing_category' END, CASE WHEN s >= e THEN 'invalid_range' END,
   CASE WHEN dh > 24 THEN 'too_long' END, CASE WHEN wh < 0 THEN 'negative_work_hours' END, CASE WHEN wh > 24 THEN 'work_hours_over_24' END,
   CASE WHEN dh <> 0 AND wh > dh THEN 'work_exceeds_duration' END, CASE WHEN flag AND category NOT IN ({CODE_LIST}) THEN 'invalid_category' END,
   CASE WHEN flag AND reason = '' THEN 'missing_justification' END, CASE WHEN o_orderstatus = 'P' THEN 'invalid_source' END) AS er,
   CASE WHEN o_orderkey % 3 <> 1 THEN 'commit_count_mismatch' ELSE '' END AS warnings FROM ty)
 SELECT o_orderkey, er AS errors, warnings, er = '' AS is_valid FROM e""")
def _(t):
    d = _typed(t).withColumn("source", F.when(F.col("o_orderstatus") == "P", "imported").otherwise("real")) \
        .withColumn("n", (F.col("o_orderkey") % 3).cast("int")).withColumn("date", F.to_date("start")).withColumn("synthetic", F.lit(False))
    required = ["o_orderkey", "start", "end", "work_hours", "date", "kind", "flag", "category", "synthetic", "n", "source"]
    checks = P.session_row_checks(required, "start", "end", "work_hours", "duration_hours", "flag",
                                  "category", "reason", "kind", "source", "n", F.array("o_orderpriority"))
    v = P.validate_rows(d, checks)
    return v.select("o_orderkey", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "is_valid")


@query("validate_calendar_row", """WITH a AS (SELECT event_id, event_type, value, ts, event_id % 5 = 0 AS no_zone, event_id % 7 = 0 AS flip FROM events)
 SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'missing_summary' END, CASE WHEN no_zone THEN 'end_without_timeZone' END,
   CASE WHEN flip THEN 'invalid_range' END) AS errors,
   CASE WHEN value > 10 THEN 'no_project,no_category' ELSE 'no_project,no_category,no_work_hours' END AS warnings,
   NOT (event_type = 'error' OR no_zone OR flip) AS is_valid FROM a""")
def _(t):
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    end = F.when(F.col("event_id") % 7 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL '1' HOUR"))
    e = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("summary"), F.col("props").alias("description"),
        F.struct(F.date_format(F.col("ts").cast("timestamp"), iso).alias("dateTime"), F.lit("UTC").alias("timeZone")).alias("start"),
        F.struct(F.date_format(end.cast("timestamp"), iso).alias("dateTime"),
                 F.when(F.col("event_id") % 5 != 0, "UTC").alias("timeZone")).alias("end"),
        F.map_filter(F.create_map(F.lit("session_id"), F.lit("x"), F.lit("work_hours"), F.when(F.col("value") > 10, "1")),
                     lambda k, v: v.isNotNull()).alias("private"))
    v = P.validate_rows(e, P.calendar_row_checks("summary", "description", "start", "end", "private"))
    return v.select("event_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "is_valid")


PREP_SQL = f"""{SHIFTED_SQL},
 p AS (SELECT o_orderkey, s, e AS e0, CASE WHEN e = date_trunc('day', e) AND e::DATE <> s::DATE + 1 THEN date_trunc('day', s) + INTERVAL '23:59:59' ELSE e END AS e FROM sh),
 q AS (SELECT *, {hrs('s', 'e')} AS hours FROM p)"""


@query("prepare_calendar_rows", f"""WITH {PREP_SQL}
 SELECT o_orderkey, {txt('e')} AS "end", round(hours, 6) AS hours, extract(isoyear FROM s) AS iso_year, extract(week FROM s) AS iso_week, extract(isodow FROM s) - 1 AS weekday
 FROM q WHERE hours > 0 AND hours <= 24""")
def _(t):
    p = P.prepare_calendar_rows(fx.shifted(t), "start", "end").filter("drop_reason is null")
    return p.select("o_orderkey", "end", F.round("hours", 6).alias("hours"), "iso_year", "iso_week", "weekday")


@query("prepare_calendar_summary", f"""WITH {PREP_SQL}
 SELECT count(*) AS rows_before, count(*) FILTER (hours > 0 AND hours <= 24) AS rows_after, round(sum({hrs('s', 'e0')}), 4) AS hours_before,
  round(sum(hours) FILTER (hours > 0 AND hours <= 24), 4) AS hours_after FROM q""")
def _(t):
    p = P.prepare_calendar_rows(fx.shifted(t).withColumn("end0", F.col("end")), "start", "end")
    ok = F.col("drop_reason").isNull()
    return p.agg(F.count("*").alias("rows_before"), F.count_if(ok).alias("rows_after"),
                 F.round(F.sum(tc.hours_between("start", "end0")), 4).alias("hours_before"),
                 F.round(F.sum(F.when(ok, F.col("hours"))), 4).alias("hours_after"))


def like_any(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def calendar_case(pick):
    arms = [f"WHEN {like_any('low', ws)} OR {like_any('cal', cs)} THEN {pick(n, False, x)}" for n, ws, cs, x in kw.NON_DECLARABLE]
    arms += [f"WHEN {like_any('low', ws)} OR {like_any('cal', cs)} THEN {pick(n, True, x)}" for n, ws, cs, x in kw.DECLARABLE]
    return "CASE " + " ".join(arms) + f" ELSE {pick(kw.DEFAULT_CATEGORY, True, None)} END"


CAL_SQL = f"""cl AS (SELECT conv_id, turn, lower(concat_ws(' ', role, text, role)) AS low, lower(role) AS cal FROM conversations),
 cc AS (SELECT conv_id, turn, low, {calendar_case(lambda n, d, x: f"'{n}'")} AS category, {calendar_case(lambda n, d, x: str(d).lower())} AS declarable,
   {calendar_case(lambda n, d, x: 'NULL' if d else f"'{x}'")} AS conflict_type FROM cl)"""


def calendar_rows(t):
    c = kw.calendar_category(F.col("role"), F.col("text"), F.col("role"))
    return t.conversations.withColumn("c", c).select("conv_id", "turn", "role", "text", "c.category", "c.declarable", "c.conflict_type")


@query("categorize_calendar", f"WITH {CAL_SQL} SELECT conv_id, turn, category, declarable, conflict_type FROM cc")
def _(t):
    return calendar_rows(t).drop("role", "text")


def repo_case(col):
    arms = []
    for name, groups in kw.REPOSITORY_RULES:
        arms.append("WHEN " + " AND ".join(like_any(col, g) for g in groups) + f" THEN '{name}'")
    return "CASE " + " ".join(arms) + " ELSE 'GENERAL_RD' END"


@query("infer_category", f"""WITH a AS (SELECT c_custkey, o_orderkey, {repo_case('lower(o_orderpriority)')} AS category FROM customer JOIN orders ON c_custkey = o_custkey),
 b AS (SELECT c_custkey, category, count(*) AS n, min(o_orderkey) AS f FROM a GROUP BY 1, 2),
 c AS (SELECT c_custkey, category, n FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, f, category) AS rn FROM b) WHERE rn = 1)
 SELECT 'c' || c_custkey AS session, coalesce(category, 'UNKNOWN') AS category, coalesce(n, 0) AS n FROM customer LEFT JOIN c USING (c_custkey)
 UNION ALL SELECT 'v' || conv_id, category, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f, category) AS rn FROM (
  SELECT conv_id, {repo_case('lower(text)')} AS category, count(*) AS n, min(turn) AS f FROM conversations GROUP BY 1, 2)) WHERE rn = 1""")
def _(t):
    """Sessions of two kinds: customers with their orders (some have none) and conversations with their turns."""
    repos = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("session"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("about")) \
        .unionByName(t.conversations.select(F.concat(F.lit("v"), "conv_id").alias("session"), F.col("turn").alias("at"), F.col("text").alias("about")))
    sessions = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("session")).unionByName(
        t.conversations.select(F.concat(F.lit("v"), "conv_id").alias("session")).distinct())
    return kw.session_category(sessions, "session", repos, "about", "at")


@query("author_eligibility", """SELECT o_orderkey, contains(lower(o_orderpriority), 'high') AND o_orderdate >= TIMESTAMP '1997-01-01' AS eligible FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", P.author_eligibility(F.col("o_orderpriority"), F.col("o_orderdate"), "HIGH", "1997-01-01").alias("eligible"))


@query("session_type", f"""WITH {SESSIONS_SQL}, h AS (SELECT key, start_id, {hrs('s', 'e')} AS h FROM ses)
 SELECT key, start_id, CASE WHEN h >= 8 THEN 'full_day' WHEN h >= 4 THEN 'half_day' ELSE 'short_session' END AS session_type,
   CASE WHEN h > 12 THEN 'full_day' WHEN h > 4 THEN 'half_day' ELSE 'short_session' END AS session_type_wide FROM h""")
def _(t):
    h = tc.hours_between("start", "end")
    return fx.sessions(t).select("key", "start_id", tc.session_type(h).alias("session_type"),
                                 tc.session_type(h, 12.0, 4.0, strict=True).alias("session_type_wide"))


@query("confidence_band", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 10 > 0.8 THEN 'high' WHEN l_discount * 10 > 0.6 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN l_discount * 10 >= 0.7 THEN 'high' WHEN l_discount * 10 >= 0.4 THEN 'medium' ELSE 'low' END AS mapping_band FROM lineitem""")
def _(t):
    x = F.col("l_discount") * 10
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", P.similarity_band(x).alias("band"), P.mapping_band(x).alias("mapping_band"))


@query("flag_tags_weekend_location", """SELECT event_id, extract(isodow FROM ts) >= 6 AS weekend,
  CASE WHEN value > 20 OR extract(isodow FROM ts) >= 6 THEN 'home' ELSE 'office' END AS place FROM events""")
def _(t):
    w, p = P.weekend_and_place("ts", F.col("value") > 20)
    return t.events.select("event_id", w.alias("weekend"), p.alias("place"))


@query("eligibility_rule", """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' OR o_custkey % 4 = 0 THEN false ELSE o_orderstatus = 'F' END AS eligible FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", P.eligibility_rule(
        F.col("o_orderstatus") == "F", F.to_date("o_orderdate"), F.col("o_custkey") % 4, "1996-01-01").alias("eligible"))


@query("split_originals", """WITH a AS (SELECT CASE WHEN event_type IN ('view','click') THEN user_id || '.' || event_id ELSE CAST(user_id + 75 AS VARCHAR) END AS sid FROM events)
 SELECT sid, count(*) AS n FROM a WHERE NOT contains(sid, '.') AND sid IN (SELECT split_part(sid, '.', 1) FROM a WHERE contains(sid, '.')) GROUP BY 1""")
def _(t):
    part = F.concat_ws(".", F.col("user_id"), F.col("event_id"))
    e = t.events.select(F.when(F.col("event_type").isin("view", "click"), part).otherwise((F.col("user_id") + 75).cast("string")).alias("sid"))
    return P.split_originals(e, "sid").groupBy("sid").agg(F.count("*").alias("n"))
