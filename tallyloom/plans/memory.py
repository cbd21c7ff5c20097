"""Memory-table queries: role = event type, session = user, created = event time."""

from pyspark.sql import functions as F

from ..operators import memory as M
from .fixtures import txt
from .registry import query

NOW = "TIMESTAMP '2024-01-25 00:00:00'"


def now():
    return F.expr("timestamp_ntz'2024-01-25 00:00:00'")


def ten_days():
    return F.col("ts") + F.expr("INTERVAL '10' DAY")


@query("sort_ts", f"SELECT event_id, {txt('ts')} AS ts FROM events ORDER BY events.ts")
def _(t):
    return t.events.select("event_id", "ts").orderBy(F.asc_nulls_first("ts"), "event_id")


@query("recent_limit", f"SELECT event_id, {txt('ts')} AS ts FROM events WHERE event_type = 'view' ORDER BY events.ts DESC, event_id DESC LIMIT 100")
def _(t):
    return M.recent(t.events, "ts", "event_id", 100, event_type="view").select("event_id", "ts")


@query("entity_search", "SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' AND p_name ILIKE '%BO%' AND p_retailprice >= 950 ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def _(t):
    return M.entity_search(t.part, "p_name", "BO", "p_retailprice", 950, "p_partkey", 20, p_type="PROMO").select("p_partkey", "p_name")


@query("keep_newest_n", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 1500")
def _(t):
    return M.keep_newest(t.events.select("event_id", "event_type", "ts"), ["event_type"], "ts", "event_id", 1500).select("event_id", "event_type")


@query("latest_kv", f"SELECT user_id, event_type, value, {txt('ts')} AS written FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND ts + INTERVAL 1 DAY > {NOW}")
def _(t):
    e = t.events.withColumn("expires", F.col("ts") + F.expr("INTERVAL '1' DAY"))
    return M.latest_kv(e, ["user_id", "event_type"], "ts", "event_id", "value", "expires", now()).select("user_id", "event_type", "value", "written")


@query("evict_lru_insert", """WITH a AS (SELECT event_id, user_id, ts, event_id % 11 AS k, row_number() OVER (PARTITION BY user_id, event_id % 11 ORDER BY ts DESC, event_id DESC) AS r1 FROM events),
 b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r2 FROM a WHERE r1 = 1) SELECT event_id, user_id, k FROM b WHERE r2 <= 5""")
def _(t):
    e = t.events.select("event_id", "user_id", "ts", (F.col("event_id") % 11).alias("k"))
    return M.evict_oldest(e, "user_id", "k", "ts", "event_id", 5).select("event_id", "user_id", "k")


@query("expire_ttl", f"""WITH s AS (SELECT user_id, event_type, count(*) FILTER (ts + INTERVAL 10 DAY < {NOW}) AS d, count(*) FILTER (ts + INTERVAL 10 DAY >= {NOW}) AS l FROM events GROUP BY 1, 2)
 SELECT sum(d)::BIGINT AS removed, sum(l)::BIGINT AS kept, count(*) FILTER (l = 0) AS sessions_dropped FROM s""")
def _(t):
    e = t.events.withColumn("s", F.concat_ws("-", "user_id", "event_type"))
    return M.expire(e, "s", ten_days(), now())


@query("retention_prune", f"SELECT event_id FROM events WHERE ts >= {NOW} - INTERVAL 12 DAY")
def _(t):
    return M.retention(t.events, "ts", now(), 12).select("event_id")


@query("deactivate_expired", f"""SELECT event_id, event_type <> 'error' AND NOT ts + INTERVAL 10 DAY < {NOW} AS is_active, event_type <> 'error' AND ts + INTERVAL 10 DAY < {NOW} AS was_deactivated FROM events""")
def _(t):
    e = t.events.withColumn("active", F.col("event_type") != "error")
    return M.deactivate(e, "active", ten_days(), now()).select("event_id", "is_active", "was_deactivated")


@query("context_counts", f"""WITH a AS (SELECT user_id, count(*) AS entries, max(ts) AS l, max(CASE WHEN event_type = 'purchase' THEN ts END) AS c FROM events GROUP BY 1)
 SELECT user_id, entries, {txt('l')} AS last_activity, CASE WHEN c = l THEN {txt('c')} END AS completed_at, CASE WHEN c = l THEN 'completed' ELSE 'active' END AS status FROM a""")
def _(t):
    return M.context_counts(t.events, "user_id", "ts", F.col("event_type") == "purchase")


DOOMED = "(SELECT DISTINCT event_type, user_id FROM events WHERE value > 60)"


@query("delete_by_session", f"SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM {DOOMED} d WHERE d.event_type = e.event_type AND d.user_id = e.user_id)")
def _(t):
    return M.delete_matching(t.events, t.events.filter("value > 60"), ["event_type", "user_id"])[0].select("event_id")


@query("delete_by_session_count", f"SELECT count(*) AS deleted FROM events e WHERE EXISTS (SELECT 1 FROM {DOOMED} d WHERE d.event_type = e.event_type AND d.user_id = e.user_id)")
def _(t):
    return M.delete_matching(t.events, t.events.filter("value > 60"), ["event_type", "user_id"])[1]


@query("memory_stats", """SELECT 'total_entries' AS stat, count(*) AS n FROM events UNION ALL SELECT 'active_entries', count(*) FILTER (value > 5) FROM events UNION ALL SELECT 'total_contexts', count(*) FROM orders
 UNION ALL SELECT 'active_contexts', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 'total_entities', count(*) FROM part UNION ALL SELECT 'total_logs', count(*) FROM lineitem""")
def _(t):
    return M.memory_stats(t.events, F.col("value") > 5, t.orders, F.col("o_orderstatus") == "O", t.part, t.lineitem)


@query("ingest_metrics", f"""SELECT count(*) FILTER (event_type = 'signup') AS documents, count(*) FILTER (event_type = 'view') AS queries, count(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END) AS index_size,
  {txt("max(ts) FILTER (event_type = 'signup')")} AS last_ingest FROM events""")
def _(t):
    return M.ingest_metrics(t.events, F.col("event_type") == "signup", F.col("event_type") == "view", "user_id", "ts")
