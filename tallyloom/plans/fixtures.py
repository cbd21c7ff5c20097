"""How the given tables stand in for activity data (see FIXTURES.md), once in Spark and once in SQL."""

from pyspark.sql import functions as F

from ..operators import sessions as S

def view_():
    return F.col("event_type") == "view"


def buy_():
    return F.col("event_type") == "purchase"


def sessions(t):
    """Machine sessions: owner = user, view opens, purchase closes."""
    e = t.events.select("user_id", "ts", "event_id", "event_type")
    return S.toggle_sessions(e, "user_id", "ts", "event_id", view_(), buy_())


def clicks(t):
    return t.events.filter("event_type = 'click'").select("user_id", "ts", "event_id", "value")


def windows(t):
    """Orders as intervals: start = order date, length 1..12 hours by order number."""
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").alias("start"),
        F.expr("timestampadd(HOUR, cast(o_orderkey % 12 + 1 as int), o_orderdate)").alias("end"))


def shifted(t):
    """Orders as loose sessions: start hour by order number, length -2 .. 27 hours by customer."""
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
                           F.expr("timestampadd(HOUR, cast(o_orderkey % 24 as int), o_orderdate)").alias("start"),
                           F.expr("timestampadd(HOUR, cast(o_orderkey % 24 + o_custkey % 30 - 2 as int), o_orderdate)").alias("end"))


def tagged(t):
    """Events with machine codes: view=7001, signup=6005, purchase=7002, error=1074."""
    code = (F.when(F.col("event_type") == "view", "7001").when(F.col("event_type") == "signup", "6005")
            .when(F.col("event_type") == "purchase", "7002").when(F.col("event_type") == "error", "1074").otherwise("1"))
    msg = F.when(F.col("event_type") == "signup", "The Event log service was started.").when(
        F.col("event_type") == "error", "initiated the shutdown of computer").otherwise("")
    return t.events.withColumn("code", code).withColumn("message", msg)


SESSIONS_SQL = """
 bnd AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was
         FROM events WHERE event_type IN ('view','purchase')),
 kept AS (SELECT * FROM bnd WHERE event_type <> coalesce(was, 'purchase')),
 prs AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM kept),
 lst AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY 1),
 ses AS (SELECT prs.user_id AS key, event_id AS start_id, ts AS s, coalesce(nx, last_ts) AS e, nx IS NULL AS is_open
         FROM prs JOIN lst USING (user_id) WHERE event_type = 'view')
"""
CLICKS_SQL = " clk AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click')"
WINDOWS_SQL = """ win AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate AS s,
   o_orderdate + to_hours((o_orderkey % 12 + 1)::INT) AS e FROM orders)"""
SHIFTED_SQL = """ sh AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate + to_hours((o_orderkey % 24)::INT) AS s,
   o_orderdate + to_hours((o_orderkey % 24 + o_custkey % 30 - 2)::INT) AS e FROM orders)"""
TAGGED_SQL = """
 tg AS (SELECT *, CASE event_type WHEN 'view' THEN 'logon' WHEN 'signup' THEN 'logon' WHEN 'purchase' THEN 'logoff' WHEN 'error' THEN 'logoff' END AS tag,
        CASE event_type WHEN 'view' THEN '7001' WHEN 'signup' THEN '6005' WHEN 'purchase' THEN '7002' WHEN 'error' THEN '1074' ELSE '1' END AS code FROM events)"""


def us(x: str) -> str:
    return f"epoch_us({x})"


def hrs(s: str, e: str) -> str:
    return f"((epoch_us({e}) - epoch_us({s})) / 3.6e9)"


def mins(s: str, e: str) -> str:
    return f"CAST(trunc((epoch_us({e}) - epoch_us({s})) / 6e7) AS BIGINT)"


def txt(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def kind(h: str) -> str:
    return f"CASE WHEN {h} >= 8 THEN 'full_day' WHEN {h} >= 4 THEN 'half_day' ELSE 'short_session' END"
