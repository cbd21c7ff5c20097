"""Streaming jobs run over whole tables until all input is processed."""

from pyspark.sql import functions as F

from ..functions.timecols import micros
from ..operators import chunks as C
from ..scale import scratch_dir
from ..streaming import jobs as J
from . import fixtures as fx
from .fixtures import SESSIONS_SQL, txt
from .privacy import IN_REASON, MSG, OUT_REASON, messages
from .registry import query
from .text import CHUNKS_SQL


def _events(t, **o):
    return J.stream_table(t.spark, t.folder, "events", "ts", **o)


@query("stream_dedup", "SELECT user_id, event_type, CAST(min(ts)::DATE AS VARCHAR) AS day, 1 AS n FROM events GROUP BY user_id, event_type, ts::DATE")
def _(t):
    d = J.dedup(_events(t).withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"], "ts", "1 hour")
    r = J.run_to_table(d.select("user_id", "event_type", "day"), scratch_dir(t.spark, "dedup"))
    return r.groupBy("user_id", "event_type", "day").agg(F.count("*").cast("int").alias("n"))


@query("stream_metrics", f"""SELECT {txt("time_bucket(INTERVAL 1 HOUR, ts)")} AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
 WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def _(t):
    m = J.window_metrics(_events(t), "ts", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return J.run_to_table(m, scratch_dir(t.spark, "metrics"))


@query("stream_gap_sessions", f"""WITH a AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), b AS (SELECT *, sum(CASE WHEN ts <= p + INTERVAL 2 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM a)
 SELECT user_id, {txt('min(ts)')} AS "start", {txt('max(ts)')} AS last_ts, count(*) AS points FROM b GROUP BY user_id, n HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(t):
    return J.run_to_table(J.gap_sessions(_events(t), "user_id", "ts"), scratch_dir(t.spark, "gap"))


@query("stream_guard", f"""WITH {MSG}, a AS (SELECT conv_id, turn, role, {IN_REASON.replace("role = 'system'", 'false')} AS i, {OUT_REASON.replace("role = 'system'", 'false')} AS o FROM msg)
 SELECT conv_id, turn, role, i AS input_reason, CASE WHEN i IN ('jailbreak','topic') THEN 'block' WHEN i = 'pii' THEN 'flag' ELSE 'allow' END AS input_action, o AS output_reason, CASE WHEN o = '' THEN 'allow' ELSE 'block' END AS output_action FROM a""")
def _(t):
    class S:
        conversations = J.stream_table(t.spark, t.folder, "conversations")

    return J.run_to_table(J.guard(messages(S), "text"), scratch_dir(t.spark, "guard"))


#: What a watermark of ten minutes has settled at the end of the log.
PASSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE event_type IN ('view', 'purchase'))"


@query("stream_sessions", f"WITH {SESSIONS_SQL} SELECT key, start_id, epoch_us(s) AS start_us, epoch_us(e) AS end_us FROM ses WHERE NOT is_open AND e <= {PASSED}")
def _(t):
    s = J.toggle_sessions(_events(t), "user_id", "ts", "event_id", fx.view_(), fx.buy_())
    return J.run_to_table(s, scratch_dir(t.spark, "toggle"), store=J.ROCKS)


@query("stream_logon_sessions", f"""WITH a AS (SELECT user_id AS key, event_id, ts, event_type = 'view' AS opens,
   coalesce(lag(event_type = 'view') OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id), false) AS was FROM events WHERE event_type IN ('view', 'purchase')),
 b AS (SELECT *, lead(ts) OVER (PARTITION BY key, ts::DATE ORDER BY ts, event_id) AS stop FROM a WHERE opens <> was)
 SELECT key, event_id AS start_id, epoch_us(ts) AS start_us, epoch_us(coalesce(stop, greatest(ts, date_trunc('day', ts) + INTERVAL '23:59:59'))) AS end_us, stop IS NULL AS is_open
 FROM b WHERE opens AND coalesce(stop, date_trunc('day', ts) + INTERVAL 1 DAY) <= {PASSED}""")
def _(t):
    """Logon and logoff couples by event time, from several files; an open logon ends with its day."""
    files = scratch_dir(t.spark, "log")
    t.events.withColumn("part", F.to_date("ts")).repartition("part").write.partitionBy("part").parquet(files)
    e = t.spark.readStream.schema(t.events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1000).parquet(files)
    s = J.couples(e.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_id", fx.view_(), fx.buy_(), by_day=True)
    return J.run_to_table(s, scratch_dir(t.spark, "logon"), store=J.ROCKS)


@query("rate_limit_audit", "SELECT event_type, event_id, n > 2 AS over_limit FROM (SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n FROM events)")
def _(t):
    """All-events form: how many events of the key lie in the trailing minute."""
    from ..operators.rates import over_limit

    return over_limit(t.events, "event_type", "ts", "event_id", 2).select("event_type", "event_id", "over_limit")


def admitted_sql(where="true"):
    return f"""WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 r(user_id, rn, event_id, ts, kept, ok) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::TIMESTAMP, []::TIMESTAMP[], true FROM o
  UNION ALL SELECT user_id, rn, event_id, ts, CASE WHEN len(k) < 2 THEN list_append(k, ts) ELSE k END, len(k) < 2 FROM
   (SELECT o.user_id, o.rn, o.event_id, o.ts, list_filter(r.kept, lambda x: x > o.ts - INTERVAL 12 HOUR) AS k FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
 SELECT user_id, event_id, ok AS admitted FROM r WHERE rn > 0 AND {where}"""


@query("rate_limit_admitted", admitted_sql())
def _(t):
    """Two events of a user in twelve hours; only admitted ones count."""
    from ..operators.rates import admitted

    return admitted(t.events, "user_id", "ts", "event_id", 2, 12 * 3600).select("user_id", "event_id", "admitted")


@query("stream_rate_limit", admitted_sql("ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"))
def _(t):
    """The same as a stream over the whole table, up to the watermark."""
    r = J.rate_limit_to_table(_events(t), "user_id", "ts", "event_id", 2, scratch_dir(t.spark, "rate"), 12 * 3600)
    return r.select(F.col("key").alias("user_id"), F.col("rid").alias("event_id"), "admitted")


@query("stream_ttl_kv", f"SELECT user_id || ':' || event_type AS key, arg_max(value, ts) AS value, max(epoch_us(ts)) AS us FROM events GROUP BY 1")
def _(t):
    d = J.ttl_kv(_events(t), ["user_id", "event_type"], "ts", "event_id", "value", 10 * 86400)
    r = J.run_to_table(d, scratch_dir(t.spark, "kv"), mode="update")
    return r.groupBy("key").agg(F.max(F.struct("us", "rid", "value")).alias("l")).select("key", "l.value", "l.us")


@query("stream_ingest", f"WITH {CHUNKS_SQL} SELECT DISTINCT doc_id, sha256(text) AS content_hash FROM ch WHERE text <> ''")
def _(t):
    docs = J.stream_table(t.spark, t.folder, "documents")

    def to_chunks(b):
        return C.records_to_embed(C.chunk_table(b.select("doc_id", "text"), "doc_id", F.split("text", "\n"), "fixed"), "doc_id")

    return J.ingest(docs, to_chunks, scratch_dir(t.spark, "ingest"), "doc_id", "content_hash").select("doc_id", "content_hash")


@query("stream_ingest_files", """SELECT doc_id // 64 AS part, sha256(CASE WHEN doc_id // 64 % 3 = 1 THEN text || ' v2' ELSE text END) AS content_hash
 FROM documents WHERE text <> '' AND doc_id // 64 % 5 <> 4""")
def _(t):
    """Text files of some documents each, taken in; then some are written anew, some removed, and the store follows."""
    from ..streaming import ingest as I

    folder, out = scratch_dir(t.spark, "files"), scratch_dir(t.spark, "store")
    part = F.floor(F.col("doc_id") / 64).cast("long")
    docs = t.documents.filter("text <> ''").select(part.alias("part"), F.col("text").alias("value"))

    def put(df):
        df.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").option("lineSep", "\x1e").text(folder)

    def records(files):
        return files.select("path", "hash", F.explode(F.split("text", "\x1e")).alias("text")).filter("text <> ''")

    store = I.FileIngest(t.spark, folder, out, records, per_batch=64, compact_every=4, batch_bytes=256 << 20)
    put(docs)
    store.sync()
    put(docs.filter("part % 3 = 1").withColumn("value", F.concat("value", F.lit(" v2"))))
    for name in I.children(t.spark, folder):
        if name.startswith("part=") and int(name[5:]) % 5 == 4:
            I.remove(t.spark, f"{folder}/{name}")
    return store.sync().select(F.regexp_extract("path", r"part=(\d+)/", 1).cast("long").alias("part"), F.sha2("text", 256).alias("content_hash"))


@query("stream_late_rows", """WITH top AS (SELECT max(ts) AS m FROM events WHERE day(ts) % 2 = 0),
 f AS (SELECT day(ts) % 2 = 1 AND ts < m - INTERVAL 600 SECOND AS late FROM events, top) SELECT count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late FROM f""")
def _(t):
    """Even days arrive first; of the odd days, what lies ten minutes before their newest row is late."""
    folder, out = scratch_dir(t.spark, "days"), scratch_dir(t.spark, "late")
    for odd in (0, 1):
        t.events.filter(F.dayofmonth("ts") % 2 == odd).write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(t.events.schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
        good, late = J.split_late(stream, "ts", 600, out)
    return good.agg(F.count("*").alias("on_time")).withColumn("k", F.lit(1)).join(late.agg(F.count("*").alias("late")).withColumn("k", F.lit(1)), "k").drop("k")
