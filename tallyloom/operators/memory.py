"""Operators over stored entries: latest values, expiry, retention, limits and access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import first_per


def own_plus_shared(own: DataFrame, shared: DataFrame, k: int, allowed: bool = True) -> DataFrame:
    """Best k of own and (when allowed) shared hits."""
    u = own.drop("rank").unionByName(shared.drop("rank")) if allowed else own.drop("rank")
    return first_per(u, ["query_id"], [F.desc("score"), "record_id"], k, rank="rank")


def recent(df: DataFrame, created: str, rid: str, n: int = 100, **equal) -> DataFrame:
    for c, v in equal.items():
        df = df.filter(F.col(c) == v)
    return df.orderBy(F.desc(created), F.desc(rid)).limit(n)


def entity_search(df: DataFrame, value: str, text: str, confidence: str, least: float, rid: str, n: int = 20, **equal) -> DataFrame:
    """Substring search (any case) over entities of a type, best confidence first."""
    for c, v in equal.items():
        df = df.filter(F.col(c) == v)
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.filter(F.col(value).ilike(f"%{safe}%") & (F.col(confidence) >= least)).orderBy(F.desc(confidence), rid).limit(n)


def keep_newest(df: DataFrame, keys: list[str], created: str, rid: str, n: int = 10_000) -> DataFrame:
    """Newest n per key.  Counted from the end with ``Ordered``: n may be large and a key hot."""
    from ..scale import Ordered, ahead

    o = Ordered(df, keys, [created, rid]).add(newer=ahead("sum", F.lit(1)))
    return o.filter(F.coalesce("newer", F.lit(0)) < n).rows().drop("newer")


def latest_kv(df: DataFrame, keys: list[str], ts: str, rid: str, value: str, expires: str, now: Column) -> DataFrame:
    """Last write per key; expired keys are not returned."""
    g = df.groupBy(*keys).agg(F.max(F.struct(ts, rid, F.col(value).alias("value"), F.col(expires).alias("expires"))).alias("l"))
    return g.select(*keys, "l.value", F.col(f"l.{ts}").alias("written"), "l.expires").filter(F.col("expires") > now)


def evict_oldest(df: DataFrame, session: str, key: str, ts: str, rid: str, n: int) -> DataFrame:
    """Latest entry per (session, key), then the newest n keys of a session.  Rewriting a key
    never pushes another one out."""
    return first_per(first_per(df, [session, key], [F.desc(ts), F.desc(rid)]), [session], [F.desc(ts), F.desc(rid)], n)


def expire(df: DataFrame, session: str, expires: Column, now: Column) -> DataFrame:
    """One row: entries removed, entries kept, sessions left empty."""
    dead = expires < now
    s = df.groupBy(session).agg(F.count_if(dead).alias("dead"), F.count_if(~dead).alias("live"))
    return s.agg(F.sum("dead").alias("removed"), F.sum("live").alias("kept"), F.count_if(F.col("live") == 0).alias("sessions_dropped"))


def retention(df: DataFrame, created: str, now: Column, days: int = 90) -> DataFrame:
    return df.filter(F.col(created) >= now - F.make_dt_interval(F.lit(days)))


def deactivate(df: DataFrame, active: str, expires: Column, now: Column) -> DataFrame:
    """Adds ``is_active`` and ``was_deactivated``."""
    hit = F.col(active) & expires.isNotNull() & (expires < now)
    return df.withColumn("was_deactivated", hit).withColumn("is_active", F.col(active) & ~hit)


def context_counts(df: DataFrame, session: str, ts: str, closing: Column) -> DataFrame:
    """Entries, last activity, status and completion time per session."""
    g = df.groupBy(session).agg(F.count("*").alias("entries"), F.max(ts).alias("last_activity"), F.max(F.when(closing, F.col(ts))).alias("completed_at"))
    done = F.col("completed_at") == F.col("last_activity")
    return g.withColumn("status", F.when(done, "completed").otherwise("active")).withColumn("completed_at", F.when(done, F.col("completed_at")))


def delete_matching(df: DataFrame, doomed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number deleted)."""
    keep = df.join(doomed.select(*keys).distinct(), keys, "left_anti")
    gone = df.join(doomed.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("deleted"))
    return keep, gone


def memory_stats(entries: DataFrame, active: Column, contexts: DataFrame, open_: Column, entities: DataFrame, logs: DataFrame) -> DataFrame:
    parts = [("total_entries", entries, F.count("*")), ("active_entries", entries, F.count_if(active)), ("total_contexts", contexts, F.count("*")),
             ("active_contexts", contexts, F.count_if(open_)), ("total_entities", entities, F.count("*")), ("total_logs", logs, F.count("*"))]
    out = None
    for name, df, agg in parts:
        d = df.agg(agg.alias("n")).select(F.lit(name).alias("stat"), "n")
        out = d if out is None else out.unionByName(d)
    return out


# What each access level permits.
LEVEL_OPERATIONS = {"read": ["read", "search"], "write": ["read", "write", "search", "delete"],
                    "admin": ["read", "write", "search", "delete", "admin"]}


def row_scope(df: DataFrame, owner: str, role: str, user) -> DataFrame:
    """GP sees all rows, PATIENT own rows; ADMIN and AUDITOR may not read patient data."""
    r = role.upper()
    if r == "GP":
        return df
    if r == "PATIENT":
        return df.filter(F.col(owner) == user)
    raise PermissionError(f"role {role} cannot access patient data")


def access_decision(requests: DataFrame, roles: dict[str, dict], role: str, operation: str, kind: str, target: str,
                    session: str, patient: str, ts: str, rid: str, default: dict) -> DataFrame:
    """allowed and reason per request, in time order inside a session.

    Checks: operation, memory type, scope and level, then patient isolation: the first patient
    that passes the other checks in a session is registered, requests for others are denied.
    """
    def per_role(field):
        out = None
        for name, p in roles.items():
            v = p[field]
            lit = F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
            out = F.when(F.col(role) == name, lit) if out is None else out.when(F.col(role) == name, lit)
        d = default[field]
        return out.otherwise(F.array(*[F.lit(x) for x in d]) if isinstance(d, list) else F.lit(d))

    scope = F.when(F.col(target).isNull() | (F.col(target) == F.col(role)), "own").when(F.col(target) == "shared", "shared").otherwise("other")
    level = F.when(scope == "own", per_role("own")).when(scope == "shared", per_role("shared")).otherwise(per_role("other"))
    ok_level = F.lit(False)
    for lv, ops in LEVEL_OPERATIONS.items():
        ok_level = ok_level | ((level == lv) & (F.col(operation).isin(*ops) if lv != "admin" else F.lit(True)))
    early = (F.when(~F.array_contains(per_role("operations"), F.col(operation)), "operation")
             .when(~F.array_contains(per_role("types"), F.col(kind)), "memory_type")
             .when(level == "none", "scope").when(~ok_level, "level"))
    d = requests.withColumn("scope", scope).withColumn("__early", early).withColumn("__iso", per_role("isolated"))
    gate = F.col("__early").isNull() & F.col("__iso") & F.col(session).isNotNull() & F.col(patient).isNotNull()
    first = d.filter(gate).groupBy(session).agg(F.min_by(patient, F.struct(ts, rid)).alias("__first"))
    j = d.join(first, session, "left")
    reason = F.when(F.col("__early").isNotNull(), F.col("__early")).when(gate & (F.col(patient) != F.col("__first")), "patient_isolation").otherwise("granted")
    return j.withColumn("reason", reason).withColumn("allowed", reason == "granted").drop("__early", "__iso", "__first")


def ingest_metrics(events: DataFrame, ingested: Column, asked: Column, doc: str, ts: str) -> DataFrame:
    """Documents taken in, queries asked, documents in the index, and when the last one came."""
    return events.agg(F.count_if(ingested).alias("documents"), F.count_if(asked).alias("queries"),
                      F.countDistinct(F.when(ingested, F.col(doc))).alias("index_size"), F.max(F.when(ingested, F.col(ts))).alias("last_ingest"))
