"""Lookups, conflict checks and star joins built from ordinary DataFrame joins.

No broadcast hints: Spark broadcasts a side when its own size check allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keywords as kw
from ..functions import timecols as tc
from ..scale import cut_lineage, first_per
from .intervals import overlap_join, stab_join


def assignment_summary(sessions: DataFrame, pairs: DataFrame, sid: str, flag: Column) -> DataFrame:
    """Every session with its number of points and whether any is flagged.  The pairs table
    itself holds the member list, one row each, so a busy session stays spread out."""
    n = pairs.groupBy(sid).agg(F.count("*").alias("commit_count"), F.bool_or(flag).alias("any_flag"))
    return sessions.join(n, sid, "left").withColumn("commit_count", F.coalesce("commit_count", F.lit(0))) \
        .withColumn("any_flag", F.coalesce("any_flag", F.lit(False)))


def unassigned_by_date(points: DataFrame, pairs: DataFrame, pid: str, ts: str) -> DataFrame:
    return points.join(pairs.select(pid), pid, "left_anti").groupBy(F.to_date(ts).alias("date")).agg(F.count("*").alias("n"))


def same_day_join(points: DataFrame, sessions: DataFrame, ts: str, start: str, end: str,
                  keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Points inside a session, looked up on the session's start day only."""
    day = sessions.withColumn("__sday", F.to_date(start)) \
        .withColumn("__until", F.least(F.col(end), F.col("__sday").cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND")))
    pts = points.withColumn("__pday", F.to_date(ts))
    return stab_join(pts, day, ts, start, "__until", [*keys, ("__pday", "__sday")]).drop("__sday", "__pday", "__until")


def overlap_pairs(df: DataFrame, sid: str, start: str, end: str, keys: list[str] = (), plain: bool = False) -> DataFrame:
    """Unordered overlapping pairs with hours; over one hour is critical.

    One lookup finds each pair once: the later start (at equal starts, the larger id) lies in the other interval.
    A pair has max(start) < min(end), so empty and reversed intervals have none.  ``plain=True`` asks only that each starts before the
    other's end: an empty or reversed interval that starts inside another one then has a pair too, of no or negative hours.
    """
    cols = [sid, start, end, *keys]
    real = df.filter(F.col(start) < F.col(end))
    late = (df if plain else real).select(*[F.col(c).alias(f"p_{c}") for c in cols])
    early = real.select(*[F.col(c).alias(f"q_{c}") for c in cols])
    j = stab_join(late, early, f"p_{start}", f"q_{start}", f"q_{end}", [(f"p_{k}", f"q_{k}") for k in keys])
    ps, pe, qs, pi, qi = F.col(f"p_{start}"), F.col(f"p_{end}"), F.col(f"q_{start}"), F.col(f"p_{sid}"), F.col(f"q_{sid}")
    j = j.filter((ps < F.col(f"q_{end}")) & (qs < pe) & (pi != qi) & ((ps > qs) | ((ps == qs) & (pi > qi))))
    first = pi < qi
    j = j.select(*[F.when(first, F.col(f"p_{c}")).otherwise(F.col(f"q_{c}")).alias(f"a_{c}") for c in cols],
                 *[F.when(first, F.col(f"q_{c}")).otherwise(F.col(f"p_{c}")).alias(f"b_{c}") for c in cols])
    hours = tc.hours_between(F.greatest(f"a_{start}", f"b_{start}"), F.least(f"a_{end}", f"b_{end}"))
    return j.withColumn("overlap_hours", hours) \
        .withColumn("severity", F.when(F.col("overlap_hours") > 1, "critical").otherwise("warning"))


def conflicts(sessions: DataFrame, existing: DataFrame, ss: str, se: str, es: str, ee: str,
              keys: list[tuple[str, str]] = ()) -> DataFrame:
    j = overlap_join(sessions, existing, ss, se, es, ee, keys)
    return j.withColumn("overlap_hours", tc.overlap_hours(ss, se, es, ee)) \
        .withColumn("conflict_size", F.when(F.col("overlap_hours") < 2.0, "short").otherwise("long"))


def conflict_annotate(sessions: DataFrame, found: DataFrame, sid: str) -> DataFrame:
    """Every session, one row each, with its number of conflicts and a flag."""
    n = found.groupBy(sid).agg(F.count("*").alias("conflict_count"))
    return sessions.join(n, sid, "left").withColumn("conflict_count", F.coalesce("conflict_count", F.lit(0))) \
        .withColumn("has_conflict", F.col("conflict_count") > 0)


def conflict_rows(found: DataFrame, sid: str, payload: list[str]) -> DataFrame:
    """One row and one JSON text per conflict, so a session with very many stays spread out."""
    return found.select(sid, F.to_json(F.struct(*payload)).alias("conflict"))


def duplicates_against(batch: DataFrame, existing: DataFrame, sid: str, start: str, end: str) -> DataFrame:
    """Rows of the batch whose id, or exact time range, is already present."""
    by_id = batch.join(existing.select(sid).distinct(), sid, "left_semi").withColumn("match", F.lit("id"))
    by_range = batch.join(existing.select(start, end).distinct(), [start, end], "left_semi").withColumn("match", F.lit("range"))
    return by_id.unionByName(by_range)


def _first_comers(open_: DataFrame, sid: str, rng: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(rows that come first under both their id and their range, rows that clash with none of these)."""
    by_id = open_.groupBy(sid).agg(F.min(order).alias("__i"))
    by_rng = open_.groupBy(*rng).agg(F.min(order).alias("__r"))
    won = cut_lineage(open_.join(by_id, sid).join(by_rng, rng).filter(
        (F.col(order) == F.col("__i")) & (F.col(order) == F.col("__r"))).select(order, sid, *rng))
    return won, cut_lineage(open_.join(won.select(sid), sid, "left_anti").join(won.select(*rng), rng, "left_anti"))


def _clusters(open_: DataFrame, sid: str, rng: list[str], order: str) -> DataFrame:
    """``open_`` with ``__c``, one number for all rows that shared ids and ranges connect.

    Every row points to a row of its cluster, itself at first.  In a round it learns the least grandparent among its
    id's and its range's rows, hooks its parent and itself there, and jumps over its parent, so rounds grow with the
    logarithm of the longest chain.
    """
    keep = [order, sid, *rng]
    now, moving = open_.select(*keep, F.col(order).alias("__f"), F.col(order).alias("__g")), 1
    while moving:
        by_id = now.groupBy(sid).agg(F.min("__g").alias("__i"))
        by_rng = now.groupBy(*rng).agg(F.min("__g").alias("__r"))
        seen = now.join(by_id, sid).join(by_rng, rng).withColumn("__m", F.least("__i", "__r"))
        hooks = seen.groupBy(F.col("__f").alias(order)).agg(F.min("__m").alias("__h"))
        up = seen.join(hooks, order, "left").select(*keep, "__g", F.least("__f", "__m", "__g", F.coalesce("__h", "__f")).alias("__f"))
        up = cut_lineage(up)
        parents = up.select(F.col(order).alias("__f"), F.col("__f").alias("__n"))
        now = cut_lineage(up.join(parents, "__f").select(*keep, "__f", F.col("__n").alias("__g"), (F.col("__g") != F.col("__n")).alias("__moved")))
        moving = now.filter("__moved").limit(1).count()
        now = now.drop("__moved")
    return now.select(*keep, F.col("__g").alias("__c"))


def _in_turn(sid: str, rng: list[str], order: str):
    """Accepts rows sorted by cluster and order; what has been accepted is held for one cluster at a time."""

    def run(batches):
        at, ids, ranges = object(), set(), set()
        for pdf in batches:
            keep = []
            for c, i, r in zip(pdf["__c"], pdf[sid], zip(*(pdf[x] for x in rng))):
                if c != at:
                    at, ids, ranges = c, set(), set()
                good = i not in ids and r not in ranges
                if good:
                    ids.add(i)
                    ranges.add(r)
                keep.append(good)
            yield pdf[keep][[order, sid, *rng]]

    return run


def upload_plan(batch: DataFrame, existing: DataFrame, sid: str, start: str, end: str, order: str, rounds: int = 2,
                cluster_rows: int = 1_000_000) -> DataFrame:
    """Decide each row in order: id exists, id repeated, range exists, range repeated, else accept.

    Only accepted rows count as seen, so a row's fate can hang on a long chain of others.  After ``rounds`` rounds, in
    which rows that come first under both their id and their range are accepted and those that clash with them leave, the rest is
    clustered by shared ids and ranges.  Clusters of up to ``cluster_rows`` rows are settled in order, streamed, in one pass; only
    inside larger ones do rounds go on.  ``order`` must be unique.
    """
    rng = [start, end]
    ids = existing.select(sid).distinct().withColumn("id_exists", F.lit(True))
    rngs = existing.select(start, end).distinct().withColumn("range_exists", F.lit(True))
    rows = batch.join(ids, sid, "left").join(rngs, rng, "left")
    open_ = cut_lineage(rows.filter("id_exists is null and range_exists is null").select(order, sid, start, end))
    accepted = open_.limit(0)
    for _ in range(rounds):
        won, open_ = _first_comers(open_, sid, rng, order)
        accepted = accepted.unionByName(won)
    if not open_.isEmpty():
        placed = _clusters(open_, sid, rng, order)
        large = cut_lineage(placed.groupBy("__c").agg(F.count("*").alias("__n")).filter(F.col("__n") > cluster_rows).select("__c"))
        small = placed.join(large, "__c", "left_anti").repartition("__c").sortWithinPartitions("__c", order)
        accepted = accepted.unionByName(cut_lineage(small.mapInPandas(_in_turn(sid, rng, order), accepted.schema)))
        open_ = placed.join(large, "__c").drop("__c")
        while not open_.isEmpty():
            won, open_ = _first_comers(open_, sid, rng, order)
            accepted = accepted.unionByName(won)
    a_id = accepted.select(sid, F.col(order).alias("__ai"))
    a_rng = accepted.select(start, end, F.col(order).alias("__ar"))
    o = F.col(order)
    status = (F.when(F.col("id_exists"), "id_exists").when(F.col("__ai") < o, "id_repeated")
              .when(F.col("range_exists"), "range_exists").when(F.col("__ar") < o, "range_repeated").otherwise("accepted"))
    return rows.join(a_id, sid, "left").join(a_rng, [start, end], "left").withColumn("status", status) \
        .drop("id_exists", "range_exists", "__ai", "__ar")


def star_totals(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, name: str, hours: Column, source: str,
                sources: list[str]) -> DataFrame:
    """Counts and hours per dimension value, split by source."""
    pre = facts.groupBy(fact_key).agg(F.count("*").alias("n"), F.sum(hours).alias("h"),
                                      *[F.sum(F.when(F.col(source) == s, hours)).alias(f"h_{s}") for s in sources])
    j = pre.join(dim.select(F.col(dim_key).alias(fact_key), name), fact_key)
    return j.groupBy(name).agg(F.sum("n").alias("n"), F.sum("h").alias("hours"),
                               *[F.coalesce(F.sum(f"h_{s}"), F.lit(0.0)).alias(f"hours_{s}") for s in sources])


def two_child_totals(parent: DataFrame, pk: str, left: DataFrame, lk: str, lagg: list[Column],
                     right: DataFrame, rk: str, ragg: list[Column]) -> DataFrame:
    """Parent with totals of two child tables; each child is summed first, so neither inflates the other."""
    a = left.groupBy(F.col(lk).alias(pk)).agg(*lagg)
    b = right.groupBy(F.col(rk).alias(pk)).agg(*ragg)
    return parent.join(a, pk, "left").join(b, pk, "left").na.fill(0)


def dates_without(points: DataFrame, ts: str, repo: str, sessions: DataFrame, day: str) -> DataFrame:
    """Per date that has points but no session: number of points and of repositories."""
    have = sessions.select(F.to_date(day).alias("date")).distinct()
    p = points.select(F.to_date(ts).alias("date"), repo).join(have, "date", "left_anti")
    return p.groupBy("date").agg(F.count("*").alias("n"), F.countDistinct(repo).alias("repos"))


def daily_enrich(log: DataFrame, sessions: DataFrame, date: str, hours: str, s_hours: str) -> DataFrame:
    """Per-date session hours replace the logged hours when they are positive."""
    per = sessions.groupBy(date).agg(F.sum(s_hours).alias("session_hours"), F.count("*").alias("session_count"))
    out = log.join(per, date, "left").na.fill(0, ["session_hours", "session_count"])
    return out.withColumn("final_hours", F.when(F.col("session_hours") > 0, F.col("session_hours")).otherwise(F.col(hours)))


def title_fallback(df: DataFrame, sub_id: str, act_id: str, category: str, subs: DataFrame, acts: DataFrame) -> DataFrame:
    """title = sub-activity name by id, else activity name, else category.  subs(id,name), acts(id,name)."""
    s = subs.select(F.col("id").alias(sub_id), F.col("name").alias("__sub"))
    a = acts.select(F.col("id").alias(act_id), F.col("name").alias("__act"))
    return df.join(s, sub_id, "left").join(a, act_id, "left").withColumn("title", F.coalesce("__sub", "__act", category)).drop("__sub", "__act")


def activity_mappings(repos: DataFrame, name: str, text: Column, commit_text: Column, catalogue: list[dict],
                      overrides: DataFrame | None = None, min_score: float = 0.1) -> DataFrame:
    """(activity, sub-activity, repository) rows with score >= ``min_score``.

    The catalogue is configuration: each repository row scores it in place, so nothing is
    crossed or shuffled.  Overrides replace rows of the same key.
    """
    both = F.concat_ws(" ", text, commit_text)
    cells = []
    for act in catalogue:
        score = kw.activity_score(act, text, commit_text)
        cells.append(F.struct(F.lit(act["id"]).alias("activity_id"), F.lit(None).cast("string").alias("sub_activity_id"), score.alias("score")))
        for sub in act.get("sub_activities", []):
            ratio = F.least(kw.keyword_count(both, sub["keywords"]) / max(len(sub["keywords"]), 1), F.lit(1.0))
            own = F.when((score >= min_score) & (ratio > 0), ratio).otherwise(0.0)
            cells.append(F.struct(F.lit(act["id"]).alias("activity_id"), F.lit(sub["id"]).alias("sub_activity_id"), own.alias("score")))
    got = F.filter(F.array(*cells), lambda c: c["score"] >= min_score)
    out = repos.select(F.col(name).alias("repo_name"), F.explode(got).alias("c")).select(
        "repo_name", "c.activity_id", "c.sub_activity_id", "c.score", F.lit(True).alias("auto"))
    band = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "medium").otherwise("low")
    out = out.withColumn("confidence", band)
    if overrides is None:
        return out
    o = overrides.select("repo_name", "activity_id", "sub_activity_id", F.lit(None).cast("double").alias("score"),
                         F.lit(False).alias("auto"), F.coalesce("confidence", F.lit("medium")).alias("confidence"))
    return first_per(out.unionByName(o), ["repo_name", "activity_id", "sub_activity_id"], ["auto"])
