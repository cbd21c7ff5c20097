"""Hours reports: conditional totals, time buckets, apportioning, rollups.

All are grouped aggregations with map-side partial sums, so hot groups shrink before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timecols as tc


def bucket(ts, period: str) -> Column:
    """Bucket label: H and D left edge, W the Sunday that ends the week, M the month's last day."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if period == "H":
        return F.date_trunc("hour", c.cast("timestamp_ntz")).cast("timestamp_ntz")
    d = {"D": F.to_date(c), "W": F.date_add(F.to_date(c), 6 - F.weekday(c)), "M": F.last_day(F.to_date(c))}[period]
    return tc.day_start(d)


def _spine(df: DataFrame, period: str) -> DataFrame:
    """All bucket labels between the first and the last one present."""
    lo_hi = df.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    step = {"H": "INTERVAL '1' HOUR", "D": "INTERVAL '1' DAY", "W": "INTERVAL '7' DAY"}.get(period)
    if step:
        return lo_hi.select(F.explode(F.expr(f"sequence(a, b, {step})")).alias("bucket"))
    months = F.expr("sequence(trunc(a, 'MM'), trunc(b, 'MM'), INTERVAL '1' MONTH)")
    return lo_hi.select(F.explode(months).alias("m")).select(tc.day_start(F.last_day("m")).alias("bucket"))


def resample(events: DataFrame, ets: str, eaggs: list[Column], commits: DataFrame, cts: str, caggs: list[Column],
             period: str) -> DataFrame:
    """Bucketed aggregates of two sources side by side; buckets without rows count 0."""
    parts = []
    for df, ts, aggs in ((events, ets, eaggs), (commits, cts, caggs)):
        g = df.groupBy(bucket(ts, period).alias("bucket")).agg(*aggs)
        parts.append((g, _spine(g, period)))
    spine = parts[0][1].unionByName(parts[1][1]).distinct()
    return spine.join(parts[0][0], "bucket", "left").join(parts[1][0], "bucket", "left").na.fill(0)


def conditional_totals(df: DataFrame, hours: Column, flag: Column, real: Column) -> DataFrame:
    def pct(a, b):
        return F.when(b > 0, a / b * 100).otherwise(0.0)

    zero = F.lit(0.0)
    out = df.agg(F.count("*").alias("sessions"), F.coalesce(F.sum(hours), zero).alias("hours"),
                 F.count_if(flag).alias("flagged"), F.coalesce(F.sum(F.when(flag, hours)), zero).alias("flagged_hours"),
                 F.count_if(real).alias("real"), F.coalesce(F.sum(F.when(real, hours)), zero).alias("real_hours"),
                 F.count_if(~real).alias("synthetic"), F.coalesce(F.sum(F.when(~real, hours)), zero).alias("synthetic_hours"))
    return out.withColumn("flagged_pct", pct(F.col("flagged_hours"), F.col("hours"))) \
        .withColumn("real_pct", pct(F.col("real_hours"), F.col("hours")))


def by_group(df: DataFrame, keys: list[Column], hours: Column, source: Column | None = None, sources: list[str] = ()) -> DataFrame:
    aggs = [F.count("*").alias("n"), F.sum(hours).alias("hours")]
    aggs += [F.coalesce(F.sum(F.when(source == s, hours)), F.lit(0.0)).alias(f"hours_{s}") for s in sources]
    return df.groupBy(*keys).agg(*aggs)


def month_category_map(df: DataFrame, ts: str, category: str, hours: Column) -> DataFrame:
    """month -> count, hours and a map(category -> hours); one map entry per category."""
    month = F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM").alias("month")
    per = df.groupBy(month, category).agg(F.count("*").alias("n"), F.sum(hours).alias("h"))
    return per.groupBy("month").agg(F.sum("n").alias("n"), F.sum("h").alias("hours"), F.map_from_entries(
        F.array_sort(F.collect_list(F.struct(F.col(category), F.col("h"))))).alias("by_category"))


def apportion(sessions: DataFrame, sid: str, hours: str, members: DataFrame, name: str, missing: str = "No commits") -> DataFrame:
    """Hours of a session split equally over its distinct members."""
    m = members.select(sid, name).distinct()
    n = m.groupBy(sid).agg(F.count("*").alias("__n"))
    j = sessions.select(sid, hours).join(n, sid, "left").join(m, sid, "left")
    share = F.col(hours) / F.coalesce("__n", F.lit(1))
    return j.groupBy(F.coalesce(name, F.lit(missing)).alias(name)).agg(F.sum(share).alias("hours"), F.count("*").alias("sessions"))


def category_stats(categories: DataFrame, key: str, sessions: DataFrame, hours: str, start: str) -> DataFrame:
    g = sessions.groupBy(key).agg(F.count("*").alias("n"), F.sum(hours).alias("hours"), F.avg(hours).alias("avg_hours"),
                                  F.min(start).alias("first_start"), F.max(start).alias("last_start"))
    return categories.join(g, key, "left").na.fill(0, ["n", "hours", "avg_hours"])


def validation_rollup(rows: DataFrame, sid: str, issues: dict[str, DataFrame]) -> DataFrame:
    """One row: rows checked, rows with errors, error and warning totals, pass and ready flags."""
    found = None
    for source, df in issues.items():
        d = df.select(F.col(sid), F.lit(source).alias("source"), "level")
        found = d if found is None else found.unionByName(d)
    bad = found.filter("level = 'error'").select(sid).distinct()
    tot = found.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"),
                    *[F.count_if(F.col("source") == s).alias(f"issues_{s}") for s in issues])
    cnt = rows.select(sid).join(bad.withColumn("__bad", F.lit(1)), sid, "left").agg(
        F.count("*").alias("total"), F.count("__bad").alias("invalid"))
    one = tot.withColumn("k", F.lit(1)).join(cnt.withColumn("k", F.lit(1)), "k").drop("k")
    return one.withColumn("valid", F.col("total") - F.col("invalid")).withColumn("passed", F.col("errors") == 0) \
        .withColumn("ready", F.col("passed") & (F.col("warnings") < 10))


def week_activity_rollup(df: DataFrame, week: str, activity: str, sub: str, hours: str) -> DataFrame:
    """Six levels in one pass: week/activity/sub, week/activity, week, activity/sub, activity, all."""
    w, a, s = F.col(week), F.col(activity), F.col(sub)
    g = df.groupingSets([[w, a, s], [w, a], [w], [a, s], [a], []], w, a, s)
    return g.agg(F.grouping_id().alias("level"), F.sum(hours).alias("hours"), F.count("*").alias("n"))


def title_totals(df: DataFrame, title: str, week: Column, hours: Column) -> DataFrame:
    return df.groupBy(title).agg(F.sum(hours).alias("hours"), F.countDistinct(week).alias("active_weeks"), F.count("*").alias("n")) \
        .orderBy(F.desc("hours"), title)


def week_totals(df: DataFrame, title: str, week: Column, hours: Column) -> DataFrame:
    return df.groupBy(week.alias("week")).agg(F.sum(hours).alias("hours"), F.countDistinct(title).alias("activities"))


def calendar_summary(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.countDistinct(F.to_date(start)).alias("days"),
                  F.round(F.sum(tc.hours_between(start, end)), 2).alias("hours"), F.min(start).alias("earliest"), F.max(end).alias("latest"))


def session_metrics(df: DataFrame, start: str, total: str, work: str, kind: str, kinds: list[str]) -> DataFrame:
    eff = F.when(F.sum(total) > 0, F.sum(work) / F.sum(total) * 100).otherwise(0.0)
    return df.agg(F.count("*").alias("sessions"), F.sum(total).alias("total_hours"), F.sum(work).alias("work_hours"),
                  eff.alias("efficiency"), F.avg(work).alias("avg_hours"), F.countDistinct(F.to_date(start)).alias("days"),
                  F.min(F.to_date(start)).alias("first_day"), F.max(F.to_date(start)).alias("last_day"),
                  *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])


def date_profile(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per source: rows, parsed rows, parse errors, first and last day, span in days."""
    out = None
    for name, (df, text) in sources.items():
        ts = tc.parse_stamp(text)
        p = df.select(F.lit(name).alias("source"), ts.alias("ts")).groupBy("source").agg(
            F.count("*").alias("rows"), F.count("ts").alias("parsed"), F.min(F.to_date("ts")).alias("first_day"),
            F.max(F.to_date("ts")).alias("last_day"))
        out = p if out is None else out.unionByName(p)
    return out.withColumn("errors", F.col("rows") - F.col("parsed")).withColumn("span_days", F.date_diff("last_day", "first_day"))


def coverage(df: DataFrame, start: str, hours: Column, kind: str, kinds: list[str], target_hours: float) -> DataFrame:
    d = F.to_date(start)
    span = F.date_diff(F.max(d), F.min(d)) + 1
    return df.agg(F.countDistinct(d).alias("days_with"), span.alias("days_in_range"), (F.countDistinct(d) / span * 100).alias("coverage_pct"),
                  F.sum(hours).alias("hours"), (F.lit(target_hours) - F.sum(hours)).alias("gap_to_target"),
                  *[F.coalesce(F.sum(F.when(F.col(kind) == k, hours)), F.lit(0.0)).alias(f"hours_{k}") for k in kinds])


def daily_activity(sessions: DataFrame, start: str, hours: Column, commits: DataFrame, ts: str, repo: str) -> DataFrame:
    """One row per day between the first and last day of either source."""
    s = sessions.groupBy(F.to_date(start).alias("day")).agg(F.sum(hours).alias("hours"), F.count("*").alias("sessions"))
    seen = commits.groupBy(F.to_date(ts).alias("day"), repo).agg(F.count("*").alias("n"))
    c = seen.groupBy("day").agg(F.sum("n").alias("commits"), F.count(repo).alias("repos"), F.array_sort(F.collect_set(repo)).alias("repo_list"))
    both = s.select("day").unionByName(c.select("day")).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = both.select(F.explode(F.sequence("a", "b")).alias("day"))
    out = spine.join(s, "day", "left").join(c, "day", "left").na.fill(0, ["hours", "sessions", "commits", "repos"])
    return out.withColumn("repo_list", F.coalesce("repo_list", F.array().cast("array<string>")))


def commit_totals(commits: DataFrame, ts: str, repo: str, eligible: Column) -> DataFrame:
    """One row about a commit log, with its repositories by name; what is known of each are the rows of ``commit_repositories``."""
    names = F.sort_array(F.collect_set(repo))
    return commits.agg(F.count("*").alias("commits"), F.count_if(eligible).alias("eligible"), F.countDistinct(repo).alias("repositories"),
                       F.when(F.size(names) > 0, F.array_join(names, ",")).alias("repos"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def commit_repositories(commits: DataFrame, ts: str, repo: str, eligible: Column) -> DataFrame:
    """Per repository: commits, eligible ones, days with commits, commits a day, first and last commit.

    Days are counted from one row per repository and day, so a busy repository is summed before the shuffle."""
    day = commits.groupBy(repo, F.to_date(ts).alias("day")).agg(
        F.count("*").alias("n"), F.count_if(eligible).alias("e"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    g = day.groupBy(repo).agg(F.sum("n").alias("commits"), F.sum("e").alias("eligible"), F.count("day").alias("days"),
                              F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return g.withColumn("per_day", F.when(F.col("days") > 0, F.col("commits") / F.col("days")))


def hours_by_kind(rows: DataFrame, kind: Column, category: str, hours: Column) -> DataFrame:
    """Rows and hours per kind and category."""
    return rows.groupBy(kind.alias("kind"), category).agg(F.count("*").alias("n"), F.sum(hours).alias("hours"))
