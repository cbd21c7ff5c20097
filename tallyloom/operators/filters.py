"""Row filters, derived flags and row validation.  Checks give one row per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timecols as tc


def filter_time_range(df: DataFrame, ts: str, lo, hi) -> DataFrame:
    """Inclusive on both ends; a bound that is no timestamp is an error."""
    bounds = [F.to_timestamp_ntz(F.lit(str(x)), F.lit("yyyy-MM-dd HH:mm:ss")) for x in (lo, hi)]
    return df.filter(F.col(ts).between(*bounds))


def filter_from_date(df: DataFrame, ts: str, first_day: str) -> DataFrame:
    return df.filter(F.col(ts) >= F.to_timestamp_ntz(F.lit(first_day), F.lit("yyyy-MM-dd")))


def filter_either_end_in_range(df: DataFrame, start: str, end: str, lo: str, hi: str) -> DataFrame:
    """A session that spans the whole range has neither end inside, and is left out."""
    a, b = (F.to_timestamp_ntz(F.lit(x), F.lit("yyyy-MM-dd HH:mm:ss")) for x in (lo, hi))
    return df.filter(F.col(start).between(a, b) | F.col(end).between(a, b))


def event_flags(df: DataFrame, ts: str, kind: str, message: str,
                start_pattern: str = "startup|logon|login", stop_pattern: str = "shutdown|logoff|logout") -> DataFrame:
    def hit(p):
        return F.coalesce(F.col(kind).rlike(f"(?i){p}"), F.lit(False))

    return df.withColumns({
        "is_startup": hit(start_pattern), "is_shutdown": hit(stop_pattern), "hour": F.hour(ts),
        "day_of_week": F.weekday(ts), "date": F.to_date(ts), "message_length": F.length(message)})


def session_tag(code: Column, message: Column) -> Column:
    """logon / logoff / null from a machine event code and its message."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (F.when(code == "7001", "logon")
            .when((code == "6005") & (m.contains("startup") | m.contains("started")), "logon")
            .when(code.isin("7002", "6008", "41"), "logoff")
            .when((code == "1074") & (m.contains("shutdown") | m.contains("restart")), "logoff"))


def work_session_reasons(df: DataFrame, start: str, end: str, first_day: str) -> DataFrame:
    """Adds ``reject_reason`` (null = keep).  An end before its start is on the next day."""
    s, e0 = F.col(start), F.col(end)
    e = F.when(e0 < s, e0 + F.expr("INTERVAL '1' DAY")).otherwise(e0)
    sm, em = tc.minute_of_day(s), tc.minute_of_day(e)
    night = F.when(F.to_date(s) == F.to_date(e), (sm < 390) & (em > 60)).otherwise((sm < 390) | (em > 60))
    reason = (F.when(s.isNull() | e0.isNull(), "invalid_datetime")
              .when(F.to_date(s) < F.lit(first_day).cast("date"), "before_target_start")
              .when(e <= s, "non_positive_duration")
              .when(night, "overlaps_night"))
    return df.withColumn(end, e).withColumn("reject_reason", reason)


def reason_counts(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return df.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason)


def _issues(df: DataFrame, sid: str, checks: list[tuple[Column, str, str]]) -> DataFrame:
    found = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(name).alias("issue"), F.lit(level).alias("level"))) for cond, name, level in checks]))
    return df.select(sid, F.explode(found).alias("x")).select(sid, "x.issue", "x.level")


def time_range_issues(df: DataFrame, sid: str, start: str, end: str, kind: str) -> DataFrame:
    s, e = F.col(start), F.col(end)
    both = s.isNotNull() & e.isNotNull()
    return _issues(df, sid, [
        (~both, "missing_time", "error"),
        (both & (s >= e), "invalid_range", "error"),
        (both & (tc.hours_between(s, e) > 24), "too_long", "error"),
        (both & (F.to_date(s) != F.to_date(e)) & ~F.coalesce(F.col(kind), F.lit("")).isin("full_day", "evening"),
         "crosses_midnight", "warning"),
    ])


# The category codes a flagged session may carry.
CATEGORY_CODES = ["AI_FRAMEWORK", "ACCESS_CONTROL", "PRIVACY_CLOUD", "AUDIT_LOGGING", "DATA_INTEGRITY", "GENERAL_RD"]


def completeness_issues(df: DataFrame, sid: str, flag: str, category: str, reason: str,
                        codes: list[str] = CATEGORY_CODES) -> DataFrame:
    c, r, on = F.coalesce(F.col(category), F.lit("")), F.coalesce(F.col(reason), F.lit("")), F.col(flag)
    return _issues(df, sid, [
        (on & (c == ""), "missing_category", "error"),
        (on & (c != "") & ~c.isin(*codes), "invalid_category", "error"),
        (on & (r == ""), "missing_justification", "error"),
    ])


# Start hours each named part of the day may have.
DAY_PARTS = {"morning": (6, 12), "afternoon": (12, 18), "evening": (18, 24)}


def quality_issues(df: DataFrame, sid: str, start: str, work_hours: str, duration_hours: str, kind: str) -> DataFrame:
    h = F.hour(start)
    checks = [(F.col(sid).isNull() | (F.col(sid).cast("string") == ""), "missing_id", "error"),
              (F.col(work_hours) > F.col(duration_hours), "work_exceeds_duration", "error")]
    for part, (lo, hi) in DAY_PARTS.items():
        checks.append(((F.col(kind) == part) & ~((h >= lo) & (h < hi)), f"type_{part}_mismatch", "warning"))
    return _issues(df, sid, checks)


def validate_rows(df: DataFrame, checks: list[tuple[Column, str, str]]) -> DataFrame:
    """Adds errors[], warnings[] and is_valid; a check is (condition, name, level)."""
    def names(level):
        return F.array_compact(F.array(*[F.when(c, n) for c, n, lv in checks if lv == level]))

    return df.withColumn("errors", names("error")).withColumn("warnings", names("warning")) \
        .withColumn("is_valid", F.size("errors") == 0)


# Accepted session types and sources.
SESSION_TYPES = ["morning", "afternoon", "evening", "full_day", "short_session"]
SOURCE_TYPES = ["real", "synthetic"]


def session_row_checks(required: list[str], start: str, end: str, work_hours: str, duration_hours: str, flag: str,
                       category: str, reason: str, kind: str, source: str, count: str, commits: Column,
                       codes: list[str] = CATEGORY_CODES) -> list[tuple[Column, str, str]]:
    wh, dh, c = F.col(work_hours), F.col(duration_hours), F.coalesce(F.col(category), F.lit(""))
    checks = [(F.col(r).isNull() | (F.col(r).cast("string") == ""), f"missing_{r}", "error") for r in required]
    return checks + [
        (F.col(start) >= F.col(end), "invalid_range", "error"),
        (tc.hours_between(start, end) > 24, "too_long", "error"),
        (wh < 0, "negative_work_hours", "error"),
        (wh > 24, "work_hours_over_24", "error"),
        ((dh != 0) & (wh > dh), "work_exceeds_duration", "error"),
        (F.col(flag) & ~c.isin(*codes), "invalid_category", "error"),
        (F.col(flag) & (F.coalesce(F.col(reason), F.lit("")) == ""), "missing_justification", "error"),
        (~F.col(kind).isin(*SESSION_TYPES), "unknown_type", "warning"),
        (~F.col(source).isin(*SOURCE_TYPES), "invalid_source", "error"),
        (F.col(count) < 0, "negative_commit_count", "error"),
        (F.col(count) != F.size(commits), "commit_count_mismatch", "warning"),
    ]


def calendar_row_checks(summary: str, description: str, start: str, end: str, private: str,
                        expected: tuple[str, ...] = ("project", "category", "session_id", "work_hours")
                        ) -> list[tuple[Column, str, str]]:
    """``start``/``end`` are struct<dateTime,timeZone>; ``private`` is map<string,string>;
    ``expected`` names the private keys whose absence is worth a warning."""
    s, e = tc.parse_stamp(F.col(f"{start}.dateTime")), tc.parse_stamp(F.col(f"{end}.dateTime"))
    out = [(F.coalesce(F.col(c), F.lit("")) == "", f"missing_{c}", "error") for c in (summary, description)]
    for c in (start, end):
        out.append((F.col(c).isNull(), f"missing_{c}", "error"))
        out += [(F.col(c).isNotNull() & F.col(f"{c}.{k}").isNull(), f"{c}_without_{k}", "error") for k in ("dateTime", "timeZone")]
    unread = [(F.col(f"{c}.dateTime").isNotNull() & t.isNull()) for c, t in ((start, s), (end, e))]
    out += [(unread[0] | unread[1], "bad_datetime", "error"), (s >= e, "invalid_range", "error")]
    return out + [(~F.map_contains_key(private, k), f"no_{k}", "warning") for k in expected]


def prepare_calendar_rows(df: DataFrame, start: str, end: str) -> DataFrame:
    """A midnight end that is not the next day's becomes 23:59:59 of the start day; adds hours, ISO week and ``drop_reason``."""
    s, e0 = F.col(start), F.col(end)
    midnight = e0 == tc.day_start(F.to_date(e0))
    next_day = F.to_date(e0) == F.date_add(F.to_date(s), 1)
    e = F.when(midnight & ~next_day, tc.day_end(F.to_date(s))).otherwise(e0)
    df = df.withColumn(end, e).withColumn("hours", tc.hours_between(start, end))
    reason = F.when(F.col("hours") <= 0, "zero_or_negative_duration").when(F.col("hours") > 24, "duration_exceeds_24_hours")
    return df.withColumns({
        "iso_year": F.extract(F.lit("YEAROFWEEK"), s).cast("int"), "iso_week": F.weekofyear(s),
        "weekday": F.weekday(s), "drop_reason": reason})


def author_eligibility(author: Column, ts: Column, token: str, first_day: str) -> Column:
    return F.contains(F.lower(author), F.lit(token.lower())) & (ts >= F.to_timestamp_ntz(F.lit(first_day), F.lit("yyyy-MM-dd")))


def similarity_band(x: Column) -> Column:
    return F.when(x > 0.8, "high").when(x > 0.6, "medium").otherwise("low")


def mapping_band(x: Column) -> Column:
    return F.when(x >= 0.7, "high").when(x >= 0.4, "medium").otherwise("low")


def weekend_and_place(day, computer_on: Column) -> tuple[Column, Column]:
    weekend = F.weekday(day) >= 5
    return weekend, F.when(computer_on | weekend, "home").otherwise("office")


def split_originals(df: DataFrame, sid: str) -> DataFrame:
    """Un-suffixed ids whose base also exists as ``base.N`` parts."""
    parts = df.filter(F.col(sid).contains(".")).select(F.split_part(sid, F.lit("."), F.lit(1)).alias("__base")).distinct()
    whole = df.filter(~F.col(sid).contains("."))
    return whole.join(parts, whole[sid] == parts["__base"], "left_semi")


def eligibility_rule(flag: Column, day: Column, commits: Column, first_day: str) -> Column:
    off = (day < F.lit(first_day).cast("date")) | (F.coalesce(commits, F.lit(0)) == 0)
    return F.when(off, False).otherwise(flag)
