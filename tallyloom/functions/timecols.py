"""Column expressions over timestamps.  All keep wall-clock values (no zone shift)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts) -> Column:
    """Microseconds since 1970-01-01 of the wall clock; independent of the session zone."""
    since = _c(ts).cast("timestamp_ntz") - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def hours_between(start, end) -> Column:
    return (micros(end) - micros(start)) / 3.6e9


def minutes_between(start, end) -> Column:
    """Whole minutes, fraction dropped."""
    return ((micros(end) - micros(start)) / 6e7).cast("long")


def plus(ts, interval: str) -> Column:
    return _c(ts) + F.expr(f"INTERVAL {interval}")


def day(ts) -> Column:
    return F.to_date(_c(ts))


def day_start(d) -> Column:
    return _c(d).cast("date").cast("timestamp_ntz")


def day_end(d) -> Column:
    """23:59:59 of the given day."""
    return plus(day_start(d), "'23:59:59' HOUR TO SECOND")


def minute_of_day(ts) -> Column:
    c = _c(ts)
    return F.hour(c) * 60 + F.minute(c)


def at_hour(ts, hour: int) -> Column:
    """Same day at ``hour`` o'clock, seconds kept."""
    c = _c(ts)
    return day_start(F.to_date(c)) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(0), F.extract(F.lit("SECOND"), c))


def session_type(hours: Column, full: float = 8.0, half: float = 4.0, strict: bool = False) -> Column:
    hit = (lambda h, lim: h > lim) if strict else (lambda h, lim: h >= lim)
    return F.when(hit(hours, full), "full_day").when(hit(hours, half), "half_day").otherwise("short_session")


def iso_week(ts) -> Column:
    """ISO year and week, e.g. 2024-W01."""
    c = _c(ts)
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), c), F.weekofyear(c))


def monday_week(ts) -> Column:
    """Year plus Monday-based week number; days before the first Monday are week 00."""
    c = _c(ts)
    n = F.floor((F.dayofyear(c) - 1 + 7 - F.weekday(c)) / 7)
    return F.format_string("%d-W%02d", F.year(c), n)


def sunday_week_of_monday(ts) -> Column:
    """Monday of the week, printed with its Sunday-based week number."""
    c = _c(ts)
    m = F.date_add(F.to_date(c), -F.weekday(c))
    n = F.floor((F.dayofyear(m) - 1 + 7 - (F.dayofweek(m) - 1)) / 7)
    return F.format_string("%d-W%02d", F.year(m), n)


def calendar_year_iso_week(ts) -> Column:
    """Calendar year next to the ISO week (differs from ``iso_week`` around New Year)."""
    c = _c(ts)
    return F.format_string("%d-W%02d", F.year(c), F.weekofyear(c))


# Last minute that still rounds to each five-minute mark (57-59 go to the next hour).
FIVE_MINUTE_TABLE = [(3, 0), (7, 5), (11, 10), (18, 15), (23, 20), (28, 25), (33, 30),
                     (38, 35), (43, 40), (48, 45), (53, 50), (56, 55), (59, 60)]


def round_5min(ts) -> Column:
    """Asymmetric five-minute rounding; 23:57 and later move to the next day."""
    c = _c(ts)
    m, to = F.minute(c), None
    for last, mark in FIVE_MINUTE_TABLE:
        to = F.when(m <= last, mark) if to is None else to.when(m <= last, mark)
    hour0 = plus(day_start(F.to_date(c)), "'0' HOUR") + F.make_dt_interval(F.lit(0), F.hour(c))
    return hour0 + F.make_dt_interval(F.lit(0), F.lit(0), to)


def floor_5min(ts) -> Column:
    c = _c(ts)
    base = day_start(F.to_date(c))
    return base + F.make_dt_interval(F.lit(0), F.hour(c), F.minute(c) - F.minute(c) % 5)


def clip_duration(start, end, max_hours: float = 11.0) -> Column:
    """End, or start + ``max_hours`` floored to five minutes when the span is longer."""
    s, e = _c(start), _c(end)
    limit = s + F.expr(f"INTERVAL '{int(max_hours * 60)}' MINUTE")
    return F.when(hours_between(s, e) <= max_hours, e).otherwise(floor_5min(limit))


def overlap_hours(s1, e1, s2, e2) -> Column:
    return F.greatest(F.lit(0.0), hours_between(F.greatest(_c(s1), _c(s2)), F.least(_c(e1), _c(e2))))


def event_hours(start, end) -> Column:
    """Hours of a calendar row: a negative same-day span that ends at 23:59:59 counts to
    midnight; any other negative span counts by absolute value."""
    h = hours_between(start, end)
    closes_day = (F.to_date(_c(start)) == F.to_date(_c(end))) & (
        F.date_format(_c(end).cast("timestamp"), "HH:mm:ss") == "23:59:59"
    )
    return F.when(closes_day, (micros(day_start(F.to_date(_c(start)))) + F.lit(86_400_000_000) - micros(start)) / 3.6e9) \
        .otherwise(F.abs(h))


# Accepted timestamp layouts in matching order, with the pattern they print in (none:
# the printed length always equals the text's).  A zone may follow: Z, +HH:MM or +HHMM.
TIMESTAMP_LAYOUTS = [
    ("us_ampm", "M/d/yyyy h:mm:ss a", "MM/dd/yyyy hh:mm:ss a"),
    ("slash", "yyyy/M/d H:m:s", "yyyy/MM/dd HH:mm:ss"),
    ("dash", "yyyy-M-d H:m:s", "yyyy-MM-dd HH:mm:ss"),
    ("iso_t", "yyyy-M-d'T'H:m:s", "yyyy-MM-dd'T'HH:mm:ss"),
    ("iso_t_frac", "yyyy-M-d'T'H:m:s.SSSSSS", None),
]
SOURCE_LAYOUTS = {
    "system_events": ["us_ampm", "slash"],
    "git_commits": ["iso_t_zone", "iso_t"],
}


def clean_stamp(text) -> Column:
    """Trim, then one leading quote, one trailing quote, one byte-order mark."""
    t = F.regexp_replace(F.regexp_replace(F.trim(_c(text)), '^"', ""), '"$', "")
    return F.regexp_replace(t, "^﻿", "")


_ZONE_TAIL = r"\s*(?:Z|[+-]\d{2}:?\d{2})$"


def _shape(layout: str) -> str:
    """What every text that a layout reads looks like: numbers and its separators."""
    body = re.sub(r"\.S+", r"~", layout.replace("'", ""))
    return "(?i)^" + re.sub(r"[yMdhHms]+", lambda _: r"[+-]?\d+", body).replace("~", r"(?:\.\d*)?").replace(" a", " .+") + "$"


def _naive(t: Column, layout: str) -> Column:
    # a layout that fails costs an exception a text, so only texts of its shape are tried
    return F.when(t.rlike(_shape(layout)), F.try_to_timestamp(t, F.lit(layout)).cast("timestamp_ntz"))


_ISO = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?$"


def _iso(t: Column) -> Column:
    """What the layouts leave of the ISO forms: a date alone, no seconds, a fraction after a blank."""
    return F.when(t.rlike(_ISO), t.try_cast("timestamp_ntz"))


def parse_stamp(text) -> Column:
    """Wall-clock timestamp of the first layout that reads the text, else of an ISO form (offset dropped), else null."""
    t = F.regexp_replace(clean_stamp(text), _ZONE_TAIL, "")
    # an array of one, so that the text is cleaned once and not again for each layout
    return F.transform(F.array(t), lambda x: F.coalesce(*[_naive(x, lay) for _, lay, _ in TIMESTAMP_LAYOUTS], _iso(x)))[0]


def stamp_layout(text) -> Column:
    """Name of the layout that reads the text, with ``_zone``, ``_offset`` or ``_space_offset`` for
    what follows it; null when nothing reads it."""
    t = clean_stamp(text)
    body, zone = F.regexp_replace(t, _ZONE_TAIL, ""), F.regexp_extract(t, _ZONE_TAIL, 0)
    base = None
    for name, lay, _ in TIMESTAMP_LAYOUTS:
        hit = _naive(body, lay).isNotNull()
        base = F.when(hit, name) if base is None else base.when(hit, name)
    tail = F.when(zone == "", "").when(zone.contains(":") | (zone == "Z"), "_zone") \
        .when(F.startswith(zone, F.lit(" ")), "_space_offset").otherwise("_offset")
    name = F.concat(base, tail)
    return F.when(F.startswith(name, F.lit("us_ampm_")), None).otherwise(name)


def stamp_confidence(text, this_year: int) -> Column:
    """How sure the layout match is: x0.8 when the printed form has another length, x1.1 for an
    ISO-like prefix, x0.7 for a year before 2020 or after next year, x1.05 for a layout of a
    known source; at most 1."""
    known = [n for names in SOURCE_LAYOUTS.values() for n in names] + ["dash"]

    def score(r):
        t, ts, lay = r["t"], r["ts"], r["lay"]
        printed = None
        for name, _, out in TIMESTAMP_LAYOUTS:
            if out:
                p = F.length(F.date_format(ts.cast("timestamp"), out))
                printed = F.when(lay == name, p) if printed is None else printed.when(lay == name, p)
        x = F.when(F.coalesce(printed, F.length(t)) != F.length(t), 0.8).otherwise(1.0)
        x = x * F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), 1.1).otherwise(1.0)
        x = x * F.when((F.year(ts) < 2020) | (F.year(ts) > this_year + 1), 0.7).otherwise(1.0)
        x = x * F.when(lay.isin(known), 1.05).otherwise(1.0)
        return F.when(ts.isNotNull(), F.least(x, F.lit(1.0)))

    # one-element array: the parsed parts are worked out once and named inside the function
    parts = F.struct(clean_stamp(text).alias("t"), parse_stamp(text).alias("ts"), stamp_layout(text).alias("lay"))
    return F.get(F.transform(F.array(parts), score), F.lit(0))


def to_zone(text, zone: str = "Europe/Amsterdam") -> Column:
    """Wall clock in ``zone``: text with an offset is converted, text without one is taken as local."""
    t = clean_stamp(text)
    off = F.regexp_extract(t, r"([+-])(\d{2}):?(\d{2})$", 1)
    hh = F.regexp_extract(t, r"([+-])(\d{2}):?(\d{2})$", 2)
    mm = F.regexp_extract(t, r"([+-])(\d{2}):?(\d{2})$", 3)
    naive = parse_stamp(t)
    shift = F.make_dt_interval(F.lit(0), F.coalesce(hh.try_cast("int"), F.lit(0)),
                               F.coalesce(mm.try_cast("int"), F.lit(0)))
    utc = F.when(off == "+", naive - shift).when(off == "-", naive + shift).otherwise(naive)
    aware = (off != "") | t.endswith("Z")
    return F.when(aware, F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)).otherwise(naive)


def standard_form(ts) -> Column:
    return F.coalesce(F.date_format(_c(ts).cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def iso_form(ts) -> Column:
    return F.coalesce(F.date_format(_c(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
