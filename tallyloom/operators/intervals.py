"""Interval joins as plain equi-joins.

Each interval is cut into aligned blocks of a few fixed sizes, from a second to 512 days (few
blocks, however long the interval), and each point names the one block per size that holds it.  A point
meets an interval in exactly one block, so the join emits true matches only, never
the pairs of a whole bucket.  Parts shorter than a whole second go through one extra level with the exact test.

Only the distinct (time, keys) of the points are looked up, and only on the sizes that the intervals
use; what was found joins the points once, so their other columns are never repeated and equal points
all keep their answer.  Blocks of six hours and more, which many points share, are dealt to
several tasks: the few rows of their intervals are repeated, the points are split by a hash.

``stab_join`` with keys does so for those keys alone that have more than ``_CROWD`` times.  The intervals of other keys take
one size, the smallest that is longer than they are, so one or two blocks, and the exact test follows: what a block holds
beyond true matches is at most ``_CROWD`` times for an interval.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import hours_between, micros
from ..scale import Ordered, ahead, running

_TICK = 1_000_000
# Block sizes in seconds; each divides the next, and hours and days are among them, so intervals
# with round ends need very few blocks.
_SIZES = [1, 10, 60, 600, 3_600, 21_600, 86_400, 8 * 86_400, 64 * 86_400, 512 * 86_400]
_LEVELS = len(_SIZES)


_FAN = {21_600: 16, 86_400: 32, 8 * 86_400: 64, 64 * 86_400: 64, 512 * 86_400: 64}  # tasks that share a block

_CROWD = 4096  # times of one key that are looked up in one block each interval

# (level, size in microseconds, how many fit in the next size; 0 for the largest, tasks)
_TABLE = "array(" + ", ".join(
    f"struct({k} as level, {_TICK * n}L as size, {(_SIZES[k + 1] // n) if k + 1 < _LEVELS else 0}L as up, {_FAN.get(n, 1)} as fan)"
    for k, n in enumerate(_SIZES)) + ")"
_EDGES = f"array(struct(-1 as level, {_TICK}L as size, 0L as up, 1 as fan))"  # parts shorter than the smallest block


def _fdiv(x: str, n: str) -> str:
    return f"(({x}) - pmod({x}, {n})) div {n}"


def _seq(lo: str, hi: str) -> str:
    """[lo, hi) as an array."""
    return f"if({lo} < {hi}, sequence({lo}, {hi} - 1L), cast(array() as array<bigint>))"


def _cover(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row per (interval, level, block): on each level the blocks inside the interval that the
    next larger size does not cover; where ``__crowd`` is false, the blocks of one size that hold the interval."""
    d = df.withColumn("__s", micros(start)).withColumn("__e", micros(end)).filter("__s <= __e")
    d = d.withColumn("__l", F.explode(F.expr(f"if(__crowd, concat({_EDGES}, {_TABLE}), slice(filter({_TABLE}, l -> l.size > __e - __s OR l.up = 0), 1, 1))")))
    d = d.withColumn("__level", F.col("__l.level")).withColumn("__size", F.col("__l.size")).withColumn("__up", F.col("__l.up")) \
        .withColumn("__fan", F.col("__l.fan"))
    big = "__size * greatest(__up, 1L)"
    d = d.withColumn("__lo", F.expr(_fdiv("__s + __size - 1L", "__size"))).withColumn("__hi", F.expr(_fdiv("__e + 1L", "__size")))
    d = d.withColumn("__lo2", F.expr(f"({_fdiv(f'__s + {big} - 1L', f'({big})')}) * __up")) \
        .withColumn("__hi2", F.expr(f"({_fdiv('__e + 1L', f'({big})')}) * __up"))
    head = f"if(pmod(__s, __size) != 0, {_fdiv('__s', '__size')}, null)"
    tail = f"if(pmod(__e + 1L, __size) != 0, {_fdiv('__e', '__size')}, null)"
    blocks = (f"case when not __crowd then sequence({_fdiv('__s', '__size')}, {_fdiv('__e', '__size')}) when __level < 0 then array_distinct(array_compact(array({head}, {tail}))) "
              f"when __up = 0 or __lo2 >= __hi2 then {_seq('__lo', '__hi')} "
              f"else concat({_seq('__lo', '__lo2')}, {_seq('__hi2', '__hi')}) end")
    return d.withColumn("__block", F.explode(F.expr(blocks))).drop("__s", "__e", "__l", "__size", "__up", "__lo", "__hi", "__lo2", "__hi2")


def _dealt(cover: DataFrame) -> DataFrame:
    """Blocks that several tasks share, once for each."""
    return cover.withColumn("__part", F.explode(F.expr("sequence(0, if(__crowd, __fan, 1) - 1)"))).drop("__fan", "__crowd")


def _asked(points: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """The distinct times (and keys) of the points, under names of their own."""
    return points.filter(F.col(ts).isNotNull()).select(F.col(ts).alias("__ts"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()


def _crowded(asked: DataFrame, keys: int) -> DataFrame:
    """The keys with more than ``_CROWD`` times, at most one in ``_CROWD`` rows, so the list of them is broadcast."""
    names = [f"__k{i}" for i in range(keys)]
    n = asked.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > _CROWD)
    return F.broadcast(n.select(*[F.col(k).alias(f"__c{k}") for k in names], F.lit(True).alias("__is")))


def _marked(df: DataFrame, keys: list[str], crowded: DataFrame | None) -> DataFrame:
    """``df`` with ``__crowd``; without keys all is crowded."""
    if crowded is None:
        return df.withColumn("__crowd", F.lit(True))
    cond = [F.col(k) == F.col(f"__c__k{i}") for i, k in enumerate(keys)]
    return df.join(crowded, reduce(lambda a, b: a & b, cond), "left").select(*[df[c] for c in df.columns], F.coalesce("__is", F.lit(False)).alias("__crowd"))


def _probe(asked: DataFrame, cover: DataFrame) -> DataFrame:
    """One row per time and size in use (at most eleven sizes, so the list of them is broadcast)."""
    names = [c for c in asked.columns if c != "__crowd"]
    used = F.broadcast(cover.select(F.col("__level").alias("__plevel"), "__crowd").distinct())
    d = asked.withColumn("__t", micros(F.col("__ts"))).withColumn("__l", F.explode(F.expr(f"concat({_EDGES}, {_TABLE})")))
    d = d.withColumn("__plevel", F.col("__l.level")).join(used, ["__plevel", "__crowd"], "left_semi")
    return d.select(*names, "__plevel", F.expr(_fdiv("__t", "__l.size")).alias("__pblock"),
                    F.pmod(F.xxhash64(*names), F.expr("if(__crowd, __l.fan, 1)").cast("long")).cast("int").alias("__ppart"))


def _meet(pt: DataFrame, iv: DataFrame, exact: Column, keys: list[str]) -> DataFrame:
    cond = [F.col("__plevel") == F.col("__level"), F.col("__pblock") == F.col("__block"), F.col("__ppart") == F.col("__part"), exact]
    cond += [F.col(f"__k{i}") == F.col(k) for i, k in enumerate(keys)]
    return pt.join(iv, reduce(lambda a, b: a & b, cond))


def _answered(points: DataFrame, found: DataFrame, ts: str, keys: list[str], how: str = "inner") -> DataFrame:
    cond = [F.col(ts) == F.col("__ts")] + [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    return points.join(found, reduce(lambda a, b: a & b, cond), how).drop("__ts", *[f"__k{i}" for i in range(len(keys))])


def stab_join(points: DataFrame, intervals: DataFrame, ts: str, start: str, end: str,
              keys: list[tuple[str, str]] = (), before: str | None = None, after: str | None = None) -> DataFrame:
    """All (point, interval) pairs with start <= ts <= end and equal keys.

    ``before``/``after`` widen the interval (e.g. "'5' MINUTE").  Column names must differ
    between the two sides.
    """
    s, e = F.col(start), F.col(end)
    if before:
        s = s - F.expr(f"INTERVAL {before}")
    if after:
        e = e + F.expr(f"INTERVAL {after}")
    pkeys, ikeys = [a for a, _ in keys], [b for _, b in keys]
    asked = _asked(points, ts, pkeys)
    crowded = _crowded(asked, len(pkeys)) if pkeys else None
    cover = _cover(_marked(intervals.withColumn("__from", s).withColumn("__to", e), ikeys, crowded), F.col("__from"), F.col("__to"))
    pt, iv = _probe(_marked(asked, [f"__k{i}" for i in range(len(pkeys))], crowded), cover), _dealt(cover)
    met = _meet(pt, iv, F.col("__ts").between(F.col("__from"), F.col("__to")), ikeys)
    found = met.select("__ts", *[f"__k{i}" for i in range(len(keys))], *intervals.columns)
    return _answered(points, found, ts, pkeys)


def longest_cover(points: DataFrame, sessions: DataFrame, ts: str, start: str, end: str,
                  payload: list[str], keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Left join of each point with the longest interval that holds it (ties: earliest start).

    Whole blocks keep only their best interval before the join, so the work does not grow
    with the number of intervals open at the same time.  Equal points each keep a row.
    """
    pkeys, ikeys = [a for a, _ in keys], [b for _, b in keys]
    best = F.struct((-hours_between(start, end)).alias("d"), F.col(start).alias("s"), F.struct(*payload).alias("p"))
    cover = _cover(_marked(sessions.select(*ikeys, best.alias("__best"), F.col(start).alias("__from"), F.col(end).alias("__to")), ikeys, None),
                   F.col("__from"), F.col("__to"))
    whole = cover.filter("__level >= 0").groupBy(*ikeys, "__level", "__block", "__fan", "__crowd").agg(F.min("__best").alias("__best"))
    none = F.expr("cast(null as timestamp_ntz)")
    iv = _dealt(whole.withColumn("__from", none).withColumn("__to", none).unionByName(cover.filter("__level < 0")))
    pt = _probe(_marked(_asked(points, ts, pkeys), [], None), cover)
    met = _meet(pt, iv, F.col("__from").isNull() | F.col("__ts").between(F.col("__from"), F.col("__to")), ikeys)
    found = met.groupBy("__ts", *[f"__k{i}" for i in range(len(keys))]).agg(F.min("__best").alias("__best"))
    out = _answered(points, found, ts, pkeys, "left")
    return out.select(*[F.col(c) for c in points.columns], *[F.col(f"__best.p.{c}").alias(c) for c in payload])


def overlap_join(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str,
                 keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs with max(start) < min(end): one of the two starts lies inside the other interval."""
    left, right = left.filter(F.col(ls) < F.col(le)), right.filter(F.col(rs) < F.col(re))
    a = stab_join(right, left, rs, ls, le, [(b, a) for a, b in keys]).filter(F.col(rs) < F.col(le))
    b = stab_join(left, right, ls, rs, re, keys).filter((F.col(ls) > F.col(rs)) & (F.col(ls) < F.col(re)))
    cols = left.columns + right.columns
    return a.select(cols).unionByName(b.select(cols))


def first_then_adjacent(points: DataFrame, sessions: DataFrame, key: str, ts: str, pid: str,
                        start: str, end: str, sid: str) -> DataFrame:
    """(point, session, pass) rows: the first session by start that holds the point; a point in
    none goes to both the session that ended last before it and the one that starts next."""
    pts = points.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(pid).alias("pid"))
    ses = sessions.select(F.col(key).alias("sk"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(sid).alias("sid"))
    hit = stab_join(pts, ses, "t", "s", "e", [("k", "sk")]) \
        .groupBy("k", "t", "pid").agg(F.min(F.struct("s", "sid")).alias("f")) \
        .select("k", "t", "pid", F.col("f.sid").alias("sid"), F.lit("inside").alias("how"))
    left = pts.join(hit.select("pid"), "pid", "left_anti")
    lane = "cast(null as struct<x:timestamp_ntz,sid:bigint>)"
    tagged = left.select("k", "t", F.lit(1).alias("o"), "pid", F.expr(lane).alias("ended"), F.expr(lane).alias("starts")) \
        .unionByName(ses.select(F.col("sk").alias("k"), F.col("e").alias("t"), F.lit(2).alias("o"), F.col("sid").alias("pid"),
                                F.struct(F.col("e").alias("x"), "sid").alias("ended"), F.expr(lane).alias("starts"))) \
        .unionByName(ses.select(F.col("sk").alias("k"), F.col("s").alias("t"), F.lit(0).alias("o"), F.col("sid").alias("pid"),
                                F.expr(lane).alias("ended"), F.struct(F.col("s").alias("x"), "sid").alias("starts")))
    o = Ordered(tagged, ["k"], ["t", "o", "pid"]).add(
        back=running("last", "ended", include=False), fwd=ahead("last", "starts")).filter("o = 1").rows()
    near = o.select("k", "t", "pid", F.explode(F.array(
        F.struct(F.col("back.sid").alias("sid"), F.lit("previous").alias("how")),
        F.struct(F.col("fwd.sid").alias("sid"), F.lit("next").alias("how")))).alias("n")) \
        .select("k", "t", "pid", "n.sid", "n.how").filter("sid is not null")
    return hit.unionByName(near)
