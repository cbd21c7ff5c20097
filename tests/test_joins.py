import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import intervals as I
from tallyloom.operators import joins as J

T0 = dt.datetime(2024, 3, 1)


def us(n):
    return dt.timedelta(microseconds=n)


def random_case(seed, n=120):
    rnd = random.Random(seed)
    iv, pts = [], []
    for i in range(n):
        s = T0 + us(rnd.randrange(0, 5_000_000_000))
        iv.append((i, i % 3, s, s + us(rnd.choice([0, 1, 999_999, 1_000_000, 7_500_000, 64_000_000, 3_000_000_000, 90_000_000_000]))))
    for i in range(n):
        base = rnd.choice(iv)
        t = rnd.choice([base[2], base[3], base[2] - us(1), base[3] + us(1), T0 + us(rnd.randrange(0, 6_000_000_000))])
        pts.append((i, i % 3, t))
    return iv, pts


def frames(spark, iv, pts):
    return (spark.createDataFrame(iv, "sid long, k long, s timestamp_ntz, e timestamp_ntz"),
            spark.createDataFrame(pts, "pid long, pk long, t timestamp_ntz"))


def test_stab_join_is_exact_at_every_boundary(spark):
    for seed in range(3):
        iv, pts = random_case(seed)
        a, b = frames(spark, iv, pts)
        got = sorted((r.pid, r.sid) for r in I.stab_join(b, a, "t", "s", "e").collect())
        assert got == sorted((p, i) for p, _, t in pts for i, _, s, e in iv if s <= t <= e)
        keyed = sorted((r.pid, r.sid) for r in I.stab_join(b, a, "t", "s", "e", [("pk", "k")]).collect())
        assert keyed == sorted((p, i) for p, pk, t in pts for i, k, s, e in iv if s <= t <= e and k == pk)


def test_longest_cover_picks_longest_then_earliest(spark):
    iv, pts = random_case(7)
    a, b = frames(spark, iv, pts)
    got = {r.pid: r.sid for r in I.longest_cover(b, a, "t", "s", "e", ["sid"]).collect()}
    for p, _, t in pts:
        c = sorted((-(e - s), s, i) for i, _, s, e in iv if s <= t <= e)
        assert got[p] == (c[0][2] if c else None)


def test_overlap_join_is_strict(spark):
    iv, _ = random_case(11, 80)
    a = spark.createDataFrame(iv, "sid long, k long, s timestamp_ntz, e timestamp_ntz")
    b = a.select(*[F.col(c).alias("x" + c) for c in a.columns])
    got = sorted((r.sid, r.xsid) for r in I.overlap_join(a, b, "s", "e", "xs", "xe").collect())
    ok = [r for r in iv if r[2] < r[3]]
    assert got == sorted((p[0], q[0]) for p in ok for q in ok if max(p[2], q[2]) < min(p[3], q[3]))


def test_touching_intervals_do_not_overlap(spark):
    h = dt.timedelta(hours=1)
    a = spark.createDataFrame([(1, T0, T0 + h), (2, T0 + h, T0 + 2 * h)], "id long, start timestamp_ntz, end timestamp_ntz")
    assert J.overlap_pairs(a, "id", "start", "end").count() == 0


def test_upload_plan_counts_only_accepted_rows_as_seen(spark):
    h = dt.timedelta(hours=1)
    rnd = random.Random(1)
    rows = [(i, f"id{rnd.randrange(12)}", T0 + h * rnd.randrange(12), ) for i in range(60)]
    rows = [(o, s, t, t + h) for o, s, t in rows]
    old = [("id3", T0 + 40 * h, T0 + 41 * h), ("zz", T0 + 5 * h, T0 + 6 * h)]
    seen_id, seen_r, want = set(), set(), []
    for o, s, a, b in rows:
        if s in {x[0] for x in old}:
            want.append((o, "id_exists"))
        elif s in seen_id:
            want.append((o, "id_repeated"))
        elif (a, b) in {x[1:] for x in old}:
            want.append((o, "range_exists"))
        elif (a, b) in seen_r:
            want.append((o, "range_repeated"))
        else:
            seen_id.add(s)
            seen_r.add((a, b))
            want.append((o, "accepted"))
    sch = "id string, start timestamp_ntz, end timestamp_ntz"
    got = J.upload_plan(spark.createDataFrame(rows, "o long, " + sch), spark.createDataFrame(old, sch), "id", "start", "end", "o")
    assert sorted((r.o, r.status) for r in got.collect()) == want


def _plan(rows):
    ids, ranges, out = set(), set(), {}
    for o, i, r in sorted(rows):
        out[o] = "id_repeated" if i in ids else "range_repeated" if r in ranges else "accepted"
        if out[o] == "accepted":
            ids.add(i)
            ranges.add(r)
    return out


def _planned(spark, rows, **settings):
    h = dt.timedelta(hours=1)
    sch = "id long, start timestamp_ntz, end timestamp_ntz"
    df = spark.createDataFrame([(o, i, T0 + h * r, T0 + h * r + h) for o, i, r in rows], "o long, " + sch)
    return {r.o: r.status for r in J.upload_plan(df, spark.createDataFrame([], sch), "id", "start", "end", "o", **settings).collect()}


@pytest.mark.parametrize("settings", [{}, {"rounds": 0}, {"rounds": 1, "cluster_rows": 6}])
def test_upload_plan_of_random_clusters(spark, settings):
    rnd = random.Random(7)
    rows = [(o, rnd.randrange(50), rnd.randrange(50)) for o in range(110)]
    assert _planned(spark, rows, **settings) == _plan(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each row shares its id with the one before and its range with the one after, so every fate hangs on all before it."""
    count, cut = [0], J.cut_lineage
    monkeypatch.setattr(J, "cut_lineage", lambda df: (count.__setitem__(0, count[0] + 1), cut(df))[1])
    taken = {}
    for n in (10, 10_000):
        rows = [(o, o // 2, (o + 1) // 2) for o in range(n)]
        count[0] = 0
        assert _planned(spark, rows) == _plan(rows)
        taken[n] = count[0]
    assert taken[10_000] <= taken[10] + 2 * 12  # two a round, rounds by the logarithm; one by one it would be ten thousand


def test_conflicts_give_one_row_per_session_at_every_size(spark):
    s = spark.createDataFrame([(1,), (2,)], "sid long")
    c = spark.createDataFrame([(1, i) for i in range(2500)], "sid long, x long")
    assert sorted(J.conflict_annotate(s, c, "sid").collect()) == [(1, 2500, True), (2, 0, False)]
    rows = J.conflict_rows(c, "sid", ["x"]).collect()
    assert sorted(r.conflict for r in rows) == sorted(f'{{"x":{i}}}' for i in range(2500))


def test_equal_points_all_keep_their_answer(spark):
    h = dt.timedelta(hours=1)
    ses = spark.createDataFrame([(1, 0, T0, T0 + 30 * h), (2, 0, T0, T0 + h)], "sid long, k long, s timestamp_ntz, e timestamp_ntz")
    pts = spark.createDataFrame([(T0 + h / 2, "x")] * 3 + [(T0 + 40 * h, "y")] * 2 + [(None, "z")], "t timestamp_ntz, w string")
    got = I.longest_cover(pts, ses, "t", "s", "e", ["sid"]).collect()
    assert sorted((r.w, r.sid or 0) for r in got) == [("x", 1)] * 3 + [("y", 0)] * 2 + [("z", 0)]
    assert I.stab_join(pts, ses, "t", "s", "e").count() == 6


def test_long_intervals_are_dealt_to_several_tasks(spark):
    d = dt.timedelta(days=1)
    iv = [(k, T0 - (3 * k + 1) * d, T0 + 200 * k * d) for k in range(8)]
    pts = [(k, T0 + k * d / 3) for k in range(300)]
    a = spark.createDataFrame(iv, "sid long, s timestamp_ntz, e timestamp_ntz")
    b = spark.createDataFrame(pts, "pid long, t timestamp_ntz")
    got = sorted((r.pid, r.sid) for r in I.stab_join(b, a, "t", "s", "e").collect())
    assert got == sorted((p, i) for p, t in pts for i, s, e in iv if s <= t <= e)


def test_overlap_pairs_finds_each_pair_once(spark):
    iv, _ = random_case(5, 60)
    iv += [(100, 0, *iv[0][2:]), (101, 0, *iv[0][2:])]
    a = spark.createDataFrame(iv, "sid long, k long, s timestamp_ntz, e timestamp_ntz")
    got = sorted((r.a_sid, r.b_sid) for r in J.overlap_pairs(a, "sid", "s", "e").collect())
    ok = [r for r in iv if r[2] < r[3]]
    assert got == sorted((p[0], q[0]) for p in ok for q in ok if p[0] < q[0] and max(p[2], q[2]) < min(p[3], q[3]))


def test_same_day_join_stops_at_midnight(spark):
    h = dt.timedelta(hours=1)
    ses = spark.createDataFrame([(1, T0 + 20 * h, T0 + 30 * h)], "sid long, s timestamp_ntz, e timestamp_ntz")
    pts = spark.createDataFrame([(k, T0 + k * h) for k in range(40)] + [(99, T0 + 24 * h - us(1))], "pid long, t timestamp_ntz")
    assert sorted(r.pid for r in J.same_day_join(pts, ses, "t", "s", "e").collect()) == [20, 21, 22, 23, 99]
