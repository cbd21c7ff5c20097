"""Sessionisation against plain sequential models of the stated rules, on random event logs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import sequential as Q
from tallyloom.scale import cut_lineage
from tallyloom.operators import sessions as S

T0 = dt.datetime(2024, 3, 1)


def log(spark, seed, n=400, users=4, step=40):
    rnd, rows, t = random.Random(seed), [], {u: T0 for u in range(users)}
    for i in range(n):
        u = rnd.randrange(users)
        t[u] += dt.timedelta(minutes=rnd.choice([1, 2, 4, 7, 20, 35, step, 5 * step]), seconds=rnd.randrange(60))
        rows.append((u, t[u], i, rnd.choice(["7001", "7001", "6005", "6005", "7002", "1074"])))
    return rows, spark.createDataFrame(rows, "u long, ts timestamp_ntz, id long, code string").withColumn(
        "tag", F.when(F.col("code").isin("7001", "6005"), "logon").otherwise("logoff"))


def per_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def on(code):
    return code in ("7001", "6005")


def shadowed(ev, i, minutes=5):
    if ev[i][3] != "6005":
        return False
    for k in range(i + 1, min(i + 10, len(ev))):
        if (ev[k][1] - ev[i][1]).total_seconds() / 60 > minutes:
            return False
        if ev[k][3] == "7001":
            return True
    return False


def model_reboot(ev):
    out, i = [], 0
    while i < len(ev):
        if not on(ev[i][3]) or shadowed(ev, i):
            i += 1
            continue
        j, end = i + 1, None
        while j < len(ev):
            if not on(ev[j][3]):
                if j + 1 < len(ev) and on(ev[j + 1][3]) and (ev[j + 1][1] - ev[j][1]).total_seconds() <= 300:
                    j += 2
                    continue
                end = ev[j][1]
                break
            j += 1
        if end is None:
            i += 1
            continue
        out.append((ev[i][0], ev[i][2], ev[i][1], end))
        i = j + 1
    return out


def test_tagged_reboot_matches_sequential_model(spark):
    for seed in range(4):
        rows, df = log(spark, seed)
        want = sorted(x for ev in per_user(rows).values() for x in model_reboot(ev))
        got = S.tagged_reboot_sessions(df, "u", "ts", "id", "code", "tag").groupBy("key", "start_id").agg(
            F.min("start").alias("s"), F.max("end").alias("e")).collect()
        got = {(r.key, r.start_id): (r.s, r.e) for r in got}
        assert set(got) == {(u, i) for u, i, _, _ in want}
        for u, i, s, e in want:
            assert got[(u, i)][0] == s
            if e.date() <= s.date() + dt.timedelta(days=1):
                assert got[(u, i)][1] == e


def model_30min(ev):
    out, i = [], 0
    while i < len(ev):
        first = ev[i]
        if not on(first[3]) or shadowed(ev, i):
            i += 1
            continue
        at, j, end = first, i + 1, None
        while j < len(ev):
            if not on(ev[j][3]):
                end = ev[j]
                break
            if (ev[j][1] - at[1]).total_seconds() >= 1800:
                break
            if ev[j][3] == "7001" or first[3] != "7001":
                at = ev[j]
            j += 1
        if end and at[1].date() == end[1].date() and int((end[1] - at[1]).total_seconds() / 60) >= 5:
            out.append((first[0], first[2], at[1], end[1]))
            i = j + 1
        else:
            i += 1
    return out


def test_30min_merge_matches_sequential_model(spark):
    for seed in range(4):
        rows, df = log(spark, seed, step=25)
        want = sorted(x for ev in per_user(rows).values() for x in model_30min(ev))
        got = S.merged_logon_sessions(df, "u", "ts", "id", "code", "tag")
        assert sorted((r.key, r.start_id, r.start, r.end) for r in got.collect()) == want


def intervals(spark, seed, n=300, owners=3):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        s = T0 + dt.timedelta(seconds=rnd.randrange(0, 6 * 3600))
        rows.append((rnd.randrange(owners), i, s, s + dt.timedelta(seconds=rnd.choice([20, 60, 61, 300, 1500, 4000]))))
    return rows, spark.createDataFrame(rows, "o long, id long, start timestamp_ntz, end timestamp_ntz")


def model_deoverlap(rows):
    out = []
    for o in sorted({r[0] for r in rows}):
        last = None
        for _, i, s, e in sorted((r for r in rows if r[0] == o), key=lambda r: (r[2], r[1])):
            start = last + dt.timedelta(minutes=1) if last and s <= last else s
            if e > start:
                out.append((o, i, start, e))
                last = e
    return sorted(out)


def test_deoverlap_plain(spark):
    rows, df = intervals(spark, 1)
    got = sorted((r.key, r.sid, r.start, r.end) for r in Q.deoverlap(df, "o", "id").collect())
    assert got == model_deoverlap(rows)


def test_deoverlap_in_segments(spark, segments):
    for seed in (2, 3):
        rows, df = intervals(spark, seed, owners=2)
        got = sorted((r.key, r.sid, r.start, r.end) for r in Q.deoverlap(df, "o", "id").collect())
        assert got == model_deoverlap(rows)


def test_transfer_table_equals_step_by_step():
    rnd = random.Random(5)
    for _ in range(300):
        ss = sorted(rnd.randrange(200) for _ in range(rnd.randrange(1, 12)))
        es = [s + rnd.randrange(1, 60) for s in ss]
        t = Q._transfer(ss, es, 5)
        for entry in range(-5, 270, 3):
            end = entry
            for s, e in zip(ss, es):
                start = end + 5 if s <= end else s
                if e > start:
                    end = e
            assert Q._apply(t, entry) == end


def test_extend_or_join_matches_sequential_model(spark):
    rnd = random.Random(9)
    rows, t = [], T0
    for i in range(120):
        t += dt.timedelta(minutes=rnd.choice([2, 10, 40]))
        e = t + dt.timedelta(minutes=rnd.choice([1, 5, 29, 30, 50]))
        rows.append((1, i, t, e))
        t = e
    want, i = [], 0
    while i < len(rows):
        _, sid, s, e = rows[i]
        if (e - s).total_seconds() < 1800:
            e2 = s + dt.timedelta(minutes=30)
            if i + 1 < len(rows) and e2 > rows[i + 1][2]:
                e2 = rows[i + 1][3]
                i += 1
            e = e2
        want.append((sid, s, e))
        i += 1
    df = spark.createDataFrame(rows, "k long, id long, start timestamp_ntz, end timestamp_ntz")
    got = S.extend_or_join(df, "k", "id").orderBy("start").collect()
    assert [(r.sid, r.start, r.end) for r in got] == want


def test_pairwise_merge_of_a_chain_of_four_gives_two(spark):
    rows = [(1, i, T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i, minutes=30), False) for i in range(4)]
    df = spark.createDataFrame(rows, "key long, start_id long, start timestamp_ntz, end timestamp_ntz, crosses boolean")
    assert S.merge_breaks(df, mode="pairwise").count() == 2
    assert S.merge_breaks(df).count() == 1


def test_rows_matching_both_patterns_are_set_aside(spark):
    df = spark.createDataFrame([(1, T0, 1, "a"), (1, T0 + dt.timedelta(hours=1), 2, "ab"), (1, T0 + dt.timedelta(hours=2), 3, "b")],
                               "k long, ts timestamp_ntz, id long, m string")
    a, b = F.col("m").contains("a"), F.col("m").contains("b")
    assert S.ambiguous_rows(df, a, b).count() == 1
    r = S.toggle_sessions(df, "k", "ts", "id", a, b).collect()
    assert [(x.start_id, x.duration_minutes, x.is_open) for x in r] == [(1, 120, False)]


def test_midnight_split_keeps_or_drops_days_between(spark):
    df = spark.createDataFrame([(1, T0 + dt.timedelta(hours=20), T0 + dt.timedelta(days=2, hours=3))], "id long, start timestamp_ntz, end timestamp_ntz")
    assert S.split_midnight(df).count() == 3
    two = S.split_midnight(df, keep_between=False).orderBy("part").collect()
    assert [str(r.end) for r in two] == ["2024-03-01 23:59:59", "2024-03-03 03:00:00"] and str(two[1].start) == "2024-03-03 00:00:00"


def test_budgeted_assignment_matches_sequential_model(spark):
    rnd, rows = random.Random(3), []
    for i in range(80):
        s = T0 + dt.timedelta(hours=5 * i)
        rows.append((i % 2, i, s, s + dt.timedelta(hours=rnd.choice([1, 2, 4])), rnd.choice([None, None, "b", "c"])))
    cat = [("a", 4.0), ("b", 3.0), ("c", 0.0)]
    want = []
    for o in (0, 1):
        now, used = "a", 0.0
        for _, i, s, e, hint in (r for r in rows if r[0] == o):
            if hint and hint != now:
                now, used = hint, 0.0
            if dict(cat)[now] > 0 and used >= dict(cat)[now] * 1.5:
                now, used = cat[([n for n, _ in cat].index(now) + 1) % 3][0], 0.0
            used += (e - s).total_seconds() / 3600
            want.append((o, i, now, used))
    df = spark.createDataFrame(rows, "o long, id long, start timestamp_ntz, end timestamp_ntz, hint string")
    got = Q.budgeted_assignment(df, "o", "id", cat, "hint").collect()
    assert sorted((r.owner, r.sid, r.sub_activity, r.cumulative_hours) for r in got) == sorted(want)


def test_budget_tables_equal_step_by_step():
    rnd = random.Random(6)
    for _ in range(400):
        machine = Q._Budgets([("abcd"[i], rnd.choice([0.0, 1.0, 2.0, 5.0])) for i in range(rnd.randrange(1, 5))], 1.5)
        hour = 3_600_000_000
        parts = [[(rnd.choice([-1, -1, -1, rnd.randrange(len(machine.names))]), rnd.choice([0, hour // 2, hour, 3 * hour])) for _ in range(rnd.randrange(1, 9))] for _ in range(3)]
        tables = [machine.table([h for h, _ in p], [w for _, w in p]) for p in parts]
        whole = machine.then(machine.then(tables[0], tables[1]), tables[2])
        for now in range(len(machine.names)):
            for used in range(0, 10 * hour, hour // 2):
                state = by_table = (now, used)
                for p, t in zip(parts, tables):
                    for h, w in p:
                        state = machine.step(*state, h, w)
                    by_table = machine.apply(t, by_table)
                    assert by_table == state
                assert machine.apply(whole, (now, used)) == state


def test_combined_transfer_tables_equal_step_by_step():
    rnd = random.Random(8)
    for _ in range(300):
        ss = sorted(rnd.randrange(200) for _ in range(12))
        es = [s + rnd.randrange(1, 60) for s in ss]
        cuts = sorted(rnd.sample(range(1, 12), 2))
        parts = [Q._transfer(ss[i:j], es[i:j], 5) for i, j in zip([0, *cuts], [*cuts, 12])]
        whole, other = Q._then(Q._then(*parts[:2]), parts[2]), Q._then(parts[0], Q._then(*parts[1:]))
        plain = Q._transfer(ss, es, 5)
        for entry in range(-5, 270, 3):
            assert Q._apply(whole, entry) == Q._apply(other, entry) == Q._apply(plain, entry)


@pytest.mark.parametrize("fan", [2, 5])
def test_a_tree_over_many_segments_equals_a_fold(spark, fan):
    """200 segments of one key: the entries of a tree with ``fan`` tables a group equal a plain fold."""
    import pickle

    from tallyloom.operators.segments import entry_states

    tables = [(k, s, pickle.dumps([(s, k)])) for k, n in ((1, 200), (2, 3), (None, 1)) for s in range(n)]
    df = spark.createDataFrame(tables, "key long, seg int, t binary")

    got = entry_states(df, lambda a, b: a + b, lambda t, s: s + t, [], fan).collect()
    assert {(r.key, r.seg): pickle.loads(r.entry) for r in got} == {(k, s): [(i, k) for i in range(s)] for k, s, _ in tables}


def test_budgeted_assignment_of_a_hot_owner_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(Q, "segmented", lambda df, keys, order: cut_lineage(
        df.repartitionByRange(23, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("seg", F.spark_partition_id())))
    rnd, rows, cat = random.Random(5), [], [("a", 4.0), ("b", 3.0), ("c", 0.0), ("d", 7.5)]
    for i in range(600):
        s = T0 + dt.timedelta(hours=5 * i)
        rows.append((1 if i % 4 else None, i, s, s + dt.timedelta(minutes=rnd.choice([0, 30, 60, 240])), rnd.choice([None] * 9 + ["b", "c", "x", ""])))
    want = []
    for o in (None, 1):
        now, used = 0, 0
        for _, i, s, e, hint in (r for r in rows if r[0] == o):
            names = [n for n, _ in cat]
            if hint in names and hint != names[now]:
                now, used = names.index(hint), 0
            if cat[now][1] > 0 and used >= cat[now][1] * 1.5 * 60:
                now, used = (now + 1) % 4, 0
            used += (e - s).total_seconds() / 60
            want.append((o, i, names[now], used / 60))
    df = spark.createDataFrame(rows, "o long, id long, start timestamp_ntz, end timestamp_ntz, hint string")
    got = Q.budgeted_assignment(df, "o", "id", cat, "hint").collect()
    assert sorted(((r.owner, r.sid, r.sub_activity, round(r.cumulative_hours, 9)) for r in got), key=repr) == sorted(((*w[:3], round(w[3], 9)) for w in want), key=repr)
    assert Q.budgeted_assignment(df.filter("id < 0"), "o", "id", cat, "hint").count() == 0
