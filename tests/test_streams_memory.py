import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import memory as M
from tallyloom.operators import rates as R
from tallyloom.scale import scratch_dir
from tallyloom.streaming import jobs as J

T0 = dt.datetime(2024, 3, 1)


def batches(spark, parts, schema):
    """A stream that delivers one part per micro-batch."""
    d = scratch_dir(spark, "in")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/b={i}")
    files = [r.f for r in spark.read.parquet(d).select(F.col("_metadata.file_path").alias("f")).distinct().collect()]
    assert len(files) == len(parts)
    sch = spark.read.parquet(f"{d}/b=0").schema
    return spark.readStream.schema(sch).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(d)


EV = "id long, k long, ts timestamp, kind string"


def at(m):
    return T0 + dt.timedelta(minutes=m)


def test_toggle_sessions_survive_batch_borders(spark):
    s = batches(spark, [[(1, 1, at(0), "on"), (2, 2, at(1), "off")], [(3, 1, at(5), "on"), (4, 1, at(9), "off")], [(5, 2, at(10), "on"), (6, 2, at(12), "off")],
                        [(7, 9, at(100), "off")]], EV)
    r = J.run_to_table(J.toggle_sessions(s, "k", "ts", "id", F.col("kind") == "on", F.col("kind") == "off"), scratch_dir(spark, "t"), store=J.ROCKS).collect()
    assert sorted((x.key, x.start_id, (x.end_us - x.start_us) // 60_000_000) for x in r) == [(1, 1, 9), (2, 5, 2)]


def _couples(rows, passed, by_day, idle):
    """Sessions of (id, key, time, kind) rows up to the watermark, as one loop over each key."""
    out = []
    for k in {r[1] for r in rows}:
        opened = None
        for i, _, t, kind in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            if t > passed:
                break
            if opened and ((by_day and t.date() > opened[1].date()) or (idle and t - opened[2] >= idle)):
                out.append((k, opened[0], opened[1], dt.datetime.combine(opened[1], dt.time(23, 59, 59)) if by_day else opened[2], True))
                opened = None
            if opened and kind == "off":
                out.append((k, opened[0], opened[1], t, False))
                opened = None
            elif opened:
                opened = (opened[0], opened[1], t if idle or kind != "noise" else opened[2])
            elif kind == "on":
                opened = (i, t, t)
        if opened and by_day and dt.datetime.combine(opened[1], dt.time()) + dt.timedelta(days=1) <= passed:
            out.append((k, opened[0], opened[1], dt.datetime.combine(opened[1], dt.time(23, 59, 59)), True))
        elif opened and idle and opened[2] + idle <= passed:
            out.append((k, opened[0], opened[1], opened[2], True))
    return sorted(out)


@pytest.mark.parametrize("by_day,idle", [(True, None), (False, 7200), (False, None)])
@pytest.mark.parametrize("parts", [1, 5])
def test_couples_do_not_depend_on_micro_batches(spark, by_day, idle, parts):
    rng = random.Random(4)
    rows = sorted(((i, rng.randrange(4), at(rng.randrange(4 * 1440)), rng.choice(["on", "off", "noise"])) for i in range(160)), key=lambda r: r[2])
    # out of order by less than the delay of an hour, across files
    rows.sort(key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(59)))
    end = (900, 77, at(9 * 1440), "off")
    step = -(-len(rows) // parts)
    files = [rows[i:i + step] for i in range(0, len(rows), step)] + [[end]]
    s = batches(spark, files if parts > 1 else [rows + [end]], EV)
    out = scratch_dir(spark, "c")
    got = J.run_to_table(J.couples(s, "k", "ts", "id", F.col("kind") == "on", F.col("kind") == "off", "1 hour", by_day, idle), out, store=J.ROCKS).collect()
    day0 = dt.datetime(1970, 1, 1)
    assert sorted((r.key, r.start_id, day0 + dt.timedelta(microseconds=r.start_us), day0 + dt.timedelta(microseconds=r.end_us), r.is_open) for r in got) \
        == _couples(rows, end[2] - dt.timedelta(hours=1), by_day, idle and dt.timedelta(seconds=idle))
    state = spark.read.format("statestore").option("path", f"{out}/progress")
    open_keys = {r.key.key for r in state.option("stateVarName", "opened").load().select("key").collect()}
    assert {r.key.key for r in state.option("stateVarName", "waiting").load().select("key").collect()} == {77}  # younger than the watermark
    assert not open_keys if by_day or idle else open_keys <= {0, 1, 2, 3}


def _admitted(rows, limit, seconds):
    out = {}
    for k in {r[1] for r in rows}:
        kept = []
        for i, _, t, _ in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            kept = [x for x in kept if x > t - dt.timedelta(seconds=seconds)]
            out[i] = len(kept) < limit
            if out[i]:
                kept.append(t)
    return out


def test_trailing_counts_over_many_slices(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), T0 + dt.timedelta(seconds=rng.randrange(4000)), "x") for i in range(400)]
    got = {r.id: (r.in_window, r.over_limit) for r in R.over_limit(spark.createDataFrame(rows + [(900, 1, None, "x")], EV), "k", "ts", "id", 4).collect()}
    for i, k, t, _ in rows:
        n = sum(k == k2 and t - dt.timedelta(seconds=60) <= t2 <= t for _, k2, t2, _ in rows)
        assert got[i] == (n, n > 4)
    assert len(got) == 401


@pytest.mark.parametrize("parts", [1, 4])
def test_only_admitted_events_count_against_the_limit(spark, parts):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), T0 + dt.timedelta(seconds=rng.randrange(1500)), "x") for i in range(150)]
    rows.sort(key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(590)))
    end, step = (900, 9, at(600), "x"), -(-len(rows) // parts)
    files = [rows[i:i + step] for i in range(0, len(rows), step)] + [[end]]
    s = batches(spark, files if parts > 1 else [rows + [end]], EV)
    out = scratch_dir(spark, "r")
    r = J.run_to_table(J.rate_limit(s, "k", "ts", "id", 2), out, store=J.ROCKS).collect()
    assert {x.rid: x.admitted for x in r} == _admitted(rows, 2, 60) and len(r) == len(rows)
    state = spark.read.format("statestore").option("path", f"{out}/progress")
    assert state.option("stateVarName", "kept").load().count() == 0  # the window of the last one is over
    assert {x.key.key for x in state.option("stateVarName", "waiting").load().select("key").collect()} == {9}


@pytest.mark.parametrize("limit", [1, 3, 7])
def test_admission_over_stored_rows_equals_a_loop(spark, segments, limit):
    """A key of half the rows, calm and crowded stretches, equal times."""
    rng, rows, t = random.Random(limit), [], 0
    for i in range(900):
        t += rng.choice([0, 1, 5, 20]) if (i // 90) % 3 else rng.choice([20, 60, 61, 200])
        rows.append((i, rng.choice([1, 1, 1, 2, 3]), T0 + dt.timedelta(seconds=t), "x"))
    df = spark.createDataFrame(rows + [(5000, None, T0, "x"), (5001, 1, None, "x")], EV).repartition(6)
    got = {r.id: r.admitted for r in R.admitted(df, "k", "ts", "id", limit).collect()}
    assert got == {**_admitted(rows, limit, 60), 5000: True, 5001: True}
    assert R.admitted(df.filter("id < 0"), "k", "ts", "id", limit).count() == 0


def test_late_rows_go_to_a_counted_side_table(spark):
    s = batches(spark, [[(1, 1, at(0), "x"), (2, 1, at(100), "x")], [(3, 1, at(5), "x"), (4, 1, at(99), "x")]], EV)
    good, late = J.split_late(s, "ts", 600, scratch_dir(spark, "l"))
    assert (good.count(), [r.id for r in late.collect()]) == (3, [3])


def test_ingest_keeps_one_copy_of_a_chunk_in_each_document(spark):
    parts = [[("a", "same"), ("a", "same"), ("b", "one")], [("c", "same"), ("d", "two")]]
    s = batches(spark, parts, "doc string, text string")
    out = J.ingest(s, lambda b: b.withColumn("content_hash", F.sha2("text", 256)), scratch_dir(spark, "i"), "doc", "content_hash")
    assert sorted((r.doc, r.text) for r in out.collect()) == [("a", "same"), ("b", "one"), ("c", "same"), ("d", "two")]


def test_dedup_across_batches(spark):
    s = batches(spark, [[(1, 1, at(0), "x")], [(1, 1, at(1), "x"), (2, 1, at(2), "x")]], EV)
    assert J.run_to_table(J.dedup(s, ["id"], "ts"), scratch_dir(spark, "d")).count() == 2


def test_rewriting_a_key_evicts_nothing(spark):
    rows = [("s", k, at(i), i) for i, k in enumerate(["a", "b", "a", "a"])]
    df = spark.createDataFrame(rows, "s string, k string, ts timestamp_ntz, id long")
    assert sorted(r.k for r in M.evict_oldest(df, "s", "k", "ts", "id", 2).collect()) == ["a", "b"]


def test_row_scope_denies_admins(spark):
    df = spark.range(3).withColumnRenamed("id", "owner")
    assert M.row_scope(df, "owner", "patient", 1).count() == 1
    with pytest.raises(PermissionError):
        M.row_scope(df, "owner", "auditor", 1)


def test_keep_newest_in_segments(spark, segments):
    df = spark.range(200).select(F.lit("hot").alias("r"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("ts"), "id")
    got = M.keep_newest(df.repartition(7), ["r"], "ts", "id", 30)
    assert sorted(r.id for r in got.collect()) == list(range(170, 200))


def test_a_document_that_comes_again_replaces_its_chunks(spark):
    parts = [[(1, "a"), (1, "b"), (2, "a")], [(1, "c"), (3, "a")], [(2, None)]]
    s = batches(spark, parts, "doc long, text string")
    got = J.ingest(s, lambda b: b.filter("text is not null").withColumn("h", F.md5("text")), scratch_dir(spark, "i"), "doc", "h").collect()
    assert sorted((r.doc, r.text) for r in got) == [(1, "c"), (3, "a")]
