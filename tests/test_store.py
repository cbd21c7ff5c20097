"""The chunk store: what is visible after appends, replacements, deletions, failures and conflicts."""

import pytest
from pyspark.sql import functions as F

from tallyloom.scale import scratch_dir
from tallyloom.sources.store import ChunkStore, Conflict

ROW = "document_name string, chunk long, text string, vector array<double>"


def rows(spark, items):
    return spark.createDataFrame([(d, i, f"{d}/{i}/{v}", [float(i), float(v), 1.0]) for d, i, v in items], ROW)


def seen(store):
    return sorted((r.document_name or "", r.chunk, r.text.rsplit("/", 1)[1]) for r in store.scan().collect())


@pytest.fixture
def store(spark):
    s = ChunkStore(spark, scratch_dir(spark, "store"), buckets=8)
    s.append(rows(spark, [(f"d{k}", i, 1) for k in range(40) for i in range(2)] + [(None, 0, 1)]))
    return s


def test_replaced_kept_and_removed_documents(spark, store):
    assert store.count() == 81
    store.append(rows(spark, [("d3", 2, 1), ("new", 0, 1)]))
    store.replace(rows(spark, [("d3", 0, 2), ("d4", 0, 2), ("d4", 1, 2)]).select("vector", "text", "chunk", "document_name"))
    got = seen(store)
    assert [r for r in got if r[0] in ("d3", "d4")] == [("d3", 0, "2"), ("d4", 0, "2"), ("d4", 1, "2")] and len(got) == 81
    assert store.delete(spark.createDataFrame([("d3",), ("d9",), ("unknown",), (None,)], "document_name string")) == {"records": 3, "documents": 2}
    assert store.count() == 78 and ("", 0, "1") in seen(store)
    assert store.delete(spark.createDataFrame([("unknown",)], "document_name string")) == {"records": 0, "documents": 0}
    assert sorted(r.text for r in store.scan(["d4", "new", "d3"]).collect()) == ["d4/0/2", "d4/1/2", "new/0/1"]


def test_only_touched_buckets_are_written_and_documents_make_no_folders(spark, store):
    before = store._load()[1]["folders"]
    store.replace(rows(spark, [("d5", 0, 3)]))
    after = store._load()[1]["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    many = ChunkStore(spark, scratch_dir(spark, "many"), buckets=16)
    many.append(spark.range(20_000).select(F.col("id").cast("string").alias("document_name"), F.lit(0).alias("chunk")))
    folder = many._names(f"{many.path}/data")
    assert len(folder) == 1 and len(many._names(f"{many.path}/data/{folder[0]}")) <= 17 and many.count() == 20_000
    assert many.scan(["77"]).inputFiles() and len(many.scan(["77"]).inputFiles()) <= 8 < len(many.scan().inputFiles())


def test_a_failed_job_and_a_conflict_change_nothing(spark, store):
    whole, version = seen(store), store.versions()[-1]
    broken = rows(spark, [("d1", 0, 9)]).withColumn("text", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        store.replace(broken)
    assert seen(store) == whole and store.versions()[-1] == version
    other = ChunkStore(spark, store.path, buckets=8)
    at, state = store._load()
    other.append(rows(spark, [("z", 0, 1)]))
    with pytest.raises(Conflict):
        store._commit(at, state)
    assert len(seen(store)) == 82
    with pytest.raises(ValueError, match="buckets"):
        ChunkStore(spark, store.path, buckets=9).scan()


def test_compaction_and_vacuum_keep_the_rows(spark, store):
    for v in range(3):
        store.append(rows(spark, [(f"e{v}", i, v) for i in range(9)]))
    whole = seen(store)
    assert store.compact(most=1) is not None and seen(store) == whole
    assert max(len(f) for f in store._load()[1]["folders"].values()) <= 1 and store.compact(most=1) is None
    assert store.vacuum(keep=1) >= 1 and seen(store) == whole and len(store.versions()) == 1


def test_search_over_the_store(spark, store):
    q = spark.createDataFrame([(1, [0.0, 1.0, 1.0]), (2, [1.0, 1.0, 1.0])], "q long, v array<double>")
    hits = store.search(q, "q", "v", "text", "vector", 3).collect()
    assert sorted((h.query_id, h.rank) for h in hits) == [(q, r) for q in (1, 2) for r in (1, 2, 3)]
    assert all(h.record_id.split("/")[1] == ("0" if h.query_id == 1 else "1") and abs(h.score - 1) < 1e-9 for h in hits)


def test_an_empty_store(spark):
    s = ChunkStore(spark, scratch_dir(spark, "none"))
    assert s.count() == 0 and s.delete(spark.createDataFrame([("a",)], "document_name string"))["records"] == 0
    with pytest.raises(ValueError, match="empty"):
        s.scan()
    s.replace(rows(spark, [("a", 0, 1)]))
    assert s.count() == 1
