"""What grew faster than the input in round 3."""

import re
from datetime import datetime, timedelta
from random import Random

import pytest

from tallyloom.operators import intervals as I

T0 = datetime(2024, 1, 1)


def spans(rnd, n, longest):
    out = []
    for i in range(n):
        s = T0 + timedelta(microseconds=rnd.randrange(40 * 86_400_000_000))
        out.append((i, rnd.randrange(3), s, s + timedelta(microseconds=rnd.randrange(-10, longest))))
    return out


@pytest.mark.parametrize("crowd", [0, 30, 4096])
def test_keyed_lookups_by_one_block_and_by_many(spark, monkeypatch, crowd):
    monkeypatch.setattr(I, "_CROWD", crowd)
    rnd = Random(crowd)
    iv = [(i, k if i % 9 else None, s, e) for i, k, s, e in
          spans(rnd, 60, 2_000_000) + spans(rnd, 60, 86_400_000_000) + spans(rnd, 30, 900 * 86_400_000_000)]
    iv = [(n, *r[1:]) for n, r in enumerate(iv)]
    pts = [(i, k if k else rnd.choice([0, 1]), t) for i, k, t, _ in spans(rnd, 150, 1)] + [(1000 + n, k, t) for n, (_, k, s, e) in enumerate(iv) for t in (s, e)]
    p = spark.createDataFrame(pts, "pid long, k int, t timestamp_ntz")
    v = spark.createDataFrame(iv, "sid long, sk int, s timestamp_ntz, e timestamp_ntz")
    got = sorted(tuple(r) for r in I.stab_join(p, v, "t", "s", "e", [("k", "sk")]).select("pid", "sid").collect())
    assert got == sorted((a, b) for a, k, t in pts for b, q, s, e in iv if k is not None and k == q and s <= t <= e)


def test_intervals_of_common_keys_are_not_repeated(spark):
    v = spark.sql("SELECT id AS sid, id AS k, timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id % 12 AS int)) AS s, timestamp_ntz'2024-01-01 22:30:00' AS e FROM range(100)")
    asked = I._asked(v, "s", ["k"])
    cover = I._cover(I._marked(v, ["k"], I._crowded(asked, 1)), v["s"], v["e"])
    assert I._dealt(cover).count() <= 200


def test_a_worker_hands_chunks_on_in_small_batches():
    import pyarrow as pa

    from tallyloom.operators import chunks as C

    given = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([["word " * 20_000, None]] * 50)], ["doc", "pages"])
    got = list(C.cut_batches([given], C.cutter("recursive"), ["doc", "chunk_index", "page_number", "raw_text"]))
    assert len(got) > 3 and max(b.nbytes for b in got) < 3 << 20
    rows = [r for b in got for r in b.to_pylist() if r["doc"] == 49]
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and rows[-1] == {"doc": 49, "chunk_index": len(rows) - 1, "page_number": 2, "raw_text": ""}
    assert [r["raw_text"] for r in rows[:-1]] == C.split_text("word " * 20_000, C.CHUNK_SIZE, C.CHUNK_OVERLAP)


def test_filters_do_not_clean_texts_again(spark):
    from pyspark.sql import functions as F

    from tallyloom.operators import chunks as C

    docs = spark.sql("SELECT id AS doc_id, concat('Some text of page ', id) AS text FROM range(1)")
    c = C.records_to_embed(C.chunk_table(docs, "doc_id", F.array("text"), "fixed"), "doc_id")
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter NOT \(text#\d+ = \)", plan) and c.count() == 1


def test_small_files_are_taken_in_together(spark, tmp_path):
    from tallyloom.streaming import ingest as I2

    folder, out = tmp_path / "files", str(tmp_path / "store")
    folder.mkdir()
    for i in range(30):
        (folder / f"{i}.txt").write_text("x" * 100)
    store = I2.FileIngest(spark, str(folder), out, lambda f: f.select("path", "hash", "text"), per_batch=2, batch_bytes=1000)
    assert store.sync().count() == 30
    assert 3 <= len([n for n in I2.children(spark, f"{out}/delta/docs") if n.startswith("batch=")]) <= 4
