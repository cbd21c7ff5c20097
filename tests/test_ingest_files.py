"""Files added, changed and removed between runs of the ingest."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import ingest as I


def lines(texts):
    return texts.select("path", "hash", F.posexplode(F.split("text", "\n")).alias("at", "text")).filter("text <> ''")


@pytest.fixture
def place(tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()

    def put(name, text, at=None):
        f = folder / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(text.encode())
        if at:
            os.utime(f, (at, at))

    return folder, put, str(tmp_path / "store")


def texts(chunks):
    return sorted((r.path.rsplit("/", 1)[1], r.at, r.text) for r in chunks.collect())


def test_added_changed_touched_and_removed_files(spark, place):
    folder, put, out = place
    ingest = I.FileIngest(spark, str(folder), out, lines, per_batch=2, compact_every=3)
    assert ingest.sync() is None
    put("a.txt", "one\ntwo", 1_000_000)
    put("b.md", "# head\nsame", 1_000_000)
    put("sub/c.txt", "same\nsame", 1_000_000)
    put("skip.exe", "no", 1_000_000)
    put("empty.txt", "", 1_000_000)
    first = [("a.txt", 0, "one"), ("a.txt", 1, "two"), ("b.md", 0, "# head"), ("b.md", 1, "same"), ("c.txt", 0, "same"), ("c.txt", 1, "same")]
    assert texts(ingest.sync()) == first
    assert texts(ingest.sync()) == first and ingest.changes().count() == 0
    put("a.txt", "three", 2_000_000)  # changed
    put("b.md", "# head\nsame", 2_000_000)  # touched only
    (folder / "sub/c.txt").unlink()
    put("d.html", "<h1>t</h1><p>body</p>", 2_000_000)
    second = texts(ingest.sync())
    assert [r for r in second if r[0] != "d.html"] == [("a.txt", 0, "three"), ("b.md", 0, "# head"), ("b.md", 1, "same")]
    assert any(r[0] == "d.html" for r in second)
    put("sub/c.txt", "same\nsame", 3_000_000)  # comes back as it was
    put("a.txt", "one\ntwo", 3_000_000)  # goes back to an earlier text
    third = texts(ingest.sync())
    assert [r for r in third if r[0] in ("a.txt", "c.txt")] == [r for r in first if r[0] in ("a.txt", "c.txt")]
    put("a.txt", "", 4_000_000)
    assert not [r for r in texts(ingest.sync()) if r[0] == "a.txt"]


def test_history_is_compacted_and_a_broken_base_does_not_count(spark, place):
    folder, put, out = place
    ingest = I.FileIngest(spark, str(folder), out, lines, compact_every=2)
    for k in range(7):
        put(f"f{k}.txt", f"text {k}", 1_000_000 + k)
        put("x.txt", f"x {k}", 1_000_000 + k)
        got = texts(ingest.sync())
        assert got == sorted([(f"f{i}.txt", 0, f"text {i}") for i in range(k + 1)] + [("x.txt", 0, f"x {k}")])
    assert len(I.children(spark, f"{out}/delta/docs")) <= 4 and len([n for n in I.children(spark, f"{out}/base") if n.isdigit()]) <= 2
    spark.range(3).write.parquet(f"{out}/base/99/docs")  # a compaction that failed half way
    assert texts(ingest.chunks()) == got


def test_a_batch_that_runs_again_doubles_nothing(spark, place):
    folder, put, out = place
    ingest = I.FileIngest(spark, str(folder), out, lines, compact_every=50)
    put("a.txt", "one", 1_000_000)
    ingest.sync()
    put("a.txt", "two\nthree", 2_000_000)
    batch = ingest.changes()
    ingest._step(batch, 1)
    once = texts(ingest.chunks())
    ingest._step(batch, 1)
    assert texts(ingest.chunks()) == once == [("a.txt", 0, "two"), ("a.txt", 1, "three")]
    # a batch that failed after its chunks, before its document rows, changes nothing yet
    put("a.txt", "four", 3_000_000)
    ingest._step(ingest.changes(), 2)
    I.remove(spark, f"{out}/delta/docs/batch=2")
    assert texts(ingest.chunks()) == once
