"""One test for each mended finding of round 3."""

from check import compare, duck

import pytest
from check import compare, duck

from tallyloom.operators import memory as M
from tallyloom.operators import sessions as S

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def beside(tmp_path, **tables):
    """The smallest tables with some replaced: {name: a query over the old one, named ``old``}."""
    import duckdb

    for n in TABLES:
        if n not in tables:
            (tmp_path / f"{n}.parquet").symlink_to(f"{SMALL}/{n}.parquet")
            continue
        duckdb.sql(f"WITH old AS (FROM '{SMALL}/{n}.parquet') {tables[n]}").write_parquet(str(tmp_path / f"{n}.parquet"))
    return str(tmp_path)


def test_no_window_runs_to_the_end_of_its_key(spark):
    d = spark.range(20).selectExpr("id", "id % 2 AS k", "id AS at")
    kept = M.keep_newest(d, ["k"], "at", "id", 3)
    assert "unboundedfollowing" not in kept._jdf.queryExecution().toString().lower()
    assert sorted(r.id for r in kept.collect()) == [14, 15, 16, 17, 18, 19]


@pytest.mark.parametrize("name", ["sessions_logon", "merge_short_breaks", "merge_short_breaks_pairwise", "break_rules"])
def test_the_last_second_of_a_day(spark, tmp_path, name):
    late = " ".join(f"UNION ALL SELECT {i}, TIMESTAMP '{ts}', {u}, '{kind}', 1.0, '{{}}'" for i, (ts, u, kind) in enumerate([
        ("2024-03-01 12:00:00", 9001, "view"), ("2024-03-01 23:59:59.5", 9001, "purchase"),  # ends within it
        ("2024-03-01 23:59:59.5", 9002, "view"), ("2024-03-02 10:00:00", 9002, "purchase"),  # begins within it
        ("2024-03-01 23:59:59.5", 9003, "view")], start=10**7))
    folder = beside(tmp_path, events=f"FROM old {late}")
    status, _, _, msg = compare(spark, duck(folder), folder, name)
    assert status == "ok", msg


TEXTS = ["é123456789é", "١٢٣٤٥٦٧٨٩", "12\x0bjaar 45\x85jaar 12 jaar", "dhr. Janſen", "dhr. ıan", "dhr. İan", "1234 A\u212a", "1234Aſ", "naïve1234 ABé",
         "PATIËNT 123", "[INST] a\rsystem [/INST]", "[INST] a\nsystem [/INST]", "ignore\x0bprevious prompts", "İgnore previous", "you should take é"]


def weird(cols):
    texts = ["'" + x + "'" for x in TEXTS] + ["NULL"]
    return "FROM old " + " ".join(f"UNION ALL SELECT {10**7 + i}, {cols.format(x)}" for i, x in enumerate(texts))


@pytest.mark.parametrize("name", ["pii_scan", "pii_spans", "pii_decision", "pii_mask"])
def test_patterns_read_as_in_sql(spark, tmp_path, name):
    folder = beside(tmp_path, documents=weird("{}, 'nl', 'src0', 1"))
    status, _, _, msg = compare(spark, duck(folder), folder, name)
    assert status == "ok", msg


@pytest.mark.parametrize("name", ["stream_guard", "guard_first_match", "leak_and_advice_scan", "blocked_terms"])
def test_screens_read_as_in_sql(spark, tmp_path, name):
    folder = beside(tmp_path, conversations=weird("7, 'user', {}"))
    status, _, _, msg = compare(spark, duck(folder), folder, name)
    assert status == "ok", msg


@pytest.mark.parametrize("name", ["stream_ingest", "stream_guard"])
def test_streams_read_tables_of_several_files(spark, tmp_path, name):
    table = "documents" if name == "stream_ingest" else "conversations"
    folder = tmp_path / "t"
    folder.mkdir()
    for n in TABLES:
        if n != table:
            (folder / f"{n}.parquet").symlink_to(f"{SMALL}/{n}.parquet")
    spark.read.parquet(f"{SMALL}/{table}.parquet").repartition(3).write.parquet(str(folder / f"{table}.parquet"))
    con = duck(SMALL)
    status, _, _, msg = compare(spark, con, str(folder), name)
    assert status == "ok", msg


def test_session_ids_beyond_their_width(spark):
    ids = [S.number_sessions(spark.range(10001), ["id"], "ses_", 4, cut=c).orderBy("id").tail(1)[0].session_id for c in (True, False)]
    assert ids == ["ses_1000", "ses_10001"]


def test_commit_metadata_names_its_repositories(spark):
    import __spark_entry__ as entry

    row = entry.queries()["commit_metadata"](spark, SMALL).first()
    assert len(row.repos.split(",")) == row.repositories > 1


def test_freshness_probe_reads_all_days(spark, tmp_path):
    import __spark_entry__ as entry

    folder = beside(tmp_path, events="FROM old WHERE ts < '2024-01-13'")  # the last day is an even one
    assert str(entry.queries()["freshness_probe"](spark, folder).first().latest_date) == "2024-01-12"
