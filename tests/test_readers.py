"""Readers on hand-made files: mixed headers, quoted breaks, separators inside subjects, wrapped and broken JSON."""

import json

import pytest

from tallyloom.sources import scans as S


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_aliases_quotes_and_line_breaks(spark, tmp_path):
    put(tmp_path / "a", "one.csv", 'TimeGenerated,EventType,EventID,ComputerName,Note\n2023-11-03 16:15:09,logon,7,"pc, ""left""","two\nlines"\n??,logoff,8,pc,x\n')
    put(tmp_path / "a", "two.csv", "﻿Event ID,Computer Name,Time Generated,Event Type\n9,pc2,11/3/2023 4:15:09 PM,start\n")
    put(tmp_path / "a", "three.csv", "Time,Computer\n2023-11-03,x\n")
    put(tmp_path / "a", "other.txt", "Time,Event Type,Event ID,Computer\n2023-11-03,x,1,y\n")
    got = sorted((r.event_id, r.computer_name, r.event_type, str(r.timestamp), r.Note) for r in S.scan_csv_alias(spark, str(tmp_path / "a")).collect())
    assert got == [("7", 'pc, "left"', "logon", "2023-11-03 16:15:09", "two\nlines"), ("9", "pc2", "start", "2023-11-03 16:15:09", None)]
    put(tmp_path / "b", "no.csv", "x,y\n1,2\n")
    with pytest.raises(FileNotFoundError):
        S.scan_csv_alias(spark, str(tmp_path / "b"))


def test_files_with_other_column_orders_do_not_shift(spark, tmp_path):
    put(tmp_path, "1.csv", "﻿DateTime (local),EventId,RecordId\nd1,e1,r1\n")
    put(tmp_path, "2.csv", "RecordId,Message,DateTime\nr2,m2,d2\n")
    got = sorted(tuple(r) for r in S.scan_csv_bom(spark, str(tmp_path)).collect())
    assert got == [("d1", "e1", None, None, "r1"), ("d2", None, None, "m2", "r2")]


def test_separator_is_decided_by_the_first_line(spark, tmp_path):
    put(tmp_path / "x", "repo.csv", 'datetime,epoch,subject,author,hash\n2023-11-03 16:15:09,1,"fix a|b, really",ann,h1\n2023-11-03 16:15:10,2,plain a|b,bo,h2\n')
    put(tmp_path / "y", "repo.csv", "2023-11-03 16:15:11|3|one, two|cy|h3\n2023-11-03 16:15:12|4||cy|h4\n")
    got = sorted((r.hash, r.message, r.author) for r in S.scan_csv_delim_fallback(spark, f"{tmp_path}/*").collect())
    assert got == [("h1", "fix a|b, really", "ann"), ("h2", "plain a|b", "bo"), ("h3", "one, two", "cy")]


def test_json_commits_under_every_accepted_name(spark, tmp_path):
    put(tmp_path / "c", "1.json", json.dumps([{"commit_time": "2023-11-03T16:15", "repo": "r", "author": "a", "msg": "m", "hash": "h", "wbso": True}]))
    got = S.scan_json_records(spark, str(tmp_path / "c")).collect()
    assert [(str(r.timestamp), r.repo_name, r.message, r.is_eligible) for r in got] == [("2023-11-03 16:15:00", "r", "m", True)]
    put(tmp_path / "d", "1.json", '{"not": "a list"}')
    with pytest.raises(ValueError, match="list"):
        S.scan_json_records(spark, str(tmp_path / "d"))


def test_wrapped_lists_bare_objects_and_rejects(spark, tmp_path):
    texts = ['[{"id": 1}, {"id": 2}]', '{"work_sessions": [{"id": 3}]}', '{"sessions": [{"id": 4}]}', '{"synthetic_sessions": [{"id": 5}]}', '{"id": 6}', "broken", "[1"]
    for k, t in enumerate(texts):
        put(tmp_path, f"{k}.json", t)
    got = S.scan_json_polymorphic(spark, str(tmp_path), "id bigint").collect()
    assert sorted(r.id for r in got if r.id is not None) == [1, 2, 3, 4, 5, 6]
    bad = S.polymorphic_rejects(spark.read.text(str(tmp_path), wholetext=True), "value").collect()
    assert sorted(r._rejected for r in bad) == ["[1", "broken"]


def test_question_sets_and_text_files(spark, tmp_path):
    put(tmp_path / "q", "1.json", json.dumps([{"question": "q1", "ground_truth_contexts": ["c"], "expected_answer": "a"}, {"question": " ", "ground_truth_contexts": ["c"]},
                                              {"question": "q3", "ground_truth_contexts": []}]))
    assert [r.question for r in S.scan_eval_dataset(spark, str(tmp_path / "q")).collect()] == ["q1"]
    put(tmp_path / "t", "a.md", "# Head\ntext")
    put(tmp_path / "t", "b.html", "<h1>H</h1><p>body</p>")
    put(tmp_path / "t", "c.exe", "no")
    (tmp_path / "t" / "d.txt").write_bytes(b"ok \xff end")
    got = {r.file_type: r for r in S.scan_text_files(spark, str(tmp_path / "t")).collect()}
    assert set(got) == {"md", "html", "txt"} and got["md"].section_headings == ["Head"] and got["txt"].text == "ok � end"


def test_git_log_and_listing(spark, tmp_path):
    put(tmp_path, "log.txt", "2023-11-03 16:15:09|1|s|a|h|i\nbad|line\n")
    assert [tuple(r)[1:] for r in S.ingest_from_git_log(spark, str(tmp_path)).collect()] == [("1", "s", "a", "h|i")]
    assert [(r.name, r.size) for r in S.file_listing(spark, str(tmp_path)).collect()] == [("log.txt", 39)]


# Expected values stated here on their own, not through the package's constants.
def test_accepted_names_and_media_types():
    assert S.EVENT_ALIASES == {"TimeGenerated": "timestamp", "Time Generated": "timestamp", "Time": "timestamp", "EventType": "event_type", "Event Type": "event_type",
                               "EventID": "event_id", "Event ID": "event_id", "ComputerName": "computer_name", "Computer Name": "computer_name", "Computer": "computer_name"}
    assert {"application/msword", "text/csv", "application/json", "text/plain"} <= set(S.ADMITTED_MEDIA) and len(S.ADMITTED_MEDIA) == 8


def test_session_category_and_fixed_rules(spark):
    from tallyloom.functions import keywords as kw
    from tallyloom.functions import text as tx

    ses = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    repos = spark.createDataFrame([("a", 1, "an AI agent"), ("a", 2, "ai framework"), ("a", 0, "audit log"), ("b", 1, None)], "s string, o int, d string")
    assert {r.s: (r.category, r.n) for r in kw.session_category(ses, "s", repos, "d", "o").collect()} == {"a": ("AI_FRAMEWORK", 2), "b": ("UNKNOWN", 0), "c": ("UNKNOWN", 0)}
    assert kw.DECLARABLE[0][2] == ["work", "development", "research", "wbso", "ai", "tech"]
    assert tx.MEDIA_TYPES["csv"] == "text/csv" and tx.MEDIA_TYPES["json"] == "application/json"
