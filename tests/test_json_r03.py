"""What took longest in reading JSON arrays in round 3."""

from tallyloom.sources import scans as S


def test_arrays_are_read_as_they_stand_without_going_back_to_the_file(spark, tmp_path):
    rec = '{"commit_time": "2024-03-04T05:06:07", "repo": "r", "author": 1.10, "msg": "a\\nb", "hash": 12, "wbso": %s}'
    (tmp_path / "a.json").write_text("[" + rec % "true" + ",\n" + rec % "false" + "]\n")
    (tmp_path / "b.json").write_text("\n [" + rec % '"yes"' + "]")
    df = S.scan_json_records(spark, str(tmp_path))
    assert sorted((str(r.timestamp), r.author, r.message, r.hash, r.is_eligible) for r in df.collect()) == \
        [("2024-03-04 05:06:07", "1.10", "a\nb", "12", x) for x in (False, True, True)]
    options = df._jdf.queryExecution().analyzed().collectLeaves().head().relation().options()
    assert not options.contains("multiLine") and options.contains("lineSep")
