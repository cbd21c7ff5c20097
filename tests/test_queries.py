"""Every registered query next to its SQL twin on the smallest tables."""

import os

import pytest
from check import compare, duck

import __spark_entry__ as entry
from tallyloom.plans import load_all

SMALL = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(load_all()[0]))
def test_query(spark, con, name):
    status, _, _, msg = compare(spark, con, SMALL, name)
    assert status != "FAIL", msg


ORDERED = ["sessions_toggle", "sessions_logon", "merge_short_breaks", "merge_short_breaks_pairwise", "sessions_tagged_reboot",
           "computer_on_same_day", "computer_on_default_end", "merge_small_gaps", "min_duration_or_join", "running_cap", "gap_sessions",
           "carry_forward_activity", "interval_first_then_adjacent", "keep_newest_n", "rate_limit_audit"]


@pytest.mark.parametrize("name", ORDERED)
def test_segmented_path_gives_the_same_rows(spark, con, segments, name):
    status, _, _, msg = compare(spark, con, SMALL, name)
    assert status in ("ok", "EMPTY"), msg


def test_every_survey_group_is_registered():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q)
    assert len(q) > 200


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == sorted(set(df.columns), key=df.columns.index) and df.count() > 0
