"""Caps by day and by week sort their rows once."""

import datetime as dt
import random

import pytest

from tallyloom import scale
from tallyloom.operators import sessions as S


@pytest.mark.parametrize("hot", [False, True])
def test_caps_of_day_and_week_need_one_sort(spark, segments, monkeypatch, hot):
    rnd, cuts = random.Random(4), []

    def cut(df):
        cuts.append(1)
        return given(df.drop("__seg").repartitionByRange(9, *order).sortWithinPartitions(*order).withColumn("__seg", scale.F.spark_partition_id()))

    given, order = scale.cut_lineage, ["k", "day", "n"]
    monkeypatch.setattr(scale, "cut_lineage", cut)
    rows = [(1 if hot else rnd.randrange(3), dt.datetime(2024, 12, 20) + dt.timedelta(days=rnd.randrange(20)), n, rnd.randrange(1, 16) / 4) for n in range(300)]
    got = S.running_cap(spark.createDataFrame(rows, "k int, day timestamp_ntz, n int, h double"), "day", ["n"], "h", 6.0, 12.0, ["k"])
    assert got.columns == ["k", "day", "n", "h", "kept_day", "iso_week", "kept"]
    want, days, weeks = {}, {}, {}
    for k, day, n, h in sorted(rows):
        d = min(h, 6.0 - days.get((k, day), 0.0))
        if d > 0:
            days[k, day] = days.get((k, day), 0.0) + d
            at = (k, *day.isocalendar()[:2])
            kept = min(d, 12.0 - weeks.get(at, 0.0))
            if kept > 0:
                weeks[at] = weeks.get(at, 0.0) + kept
                want[n] = kept
    assert {r.n: round(r.kept, 9) for r in got.collect()} == want and len(cuts) == 1
