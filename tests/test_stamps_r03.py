"""What took longest in reading times in round 3."""

import re

from pyspark.sql import functions as F

from tallyloom.functions import timecols as tc


def test_only_layouts_of_its_shape_are_tried_on_a_text(spark):
    texts = ["3/4/2024 5:6:07 pm", "2024/3/4 5:6:7", "2024-3-4 5:6:7", "2024-03-04t05:06:07", "2024-03-04T05:06:07.5", "2024-03-04T05:06:07.123456Z", "+2024-13-04 05:06:07", "x", None, "2024-03-04"]
    raw = [F.try_to_timestamp("t", F.lit(lay)).cast("timestamp_ntz") for _, lay, _ in tc.TIMESTAMP_LAYOUTS]
    body = F.regexp_replace("t", tc._ZONE_TAIL, "")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = F.coalesce(*[F.try_to_timestamp(body, F.lit(lay)).cast("timestamp_ntz") for _, lay, _ in tc.TIMESTAMP_LAYOUTS], tc._iso(body))
    got = df.select("t", want.alias("want"), tc.parse_stamp("t").alias("got"), *[(r.eqNullSafe(tc._naive(F.col("t"), lay))).alias(n) for r, (n, lay, _) in zip(raw, tc.TIMESTAMP_LAYOUTS)]).collect()
    assert all(r.want == r.got and all(r[3:]) for r in got) and sum(r.got is not None for r in got) == 6
    assert [sum(bool(re.search(tc._shape(lay), t or "")) for _, lay, _ in tc.TIMESTAMP_LAYOUTS) for t in texts] == [1, 1, 1, 2, 1, 0, 1, 0, 0, 0]
