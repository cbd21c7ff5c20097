"""What round 4 found."""

import datetime as dt
import random

import pytest
from check import table
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.operators import chunks as C


def test_sentences_are_found_once(spark):
    docs = spark.sql("SELECT id AS doc_id, concat('Text ', id, '. Next sentence.') AS text, 'x' AS chunks FROM range(3)")
    c = C.sentence_chunks(docs, "text", 3, 1).select("doc_id", F.posexplode("chunks").alias("chunk_index", "c"))
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(trim(") == 1 and plan.count("split(regexp_replace(") == 1
    assert sorted(map(tuple, c.collect())) == [(i, k, t) for i in range(3) for k, t in enumerate([f"Text {i}.", "Next sentence."])]


@pytest.mark.parametrize("lowest", [-60, 0])
def test_windows_of_no_length_have_the_pairs_of_the_sql(spark, tmp_path, lowest):
    """Order numbers below zero give windows that are empty or end before they start."""
    import duckdb

    rnd = random.Random(lowest)
    rows = [(k, k % 3, "F", 1.0, dt.datetime(2024, 3, 1) + dt.timedelta(hours=rnd.randrange(40)), "p") for k in range(lowest, 60)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = entry.queries()["overlap_self_join"](spark, str(tmp_path))
    cur = con.execute(entry.oracle_sql()["overlap_self_join"])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert table(got.columns, got.collect()) == want and (lowest == 0 or [r for r in want[1] if float(r[2]) <= 0])
