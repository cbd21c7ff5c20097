"""Table functions called from SQL text against the DataFrame forms."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import chunks as C
from tallyloom.operators import table_functions as U

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    U.register(spark)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n "), (-4, "short"), (-5, "x" * 1500)], "doc_id long, text string")
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd)
    d.createOrReplaceTempView("docs_for_chunks")
    return d


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_chunkers_equal_the_column_forms(spark, docs):
    got = spark.sql("SELECT d.doc_id, c.* FROM docs_for_chunks d, LATERAL chunk_fixed(d.text, 300, 30) c")
    want = docs.filter("trim(translate(text, '\n', ' ')) <> ''").select("doc_id", F.posexplode(C.fixed_width("text", 300, 30)))
    assert rows(got) == rows(want)
    got = spark.sql("SELECT d.doc_id, c.chunk_index, c.text FROM docs_for_chunks d, LATERAL chunk_recursive(d.text) c")
    want = docs.select("doc_id", F.posexplode(C.chunker("recursive")(F.array("text"))).alias("i", "c")).select("doc_id", "i", "c.text").filter("text <> ''")
    assert rows(got) == rows(want)
    got = spark.sql("SELECT d.doc_id, c.text FROM docs_for_chunks d, LATERAL chunk_sentences(d.text, 200) c")
    want = docs.select("doc_id", F.explode(C.chunker("semantic", size=200)(F.array("text"))).alias("c")).select("doc_id", "c.text").filter("text <> ''")
    assert rows(got) == rows(want)


def test_processor_equals_the_column_form(spark):
    U.register(spark)
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    pages.createOrReplaceTempView("pages_to_read")
    got = spark.sql("SELECT p.page_id, t.text, t.headings FROM pages_to_read p, LATERAL html_document(p.html) t")
    want = pages.select("page_id", tx.html_text("html").alias("x")).select("page_id", "x.text", "x.headings")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("call", ["chunk_fixed(text, 10, 10)", "chunk_fixed(text, 0)", "chunk_recursive(doc_id)", "chunk_recursive(text, doc_id)", "chunk_fixed(text, 5, 1, 1)"])
def test_wrong_arguments_are_refused_before_anything_runs(spark, docs, call):
    with pytest.raises(Exception, match="constant|overlap|first argument|no more"):
        spark.sql(f"SELECT c.* FROM docs_for_chunks, LATERAL {call} c")


def test_scorer_from_sql(spark, docs):
    U.register_scorer(spark, "shared_letters", lambda: lambda qs, ts: [float(len(set(q) & set(t))) for q, t in zip(qs, ts)])
    got = spark.sql("SELECT doc_id, shared_letters('short', text) AS s FROM docs_for_chunks WHERE doc_id < 0").collect()
    assert {r.doc_id: r.s for r in got} == {-1: 0.0, -2: 0.0, -3: 0.0, -4: 5.0, -5: 0.0}
