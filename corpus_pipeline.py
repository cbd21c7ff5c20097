"""From raw documents to packed sequences: quality, exact copies, near copies, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import exact, minhash, packing, quality, queries, surrogates
from tallyloom.llm.common import table, written

ID, TEXT = "doc_id", "text"


def _only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``keep``, a null id included; all columns, in order."""
    ids = keep.select(F.col(ID).alias("__keep")).distinct()
    return docs.join(ids, docs[ID].eqNullSafe(ids["__keep"]), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or better stay.  Without both labels among the learnable rows all stay.

    The score depends on the text alone, so equal texts share their fate, and null ids are judged like others.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"), id_col=ID, text_col=TEXT)
    if model is None:
        return docs
    return quality.filtered(docs, model, text_col=TEXT)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; of rows that repeat id and text, one."""
    groups = exact.exact_groups(docs, id_col=ID, text_col=TEXT)
    counts = groups.groupBy(ID).agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("stay")).filter(f"stay > 0 AND {ID} IS NOT NULL")
    ids = written(counts, "kept")
    named, nameless = docs.filter(F.col(ID).isNotNull()), docs.filter(F.col(ID).isNull())
    once = _only(named, ids.filter("rows = 1"))
    # a repeated or null id says nothing about its rows: these are judged by id and text
    again = _only(named, ids.filter("rows > 1")).unionByName(nameless).withColumn("__text", F.sha2(F.coalesce(F.col(TEXT), F.lit("")), 256))
    dropped = groups.filter("NOT kept").select(F.col(ID).alias("__id"), F.col("text_sha256").alias("__sha"))
    again = again.join(dropped, F.col(ID).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__sha")), "left_anti")
    return once.unionByName(again.dropDuplicates([ID, "__text"]).drop("__text"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles of similarity 0.8 or more, the one with the smallest id stays."""
    found = minhash.near_duplicates(docs, id_col=ID, text_col=TEXT, num=80, den=100)
    return _only(docs, found.filter("kept"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the new text.  All rows stay."""
    out = surrogates.surrogate_text(docs, queries.SURROGATE_KEY, text_col=TEXT)
    if "n_chars" not in docs.columns:
        return out
    kind = dict(docs.dtypes)["n_chars"]
    changed = F.when(F.col(TEXT).isNotNull(), F.length(TEXT)).otherwise(F.col("n_chars")).cast(kind)
    return out.withColumn("n_chars", changed)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens, with their ids."""
    packed = packing.sequences(docs, queries.tokenizer_path("word_bpe_49k.json"), id_col=ID, text_col=TEXT, remember=80_000)
    return packing.pieces(packed).select(F.col("doc").alias(ID), "piece", "start", "length", "ids", F.col("sequence").alias("sequence_id"), "offset")


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("pii_surrogates", privacy_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
