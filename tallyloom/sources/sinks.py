"""Writers: CSV and JSON exports, idempotent appends, vector records, per-document replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import dedup_content


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, lookups: dict[str, tuple[DataFrame, str, str]],
                     order: list) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows left out).  New natural keys only; each lookup maps a code column to
    an id through (table, code, id); a code that is unknown leaves the row out with a reason."""
    from ..scale import first_per

    d = first_per(incoming, [key], order).join(existing.select(key).distinct(), key, "left_anti")
    missing = []
    for col, (table, code, ident) in lookups.items():
        m = table.select(F.col(code).alias(col), F.col(ident).alias(f"{col}_id"))
        d = d.join(m, col, "left")
        missing.append(F.when(F.col(f"{col}_id").isNull(), F.lit(f"unknown_{col}")))
    d = d.withColumn("skip_reason", F.coalesce(*missing) if missing else F.lit(None).cast("string"))
    return d.filter("skip_reason is null").drop("skip_reason"), d.filter("skip_reason is not null")


def append_vectors(df: DataFrame, path: str, rid: str, content_hash: Column, text: Column, order: list) -> None:
    """Append records after in-batch dedup, one folder per embedding model."""
    dedup_content(df, content_hash, text, rid, order).write.mode("append").partitionBy("embedding_model").parquet(path)


def replace_documents(df: DataFrame, path: str, doc: str = "document_name") -> None:
    """Write chunks so that every document in ``df`` replaces its earlier chunks and others stay.
    Documents are partitions; only those present in the batch are overwritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(doc).parquet(path)


def delete_by_document(chunks: DataFrame, doc: str, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks that stay, number deleted per document)."""
    keep = chunks.join(names.select(doc).distinct(), doc, "left_anti")
    gone = chunks.join(names.select(doc).distinct(), doc, "left_semi").groupBy(doc).agg(F.count("*").alias("deleted"))
    return keep, gone


def write_by_role(df: DataFrame, path: str, role: str) -> None:
    """One append per batch; a folder per role lets readers skip the others."""
    df.write.mode("append").partitionBy(role).parquet(path)
