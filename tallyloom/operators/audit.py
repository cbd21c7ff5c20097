"""Audit tables without personal data: hashes, codes and counts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import privacy as pv
from ..functions.text import hash_identifier, hash_scope


def pseudonymise(df: DataFrame, user: str, session: str, role: str, resource: str, collection: str) -> DataFrame:
    return df.select(hash_identifier(user).alias("actor_hash"), F.col(role).alias("role"), hash_identifier(session).alias("session_hash"),
                     hash_identifier(resource).alias("resource_hash"), F.lit("patient_record").alias("resource_type"),
                     F.lit(collection).alias("collection"), hash_identifier(resource).alias("scope_hash"))


def event_rows(messages: DataFrame, text: str, role: str, ids: list[str]) -> DataFrame:
    """One row per screened message: guard type, action, reason, query hash and categories."""
    s = pv.screen_input(text)
    m = messages.withColumn("__s", s).withColumn("categories", pv.pii_categories(text))
    kind = F.when(F.col("__s.reason") == "jailbreak", "jailbreak_detection").when(F.col("__s.reason") == "topic", "topic_filter") \
        .when(F.col("__s.reason") == "pii", "pii_detection").otherwise("access_control")
    action = F.when(F.col("__s.action") == "block", "blocked").when(F.col("__s.action") == "flag", "flagged").otherwise("allowed")
    return m.select(*ids, kind.alias("guardrail_type"), action.alias("action"), F.col("__s.reason").alias("reason_code"),
                    hash_identifier(text).alias("query_hash"), F.col(role).alias("user_role"), "categories")


def isolation_rows(df: DataFrame, ids: list[str], requester: str, requested: Column, response: Column) -> DataFrame:
    leak = F.array_except(response, requested)
    return df.select(*ids, hash_identifier(requester).alias("requester_hash"), hash_scope(requested).alias("requested_scope"),
                     F.size(requested).alias("requested_count"), F.size(response).alias("response_count"),
                     (F.size(leak) == 0).alias("isolation_maintained"), F.size(leak).alias("blocked_count"))


def effectiveness(events: DataFrame, isolation: DataFrame) -> DataFrame:
    """One row: counts, protection, block and isolation rates (1.0 when there was nothing to protect)."""
    found = F.size("categories") > 0
    handled = found & F.col("action").isin("flagged", "blocked")
    e = events.agg(F.count("*").alias("total_events"), F.count_if(found).alias("with_pii"), F.count_if(handled).alias("pii_handled"),
                   F.count_if(F.col("action") == "blocked").alias("blocked"))
    i = isolation.agg(F.count("*").alias("patient_queries"), F.count_if("isolation_maintained").alias("isolation_passed"))
    one = e.withColumn("k", F.lit(1)).join(i.withColumn("k", F.lit(1)), "k").drop("k")

    def rate(a, b, empty):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(empty)

    return one.withColumn("protection_rate", rate("pii_handled", "with_pii", 1.0)).withColumn("block_rate", rate("blocked", "total_events", 0.0)) \
        .withColumn("isolation_rate", rate("isolation_passed", "patient_queries", 1.0))
