"""Exact dedup in three stages that each compare whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import filled, materialize

SALTS = 16


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Local stage: the map side of the first aggregation merges equal texts of a partition. Salted
    stage: the local winners of a digest meet by (digest, text, salt), the salt being the
    partition they come from, so a text that fills a third of all rows spreads over ``salts``
    tasks. Global stage: the salts' winners meet by (digest, text). The text itself is part of
    the key in all three. The winners then go back to the rows by digest alone where no digest
    has two texts, which is counted, else by digest and text.

    Null text counts as empty. Among equal texts the largest doc_id stays; a null doc_id only
    stays in a group that has no other. Rows repeated with one doc_id each get a row and count in group_size, and all
    those with the winning id are ``kept``. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", filled().alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    salted = rows.groupBy("text_sha256", "text", (F.spark_partition_id() % salts).alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("text_sha256", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # Only a digest with several texts needs its texts from here on.
    slim = materialize(winners.select("text_sha256", "keep_id", "group_size", F.xxhash64("text").alias("tag")))
    collided = not slim.groupBy("text_sha256").count().filter("count > 1").isEmpty()
    if collided:
        rows, on = rows.withColumn("tag", F.xxhash64("text")), ["text_sha256", "tag"]
    else:
        slim, on = slim.drop("tag"), ["text_sha256"]
    return rows.drop("text").join(slim, on, "left").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"), "text_sha256")
