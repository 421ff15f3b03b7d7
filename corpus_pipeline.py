"""The corpus pipeline: quality, line dedup, near dedup, decontamination, mixing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import shared_folder, table
from parley.llm.decontaminate import decontaminate
from parley.llm.line_dedup import line_dedup
from parley.llm.mixing import mix_sources
from parley.llm.near_dedup import near_dedup
from parley.llm.quality import fit_quality, with_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT = 0.5


def _row() -> Column:
    """The hash of the text, as the operators give it; with doc_id it tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below REJECT go.

    Null text, lang, source or n_chars are values like others, and an empty text is scored as
    such. Null doc_ids are scored but never learned from; repeated rows stay or go alike. Labels
    of one class or none let all stay (of class 0: none). Empty table: no rows. Extra columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs.withColumn("text", F.coalesce("text", F.lit(""))), table(spark, sf_dir, "labels"))
    return with_quality(docs, model).filter(F.col("score") >= REJECT).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go from all documents but one; n_chars follows the text.

    Null text becomes ''; a text may become '' too and its row stays. Repeated rows are decided
    alike and count once; null doc_ids never win a line. Empty table: no rows. Extra columns are dropped.
    """
    out = line_dedup(docs.select(*COLUMNS), keep=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, one row of it.

    Null and empty texts are one group like any other. Of repeated rows one stays; rows of one
    doc_id with different texts are told apart by their texts, so in a group whose smallest
    doc_id has several texts each of those stays. A row without doc_id goes if its group has a
    doc_id, else it stays, once for each text. Empty table: no rows. Extra columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    roots = near_dedup(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("root"), F.col("row").alias("r")).distinct()
    kept = docs.join(roots.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("root")) & (_row() == F.col("r")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Null and empty texts stay. Rows of one doc_id are decided by their own texts, repeated rows
    alike, null doc_ids like others. An empty benchmark lets all stay; empty table: no rows.
    Extra columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    bad = decontaminate(docs, table(spark, sf_dir, "benchmark"), with_row=True).filter("contaminated").select(F.col("doc_id").alias("bad"), F.col("row").alias("r")).distinct()
    return docs.join(bad.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("bad")) & (_row() == F.col("r")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; the mix itself is written to the shared folder.

    Null or empty text has size 0 and is never taken; null is a source of its own. Repeated rows
    share what is taken of their text. Empty table: no rows. Extra columns are dropped.
    """
    return mix_sources(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontaminate", benchmarks), ("mix", mix)]
ORACLE_SQL = None  # a trained classifier, fingerprints linked to groups, and pseudorandom draws


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
