"""Lines that many documents share are dropped from all but one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import WHITE, ascii_lower, filled, stored, strong_key


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text, and the columns in ``keep``.

    A line's key is the line without white space at its ends, A-Z in lower case. A key of at
    least ``min_chars`` code points in at least ``min_docs`` documents (distinct doc_ids) loses
    its lines in all but the largest doc_id that holds it, where all of them stay. Null is no doc_id here. Keys travel
    as 128-bit hashes. (key, document) pairs are made distinct, then counted on the map side
    first; the common keys are written to a table of their own, a row each, so that the join
    back to the lines has nothing but an exchange on either side: Spark broadcasts the table where its
    size allows that, else AQE splits the partition of a line that a third of all documents share.

    Null or empty text is one empty line. Rows repeated with one doc_id and one text are decided
    alike and count once; with a null doc_id they never win a line. A text whose lines all go
    becomes ''. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", *keep, filled().alias("text")).withColumn("row", F.xxhash64("text"))
    lines = rows.select("doc_id", "row", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).withColumn("key", F.btrim("line", F.lit(WHITE))).filter(F.length("key") >= min_chars)
    h1, h2 = strong_key(ascii_lower(F.col("key")))
    lines = lines.select("doc_id", "row", "pos", h1.alias("h1"), h2.alias("h2"))
    common = stored(
        lines.select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("holder"))
        .filter(F.col("n_docs") >= min_docs)
    )
    drops = lines.join(common, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("holder"))).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drops"))
    drops = drops.select(F.col("doc_id").alias("id"), F.col("row").alias("r"), "drops")
    out = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r")), "left").withColumn("lines", F.split("text", "\n"))
    last = F.size("lines") - 1
    kept = F.transform(F.array_except(F.sequence(F.lit(0), last), F.col("drops")), lambda i: F.col("lines")[i])
    return out.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"), *keep,
    )
