"""Benchmark decontamination by winnowed fingerprints, verified window by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import ascii_lower, filled, materialize

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 5
POS_BITS = 31
#: The benchmark's windows and fingerprints are broadcast up to so many bytes; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def _fingerprints(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Adds ``prints``: the least k-gram of every sliding window as hash and position in one long.

    Two sequences that share ``window`` words share all k-grams of that window, so they keep the
    same least hash there.
    """
    size = F.size("words")
    pack = lambda h, i: F.shiftleft(F.shiftright(h, POS_BITS), POS_BITS).bitwiseOR(i.cast("long"))
    grams = F.transform(F.sequence(F.lit(0), size - gram), lambda i: pack(F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(gram)]), i))
    rows = rows.withColumn("grams", F.when(size >= window, grams))
    # ``grams`` is named twice, so that Catalyst keeps it a column of its own instead of computing it for every window.
    least = F.transform(F.sequence(F.lit(1), F.size("grams") - (window - gram)), lambda i: F.array_min(F.slice("grams", i, window - gram + 1)))
    return rows.withColumn("prints", F.when(F.col("grams").isNotNull(), F.array_distinct(least))).drop("grams")


def _window(start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice("words", start + 1, n), " ")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES, with_row: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted strings), contaminated.

    A window is ``window`` consecutive words of an item, or the whole item where it has fewer
    words, but not none; document words inside any occurrence of a window are hit. Candidates are
    the places where winnowed fingerprints of both sides are equal; each is extended to the
    windows around it, which are compared word by word. Items too short to winnow are looked up by
    their first word, all lengths in one pass, then whole. ``with_row`` adds row, the hash of the
    text, which tells rows of one doc_id apart.

    Null text has no words; a document without words has no hits. Rows repeated with one doc_id
    and one text are decided alike. An item whose id is null goes by the name 'null'; items
    repeated under one id count once; an empty benchmark hits nothing. Other columns are ignored.
    """
    rows = docs.select("doc_id", filled().alias("text")).select("doc_id", F.xxhash64("text").alias("row"), words(F.col("text")).alias("words"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(filled()).alias("words")).filter(F.size("words") > 0)

    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    windows = items.select("item", "words", F.explode(starts).alias("s")).select("item", F.least(F.size("words"), F.lit(window)).alias("len"), F.get(F.col("words"), F.col("s")).alias("first"), _window(F.col("s"), F.least(F.size("words"), F.lit(window))).alias("key"))
    windows = materialize(windows.groupBy("len", "first", "key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    prints = materialize(_fingerprints(items, window, gram).select(F.explode_outer("prints").alias("p")).filter("p IS NOT NULL").select(F.shiftright("p", POS_BITS).alias("fp")).distinct())
    bytes_of = F.octet_length("key") + F.octet_length("first") + F.aggregate("items", F.lit(100), lambda n, x: n + 24 + F.octet_length(x))
    lengths, size = windows.agg(F.collect_set("len"), F.coalesce(F.sum(bytes_of), F.lit(0))).first()  # at most `window` lengths
    small = size + 40 * prints.count() <= broadcast_bytes
    sent = F.broadcast if small else lambda df: df

    # Candidates carry the words around them, so the text need not be joined again.
    # explode_outer: for explode, Catalyst would add a filter on the array's size below, and compute the array twice.
    spots = _fingerprints(rows, window, gram).select("doc_id", "row", "words", F.explode_outer("prints").alias("p")).filter("p IS NOT NULL")
    spots = spots.withColumns({"fp": F.shiftright("p", POS_BITS), "at": F.col("p").bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int")})
    low = F.greatest(F.col("at") - (window - gram), F.lit(0))
    around = ["doc_id", "row", "fp", low.alias("low"), F.least(F.col("at"), F.size("words") - window).alias("high"), F.slice("words", low + 1, F.lit(2 * window)).alias("words")]
    if small:
        spots = spots.join(sent(prints), "fp", "left_semi").select(*around)
    else:
        spots = spots.select(*around).join(prints, "fp", "left_semi")
    hits = spots.withColumn("s", F.explode(F.sequence("low", "high"))).select("doc_id", "row", "s", _window(F.col("s") - F.col("low"), window).alias("key")).distinct()
    columns = ["doc_id", "row", "s", "len", "items"]
    marks = hits.withColumn("len", F.lit(window)).join(sent(windows.filter(F.col("len") == window).select("key", "items")), "key").select(*columns)
    if any(n < window for n in lengths):
        short = windows.filter(F.col("len") < window)
        firsts = short.select("first", "len").distinct()
        near = rows.select("doc_id", "row", "words", F.posexplode("words").alias("s", "first"))
        if not small:  # a window's words go along instead of the whole text's
            near = near.select("doc_id", "row", F.slice("words", F.col("s") + 1, window - 1).alias("words"), "s", "first")
        begin = F.col("s") if small else F.lit(0)
        near = near.join(sent(firsts), "first").filter(begin + F.col("len") <= F.size("words")).select("doc_id", "row", "s", "len", _window(begin, F.col("len")).alias("key"))
        marks = marks.union(near.join(sent(short.select("len", "key", "items")), ["len", "key"]).select(*columns))

    marks = marks.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("s", "len"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    end = lambda x: x["s"] + x["len"]
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, x: F.struct(F.greatest(a["end"], end(x)).alias("end"), (a["n"] + F.greatest(F.lit(0), end(x) - F.greatest(a["end"], x["s"]))).alias("n")), lambda a: a["n"])
    marks = marks.select(F.col("doc_id").alias("id"), F.col("row").alias("r"), covered.cast("long").alias("n_hit"), "items")
    out = rows.select("doc_id", "row", F.size("words").cast("long").alias("n_words")).join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r")), "left")
    out = out.select("doc_id", *["row"] * with_row, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
