"""The queries opN_* over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.chat import format_chats, read_back
from parley.llm.common import table
from parley.llm.decontaminate import decontaminate
from parley.llm.exact_dedup import exact_dedup
from parley.llm.line_dedup import line_dedup
from parley.llm.mixing import mix_sources
from parley.llm.near_dedup import near_dedup
from parley.llm.periodic_runs import periodic_runs
from parley.llm.pii import KINDS, find_pii
from parley.llm.quality import score_quality
from parley.llm.repair import OUT, damage, repair
from parley.llm.substring_dedup import substring_dedup
from parley.llm.top_k import top_k, usable
from parley.llm.toxicity import score_toxicity


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    chats = read_back(format_chats(turns))
    said = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("row")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = find_pii(docs)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    spans = spans.select("doc_id", "row", F.struct(order[F.col("kind")].alias("o"), "start", "end", "kind").alias("s"), "base", "kind")
    listed = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    spans = spans.groupBy("doc_id", "row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.collect_list(F.when(F.col("base"), F.col("s")))), 256).alias("base_sha256"), listed(F.collect_list("s")).alias("spans"),
    ).withColumnsRenamed({"doc_id": "id", "row": "r"})
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    out = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r")), "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents the words from some place on repeat a stretch, all by crc32 of doc_id; null doc_ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")
    rows = rows.withColumn("a", a).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    told = F.expr("concat(slice(words, 1, a), transform(sequence(0, n - a - 1), k -> words[a + k % p]))")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(told, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic_runs(with_planted_period(table(spark, sf_dir, "documents")))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    out = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("").alias("told"), "collapsed_text")
    start, length, period = -F.col("b.s"), F.col("b.length"), -F.col("b.p")
    return out.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2("told", 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter("vec_id % 50 = 0"), vectors)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repair(damage(turns)).withColumnRenamed("conv_id", "id")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select("conv_id", *(F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in OUT))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_line_dedup, op2_chat_format, op3_exact_dedup, op4_toxicity, op5_mixing, op6_decontaminate, op7_substring_dedup, op8_simhash_dedup, op9_pii, op10_quality, op11_periodic_runs, op12_exact_top_k, op13_conversation_repair)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = rf"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM t),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOW}) AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.holder AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""

_MARKS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPED = "replace({0}, chr(92), chr(92) || 'b')"
for _m in _MARKS:
    _ESCAPED = f"replace({_ESCAPED}, '{_m}', chr(92) || 'x')"

OP2 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum(12 + length({_ESCAPED.format("role")}) + 1 + length({_ESCAPED.format("text")}) + 11) AS BIGINT) AS formatted_chars,
  string_agg(role, ' ' ORDER BY turn, role, text) AS roles FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
 regexp_full_match(roles, '(system )?(user assistant )*user assistant') AS valid FROM g
"""

OP3 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256 FROM t WINDOW w AS (PARTITION BY text)
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOW}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOW}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT item_id, least(len(ws), 13) AS n, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS s, ws FROM b WHERE len(ws) > 0),
bk AS (SELECT DISTINCT item_id, n, array_to_string(ws[s : s + n - 1], ' ') AS key FROM bw),
lens AS (SELECT DISTINCT n FROM bk),
dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS s, ws FROM d, lens WHERE len(ws) >= n),
dk AS (SELECT doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') AS key FROM dw),
h AS (SELECT dk.doc_id, dk.s, dk.n, bk.item_id FROM dk JOIN bk ON dk.n = bk.n AND dk.key = bk.key),
w AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN w ON d.doc_id = w.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

OP7 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS s, ws FROM d WHERE len(ws) >= 50),
k AS (SELECT doc_id, s, sha256(array_to_string(ws[s : s + 49], ' ')) AS key FROM s),
m AS (SELECT key, min(doc_id) AS low FROM k GROUP BY key),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM k JOIN m ON k.key = m.key WHERE doc_id > low),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
r AS (SELECT w.doc_id, count(*) AS n_words, count(g.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL), '') AS kept
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


OP12 = """
WITH t AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM t AS q JOIN t AS c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

# crc32 bit by bit over the bytes of the key; then, for each number of rows passed and each state, the cheapest edits so far.
OP13 = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, c: list_reduce(list_prepend(xor(crc, c), CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, (VALUES (1), (2)) AS copies(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
told AS (SELECT *, CASE WHEN rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
  WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS step FROM numbered),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE step NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM told GROUP BY conv_id),
-- Edits by state: what may be inserted before a row (up to twice), then what is done with it.
inserts(s, s1, letters, cost, added) AS (SELECT s, s, '', 0, CAST([] AS VARCHAR[]) FROM range(4) AS r(s)
  UNION ALL SELECT s, CASE WHEN s = 2 THEN 3 ELSE 2 END, 'I', 3, [CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END] FROM range(4) AS r(s)
  UNION ALL SELECT s, CASE WHEN s = 2 THEN 2 ELSE 3 END, 'II', 6, CASE WHEN s = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END FROM range(4) AS r(s)),
rows_at AS (SELECT conv_id, pos, 'D' AS letter, s, s AS s2, 4 AS cost, NULL AS turn_text FROM told, range(4) AS r(s)
  UNION ALL SELECT conv_id, pos, 'K', s, s2, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, role || ':' || text
  FROM told JOIN (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS k(s, initial, s2) ON left(role, 1) = initial WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, pos, 'R', s, CASE WHEN s = 2 THEN 3 ELSE 2 END, 3 + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || text
  FROM told, range(4) AS r(s) WHERE fault IN ('', 'truncated')),
steps AS (SELECT conv_id, pos, i.s, r.s2, i.letters || r.letter AS letters, i.cost + r.cost AS cost, CASE WHEN turn_text IS NULL THEN added ELSE list_append(added, turn_text) END AS added
  FROM rows_at AS r JOIN inserts AS i ON i.s1 = r.s),
ways(conv_id, pos, s, cost, audit, said) AS (SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM counts
  UNION ALL SELECT conv_id, pos, s, cost, audit, said FROM (SELECT w.conv_id, t.pos, t.s2 AS s, w.cost + t.cost AS cost, w.audit || t.letters AS audit, list_concat(w.said, t.added) AS said,
    row_number() OVER (PARTITION BY w.conv_id, t.s2 ORDER BY w.cost + t.cost, w.audit || t.letters) AS place
    FROM ways AS w JOIN steps AS t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1 AND t.s = w.s) WHERE place = 1),
ends AS (SELECT w.conv_id, w.cost + i.cost AS cost, w.audit || i.letters AS audit, list_concat(w.said, i.added) AS said, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + i.cost, w.audit || i.letters) AS place
  FROM ways AS w JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = c.n JOIN inserts AS i ON i.s = w.s AND i.s1 IN (0, 3))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(CAST(e.cost AS BIGINT), 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends AS e ON e.conv_id IS NOT DISTINCT FROM o.conv_id AND e.place = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op2_chat_format": OP2, "op3_exact_dedup": OP3, "op6_decontaminate": OP6, "op7_substring_dedup": OP7, "op12_exact_top_k": OP12, "op13_conversation_repair": OP13}
