"""Views of the driver's tables in the shapes the operators take, one text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = """
WITH t AS (SELECT conv_id, turn, role, 300+(length(text)%97)*60 AS dur, (((conv_id*31+turn*17)%11)-3)*400 AS gap FROM {conversations} WHERE role IN ('user','assistant')),
u AS (SELECT *, GREATEST(CAST(0 AS BIGINT), CAST(1500 + SUM(dur+gap) OVER (PARTITION BY conv_id ORDER BY turn) - dur AS BIGINT)) AS ms FROM t)
SELECT conv_id AS call_id, turn AS turn_id, CASE WHEN role='user' THEN 0 ELSE 1 END AS channel, ms/1e3 AS s, (ms+dur)/1e3 AS e FROM u"""
CALLS = "SELECT call_id, MAX(e)+((call_id%5)*0.7e0) AS dur FROM {turns} GROUP BY call_id"
TURNS_B = """SELECT call_id, turn_id, channel, s+((turn_id*13)%5-2)*0.05e0 AS s, e+((turn_id*13)%5-2)*0.05e0 AS e FROM {turns} WHERE (call_id*7+turn_id)%17<>0"""
EVENTS = """
SELECT ts, CAST(event_id AS STRING) AS request_id, CASE WHEN event_id%4=0 THEN '' ELSE concat('call-',CAST(user_id AS STRING)) END AS call_id,
 event_type='error' AS is_synthetic, 0.5e0+((event_id*37)%500)/1e3 AS confidence,
 CASE WHEN event_type='error' THEN 0.5e0+((event_id*37)%500)/1e3 ELSE 0.5e0-((event_id*37)%500)/1e3 END AS p_synthetic,
 CAST(FLOOR(value*10e0) AS INT) AS latency_ms, CASE WHEN event_id%50=0 THEN 'fallback' ELSE 'ok' END AS outcome, event_type AS route,
 event_id%3=0 AS semantic_available, concat('m-',CAST(user_id%3 AS STRING)) AS model_version, 60e0+(user_id*13)%220 AS duration_s FROM {events}"""
SCORED = """
SELECT d.doc_id AS call_id, CASE WHEN l.toxic=1 THEN 'synthetic' ELSE 'human' END AS label, l.toxic AS y, CASE WHEN d.doc_id%5=0 THEN 'val' ELSE 'train' END AS split,
 (((d.doc_id*7919)%600)+350*l.toxic+25)/1e3 AS score, 60e0+(d.n_chars%220) AS duration_s, ((d.doc_id*31)%100)/1e2 AS invention
FROM {labels} l JOIN {documents} d ON l.doc_id=d.doc_id"""
ANSWERS = """
SELECT doc_id AS call_id, CASE WHEN doc_id%3=0 THEN 'synthetic' ELSE 'human' END AS label, CASE doc_id%13 WHEN 0 THEN concat('no tengo esa cuenta',' ',text) WHEN 1 THEN concat('no cuento con eso',' ',text) WHEN 2 THEN concat('no sé, no me acuerdo',' ',text)
 WHEN 3 THEN concat('no me aparece ninguna',' ',text) WHEN 4 THEN concat('creo que sí tengo algo',' ',text) WHEN 5 THEN concat('no estoy seguro, tal vez',' ',text) WHEN 6 THEN concat('sí, tengo la nómina plus',' ',text)
 WHEN 7 THEN concat('mi crédito verde está activo',' ',text) WHEN 8 THEN concat('el número es 4 5 6 7 8 9',' ',text) WHEN 9 THEN concat('me llamo Roberto Sánchez',' ',text) WHEN 10 THEN concat('¿cuál es? no entiendo',' ',text)
 WHEN 11 THEN concat('buenos días como esta',' ',text) ELSE text END AS text FROM {documents}"""
#: db values are exact halves of float32 numbers in both engines.
FRAMES_DUCK = """
SELECT CAST(FLOOR(vec_id/2e0) AS BIGINT) AS call_id, CAST(vec_id%2 AS INT) AS channel, i-1 AS i, 20e0*CAST(embedding[i] AS DOUBLE) AS db
FROM (SELECT vec_id, embedding, unnest(range(1,len(embedding)+1)) AS i FROM embeddings)"""
FRAMES = """
SELECT CAST(FLOOR(vec_id/2e0) AS BIGINT) AS call_id, CAST(vec_id%2 AS INT) AS channel, CAST(pos AS BIGINT) AS i, 20e0*CAST(x AS DOUBLE) AS db
FROM {embeddings} LATERAL VIEW posexplode(embedding) p AS pos, x"""
REQUESTS = """
SELECT doc_id AS call_id, concat('{{"call_id":"',CAST(doc_id AS STRING),'","', CASE doc_id%9 WHEN 0 THEN 'audio' WHEN 1 THEN 'wav' WHEN 2 THEN 'data' WHEN 3 THEN 'file' WHEN 4 THEN 'clip' WHEN 5 THEN 'content'
 WHEN 6 THEN 'unexpected' ELSE 'audio_base64' END,'":"', CASE WHEN doc_id%5=0 THEN 'data:audio/wav;base64,' ELSE '' END, {b64}, '"}}') AS body FROM {documents} WHERE doc_id%11<>3
 UNION ALL SELECT doc_id, concat('RIFFsizeWAVE', text) FROM {documents} WHERE doc_id%11=3 AND doc_id%2=1
 UNION ALL SELECT doc_id, concat('{{"audio_base64":{{"a":1}},"audio":7,"clip":"', {b64}, '"}}') FROM {documents} WHERE doc_id%11=3 AND doc_id%2=0"""

_NEEDS = {
    "turns": (TURNS, ("conversations",)), "calls": (CALLS, ("turns",)), "turns_b": (TURNS_B, ("turns",)), "detections": (EVENTS, ("events",)),
    "scored": (SCORED, ("labels", "documents")), "answers": (ANSWERS, ("documents",)), "frames": (FRAMES, ("embeddings",)),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "requests":
        b64 = "replace(base64(CAST(text AS BINARY)), concat(chr(13),chr(10)), '')"
        return spark.sql(REQUESTS.replace("{b64}", b64), documents=view(spark, sf_dir, "documents"))
    if name not in _NEEDS:
        out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "events":
            out = out.withColumn("ts", F.col("ts").cast("timestamp"))
        return out
    text, needs = _NEEDS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in needs})


def oracle(views: str, body: str) -> str:
    """DuckDB SQL with the named views first; ``body`` begins with SELECT or with further common tables."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name == "requests":
            done[name] = REQUESTS.replace("{b64}", "to_base64(encode(text))").replace("{{", "{").replace("}}", "}").replace("{documents}", "documents")
        elif name == "frames":
            done[name] = FRAMES_DUCK
        elif name in _NEEDS and name not in done:
            text, needs = _NEEDS[name]
            for n in needs:
                add(n)
            done[name] = text.replace("CAST(event_id AS STRING)", "CAST(event_id AS VARCHAR)").replace("{", "").replace("}", "")

    for name in views.split():
        add(name)
    tables = ", ".join(f"{n} AS ({t})" for n, t in done.items())
    rest = body.strip()
    return f"WITH {tables}" + (f" {rest}" if rest.upper().startswith("SELECT") else f", {rest}")


def recursive(sql: str) -> str:
    """The same SQL, whose common tables may name themselves."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)
