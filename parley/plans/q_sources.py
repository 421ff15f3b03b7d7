"""Queries on sinks and sources by reading back what was written, and on cross-validated gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import calibrate as ca
from parley.operators import evaluate as evl
from parley.operators import ml
from parley.plans.q_evaluate import CM, THR, scored
from parley.plans.q_intervals import FEATURES, features
from parley.plans.q_monitor import as_us, detections
from parley.plans.q_signal import KINDS, SEM, _semantic
from parley.plans.registry import query, rounded, shared
from parley.plans.views import oracle, view
from parley.sources import readers as rd
from parley.sources import sinks as sk


@query(oracle("scored", "SELECT CAST(call_id AS VARCHAR) AS call_id, label, split, duration_s FROM scored"))
def read_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared(spark)}/manifest"
    scored(spark, sf_dir).select(F.col("call_id").cast("string"), "label", "split", "duration_s").write.csv(path, header=True)
    return rd.read_manifest(spark, path)


@query(oracle("turns calls", f"{FEATURES} SELECT call_id, round(resp_latency_mean, 6) + 0e0 AS resp_latency_mean, turn_count_caller FROM f WHERE call_id%5=0"))
def write_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared(spark)}/features"
    table = features(spark, sf_dir).withColumn("split", F.when(F.col("call_id") % 5 == 0, "val").otherwise("train"))
    for source in ("ref", "vad"):
        sk.write_feature_table(table, path, source)
    return rounded(rd.read_split(spark.read.parquet(path), "val").filter("source = 'vad'").select("call_id", "resp_latency_mean", "turn_count_caller"))


@query(oracle("answers", f"{KINDS}, {SEM} SELECT call_id, model, coalesce(answer_type, '') AS answer_type, coalesce(invention, 0.5e0) AS invention_score FROM sv"))
def write_scores_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared(spark)}/scores"
    sk.write_scores_csv(_semantic(spark, sf_dir).select("call_id", "model", "answer_type", "invention_score"), path)
    return spark.read.schema("call_id bigint, model string, answer_type string, invention_score double").option("emptyValue", "").csv(path, header=True).fillna({"answer_type": ""})


@query(oracle("detections", "SELECT epoch_us(date_trunc('day', ts)) AS day, count(*) AS n, CAST(sum(latency_ms) AS BIGINT) AS ms FROM detections GROUP BY 1"))
def write_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared(spark)}/events"
    sk.write_events(detections(spark, sf_dir), path)
    back = spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("ms"))
    return as_us(back.withColumn("day", F.col("day").cast("timestamp")), "day")


@query(oracle("scored", f"{CM}, b AS (SELECT round(avg((score-y)*(score-y)), 6) + 0e0 AS brier FROM scored) SELECT tp, fp, tn, fn, brier FROM cm, b"))
def export_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = sk.export_metrics([evl.confusion(scored(spark, sf_dir), THR), evl.brier(scored(spark, sf_dir))], required=("tp", "fp", "tn", "fn", "brier"))
    return rounded(record.select(F.from_json("record", "tp bigint, fp bigint, tn bigint, fn bigint, brier double").alias("r")).select("r.*"))


@query(oracle("scored", """SELECT score>=0.5e0 AS is_synthetic, greatest(score, 1-score) AS confidence, duration_s/100 AS latency_s, CAST(call_id AS VARCHAR) AS call_id, label
 FROM scored"""))
def read_check_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results files of up to 1000 ids each, written and read back."""
    path = f"{shared(spark)}/results"
    one = F.struct((F.col("score") >= 0.5).alias("is_synthetic"), F.greatest("score", 1 - F.col("score")).alias("confidence"), (F.col("duration_s") / 100).alias("latency_s"), F.col("call_id").cast("string").alias("call_id"), "label")
    files = scored(spark, sf_dir).groupBy(F.floor(F.col("call_id") / 1000).alias("file")).agg(F.struct(F.count(F.lit(1)).alias("n")).alias("summary"), F.collect_list(one).alias("results"))
    files.write.option("maxRecordsPerFile", 1).json(path)
    return rd.read_check_results(spark, path)


FOLDS = """fd AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY label ORDER BY (call_id*7919)%10007, call_id)-1)%3 AS fold FROM scored WHERE split='train'),
au AS (SELECT a.fold, sum(CASE WHEN a.score>b.score THEN 1e0 WHEN a.score=b.score THEN 0.5e0 ELSE 0e0 END)/count(*) AS auc FROM fd a JOIN fd b ON a.fold=b.fold
 AND a.y=1 AND b.y=0 GROUP BY a.fold),
cv AS (SELECT avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc FROM au), va AS (SELECT sum(CASE WHEN a.score>b.score THEN 1e0 WHEN a.score=b.score THEN 0.5e0
 ELSE 0e0 END)/count(*) AS auc FROM scored a, scored b WHERE a.split='val' AND b.split='val' AND a.y=1 AND b.y=0)"""


def _cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = rd.read_split(scored(spark, sf_dir), "train")
    folds = ca.stratified_folds(train, 3, (F.col("call_id") * 7919) % 10007)
    return ml.cross_validate(evl.auc_rank(folds, ("fold",)).withColumn("best_round", F.lit(1)))


@query(oracle("scored", f"""{FOLDS}, im AS (SELECT source AS feature, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 5)
SELECT round(mean_auc, 6) + 0e0 AS mean_auc, mean_auc>0.6e0 AS suspicious, CASE WHEN mean_auc>0.6e0 THEN (SELECT string_agg(feature, ','
 ORDER BY n DESC, feature) FROM im) ELSE '' END AS top_features, mean_auc>0.6e0 AS refused FROM cv"""))
def audit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source stand for importances; the limit is one that the scores exceed."""
    sizes = view(spark, sf_dir, "documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("feature")).agg(F.count(F.lit(1)).alias("importance"))
    return rounded(ml.audit_gate(_cv(spark, sf_dir), sizes, 0.6))


_BA = "(avg(CASE WHEN y=1 THEN (CASE WHEN score>=0.42e0 THEN 1e0 ELSE 0e0 END) END)+avg(CASE WHEN y=0 THEN (CASE WHEN score<0.42e0 THEN 1e0 ELSE 0e0 END) END))/2e0"


@query(oracle("scored", f"""{FOLDS}, bt AS (SELECT {_BA} AS a FROM scored WHERE split='train'), bv AS (SELECT {_BA} AS b FROM scored WHERE split='val')
 SELECT round(mean_auc-auc, 6) + 0e0 AS gap, round(a-b, 6) + 0e0 AS ba_gap FROM cv, va, bt, bv"""))
def cv_val_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = (rd.read_split(scored(spark, sf_dir), x) for x in ("train", "val"))
    return rounded(ml.cv_val_gap(_cv(spark, sf_dir), evl.auc_rank(val), evl.confusion(train, THR), evl.confusion(val, THR)))
