"""Queries on evaluation, calibration, gates and training."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import calibrate as ca
from parley.operators import evaluate as evl
from parley.operators import gates as ga
from parley.operators.features import CONTRACT, extract_features
from parley.plans.q_intervals import _LONG, FEATURES, OV, rounding
from parley.plans.registry import query, rounded
from parley.plans.views import oracle, recursive, view
from parley.sources.readers import read_split as keep_split

THR = 0.42
BANDS = [(60, 120), (120, 180), (180, 280)]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scored")


@query(oracle("scored", "SELECT call_id, y, split FROM scored WHERE split = 'train'"))
def read_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_split(scored(spark, sf_dir), "train").select("call_id", "y", "split")


CM = """cm AS (SELECT CAST(sum(CASE WHEN score>=0.42e0 AND y=1 THEN 1 ELSE 0 END) AS BIGINT) tp, CAST(sum(CASE WHEN score>=0.42e0 AND y=0 THEN 1
 ELSE 0 END) AS BIGINT) fp,
 CAST(sum(CASE WHEN score<0.42e0 AND y=0 THEN 1 ELSE 0 END) AS BIGINT) tn, CAST(sum(CASE WHEN score<0.42e0 AND y=1 THEN 1 ELSE 0 END) AS BIGINT) fn
 FROM scored)"""


@query(oracle("scored", f"""{CM}, q AS (SELECT *, (tp+0e0)/(tp+fn) tpr, (tn+0e0)/(tn+fp) tnr, (tp+tn+0e0)/(tp+tn+fp+fn) accuracy FROM cm)
 SELECT tp, fp, tn, fn, {rounding('tpr tnr accuracy')}, round((tpr+tnr)/2e0, 6) + 0e0 AS balanced_accuracy, 3*fp+fn AS cost FROM q"""))
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evl.confusion(scored(spark, sf_dir), THR))


@query(oracle("scored", """SELECT round(t, 6) + 0e0 AS threshold, round((avg(CASE WHEN y=1 THEN (CASE WHEN score>=t THEN 1e0 ELSE 0e0 END) END) + avg(CASE WHEN y=0 THEN (CASE
 WHEN score<t THEN 1e0 ELSE 0e0 END) END))/2e0, 6) + 0e0 AS balanced_accuracy FROM scored, (SELECT unnest([0.42e0+(-0.05e0), 0.42e0, 0.42e0+0.05e0]) AS t)
 GROUP BY t"""))
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evl.sensitivity(scored(spark, sf_dir), THR))


ROC = """c AS (SELECT score, sum(CASE WHEN y=1 THEN 1 ELSE 0 END) pos, sum(CASE WHEN y=0 THEN 1 ELSE 0 END) neg FROM scored GROUP BY score),
s AS (SELECT score, pos, neg, sum(pos) OVER w tp, sum(neg) OVER w fp, sum(pos) OVER () ap, sum(neg) OVER () an, lag(score) OVER (ORDER BY score DESC) pv,
 lead(pos) OVER (ORDER BY score DESC) np, lead(neg) OVER (ORDER BY score DESC) nn FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
roc AS (SELECT (fp+0e0)/an AS fpr, (tp+0e0)/ap AS tpr, score AS threshold FROM s WHERE pv IS NULL OR np IS NULL OR pos<>np OR neg<>nn UNION ALL
 SELECT 0e0, 0e0, NULL)"""


@query(oracle("scored", f"{ROC} SELECT {rounding('fpr tpr threshold')} FROM roc"))
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evl.roc_curve(scored(spark, sf_dir)))


@query(oracle("scored", f"{ROC} SELECT round((fpr+1-tpr)/2e0, 6) + 0e0 AS eer FROM roc ORDER BY abs(1-tpr-fpr), fpr, tpr LIMIT 1"))
def eer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evl.eer(scored(spark, sf_dir)))


AUC = """SELECT round(sum(CASE WHEN a.score>b.score THEN 1e0 WHEN a.score=b.score THEN 0.5e0 ELSE 0e0 END)/count(*), 6) + 0e0 AS auc FROM scored a, scored b
 WHERE a.y=1 AND b.y=0"""


@query(oracle("scored", AUC))
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evl.auc_rank(scored(spark, sf_dir)))


@query(oracle("scored", "SELECT round(avg((score-y)*(score-y)), 6) + 0e0 AS brier FROM scored"))
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evl.brier(scored(spark, sf_dir)))


REL = """t AS (SELECT b AS bin, count(score) n, coalesce(avg(score),0e0) mean_score, coalesce(avg(y),0e0) share FROM (SELECT unnest(range(0,10)) AS b) LEFT
 JOIN scored ON b=CAST(least(floor(score*10),9) AS BIGINT) GROUP BY b)"""


@query(oracle("scored", f"{REL} SELECT bin, n, {rounding('mean_score share')} FROM t"))
def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evl.reliability_table(scored(spark, sf_dir)))


@query(oracle("scored", f"{REL} SELECT round(sum(n*abs(mean_score-share))/sum(n), 6) + 0e0 AS ece FROM t"))
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evl.ece(scored(spark, sf_dir)))


@query(oracle("scored", """b AS (SELECT * FROM (VALUES (60e0,120e0),(120e0,180e0),(180e0,280e0)) v(lo,hi)) SELECT lo, hi, count(y) AS n, round(coalesce(avg(CASE
 WHEN (score>=0.42e0)<>(y=1) THEN 1e0 ELSE 0e0 END) FILTER (WHERE y IS NOT NULL),0e0), 6) + 0e0 AS error FROM b LEFT JOIN scored ON duration_s>=lo
 AND duration_s<hi GROUP BY lo, hi"""))
def error_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evl.error_by_band(scored(spark, sf_dir), THR, BANDS))


@query(oracle("scored", """c AS (SELECT DISTINCT score AS t FROM scored UNION ALL SELECT max(score)+1e-9 FROM scored),
m AS (SELECT t, sum(CASE WHEN y=1 AND score>=t THEN 1 ELSE 0 END) tp, sum(CASE WHEN y=0 AND score<t THEN 1 ELSE 0 END) tn, sum(CASE WHEN y=1 THEN 1
 ELSE 0 END) p, sum(CASE WHEN y=0 THEN 1 ELSE 0 END) n FROM scored, c GROUP BY t)
SELECT round(t, 6) + 0e0 AS threshold, round((tp/(p+0e0)+tn/(n+0e0))/2e0, 6) + 0e0 AS balanced_accuracy, CAST(3*(n-tn)+(p-tp) AS BIGINT) AS cost FROM m
 ORDER BY tp*n+tn*p DESC, 3*(n-tn)+(p-tp), t LIMIT 1"""))
def select_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evl.select_threshold(scored(spark, sf_dir)))


@query(oracle("scored", """b AS (SELECT split, (avg(CASE WHEN y=1 THEN (CASE WHEN score>=0.42e0 THEN 1e0 ELSE 0e0 END) END) + avg(CASE WHEN y=0 THEN (CASE WHEN score<0.42e0 THEN 1e0
 ELSE 0e0 END) END))/2e0 AS ba FROM scored GROUP BY split)
 SELECT round(x.ba, 6) + 0e0 AS x, round(z.ba, 6) + 0e0 AS y, round(abs(x.ba-z.ba), 6) + 0e0 AS difference, abs(x.ba-z.ba)<=0.01e0 AS agrees FROM b x, b z
 WHERE x.split='train' AND z.split='val'"""))
def cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (evl.confusion(keep_split(scored(spark, sf_dir), s), THR) for s in ("train", "val"))
    return rounded(evl.cross_check(a, b))


@query(oracle("scored", """SELECT model AS engine, count(*) AS n, CAST(sum(CASE WHEN (y=1)=(score>=0.42e0) THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE
 WHEN (y=1)=(score>=0.42e0) THEN 1e0 ELSE 0e0 END), 6) + 0e0 AS hit_rate FROM (SELECT *, CASE WHEN call_id%2=0 THEN 'a' ELSE 'b' END AS model FROM scored)
 GROUP BY model"""))
def redteam_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select(F.when(F.col("call_id") % 2 == 0, "a").otherwise("b").alias("engine"), (F.col("y") == 1).alias("expected"), (F.col("score") >= THR).alias("verdict"))
    return rounded(evl.redteam_eval(rows))


@query(oracle("scored", """SELECT round(coalesce(sum(CASE WHEN y=0 THEN 1e0 ELSE 0e0 END)/nullif(sum(CASE WHEN y=1 THEN 1e0 ELSE 0e0 END),0), 1e0), 6) + 0e0 AS weight FROM scored
 WHERE split='train'"""))
def class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ca.class_weight(keep_split(scored(spark, sf_dir), "train")))


@query(oracle("scored", "SELECT call_id, label, CAST((ROW_NUMBER() OVER (PARTITION BY label ORDER BY (call_id*7919)%10007, call_id)-1)%5 AS INT) AS fold FROM scored"))
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.stratified_folds(scored(spark, sf_dir), 5, (F.col("call_id") * 7919) % 10007).select("call_id", "label", F.col("fold").cast("int").alias("fold"))


@query(oracle("scored", "SELECT call_id, round(1/(1+exp(-6.1e0*score+3.4e0)), 6) + 0e0 AS p FROM scored"))
def platt_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).select("call_id", ca.platt_apply(F.col("score"), -6.1, 3.4).alias("p")))


@query(recursive(oracle("scored", """n AS (SELECT sum(y)+0e0 AS p, count(*)-sum(y)+0e0 AS n FROM scored),
d AS (SELECT score AS x, CASE WHEN y=1 THEN (p+1)/(p+2) ELSE 1/(n+2) END AS t FROM scored, n),
s(it, a, b) AS (SELECT 0, 0e0, ln((n+1)/(p+1)) FROM n UNION ALL
 SELECT it+1, a-(h3*g1-h2*g2)/(h1*h3-h2*h2), b-(h1*g2-h2*g1)/(h1*h3-h2*h2)
 FROM (SELECT it, a, b, sum((t-q)*x) AS g1, sum(t-q) AS g2, sum(q*(1-q)*x*x) AS h1, sum(q*(1-q)*x) AS h2, sum(q*(1-q)) AS h3
  FROM (SELECT it, a, b, x, t, 1/(1+exp(a*x+b)) AS q FROM s, d WHERE it<25) GROUP BY it, a, b))
SELECT call_id, round(1/(1+exp(a*score+b)), 4) + 0e0 AS p FROM scored, s WHERE it=25""")))
def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newton's method in the other engine."""
    rows = scored(spark, sf_dir)
    a, b = ca.platt_fit(rows)
    return rounded(rows.select("call_id", ca.platt_apply(F.col("score"), a, b).alias("p")), 4)


@query(oracle("scored", """g AS (SELECT score, sum(y)+0e0 AS sy, count(*)+0e0 AS n FROM scored GROUP BY score),
p AS (SELECT score, sy, n, ROW_NUMBER() OVER w AS k, sum(sy) OVER w AS cy, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY score)),
ab AS (SELECT a.k AS a, b.k AS b, (b.cy-a.cy+a.sy)/(b.cn-a.cn+a.n) AS m FROM p a JOIN p b ON a.k<=b.k),
lo AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS v FROM ab), ft AS (SELECT b AS k, max(v) AS v FROM lo GROUP BY b)
SELECT call_id, round(v, 6) + 0e0 AS p FROM scored s JOIN p ON s.score=p.score JOIN ft ON ft.k=p.k"""))
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return rounded(ca.isotonic_fit(rows).transform(rows).select("call_id", F.col("prediction").alias("p")))


FUSED = "greatest(0e0, least(1e0, greatest(p-1e0, least(p+1e0, 1/(1+exp(-(ln(c/(1-c)) + {w}*(invention-0.5e0))))))))"
CLIP = "k AS (SELECT *, score AS p, greatest(1e-6, least(1-1e-6, score)) AS c FROM scored)"


@query(oracle("scored", f"{CLIP} SELECT call_id, round({FUSED.format(w='0.8e0')}, 6) + 0e0 AS p FROM k"))
def fuse_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).select("call_id", ca.fuse_probability(F.col("score"), F.col("invention"), 0.8).alias("p")))


GRID = f"""{CLIP}, f AS (SELECT y, w, {FUSED.format(w='w')}>=0.42e0 AS yes FROM k, (SELECT unnest(range(-80,81))/20e0 AS w)),
g AS (SELECT w, sum(CASE WHEN yes AND y=1 THEN 1 ELSE 0 END) tp, sum(CASE WHEN NOT yes AND y=0 THEN 1 ELSE 0 END) tn, sum(CASE WHEN y=1 THEN 1
 ELSE 0 END) np, sum(CASE WHEN y=0 THEN 1 ELSE 0 END) nn FROM f GROUP BY w)"""


@query(oracle("scored", f"{GRID} SELECT round(w, 6) + 0e0 AS w, round((tp/(np+0e0)+tn/(nn+0e0))/2e0, 6) + 0e0 AS balanced_accuracy FROM g ORDER BY tp*nn+tn*np DESC, w LIMIT 1"))
def select_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ca.select_w(scored(spark, sf_dir).withColumn("p", F.col("score")), THR))


@query(oracle("scored", f"""{CLIP}, f AS (SELECT y, p, {FUSED.format(w='(-0.8e0)')} AS q FROM k),
m AS (SELECT (avg(CASE WHEN y=1 THEN (CASE WHEN p>=0.42e0 THEN 1e0 ELSE 0e0 END) END)+avg(CASE WHEN y=0 THEN (CASE WHEN p<0.42e0 THEN 1e0
 ELSE 0e0 END) END))/2e0 AS ba_base,
 (avg(CASE WHEN y=1 THEN (CASE WHEN q>=0.42e0 THEN 1e0 ELSE 0e0 END) END)+avg(CASE WHEN y=0 THEN (CASE WHEN q<0.42e0 THEN 1e0
 ELSE 0e0 END) END))/2e0 AS ba_fused,
 avg((p-y)*(p-y)) AS brier_base, avg((q-y)*(q-y)) AS brier_fused, avg(CASE WHEN (p>=0.42e0)<>(q>=0.42e0) THEN 1e0 ELSE 0e0 END) AS flips FROM f),
u AS (SELECT avg(CASE WHEN a.p>b.p THEN 1e0 WHEN a.p=b.p THEN 0.5e0 ELSE 0e0 END) AS auc_base, avg(CASE WHEN a.q>b.q THEN 1e0 WHEN a.q=b.q THEN 0.5e0
 ELSE 0e0 END) AS auc_f FROM f a, f b WHERE a.y=1 AND b.y=0),
o AS (SELECT ba_base, auc_base, brier_base, CASE WHEN ba_fused>ba_base THEN ba_fused ELSE ba_base END AS ba_fused, CASE WHEN ba_fused>ba_base THEN auc_f
 ELSE auc_base END AS auc_fused,
 CASE WHEN ba_fused>ba_base THEN brier_fused ELSE brier_base END AS brier_fused, CASE WHEN ba_fused>ba_base THEN flips ELSE 0e0 END AS flips, CASE
 WHEN ba_fused>ba_base THEN -0.8e0 ELSE 0e0 END AS w FROM m, u)
SELECT {rounding('ba_base auc_base brier_base ba_fused auc_fused brier_fused flips')}, w FROM o"""))
def fusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ca.fusion_report(scored(spark, sf_dir).withColumn("p", F.col("score")), THR, -0.8))


@query(oracle("scored", """SELECT d.doc_id AS call_id, coalesce(invention, 0.5e0) AS invention, coalesce(score>0.5e0, FALSE) AS probe_detected FROM documents d LEFT
 JOIN scored s ON d.doc_id=s.call_id"""))
def merge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = scored(spark, sf_dir).select("call_id", "invention", (F.col("score") > 0.5).alias("probe_detected"))
    return ca.merge_scores(view(spark, sf_dir, "documents").select(F.col("doc_id").alias("call_id")), scores)


@query(oracle("scored", """v AS (SELECT split AS name, avg(score) AS b, split='train' AS is_base FROM scored GROUP BY split) SELECT name FROM v ORDER BY b DESC, is_base DESC LIMIT 1"""))
def choose_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.choose_variant(scored(spark, sf_dir).groupBy(F.col("split").alias("name")).agg(F.avg("score").alias("balanced_accuracy"), F.first(F.col("split") == "train").alias("is_base")))


@query(oracle("scored", "SELECT call_id, round(avg(score+k/1e3), 6) + 0e0 AS score FROM scored, (SELECT unnest(range(0,3)) AS k) GROUP BY call_id"))
def oof_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("call_id", F.explode(F.array(*[F.col("score") + k / 1e3 for k in range(3)])).alias("score"))
    return rounded(ca.oof_average(rows))


@query(oracle("scored", """c AS (SELECT split, CAST(sum(CASE WHEN label='human' THEN 1 ELSE 0 END) AS BIGINT) human, CAST(sum(CASE WHEN label='synthetic' THEN 1
 ELSE 0 END) AS BIGINT) synthetic FROM scored GROUP BY split)
SELECT split, human, synthetic, round(greatest(human,synthetic)/(human+synthetic+0e0), 6) + 0e0 AS majority_share,
 greatest(human,synthetic)/(human+synthetic+0e0)>0.6e0 AS unbalanced, split='train' AND greatest(human,synthetic)/(human+synthetic+0e0)>=0.55e0 AS reweight
 FROM c"""))
def gate_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ga.gate_class_balance(scored(spark, sf_dir)))


def _labelled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "calls").withColumn("label", F.when(F.col("call_id") % 3 == 0, "synthetic").otherwise("human"))


@query(oracle("turns calls", f"""{OV}, n AS (SELECT c.call_id, CASE WHEN c.call_id%3=0 THEN 'synthetic' ELSE 'human' END AS label, count(ov.ai) AS k FROM calls c LEFT
 JOIN ov ON c.call_id=ov.call_id GROUP BY c.call_id)
SELECT label, count(*) AS n, round(avg(CASE WHEN k>0 THEN 1e0 ELSE 0e0 END), 6) + 0e0 AS share, median(k) + 0e0 AS median_events, avg(CASE WHEN k>0 THEN 1e0
 ELSE 0e0 END)<0.4e0 AS sparse FROM n GROUP BY GROUPING SETS ((), (label))"""))
def gate_overlap_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ga.gate_overlap_density(view(spark, sf_dir, "turns"), _labelled_calls(spark, sf_dir)))


@query(oracle("scored", """u AS (SELECT sum(CASE WHEN a.duration_s>b.duration_s THEN 1e0 WHEN a.duration_s=b.duration_s THEN 0.5e0 ELSE 0e0 END)/count(*) AS auc FROM scored a, scored b
 WHERE a.y=1 AND b.y=0),
m AS (SELECT avg(CASE WHEN y=0 THEN duration_s END) AS mean_human, avg(CASE WHEN y=1 THEN duration_s END) AS mean_synthetic, corr(y, duration_s) AS r
 FROM scored)
SELECT round(mean_human, 6) + 0e0 AS mean_human, round(mean_synthetic, 6) + 0e0 AS mean_synthetic, round(r, 6) + 0e0 AS r, round(auc, 6) + 0e0 AS auc,
 round(greatest(auc,1-auc), 6) + 0e0 AS best_auc, greatest(auc,1-auc)>=0.6e0 AS banned FROM m, u"""))
def gate_duration_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ga.gate_duration_leak(scored(spark, sf_dir)))


@query(oracle("scored", """e AS (SELECT min(duration_s) lo, max(duration_s) hi FROM scored)
 SELECT label, CAST(least(floor((duration_s-lo)/(hi-lo)*20),19) AS BIGINT) AS bin, count(*) AS n FROM scored, e GROUP BY 1, 2"""))
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.duration_histogram(scored(spark, sf_dir))


@query(oracle("scored", """a AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score)-1)/2e0 AS x, rank() OVER (ORDER BY duration_s) + (count(*) OVER (PARTITION BY
 duration_s)-1)/2e0 AS y FROM scored) SELECT round(corr(x, y), 6) + 0e0 AS rho FROM a"""))
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ga.spearman(scored(spark, sf_dir), "score", "duration_s"))


@query(oracle("turns calls", f"{FEATURES}, l AS ({_LONG}) SELECT feature, round(avg(value), 6) + 0e0 AS mean, round(stddev_pop(value), 6) + 0e0 AS std FROM l GROUP BY feature"))
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ga.feature_stats(_features(spark, sf_dir)))


def _features(spark: SparkSession, sf_dir: str, turns: str = "turns") -> DataFrame:
    return extract_features(view(spark, sf_dir, turns), view(spark, sf_dir, "calls"))


def _steady(f: DataFrame) -> DataFrame:
    """Rounded, so that equal values tie in any engine."""
    return f.select("call_id", *[(F.round(n, 9) + F.lit(0.0)).alias(n) for n in CONTRACT])


_RANKED = "rank() OVER (PARTITION BY feature ORDER BY {0}) + (count(*) OVER (PARTITION BY feature, {0})-1)/2e0"


@query(oracle("turns calls", f"""{FEATURES}, l AS (SELECT call_id, feature, round(value, 9) + 0e0 AS value, CASE WHEN call_id%3=0 THEN 1e0 ELSE 0e0 END AS y FROM ({_LONG})),
k AS (SELECT feature, {_RANKED.format('value')} AS x, {_RANKED.format('y')} AS z, value FROM l), cc AS (SELECT feature, CASE
 WHEN max(value)=min(value) THEN NULL ELSE corr(x, z) END AS rho, max(value)=min(value) AS flat FROM k GROUP BY feature)
SELECT feature, round(rho, 6) + 0e0 AS rho, CAST(CASE WHEN flat OR rho>=0 THEN 1 ELSE -1 END AS INT) AS sign FROM cc"""))
def direction_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = view(spark, sf_dir, "calls").select("call_id", (F.col("call_id") % 3 == 0).cast("int").alias("y"))
    return rounded(ga.direction_signs(_steady(_features(spark, sf_dir)), labels))


@query(oracle("turns calls", f"""{FEATURES}, l AS ({_LONG}), m AS (SELECT feature, round(stddev_pop(value), 6) + 0e0 AS importance, CASE WHEN min(idx)%2=1 THEN -1 ELSE 1 END AS sign FROM l
 GROUP BY feature) SELECT feature, importance, CASE WHEN sign>0 THEN 'synthetic' ELSE 'human' END AS points_to FROM m
 ORDER BY importance DESC, feature LIMIT 5"""))
def top_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(n) for n in CONTRACT]), F.col("feature"))
    meta = ga.feature_stats(_features(spark, sf_dir)).select("feature", (F.round("std", 6) + F.lit(0.0)).alias("importance"), F.when(place % 2 == 0, -1).otherwise(1).alias("sign"))
    return evl.top_importances(meta)


def _twice(sql: str) -> str:
    """The features of both turn sources as fa and fb."""
    inner = oracle("turns calls turns_b", f"{FEATURES} SELECT * FROM f")
    other = oracle("turns calls turns_b", re.sub(r"\b(FROM|JOIN) turns\b", r"\1 turns_b", FEATURES) + " SELECT * FROM f")
    long = lambda t: " UNION ALL ".join(f"SELECT call_id, '{n}' AS feature, round({n}, 9) + 0e0 AS value FROM {t}" for n in CONTRACT)
    return f"""WITH fa AS ({inner}), fb AS ({other}), la AS ({long('fa')}), lb AS ({long('fb')}), j AS (SELECT a.feature, a.value AS x, b.value AS y FROM la a
 JOIN lb b ON a.call_id=b.call_id AND a.feature=b.feature) {sql}"""


@query(_twice(f""", k AS (SELECT feature, x, y, {_RANKED.format('x')} AS rx, {_RANKED.format('y')} AS ry FROM j),
c AS (SELECT feature, avg(abs(x-y)) AS d, CASE WHEN max(x)=min(x) OR max(y)=min(y) THEN NULL ELSE corr(rx, ry) END AS rho FROM k GROUP BY feature)
SELECT feature, round(d, 6) + 0e0 AS mean_abs_diff, round(rho, 6) + 0e0 AS rho, rho IS NULL OR rho<0.7e0 AS flagged FROM c""").replace(") , k AS", "), k AS"))
def skew_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ga.skew_report(_steady(_features(spark, sf_dir)), _steady(_features(spark, sf_dir, "turns_b"))))


@query(_twice("SELECT feature, round(max(abs(x-y)), 6) + 0e0 AS max_abs_error, max(abs(x-y))<=1e-6 AS passed FROM j GROUP BY feature"))
def parity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ga.parity_report(_steady(_features(spark, sf_dir)), _steady(_features(spark, sf_dir, "turns_b"))))


_CELLS = """n AS (SELECT call_id, CAST(round_even(dur*1000/10, 0) AS BIGINT) AS n FROM calls),
g AS (SELECT DISTINCT t.call_id, channel, unnest(range(CAST(floor(s*1000/10) AS BIGINT), least(CAST(floor(e*1000/10) AS BIGINT), n.n))) AS f FROM turns t
 JOIN n ON t.call_id=n.call_id),
p AS (SELECT DISTINCT t.call_id, channel, unnest(range(CAST(floor(s*1000/10) AS BIGINT), least(CAST(floor(e*1000/10) AS BIGINT), n.n))) AS f FROM turns_b t
 JOIN n ON t.call_id=n.call_id),
c AS (SELECT coalesce(p.call_id,g.call_id) AS call_id, coalesce(p.channel,g.channel) AS channel, count(p.f) AS np, count(g.f) AS ng, count(CASE
 WHEN p.f IS NOT NULL AND g.f IS NOT NULL THEN 1 END) AS nb FROM p FULL JOIN g ON p.call_id=g.call_id AND p.channel=g.channel AND p.f=g.f GROUP BY 1, 2),
a AS (SELECT call_id, channel, coalesce(nb/nullif(np,0)::DOUBLE,0e0) AS precision, coalesce(nb/nullif(ng,0)::DOUBLE,0e0) AS recall,
 coalesce(2*nb/nullif(np+ng,0)::DOUBLE,0e0) AS f1 FROM c)"""


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.frame_agreement(view(spark, sf_dir, "turns_b"), view(spark, sf_dir, "turns"), view(spark, sf_dir, "calls"))


@query(oracle("turns calls turns_b", f"{_CELLS} SELECT call_id, channel, {rounding('precision recall f1')} FROM a"))
def frame_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_agreement(spark, sf_dir))


@query(oracle("turns calls turns_b", f"""{_CELLS}, m AS (SELECT median(CASE WHEN channel=0 THEN f1 END) AS f0, median(CASE WHEN channel=1 THEN f1 END) AS f9 FROM a),
q AS (SELECT median(coalesce(p,0)/(g+0e0)) AS turn_ratio FROM (SELECT call_id, count(*) AS g FROM turns GROUP BY call_id) x LEFT
 JOIN (SELECT call_id, count(*) AS p FROM turns_b GROUP BY call_id) z ON x.call_id=z.call_id)
SELECT round(f0, 6) + 0e0 AS f1_caller, round(f9, 6) + 0e0 AS f1_agent, round(turn_ratio, 6) + 0e0 AS turn_ratio, f0>=0.85e0 AND f9>=0.85e0
 AND turn_ratio BETWEEN 0.8e0 AND 1.2e0 AS passed FROM m, q"""))
def agreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ga.agreement_summary(_agreement(spark, sf_dir), view(spark, sf_dir, "turns_b"), view(spark, sf_dir, "turns")))


@query(oracle("turns calls turns_b", f"""{_CELLS}, lb AS (SELECT call_id, CASE WHEN call_id%2=0 THEN 'human' ELSE 'synthetic' END AS label FROM calls),
q AS (SELECT x.call_id, coalesce(p,0)/(g+0e0) AS r FROM (SELECT call_id, count(*) AS g FROM turns GROUP BY call_id) x LEFT JOIN (SELECT call_id, count(*) AS p
 FROM turns_b GROUP BY call_id) z ON x.call_id=z.call_id),
m AS (SELECT label, median(CASE WHEN channel=0 THEN f1 END) AS f1_caller, median(CASE WHEN channel=1 THEN f1 END) AS f1_agent FROM a
 JOIN lb ON a.call_id=lb.call_id GROUP BY label),
t AS (SELECT label, median(r) AS turn_ratio FROM q JOIN lb ON q.call_id=lb.call_id GROUP BY label)
SELECT m.label, {rounding('f1_caller f1_agent turn_ratio')} FROM m JOIN t ON m.label=t.label"""))
def agreement_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = view(spark, sf_dir, "calls").select("call_id", F.when(F.col("call_id") % 2 == 0, "human").otherwise("synthetic").alias("label"))
    return rounded(ga.agreement_by_label(_agreement(spark, sf_dir), view(spark, sf_dir, "turns_b"), view(spark, sf_dir, "turns"), labels))
