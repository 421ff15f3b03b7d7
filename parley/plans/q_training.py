"""Queries on training: boosted trees, early stopping, cross-validation, compiled scores, A/B and audits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import evaluate as evl
from parley.operators import gates as ga
from parley.operators import ml, timeline, trees
from parley.operators.features import CONTRACT, extract_features
from parley.plans.q_evaluate import _CELLS, _agreement, scored
from parley.plans.q_intervals import FEATURES, rounding
from parley.plans.q_signal import acoustic_features
from parley.plans.registry import query, rounded
from parley.plans.views import oracle, view
from parley.sources.readers import read_split as keep_split

ROUNDS, PATIENCE = 40, 12
#: The registered fits but those of ab_compare: 3 folds instead of 5, one seed instead of three, at most 6 rounds instead of 500, a patience of 3 instead of 50.
FEWER = {"k": 3, "seeds": ml.SEEDS[:1], "rounds": 6, "patience": 3}


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 23 features of each call with y, which follows one of them but for every seventh call, and split."""
    features = extract_features(view(spark, sf_dir, "turns"), view(spark, sf_dir, "calls"))
    label = ((F.col("resp_latency_mean") > 1.0) != (F.col("call_id") % 7 == 0)).cast("int")
    return features.withColumns({"y": label, "split": F.when(F.col("call_id") % 5 == 0, "val").otherwise("train")}).persist()


def _trained(rows: DataFrame, names: list[str], params: dict | None) -> DataFrame:
    """Early stopping on a fifth of the train rows gives the rounds, all train rows the final trees; chances of all rows."""
    train = keep_split(rows, "train")
    valid = F.col("call_id") % 5 == 1
    fit = ml.fit_early(train.filter(~valid), train.filter(valid), names, params, FEWER["rounds"], FEWER["patience"])
    final = trees.compiled(ml.train_gbt(train, names, params, fit.best))
    return trees.score_model(rows, final).select("call_id", "y", F.col("p").alias("score"))


@query()
def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(training(spark, sf_dir), list(CONTRACT), ml.BEHAVIOURAL)


@query()
def train_acoustic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = acoustic_features(spark, sf_dir)
    names = [c for c in rows.columns if c != "call_id"]
    label = ((F.col("centroid_mean") > 2000) != (F.col("call_id") % 7 == 0)).cast("int")
    return _trained(rows.withColumns({"y": label, "split": F.lit("train")}).persist(), names, ml.ACOUSTIC)


@query()
def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 23 features; with the reductions of FEWER."""
    fits = ml.fold_fits(keep_split(training(spark, sf_dir), "train"), list(CONTRACT), **FEWER)
    return ml.cross_validate(ml.fold_table(spark, fits))


@query()
def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the leading feature against all 23, each by the whole protocol: 5 folds by 3 seeds, up to 500 rounds, a patience of 50."""
    return ml.ab_compare(training(spark, sf_dir), list(CONTRACT[1:]), list(CONTRACT[:1]))


#: A small model over the contract's features.
MODEL = trees.Ensemble((
    (1.0, ("resp_latency_mean", 1.0, -0.5, ("overlap_count", 2.0, 0.75, 0.25))),
    (0.05, ("short_turn_ratio", 0.3, ("turn_count_caller", 4.0, 0.4, -0.2), 0.1)),
    (0.05, ("speech_balance", 0.5, 0.3, ("latency_monotony_index", 0.2, -0.45, 0.15))),
))


_ROUNDED = ", ".join(f"round({n}, 9) AS {n}" for n in CONTRACT)


_RAW = """2e0*((CASE WHEN resp_latency_mean>1 THEN (CASE WHEN overlap_count>2 THEN 0.25e0 ELSE 0.75e0 END) ELSE -0.5e0 END)
 + 0.05e0*(CASE WHEN short_turn_ratio>0.3e0 THEN 0.1e0 WHEN turn_count_caller>4 THEN -0.2e0 ELSE 0.4e0 END)
 + 0.05e0*(CASE WHEN speech_balance<=0.5e0 THEN 0.3e0 WHEN latency_monotony_index<=0.2e0 THEN -0.45e0 ELSE 0.15e0 END))"""


@query(oracle("turns calls", f"""{FEATURES}, g AS (SELECT call_id, {_ROUNDED} FROM f), m AS (SELECT call_id, {_RAW} AS raw FROM g),
q AS (SELECT call_id, raw, 1/(1+exp(-1.2e0*raw+0.1e0)) AS p FROM m)
SELECT call_id, {rounding('raw p')}, p>=0.42e0 AS is_synthetic, round(CASE WHEN p>=0.42e0 THEN p ELSE 1-p END, 6) + 0e0 AS confidence FROM q"""))
def score_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = extract_features(view(spark, sf_dir, "turns"), view(spark, sf_dir, "calls"))
    steady = features.select("call_id", *[(F.round(n, 9) + F.lit(0.0)).alias(n) for n in CONTRACT])  # no engine's last digit decides a split
    return rounded(trees.score_model(steady, MODEL, -1.2, 0.1, 0.42).select("call_id", "raw", "p", "is_synthetic", "confidence"))


_AT = re.sub(r"\bcalls\b", "cc", re.sub(r"\bturns\b", "tt", FEATURES))


@query(oracle("turns calls", f"""ct AS (SELECT call_id, i, CASE WHEN i>16 THEN dur ELSE dur*i/17e0 END AS cut FROM calls, (SELECT unnest(range(1, 18)) AS i)),
tt AS (SELECT t.call_id*100+i AS call_id, turn_id, channel, s, LEAST(e, cut) AS e FROM turns t JOIN ct ON t.call_id=ct.call_id WHERE s < cut),
 cc AS (SELECT call_id*100+i AS call_id, cut AS dur FROM ct),
{_AT}, g AS (SELECT call_id, {_ROUNDED} FROM f), m AS (SELECT call_id, 1/(1+exp(-1.2e0*{_RAW}+0.1e0)) AS p FROM g),
k AS (SELECT call_id//100 AS call_id, call_id%100 AS i, CASE WHEN p>=0.42e0 THEN p ELSE 1-p END AS c FROM m)
SELECT k.call_id, CAST(k.i AS INT) AS i, round(cut, 6) + 0e0 AS t, round(CASE WHEN k.i=17 AND k.call_id%3<>0 THEN 0.5e0+(k.call_id%7)/16e0
 ELSE c END, 6) + 0e0 AS confidence FROM k JOIN ct ON ct.call_id=k.call_id AND ct.i=k.i"""))
def confidence_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """17 points of each call under MODEL; for two of three calls the last one is what was served."""
    turns, calls = view(spark, sf_dir, "turns"), view(spark, sf_dir, "calls")
    served = calls.filter("call_id % 3 <> 0").select("call_id", (0.5 + F.col("call_id") % 7 / 16).alias("confidence"))
    return rounded(timeline.confidence_timeline(turns, calls, MODEL, -1.2, 0.1, 0.42, served=served, digits=9))


#: Steps of 40 rounds in sixteenths, so that sums are exact in any order: their use grows, then fades.
_STEP = "(((call_id*31+r*17)%64) + (CASE WHEN y=1 THEN 18-r ELSE 0 END))/16e0"
_STAGED = f"""st AS (SELECT call_id, split, y, r, sum({_STEP}) OVER (PARTITION BY call_id ORDER BY r) AS s FROM scored, range(1, {ROUNDS + 1}) AS q(r)),
n AS (SELECT split, sum(y) AS p, count(*)-sum(y) AS n FROM scored GROUP BY split),
k AS (SELECT split, y, r, rank() OVER (PARTITION BY split, r ORDER BY s)+(count(*) OVER (PARTITION BY split, r, s)-1)/2e0 AS k FROM st),
au AS (SELECT k.split, r AS round, round((sum(CASE WHEN y=1 THEN k ELSE 0 END)-p*(p+1)/2e0)/(p*n), 9) + 0e0 AS auc FROM k JOIN n ON n.split=k.split
 GROUP BY k.split, r, p, n)"""


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    steps = F.transform(rounds, lambda r: ((F.col("call_id") * 31 + r * 17) % 64 + F.when(F.col("y") == 1, 18 - r).otherwise(0)) / 16e0)
    return rounded(ml.staged_auc(scored(spark, sf_dir).select("split", "y", steps.alias("steps")), ("split",)), 9)


@query(oracle("scored", f"{_STAGED} SELECT split, CAST(round AS INT) AS round, auc FROM au"))
def staged_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir)


@query(oracle("scored", f"""{_STAGED}, b AS (SELECT split, round, auc, max(auc) OVER (PARTITION BY split ORDER BY round) AS top FROM au),
f AS (SELECT split, round, auc, (SELECT min(x.round) FROM au x WHERE x.split=b.split AND x.auc=b.top) AS best FROM b),
e AS (SELECT split, min(round) AS stopped FROM f WHERE round-best>={PATIENCE} GROUP BY split),
w AS (SELECT f.split, f.round, f.auc, stopped FROM f LEFT JOIN e ON e.split=f.split WHERE stopped IS NULL OR f.round<=stopped)
SELECT split, CAST(arg_min(round, (-auc, round)) AS INT) AS best_round, max(auc) AS best_auc, CAST(max(stopped) AS INT) AS stopped FROM w GROUP BY split"""))
def best_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.best_round(_staged(spark, sf_dir), ("split",), PATIENCE)


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores, and the scores moved by invention, as two variants."""
    out = None
    for name, score in (("base", F.col("score")), ("extended", F.col("score") + F.round((F.col("invention") - 0.5) / 4, 3))):
        rows = scored(spark, sf_dir).select("y", F.round(score, 6).alias("score"))
        part = evl.auc_rank(rows).crossJoin(evl.confusion(rows, 0.5)).select(F.lit(name).alias("variant"), F.col("auc").alias("auc_val"), F.col("balanced_accuracy").alias("ba_val"))
        out = part if out is None else out.union(part)
    return out


@query(oracle("scored", f"""v AS (SELECT 'base' AS variant, y, round(score, 6) AS score FROM scored UNION ALL SELECT 'extended', y, round(score+round((invention-0.5e0)/4, 3), 6)
 FROM scored),
k AS (SELECT variant, y, score, rank() OVER (PARTITION BY variant ORDER BY score)+(count(*) OVER (PARTITION BY variant, score)-1)/2e0 AS k FROM v),
a AS (SELECT variant, (sum(CASE WHEN y=1 THEN k ELSE 0 END)-sum(y)*(sum(y)+1)/2e0)/(sum(y)*(count(*)-sum(y))) AS auc_val, (avg(CASE WHEN y=1 THEN (CASE
 WHEN score>=0.5e0 THEN 1e0 ELSE 0e0 END) END)+avg(CASE WHEN y=0 THEN (CASE WHEN score<0.5e0 THEN 1e0 ELSE 0e0 END) END))/2e0 AS ba_val FROM k GROUP BY variant)
SELECT a.variant, {', '.join(f'round(a.{c}, 6) + 0e0 AS {c}, round(a.{c}-b.{c}, 6) + 0e0 AS delta_{c}' for c in ('auc_val', 'ba_val'))} FROM a, a AS b
 WHERE b.variant='base'"""))
def ab_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ml.with_deltas(_variants(spark, sf_dir)))


_AUC = "sum(CASE WHEN a.{0}>b.{0} THEN 1e0 WHEN a.{0}=b.{0} THEN 0.5e0 ELSE 0e0 END)/count(*)"


@query(oracle("scored turns calls turns_b", f"""{_CELLS}, lb AS (SELECT call_id, CASE WHEN call_id%2=0 THEN 'human' ELSE 'synthetic' END AS label FROM calls),
m AS (SELECT median(CASE WHEN label='human' AND channel=0 THEN f1 END) AS f1_human, median(CASE WHEN label='synthetic'
 AND channel=0 THEN f1 END) AS f1_synthetic FROM a JOIN lb ON a.call_id=lb.call_id),
va AS (SELECT {_AUC.format('score')} AS auc, {_AUC.format('duration_s')} AS duration_auc FROM scored a, scored b WHERE a.y=1 AND b.y=0),
 r AS (SELECT corr(y, duration_s) AS duration_r FROM scored),
im AS (SELECT source AS feature, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 5)
SELECT {rounding('auc')}, auc>=l AS triggered,
 {', '.join(f'CASE WHEN auc>=l THEN round({c}, 6) + 0e0 END AS {c}' for c in ('duration_auc', 'duration_r', 'f1_human', 'f1_synthetic'))},
 CASE WHEN auc>=l THEN (SELECT string_agg(feature, ',' ORDER BY n DESC, feature) FROM im) END AS top_features
 FROM va, r, m, (VALUES (0.6e0), (0.99e0)) AS limits(l)"""))
def validation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit that the scores exceed, and one that they don't; documents per source stand for importances."""
    rows, labels = scored(spark, sf_dir), view(spark, sf_dir, "calls").select("call_id", F.when(F.col("call_id") % 2 == 0, "human").otherwise("synthetic").alias("label"))
    duration = ga.gate_duration_leak(rows).select("auc", "r")
    agreement = ga.agreement_by_label(_agreement(spark, sf_dir), view(spark, sf_dir, "turns_b"), view(spark, sf_dir, "turns"), labels)
    sizes = view(spark, sf_dir, "documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("feature")).agg(F.count(F.lit(1)).alias("importance"))
    over, under = (ml.validation_audit(evl.auc_rank(rows), duration, agreement, sizes, limit) for limit in (0.6, 0.99))
    return rounded(over.union(under))
