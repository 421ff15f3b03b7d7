"""Queries on intervals, features and dialogue events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import events as ev
from parley.operators import features as ft
from parley.operators import intervals as iv
from parley.plans.registry import ORACLES, query, rounded
from parley.plans.views import oracle, view

OV = """ov AS (SELECT a.call_id, a.turn_id AS ai, c.turn_id AS ci, c.s AS cs, c.e AS ce, GREATEST(a.s,c.s) AS os, LEAST(a.e,c.e) AS oe
 FROM turns a JOIN turns c ON a.call_id=c.call_id AND a.channel=1 AND c.channel=0 AND a.s<c.e AND c.s<a.e)"""
GAP = """isl0 AS (SELECT call_id,s,e, MAX(e) OVER (PARTITION BY call_id ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM turns),
gap AS (SELECT call_id, GREATEST(COALESCE(pm,0e0),0e0) AS g, s AS g_end FROM isl0 WHERE s-GREATEST(COALESCE(pm,0e0),0e0)>2e0
 UNION ALL SELECT d.call_id, COALESCE(m.me,0e0), d.dur FROM calls d LEFT JOIN (SELECT call_id,GREATEST(MAX(e),0e0) me FROM turns
 GROUP BY call_id) m ON d.call_id=m.call_id WHERE d.dur-COALESCE(m.me,0e0)>2e0)"""


def rounding(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0e0 AS {n}" for n in names.split())


@query(oracle("turns", """SELECT call_id, CAST(sum(CASE WHEN channel=0 THEN 1 ELSE 0 END) AS BIGINT) AS caller, CAST(sum(CASE WHEN channel=1 THEN 1 ELSE 0 END) AS BIGINT) AS agent
 FROM turns GROUP BY call_id"""))
def turn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.turn_counts(view(spark, sf_dir, "turns"))


@query(oracle("turns", f"SELECT call_id, turn_id, {rounding('s e')} FROM turns WHERE channel = 0"))
def split_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(iv.split_channels(view(spark, sf_dir, "turns"))[0].drop("channel"))


@query(oracle("turns", f"{OV} SELECT call_id, ai, ci, {rounding('cs ce os oe')} FROM ov"))
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(iv.overlap_join(view(spark, sf_dir, "turns")))


@query(oracle("turns", f"{OV} SELECT call_id, ai, ci, {rounding('cs ce os oe')} FROM ov"))
def overlap_join_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(iv.overlap_join(view(spark, sf_dir, "turns"), bin_seconds=10.0))


@query(oracle("turns", """SELECT a.call_id, a.turn_id, round(a.e, 6) + 0e0 AS t, round(min(c.s), 6) + 0e0 AS nt FROM turns a JOIN turns c ON a.call_id=c.call_id AND c.channel=0
 AND a.channel=1 AND c.s>=a.e GROUP BY a.call_id, a.turn_id, a.e"""))
def next_start_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    caller, agent = iv.split_channels(view(spark, sf_dir, "turns"))
    return rounded(iv.next_start_asof(agent.select("call_id", F.col("e").alias("t"), "turn_id"), caller))


@query(oracle("turns", f"""m AS (SELECT call_id, s, e, MAX(e) OVER (PARTITION BY call_id ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM turns),
i AS (SELECT call_id, s, e, SUM(CASE WHEN s<=pm THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY s,e ROWS UNBOUNDED PRECEDING) AS k FROM m),
g AS (SELECT call_id, k, MIN(s) AS s, MAX(e) AS e FROM i GROUP BY call_id, k) SELECT call_id, {rounding('s e')} FROM g"""))
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(iv.merge_intervals(view(spark, sf_dir, "turns")))


@query(oracle("turns calls", f"{GAP} SELECT call_id, {rounding('g g_end')} FROM gap"))
def silence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(iv.silence_gaps(view(spark, sf_dir, "turns"), view(spark, sf_dir, "calls")))


@query(oracle("turns calls", """SELECT t.call_id, CAST(1 AS INT) AS i, turn_id, channel, round(s, 6) + 0e0 AS s, round(LEAST(e, dur/2e0), 6) + 0e0 AS e FROM turns t
 JOIN calls c ON t.call_id=c.call_id WHERE s < dur/2e0"""))
def truncate_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = view(spark, sf_dir, "calls").select("call_id", F.lit(1).alias("i"), (F.col("dur") / 2).alias("t"))
    return rounded(iv.truncate_turns(view(spark, sf_dir, "turns"), cuts))


@query(oracle("turns", """p AS (SELECT call_id, MIN(turn_id) AS probe_turn FROM turns WHERE channel=1 GROUP BY call_id) SELECT p.call_id, probe_turn, coalesce((SELECT MIN(turn_id)
 FROM turns t WHERE t.call_id=p.call_id AND channel=0 AND turn_id>probe_turn), -1) AS answer_turn FROM p"""))
def find_answer_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = view(spark, sf_dir, "turns")
    return iv.find_answer_turn(turns, turns.filter("channel = 1").groupBy("call_id").agg(F.min("turn_id").alias("probe_turn"))).fillna({"answer_turn": -1})


FEATURES = f"""c AS (SELECT * FROM turns WHERE channel=0), a AS (SELECT * FROM turns WHERE channel=1), {OV}, {GAP},
pts AS (SELECT call_id,e t,1 k FROM a UNION ALL SELECT call_id,oe,2 FROM ov UNION ALL SELECT call_id,g,3 FROM gap),
nx AS (SELECT * FROM (SELECT call_id,k,t, MIN(CASE WHEN k=0 THEN t END) OVER (PARTITION BY call_id ORDER BY t RANGE BETWEEN CURRENT ROW
 AND UNBOUNDED FOLLOWING) nt
  FROM (SELECT * FROM pts UNION ALL SELECT call_id,s,0 FROM c) u) v WHERE k<>0 AND nt IS NOT NULL),
dl AS (SELECT call_id,k,nt-t d FROM nx),
md AS (SELECT call_id, MEDIAN(d) md FROM dl WHERE k=1 GROUP BY call_id),
la AS (SELECT dl.call_id, AVG(d) m, MIN(md) md, STDDEV_POP(d) sd, AVG(CASE WHEN ABS(d-md)<=0.15e0 THEN 1e0 ELSE 0e0 END) mi, MIN(d) mn FROM dl
 JOIN md ON dl.call_id=md.call_id WHERE k=1 GROUP BY dl.call_id),
re AS (SELECT call_id, AVG(d) m, STDDEV_POP(d) sd FROM dl WHERE k=2 GROUP BY call_id),
si AS (SELECT call_id, AVG(d) m, STDDEV_POP(d) sd FROM dl WHERE k=3 GROUP BY call_id),
oa AS (SELECT call_id, COUNT(*) n, SUM(oe-os) tot, SUM(CASE WHEN ce-os<=0.4e0 THEN 1 ELSE 0 END) ab FROM ov GROUP BY call_id),
bi AS (SELECT call_id, COUNT(*) n FROM c WHERE EXISTS (SELECT 1 FROM a WHERE a.call_id=c.call_id AND a.s<c.s AND c.s<a.e) GROUP BY call_id),
ca AS (SELECT call_id, COUNT(*) n, AVG(e-s) m, STDDEV_POP(e-s) sd, SUM(e-s) tot, AVG(CASE WHEN e-s<1e0 THEN 1e0 ELSE 0e0 END) sh, SUM(CASE
 WHEN nxs-e<0.5e0 THEN 1 ELSE 0 END) fr
  FROM (SELECT *, LEAD(s) OVER (PARTITION BY call_id ORDER BY s,e) nxs FROM c) q GROUP BY call_id),
aa AS (SELECT call_id, SUM(e-s) tot FROM a GROUP BY call_id),
f AS (SELECT d.call_id, COALESCE(la.m,0e0) resp_latency_mean, COALESCE(la.md,0e0) resp_latency_median, COALESCE(la.sd,0e0) resp_latency_std,
 COALESCE(la.sd/NULLIF(la.m,0e0),0e0) resp_latency_cv,
 COALESCE(la.mi,0e0) latency_monotony_index, COALESCE(la.mn,0e0) resp_latency_min, COALESCE(oa.n,0)+0e0 overlap_count,
 CASE WHEN d.dur>0 THEN COALESCE(oa.n,0)/(d.dur/60e0)
 ELSE 0e0 END overlap_rate_per_min, COALESCE(oa.tot,0e0) overlap_total_dur, COALESCE(bi.n,0)+0e0 caller_bargein_count,
 COALESCE(re.m,0e0) recovery_delay_mean, COALESCE(re.sd/NULLIF(re.m,0e0),0e0) recovery_delay_cv, COALESCE((oa.ab+0e0)/oa.n,0e0) recovery_abort_ratio,
 COALESCE(ca.m,0e0) caller_turn_dur_mean, COALESCE(ca.sd,0e0) caller_turn_dur_std, COALESCE(ca.sd/NULLIF(ca.m,0e0),0e0) caller_turn_dur_cv, COALESCE(ca.sh,0e0)
 short_turn_ratio,
 CASE WHEN d.dur>0 THEN COALESCE(ca.fr,0)/(d.dur/60e0) ELSE 0e0 END fragmentation_rate,
 CASE WHEN d.dur>0 THEN COALESCE(ca.tot,0e0)/d.dur ELSE 0e0 END caller_speech_ratio, CASE WHEN aa.tot>0 THEN COALESCE(ca.tot,0e0)/aa.tot
 ELSE 0e0 END speech_balance,
 COALESCE(si.m,0e0) silence_break_delay_mean, COALESCE(si.sd/NULLIF(si.m,0e0),0e0) silence_break_delay_cv, COALESCE(ca.n,0)+0e0 turn_count_caller
FROM calls d LEFT JOIN la ON d.call_id=la.call_id LEFT JOIN oa ON d.call_id=oa.call_id LEFT JOIN bi ON d.call_id=bi.call_id
 LEFT JOIN re ON d.call_id=re.call_id LEFT JOIN ca ON d.call_id=ca.call_id LEFT JOIN aa ON d.call_id=aa.call_id LEFT JOIN si ON d.call_id=si.call_id)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.extract_features(view(spark, sf_dir, "turns"), view(spark, sf_dir, "calls"))


@query(oracle("turns calls", f"{FEATURES} SELECT call_id, {rounding(' '.join(ft.CONTRACT))} FROM f"))
def extract_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features(spark, sf_dir)
    ft.assert_contract(out)
    return rounded(out)


_LONG = " UNION ALL ".join(f"SELECT call_id, CAST({i} AS INT) AS idx, '{n}' AS feature, {n} AS value FROM f" for i, n in enumerate(ft.CONTRACT))


@query(oracle("turns calls", f"{FEATURES}, l AS ({_LONG}) SELECT call_id, idx, feature, {rounding('value')} FROM l"))
def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.features_long(features(spark, sf_dir)))


def _feature_query(name: str, make, columns: str) -> None:
    """A query for one group of features, over the calls where it is not 0."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = rounded(make(view(spark, sf_dir, "turns"), view(spark, sf_dir, "calls")))
        return out.select("call_id", *columns.split())

    run.__name__ = name
    first = columns.split()[0]
    cte = {"resp_latency": "la", "caller_turn_stats": "ca", "overlap_totals": "oa", "barge_in_count": "bi", "recovery_delays": "re", "silence_break_delays": "si"}[name]
    inner = {"resp_latency": "m resp_latency_mean, md resp_latency_median, sd resp_latency_std, mi latency_monotony_index, mn resp_latency_min", "caller_turn_stats": "m caller_turn_dur_mean, sd caller_turn_dur_std, sh short_turn_ratio",
             "overlap_totals": "tot overlap_total_dur", "barge_in_count": "n bargeins", "recovery_delays": "m recovery_delay_mean, sd recovery_delay_std", "silence_break_delays": "m silence_break_delay_mean, sd silence_break_delay_std"}[name]
    exact = first == "bargeins"
    body = f"SELECT call_id, {columns if exact else rounding(columns)} FROM (SELECT call_id, {inner} FROM {cte}) x"
    query(oracle("turns calls", f"{FEATURES} {body}"))(run)


_feature_query("resp_latency", lambda t, c: ft.response_latency(t), "resp_latency_mean resp_latency_median resp_latency_std latency_monotony_index resp_latency_min")
_feature_query("caller_turn_stats", lambda t, c: ft.caller_turns(t), "caller_turn_dur_mean caller_turn_dur_std short_turn_ratio")
_feature_query("overlap_totals", lambda t, c: ft.overlap_stats(t), "overlap_total_dur")
_feature_query("barge_in_count", lambda t, c: ft.barge_ins(t), "bargeins")
_feature_query("recovery_delays", lambda t, c: ft.delays_after(iv.overlap_join(t).select("call_id", F.col("oe").alias("t")), t, "recovery_delay"), "recovery_delay_mean recovery_delay_std")
_feature_query("silence_break_delays", lambda t, c: ft.delays_after(iv.silence_gaps(t, c).select("call_id", F.col("g").alias("t")), t, "silence_break_delay"), "silence_break_delay_mean silence_break_delay_std")


@query(oracle("turns calls", f"""{OV}, {GAP}, x AS (SELECT call_id, 'overlap' AS kind, os AS s, oe AS e FROM ov WHERE oe>os
 UNION ALL SELECT call_id, 'interruption', s, e FROM turns c WHERE channel=0 AND EXISTS (SELECT 1 FROM turns a WHERE a.call_id=c.call_id AND a.channel=1
 AND c.s>=a.s AND c.s<a.e)
 UNION ALL SELECT call_id, 'silence', g, g_end FROM gap) SELECT call_id, kind, {rounding('s e')} FROM x"""))
def dialogue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.dialogue_events(view(spark, sf_dir, "turns"), view(spark, sf_dir, "calls")))


def feature_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{feature, mean, std, importance, sign} from the calls themselves; importance falls with the contract's order."""
    from parley.operators.gates import feature_stats

    order = F.array_position(F.array(*[F.lit(n) for n in ft.CONTRACT]), F.col("feature"))
    return feature_stats(features(spark, sf_dir)).select("feature", r6("mean"), r6("std"), (24 - order).cast("double").alias("importance"), F.when(order % 2 == 0, -1).otherwise(1).alias("sign"))


def r6(name: str):
    return (F.round(name, 6) + F.lit(0.0)).alias(name)


_META = """meta AS (SELECT feature, round(AVG(value), 6) + 0e0 AS mean, round(STDDEV_POP(value), 6) + 0e0 AS std, (23e0 - MIN(idx)) AS importance, CASE
 WHEN MIN(idx)%2=1 THEN -1 ELSE 1 END AS sign FROM l GROUP BY feature)"""


_TOP = f"""{FEATURES}, l AS ({_LONG}), {_META},
z AS (SELECT call_id, idx, l.feature, value, sign, CASE WHEN std<=1e-12 THEN 0e0 ELSE (value-mean)/std END AS z, importance FROM l
 JOIN meta ON l.feature=meta.feature),
k AS (SELECT *, abs(importance*z) AS score, ROW_NUMBER() OVER (PARTITION BY call_id ORDER BY round(abs(importance*z), 9) DESC, idx) AS rank FROM z),
w AS (SELECT *, SUM(score) OVER (PARTITION BY call_id) AS total FROM k WHERE rank<=5),
top AS (SELECT call_id, CAST(rank AS INT) AS rank, feature, value, CASE WHEN sign*z>0 THEN 'synthetic' WHEN sign*z<0 THEN 'human'
 ELSE 'neutral' END AS direction,
 CASE WHEN total<=1e-12 THEN 0.2e0 ELSE score/total END AS weight FROM w)"""


@query(oracle("turns calls", f"{_TOP} SELECT call_id, rank, feature, direction, {rounding('value weight', 4)} FROM top"))
def top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.top_factors(features(spark, sf_dir), feature_meta(spark, sf_dir)), 4)


def _said(template: str) -> str:
    """A sentence of ``PHRASES`` in DuckDB's SQL."""
    place = ev.PLACE.search(template)
    x = "v*100" if place[1] == "percent" else "v"
    return f"replace(replace('{template}', '{place[0]}', printf('%.{place[2]}f', {x})), '{{agent}}', CAST(agent AS VARCHAR))"


@query(oracle("turns calls", f"""{_TOP}, n AS (SELECT call_id, sum(CASE WHEN channel=1 THEN 1 ELSE 0 END) AS agent FROM turns GROUP BY call_id),
x AS (SELECT top.call_id, rank, feature, direction, round(value, 9) AS v, round(weight, 9) AS w, agent FROM top JOIN n ON n.call_id=top.call_id WHERE rank<=3),
s AS (SELECT call_id, rank, CASE feature {' '.join(f"WHEN '{n}' THEN {_said(t)}" for n, t in ev.PHRASES.items())} END || ' (' || feature || ', ' || direction ||
 ' signal, weight ' || printf('%.0f', w*100) || '%).' AS line FROM x)
SELECT call_id, string_agg(line, ' ' ORDER BY rank) AS rationale FROM s GROUP BY call_id"""))
def rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = rounded(ev.top_factors(features(spark, sf_dir), feature_meta(spark, sf_dir)), 9)
    return ev.rationale(factors, iv.turn_counts(view(spark, sf_dir, "turns")))


@query(oracle("turns calls", """SELECT t.call_id, i, turn_id, channel, round(s, 6) + 0e0 AS s, round(LEAST(e, cut), 6) + 0e0 AS e FROM turns t JOIN (SELECT call_id, CAST(i AS INT) AS i,
 CASE WHEN i>16 THEN dur ELSE dur*i/17e0 END AS cut FROM calls, (SELECT unnest(range(1, 18)) AS i)) c ON t.call_id=c.call_id WHERE s < cut"""))
def confidence_timeline_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(iv.truncate_turns(view(spark, sf_dir, "turns"), ev.timeline_cuts(view(spark, sf_dir, "calls"))))


@query(oracle("turns", """pt AS (SELECT call_id, s AS t, turn_id/10e0 AS p FROM turns), q AS (SELECT call_id, AVG(s) AS t FROM turns GROUP BY call_id),
l AS (SELECT q.call_id, q.t, arg_max(pt.t, (pt.t, pt.p)) AS lt, arg_max(pt.p, (pt.t, pt.p)) AS lp FROM q JOIN (SELECT call_id, t, MAX(p) AS p FROM pt
 GROUP BY call_id, t) pt ON q.call_id=pt.call_id AND pt.t<=q.t GROUP BY q.call_id, q.t),
h AS (SELECT q.call_id, arg_min(pt.t, (pt.t, pt.p)) AS rt, arg_min(pt.p, (pt.t, pt.p)) AS rp FROM q JOIN (SELECT call_id, t, MAX(p) AS p FROM pt
 GROUP BY call_id, t) pt ON q.call_id=pt.call_id AND pt.t>=q.t GROUP BY q.call_id)
SELECT q.call_id, round(q.t, 4) + 0e0 AS t, round(CASE WHEN lt IS NULL THEN rp WHEN rt IS NULL OR rt<=lt THEN lp
 ELSE lp+(rp-lp)*(q.t-lt)/(rt-lt) END, 4) + 0e0 AS p FROM q LEFT JOIN l ON q.call_id=l.call_id LEFT JOIN h ON q.call_id=h.call_id"""))
def interpolate_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = view(spark, sf_dir, "turns")
    points = turns.groupBy("call_id", F.col("s").alias("t")).agg(F.max(F.col("turn_id") / 10).alias("p"))
    return rounded(ev.interpolate_timeline(points, turns.groupBy("call_id").agg(F.avg("s").alias("t"))), 4)


@query(oracle("frames", """SELECT call_id, channel, CAST(FLOOR(i/8e0) AS BIGINT) AS b, round(MAX(abs(db/20e0)), 3) + 0e0 AS peak FROM frames
 GROUP BY call_id, channel, CAST(FLOOR(i/8e0) AS BIGINT)"""))
def waveform_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.waveform_envelope(view(spark, sf_dir, "frames").withColumn("x", F.col("db") / 20), 8)


@query(oracle("frames", """p AS (SELECT call_id, channel, CAST(FLOOR(i/8e0) AS BIGINT) AS b, round(MAX(abs(db/20e0)), 3) + 0e0 AS peak FROM frames
 GROUP BY call_id, channel, CAST(FLOOR(i/8e0) AS BIGINT)),
s AS (SELECT call_id, channel, (MAX(b)+1)/3e0 AS step FROM p GROUP BY call_id, channel),
 g AS (SELECT call_id, channel, g, FLOOR(g*step) AS a, GREATEST(FLOOR(g*step)+1, FLOOR((g+1)*step)) AS z FROM s, (SELECT unnest(range(0,3)) AS g))
SELECT p.call_id, p.channel, CAST(g AS INT) AS g, LEAST(MAX(peak), 1e0) AS peak FROM p JOIN g ON p.call_id=g.call_id AND p.channel=g.channel AND b>=a AND b<z
 GROUP BY p.call_id, p.channel, g"""))
def downsample_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.downsample_peaks(waveform_envelope(spark, sf_dir), 3)


@query(oracle("scored", """SELECT call_id, score>=0.42e0 AS is_synthetic, round(CASE WHEN score>=0.42e0 THEN LEAST(1e0,GREATEST(0e0,score))
 ELSE 1-LEAST(1e0,GREATEST(0e0,score)) END, 4) + 0e0 AS confidence FROM scored"""))
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.verdict(view(spark, sf_dir, "scored").withColumn("p", F.col("score")), 0.42).select("call_id", "is_synthetic", (F.col("confidence") + F.lit(0.0)).alias("confidence"))


@query(oracle("scored", """SELECT d.doc_id AS call_id, COALESCE(score>=0.42e0, FALSE) AS is_synthetic, COALESCE(round(CASE WHEN score>=0.42e0 THEN LEAST(1e0,score)
 ELSE 1-score END, 4), 0.5e0) AS confidence FROM documents d LEFT JOIN scored s ON d.doc_id=s.call_id"""))
def fallback_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("call_id"))
    return ev.fallback_verdict(calls, verdict(spark, sf_dir))[0]


@query(oracle("detections", "SELECT request_id, CASE WHEN confidence<0.7e0 THEN 'review' WHEN is_synthetic THEN 'synthetic' ELSE 'verified' END AS band FROM detections"))
def verdict_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "detections").select("request_id", ev.verdict_band(F.col("is_synthetic"), F.col("confidence")).alias("band"))


@query(oracle("detections", """SELECT request_id, ROW_NUMBER() OVER (PARTITION BY date_trunc('day', ts) ORDER BY abs(confidence-0.6e0), ts, request_id) AS priority FROM detections
 WHERE abs(confidence-0.6e0)<=0.2e0"""))
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.review_queue(view(spark, sf_dir, "detections"), 0.6).select("request_id", F.col("priority").cast("long").alias("priority"))


@query(oracle("turns calls", f"""{FEATURES}, v AS (SELECT call_id, 1/(1+exp(-resp_latency_mean)) AS p, round(resp_latency_mean, 6) + 0e0 AS latency FROM f),
n AS (SELECT call_id, count(*) AS n_turns, round(max(e), 6) + 0e0 AS last_end FROM turns GROUP BY call_id), w AS (SELECT call_id, count(*) AS n_events FROM ({ORACLES['dialogue_events']}) GROUP BY call_id),
t AS (SELECT call_id, string_agg(feature, ',' ORDER BY rank) AS top FROM ({ORACLES['top_factors']}) GROUP BY call_id)
SELECT v.call_id, p>=0.42e0 AS is_synthetic, round(CASE WHEN p>=0.42e0 THEN p ELSE 1-p END, 4) AS confidence, n_turns, last_end, coalesce(n_events, -1) AS n_events, 23 AS n_features, latency, top, rationale
 FROM v LEFT JOIN n ON n.call_id=v.call_id LEFT JOIN w ON w.call_id=v.call_id LEFT JOIN t ON t.call_id=v.call_id LEFT JOIN ({ORACLES['rationale']}) AS r ON r.call_id=v.call_id"""))
def build_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the nested record of each call: its verdict, how many turns, events and features it holds, some of them, and its words."""
    turns, calls = view(spark, sf_dir, "turns"), view(spark, sf_dir, "calls")
    f = features(spark, sf_dir)
    p = f.select("call_id", (1 / (1 + F.exp(-F.col("resp_latency_mean")))).alias("p"))
    factors = rounded(ev.top_factors(f, feature_meta(spark, sf_dir)), 9)
    out = ev.build_analysis(ev.verdict(p, 0.42), turns, ev.dialogue_events(turns, calls), f, factors, ev.rationale(factors, iv.turn_counts(turns)))
    ends = F.array_max(F.transform("turns", lambda t: t["e"]))
    return out.select(
        "call_id", "verdict.is_synthetic", (F.col("verdict.confidence") + F.lit(0.0)).alias("confidence"), F.size("turns").cast("long").alias("n_turns"), (F.round(ends, 6) + F.lit(0.0)).alias("last_end"),
        F.coalesce(F.size("events"), F.lit(-1)).cast("long").alias("n_events"), F.size("features").alias("n_features"), (F.round(F.col("features")["resp_latency_mean"], 6) + F.lit(0.0)).alias("latency"),
        F.array_join(F.transform("top_factors", lambda t: t["feature"]), ",").alias("top"), "rationale",
    )
