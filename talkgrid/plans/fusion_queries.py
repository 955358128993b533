"""Queries over layer scores, running verdicts and the verdict log."""

from pyspark.sql import functions as F

from ..functions.scalar import sigmoid
from ..operators import calllog as L
from ..operators import events as E
from ..operators import fusion as U
from ..operators import prefix as X
from ..operators.metrics import evaluate
from ..sources import corpus as C
from ..sources import logs as G
from .interval_queries import norm
from .metrics_queries import AUC, curve_sql
from .registry import query
from .tables import CALL_MS, NOW, VIEWS

D = CALL_MS
CONFIGS = [
    {"config_id": "base"}, {"config_id": "logit", "mode": "logit_mean"}, {"config_id": "neutral", "on_abstain": "neutral"},
    {"config_id": "quality", "use_quality": True, "verify_threshold": 0.6}, {"config_id": "flat", "use_verifiers": False, "confidence_mode": "synthetic"},
    {"config_id": "tilted", "weights": {"acoustic": 0.9, "semantic": 0.4}, "threshold": 0.4}, {"config_id": "muted", "weights": {"acoustic": 0.0, "behaviour": 0.0, "semantic": 0.0}},
    {"config_id": "swapped", "roles": {"semantic": "primary", "behaviour": "verifier"}},
]
VIEWS["d_cfg"] = """select * from (values
  ('base','weighted_mean','renormalise',false,0.5::double,'verdict',0.8::double,true,0.5::double,0.5::double,0.15::double,'primary','verifier'),
  ('logit','logit_mean','renormalise',false,0.5,'verdict',0.8,true,0.5,0.5,0.15,'primary','verifier'), ('neutral','weighted_mean','neutral',false,0.5,'verdict',0.8,true,0.5,0.5,0.15,'primary','verifier'),
  ('quality','weighted_mean','renormalise',true,0.5,'verdict',0.6,true,0.5,0.5,0.15,'primary','verifier'), ('flat','weighted_mean','renormalise',false,0.5,'synthetic',0.8,false,0.5,0.5,0.15,'primary','verifier'),
  ('tilted','weighted_mean','renormalise',false,0.4,'verdict',0.8,true,0.9,0.5,0.4,'primary','verifier'), ('muted','weighted_mean','renormalise',false,0.5,'verdict',0.8,true,0.0,0.0,0.0,'primary','verifier'),
  ('swapped','weighted_mean','renormalise',false,0.5,'verdict',0.8,true,0.5,0.5,0.15,'verifier','primary'))
  c(config_id, mode, on_abstain, use_quality, threshold, confidence_mode, verify_threshold, use_verifiers, wa, wb, ws, role_b, role_s)"""
VIEWS["d_con"] = """select l.call_id, l.key, l.abstained, c.*, case key when 'acoustic' then wa when 'behaviour' then wb else ws end as raw,
    case when abstained then 0.5::double else least(greatest(probability,0),1) end as p,
    (key='acoustic' or (key='behaviour' and role_b='primary') or (key='semantic' and role_s='primary')) as prim,
    case when abstained and on_abstain='renormalise' then 0.0::double else case key when 'acoustic' then wa when 'behaviour' then wb else ws end * case when use_quality then quality else 1 end end as w
  from d_layers l, d_cfg c"""
VIEWS["d_x"] = "select *, case when mode='logit_mean' then ln(least(greatest(p,1e-6),1-1e-6)/(1-least(greatest(p,1e-6),1-1e-6))) else p end as x from d_con"
VIEWS["d_g0"] = """select call_id, config_id, any_value(mode) as mode, any_value(threshold) as threshold, any_value(confidence_mode) as cm, any_value(verify_threshold) as vt, any_value(use_verifiers) as uv,
    coalesce(sum(w) filter (prim),0) as pw, coalesce(sum(w*x) filter (prim),0) as px, coalesce(sum(w) filter (not prim),0) as vw, coalesce(sum(w*x) filter (not prim),0) as vx,
    count(*) filter (prim and w>0) as np, count(*) filter (not prim and w>0) as nv, count(*) filter (not prim) as vs from d_x group by call_id, config_id"""
MIX = "coalesce(case when mode='logit_mean' then 1/(1+exp(-({x})/nullif({w},0))) else ({x})/nullif({w},0) end, 0.5)"
VIEWS["d_g1"] = f"select *, {MIX.format(x='px', w='pw')} as pp from d_g0"
VIEWS["d_g2"] = "select *, case when pw>0 then greatest(pp,1-pp) else 0 end as pc, pw>0 and round(greatest(pp,1-pp)::decimal(38,14),12) >= vt as settled from d_g1"
VIEWS["d_g3"] = "select *, vs>0 and (not uv or not settled) as consult from d_g2"
VIEWS["d_g4"] = f"""select *, {MIX.format(x='px + case when consult then vx else 0 end', w='pw + case when consult then vw else 0 end')} as p,
   pw + case when consult then vw else 0 end > 0 as decisive from d_g3"""
VIEWS["d_verdicts"] = """select call_id, config_id, round_even(p,6) as p, decisive and round(p::decimal(38,14),12) >= threshold as is_synthetic,
   round_even(case when decisive then case when cm='verdict' then greatest(p,1-p) else p end else 0.5 end,4) as confidence, decisive,
   case when decisive then np + case when consult then nv else 0 end else 0 end as n_layers_used, round_even(pp,6) as primary_p, round_even(pc,4) as primary_confidence,
   settled, consult and decisive as verifiers_consulted from d_g4"""


def configs(t):
    return U.valid_configs(t.spark, CONFIGS)


def verdicts(t):
    return U.combine(t.layer_scores(), configs(t))


def base_verdicts(t):
    return U.combine(t.layer_scores(), U.valid_configs(t.spark, CONFIGS[:1]))


@query("fus_01_effective_weights", """with s as (select *, sum(case when prim or false then w else 0 end) over (partition by call_id, config_id) as tot from d_con)
  select call_id, config_id, key, case when prim then 'primary' else 'verifier' end as layer_role, raw as weight, w as effective_weight, p from s""", r="weight effective_weight p")
def _(t):
    return U.contributions(t.layer_scores(), configs(t)).select("call_id", "config_id", "key", "layer_role", "weight", "effective_weight", "p")


@query("fus_01_layer_shares", """with s as (select c.call_id, c.config_id, c.key, c.raw, c.prim, case when prim or v.verifiers_consulted then w else 0 end as w
    from d_con c join d_verdicts v on c.call_id=v.call_id and c.config_id=v.config_id)
  select call_id, config_id, key, case when prim then 'primary' else 'verifier' end as role, raw as weight,
    coalesce(w/nullif(sum(w) over (partition by call_id, config_id),0),0) as share from s""", r="weight share")
def _(t):
    return U.layer_shares(t.layer_scores(), configs(t), verdicts(t))


@query("fus_02_mix", "select call_id, config_id, primary_p, p from d_verdicts", r="primary_p p")
def _(t):
    return verdicts(t).select("call_id", "config_id", "primary_p", "p")


@query("fus_03_gate", "select call_id, config_id, settled, verifiers_consulted, primary_confidence, n_layers_used from d_verdicts", r="primary_confidence")
def _(t):
    return verdicts(t).select("call_id", "config_id", "settled", "verifiers_consulted", "primary_confidence", "n_layers_used")


@query("fus_04_final_decision", "select call_id, config_id, is_synthetic, confidence, decisive from d_verdicts", r="confidence")
def _(t):
    return verdicts(t).select("call_id", "config_id", "is_synthetic", "confidence", "decisive")


@query("fus_05_config_table", """with l as (select o_orderkey as k from orders), c as (select 'k' || k as config_id, case when k % 11 = 0 then 'sum' else 'weighted_mean' end as mode,
    case when k % 7 = 0 then 1.5::double else 0.5::double end as threshold, case when k % 5 = 0 then -1.0::double else 0.25::double end as wa, case when k % 13 = 0 then 'judge' else 'verifier' end as rs from l)
  select config_id, case when mode='sum' then 'mode' when threshold=1.5 then 'threshold' when wa<0 then 'weights' when rs='judge' then 'roles' end as invalid, wa as acoustic, 0.5::double as behaviour from c""")
def _(t):
    k = F.col("o_orderkey")
    raw = t.raw("orders").select(
        F.concat(F.lit("k"), k.cast("string")).alias("config_id"),
        F.create_map(F.lit("acoustic"), F.when(k % 5 == 0, -1.0).otherwise(0.25)).alias("weights"),
        F.create_map(F.lit("semantic"), F.when(k % 13 == 0, "judge").otherwise("verifier")).alias("roles"),
        F.when(k % 11 == 0, "sum").alias("mode"), F.lit(None).cast("string").alias("on_abstain"), F.lit(None).cast("boolean").alias("use_quality"),
        F.when(k % 7 == 0, 1.5).alias("threshold"), F.lit(None).cast("string").alias("confidence_mode"), F.lit(None).cast("double").alias("verify_threshold"),
        F.lit(None).cast("boolean").alias("use_verifiers"))
    return U.complete_configs(t.spark, raw).select("config_id", "invalid", F.col("weights")["acoustic"].alias("acoustic"), F.col("weights")["behaviour"].alias("behaviour"))


@query("fus_06_recombine", "select call_id, config_id, p, is_synthetic, confidence, decisive, n_layers_used, primary_p, primary_confidence, settled, verifiers_consulted from d_verdicts",
       r="p confidence primary_p primary_confidence")
def _(t):
    return verdicts(t).drop("note")


@query("fus_07_verification_worklist", """select v.call_id, 'semantic' as key from d_verdicts v where config_id='base' and not settled and v.call_id % 3 <> 0
  and not exists (select 1 from d_layers l where l.call_id=v.call_id and l.key='semantic')""")
def _(t):
    layers = t.layer_scores()
    held = t.order_calls().where("call_id % 3 = 0").select("call_id", F.lit("semantic").alias("key"))
    return U.verification_worklist(layers, base_verdicts(t), ["semantic"], held)


@query("fus_08_weight_sweep", """with g as (select i/10.0::double as weight from range(11) r(i)),
  c as (select call_id, weight, sum(case when abstained then 0 else case key when 'acoustic' then weight else 1-weight end end) as w,
      sum(case when abstained then 0 else case key when 'acoustic' then weight else 1-weight end * least(greatest(probability,0),1) end) as x
    from d_layers, g where key<>'semantic' group by all),
  v as (select call_id, weight, round_even(coalesce(x/nullif(w,0),0.5),6) as p, w>0 and round(coalesce(x/nullif(w,0),0.5)::decimal(38,14),12)>=0.5 as s from c)
  select weight, count(*) as n, avg((s=(y=1))::int) as accuracy, avg(pow(p-y,2)) as brier from v join d_order_calls using (call_id) group by weight""", r="weight accuracy brier")
def _(t):
    return U.weight_sweep(t.layer_scores(), t.order_calls(), "acoustic", "behaviour", 11).select("weight", "n", "accuracy", "brier")


@query("fus_09_layer_only", f"""with e as (select call_id, y, unnest(['acoustic','behaviour','semantic']) as key from d_order_calls),
  j as (select e.call_id, e.y, e.key, not coalesce(abstained,true) as answered, case when coalesce(abstained,true) then 0.5::double else probability end as p from e left join d_layers l on l.call_id=e.call_id and l.key=e.key),
  b as (select key, y, p as score from j where answered), c as ({curve_sql('b', 'key')}), a as (select key, {AUC} as auc from c group by key)
  select key, count(*) as n, count(*) filter (answered) as n_answered, avg(((p>=0.5)=(y=1))::int) as accuracy_forced, avg(pow(p-y,2)) as brier,
    avg(((p>=0.5)=(y=1))::int) filter (answered) as accuracy, avg(pow(p-y,2)) filter (answered) as brier_answered, any_value(auc) as auc from j left join a using (key) group by key""",
       r="accuracy_forced brier accuracy brier_answered auc")
def _(t):
    return U.layer_only(t.layer_scores(), t.order_calls(), ["acoustic", "behaviour", "semantic"])


@query("fus_10_equal_weights", """select call_id, 1.0::double/count(*) as weight, round_even(coalesce(avg(probability) filter (not abstained),0.5),6) as p,
  coalesce(round(avg(probability) filter (not abstained), 12) >= 0.5, false) as is_synthetic from d_layers group by call_id""", r="weight p")
def _(t):
    return U.equal_weights(t.layer_scores())


def wide_layers(t):
    return G.telemetry_view(t.layer_scores())


VIEWS["d_wide"] = """select call_id, max(round_even(probability,4)) filter (key='acoustic' and not abstained) as acoustic_score, max(round_even(probability,4)) filter (key='behaviour' and not abstained) as behavioral_score,
  max(round_even(probability,4)) filter (key='semantic' and not abstained) as semantic_score from d_layers group by call_id"""


@query("fus_11_simple_weighted", """select call_id, (coalesce(acoustic_score*0.6,0)+coalesce(behavioral_score*0.3,0)+coalesce(semantic_score*0.1,0))
  /nullif(case when acoustic_score is not null then 0.6 else 0 end + case when behavioral_score is not null then 0.3 else 0 end + case when semantic_score is not null then 0.1 else 0 end,0)::double as p from d_wide""", r="p")
def _(t):
    w = {"acoustic_score": 0.6, "behavioral_score": 0.3, "semantic_score": 0.1}
    return U.simple_weighted(wide_layers(t), w).select("call_id", "p")


@query("fus_12_fusion_metrics", """select config_id, count(*) as n, avg((is_synthetic=(y=1))::int) as accuracy, avg(pow(p-y,2)) as brier, count(*) filter (y=0 and not is_synthetic) as tn,
  count(*) filter (y=0 and is_synthetic) as fp, count(*) filter (y=1 and not is_synthetic) as fn, count(*) filter (y=1 and is_synthetic) as tp,
  (count(*) filter (y=0 and is_synthetic))::double/nullif(count(*) filter (y=0),0) as fpr, (count(*) filter (y=1 and not is_synthetic))::double/nullif(count(*) filter (y=1),0) as fnr,
  count(*) filter (verifiers_consulted) as n_verifier_consulted, count(*) filter (settled) as n_settled, count(*) filter (not decisive) as n_abstained
  from d_verdicts join d_order_calls using (call_id) group by config_id""", r="accuracy brier fpr fnr")
def _(t):
    return U.fusion_metrics(verdicts(t), t.order_calls())


# ------------------------------------------------------------------------------ running verdicts

VIEWS.update({
    # whole-number scores keep running signs exact on both sides
    "d_ichunks": "select call_id, chunk, (chunk-1)*9.0::double as start_s, (chunk-1)*9.0::double + 1 + round(discount*100)/4 as end_s, quantity*2-51 as score from d_chunks",
    "d_prog": """select call_id, chunk, start_s, end_s, score, avg(score) over w as m, max(score) over w as mx, sum(end_s-start_s) over w as speech
      from d_ichunks window w as (partition by call_id order by chunk)""",
    "d_steps": """select call_id, chunk, round_even(end_s,2) as call_time_s, round_even(start_s,2) as chunk_start_s, round_even(speech,2) as caller_speech_s, round_even(score,4) as chunk_score,
      round_even(1/(1+exp(-(0.1*score-0.05))),4) as chunk_probability, round_even(1/(1+exp(-(0.1*m-0.05))),4) as p,
      1/(1+exp(-(0.1*m-0.05))) >= 0.85 or 1/(1+exp(-(0.1*m-0.05))) <= 0.15 as confident from d_prog""",
    "d_sure": "select call_id, min(chunk) filter (confident) as sc, min(chunk) as fc, max(chunk) as lc, count(*) as n, max(p)-min(p) as spread from d_steps group by call_id",
    "d_det": """select o.call_id, o.label, o.duration_s, coalesce(u.n,0) as n_chunks, f.call_time_s as first_at_s, f.p as first_p, s.call_time_s as confident_at_s, s.caller_speech_s as confident_after_speech_s,
      s.p as early_p, s.chunk as confident_chunk, l.p as final_p, case when s.p is not null then round_even(greatest(o.duration_s-s.call_time_s,0),2) end as lead_s, case when s.p is not null then round_even(least(s.call_time_s/o.duration_s,1)*100,1) end as percent_elapsed,
      case when s.p>=0.5 then 'synthetic' when s.p is not null then 'human' end as early_verdict, case when l.p>=0.5 then 'synthetic' when l.p is not null then 'human' end as final_verdict,
      l.p is not null and s.p is null as never_confident, round_even(coalesce(u.spread,0),4) as spread
      from d_order_calls o left join d_sure u using (call_id) left join d_steps f on f.call_id=o.call_id and f.chunk=u.fc left join d_steps l on l.call_id=o.call_id and l.chunk=u.lc
      left join d_steps s on s.call_id=o.call_id and s.chunk=u.sc""",
    "d_det2": "select *, early_verdict = final_verdict as agrees from d_det",
})


def ichunks(t):
    return t.chunks().select("call_id", "chunk", "start_s", (F.col("start_s") + 1 + F.round(F.col("discount") * 100) / 4).alias("end_s"), (F.col("quantity") * 2 - 51).alias("score"))


def steps(t, how="mean"):
    return X.progression(ichunks(t), how, 0.1, -0.05)


def detections(t):
    return X.detection_metrics(steps(t), t.order_calls())


@query("lat_01_progression", "select * from d_steps", r="call_time_s chunk_start_s caller_speech_s chunk_score chunk_probability p")
def _(t):
    return steps(t)


@query("lat_01_progression_max", "select call_id, chunk, round_even(1/(1+exp(-(0.1*mx-0.05))),4) as p from d_prog", r="p")
def _(t):
    return steps(t, "max").select("call_id", "chunk", "p")


@query("lat_01_progression_median", """select a.call_id, a.chunk, round_even(1/(1+exp(-(0.1*median(b.score)-0.05))),4) as p from d_ichunks a join d_ichunks b on a.call_id=b.call_id and b.chunk<=a.chunk group by all""", r="p")
def _(t):
    return steps(t, "median").select("call_id", "chunk", "p")


PREFIXES = """select a.call_id, a.chunk, list_sort(list(b.score)) as s, count(b.score) as m from d_ichunks a join d_ichunks b on a.call_id=b.call_id and b.chunk<=a.chunk group by all"""


@query("lat_01_progression_top25", f"""with v as ({PREFIXES}), r as (select call_id, chunk, list_sum(s[m - greatest(1, ceil(m/4))::int + 1 : m]) / greatest(1, ceil(m/4)) as v from v)
  select call_id, chunk, round_even(1/(1+exp(-(0.1*v-0.05))),4) as p from r""", r="p")
def _(t):
    return steps(t, "top25_mean").select("call_id", "chunk", "p")


@query("lat_01_progression_trimmed", f"""with v as ({PREFIXES}), r as (select call_id, chunk, list_avg(s[m // 10 + 1 : m - m // 10]) as v from v)
  select call_id, chunk, round_even(1/(1+exp(-(0.1*v-0.05))),4) as p from r""", r="p")
def _(t):
    return steps(t, "trimmed_mean").select("call_id", "chunk", "p")


@query("lat_02_first_confident", "select call_id, n_chunks, first_at_s, first_p, confident_at_s, confident_after_speech_s, early_p, confident_chunk from d_det",
       r="first_at_s first_p confident_at_s confident_after_speech_s early_p")
def _(t):
    return detections(t).select("call_id", "n_chunks", "first_at_s", "first_p", "confident_at_s", "confident_after_speech_s", "early_p", "confident_chunk")


@query("lat_03_lead_time", "select call_id, lead_s, percent_elapsed from d_det", r="lead_s percent_elapsed")
def _(t):
    return detections(t).select("call_id", "lead_s", "percent_elapsed")


@query("lat_04_early_vs_final", "select call_id, early_verdict, final_verdict, agrees, never_confident from d_det2")
def _(t):
    return detections(t).select("call_id", "early_verdict", "final_verdict", "agrees", "never_confident")


@query("lat_05_decided_at", """with s as (select *, (m>=0) = (last_value(m) over (partition by call_id order by chunk rows between unbounded preceding and unbounded following) >= 0) as same from d_prog),
  o as (select call_id, coalesce(max(chunk) filter (not same),0) as off from s group by call_id)
  select s.call_id, round_even(s.end_s,2) as decided_at_s from s join o on s.call_id=o.call_id and s.chunk=o.off+1""", r="decided_at_s")
def _(t):
    return X.decided_at(ichunks(t))


def event_steps(t):
    """Steps at fixed tenths of the calls behind the turn tables, the acoustic answer a hash of call and step."""
    k = F.explode(F.sequence(F.lit(1), F.lit(4)))
    c = t.calls().select("call_id", k.alias("chunk"))
    return c.select("call_id", "chunk", (F.col("chunk") * 648.0).alias("call_time_s"), (F.col("chunk") * 10.0).alias("caller_speech_s"),
                    ((F.col("call_id") * 7 + F.col("chunk") * 13) % 100 / 100).alias("p"))


VIEWS["d_est"] = "select call_id, chunk, chunk*648000 as lim, ((call_id*7+chunk*13) % 100)/100.0::double as pa from d_calls, range(1,5) r(chunk)"
PREFIX_NORM = """select s.call_id, s.{k} as k, s.lim, n.channel, n.start_ms, least(n.end_ms, s.lim) as end_ms from {steps} s join d_norm n on n.call_id=s.call_id and n.start_ms < s.lim"""


def prefix_sql(steps_view: str, k: str) -> str:
    """Event counts, speech and evidence quality of every call cut at every step."""
    return f"""n as ({PREFIX_NORM.format(k=k, steps=steps_view)}),
  sp as (select call_id, k, sum(end_ms-start_ms) filter (channel=0)/1000.0::double as cs, sum(end_ms-start_ms) filter (channel=1)/1000.0::double as ags from n group by all),
  i as (select a.call_id, a.k, count(*) as n from n a join n c on a.call_id=c.call_id and a.k=c.k and a.channel=1 and c.channel=0 and c.start_ms+64<a.start_ms and a.start_ms<c.end_ms and least(c.end_ms,a.end_ms)-a.start_ms>=96 group by all),
  b as (select c.call_id, c.k, count(*) as n from n c join n a on a.call_id=c.call_id and a.k=c.k and c.channel=0 and a.channel=1 and a.start_ms+64<c.start_ms and c.start_ms<a.end_ms and least(c.end_ms,a.end_ms)-c.start_ms>=96 group by all),
  -- a response: an agent turn ends with nobody speaking and no further agent turn starts before the caller does
  rs as (select a.call_id, a.k, a.end_ms, (select min(c.start_ms) from n c where c.call_id=a.call_id and c.k=a.k and c.channel=0 and c.start_ms>=a.end_ms) as nc,
      (select min(x.start_ms) from n x where x.call_id=a.call_id and x.k=a.k and x.channel=1 and x.start_ms>=a.end_ms) as na,
      exists (select 1 from n c where c.call_id=a.call_id and c.k=a.k and c.channel=0 and c.start_ms<a.end_ms and c.end_ms>=a.end_ms) as busy from n a where a.channel=1),
  r as (select call_id, k, count(*) as n from rs where nc is not null and not busy and (na is null or nc<na) group by all),
  q as (select s.*, coalesce(cs,0) as cs, coalesce(ags,0) as ags, coalesce(r.n,0) as rn, coalesce(i.n,0) as inn, coalesce(b.n,0) as bn from {steps_view} s
    left join sp on sp.call_id=s.call_id and sp.k=s.{k} left join i on i.call_id=s.call_id and i.k=s.{k} left join b on b.call_id=s.call_id and b.k=s.{k} left join r on r.call_id=s.call_id and r.k=s.{k}),
  ev as (select *, rn+inn+bn as event_count, least(1,cs/10,ags/10)*least(1,lim/30000.0::double)*(0.45*least(1,rn/8)+0.35*least(1,(inn+bn)/5)+0.2*least(1,greatest(0,inn-2)/4)) as q0 from q),
  qq as (select *, event_count<2 or least(cs,ags)<1 as weak, case when event_count<2 or least(cs,ags)<1 then 0 else q0 end as quality from ev)"""


@query("lat_06_fusion_progression", f"""with {prefix_sql('d_est', 'chunk')},
  f as (select *, case when weak or quality<=0 then pa else 0.5*pa + 0.5*((call_id % 97)/97.0::double) end as p, case when weak or quality<=0 then 1 else 2 end as n_layers_used from qq)
  select call_id, chunk::int as chunk, lim/1000.0::double as call_time_s, chunk*10.0::double as caller_speech_s, round_even(round_even(p,6),4) as p, round_even(p,6)>=0.85 or round_even(p,6)<=0.15 as confident, n_layers_used from f""",
       r="call_time_s caller_speech_s p")
def _(t):
    return X.fusion_progression(event_steps(t), norm(t), U.valid_configs(t.spark, CONFIGS[:1]), (F.col("call_id") % 97) / 97.0)


@query("lat_07_latency_benchmark", """with b as (select 'all' as scope, * from d_det2 union all select label, * from d_det2)
  select scope, count(*) as n, count(confident_at_s) as n_detected, count(*) filter (never_confident) as n_never_confident,
    round_even(100*avg((percent_elapsed<=50)::int),1) as before_halfway_pct, round_even(100*avg(agrees::int),1) as agrees_pct, round_even(median(confident_after_speech_s),2) as median_speech_s,
    round_even(median(confident_at_s),2) as median_call_s, round_even(median(lead_s),2) as median_lead_s, round_even(median(percent_elapsed),2) as median_percent from b group by scope""",
       r="before_halfway_pct agrees_pct median_speech_s median_call_s median_lead_s median_percent")
def _(t):
    return X.latency_benchmark(detections(t))


@query("lat_08_notable_calls", """select * from (select call_id, 'gradual' as why, spread, first_p, final_p from d_det2 where n_chunks>=3 order by spread desc, call_id limit 6)
  union all select call_id, 'disagreed', spread, first_p, final_p from d_det2 where not agrees""", r="spread first_p final_p")
def _(t):
    return X.notable_calls(detections(t))


@query("lat_08_flat_calls", "select count(*) filter (spread<0.02) as n_flat, count(*) as n_total from d_det2")
def _(t):
    return X.flat_calls(detections(t))


VIEWS["d_pre"] = "select call_id, y, prefix, lim from d_calls, (values ('60',60000),('600',600000),('full',2592000)) p(prefix, lim)"


def prefix_results(t):
    f = X.prefix_features(norm(t), t.calls(), [60, 600]).withColumn("p", (F.col("call_id") % 97) / 97.0)
    return E.behaviour_result(f)


@query("lat_09_prefix_table", f"""with {prefix_sql('d_pre', 'prefix')}, f as (select *, case when weak then 0.5::double else (call_id % 97)/97.0::double end as p from qq)
  select prefix, count(*) as n, avg(event_count) as mean_events, avg(quality) as mean_quality, avg(quality*abs(2*p-1)) as mean_confidence, count(*) filter (weak) as insufficient_calls from f group by prefix""",
       r="mean_events mean_quality mean_confidence")
def _(t):
    return X.prefix_table(prefix_results(t))


@query("lat_09_prefix_metrics", f"""with {prefix_sql('d_pre', 'prefix')}, f as (select prefix, y, case when weak then 0.5::double else (call_id % 97)/97.0::double end as score from qq),
  c as ({curve_sql('f', 'prefix')}) select prefix, {AUC} as auc from c group by prefix""", r="auc")
def _(t):
    r = prefix_results(t)
    return evaluate(r, ["prefix"], "p", 0.5, probability="p").select("prefix", "auc")


@query("lat_10_decision_policy_impact", f"""with {prefix_sql('d_pre', 'prefix')}, f as (select *, case when weak then 0.5::double else (call_id % 97)/97.0::double end as p, quality<=0 or event_count<2 as blank from qq)
  select prefix, avg(((p>=0.5)=(y=1))::int) as accuracy_before, avg(((p>=0.5 and not blank)=(y=1))::int) as accuracy_after, count(*) filter (not blank) as available, count(*) filter (blank) as fallback,
    count(*) filter (blank and y=0) as fallback_human, count(*) filter (blank and y=1) as fallback_synthetic from f group by prefix""", r="accuracy_before accuracy_after")
def _(t):
    return X.decision_policy_impact(prefix_results(t))


# ------------------------------------------------------------------------------ the log

N = f"timestamp '{NOW}'"


@query("set_01_recent", f"select id, \"at\", verdict, latency_ms from d_log where \"at\" >= {N} - interval 48 hour and ok order by \"at\" desc, id limit 100", r="latency_ms")
def _(t):
    return L.recent(t.call_log(), NOW, 48, 100).select("id", "at", "verdict", "latency_ms")


@query("log_01_latency_series", f"""with b as (select 47 - cast(floor(epoch_us({N}) - epoch_us("at")) as bigint)//1000000//7200 as bucket, latency_ms from d_log where ok and "at" >= {N} - interval 96 hour),
  b2 as (select *, row_number() over (partition by bucket order by latency_ms) as rk, count(*) over (partition by bucket) as n from b where bucket between 0 and 47),
  m as (select bucket, round_even(latency_ms,0) as p from b2 where rk = n//2 + 1)
  select i::int as bucket, coalesce(last_value(p ignore nulls) over (order by i), 0)::double as latency_ms from range(48) s(i) left join m on m.bucket=s.i""")
def _(t):
    return L.latency_series(t.call_log(), NOW, 96, 48)


@query("log_02_health_stats", f"select count(*) as n, count(*) filter (ok) as ok, case when count(*)=0 then 100.0::double else round_even(100.0*count(*) filter (ok)/count(*),2)::double end as uptime from d_log where \"at\" >= {N} - interval 72 hour", r="uptime")
def _(t):
    return L.health_stats(t.call_log(), NOW, 72)


@query("log_03_prune", f"select id, \"at\" from d_log where \"at\" >= {N} - interval 10 day")
def _(t):
    return L.prune(t.call_log(), NOW, 10).select("id", "at")


@query("log_04_detection_stats", """select count(*) as total, count(*) filter (verdict='synthetic') as synthetic, count(*) filter (verdict<>'synthetic') as human, avg(confidence) as average_confidence,
  avg(latency_ms) as average_latency_ms from d_log""", r="average_confidence average_latency_ms")
def _(t):
    return L.detection_stats(t.call_log())


@query("log_05_hourly_verdicts", f"""with b as (select 23 - floor((epoch_us({N}) - epoch_us("at"))/3600e6)::int as bucket, verdict from d_log where ok)
  select i::int as bucket, count(*) filter (verdict='human') as human, count(*) filter (verdict='synthetic') as synthetic, count(*) filter (verdict='abstained') as abstained
  from range(24) s(i) left join b on b.bucket=s.i group by i""")
def _(t):
    return L.hourly_verdicts(t.call_log(), NOW)


@query("log_06_confidence_histogram", "select i::int as bin, count(id) as n from range(10) s(i) left join (select id, least(9, floor(confidence*10))::int as b from d_log where ok) on b=i group by i")
def _(t):
    return L.confidence_histogram(t.call_log())


FLOOR = "(select {v} from (select {v}, row_number() over (order by {v}) - 1 as i, count(*) over () as n from d_log where ok and {v} is not null) where i = least(n-1, floor({p}*n)))"


@query("log_07_summary", f"""select count(*) filter (ok) as calls, count(*) filter (ok and verdict='synthetic') as synthetic, count(*) filter (ok and verdict='abstained') as abstained,
  {FLOOR.format(v='latency_ms', p='0.5')} as latency_p50_ms, {FLOOR.format(v='latency_ms', p='0.95')} as latency_p95_ms, {FLOOR.format(v='decided_at_s', p='0.5')} as decided_p50_s from d_log""",
       r="latency_p50_ms latency_p95_ms decided_p50_s")
def _(t):
    return L.summary(t.call_log())


@query("log_08_latest", "select queue, id, rank from (select *, row_number() over (partition by queue order by \"at\" desc, id) as rank from d_log) where rank <= 5")
def _(t):
    return L.latest(t.call_log(), "queue", 5).select("queue", "id", "rank")


@query("log_09_request_latency", """with r as (select queue, latency_ms, row_number() over (partition by queue order by latency_ms) as rk, count(*) over (partition by queue) as n from d_log where ok),
  q as (select queue, median(latency_ms) as median_ms, max(latency_ms) filter (rk = least(n, greatest(1, ceil(n*0.95)))) as p95_ms from r group by queue)
  select queue, count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed, avg(latency_ms) filter (ok) as mean_ms, max(latency_ms) filter (ok) as max_ms, any_value(median_ms) as median_ms, any_value(p95_ms) as p95_ms
  from d_log join q using (queue) group by queue""", r="mean_ms max_ms median_ms p95_ms")
def _(t):
    return L.request_latency(t.call_log())


@query("log_10_path_counts", "select verdict as used, case when latency_ms > 1000 then 'slow' else '' end as reason, count(*) as n from d_log group by all")
def _(t):
    d = t.call_log().select(F.col("verdict").alias("used"), F.when(F.col("latency_ms") > 1000, "slow").otherwise("").alias("reason"))
    return L.path_counts(d, "used", "reason")


@query("prj_12_call_search", "select id, verdict from d_log where verdict='synthetic' and (contains(id::varchar,'42') or contains(queue::varchar,'42'))")
def _(t):
    return L.call_search(t.call_log(), "synthetic", " 42 ").select("id", "verdict")


@query("prj_13_evidence_row", """select call_id, coalesce(acoustic_score,0) as acoustic, coalesce(behavioral_score,0) as conversational, coalesce(semantic_score,0) as semantic, left(repeat('q', (call_id % 60)::int), 40) as queue
  from d_order_calls left join d_wide using (call_id)""", r="acoustic conversational semantic")
def _(t):
    c = t.order_calls().select("call_id", F.expr("repeat('q', cast(call_id % 60 as int))").alias("queue"))
    return G.evidence_row(t.layer_scores(), c)


# ------------------------------------------------------------------------------ log sources

@query("src_11_log_rows", """select v.call_id as id, case when not v.decisive then 'abstained' when v.is_synthetic then 'synthetic' else 'human' end as verdict, o.o_orderdate::date as date,
  string_agg(l.key || ':' || l.abstained, ',' order by l.key) as layers from d_verdicts v join orders o on o.o_orderkey=v.call_id join d_layers l on l.call_id=v.call_id where config_id='base' group by all""")
def _(t):
    v = base_verdicts(t).join(t.raw("orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").alias("at")), "call_id")
    r = G.log_rows(v, t.layer_scores())
    text = F.array_join(F.transform("layers", lambda x: F.concat(x["key"], F.lit(":"), x["abstained"].cast("string"))), ",")
    return r.select("id", "verdict", "date", text.alias("layers"))


@query("src_12_merge_layer_views", """with c as (select v.call_id, l.key, case l.key when 'semantic' then 'verifier' else 'primary' end as role, 0.1::double as quality from d_verdicts v join d_layers l on l.call_id=v.call_id where config_id='base'),
  r as (select call_id, key, quality from d_layers where call_id % 2 = 0)
  select c.call_id, c.key, c.role, case when c.call_id % 2 = 0 then r.quality else c.quality end as quality from c left join r on r.call_id=c.call_id and r.key=c.key""", r="quality")
def _(t):
    lay = t.layer_scores()
    c = lay.select("call_id", "key", F.when(F.col("key") == "semantic", "verifier").otherwise("primary").alias("role"), F.lit(0.1).alias("quality"))
    return G.merge_layer_views(lay.where("call_id % 2 = 0").select("call_id", "key", "quality"), c).select("call_id", "key", "role", "quality")


BODY = """select event_id, case event_id % 6 when 0 then '{"call_id":"c' || event_id || '","is_synthetic":true,"confidence":' || (value/600)::varchar || '}'
  when 1 then '{"call_id":"c","is_synthetic":false,"confidence":1.5}' when 2 then '{"call_id":"c","is_synthetic":false,"confidence":0.5,"extra":1}' when 3 then '{"call_id":"","is_synthetic":false,"confidence":0.5}'
  when 4 then 'oops' else '{"call_id":"c","is_synthetic":false,"confidence":0.5,"latency_ms":-1}' end as body from events"""


@query("src_13_detection_sink", """select event_id, case event_id % 6 when 1 then 'range' when 2 then 'unknown_field' when 3 then 'call_id' when 4 then 'not_json' when 5 then 'latency' end as problem,
  case event_id % 6 when 0 then 'c' || event_id when 1 then 'c' when 2 then 'c' when 3 then '' when 5 then 'c' end as call_id from events""")
def _(t):
    k = F.col("event_id") % 6
    ok = F.concat(F.lit('{"call_id":"c'), F.col("event_id").cast("string"), F.lit('","is_synthetic":true,"confidence":'), (F.col("value") / 600).cast("string"), F.lit("}"))
    body = (F.when(k == 0, ok).when(k == 1, '{"call_id":"c","is_synthetic":false,"confidence":1.5}')
            .when(k == 2, '{"call_id":"c","is_synthetic":false,"confidence":0.5,"extra":1}').when(k == 3, '{"call_id":"","is_synthetic":false,"confidence":0.5}')
            .when(k == 4, "oops").otherwise('{"call_id":"c","is_synthetic":false,"confidence":0.5,"latency_ms":-1}'))
    return G.parse_detections(t.raw("events").select("event_id", body.alias("body"))).select("event_id", "problem", "call_id")


@query("src_14_telemetry_view", "select * from d_wide", r="acoustic_score behavioral_score semantic_score")
def _(t):
    return wide_layers(t)


@query("src_15_compact_manifest", """select 's' || l_orderkey as sample_id, max(l_shipdate) as created_at, max(l_extendedprice) filter (rk=1) as price from (
  select *, row_number() over (partition by l_orderkey order by l_shipdate desc, l_extendedprice desc) as rk from lineitem) group by l_orderkey""", r="price")
def _(t):
    li = t.raw("lineitem").groupBy("l_orderkey", "l_shipdate").agg(F.max("l_extendedprice").alias("price"))
    return G.compact_manifest(li.select(F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("sample_id"), F.col("l_shipdate").alias("created_at"), "price"))


@query("src_18_held_out_scores", """select call_id, coalesce(case when call_id % 2 = 0 then s end, case when call_id % 3 = 0 then s+1 end, s+2) as score,
  case when call_id % 2 = 0 then 0 when call_id % 3 = 0 then 1 else 2 end as source_rank from (select call_id, score as s from d_preds)""", r="score")
def _(t):
    p = t.predictions().select("call_id", "score")
    return C.first_source_wins([p.where("call_id % 2 = 0"), p.where("call_id % 3 = 0").withColumn("score", F.col("score") + 1), p.withColumn("score", F.col("score") + 2)])
