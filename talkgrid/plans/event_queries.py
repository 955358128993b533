"""Queries over conversation events and behaviour features."""

from pyspark.sql import functions as F

from ..functions.feature_sets import ALL_BEHAVIOUR, BEHAVIOUR_SETS, SHORTCUT_SETS
from ..operators import events as E
from ..operators import intervals as I
from .interval_queries import hyp, norm
from .registry import query
from .tables import CALL_MS, VIEWS

D = CALL_MS

VIEWS.update({
    "d_agents": f"select *, coalesce(lead(start_ms) over (partition by call_id order by start_ms), {D}) as next_agent from d_norm where channel=1",
    "d_inter0": f"""select a.call_id, a.start_ms as a, a.end_ms as ae, c.end_ms as ce, next_agent, least(c.end_ms,a.end_ms)-a.start_ms as overlap,
        c.end_ms < {D} as observed, case when c.end_ms < {D} then c.end_ms < a.end_ms - 64 end as yielded,
        (select min(n.start_ms) from d_norm n where n.call_id=a.call_id and n.channel=0 and n.start_ms >= c.end_ms) as nc
      from d_agents a join d_norm c on a.call_id=c.call_id and c.channel=0 and c.start_ms+64 < a.start_ms and a.start_ms < c.end_ms
        and least(c.end_ms,a.end_ms)-a.start_ms >= 96""",
    "d_inter1": "select *, case when yielded and nc < next_agent then nc end as resumed from d_inter0",
    "d_inter": f"""select call_id, a as onset_ms, overlap as overlap_ms, case when observed then ce-a end as stop_latency_ms, yielded,
        case when observed then yielded and ce-a <= 500 end as immediate_yield, resumed-ce as recovery_ms,
        case when ae < {D} then resumed-ae end as recovery_gap_ms, resumed <= ae+500 as retake from d_inter1""",
    "d_barge": f"""select c.call_id, c.start_ms as onset_ms, case when least(c.end_ms,a.end_ms) < {D} then least(c.end_ms,a.end_ms)-c.start_ms end as overlap_ms,
        case when a.end_ms < {D} then a.end_ms-c.start_ms end as lead_ms, case when a.end_ms < {D} then c.end_ms > a.end_ms+64 end as continues
      from d_norm c join d_norm a on a.call_id=c.call_id and c.channel=0 and a.channel=1 and a.start_ms+64 < c.start_ms and c.start_ms < a.end_ms
        and least(c.end_ms,a.end_ms)-c.start_ms >= 96""",
    "d_st2": """select *, lead(state,1) over w as s1, lead(start_ms,1) over w as t1, lead(state,2) over w as s2, lead(start_ms,2) over w as t2
      from d_states window w as (partition by call_id order by start_ms)""",
    "d_resp": """select s.call_id, case when s1=1 then t1 else t2 end as onset_ms, case when s1=1 then t1 else t2 end - s.end_ms as latency_ms,
        a.end_ms-a.start_ms as agent_ms from d_st2 s join d_norm a on a.call_id=s.call_id and a.channel=1 and a.end_ms=s.end_ms
      where state=2 and (s1=1 or (s1=0 and s2=1))""",
    "d_gaps": f"""select call_id, start_ms as onset_ms, end_ms-start_ms as duration_ms, s1=1 as caller_next from d_st2
      where state=0 and start_ms>0 and end_ms<{D} and end_ms-start_ms>=2000""",
    "d_pause": "select call_id, lead(start_ms) over (partition by call_id order by start_ms) - end_ms as v from d_norm where channel=0",
})


def summary_sql(source: str, value: str, prefix: str, stats: str, where: str = "true") -> str:
    forms = {
        "count": f"count({value})", "mean": f"avg({value})/1000", "median": f"median({value})/1000",
        "std": f"case when count({value})>=3 then stddev_samp({value})/1000 end",
        "iqr": f"case when count({value})>=3 then (quantile_cont({value},0.75)-quantile_cont({value},0.25))/1000 end",
        "cv": f"case when count({value})>=3 and avg({value})>=100 and min({value})>=0 then stddev_samp({value})/avg({value}) end"}
    cols = ", ".join(f"{forms[s]} as {prefix}_{s}" for s in stats.split())
    return f"(select call_id, {cols} from {source} where {where} group by call_id)"


VIEWS["d_features"] = f"""select c.call_id, {D / 1000}::double as duration_s,
  coalesce(n.cs,0)/1000.0::double as caller_speech_s, coalesce(n.ags,0)/1000.0::double as agent_speech_s,
  coalesce(s.sil,0)/1000.0::double as silence_s, coalesce(s.ov,0)/1000.0::double as overlap_s, coalesce(n.cs,0)/{D}.0::double as caller_proportion,
  coalesce(n.first_start,{D})/1000.0::double as leading_silence_s, ({D}-coalesce(n.last_end,0))/1000.0::double as trailing_silence_s,
  coalesce(n.nc,0) as caller_turn_count, coalesce(n.na,0) as agent_turn_count,
  ct.* exclude (call_id), at_.* exclude (call_id), p.* exclude (call_id),
  coalesce(r.response_latency_count,0) as response_latency_count, r.* exclude (call_id, response_latency_count),
  coalesce(i.interruption_count,0) as interruption_count, coalesce(i.interruption_count,0)/nullif(n.na,0) as interruption_rate,
  i.* exclude (call_id, interruption_count, recovery_latency_count, interruption_stop_latency_count),
  coalesce(i.recovery_latency_count,0) as recovery_latency_count,
  coalesce(b.barge_in_count,0) as barge_in_count, coalesce(b.barge_in_count,0)/nullif(n.nc,0) as barge_in_rate, b.* exclude (call_id, barge_in_count),
  coalesce(g.n,0) as extended_gap_count, g.f as extended_gap_caller_fraction, e.reaction_entropy,
  sh.short_context_response_std, lo.long_context_response_std
from d_calls c
left join (select call_id, sum(end_ms-start_ms) filter (channel=0) as cs, sum(end_ms-start_ms) filter (channel=1) as ags, min(start_ms) as first_start,
  max(end_ms) as last_end, count(*) filter (channel=0) as nc, count(*) filter (channel=1) as na from d_norm group by call_id) n using (call_id)
left join (select call_id, sum(end_ms-start_ms) filter (state=0) as sil, sum(end_ms-start_ms) filter (state=3) as ov from d_states group by call_id) s using (call_id)
left join {summary_sql('d_norm', '(end_ms-start_ms)', 'caller_turn', 'mean median std iqr', f'channel=0 and end_ms<{D}')} ct using (call_id)
left join {summary_sql('d_norm', '(end_ms-start_ms)', 'agent_turn', 'mean median', f'channel=1 and end_ms<{D}')} at_ using (call_id)
left join {summary_sql('d_pause', 'v', 'caller_pause', 'median')} p using (call_id)
left join {summary_sql('d_resp', 'latency_ms', 'response_latency', 'count mean median std iqr cv')} r using (call_id)
left join {summary_sql('d_resp', 'latency_ms', 'short_context_response', 'std', 'agent_ms < 3000')} sh using (call_id)
left join {summary_sql('d_resp', 'latency_ms', 'long_context_response', 'std', 'agent_ms >= 3000')} lo using (call_id)
left join (select * from (select call_id, count(*) as interruption_count, avg(yielded::int) as interruption_yield_fraction,
  avg(immediate_yield::int) as interruption_immediate_yield_fraction, avg(recovery_gap_ms)/1000 as recovery_gap_mean,
  avg(retake::int) as immediate_retake_fraction from d_inter group by call_id)
  join {summary_sql('d_inter', 'stop_latency_ms', 'interruption_stop_latency', 'count mean median std iqr cv')} using (call_id)
  join {summary_sql('d_inter', 'recovery_ms', 'recovery_latency', 'count mean std iqr cv')} using (call_id)) i using (call_id)
left join (select * from (select call_id, count(*) as barge_in_count, avg(continues::int) as barge_continues_fraction from d_barge group by call_id)
  join {summary_sql('d_barge', 'overlap_ms', 'barge_overlap', 'mean std iqr cv')} using (call_id)) b using (call_id)
left join (select call_id, count(*) as n, avg(caller_next::int) as f from d_gaps group by call_id) g using (call_id)
left join d_entropy e using (call_id)"""
VIEWS["d_entropy"] = """select call_id, n as n_known, case when n>=3 then -(case when a>0 then a/n*log2(a/n) else 0 end
   + case when b>0 then b/n*log2(b/n) else 0 end + case when h>0 then h/n*log2(h/n) else 0 end) + 0.0 end as reaction_entropy
  from (select call_id, count(yielded) as n, (count(*) filter (immediate_yield))::double as a, (count(*) filter (yielded and not immediate_yield))::double as b,
   (count(*) filter (not yielded))::double as h from d_inter group by call_id)"""
COUNTS = ["caller_turn_count", "agent_turn_count", "response_latency_count", "interruption_count", "recovery_latency_count",
          "barge_in_count", "extended_gap_count"]
DOUBLES = " ".join(c for c in ALL_BEHAVIOUR if c not in COUNTS)


def context(t):
    return E.turn_context(norm(t), t.calls())


def states(t):
    return I.speaking_states(norm(t), t.calls())


def features(t):
    return E.behaviour_features(t.turns(), t.calls())


@query("evt_01_interruptions", "select call_id, onset_ms, overlap_ms, stop_latency_ms, yielded, immediate_yield from d_inter")
def _(t):
    return E.interruptions(context(t)).select("call_id", "onset_ms", "overlap_ms", "stop_latency_ms", "yielded", "immediate_yield")


@query("evt_02_recovery", "select call_id, onset_ms, recovery_ms, recovery_gap_ms, retake from d_inter")
def _(t):
    return E.interruptions(context(t)).select("call_id", "onset_ms", "recovery_ms", "recovery_gap_ms", "retake")


@query("evt_03_barge_ins", "select * from d_barge")
def _(t):
    return E.barge_ins(context(t))


@query("evt_04_responses", "select * from d_resp")
def _(t):
    return E.responses(states(t))


@query("evt_05_response_latency", "select * from d_latency")
def _(t):
    return I.response_latency_simple(norm(t))


@query("evt_06_extended_gaps", "select * from d_gaps")
def _(t):
    return E.extended_gaps(states(t))


@query("evt_07_summarize", """with m as (select call_id, 'overlap' as metric, overlap_ms/1000.0::double as value from d_inter
  union all select call_id, 'stop', stop_latency_ms/1000.0::double from d_inter)
  select call_id, metric, count(value) as count, avg(value) as mean, median(value) as median, case when count(value)>=3 then stddev_samp(value) end as std,
  case when count(value)>=3 then quantile_cont(value,0.75)-quantile_cont(value,0.25) end as iqr,
  case when count(value)>=3 and avg(value)>=0.1 and min(value)>=0 then stddev_samp(value)/avg(value) end as cv from m group by all""",
       r="mean median std iqr cv")
def _(t):
    i = E.interruptions(context(t))
    long = i.select("call_id", F.explode(F.array(
        F.struct(F.lit("overlap").alias("metric"), (F.col("overlap_ms") / 1000).alias("value")),
        F.struct(F.lit("stop").alias("metric"), (F.col("stop_latency_ms") / 1000).alias("value")))).alias("m")).select("call_id", "m.*")
    return E.summarize(long)


@query("evt_08_fraction", "select call_id, avg(yielded::int) as yielded, avg(retake::int) as retake from d_inter group by call_id", r="yielded retake")
def _(t):
    return E.interruptions(context(t)).groupBy("call_id").agg(E.known_mean(F.col("yielded")).alias("yielded"),
                                                             E.known_mean(F.col("retake")).alias("retake"))


@query("evt_09_behaviour_features", f"select call_id, {', '.join(ALL_BEHAVIOUR)} from d_features", r=DOUBLES)
def _(t):
    return features(t).select("call_id", *ALL_BEHAVIOUR)


@query("evt_10_reaction_entropy", "select * from d_entropy", r="reaction_entropy")
def _(t):
    return E.reaction_entropy(E.interruptions(context(t)))


VIEWS["d_quality"] = """select call_id, caller_speech_s, agent_speech_s, response_latency_count+interruption_count+barge_in_count as event_count,
  least(greatest(least(1, caller_speech_s/10, agent_speech_s/10)*least(1, duration_s/30)*(0.45*least(1, response_latency_count/8)
   + 0.35*least(1,(interruption_count+barge_in_count)/5) + 0.20*least(1, greatest(0, interruption_count-2)/4)),0),1)::double as quality from d_features"""


@query("evt_11_evidence_quality", "select call_id, event_count, quality from d_quality", r="quality")
def _(t):
    return E.evidence_quality(features(t)).select("call_id", "event_count", "quality")


VIEWS["d_result"] = """select call_id, event_count, event_count<2 or least(caller_speech_s, agent_speech_s)<1 as insufficient,
  case when event_count<2 or least(caller_speech_s, agent_speech_s)<1 then 0.5::double else (call_id % 97)/97.0::double end as p,
  case when event_count<2 or least(caller_speech_s, agent_speech_s)<1 then 0.0::double else quality end as quality from d_quality"""


def result(t):
    q = E.evidence_quality(features(t)).withColumn("p", (F.col("call_id") % 97) / 97.0)
    return E.behaviour_result(q)


@query("evt_12_insufficient_evidence", "select call_id, insufficient, p, quality, quality*abs(2*p-1) as confidence from d_result", r="p quality confidence")
def _(t):
    return result(t).select("call_id", "insufficient", "p", "quality", "confidence")


@query("prj_04_challenge_response", """select call_id, quality<=0 or event_count<2 as abstained, case when quality<=0 or event_count<2 then false else p>=0.5 end as is_synthetic,
  case when quality<=0 or event_count<2 then 0.5::double when p>=0.5 then p else 1-p end as answer_confidence from d_result""", r="answer_confidence")
def _(t):
    return E.challenge_response(result(t)).select("call_id", "abstained", "is_synthetic", "answer_confidence")


def five(prefix, where, value="(end_ms-start_ms)/1000.0::double", source="d_norm"):
    return f"""(select call_id, avg({value}) as {prefix}_mean, stddev_pop({value}) as {prefix}_std, min({value}) as {prefix}_min, max({value}) as {prefix}_max,
      median({value}) as {prefix}_median from {source} where {where} group by call_id)"""


V1 = [f"{p}_{s}" for p in ("caller_turn_duration", "agent_turn_duration", "caller_pause", "response_latency") for s in ("mean", "std", "min", "max", "median")]
V1_MORE = ["pause_cv", "response_latency_cv", "quick_response_ratio", "interruption_rate", "overlap_seconds", "overlap_ratio",
           "caller_turns", "agent_turns", "response_count", "interruptions", "caller_speech_ratio", "agent_speech_ratio"]


@query("evt_13_conversation_features", f"""with j as (select c.call_id, {', '.join(f'coalesce({x},0)::double as {x}' for x in V1)},
    coalesce(nc,0)::double as caller_turns, coalesce(na,0)::double as agent_turns, coalesce(nr,0)::double as response_count, coalesce(qk,0)::double as qk,
    coalesce(ni,0)::double as interruptions, coalesce(cs,0)::double as cs, coalesce(ags,0)::double as ags, coalesce(ov,0)::double as overlap_seconds from d_calls c
  left join {five('caller_turn_duration', 'channel=0')} a using (call_id) left join {five('agent_turn_duration', 'channel=1')} b using (call_id)
  left join {five('caller_pause', 'v is not null', 'v/1000.0::double', 'd_pause')} p using (call_id)
  left join {five('response_latency', 'true', 'latency_ms/1000.0::double', 'd_latency')} l using (call_id)
  left join (select call_id, count(*) filter (channel=0) as nc, count(*) filter (channel=1) as na, sum(end_ms-start_ms) filter (channel=0)/1000.0::double as cs,
    sum(end_ms-start_ms) filter (channel=1)/1000.0::double as ags from d_norm group by call_id) n using (call_id)
  left join (select call_id, count(*) as nr, count(*) filter (latency_ms<=500) as qk from d_latency group by call_id) q using (call_id)
  left join (select call_id, sum(end_ms-start_ms)/1000.0::double as ov from d_states where state=3 group by call_id) o using (call_id)
  left join (select c.call_id, count(*) as ni from d_norm c where channel=0 and exists (select 1 from d_norm a where a.call_id=c.call_id and a.channel=1
    and a.start_ms<=c.start_ms and c.start_ms<a.end_ms) group by c.call_id) i using (call_id))
  select call_id, {', '.join(V1)}, coalesce(caller_pause_std/nullif(caller_pause_mean,0),0) as pause_cv, coalesce(response_latency_std/nullif(response_latency_mean,0),0) as response_latency_cv,
    coalesce(qk/nullif(response_count,0),0) as quick_response_ratio, interruptions/greatest(1,caller_turns) as interruption_rate, overlap_seconds,
    overlap_seconds/{D / 1000} as overlap_ratio, caller_turns, agent_turns, response_count, interruptions, cs/{D / 1000} as caller_speech_ratio, ags/{D / 1000} as agent_speech_ratio from j""",
       r=" ".join(V1 + V1_MORE))
def _(t):
    return E.conversation_features(norm(t), t.calls()).select("call_id", *V1, *V1_MORE)


@query("evt_14_event_count_delta", """with a as (select c.call_id, count(i.call_id) as n from d_calls c left join d_inter i using (call_id) group by all),
  h as (select a.call_id, count(*) as n from d_hyp a join d_hyp c on a.call_id=c.call_id and a.channel=1 and c.channel=0 and c.start_ms+64<a.start_ms and a.start_ms<c.end_ms
    and least(c.end_ms,a.end_ms)-a.start_ms>=96 group by a.call_id)
  select call_id, abs(a.n-coalesce(h.n,0)) as interruption_count_delta from a left join h using (call_id)""")
def _(t):
    def counts(n):
        i = E.interruptions(E.turn_context(n, t.calls())).groupBy("call_id").agg(F.count(F.lit(1)).alias("interruption_count"))
        return t.calls().select("call_id").join(i, "call_id", "left").fillna(0)
    return E.event_count_delta(counts(norm(t)), counts(hyp(t)), ["interruption_count"])


@query("prj_16_feature_sets", "select call_id, " + ", ".join(BEHAVIOUR_SETS["reaction_only"]) + " from d_features",
       r=" ".join(c for c in BEHAVIOUR_SETS["reaction_only"] if c not in COUNTS))
def _(t):
    return features(t).select("call_id", *BEHAVIOUR_SETS["reaction_only"])


@query("agg_15_segmentation_agreement", """with s as (select p.call_id, channel, count(*) as pairs, avg(iou) as iou, avg(abs(a_start-b_start)) as onset from d_pairs p group by all)
  select split, y, avg(pairs) as mean_pairs, avg(iou) as mean_iou, avg(onset)/1000 as onset_mae_s from s join d_calls using (call_id) group by all""",
       r="mean_pairs mean_iou onset_mae_s")
def _(t):
    s = I.segment_match_summary(I.segment_match(norm(t), hyp(t))).join(t.calls(), "call_id")
    return s.groupBy("split", "y").agg(F.avg("pairs").alias("mean_pairs"), F.avg("mean_iou").alias("mean_iou"), F.avg("onset_mae_s").alias("onset_mae_s"))


@query("prj_16_shortcut_sets", f"""with l as (select call_id, max(end_ms)/1000.0::double as e, min(start_ms)/1000.0::double as s from d_norm where channel=0 group by call_id)
  select call_id, {D / 1000}::double as duration_s, coalesce(s,{D / 1000}) as first_caller_start_s, {D / 1000} - coalesce(e,0) as trailing_silence_s from d_calls left join l using (call_id)""",
       r="duration_s first_caller_start_s trailing_silence_s")
def _(t):
    s = I.turn_stats(norm(t), t.calls()).join(t.calls().select("call_id", "duration_s"), "call_id")
    s = s.withColumn("trailing_silence_s", F.col("duration_s") - F.col("last_caller_end_s"))
    return s.select("call_id", *SHORTCUT_SETS["duration+silence"])
