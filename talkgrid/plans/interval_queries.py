"""Queries over turns and frames: union, states, segmentation, packing."""

from pyspark.sql import functions as F

from ..operators import intervals as I, segmentation as S
from .registry import query
from .tables import CALL_MS, VIEWS

D = CALL_MS


def union_sql(base: str, keys: str, gap: int, s: str = "start_ms", e: str = "end_ms") -> str:
    return f"""select {keys}, min({s}) as {s}, max({e}) as {e} from (
      select *, sum(case when pe is null or {s} > pe + {gap} then 1 else 0 end) over (partition by {keys} order by {s}, {e}) as g from (
        select *, max({e}) over (partition by {keys} order by {s}, {e} rows between unbounded preceding and 1 preceding) as pe
        from ({base}))) group by {keys}, g"""


VIEWS.update({
    "d_norm": union_sql(f"select call_id, channel, start_ms, least(end_ms, {D}) as end_ms from d_turns where start_ms < {D}",
                        "call_id, channel", 150),
    "d_points": f"""select call_id, t, sum(d0) as d0, sum(d1) as d1 from (
        select call_id, start_ms as t, (channel=0)::int as d0, (channel=1)::int as d1 from d_norm
        union all select call_id, end_ms, -((channel=0)::int), -((channel=1)::int) from d_norm
        union all select call_id, 0, 0, 0 from d_calls union all select call_id, {D}, 0, 0 from d_calls) group by call_id, t""",
    "d_seg": """select call_id, t as a, lead(t) over (partition by call_id order by t) as b,
        (sum(d0) over w > 0)::int + 2*(sum(d1) over w > 0)::int as state from d_points window w as (partition by call_id order by t)""",
    "d_states": """select call_id, min(a) as start_ms, max(b) as end_ms, state from (
        select *, sum(ch) over (partition by call_id order by a) as g from (
          select *, (state is distinct from lag(state) over (partition by call_id order by a))::int as ch from d_seg where b is not null))
        group by call_id, state, g""",
    # a second segmentation of the same calls: the view and click turns only, moved by 40 ms
    "d_hyp": union_sql(f"""select user_id as call_id, case when event_type in ('click','view') then 0 else 1 end as channel,
        least(cast(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01'))/1e6) as bigint) + 40, {D} - 1) as start_ms,
        least(cast(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01'))/1e6) as bigint) + 40
          + cast(greatest(200, floor(value*250)) as bigint), {D}) as end_ms from events where event_type <> 'purchase'""",
                       "call_id, channel", 150),
    "d_bins": """select distinct call_id, channel, unnest(range(start_ms//1000, (end_ms+999)//1000)) as bin from d_norm""",
    "d_hyp_bins": """select distinct call_id, channel, unnest(range(start_ms//1000, (end_ms+999)//1000)) as bin from d_hyp""",
    "d_lengths": "select call_id, (max(frame_idx)+1)*32 as length_ms from d_frames group by call_id",
})


def norm(t):
    return I.normalize_turns(t.turns(), t.calls())


def hyp(t):
    e = t.raw("events").where("event_type <> 'purchase'").select("event_id", F.when(
        F.col("event_type").isin("click", "view"), 0).otherwise(1).alias("channel"), F.col("user_id").alias("call_id"), "ts", "value")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    s = F.floor(us / 1e6).cast("bigint") + 40
    e = e.select("call_id", "channel", F.least(s, F.lit(D - 1)).alias("start_ms"),
                 F.least(s + F.greatest(F.lit(200), F.floor(F.col("value") * 250)), F.lit(D)).alias("end_ms"))
    return I.merge_intervals(e, I.CHANNEL, 150)


def lengths(t, ms=32):
    return t.frames().groupBy("call_id").agg(((F.max("frame_idx") + 1) * ms).alias("length_ms"))


@query("prj_01_select_channel", "select call_id, start_ms, end_ms from d_turns where case when call_id % 10 = 0 then 0 else channel end = 0")
def _(t):
    d = t.turns().withColumn("n", F.when(F.col("call_id") % 10 == 0, 1).otherwise(2))
    return I.select_channel(d, 0, "n").select("call_id", "start_ms", "end_ms")


def runs_sql(base, cond):
    return f"""select call_id, channel, min(frame_idx) as start_idx, max(frame_idx)+1 as end_idx from (
      select *, frame_idx - row_number() over (partition by call_id, channel order by frame_idx) as g from {base} where {cond})
      group by call_id, channel, g"""


@query("int_01_islands", runs_sql("d_frames", "p_pct >= 50"))
def _(t):
    return I.islands(t.frames(), F.col("p_pct") >= 50)


@query("int_02_merge_intervals", union_sql("select call_id, channel, start_ms, end_ms from d_turns", "call_id, channel", 0))
def _(t):
    return I.merge_intervals(t.turns())


@query("int_03_normalize_turns", "select * from d_norm")
def _(t):
    return norm(t)


@query("int_04_intersection_duration", """select a.call_id, sum(least(a.end_ms,b.end_ms)-greatest(a.start_ms,b.start_ms))::bigint as shared_ms
  from d_norm a join d_norm b on a.call_id=b.call_id and a.channel=0 and b.channel=1 and a.start_ms<b.end_ms and b.start_ms<a.end_ms group by a.call_id""")
def _(t):
    n = norm(t)
    return I.intersection_duration(n.where("channel = 0"), n.where("channel = 1"))


@query("int_05_speaking_states", "select * from d_states")
def _(t):
    return I.speaking_states(norm(t), t.calls()).drop("agent_start_ms")


@query("int_06_rasterize", "select call_id, channel, bin, count(*) as n from d_bins group by all")
def _(t):
    return I.rasterize(norm(t), I.CHANNEL, 1000).groupBy("call_id", "channel", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("int_07_overlap_seconds", """select a.call_id, count(*)::double as overlap_s from d_bins a join d_bins b
  on a.call_id=b.call_id and a.bin=b.bin and a.channel=0 and b.channel=1 group by a.call_id""")
def _(t):
    n = norm(t)
    return I.overlap_seconds(n.where("channel = 0"), n.where("channel = 1"), hop=1000)


@query("int_08_frame_agreement", """with j as (select coalesce(r.call_id,h.call_id) as call_id, coalesce(r.channel,h.channel) as channel,
    r.bin as rb, h.bin as hb from d_bins r full join d_hyp_bins h on r.call_id=h.call_id and r.channel=h.channel and r.bin=h.bin),
  g as (select call_id, channel, count(*) filter (rb is not null and hb is not null) as tp, count(rb) as nr, count(hb) as nh from j group by all),
  q as (select *, coalesce(tp::double/nullif(nh,0),0) as p, coalesce(tp::double/nullif(nr,0),0) as r from g)
  select call_id, channel, p as "precision", r as recall, coalesce(2*p*r/nullif(p+r,0),0) as f1 from q""", r='"precision" recall f1')
def _(t):
    return I.frame_agreement(norm(t), hyp(t), I.CHANNEL, 1000)


@query("int_09_speech_iou", """with b as (select call_id, unnest([0,1]) as channel from d_calls),
  i as (select a.call_id, a.channel, sum(least(a.end_ms,b.end_ms)-greatest(a.start_ms,b.start_ms)) as s from d_norm a join d_hyp b
    on a.call_id=b.call_id and a.channel=b.channel and a.start_ms<b.end_ms and b.start_ms<a.end_ms group by all),
  x as (select call_id, channel, sum(end_ms-start_ms) as n from d_norm group by all),
  y as (select call_id, channel, sum(end_ms-start_ms) as n from d_hyp group by all)
  select call_id, channel, case when coalesce(x.n,0)+coalesce(y.n,0)-coalesce(s,0)=0 then 1.0::double
    else coalesce(s,0)::double/(coalesce(x.n,0)+coalesce(y.n,0)-coalesce(s,0)) end as iou
  from b left join i using (call_id, channel) left join x using (call_id, channel) left join y using (call_id, channel)""", r="iou")
def _(t):
    both = t.calls().select("call_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"))
    return I.speech_iou(norm(t), hyp(t), both, I.CHANNEL)


VIEWS["d_pairs"] = """select * from (select *, row_number() over (partition by call_id, channel, a_start order by iou desc, b_start) as ra,
    row_number() over (partition by call_id, channel, b_start order by iou desc, a_start) as rb from (
    select a.call_id, a.channel, a.start_ms as a_start, a.end_ms as a_end, b.start_ms as b_start, b.end_ms as b_end,
      (least(a.end_ms,b.end_ms)-greatest(a.start_ms,b.start_ms))::double
       /(a.end_ms-a.start_ms+b.end_ms-b.start_ms-(least(a.end_ms,b.end_ms)-greatest(a.start_ms,b.start_ms))) as iou
    from d_norm a join d_hyp b on a.call_id=b.call_id and a.channel=b.channel and a.start_ms<b.end_ms and b.start_ms<a.end_ms)
    where iou >= 0.1) where ra=1 and rb=1"""


@query("int_10_segment_match", "select call_id, channel, a_start, a_end, b_start, b_end, iou from d_pairs", r="iou")
def _(t):
    return I.segment_match(norm(t), hyp(t))


@query("int_10_segment_match_summary", """select call_id, channel, count(*) as pairs, avg(iou) as mean_iou, avg(abs(a_start-b_start))/1000 as onset_mae_s,
  avg(abs(a_end-b_end))/1000 as offset_mae_s from d_pairs group by all""", r="mean_iou onset_mae_s offset_mae_s")
def _(t):
    return I.segment_match_summary(I.segment_match(norm(t), hyp(t)))


@query("int_11_boundary_error", """with r as (select call_id, unnest([start_ms,end_ms]) as t from d_norm),
  h as (select distinct call_id, unnest([start_ms,end_ms]) as t from d_hyp),
  p as (select r.call_id, r.t, r.t - h.t as d from r asof left join h on r.call_id=h.call_id and r.t >= h.t),
  n as (select r.call_id, r.t, h.t - r.t as d from r asof left join h on r.call_id=h.call_id and r.t <= h.t),
  pd as (select call_id, t, d, row_number() over (partition by call_id, t) as k from p),
  nd as (select call_id, t, d, row_number() over (partition by call_id, t) as k from n),
  e as (select least(pd.d, nd.d) as err from pd join nd using (call_id, t, k))
  select count(*) as boundaries, avg(err) as mean_ms, avg(coalesce(err<=1000,false)::int) as within, quantile_cont(err,0.5) as median_ms from e""",
       r="mean_ms within median_ms")
def _(t):
    return I.boundary_error(norm(t), hyp(t), 1000)


VIEWS["d_latency"] = """select c.call_id, c.start_ms as onset_ms, c.start_ms - max(a.end_ms) as latency_ms from d_norm c join d_norm a
  on a.call_id=c.call_id and c.channel=0 and a.channel=1 and a.end_ms <= c.start_ms group by c.call_id, c.start_ms"""


@query("int_12_turn_stats", f"""with g as (select call_id, count(*) filter (channel=0) as n_caller_turns, count(*) filter (channel=1) as n_agent_turns,
    coalesce(sum((end_ms-start_ms)/1000.0::double) filter (channel=0),0) as caller_speech_s, coalesce(sum((end_ms-start_ms)/1000.0::double) filter (channel=1),0) as agent_speech_s,
    avg((end_ms-start_ms)/1000.0::double) filter (channel=0) as mean_caller_turn_s, max((end_ms-start_ms)/1000.0::double) filter (channel=0) as max_caller_turn_s,
    min(start_ms/1000.0::double) filter (channel=0) as first_caller_start_s, max(end_ms/1000.0::double) filter (channel=0) as last_caller_end_s from d_norm group by call_id),
  l as (select call_id, median(latency_ms)/1000 as median_response_latency_s, case when count(*)>1 then stddev_pop(latency_ms)/1000 end as std_response_latency_s
    from d_latency group by call_id),
  o as (select a.call_id, count(*)/100.0::double as overlap_s from (select distinct call_id, unnest(range(start_ms//10,(end_ms+9)//10)) as bin from d_norm where channel=0) a
    join (select distinct call_id, unnest(range(start_ms//10,(end_ms+9)//10)) as bin from d_norm where channel=1) b on a.call_id=b.call_id and a.bin=b.bin group by a.call_id)
  select c.call_id, coalesce(n_caller_turns,0) as n_caller_turns, coalesce(n_agent_turns,0) as n_agent_turns, coalesce(caller_speech_s,0) as caller_speech_s,
    coalesce(agent_speech_s,0) as agent_speech_s, coalesce(caller_speech_s,0)/{D / 1000} as caller_speech_fraction, coalesce(mean_caller_turn_s,0) as mean_caller_turn_s,
    coalesce(max_caller_turn_s,0) as max_caller_turn_s, coalesce(first_caller_start_s,{D / 1000}) as first_caller_start_s, coalesce(last_caller_end_s,0) as last_caller_end_s,
    median_response_latency_s, std_response_latency_s, coalesce(overlap_s,0) as overlap_s
  from d_calls c left join g using (call_id) left join l using (call_id) left join o using (call_id)""",
       r="caller_speech_s agent_speech_s caller_speech_fraction mean_caller_turn_s max_caller_turn_s first_caller_start_s last_caller_end_s median_response_latency_s std_response_latency_s overlap_s")
def _(t):
    return I.turn_stats(norm(t), t.calls())


@query("int_13_silence_stats", f"""with g as (select call_id, min(start_ms) as a, max(end_ms) as b, sum(end_ms-start_ms) as s, count(*) as n from d_norm
    where channel=0 and end_ms-start_ms > 90000 group by call_id)
  select call_id, coalesce(a,{D})/1000.0::double as leading_silence_s, ({D}-coalesce(b,0))/1000.0::double as trailing_silence_s, coalesce(s,0)/1000.0::double as speech_s,
    coalesce(s,0)/{D}.0::double as speech_fraction, coalesce(n,0) as n_regions, coalesce(s/1000.0::double/n,0) as mean_region_s from d_calls left join g using (call_id)""",
       r="leading_silence_s trailing_silence_s speech_s speech_fraction mean_region_s")
def _(t):
    return I.silence_stats(norm(t).where("channel = 0 and end_ms - start_ms > 90000"), t.calls())


ENERGY = """with floor_ as (select call_id, channel, quantile_cont(rms_db, 0.1) as fl from d_frames group by all),
  s as (select f.*, rms_db > greatest(fl+15, -55) {gate} as sp, max(frame_idx) over (partition by f.call_id, f.channel) as last_idx
    from d_frames f join floor_ using (call_id, channel) {join}),
  quiet as (select call_id, channel, min(frame_idx) as a, max(frame_idx)+1 as b, max(last_idx)+1 as n from (
    select *, frame_idx - row_number() over (partition by call_id, channel order by frame_idx) as g from s where not sp) group by call_id, channel, g),
  closed as (select call_id, channel, a, b from quiet where b-a < 30 and a > 0 and b < n),
  sp2 as (select s.call_id, s.channel, s.frame_idx from s left join closed c on c.call_id=s.call_id and c.channel=s.channel and s.frame_idx >= c.a and s.frame_idx < c.b
    where s.sp or c.a is not null),
  runs as (select call_id, channel, min(frame_idx) as a, max(frame_idx)+1 as b from (
    select *, frame_idx - row_number() over (partition by call_id, channel order by frame_idx) as g from sp2) group by call_id, channel, g),
  pad as (select call_id, channel, greatest(0, a*10-100) as start_ms, least((b-1)*10+20+100, length_ms) as end_ms
    from runs join (select call_id, (max(frame_idx)+1)*10 as length_ms from d_frames group by all) using (call_id) where b-a >= 30)
  """


@query("int_14_energy_vad", ENERGY.format(gate="", join="") + union_sql("select * from pad", "call_id, channel", 0))
def _(t):
    return S.energy_vad(t.frames(), lengths(t, 10))


@query("int_15_crosstalk_gate", ENERGY.format(gate="and coalesce(rms_db >= ag.adb - 3, true)",
       join="left join (select call_id, frame_idx, rms_db as adb from d_frames where channel=1) ag using (call_id, frame_idx) where f.channel=0")
       + union_sql("select * from pad", "call_id, channel", 0))
def _(t):
    return S.energy_vad(t.frames(), lengths(t, 10), margin_db=3.0)


@query("int_16_energy_vad_peak", f"""with floor_ as (select call_id, channel, quantile_cont(rms_db, 0.1) as fl from d_frames group by all),
  s as (select call_id, channel, frame_idx*10 as start_ms, frame_idx*10+25 as end_ms from d_frames join floor_ using (call_id, channel) where rms_db > fl+12),
  m as ({union_sql('select * from s', 'call_id, channel', 250)}),
  pad as (select call_id, channel, greatest(0,start_ms-40) as start_ms, least(end_ms+40, length_ms) as end_ms from m
    join (select call_id, (max(frame_idx)+1)*10 as length_ms from d_frames group by all) using (call_id) where end_ms-start_ms >= 150)
  {union_sql('select * from pad', 'call_id, channel', 0)}""")
def _(t):
    return S.energy_vad_peak(t.frames(), lengths(t, 10))


@query("int_17_energy_vad_fast", f"""with r as (select call_id, channel, frame_idx, pow(10.0, rms_db/20) as rms from d_frames),
  q as (select call_id, channel, greatest(least(quantile_cont(rms,0.25)*1.8, max(rms)*0.5), 1e-4) as thr from r group by all),
  b as (select r.* from r join q using (call_id, channel) where rms > thr) {runs_sql('b', 'true')}""")
def _(t):
    return S.energy_vad_fast(t.frames())


# the step-by-step rule with a recursive state per frame would need a loop in SQL; the gap rule is stated with windows instead
HYST = """with f as (select d.*, frame_idx*32 as t, length_ms, sum((p >= {thr})::int) over (partition by d.call_id, channel order by frame_idx) as g
    from d_frames d join d_lengths using (call_id)),
  gaps as (select call_id, channel, g, min(t) filter (p >= {thr}) as h, min(t) filter (p < {thr}-0.15) as lo, max(t) filter (p < {thr}-0.15) as hi, max(length_ms) as len
    from f where g > 0 group by all),
  c as (select *, case when hi-lo >= 160 then lo end as cut from gaps),
  o as (select *, (lag(g) over w is null or lag(cut) over w is not null)::int as op from c window w as (partition by call_id, channel order by g)),
  k as (select *, sum(op) over (partition by call_id, channel order by g) as sid from o),
  seg as (select call_id, channel, sid, min(h) as a, coalesce(max(cut), max(len)) as b, max(len) as len from k group by all),
  pad as (select call_id, channel, greatest(0, a-32) as start_ms, least(len, b+32) as end_ms from seg where b-a >= 160)
  """


@query("int_18_hysteresis_vad", HYST.format(thr="0.5") + union_sql("select * from pad", "call_id, channel", 150))
def _(t):
    return S.hysteresis_vad(t.frames(), lengths(t))


def hyst_view(thr):
    return HYST.format(thr=thr) + union_sql("select * from pad", "call_id, channel", 150)


IOU2 = """with lo as ({a}), hi as ({b}), b as (select call_id, unnest([0,1]) as channel from d_lengths),
  i as (select a.call_id, a.channel, sum(least(a.end_ms,b.end_ms)-greatest(a.start_ms,b.start_ms)) as s from lo a join hi b
    on a.call_id=b.call_id and a.channel=b.channel and a.start_ms<b.end_ms and b.start_ms<a.end_ms group by all),
  x as (select call_id, channel, sum(end_ms-start_ms) as n from lo group by all), y as (select call_id, channel, sum(end_ms-start_ms) as n from hi group by all),
  u as (select call_id, channel, coalesce(s,0) as s, coalesce(x.n,0)+coalesce(y.n,0)-coalesce(s,0) as u from b left join i using (call_id, channel)
    left join x using (call_id, channel) left join y using (call_id, channel)),
  iou as (select call_id, channel, case when u=0 then 1.0::double else s::double/u end as iou from u)"""


@query("int_19_segmentation_stability", IOU2.format(a=hyst_view("0.4"), b=hyst_view("0.6")) + " select call_id, avg(iou) as stability from iou group by call_id",
       r="stability")
def _(t):
    return S.segmentation_stability(t.frames(), lengths(t))


@query("int_20_vad_config_select", IOU2.format(a=hyst_view("0.5"), b=hyst_view("0.6")) + ", r1 as (select avg(iou) as m from iou) select 'strict' as config, m as mean_iou from r1",
       r="mean_iou")
def _(t):
    ref = S.hysteresis_vad(t.frames(), lengths(t))
    scores = S.vad_config_scores(t.frames(), lengths(t), ref, {"strict": {"threshold": 0.6}, "stricter": {"threshold": 0.75}})
    return scores.orderBy(F.desc("mean_iou"), "config").limit(1)


VIEWS["d_cut"] = """select call_id, a as start_ms, least(a+4000, e) as end_ms, row_number() over (partition by call_id order by a) as chunk from (
  select call_id, end_ms as e, unnest(range(start_ms, end_ms, 4000)) as a from d_norm where channel=0 and end_ms-start_ms >= 1000) where least(a+4000,e)-a >= 1000"""


@query("int_21_chunk_regions", "select * from d_cut")
def _(t):
    return I.chunk_regions(norm(t).where("channel = 0"))


@query("int_22_pack_segments", """with recursive s as (select call_id, start_ms, end_ms, row_number() over (partition by call_id order by start_ms) as k from d_norm where channel=0),
  p as (select call_id, k, start_ms, end_ms, 0::bigint as pack, (end_ms-start_ms)::bigint as acc from s where k=1
   union all select s.call_id, s.k, s.start_ms, s.end_ms, case when p.acc + s.end_ms-s.start_ms > 20000 then p.pack+1 else p.pack end,
    case when p.acc + s.end_ms-s.start_ms > 20000 then s.end_ms-s.start_ms else p.acc + s.end_ms-s.start_ms end
   from p join s on s.call_id=p.call_id and s.k=p.k+1) select call_id, start_ms, end_ms, pack from p""".replace("with recursive s", "with s"))
def _(t):
    return I.pack_segments(norm(t).where("channel = 0"))


@query("int_23_to_original", """with tl as (select call_id, coalesce(sum(end_ms-start_ms+500) over (partition by call_id order by start_ms rows between unbounded preceding and 1 preceding),0) as c,
    start_ms as o, end_ms-start_ms as d from d_norm where channel=0),
  p as (select call_id, unnest(range(0, 60000, 700)) as t_ms from d_calls)
  select p.call_id, t_ms, (o + least(greatest(t_ms-c,0),d))::bigint as original_ms from p asof join tl on p.call_id=tl.call_id and t_ms >= c""")
def _(t):
    tl = I.compact_timeline(norm(t).where("channel = 0"))
    pts = t.calls().select("call_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(59_500).cast("bigint"), F.lit(700).cast("bigint"))).alias("t_ms"))
    pts = pts.join(tl.select("call_id").distinct(), "call_id", "left_semi")
    return I.to_original(pts, tl)


@query("int_25_dynamic_range", """select call_id, channel, quantile_cont(rms_db,0.1) as p10, quantile_cont(rms_db,0.5) as p50, quantile_cont(rms_db,0.95) as p95,
  quantile_cont(rms_db,0.95)-quantile_cont(rms_db,0.1) as range_db from d_frames group by all""", r="p10 p50 p95 range_db")
def _(t):
    return S.dynamic_range(t.frames())


@query("int_26_peak_envelope", """with t as (select call_id, channel, max(frame_idx)+1 as n, max(abs(rms_db)) as top from d_frames group by all)
  select call_id, channel, (frame_idx*least(100,n))//n as bucket, round_even(max(abs(rms_db))/max(top),4) as level
  from d_frames join t using (call_id, channel) group by all""", r="level")
def _(t):
    return S.peak_envelope(t.frames(), 100, value="rms_db")


@query("int_27_jitter_turns")
def _(t):
    return I.jitter_turns(norm(t), t.calls(), 7)


@query("int_28_clip_to_prefix", """select call_id, channel, start_ms, least(end_ms, prefix_ms) as end_ms, prefix_ms from d_norm,
  (select unnest([60000,600000,2592000]) as prefix_ms) where start_ms < prefix_ms""")
def _(t):
    p = t.spark.createDataFrame([(60_000,), (600_000,), (D,)], "prefix_ms bigint")
    return I.clip_to_prefix(norm(t), p)
