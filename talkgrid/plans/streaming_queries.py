"""Streams run to completion over the events table, and the plug-in surface."""

import uuid

from pyspark.sql import functions as F

from ..operators import plugins as G
from ..operators.fusion import combine, valid_configs
from ..operators.intervals import chunk_regions
from ..operators.sampling import augmentation_plan
from ..session import checkpoint_dir
from ..streaming import log as L
from ..streaming.verdict import running_verdict
from .interval_queries import norm
from .registry import query
from .tables import VIEWS, Tables


def event_stream(t: Tables):
    """The events table as a stream, shaped like the log."""
    src = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.path)
    log = Tables.call_log(_Streamed(t, src))
    return log.withColumn("at", F.col("at").cast("timestamp"))


class _Streamed(Tables):
    """Tables whose ``events`` come from a stream."""

    def __init__(self, t: Tables, events):
        super().__init__(t.spark, t.path)
        self.events = events

    def raw(self, name):
        return self.events if name == "events" else super().raw(name)


def finished(t: Tables, df, mode: str = "append"):
    """Run a stream over what is there and read its sink back; sink and offsets lie in the shared folder."""
    base = f"{checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/offsets")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{base}/out")


def naive(*names):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


CLOSED = "(select max(ts) - interval 1 hour from events)"


@query("str_01_live_log", "select distinct event_id // 2 as id from events")
def _(t):
    log = event_stream(t).withColumn("id", F.floor(F.col("id") / 2))
    return finished(t, L.live_log(log)).select("id")


@query("str_02_rolling_latency", f"""select time_bucket(interval 30 minute, ts) as start, time_bucket(interval 30 minute, ts) + interval 30 minute as "end", count(*) filter (event_type<>'error') as n,
  avg(value*20) filter (event_type<>'error') as mean_ms from events group by 1, 2 having time_bucket(interval 30 minute, ts) + interval 30 minute <= {CLOSED}""", r="mean_ms")
def _(t):
    return finished(t, L.rolling_latency(event_stream(t))).select(*naive("start", "end"), "n", "mean_ms")


@query("str_02_rolling_median")
def _(t):
    return finished(t, L.rolling_latency(event_stream(t))).select(*naive("start"), "p50_ms")


@query("str_04_rolling_uptime", f"""with w as (select event_type, unnest(generate_series(date_trunc('hour', ts) - interval 23 hour, date_trunc('hour', ts), interval 1 hour)) as start from events)
  select start, start + interval 24 hour as "end", count(*) as n, count(*) filter (event_type<>'error') as ok, round_even(100.0*count(*) filter (event_type<>'error')/count(*),2)::double as uptime
  from w group by start having start + interval 24 hour <= {CLOSED}""", r="uptime")
def _(t):
    return finished(t, L.rolling_uptime(event_stream(t))).select(*naive("start", "end"), "n", "ok", "uptime")


def chunk_stream(t: Tables):
    src = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.path)
    k = F.col("event_id")
    # fifty calls in turn: event i is chunk i div 50 of call i mod 50
    return src.select((k % 50).alias("call_id"), (F.floor(k / 50) + 1).alias("chunk"), (F.floor(k / 50) * 9.0).alias("start_s"),
                      (F.floor(k / 50) * 9.0 + 2).alias("end_s"), (F.floor("value") % 41 - 20).cast("double").alias("score"), F.col("ts").cast("timestamp").alias("at"))


@query("str_03_running_verdict", """with c as (select event_id % 50 as call_id, event_id // 50 + 1 as chunk, floor(value) % 41 - 20 as score from events),
  r as (select call_id, chunk, sum(score) over (partition by call_id order by chunk)/chunk as m from c)
  select call_id, chunk, (chunk-1)*9.0::double + 2 as call_time_s, chunk*2.0::double as caller_speech_s, round_even(1/(1+exp(-(0.5*m))),4) as p from r""", r="call_time_s caller_speech_s p")
def _(t):
    v = finished(t, running_verdict(chunk_stream(t), "10 minutes", a=0.5))
    return v.where("not settled").select("call_id", "chunk", "call_time_s", "caller_speech_s", "p")


GAPS = """with c as (select event_id % 50 as call_id, event_id // 50 + 1 as chunk, floor(value) % 41 - 20 as score from events where event_id % 50 < 49),
  k as (select * from c where chunk % 7 <> 0), n as (select call_id, max(chunk) as newest, count(*) as heard from k group by 1)"""


@query("str_03_gaps", GAPS + """ select call_id, chunk, chunk > 7 as gap, false as settled, 0::bigint as missing, round_even(1/(1+exp(-0.5*m)),4) as p
    from (select call_id, chunk, sum(score) over w / row_number() over w as m from k window w as (partition by call_id order by chunk))
  union all select n.call_id, newest, false, true, newest - heard, round_even(1/(1+exp(-0.5*m)),4) from n join (select call_id, avg(score) as m from k group by 1) using (call_id)""", r="p")
def _(t):
    """Every seventh chunk never comes; a clock call a day ahead lets the others settle, so all that is held must come out."""
    s = chunk_stream(t)
    late = F.col("call_id") == 49
    s = s.where((F.col("chunk") % 7 != 0) | late).withColumn("at", F.when(late, F.col("at") + F.expr("interval 1 day")).otherwise(F.col("at")))
    v = finished(t, running_verdict(s, "10 minutes", a=0.5)).where("call_id <> 49")
    return v.select("call_id", "chunk", "gap", "settled", "missing", "p")


@query("str_05_quarantine", "select coalesce(problem, 'none') as problem, count(*) as n from (select case event_id % 3 when 1 then 'range' when 2 then 'unknown_field' end as problem from events) group by 1")
def _(t):
    src = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.path)
    k = F.col("event_id") % 3
    body = (F.when(k == 0, '{"call_id":"c","is_synthetic":true,"confidence":0.9}').when(k == 1, '{"call_id":"c","is_synthetic":false,"confidence":1.5}')
            .otherwise('{"call_id":"c","is_synthetic":false,"confidence":0.5,"extra":1}'))
    base = f"{checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    L.detection_stream(src.select(body.alias("body")), f"{base}/good", f"{base}/bad", f"{base}/offsets", once=True).awaitTermination()
    good = t.spark.read.parquet(f"{base}/good").select(F.lit("none").alias("problem"))
    return good.unionByName(t.spark.read.parquet(f"{base}/bad").select("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------ plug-ins and generators

VIEWS["d_plug"] = """select o_orderkey as call_id, 'acoustic' as key, case when o_custkey % 7 = 0 then 0.5::double else (o_custkey % 100)/100.0::double end as probability,
    case when o_custkey % 7 = 0 then 0.0::double else 1.0::double end as quality, o_custkey % 7 = 0 as abstained, true as scored from orders
  union all select o_orderkey, 'behaviour', coalesce(case when o_custkey % 3 > 0 then (o_custkey % 10)/10.0::double end, 0.5), case when o_custkey % 3 > 0 then 0.8::double else 0.0::double end, o_custkey % 3 = 0, true from orders
  union all select o_orderkey, 'semantic', 0.5, 0.0, true, false from orders"""


def plugged(t):
    calls = t.raw("orders").select(F.col("o_orderkey").alias("call_id"), "o_custkey")

    def acoustic(row):
        if row["o_custkey"] % 7 == 0:
            raise ValueError("no speech")
        return (row["o_custkey"] % 100) / 100.0, 1.0

    k = F.col("o_custkey")
    layers = [G.layer("acoustic", acoustic), G.expression_layer("behaviour", F.when(k % 3 > 0, (k % 10) / 10), F.lit(0.8)), G.layer("semantic", None)]
    return G.score_all(calls, layers)


@query("udf_01_layer_plugins", "select * from d_plug", r="probability quality")
def _(t):
    return plugged(t).drop("reason", "latency_ms")


@query("udf_01_plugin_verdicts", """with w as (select call_id, probability as p, case when abstained or not scored then 0 else 0.5 end as w from d_plug where key<>'semantic')
  select call_id, round_even(coalesce(sum(w*p)/nullif(sum(w),0),0.5),6) as p, sum(w)>0 as decisive from w group by call_id""", r="p")
def _(t):
    return combine(plugged(t), valid_configs(t.spark, [{"config_id": "base"}])).select("call_id", "p", "decisive")


@query("udf_02_aggregation_registry", "select call_id, n_chunks, trimmed_mean as score from d_agg", r="score")
def _(t):
    return G.aggregate_by_name(t.chunk_scores(), "trimmed_mean")


@query("udf_03_perturbations", "select condition, count(*) as n, avg(rms_db + case condition when 'gain_-12dB' then -12 else 0 end) as mean_db from d_frames, (select unnest(['clean','gain_-12dB']) as condition) group by condition", r="mean_db")
def _(t):
    p = G.perturbed(t.frames().select("call_id", "channel", "frame_idx", "rms_db"), ["clean", "gain_-12dB"])
    return p.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.avg("rms_db").alias("mean_db"))


@query("udf_03_dropped_frames")
def _(t):
    p = G.perturbed(t.frames().select("call_id", "channel", "frame_idx", "rms_db"), ["clean", "drop_frames_5"])
    return p.groupBy("condition").agg(F.count(F.lit(1)).alias("n"))


@query("udf_04_generated_rows", """select 'chunk' as kind, count(*) as n from d_cut union all select 'sample', sum(case when split='train' then 2 else 2 end)::bigint from d_order_calls""")
def _(t):
    c = chunk_regions(norm(t).where("channel = 0"), max_chunks=None).agg(F.count(F.lit(1)).alias("n")).select(F.lit("chunk").alias("kind"), "n")
    return c.unionByName(augmentation_plan(t.order_calls()).agg(F.count(F.lit(1)).alias("n")).select(F.lit("sample").alias("kind"), "n"))
