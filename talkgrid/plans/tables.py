"""Conversation-shaped tables derived from the driver's tables, once for Spark and once as SQL views.

The driver's tables hold no calls; these derivations give their rows call-like roles, so
that every operator runs over whole tables at every scale factor.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordered import numbered
from ..functions.scalar import bool_int

CALL_MS = 2_592_000
NOW = "2024-01-31 00:00:00"


class Tables:
    """The driver's tables by name, and the derived ones as methods."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def turns(self) -> DataFrame:
        us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
        start = F.floor(us / 1e6).cast("bigint")
        return self.raw("events").select(
            F.col("user_id").alias("call_id"),
            F.when(F.col("event_type").isin("click", "purchase", "view"), 0).otherwise(1).alias("channel"),
            start.alias("start_ms"),
            (start + F.greatest(F.lit(200), F.floor(F.col("value") * 250))).alias("end_ms"))

    def calls(self) -> DataFrame:
        u = self.raw("events").select(F.col("user_id").alias("call_id")).distinct()
        y = (F.col("call_id") % 2).cast("int")
        return u.select(
            "call_id", F.when(y == 1, "synthetic").otherwise("human").alias("label"),
            F.when(F.col("call_id") % 5 == 0, "val").otherwise("train").alias("split"),
            F.lit(CALL_MS / 1000).alias("duration_s"), F.lit(CALL_MS).cast("bigint").alias("duration_ms"),
            y.alias("y"))

    def chunks(self) -> DataFrame:
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
        li = self.raw("lineitem")
        block = F.col("l_linenumber").cast("bigint") * (1 << 40) + F.shiftright(F.col("l_partkey"), 8)
        r = numbered(li, ["l_orderkey"], block, order, "chunk")
        start = (F.col("chunk") - 1) * 9.0
        dur = 1 + F.col("l_discount") * 30
        return r.select(F.col("l_orderkey").alias("call_id"), "chunk",
                        start.alias("start_s"), (start + dur).alias("end_s"), dur.alias("duration_s"),
                        ((F.col("l_quantity") - 25.5) / 10).alias("score"),
                        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
                        F.col("l_returnflag").alias("flag"))

    def chunk_scores(self) -> DataFrame:
        """The chunks without their number: what an aggregation that knows no order needs."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("call_id"), ((F.col("l_quantity") - 25.5) / 10).alias("score"),
            (1 + F.col("l_discount") * 30).alias("duration_s"), F.col("l_returnflag").alias("flag"))

    def order_calls(self) -> DataFrame:
        o = self.raw("orders")
        y = bool_int(F.left(F.col("o_orderpriority"), F.lit(1)).isin("1", "2"))
        return o.select(F.col("o_orderkey").alias("call_id"), y.alias("y"),
                        F.when(y == 1, "synthetic").otherwise("human").alias("label"),
                        F.when(F.col("o_orderkey") % 5 == 0, "val").otherwise("train").alias("split"),
                        F.lit(70.0).alias("duration_s"))

    def layer_scores(self) -> DataFrame:
        """Every chunk of a call in one of three layers, by its number; a layer is the mean of its chunks, and abstains where all of them do."""
        third = F.pmod(F.col("chunk"), F.lit(3))
        key = F.when(third == 1, "acoustic").when(third == 2, "behaviour").otherwise("semantic")
        c = self.chunks().groupBy("call_id", key.alias("key")).agg(
            F.avg("quantity").alias("quantity"), F.avg(F.round(F.col("discount") * 100)).alias("percent"), F.bool_and(F.col("flag") == "N").alias("quiet"))
        return c.select("call_id", "key", ((F.col("quantity") - 1) / 49).alias("probability"), (F.col("percent") / 10).alias("quality"),
                        (F.col("quiet") & (F.col("key") == "behaviour")).alias("abstained"), F.lit(True).alias("scored"), (F.col("quantity") * 10).alias("latency_ms"))

    def predictions(self) -> DataFrame:
        """Rounded order scores; domain = status, condition = priority, model a/b by customer parity."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("call_id"),
            (F.col("o_custkey") % 2).cast("int").alias("y"),
            F.round((F.col("o_totalprice") - 250000) / 100000 + (F.col("o_custkey") % 2) * 0.8, 2).alias("score"),
            F.col("o_orderstatus").alias("domain"), F.col("o_orderpriority").alias("condition"),
            F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("b").alias("model"),
            F.when(F.col("o_orderkey") % 5 == 0, "val").otherwise("train").alias("split"),
            (F.col("o_orderkey") % 50 == 0).alias("no_speech"))

    def call_log(self) -> DataFrame:
        e = self.raw("events")
        t = F.col("event_type")
        verdict = (F.when(t.isin("click", "purchase"), "human").when(t.isin("view", "signup"), "synthetic")
                   .otherwise("abstained"))
        conf = 0.5 + (F.col("event_id") % 50) / 100.0
        return e.select(
            F.col("event_id").alias("id"), F.col("ts").alias("at"), verdict.alias("verdict"),
            conf.alias("confidence"), F.when(verdict == "human", 1 - conf).otherwise(conf).alias("probability"),
            (F.col("value") * 20).alias("latency_ms"), (F.col("user_id") % 4).alias("queue"),
            F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 40) * 1.0).alias("decided_at_s"),
            (t != "error").alias("ok"))

    def frames(self) -> DataFrame:
        """Dense 50-call, two-channel frame grid: frame i of a channel is every 100th event."""
        e = self.raw("events")
        eid = F.col("event_id")
        call, idx = F.floor(eid / 2) % 50, F.floor(eid / 100)
        noise = F.floor(F.col("value") * 100).cast("bigint")
        wave = ((idx * 7 + call * 13) % 200)
        return e.select(call.cast("bigint").alias("call_id"), (eid % 2).cast("int").alias("channel"),
                        idx.cast("bigint").alias("frame_idx"),
                        (-F.when(wave < 90, 20).when(wave < 110, 48).otherwise(64)
                         - (noise % 9)).cast("double").alias("rms_db"),
                        (F.when(wave < 90, 60).when(wave < 110, 40).otherwise(15) + noise % 31).alias("p_pct"),
                        ((F.when(wave < 90, 60).when(wave < 110, 40).otherwise(15) + noise % 31) / 100).alias("p"))

    def words(self) -> DataFrame:
        c = self.raw("conversations").where(F.col("role").isin("user", "assistant"))
        w = c.select(F.col("conv_id").alias("call_id"),
                     F.when(F.col("role") == "user", 0).otherwise(1).alias("channel"), "turn",
                     F.posexplode(F.split("text", " ")).alias("pos", "text"))
        # some words become fillers, regional words, cut-offs and a repeated phrase, so that every text column has something to count
        loop = F.array(*map(F.lit, ("si", "no", "ya", "va")))
        pos = F.col("pos")
        w = w.withColumn("text", F.when(pos % 37 == 5, "este").when(pos % 41 == 7, "mande").when(pos % 43 == 9, "guion").when(pos % 31 == 3, F.concat("text", F.lit("-")))
                         .when(pos.between(10, 13), F.get(loop, pos - 10)).when(pos.between(20, 23), F.get(loop, pos - 20)).otherwise(F.col("text")))
        start = F.col("turn") * 30 + F.col("pos") * 0.4
        return w.select("call_id", "channel", "turn", "pos", "text", start.alias("start_s"),
                        (start + 0.3).alias("end_s"), (-(F.length("text") % 7) / 20.0).alias("logprob"))

    def chunk_embeddings(self) -> DataFrame:
        e = self.raw("embeddings")
        return e.select(F.floor(F.col("vec_id") / 5).cast("bigint").alias("call_id"),
                        (F.col("vec_id") % 5).alias("chunk"), F.lit(0).alias("layer"),
                        F.col("embedding").alias("emb"), bool_int(F.col("label") >= 5).alias("y"),
                        (1 + F.col("vec_id") % 4).cast("double").alias("duration_s"))


VIEWS = {
    "d_turns": """select user_id as call_id,
  case when event_type in ('click','purchase','view') then 0 else 1 end as channel,
  cast(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01'))/1e6) as bigint) as start_ms,
  cast(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01'))/1e6) as bigint)
    + cast(greatest(200, floor(value*250)) as bigint) as end_ms from events""",
    "d_calls": """select distinct user_id as call_id, case when user_id % 2 = 1 then 'synthetic' else 'human' end as label,
  case when user_id % 5 = 0 then 'val' else 'train' end as split, 2592.0::double as duration_s,
  2592000::bigint as duration_ms, cast(user_id % 2 as int) as y from events""",
    "d_chunks0": """select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
  l_extendedprice, l_shipdate) as chunk from lineitem""",
    "d_chunks": """select l_orderkey as call_id, chunk, (chunk-1)*9.0::double as start_s,
  (chunk-1)*9.0::double + 1 + l_discount*30 as end_s, 1 + l_discount*30 as duration_s,
  (l_quantity-25.5::double)/10 as score, l_quantity as quantity, l_discount as discount, l_returnflag as flag from d_chunks0""",
    "d_order_calls": """select o_orderkey as call_id, case when left(o_orderpriority,1) in ('1','2') then 1 else 0 end as y,
  case when left(o_orderpriority,1) in ('1','2') then 'synthetic' else 'human' end as label,
  case when o_orderkey % 5 = 0 then 'val' else 'train' end as split, 70.0::double as duration_s from orders""",
    "d_layers0": """select call_id, case chunk % 3 when 1 then 'acoustic' when 2 then 'behaviour' else 'semantic' end as key,
  avg(quantity) as quantity, avg(round(discount*100)) as percent, bool_and(flag='N') as quiet from d_chunks group by all""",
    "d_layers": """select call_id, key, (quantity-1)/49 as probability, percent/10 as quality, (quiet and key='behaviour') as abstained, true as scored,
  quantity*10 as latency_ms from d_layers0""",
    "d_preds": """select o_orderkey as call_id, cast(o_custkey % 2 as int) as y,
  round((o_totalprice-250000)/100000 + (o_custkey % 2)*0.8::double, 2) as score, o_orderstatus as domain,
  o_orderpriority as condition, case when o_orderkey % 3 = 0 then 'a' else 'b' end as model,
  case when o_orderkey % 5 = 0 then 'val' else 'train' end as split, (o_orderkey % 50 = 0) as no_speech from orders""",
    "d_log0": """select *, case when event_type in ('click','purchase') then 'human' when event_type in ('view','signup')
  then 'synthetic' else 'abstained' end as verdict, 0.5::double + (event_id % 50)/100.0::double as confidence from events""",
    "d_log": """select event_id as id, ts as at, verdict, confidence,
  case when verdict='human' then 1-confidence else confidence end as probability, value*20 as latency_ms,
  user_id % 4 as queue, case when event_id % 3 > 0 then (event_id % 40)*1.0::double end as decided_at_s,
  event_type <> 'error' as ok from d_log0""",
    "d_frames0": """select (event_id // 2) % 50 as call_id, cast(event_id % 2 as int) as channel, event_id // 100 as frame_idx,
  cast(floor(value*100) as bigint) as noise, ((event_id // 100)*7 + ((event_id // 2) % 50)*13) % 200 as wave from events""",
    "d_frames": """select call_id, channel, frame_idx,
  cast(-(case when wave < 90 then 20 when wave < 110 then 48 else 64 end) - (noise % 9) as double) as rms_db,
  (case when wave < 90 then 60 when wave < 110 then 40 else 15 end) + noise % 31 as p_pct,
  ((case when wave < 90 then 60 when wave < 110 then 40 else 15 end) + noise % 31)/100.0::double as p from d_frames0""",
    "d_words0": """select call_id, channel, turn, pos, case when pos % 37 = 5 then 'este' when pos % 41 = 7 then 'mande' when pos % 43 = 9 then 'guion' when pos % 31 = 3 then text || '-'
  when pos between 10 and 13 then ['si','no','ya','va'][pos-9] when pos between 20 and 23 then ['si','no','ya','va'][pos-19] else text end as text
  from (select conv_id as call_id, case when role='user' then 0 else 1 end as channel, turn,
  unnest(str_split(text,' ')) as text, generate_subscripts(str_split(text,' '),1)-1 as pos
  from conversations where role in ('user','assistant'))""",
    "d_words": """select call_id, channel, turn, pos, text, turn*30 + pos*0.4::double as start_s,
  turn*30 + pos*0.4::double + 0.3::double as end_s, -(length(text) % 7)/20.0::double as logprob from d_words0""",
    "d_chunk_embeddings": """select vec_id // 5 as call_id, vec_id % 5 as chunk, 0 as layer, embedding as emb,
  case when label >= 5 then 1 else 0 end as y, (1 + vec_id % 4)::double as duration_s from embeddings""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the derived views it names, in dependency order."""
    views = VIEWS | (extra or {})
    done: dict[str, str] = {}

    def need(text):
        for name in re.findall(r"\bd_[a-z0-9_]+\b", text):
            if name in views and name not in done:
                need(views[name])
                done[name] = views[name]

    need(body)
    if not done:
        return body
    head = ",\n".join(f"{n} as ({s})" for n, s in done.items())
    body = body.lstrip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    if body.lower().startswith("with "):
        rec = "recursive " if re.search(r"\bfrom p join s\b", body) else ""
        return f"with {rec}{head},\n{body[5:]}"
    return f"with {head}\n{body}"
