"""Queries over words, vectors, joins, sources and guards."""

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.fixed import DISFLUENCIES, REGIONALISMS
from ..operators import guards as Q
from ..operators import joins as J
from ..operators import quality as K
from ..operators import sampling as P
from ..operators import scoring as A
from ..operators import text as T
from ..operators import vectors as V
from ..session import checkpoint_dir
from ..sources import audio as S
from ..sources import corpus as C
from ..sources.logs import append_experiments
from .metrics_queries import AUC, curve_sql
from .registry import query
from .scoring_queries import PLAN, manifest
from .tables import CALL_MS, VIEWS

# ------------------------------------------------------------------------------ text


def in_list(words):
    return "(" + ",".join("'" + w + "'" for w in words if " " not in w) + ")"


VIEWS.update({
    "d_cw": "select * from d_words where channel=0",
    "d_tok": r"select *, regexp_replace(lower(text), '[^\p{L}\p{N}_]', '', 'g') as token from d_words",
    "d_tk": "select call_id, channel, token, start_s, pos from d_tok where token <> ''",
    "d_joined": "select call_id, string_agg(token, ' ' order by start_s, pos) as txt from d_tk where channel=0 group by call_id",
    "d_raw": "select call_id, string_agg(text, ' ' order by start_s, pos) as txt, count(*) as nw from d_cw group by call_id",
    "d_sent": r"select call_id, len(list_filter(regexp_split_to_array(txt, '[.!?¿¡]+'), lambda s: trim(s, chr(32)) <> '')) as ns from d_raw",
    "d_tr": f"""select w.call_id, greatest(count(t.token),1) as n, count(distinct t.token) as types, count(*) filter (t.token in {in_list(DISFLUENCIES)}) as dis,
      count(*) filter (t.token in {in_list(REGIONALISMS)}) as reg, count(*) filter (t.token in ('guion','guión')) as tic from d_raw w left join d_tk t on t.call_id=w.call_id and t.channel=0 group by w.call_id""",
    "d_lp": """select call_id, avg(logprob) as m, stddev_pop(logprob) as s, quantile_cont(logprob,0.1) as p10, min(logprob) as mn, avg((logprob < -0.05)::int) as low,
      coalesce(avg(logprob) filter (start_s<30), avg(logprob)) as f30, count(*) filter (contains(text,'--') or ends_with(text,'-')) as cut from d_cw group by call_id""",
})


def caller(t):
    return t.words().where("channel = 0")


def features(t):
    return T.transcript_features(caller(t))


@query("txt_01_tokenize", "select call_id, channel, start_s, pos, token from d_tk", r="start_s")
def _(t):
    return T.tokenize(t.words()).select("call_id", "channel", "start_s", "pos", "token")


@query("txt_02_lexicon_rates", """select call_id, (dis + (length(coalesce(txt,'')) - length(replace(coalesce(txt,''),'o sea','')))/5)/n as disfluency_rate,
  (reg + (length(coalesce(txt,'')) - length(replace(coalesce(txt,''),'ni modo','')))/7)/n as regional_rate, tic/n as script_tic_rate from d_tr left join d_joined using (call_id)""",
       r="disfluency_rate regional_rate script_tic_rate")
def _(t):
    return features(t).select("call_id", "disfluency_rate", "regional_rate", "script_tic_rate")


@query("txt_02_phrases_across_words", """with x as (select call_id, string_agg(token,' ' order by start_s, pos) as txt from d_tk where channel=0 group by call_id)
  select call_id, ((length(txt)-length(replace(txt,'e la','')))/4)::bigint as hits from x where contains(txt,'e la')""")
def _(t):
    w = T.tokenize(caller(t))
    s = T.scan(w, ["call_id"], T._block(), T.ORDER, {"prev": ("last", "token")}, inclusive=False)
    g = s.groupBy("call_id").agg(F.count_if(T.phrase_hit(F.col("prev"), F.col("token"), "e la")).alias("hits"))
    # the phrase may also lie inside one token only if a token held a blank, which none does
    return g.where("hits > 0")


@query("txt_03_false_start_rate", "select call_id, cut/n as false_start_rate from d_lp join d_tr using (call_id)", r="false_start_rate")
def _(t):
    return features(t).select("call_id", "false_start_rate")


@query("txt_04_richness", """select call_id, types/n as ttr, n/greatest(ns,1) as mean_sentence_len, n/greatest(coalesce(nt,0),1) as words_per_turn, n::double as n_words from d_tr join d_sent using (call_id)
  left join (select conv_id as call_id, count(*) as nt from conversations where role='user' group by conv_id) using (call_id)""", r="ttr mean_sentence_len words_per_turn n_words")
def _(t):
    turns = t.raw("conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("call_id")).agg(F.count(F.lit(1)).alias("n_turns"))
    return T.transcript_features(caller(t), n_turns=turns).select("call_id", "ttr", "mean_sentence_len", "words_per_turn", "n_words")


@query("txt_05_asr_confidence", "select call_id, m as logprob_mean, s as logprob_std, p10 as logprob_p10, mn as logprob_min, low as logprob_low_frac, f30 as logprob_first30 from d_lp",
       r="logprob_mean logprob_std logprob_p10 logprob_min logprob_low_frac logprob_first30")
def _(t):
    return features(t).select("call_id", "logprob_mean", "logprob_std", "logprob_p10", "logprob_min", "logprob_low_frac", "logprob_first30")


@query("txt_06_vocabulary_overlap", """with c as (select distinct call_id, token from d_tk where channel=0), a as (select distinct call_id, token from d_tk where channel=1), e as (select distinct call_id from d_tk)
  select e.call_id, count(a.token)/greatest(count(c.token),1) as overlap_agent from e left join c on c.call_id=e.call_id left join a on a.call_id=c.call_id and a.token=c.token group by e.call_id""", r="overlap_agent")
def _(t):
    return T.vocabulary_overlap(t.words())


@query("txt_07_annotate", r"""with o as (select *, lag(channel) over w as pc, lag(end_s) over w as pe, max(end_s) over (w rows between unbounded preceding and 1 preceding) as heard from d_words window w as (partition by call_id order by start_s, end_s, channel, pos)),
  n as (select *, (pc is null or pc<>channel or start_s-pe > 1.0)::int as opens from o), l as (select *, sum(opens) over (partition by call_id order by start_s, end_s, channel, pos) as line from n)
  select call_id, line, channel, min(start_s) as start_s, max(start_s-heard) filter (opens=1 and start_s-heard > 2.0) as silence_s,
    '[' || rpad(case channel when 0 then 'CALLER' else 'AGENT' end,7,' ') || ' ' || printf('%d:%05.2f', floor(min(start_s)/60)::int, min(start_s)-floor(min(start_s)/60)*60) || '] ' || string_agg(text,' ' order by start_s, end_s, channel, pos) as text
  from l group by call_id, line, channel""", r="start_s silence_s")
def _(t):
    return T.annotate(t.words())


@query("txt_08_repetition_loops", r"""with a as (select call_id, regexp_split_to_array(lower(string_agg(text,' ' order by start_s, pos)), '\s+') as a from d_cw group by call_id),
  w as (select call_id, unnest(a) as w, generate_subscripts(a, 1) as k from a),
  r as (select call_id, w, row_number() over (partition by call_id order by k) as i from w where w <> ''),
  g as (select call_id, w || ' ' || lead(w,1) over o || ' ' || lead(w,2) over o || ' ' || lead(w,3) over o as gram from r window o as (partition by call_id order by i)),
  c as (select call_id, gram, count(*) as times from g where gram is not null group by all having count(*) >= 2)
  select call_id, count(*) as n_grams, max(times) as most from c group by call_id""")
def _(t):
    return T.repetition_loops(caller(t), times=2)


DIMS = "unnest(['sobrecompletitud','registro_formal','iniciativa']) as dimension, unnest([0.5::double, (call_id % 11)/10.0::double, (call_id % 3)/2.0::double]) as score"
VIEWS["d_rubric"] = f"select call_id, {DIMS} from d_order_calls"


def rubric(t):
    k = F.col("call_id")
    f = F.concat(F.lit('{"scores":{"sobrecompletitud":{"score":0.5,"evidencia":"a"},"registro_formal":{"score":'), ((k % 11) / 10).cast("string"),
                 F.lit(',"evidencia":"b"},"iniciativa":{"score":'), ((k % 3) / 2).cast("string"), F.lit("}}}"))
    path = F.concat(F.lit("/cache/call_"), F.lower(F.hex("call_id")), F.lit("_some_model-2_ab12.json"))
    return C.parse_rubric(t.order_calls().select(path.alias("path"), f.alias("content")))


def rubric_calls(t):
    return t.order_calls().withColumn("call_id", F.concat(F.lit("call_"), F.lower(F.hex("call_id"))))


@query("txt_09_rubric_stats", f"""with j as (select r.*, o.y, o.split from d_rubric r join d_order_calls o using (call_id)), v as (select * from j where split='val'), c as ({curve_sql('v', 'dimension')}),
  a as (select dimension, {AUC} as auc from c group by dimension)
  select dimension, avg(score) filter (y=0) as human_mean, avg(score) filter (y=1) as synthetic_mean, avg((score=0.5)::int) as undecided_share, any_value(auc) as auc from j join a using (dimension) group by dimension""",
       r="human_mean synthetic_mean undecided_share auc")
def _(t):
    return T.rubric_stats(rubric(t), rubric_calls(t))


# ------------------------------------------------------------------------------ sources

@query("src_01_scan_calls", """select 'call_' || printf('%06x', o_orderkey) as call_id, case when o_custkey % 2 = 1 then 'synthetic' else 'human' end as label, case when o_orderkey % 5 = 0 then 'val' else 'train' end as split,
  round(o_totalprice/1000, 2) as duration_s, (o_custkey % 2)::int as y from orders where o_orderkey % 17 > 0""", r="duration_s")
def _(t):
    k = F.col("o_orderkey")
    cid = F.concat(F.lit("call_"), F.lpad(F.lower(F.hex(k)), 6, "0"))
    line = F.concat_ws(",", cid, F.when(F.col("o_custkey") % 2 == 1, "synthetic").otherwise("human"), F.when(k % 5 == 0, "val").otherwise("train"),
                       F.round(F.col("o_totalprice") / 1000, 2).cast("string"))
    rows = t.raw("orders").select(F.from_csv(line, C.CALLS_SCHEMA).alias("r")).select("r.*")
    return C.manifest_calls(rows, t.raw("orders").where(k % 17 == 0).select(cid.alias("call_id"))).drop("duration_ms")


@query("src_02_validate_calls", """with c as (select case when o_orderkey % 100 = 0 then 'x' || o_orderkey else 'call_' || printf('%x', o_orderkey // 2 * 2) end as call_id, case when o_orderkey % 50 = 1 then 'robot' else 'human' end as label,
    case when o_orderkey % 40 = 1 then null else 'train' end as split, case when o_orderkey % 30 = 0 then -1.0::double when o_orderkey % 31 = 0 then 'nan'::double else 5 end as duration_s from orders)
  select 'missing_value' as rule, count(*) filter (split is null) as violations from c union all select 'bad_id', count(*) filter (not regexp_matches(call_id,'^call_[0-9a-f]+$')) from c
  union all select 'bad_label', count(*) filter (label not in ('human','synthetic')) from c union all select 'bad_split', count(*) filter (split not in ('train','val')) from c
  union all select 'bad_duration', count(*) filter (isnan(duration_s) or duration_s <= 0) from c union all select 'duplicate_id', count(*) - count(distinct call_id) from c""")
def _(t):
    k = F.col("o_orderkey")
    c = t.raw("orders").select(
        F.when(k % 100 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(F.lit("call_"), F.lower(F.hex(F.floor(k / 2) * 2)))).alias("call_id"),
        F.when(k % 50 == 1, "robot").otherwise("human").alias("label"), F.when(k % 40 == 1, None).otherwise("train").alias("split"),
        F.when(k % 30 == 0, -1.0).when(k % 31 == 0, float("nan")).otherwise(5.0).alias("duration_s"))
    return C.validate_calls(c)


def turn_files(t):
    """One file per turn and caller, as text; a third of the channels and orders broken on purpose."""
    e = t.turns().withColumn("bad", F.col("start_ms") % 5)
    body = F.concat(F.lit('{"turns":[{"channel":'), F.when(F.col("bad") == 0, 7).otherwise(F.col("channel")).cast("string"), F.lit(',"start":'), (F.col("start_ms") / 1000).cast("string"),
                    F.lit(',"end":'), F.when(F.col("bad") == 1, F.col("start_ms") / 1000).otherwise(F.col("end_ms") / 1000).cast("string"), F.lit("}]}"))
    return e.select(F.concat(F.lit("file:/t/u"), F.col("call_id").cast("string"), F.lit(".json")).alias("path"), body.alias("content"))


@query("src_04_scan_turns", """select 'u' || call_id as call_id, case when start_ms % 5 = 0 then 7 else channel end as channel, start_ms, case when start_ms % 5 = 1 then start_ms else end_ms end as end_ms from d_turns""")
def _(t):
    return C.parse_turns(turn_files(t)).select("call_id", "channel", "start_ms", "end_ms")


@query("src_05_validate_turns", "select case start_ms % 5 when 0 then 'channel' when 1 then 'order' end as reason, count(*) as n from d_turns group by all")
def _(t):
    return C.check_turns(C.parse_turns(turn_files(t))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def recordings(t):
    """Each vector as a short two-channel recording: every value held for ten samples, the agent at half level."""
    def build(batches):
        for b in batches:
            out = []
            for v in b["embedding"]:
                x = np.repeat(np.asarray(v, dtype=np.float64), 10)
                out.append(S.encode_recording(np.stack([x, x / 2], axis=1)))
            yield pd.DataFrame({"call_id": b["vec_id"].astype(str), "content": out})
    return t.raw("embeddings").select("vec_id", "embedding").mapInPandas(build, "call_id string, content binary")


VIEWS["d_pcm"] = """select vec_id, ch, i, trunc(embedding[i//10+1]::double/(ch+1)*32768)/32768.0::double as x from embeddings, range(2) c(ch), range(640) r(i)"""


@query("src_06_wav_frames", """select p.vec_id::varchar as call_id, ch::int as channel, f as frame_idx, 20*log10(sqrt(avg(x*x))+1e-9) as rms_db, max(abs(x)) as peak from d_pcm p, range(7) g(f)
  where i >= f*80 and i < f*80+160 group by all""", r="rms_db peak")
def _(t):
    return S.wav_frames(recordings(t)).select("call_id", "channel", "frame_idx", "rms_db", "peak")


@query("src_06_wav_rejects", "select case when vec_id % 2 = 0 then 'truncated' else 'container' end as reason, count(*) as n from embeddings group by 1")
def _(t):
    r = recordings(t)
    bad = r.withColumn("content", F.when(F.col("call_id").cast("int") % 2 == 0, F.expr("substr(content, 1, length(content) - 8)")).otherwise(F.encode(F.lit("not a recording"), "UTF-8")))
    return S.wav_frames(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("int_24_level_stats", """with s as (select vec_id, ch, 20*log10(sqrt(avg(x*x))+1e-9) as rms_db, max(abs(x)) as peak, avg((abs(x)>=0.99)::int) as clip_fraction, avg(x) as dc_offset, avg((x=0)::int) as zero_fraction from d_pcm group by all),
  c as (select a.vec_id, corr(a.x, b.x) as r from d_pcm a join d_pcm b on a.vec_id=b.vec_id and a.i=b.i and a.ch=0 and b.ch=1 group by a.vec_id)
  select s.vec_id::varchar as call_id, ch::int as channel, rms_db, peak, clip_fraction, dc_offset, zero_fraction, r as channel_correlation from s join c using (vec_id)""",
       r="rms_db peak clip_fraction dc_offset zero_fraction channel_correlation")
def _(t):
    return S.level_stats(S.level_partials(recordings(t))).drop("n", "clip_fraction_strict")


VIEWS["d_spec"] = """select vec_id, ch, k as bin, k*15.625::double as hz, pow(sum(x*w*cos(2*pi()*((k*i) % 512)/512)), 2) + pow(sum(x*w*sin(2*pi()*((k*i) % 512)/512)), 2) as power
  from (select vec_id, ch, i, x, 0.5-0.5*cos(2*pi()*i/512) as w from d_pcm where i < 512), range(257) r(k) group by all"""


def spec_stats_sql(rows):
    return f"""c as (select *, sum(power) over (partition by vec_id, ch order by bin) as cum, sum(power) over (partition by vec_id, ch) as tot from {rows})
  select vec_id::varchar as call_id, ch::int as channel, min(hz) filter (cum/greatest(tot,1e-12) >= 0.95) as rolloff95_hz, sum(hz*power)/greatest(sum(power),1e-12) as centroid_hz,
  10*log10(coalesce(sum(power) filter (hz>=3400 and hz<4000),0)/greatest(coalesce(sum(power) filter (hz>=300 and hz<3400),0),1e-12) + 1e-12) as hf_ratio_db from c group by vec_id, ch"""


@query("int_29_spectral_stats", f"with {spec_stats_sql('d_spec')}", r="rolloff95_hz centroid_hz hf_ratio_db")
def _(t):
    return S.spectral_stats(S.spectrum(recordings(t)))


@query("int_29_caller_speech", f"""with g as (select vec_id, (vec_id % 3)*10 as s, (vec_id % 3)*10 + 30 as e from embeddings where vec_id % 4 < 3),
  f as (select p.vec_id, f, 20*log10(sqrt(avg(x*x))+1e-9) as db from d_pcm p, range(7) r(f) where ch=0 and i >= f*80 and i < f*80+160 group by all),
  n as (select vec_id, quantile_cont(db, 0.1) as floor from f group by vec_id),
  l as (select p.vec_id, 20*log10(sqrt(avg(x*x))+1e-9) as rms from d_pcm p left join g using (vec_id) where ch=0 and (s is null or (i/8.0 >= s and i/8.0 < e)) group by p.vec_id),
  o as (select * from ({'with ' + spec_stats_sql('d_spec')}) where channel=0)
  select call_id, 1::bigint as n_frames, rms as speech_rms_db, floor as noise_floor_db, rms-floor as snr_db, rolloff95_hz, centroid_hz, hf_ratio_db from o join n on n.vec_id::varchar=call_id join l on l.vec_id=n.vec_id""",
       r="speech_rms_db noise_floor_db snr_db rolloff95_hz centroid_hz hf_ratio_db")
def _(t):
    v = t.raw("embeddings").select("vec_id").where("vec_id % 4 < 3")
    regions = v.select(F.col("vec_id").alias("call_id"), (F.col("vec_id") % 3 * 10).alias("start_ms"), (F.col("vec_id") % 3 * 10 + 30).alias("end_ms"))
    return S.caller_speech_stats(S.caller_speech(recordings(t), regions))


@query("int_30_spectral_distance", """with s as materialized (select vec_id, ch, bin, hz, 10*log10(power + 1e-14) as db from d_spec),
  d as (select a.vec_id, a.ch, sqrt(avg(pow(a.db-b.db,2))) as distance_db from s a join s b on b.vec_id=a.vec_id+1 and a.ch=b.ch and a.bin=b.bin group by all),
  m as (select *, max(db) over (partition by vec_id, ch) as top from s), e as (select vec_id, ch, max(hz) filter (db >= top-20) as band_edge_hz from m group by all)
  select vec_id::varchar as call_id, ch::int as channel, distance_db, band_edge_hz from d join e using (vec_id, ch)""", r="distance_db band_edge_hz")
def _(t):
    """Every recording against the one that follows it."""
    sp = S.spectra(recordings(t)).where("reason is null")
    after = sp.withColumn("call_id", (F.col("call_id").cast("bigint") - 1).cast("string"))
    return S.spectral_distance(sp, after).join(S.band_edge(sp), ["call_id", "channel"])


@query("int_31_frame_descriptor_stats")
def _(t):
    return S.descriptor_stats(S.frame_descriptors(recordings(t)))


@query("src_07_decode_payloads", """with b as (select doc_id, text as tx from documents)
  select doc_id, case doc_id % 4 when 3 then 'empty' end as reason, case when doc_id % 4 < 3 then md5(tx) end as digest from b""")
def _(t):
    d = t.raw("documents").select("doc_id", F.col("text").alias("tx"))
    b64 = F.regexp_replace(F.base64(F.encode("tx", "UTF-8")), r"\s", "")
    k = F.col("doc_id") % 4
    body = (F.when(k == 0, F.concat(F.lit('{"note":"x","wav":"'), b64, F.lit('"}')))
            .when(k == 1, F.concat(F.lit('{"audio":"data:audio/wav;base64,'), b64, F.lit('"}'))).when(k == 2, b64).otherwise('{"note":"short"}'))
    p = S.decode_payloads(d.select("doc_id", body.alias("body")))
    return p.select("doc_id", "reason", F.md5("content").alias("digest"))


@query("src_08_chunk_embeddings", """select vec_id, len(embedding)*2 as dims, list_sum(embedding::double[])*1.5::double as total from embeddings""", r="total")
def _(t):
    e = t.raw("embeddings").select("vec_id", F.col("embedding").alias("mean_emb"), F.transform("embedding", lambda x: x / 2).alias("std_emb"))
    p = C.pooled_embeddings(e, "mean+std")
    return p.select("vec_id", F.size("emb").cast("bigint").alias("dims"), F.aggregate("emb", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query("src_09_scan_words", """select 'c' || conv_id as call_id, case when role='user' then 0 else 1 end as channel, turn as pos, 'w' || turn as text, turn*1.5::double as start_s, -(turn % 7)/20.0::double as logprob
  from conversations where role<>'system' and turn % 4 > 0""", r="start_s logprob")
def _(t):
    c = t.raw("conversations").where("role <> 'system'")
    kind = F.when(F.col("turn") % 4 == 0, "spacing").otherwise("word")
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("w"), F.col("turn").cast("string")).alias("text"), (F.col("turn") * 1.5).alias("start"), (F.col("turn") * 1.5 + 1).alias("end"),
                                               kind.alias("type"), (-(F.col("turn") % 7) / 20).alias("logprob"))).alias("words")))
    path = F.concat(F.lit("/asr/c"), F.col("conv_id").cast("string"), F.lit("_ch"), F.when(F.col("role") == "user", "0").otherwise("1"), F.lit(".json"))
    w = C.parse_words(c.select("turn", path.alias("path"), body.alias("content")).select("path", "content", "turn").drop("turn"))
    return w.select("call_id", "channel", F.regexp_extract("text", r"(\d+)", 1).cast("bigint").alias("pos"), "text", "start_s", "logprob")


@query("src_10_scan_rubric", "select 'call_' || printf('%x', call_id) as call_id, 'some_model-2' as model, 'ab12' as prompt, dimension, score from d_rubric", r="score")
def _(t):
    return rubric(t).drop("evidence")


@query("src_16_experiment_log", "select o_orderstatus as title, printf('%.4f', count(*)/7) as accuracy, 'x' as note from orders group by o_orderstatus")
def _(t):
    g = t.raw("orders").groupBy(F.col("o_orderstatus").alias("title")).agg((F.count(F.lit(1)) / 7).alias("a"))
    path = f"{checkpoint_dir(t.spark)}/experiments-{uuid.uuid4().hex}"
    append_experiments(g.select("title", F.create_map(F.lit("accuracy"), F.format_string("%.4f", "a"), F.lit("note"), F.lit("x")).alias("params")), path)
    rec = t.spark.read.parquet(path).where("ts is not null")
    return rec.select("title", F.col("params")["accuracy"].alias("accuracy"), F.col("params")["note"].alias("note"))


@query("src_17_feature_table_guard", """select case when call_id % 50 = 0 then 'missing_or_changed' else 'unknown_or_changed' end as problem, call_id::varchar as call_id from d_order_calls where call_id % 50 = 0
  union all select 'unknown_or_changed', call_id::varchar from d_order_calls where call_id % 50 = 0 and call_id % 100 = 0 union all select 'stale_config', null""")
def _(t):
    c = t.order_calls()
    f = c.where("call_id % 50 <> 0 or call_id % 100 = 0").withColumn("y", F.when(F.col("call_id") % 100 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    return C.feature_table_problems(f, c, {"version": 1}, {"version": 2})


@query("src_17_table_checksum")
def _(t):
    return C.table_checksum(t.raw("lineitem"))


@query("src_19_domain_items", """with v as (select call_id, y from d_order_calls where split='val'), m as (select call_id, family, (label='synthetic')::int as y from d_manifest where status='ok' and split='val')
  select 'validation' as domain, call_id::varchar as item, y, null as condition from v union all select 'channel_' || family, call_id || '__' || family, y, null from m
  union all select 'external', 'e' || s_suppkey, (s_suppkey % 2)::int, null from supplier union all select 'external_channel', 'e' || s_suppkey, (s_suppkey % 2)::int, 'unseen' from supplier
  union all select 'stress', call_id || '|' || c, y, c from v, (select unnest(['clean','noise','gain']) as c)""")
def _(t):
    m = manifest(t).select("status", "split", "family", F.concat_ws("__", F.col("call_id").cast("string"), "family").alias("sample_id"), (F.col("label") == "synthetic").cast("int").alias("y"))
    ext = t.raw("supplier").select(F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("item"), (F.col("s_suppkey") % 2).cast("int").alias("y"))
    return C.domain_items(t.order_calls().where("split = 'val'"), m, ext, ["clean", "noise", "gain"])


@query("prj_07_semantic_degrade", """with w as (select call_id, count(*) filter (channel=0) as n, count(*) filter (channel=1) > 0 as a from d_words group by call_id)
  select call_id, case when call_id % 13 = 0 then 'abstain' when n < 5 then 'abstain' when not a or call_id % 4 = 0 then 'f4' else 'f4+f5' end as path,
   case when call_id % 13 = 0 then 'asr_error' when n < 5 then 'no_speech' when not a or call_id % 4 = 0 then 'degraded' else '' end as reason from w""")
def _(t):
    w = t.words().groupBy("call_id").agg(F.count_if(F.col("channel") == 0).alias("n"), (F.count_if(F.col("channel") == 1) > 0).alias("a"))
    n = F.when(F.col("call_id") % 13 == 0, None).otherwise(F.col("n"))
    return w.select("call_id", K.semantic_path(n, F.col("a"), F.col("call_id") % 4 != 0).alias("s")).select("call_id", "s.path", "s.reason")


@query("prj_15_feature_vector", "select call_id, coalesce(case when call_id % 3 > 0 then avg(score) end, 0.5) + coalesce(case when call_id % 2 > 0 then max(score) end, 0.0) as total from d_chunks group by call_id", r="total")
def _(t):
    from pyspark.ml.functions import vector_to_array
    c = t.chunk_scores().groupBy("call_id").agg(F.avg("score").alias("m"), F.max("score").alias("x"))
    c = c.withColumns({"m": F.when(F.col("call_id") % 3 > 0, F.col("m")), "x": F.when(F.col("call_id") % 2 > 0, F.col("x"))})
    cols, assembler = K.feature_vector(["m", "x"], {"m": 0.5})
    return assembler.transform(c.select("call_id", *cols)).select("call_id", F.aggregate(vector_to_array("vector"), F.lit(0.0), lambda a, x: a + x).alias("total"))


# ------------------------------------------------------------------------------ joins

@query("jon_01_one_to_one", "select o.call_id, o.y, n_chunks, d.mean from d_order_calls o join d_agg d using (call_id)", r='mean')
def _(t):
    return J.one_to_one(t.order_calls().select("call_id", "y"), A.call_scores(t.chunk_scores(), ["mean"]), ["call_id"])


@query("jon_02_left_filled", "select o.call_id, coalesce(n_chunks,0) as n_chunks, coalesce(d.mean,0) as mean from d_order_calls o left join d_agg d using (call_id)", r="mean")
def _(t):
    return J.left_filled(t.order_calls().select("call_id"), A.call_scores(t.chunk_scores(), ["mean"]), "call_id", {"n_chunks": 0, "mean": 0.0})


@query("jon_03_missing", "select call_id from d_order_calls where call_id not in (select call_id from d_chunks)")
def _(t):
    return J.missing(t.order_calls(), t.chunk_scores()).select("call_id")


@query("jon_04_held", "select call_id, count(*) as n from d_chunks where call_id in (select call_id from d_order_calls where split='val') group by call_id")
def _(t):
    return J.held(t.chunk_scores(), t.order_calls().where("split = 'val'")).groupBy("call_id").agg(F.count(F.lit(1)).alias("n"))


@query("jon_05_parameters", "select thr, avg(((score>=thr)=(y=1))::int) as accuracy from d_preds, (select unnest([-1.0::double,0,1]) as thr) group by thr", r="thr accuracy")
def _(t):
    p = J.with_parameters(t.predictions(), [(-1.0,), (0.0,), (1.0,)], "thr double")
    return p.groupBy("thr").agg(F.avg(((F.col("score") >= F.col("thr")) == (F.col("y") == 1)).cast("double")).alias("accuracy"))


VIEWS["d_vec"] = """select call_id, y, split, list(x/n order by i) as vec from (select call_id, i, avg(x) as x from (select call_id, unnest(emb)::double as x, generate_subscripts(emb,1) as i from d_chunk_embeddings) group by all)
  join (select call_id, sqrt(sum(m*m)) as n from (select call_id, i, avg(x) as m from (select call_id, unnest(emb)::double as x, generate_subscripts(emb,1) as i from d_chunk_embeddings) group by all) group by call_id) using (call_id)
  join (select call_id, max(y) as y, case when call_id % 4 = 0 then 'val' else 'train' end as split from (select call_id, case when chunk=0 then y end as y from d_chunk_embeddings) group by call_id) using (call_id) group by all"""


def vectors(t):
    e = t.chunk_embeddings()
    v = A.mean_vector(e, ["call_id"], extra={"y": F.max(F.when(F.col("chunk") == 0, F.col("y")))})
    return v.withColumn("split", F.when(F.col("call_id") % 4 == 0, "val").otherwise("train"))


@query("jon_06_nearest_neighbour", """select a.call_id, a.y, arg_max(b.call_id, list_dot_product(a.vec,b.vec)) as neighbour, max(list_dot_product(a.vec,b.vec)) as similarity from d_vec a join d_vec b
  on a.y=b.y and a.split='val' and b.split='train' group by a.call_id, a.y""", r="similarity")
def _(t):
    return V.nearest_train_neighbour(vectors(t), rows=16)


@query("jon_06_neighbour_summary", """with s as (select a.call_id, a.y, a.split, max(list_dot_product(a.vec,b.vec)) as s from d_vec a join d_vec b on a.y=b.y and b.split='train' and a.call_id<>b.call_id group by all)
  select y, count(*) filter (split='val') as n, min(s) filter (split='val') as least, max(s) filter (split='val') as largest, median(s) filter (split='val') as median_similarity, median(s) filter (split='train') as train_median from s group by y""",
       r="least largest median_similarity train_median")
def _(t):
    return V.neighbour_summary(vectors(t), rows=16)


@query("jon_07_near_duplicates", """select a.call_id as val_id, arg_max(b.call_id, list_dot_product(a.vec,b.vec)) as train_id, max(list_dot_product(a.vec,b.vec)) as similarity, count(*) filter (list_dot_product(a.vec,b.vec) > 0.3) as n_pairs
  from d_vec a join d_vec b on a.split='val' and b.split='train' group by a.call_id having max(list_dot_product(a.vec,b.vec)) > 0.3""", r="similarity")
def _(t):
    return V.near_duplicates(vectors(t), 0.3, rows=16)


@query("jon_08_matched_pairs")
def _(t):
    p = t.predictions()
    return J.matched_pairs(p.where("y = 0"), p.where("y = 1"), "score", 0.05)


PAIRS = "p as (select least(a.y,b.y) || '|' || greatest(a.y,b.y) as pair, round_even(list_dot_product(a.vec,b.vec),4) as sim from d_vec a join d_vec b on a.call_id<b.call_id)"


@query("agg_24_pair_similarity_hist", f"""with {PAIRS} select pair, least(floor((sim+0.2)/1.2*50),49)::int as bin, count(*) as n from p where sim between -0.2 and 1 group by all""")
def _(t):
    return V.pair_similarity_histogram(V.pair_similarity_counts(vectors(t), rows=32))


@query("agg_24_pair_similarity_median", f"with {PAIRS} select pair, median(sim) as median, count(*) as pairs from p group by pair", r="median")
def _(t):
    return V.pair_similarity_medians(V.pair_similarity_counts(vectors(t), rows=32))


@query("mod_18_threshold_clusters", """with recursive e as materialized (select a.call_id as a, b.call_id as b from d_vec a join d_vec b on list_dot_product(a.vec,b.vec) >= 0.35),
  r(a, b) as (select call_id, call_id from d_vec union select r.a, e.b from r join e on r.b=e.a) select a as call_id, min(b) as cluster from r group by a""")
def _(t):
    v = vectors(t)
    return V.connected_components(v, V.similarity_edges(v, 0.35, rows=32))


@query("mod_19_describe_clusters", """with c as (select o_custkey as cluster, o_orderkey as call_id, case when o_orderkey % 5 = 0 then 'val' else 'train' end as split from orders),
  p as (select cluster, count(*) as n, count(*) filter (split='train') as train, count(*) filter (split='val') as val from c group by cluster)
  select count(*) as n_clusters, count(*) filter (n=1) as n_singletons, max(n) as largest, count(*) filter (train>0 and val>0) as shared_clusters, (sum(val) filter (train>0 and val>0))::bigint as exposed_val, sum(val)::bigint as val_total from p""")
def _(t):
    c = t.raw("orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("call_id"))
    return V.describe_clusters(c, t.order_calls())


# ------------------------------------------------------------------------------ sets and guards

@query("set_02_top_errors", """select call_id, y, p, error from (select call_id, y, 1/(1+exp(-score)) as p, abs(1/(1+exp(-score))-y) as error from d_preds order by round(error,9) desc, call_id limit 30) where (p>=0.5)<>(y=1)""", r="p error")
def _(t):
    p = t.predictions().select("call_id", "y", F.round(1 / (1 + F.exp(-F.col("score"))), 9).alias("p"))
    return Q.top_errors(p, 30)


@query("set_03_split_overlap", "select l_orderkey as call_id from lineitem where l_linenumber % 2 = 1 intersect select l_orderkey from lineitem where l_linenumber % 2 = 0")
def _(t):
    s = F.when(F.col("l_linenumber") % 2 == 1, "train").otherwise("val")
    return Q.split_overlap(t.raw("lineitem").select(F.col("l_orderkey").alias("call_id"), s.alias("split")))


@query("set_03_id_differences", """select call_id, 'left' as only_in from (select o_orderkey as call_id from orders except all select distinct l_orderkey from lineitem)
  union all select call_id, 'right' from (select distinct l_orderkey as call_id from lineitem except all select o_orderkey from orders)""")
def _(t):
    return Q.id_differences(t.order_calls(), t.raw("lineitem").select(F.col("l_orderkey").alias("call_id")).distinct())


@query("set_04_union_sets", "select domain, count(*) as n from (select domain from d_preds where model='a' union all select domain from d_preds where model='b' union all select 'all' from d_preds) group by domain")
def _(t):
    p = t.predictions().select("domain", "model")
    u = Q.union_sets(p.where("model = 'a'"), p.where("model = 'b'").select("model", "domain"), p.withColumn("domain", F.lit("all")))
    return u.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("set_05_content_duplicates", "select md5(text) as digest, count(*)-1 as duplicates from documents group by md5(text) having count(*) > 1")
def _(t):
    return Q.content_duplicates(t.raw("documents"), "text")


@query("set_05_page_duplicates", "select sha256(html) as digest, count(*)-1 as duplicates from pages group by 1 having count(*) > 1")
def _(t):
    return Q.content_duplicates(t.raw("pages"), "html", "sha256")


@query("dq_01_calls_in_two_splits", "select o_custkey as call_id, 2 as splits from d_order_calls d join orders o on o.o_orderkey=d.call_id group by o_custkey having count(distinct split)=2")
def _(t):
    o = t.raw("orders").select(F.col("o_custkey").alias("call_id"), F.when(F.col("o_orderkey") % 5 == 0, "val").otherwise("train").alias("split"))
    return Q.calls_in_two_splits(o)


@query("dq_02_changed_split_or_label", "select call_id, m.split, m.label from d_manifest m join d_order_calls o using (call_id) where m.split<>o.split or m.label<>o.label")
def _(t):
    return Q.changed_split_or_label(manifest(t).select("call_id", "split", "label"), t.order_calls()).select("call_id", "split", "label")


@query("dq_03_held_out_family", "select call_id, family from d_manifest where split='train' and family in ('P')")
def _(t):
    return Q.held_out_family_in_training(manifest(t), ["P"]).select("call_id", "family")


@query("dq_04_bad_sample_ids", f"""with p as ({PLAN}), b as (select case when call_id % 11 = 0 then call_id || '__seen0' else sample_id end as sample_id, call_id, family, variant from p)
  select sample_id, 'duplicate' as problem from b group by sample_id having count(*) > 1 union all select sample_id, 'origin' from b where sample_id <> call_id || '__' || family || variant
  union all select sample_id, 'unknown_call' from b where call_id % 7 = 0""")
def _(t):
    p = P.augmentation_plan(t.order_calls())
    sid = F.when(F.col("call_id") % 11 == 0, F.concat(F.col("call_id").cast("string"), F.lit("__seen0"))).otherwise(F.col("sample_id"))
    return Q.bad_sample_ids(p.withColumn("sample_id", sid), t.order_calls().where("call_id % 7 <> 0"))


@query("dq_05_classes_lost", "select split, family, count(distinct label) as classes from d_manifest where not (family='P' and label='human') group by all having count(distinct label) < 2")
def _(t):
    return Q.classes_lost(manifest(t).where("not (family = 'P' and label = 'human')"))


@query("dq_06_planned_but_missing", """select 's' || call_id as sample_id, case when call_id % 10 = 0 then 'missing' else 'duration' end as problem from d_manifest where call_id % 10 in (0, 1)""")
def _(t):
    m = manifest(t).select(F.concat(F.lit("s"), F.col("call_id").cast("string")).alias("sample_id"), "duration_s", "call_id")
    made = m.where("call_id % 10 <> 0").withColumn("duration_s", F.col("duration_s") + F.when(F.col("call_id") % 10 == 1, 1.0).otherwise(0.0))
    return Q.planned_but_missing(m, made)


@query("dq_07_duration_errors", f"""with r as (select call_id, {CALL_MS / 1000} - (call_id % 3) as real_s from d_calls), l as (select call_id, max(end_ms)/1000.0::double as e from d_turns group by call_id)
  select call_id, abs({CALL_MS / 1000}-real_s)::double as duration_error_s, greatest(0, e-real_s)::double as turns_past_end_s from r join l using (call_id)""", r="duration_error_s turns_past_end_s")
def _(t):
    real = t.calls().select("call_id", (F.col("duration_s") - F.col("call_id") % 3).alias("duration_s"))
    return Q.duration_errors(t.calls(), real, t.turns())
