"""Queries over chunks, scores and grouped summaries, samples and plans, scalar expressions."""

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import metrics as M
from ..operators import sampling as P
from ..operators import scoring as A
from .metrics_queries import AUC, FEATS, curve_sql, features
from ..functions.fixed import LINE_SCALED, LINE_UNIFORM
from .registry import query
from .tables import VIEWS

LOGIT_AVG = "ln(least(greatest(avg(1/(1+exp(-score))),1e-6),1-1e-6)/(1-least(greatest(avg(1/(1+exp(-score))),1e-6),1-1e-6)))"
VIEWS.update({
    "d_rk": """select *, row_number() over (partition by call_id order by score) as rk, count(*) over (partition by call_id) as n from d_chunks""",
    "d_agg": f"""select call_id, count(*) as n_chunks, avg(score) as mean, median(score) as median, max(score) as max, min(score) as min,
      avg(score) filter (rk > n - greatest(1, ceil(0.25*n))) as top25_mean,
      avg(score) filter (rk > floor(0.1*n) and rk <= n - floor(0.1*n)) as trimmed_mean,
      {LOGIT_AVG} as mean_prob, sum(score*duration_s)/greatest(sum(duration_s),1e-9) as duration_weighted from d_rk group by call_id""",
})


@query("agg_01_call_scores", 'select call_id, n_chunks, mean, median, "max", "min" from d_agg', r='mean median "max" "min"')
def _(t):
    return A.call_scores(t.chunk_scores(), ["mean", "median", "max", "min"])


@query("agg_02_top25_mean", "select call_id, n_chunks, top25_mean from d_agg", r="top25_mean")
def _(t):
    return A.call_scores(t.chunk_scores(), ["top25_mean"])


@query("agg_03_trimmed_mean", "select call_id, n_chunks, trimmed_mean from d_agg", r="trimmed_mean")
def _(t):
    return A.call_scores(t.chunk_scores(), ["trimmed_mean"])


@query("agg_03_trimmed_mean_by_flag", """with r as (select flag, score, row_number() over (partition by flag order by score) as rk, count(*) over (partition by flag) as n from d_chunks)
  select flag, any_value(n) as n_chunks, avg(score) filter (rk > floor(0.1*n) and rk <= n-floor(0.1*n)) as trimmed_mean,
   avg(score) filter (rk > n-ceil(0.25*n)) as top25_mean, median(score) as median from r group by flag""", r="trimmed_mean top25_mean median")
def _(t):
    return A.call_scores(t.chunk_scores(), ["trimmed_mean", "top25_mean", "median"], ["flag"])


@query("agg_04_mean_prob", "select call_id, n_chunks, mean_prob from d_agg", r="mean_prob")
def _(t):
    return A.call_scores(t.chunk_scores(), ["mean_prob"])


@query("agg_05_duration_weighted", "select call_id, n_chunks, duration_weighted from d_agg", r="duration_weighted")
def _(t):
    return A.call_scores(t.chunk_scores(), ["duration_weighted"])


@query("agg_06_call_table", """select c.call_id, 0::bigint as page, y, split, avg(score) as score, count(*) as n_chunks,
  string_agg(printf('%.2f', score), ' ' order by chunk) as scores from d_chunks c join d_order_calls using (call_id) group by all""", r="score")
def _(t):
    c = A.call_table(t.chunks(), t.order_calls())
    return c.withColumn("scores", F.array_join(F.transform("scores", lambda s: F.format_string("%.2f", s)), " "))


EMB = """e as (select call_id, y, emb, duration_s, chunk from d_chunk_embeddings), x as (select call_id, unnest(emb)::double as x, generate_subscripts(emb,1) as i from {src}),
  m as (select call_id, i, avg(x) as m from x group by all), n as (select call_id, sqrt(sum(m*m)) as n from m group by call_id)
  select call_id, count(*) as dims, sum(m/n*i) as weighted, max(m/n) as top from m join n using (call_id) group by call_id"""


def vec_view(df):
    return df.select("call_id", F.size("vec").cast("bigint").alias("dims"), F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x).alias("weighted"),
                     F.array_max("vec").alias("top"))


@query("agg_07_call_embedding", "with " + EMB.format(src="e"), r="weighted top")
def _(t):
    return vec_view(A.mean_vector(t.chunk_embeddings(), ["call_id"]))


@query("agg_08_longest_chunks_embedding", "with k as (select * from d_chunk_embeddings qualify row_number() over (partition by call_id order by duration_s desc, chunk) <= 3), "
       + EMB.format(src="k"), r="weighted top")
def _(t):
    return vec_view(A.longest_chunks_vector(t.chunk_embeddings(), 3))


@query("agg_09_few_chunks", """select call_id, 'first' as variant, score, 1 as used from d_chunks where chunk=1
  union all select call_id, 'first3', avg(score), count(*) from d_chunks where chunk<=3 group by call_id
  union all select call_id, 'all', avg(score), count(*) from d_chunks group by call_id""", r="score")
def _(t):
    return A.few_chunks(t.chunks()).where("variant <> 'random'")


@query("agg_09_random_chunk")
def _(t):
    return A.few_chunks(t.chunks(), seed=3).where("variant = 'random'")


@query("agg_09_single_chunks", """with s as (select y, score, round(c.end_s-c.start_s,9) as duration_s from d_chunks c join d_order_calls o on c.call_id=o.call_id),
  v as (select 'single' as variant, * from s union all select 'single_short', * from s where duration_s < 2)
  select variant, count(*) as n, avg(((score>=0)=(y=1))::int) as accuracy from v group by variant""", r="accuracy")
def _(t):
    s = A.single_chunks(t.chunks().withColumn("duration_s", F.col("end_s") - F.col("start_s")).withColumn("duration_s", F.round("duration_s", 9)), t.order_calls())
    m = M.decision_metrics(s, ["variant"])
    return m.select("variant", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"), "accuracy")


METHOD_ROWS = " union all ".join(f"select split, y, '{m}' as method, coalesce(\"{m}\",0) as score from d_order_calls left join d_agg using (call_id)" for m in A.COMPARED)


@query("agg_10_aggregation_compare", f"""with l as ({METHOD_ROWS}), r as (select split, y, method, round(score,9) as score from l), c as ({curve_sql('r', 'method, split')}),
  a as (select method, split, {AUC} as auc from c group by all) select method, split, count(*) as n, avg(((score>=0)=(y=1))::int) as accuracy, any_value(auc) as auc
  from r join a using (method, split) group by all""", r="accuracy auc")
def _(t):
    s = A.complete_calls(t.order_calls(), A.call_scores(t.chunk_scores(), A.COMPARED), A.COMPARED + ["n_chunks"])
    s = s.select("split", "y", *[F.round(m, 9).alias(m) for m in A.COMPARED])
    long = s.unpivot(["split", "y"], A.COMPARED, "method", "score")
    return M.ranking(long, ["method", "split"]).select("method", "split", "n", "accuracy", "auc")


@query("agg_10_metrics_by_method")
def _(t):
    return A.aggregation_compare(t.chunk_scores(), t.order_calls()).select("method", "split", "n", "accuracy", "auc", "eer", "brier")


@query("agg_11_group_counts", """select split, count(*) filter (label='human') as human, count(*) filter (label='synthetic') as synthetic from d_order_calls group by split""")
def _(t):
    return A.group_counts(t.order_calls(), ["split"], "label", ["human", "synthetic"])


@query("agg_11_group_count_rollup", "select split, label, count(*) as n from d_order_calls group by rollup(split, label)")
def _(t):
    return A.group_count_rollup(t.order_calls(), ["split", "label"])


LONG = f"with {FEATS}, l as (select feature, case when feature='p_size' and value<10 then null else value end as value, case y when 1 then 'synthetic' else 'human' end as label from f)"


def long(t):
    v = F.when((F.col("feature") == "p_size") & (F.col("value") < 10), None).otherwise(F.col("value"))
    return features(t).withColumns({"value": v, "label": F.when(F.col("y") == 1, "synthetic").otherwise("human")})


@query("agg_12_class_medians", LONG + """ select feature, label, count(*) as n, avg((value is null)::int) as missing_share, median(value) as median, count(distinct value) as n_distinct
  from l group by all""", r="missing_share median")
def _(t):
    return A.class_medians(long(t), ["feature", "label"])


@query("agg_13_describe", LONG + """ select feature, count(value) as count, avg(value) as mean, stddev_samp(value) as std, min(value) as min, max(value) as max,
  quantile_cont(value,0.25) as q25, quantile_cont(value,0.5) as q50, quantile_cont(value,0.75) as q75 from l group by feature""", r='mean std "min" "max" q25 q50 q75')
def _(t):
    return A.describe(long(t))


@query("agg_14_typical_example", """with b as (select o_orderkey as call_id, o_orderstatus as label, o_totalprice as a, o_custkey::double as b from orders),
  m as (select label, median(a) as ma, median(b) as mb from b group by label),
  d as (select call_id, label, abs(a-ma)/1000 + abs(b-mb)/10 as distance from b join m using (label))
  select label, call_id, distance from d qualify row_number() over (partition by label order by distance, call_id)=1""", r="distance")
def _(t):
    b = t.raw("orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderstatus").alias("label"), F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    return A.typical_example(b, "call_id", "label", {"a": 1000.0, "b": 10.0})


@query("agg_16_source_summary", """select domain as source, model as variant, count(*) as n, avg(((score>=0)=(y=1))::int) as correct, median(score) as median_score,
  median(1/(1+exp(-score))) as median_p from d_preds group by all""", r="correct median_score median_p")
def _(t):
    return A.source_summary(t.predictions().withColumnsRenamed({"domain": "source", "model": "variant"}))


VIEWS["d_manifest"] = """select o_orderkey as call_id, case when o_orderkey % 5 = 0 then 'val' else 'train' end as split, o_orderstatus as family,
  case when o_custkey % 2 = 1 then 'synthetic' else 'human' end as label, case when o_orderkey % 9 = 0 then 'failed' else 'ok' end as status,
  o_totalprice/1000 as duration_s, (o_custkey % 200)::double as delay_ms, (o_custkey % 13)-6.0::double as level_change_db,
  case when o_orderkey % 3 = 0 then 'g711+gsm' when o_orderkey % 3 = 1 then 'gsm' else 'opus+opus' end as codecs from orders"""


def manifest(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.raw("orders").select(
        k.alias("call_id"), F.when(k % 5 == 0, "val").otherwise("train").alias("split"), F.col("o_orderstatus").alias("family"),
        F.when(c % 2 == 1, "synthetic").otherwise("human").alias("label"), F.when(k % 9 == 0, "failed").otherwise("ok").alias("status"),
        (F.col("o_totalprice") / 1000).alias("duration_s"), (c % 200).cast("double").alias("delay_ms"), ((c % 13) - 6.0).alias("level_change_db"),
        F.when(k % 3 == 0, "g711+gsm").when(k % 3 == 1, "gsm").otherwise("opus+opus").alias("codecs"))


@query("agg_17_augmentation_summary", """select split, family, label, count(*) filter (status='ok') as samples, count(*) filter (status<>'ok') as failed,
  sum(duration_s) filter (status='ok')/3600 as hours, min(delay_ms) filter (status='ok') as delay_min, max(delay_ms) filter (status='ok') as delay_max,
  median(delay_ms) filter (status='ok') as delay_median, avg(level_change_db) filter (status='ok') as mean_level_change_db from d_manifest group by all""",
       r="hours delay_min delay_max delay_median mean_level_change_db")
def _(t):
    return A.augmentation_summary(manifest(t))


@query("agg_17_codec_frequencies", "select codec, count(*) as n from (select unnest(str_split(codecs,'+')) as codec from d_manifest) group by codec")
def _(t):
    return A.codec_frequencies(manifest(t))


@query("agg_18_processing_summary", """select split, avg(delay_ms/1000) as mean_seconds, avg(duration_s) as mean_duration, sum(delay_ms/1000)/sum(duration_s) as real_time_factor
  from d_manifest group by split""", r="mean_seconds mean_duration real_time_factor")
def _(t):
    return A.processing_summary(manifest(t).withColumn("seconds", F.col("delay_ms") / 1000))


@query("agg_19_chunk_budget", """with p as (select call_id, count(*) as n, sum(duration_s) as s from d_chunks where flag<>'A' group by call_id),
  j as (select split, coalesce(n,0) as n, coalesce(s,0) as s from d_order_calls left join p using (call_id))
  select split, sum(n)::bigint as n_chunks, sum(s)/3600 as chunk_hours, count(*) filter (n=0) as calls_without_chunks, median(n) as median_chunks from j group by split""",
       r="chunk_hours median_chunks")
def _(t):
    return A.chunk_budget(t.order_calls(), t.chunk_scores().where("flag <> 'A'"))


@query("agg_20_model_comparison", f"""with c as ({curve_sql('d_preds', 'domain, model')}), a as (select domain, model, {AUC} as auc from c group by all),
  d as (select domain, model, avg(((score>=0)=(y=1))::int) as accuracy from d_preds group by all), j as (select * from a join d using (domain, model)),
  s as (select domain, model, auc, accuracy from j where domain<>'P' union all (select domain, model, auc, accuracy from j where domain='P' order by auc desc, domain, model limit 1))
  select domain, model, 'auc' as metric, auc as value from s union all select domain, model, 'accuracy', accuracy from s""", r="value")
def _(t):
    m = M.evaluate(t.predictions(), ["domain", "model"])
    return A.model_comparison(m.where("domain <> 'P'"), ["domain", "model"], ["auc", "accuracy"], m.where("domain = 'P'"))


@query("agg_21_class_histogram", """select least(floor((least(greatest(score,-2),3)+2)/5*20),19)::int as bin, count(*) filter (y=0) as human, count(*) filter (y=1) as synthetic
  from d_preds group by all""")
def _(t):
    p = t.predictions().withColumn("label", F.when(F.col("y") == 1, "synthetic").otherwise("human"))
    return A.class_histogram(p, "score", "label", ["human", "synthetic"], 20, -2.0, 3.0)


@query("agg_22_error_review", """with s as (select call_id, y, (call_id*37 % 101)/100.0::double as p from d_calls),
  w as (select *, case when p>=0.5 and y=0 then 'false_positive' when p<0.5 and y=1 then 'false_negative' end as kind from s)
  select w.call_id, kind, p, count(distinct (start_ms, end_ms, channel)) as n_turns, min(start_ms) as first_start from w join d_turns using (call_id) where kind is not null group by all""", r="p")
def _(t):
    s = t.calls().select("call_id", "y", ((F.col("call_id") * 37 % 101) / 100).alias("p"))
    e = A.error_review(s, t.turns())
    return e.groupBy("call_id", "kind", "p").agg(F.sum(F.size("timeline")).alias("n_turns"), F.min(F.col("timeline")[0]["start_ms"]).alias("first_start"))


PAIR = """with o as (select call_id, y, 1/(1+exp(-score)) as p from d_preds), j as (select call_id, o.y, o.p as p0, 1/(1+exp(-(d.score-0.4))) as p1, case when call_id % 40=0 then 0 else 5 end as c1
  from o join d_preds d using (call_id))"""


@query("agg_23_paired_shift", PAIR + """ select y, count(*) as n, avg(((p0>=0.5)=(y=1))::int) as accuracy_original, avg(((p1>=0.5)=(y=1))::int) as accuracy_changed,
  avg(abs(p1-p0)) as mean_abs_delta_p, count(*) filter ((p0>=0.5)=(y=1) and (p1>=0.5)<>(y=1)) as flips, count(*) filter (c1=0) as segmentation_failures, true as go from j group by y""",
       r="accuracy_original accuracy_changed mean_abs_delta_p")
def _(t):
    p = t.predictions()
    o = p.select("call_id", "y", X.sigmoid(F.col("score")).alias("p"), F.lit(5).alias("n_chunks"))
    c = p.select("call_id", X.sigmoid(F.col("score") - 0.4).alias("p"), F.when(F.col("call_id") % 40 == 0, 0).otherwise(5).alias("n_chunks"))
    return A.shift_summary(A.paired_shift(o, c), ["y"])


# ------------------------------------------------------------------------------ scalar expressions

@query("prj_02_is_confident", "select call_id, (1/(1+exp(-score))>=0.85 or 1/(1+exp(-score))<=0.15) as confident from d_preds")
def _(t):
    return t.predictions().select("call_id", X.is_confident(X.sigmoid(F.col("score"))).alias("confident"))


@query("prj_03_verdict", """with p as (select call_id, score, 1/(1+exp(-score)) as p from d_preds) select call_id, p>=0.5 as is_synthetic, round_even(greatest(p,1-p),4) as confidence,
  round_even(p,4) as confidence_synthetic from p""", r="confidence confidence_synthetic")
def _(t):
    p = X.sigmoid(F.col("score"))
    return t.predictions().select("call_id", X.is_synthetic(p).alias("is_synthetic"), X.confidence(p).alias("confidence"),
                                  X.confidence(p, "synthetic").alias("confidence_synthetic"))


@query("prj_05_calibrate", "select call_id, 1/(1+exp(-least(greatest(1.7*score-0.2,-40),40))) as p, 1/(1+exp(-(30*score))) as p_unclipped from d_preds", r="p p_unclipped")
def _(t):
    return t.predictions().select("call_id", X.calibrate(F.col("score"), 1.7, -0.2).alias("p"), X.calibrate(F.col("score"), 30.0, 0.0, None).alias("p_unclipped"))


@query("prj_06_logit", "with p as (select o_orderkey as call_id, (o_custkey % 101)/100.0::double as p from orders) select call_id, ln(least(greatest(p,1e-6),1-1e-6)/(1-least(greatest(p,1e-6),1-1e-6))) as z from p", r="z")
def _(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("call_id"), X.logit((F.col("o_custkey") % 101) / 100).alias("z"))


@query("prj_08_layer_quality", """select call_id, sum(duration_s) as speech_s, least(1, sum(duration_s)/12)::double as acoustic_quality,
  case any_value(call_id % 4) when 0 then 1.0::double when 1 then 0.5::double when 2 then 0.5::double else 0.0::double end as semantic_quality from d_chunks group by call_id""",
       r="speech_s acoustic_quality semantic_quality")
def _(t):
    from ..operators.quality import acoustic_quality, semantic_quality
    c = t.chunk_scores().groupBy("call_id").agg(F.sum("duration_s").alias("speech_s"))
    k = F.col("call_id") % 4
    path = F.when(k == 0, "f4+f5").when(k == 1, "f4").when(k == 2, "other").otherwise("abstain")
    return c.select("call_id", "speech_s", acoustic_quality(F.col("speech_s")).alias("acoustic_quality"), semantic_quality(path).alias("semantic_quality"))


@query("prj_09_level_gain", """with x as (select vec_id, unnest(embedding)::double as x from embeddings), r as (select vec_id, sqrt(avg(x*x)) as rms, max(x) as top from x group by vec_id)
  select vec_id, pow(10,-26/20.0::double)/(rms+1e-9) as gain, top*pow(10,-26/20.0::double)/(rms+1e-9) as top from r""", r="gain top")
def _(t):
    e = t.raw("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    rms = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x) / F.size("s"))
    e = e.withColumn("gain", X.level_gain(rms))
    return e.select("vec_id", "gain", F.array_max(X.apply_gain(F.col("s"), F.col("gain"))).alias("top"))


@query("prj_10_zscore_chunk", """with x as (select vec_id, unnest(embedding)::double as x from embeddings)
  select vec_id, (max(x)-avg(x))/sqrt(var_pop(x)+1e-7) as top, (min(x)-avg(x))/sqrt(var_pop(x)+1e-7) as bottom from x group by vec_id""", r="top bottom")
def _(t):
    z = X.zscore_array(F.transform("embedding", lambda x: x.cast("double")))
    return t.raw("embeddings").select("vec_id", z.alias("z")).select("vec_id", F.array_max("z").alias("top"), F.array_min("z").alias("bottom"))


@query("prj_11_mask_identifier", "with d as (select c_custkey, regexp_replace(substr(c_name,8) || '-5', '[^0-9]', '', 'g') as n from customer) select c_custkey, case when length(n)>=4 then '…' || right(n,4) else '…' end as masked from d")
def _(t):
    return t.raw("customer").select("c_custkey", X.mask_identifier(F.concat(F.substring("c_name", 8, 100), F.lit("-5"))).alias("masked"))


@query("prj_14_input_guards", """with j as (select call_id, 40 + (call_id % 100)*8.0::double as duration_s, sum(duration_s) as caller_speech_s, case when call_id % 77=0 then 'nan'::double else avg(score) end as f from d_chunks group by call_id)
  select call_id, case when duration_s < 50 then 'too_short' when duration_s > 800 then 'too_long' when caller_speech_s < 4 then 'not_enough_speech' when isnan(f) then 'non_finite_feature' end as reason from j""")
def _(t):
    from ..operators.quality import input_guard
    j = t.chunk_scores().groupBy("call_id").agg(F.sum("duration_s").alias("caller_speech_s"), F.avg("score").alias("f"))
    j = j.withColumns({"duration_s": 40 + (F.col("call_id") % 100) * 8.0, "f": F.when(F.col("call_id") % 77 == 0, float("nan")).otherwise(F.col("f"))})
    return j.select("call_id", input_guard(["f"], 50, 800, 4).alias("reason"))


# ------------------------------------------------------------------------------ samples and plans

@query("set_06_balanced_head", "select call_id, label from d_order_calls qualify row_number() over (partition by label order by call_id) <= 25")
def _(t):
    return P.balanced_head(t.order_calls(), "label", "call_id", 50).select("call_id", "label")


@query("set_07_sample_per_class", "select label, 12 as n, 12 as n_distinct from (select distinct label from d_order_calls)")
def _(t):
    s = P.sample_per_class(t.order_calls(), "label", "call_id", 12, 5)
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("call_id").alias("n_distinct"))


@query("src_03_load_split", "select label, greatest(2, round_even(count(*)*0.3,0))::bigint as n from d_order_calls where split='val' group by label")
def _(t):
    from ..sources.corpus import load_split
    return load_split(t.order_calls(), "val", 0.3, 11).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


PLAN = """select call_id || '__' || family || v as sample_id, call_id, split, family, v::int as variant, sha256(call_id || '|' || family || '|' || v) as h from (
  select call_id, split, unnest(case when split='train' then ['seen','seen'] else ['seen','unseen'] end) as family, unnest(case when split='train' then [0,1] else [0,0] end) as v from d_order_calls)"""


@query("set_08_augmentation_plan", f"with p as ({PLAN}) select sample_id, call_id, split, family, variant, substr(h,1,16) as seed_hex from p where call_id % 3 <> 0 or family <> 'seen' or variant <> 0")
def _(t):
    o = t.order_calls()
    done = o.where("call_id % 3 = 0").select(F.concat(F.col("call_id").cast("string"), F.lit("__seen0")).alias("sample_id"))
    p = P.augmentation_plan(o, done)
    return p.select("sample_id", "call_id", "split", "family", "variant", F.lower(F.lpad(F.conv(F.col("seed").cast("string"), 10, 16), 16, "0")).alias("seed_hex"))


@query("set_09_draw_line_parameters")
def _(t):
    return P.draw_line_parameters(P.augmentation_plan(t.order_calls())).drop("seed")


@query("set_09_severity", """select count(*) as n, 2.0::double as ratio_least, 2.0::double as ratio_most, true as inside from (select o_orderkey from orders)""")
def _(t):
    """Twice the severity is twice every impairment, with the draws as they were; every draw lies in its range."""
    plan = t.order_calls().select("call_id", F.col("call_id").alias("seed"), F.lit("seen").alias("family"))
    one, two = (P.draw_line_parameters(plan, s).select("call_id", *LINE_UNIFORM, "loss_rate") for s in (1.0, 2.0))
    j = one.join(two.select("call_id", *[F.col(c).alias(f"{c}_2") for c in LINE_SCALED]), "call_id")
    r = F.array(*[F.when(F.col(c) != 0, F.col(f"{c}_2") / F.col(c)) for c in LINE_SCALED])
    known = F.filter(r, lambda x: x.isNotNull())
    inside = F.forall(F.array(*[F.col(c).between(lo, hi) for c, (lo, hi) in LINE_UNIFORM.items()]), lambda x: x)
    return j.agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min(known)).alias("ratio_least"), F.max(F.array_max(known)).alias("ratio_most"), F.bool_and(inside).alias("inside"))


@query("set_10_model_selection", f"""with c as ({curve_sql('d_preds', 'domain, model')}), a as (select domain, model, {AUC} as auc from c group by all),
  d as (select domain, model, avg(((score>=0)=(y=1))::int) as acc, avg(pow(least(greatest(1/(1+exp(-score)),1e-6),1-1e-6)-y,2)) as brier from d_preds group by all),
  g as (select model, round_even(min(auc),4) as worst_auc, round_even(min(acc),4) as worst_accuracy, round_even(max(brier),5) as worst_brier from a join d using (domain, model) group by model)
  select * from g order by worst_auc desc, worst_accuracy desc, worst_brier, model limit 1""", r="worst_auc worst_accuracy worst_brier")
def _(t):
    return P.best_model(M.evaluate(t.predictions(), ["domain", "model"]))


@query("set_10_best_within_band", f"""with c as ({curve_sql('d_preds', 'condition')}), a as (select condition, {AUC} as auc from c group by all),
  d as (select condition, avg(((score>=0)=(y=1))::int) as accuracy from d_preds group by all), j as (select * from a join d using (condition))
  select condition, auc, accuracy from j where auc >= (select max(auc) from j)-0.005 order by accuracy desc, condition limit 1""", r="auc accuracy")
def _(t):
    m = M.evaluate(t.predictions(), ["condition"]).select("condition", "auc", "accuracy")
    return P.best_within(m, "auc", 0.005, F.desc("accuracy"), F.col("condition"))


@query("set_11_bootstrap_resample", "select y, 10 as replicates, count(*)*10 as rows from d_preds group by y")
def _(t):
    w = P.poisson_weights(t.predictions().select("call_id", "y"), "call_id", 10, 1)
    return w.groupBy("y").agg(F.count_distinct("replicate").alias("replicates"), F.count(F.lit(1)).alias("rows"))
