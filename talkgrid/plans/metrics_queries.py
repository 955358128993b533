"""Queries over score tables: metrics, curves, calibration, audits."""

from pyspark.sql import functions as F

from ..functions.scalar import sigmoid
from ..operators import metrics as M
from ..operators.resampling import bootstrap_auc_difference
from .registry import query


def curve_sql(base: str, by: str, score: str = "score") -> str:
    """Distinct scores per group with decision counts, as SQL."""
    return f"""select *, 1 - tp/nullif(p_all,0) as fnr, fp/nullif(n_all,0) as fpr from (
      select *, sum(pos) over (partition by {by} order by {score} desc) as tp,
        sum(neg) over (partition by {by} order by {score} desc) as fp,
        coalesce(sum(neg) over (partition by {by} order by {score} rows between unbounded preceding and 1 preceding), 0) as n_below,
        sum(pos) over (partition by {by}) as p_all, sum(neg) over (partition by {by}) as n_all
      from (select {by}, {score}, sum(y)::double as pos, sum(1-y)::double as neg from {base}
            where {score} is not null and y is not null group by all))"""


DECISION_SQL = """(tp+tn)/(tp+tn+fp+fn) as accuracy,
  (coalesce(tp/nullif(tp+fn,0),0) + coalesce(tn/nullif(tn+fp,0),0))/2 as balanced_accuracy,
  coalesce(tp/nullif(tp+fp,0),0) as "precision", coalesce(tp/nullif(tp+fn,0),0) as recall,
  coalesce(2*tp/nullif(2*tp+fp+fn,0),0) as f1, coalesce(fn/nullif(fn+tp,0),0) as far, coalesce(fp/nullif(fp+tn,0),0) as frr"""
CONF = """count(*) filter (y=0 and not score>=0) as tn, count(*) filter (y=0 and score>=0) as fp,
  count(*) filter (y=1 and not score>=0) as fn, count(*) filter (y=1 and score>=0) as tp"""
AUC = "sum(pos*(n_below + neg/2))/nullif(max(p_all*n_all),0)"
P_SQL = "least(greatest(1/(1+exp(-score)),1e-6),1-1e-6)"
ECE_BIN = "(" + "+".join(f"(p > {e!r}::double)::int" for e in M.ECE_EDGES[1:-1]) + ")"


def with_p(t):
    return t.predictions().withColumn("p", sigmoid(F.col("score"), None))


@query("met_01_confusion", f"select split, {CONF} from d_preds group by split")
def _(t):
    return M.confusion(t.predictions(), ["split"])


@query("met_02_decision_metrics", f"with c as (select split, {CONF} from d_preds group by split) select *, {DECISION_SQL} from c",
       r='accuracy balanced_accuracy "precision" recall f1 far frr')
def _(t):
    return M.decision_metrics(t.predictions(), ["split"])


@query("met_03_roc_auc", f"with c as ({curve_sql('d_preds', 'domain, model')}) select domain, model, {AUC} as auc from c group by all", r="auc")
def _(t):
    return M.roc_auc(t.predictions(), ["domain", "model"])


@query("met_04_average_precision", f"""with c as ({curve_sql('d_preds', 'domain, model')})
  select domain, model, sum(pos/p_all * tp/(tp+fp)) as ap from c group by all""", r="ap")
def _(t):
    return M.score_curve(t.predictions(), ["domain", "model"]).groupBy("domain", "model").agg(M.ap_column().alias("ap"))


@query("met_05_eer_nearest", f"""with c as ({curve_sql('d_preds', 'domain, model')}),
  k as (select *, row_number() over (partition by domain, model order by abs(fnr-fpr), score desc) as rn from c)
  select domain, model, (fnr+fpr)/2 as eer, score as threshold from k where rn=1""", r="eer threshold")
def _(t):
    return (M.score_curve(t.predictions(), ["domain", "model"]).groupBy("domain", "model")
            .agg(M.eer_nearest_column("score").alias("e")).select("domain", "model", "e.eer", "e.threshold"))


@query("met_06_eer_interpolated", f"""with c as ({curve_sql('d_preds', 'domain, model')}),
  k as (select *, coalesce(lag(fpr) over w, 0) as f0, coalesce(lag(fpr-fnr) over w, -1) as d0, fpr-fnr as d1 from c
        window w as (partition by domain, model order by score desc)),
  s as (select *, row_number() over (partition by domain, model order by score desc) as rn from k where d1 >= 0)
  select domain, model, f0 + (-d0/(d1-d0))*(fpr-f0) as eer from s where rn=1""", r="eer")
def _(t):
    return M.score_curve(t.predictions(), ["domain", "model"]).groupBy("domain", "model").agg(
        M.eer_interpolated_column("score").alias("eer"))


@query("met_07_probability_losses", f"""with q as (select split, y, {P_SQL} as p from d_preds)
  select split, avg((p-y)*(p-y)) as brier, avg(-(y*ln(p)+(1-y)*ln(1-p))) as log_loss from q group by split""", r="brier log_loss")
def _(t):
    return M.probability_losses(with_p(t), ["split"])


@query("met_08_ece_10", f"""with q as (select split, y, 1/(1+exp(-score)) as p from d_preds),
  b as (select split, {ECE_BIN} as bin, count(*) as n, avg(p) as c, avg(y) as f from q group by all)
  select split, sum(n*abs(c-f))/sum(n) as ece from b group by split""", r="ece")
def _(t):
    return M.ece(with_p(t), ["split"])


@query("met_08_reliability_10", f"""with q as (select split, y, 1/(1+exp(-score)) as p from d_preds)
  select split, {ECE_BIN} as bin, count(*) as n, avg(p) as confidence, avg(y) as frequency from q group by all""",
       r="confidence frequency")
def _(t):
    return M.reliability(with_p(t), ["split"])


@query("met_09_ece_8", """with q as (select split, y, 1/(1+exp(-score)) as p from d_preds),
  b as (select split, least(floor(p*8),7) as bin, count(*) as n, avg(p) as c, avg(y) as f from q group by all)
  select split, sum(n*abs(c-f))/sum(n) as ece from b group by split""", r="ece")
def _(t):
    return M.ece(with_p(t), ["split"], bins=8, left_closed=True)


@query("met_10_quantile_gap", """with q as (select split, y, 1/(1+exp(-score)) as p from d_preds),
  e as (select split, quantile_cont(p, [0.2,0.4,0.6,0.8]) as e from q group by split),
  b as (select q.split, (e[1]<p)::int+(e[2]<p)::int+(e[3]<p)::int+(e[4]<p)::int as bin, avg(p) as c, avg(y) as f
        from q join e using (split) group by all)
  select split, avg(abs(c-f)) as mean_gap from b group by split""", r="mean_gap")
def _(t):
    return M.quantile_gap(with_p(t), ["split"])


BEST = """, cand as (select domain, model, score as t, tp + n_all - fp as correct, p_all + n_all as n from c
   union all select domain, model, 0.0, count(*) filter ((score >= 0) = (y=1)), count(*) from b group by all),
  best as (select *, row_number() over (partition by domain, model order by correct desc, t) as rn from cand)"""


@query("met_11_best_threshold", f"with b as (select * from d_preds), c as ({curve_sql('b', 'domain, model')}){BEST}"
       " select domain, model, correct/n as best_accuracy, t as best_threshold from best where rn=1",
       r="best_accuracy best_threshold")
def _(t):
    return M.evaluate(t.predictions(), ["domain", "model"]).select("domain", "model", "best_accuracy", "best_threshold")


MATRIX_SQL = f"""with b as (select * replace (case when no_speech then 0.0 else score end as score) from d_preds),
  c as ({curve_sql('b', 'domain, model')}){BEST},
  d as (select domain, model, count(*) as n, {CONF}, count(*) filter (no_speech) as files_without_speech,
        avg(({P_SQL}-y)*({P_SQL}-y)) as brier, avg(-(y*ln({P_SQL})+(1-y)*ln(1-{P_SQL}))) as log_loss from b group by all),
  e as (select *, row_number() over (partition by domain, model order by abs(fnr-fpr), score desc) as rn from c),
  a as (select domain, model, {AUC} as auc from c group by all)
  select d.domain, d.model, d.n, {DECISION_SQL}, auc, (e.fnr+e.fpr)/2 as eer, brier, log_loss, correct/best.n as best_accuracy,
    t as best_threshold, files_without_speech
  from d join a using (domain, model) join e on e.domain=d.domain and e.model=d.model and e.rn=1
  join best on best.domain=d.domain and best.model=d.model and best.rn=1"""
MATRIX_COLS = ["domain", "model", "n", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "far", "frr", "auc", "eer",
               "brier", "log_loss", "best_accuracy", "best_threshold", "files_without_speech"]


# the error counts carry their table names: c also has tp and fp columns
@query("met_12_evaluation_matrix", MATRIX_SQL.replace(DECISION_SQL, DECISION_SQL.replace("tp", "d.tp").replace("fp", "d.fp")),
       r='accuracy balanced_accuracy "precision" recall f1 far frr auc eer brier log_loss best_accuracy best_threshold')
def _(t):
    return M.evaluation_matrix(t.predictions()).select(*MATRIX_COLS)


@query("met_13_worst_case", """with a as (select domain, model, avg(((case when no_speech then 0 else score end >= 0) = (y=1))::int) as acc
  from d_preds group by all) select model, min(acc) as worst_all, min(acc) filter (domain in ('F','O')) as worst_telephone
  from a group by model""", r="worst_all worst_telephone")
def _(t):
    return M.worst_case(M.evaluation_matrix(t.predictions()), ["F", "O"])


FEATS = """f as (select 'p_size' as feature, p_size::double as value, (p_partkey % 2)::int as y from part
  union all select 'p_retailprice', p_retailprice, (p_partkey % 2)::int from part
  union all select 's_acctbal', s_acctbal, (s_suppkey % 2)::int from supplier
  union all select 'c_acctbal', c_acctbal, (c_custkey % 2)::int from customer)"""


def features(t):
    parts = [("part", "p_partkey", "p_size"), ("part", "p_partkey", "p_retailprice"),
             ("supplier", "s_suppkey", "s_acctbal"), ("customer", "c_custkey", "c_acctbal")]
    out = None
    for table, key, col in parts:
        d = t.raw(table).select(F.col(key).alias("id"), (F.col(key) % 2).cast("int").alias("y"), F.lit(col).alias("feature"),
                                F.col(col).cast("double").alias("value"))
        out = d if out is None else out.unionByName(d)
    return out


@query("met_14_single_feature_auc", f"with {FEATS}, c as ({curve_sql('f', 'feature', 'value')}) select feature,"
       f" max(p_all+n_all)::bigint as n, {AUC} as auc from c group by feature", r="auc")
def _(t):
    return M.single_feature_auc(features(t))


@query("met_15_mann_whitney", f"""with {FEATS}, c as ({curve_sql('f', 'feature', 'value')}),
  g as (select feature, sum(pos*(n_below+neg/2)) as u, max(p_all) as n1, max(n_all) as n0,
        sum(pow(pos+neg,3)-(pos+neg)) as ties from c group by feature)
  select feature, u, greatest(abs(u-n1*n0/2)-0.5,0)/sqrt(n1*n0/12*((n1+n0+1)-ties/((n1+n0)*(n1+n0-1)))) as z from g""", r="u z")
def _(t):
    return M.mann_whitney(features(t)).drop("p_value")


@query("met_15_mann_whitney_p")
def _(t):
    return M.mann_whitney(features(t))


RANK = "rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1)/2.0"


@query("met_16_spearman", f"""with r as (select o_orderstatus, {RANK.format(by='o_orderstatus', c='o_totalprice')} as ra,
  {RANK.format(by='o_orderstatus', c='o_custkey')} as rb from orders)
  select o_orderstatus, corr(ra, rb) as spearman from r group by all""", r="spearman")
def _(t):
    return M.spearman(t.raw("orders"), ["o_orderstatus"], "o_totalprice", "o_custkey")


@query("met_16_pearson_redundancy", """select 'l_quantity' as a, 'l_extendedprice' as b, corr(l_quantity, l_extendedprice) as r from lineitem
  union all select 'l_quantity','l_discount', corr(l_quantity,l_discount) from lineitem
  union all select 'l_quantity','l_tax', corr(l_quantity,l_tax) from lineitem
  union all select 'l_extendedprice','l_discount', corr(l_extendedprice,l_discount) from lineitem
  union all select 'l_extendedprice','l_tax', corr(l_extendedprice,l_tax) from lineitem
  union all select 'l_discount','l_tax', corr(l_discount,l_tax) from lineitem""", r="r")
def _(t):
    return M.correlation_pairs(t.raw("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("met_17_id_leakage", f"""with b as (select conv_num as idv, y, 'all' as scope from (select ('0x' || printf('%012x', o_orderkey*7919))::bigint as conv_num,
    (o_custkey % 2)::int as y from orders)), c as ({curve_sql('b', 'scope', 'idv')}),
  l as (select y, lag(y) over (order by idv) as prev from b)
  select (select {AUC} from c) as id_auc, (select count(*) filter (prev is null or prev <> y) from l) as label_runs,
    (select 1 + 2.0::double*count(*) filter (y=0)*count(*) filter (y=1)/count(*) from b) as expected_runs""", r="id_auc expected_runs")
def _(t):
    o = t.raw("orders").select(
        F.concat(F.lit("call_"), F.lpad(F.lower(F.hex(F.col("o_orderkey") * 7919)), 12, "0")).alias("anon_id"),
        (F.col("o_custkey") % 2).cast("int").alias("y"))
    return M.id_leakage(o, F.conv(F.substring("anon_id", 6, 12), 16, 10).cast("bigint"))


@query("met_18_quartile_strata", f"""with e as (select quantile_cont(o_totalprice, [0.25,0.5,0.75]) as e from orders where o_orderkey % 5 <> 0),
  s as (select (o_totalprice>=e[1])::int+(o_totalprice>=e[2])::int+(o_totalprice>=e[3])::int as stratum, p.y, p.score
        from orders o, e, d_preds p where p.call_id = o.o_orderkey and o.o_orderkey % 5 = 0),
  d as (select stratum, count(*) as n, {CONF} from s group by stratum)
  select stratum, n, (tp+tn)/n as accuracy, coalesce(2*tp/nullif(2*tp+fp+fn,0),0) as f1 from d""", r="accuracy f1")
def _(t):
    p = t.predictions().join(t.raw("orders").select(F.col("o_orderkey").alias("call_id"), "o_totalprice"), "call_id")
    s = M.strata_by_train_quartile(p, "o_totalprice").where(F.col("split") == "val")
    d = M.decision_metrics(s, ["stratum"])
    return d.select("stratum", (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n"), "accuracy", "f1")


@query("met_19_perturbation_report", """with o as (select call_id, y, 1/(1+exp(-score)) as p0 from d_preds),
  v as (select call_id, v.variant, 1/(1+exp(-(score + v.shift))) as p from d_preds, (values ('low',-0.3),('high',0.2)) v(variant, shift))
  select variant, count(*) as n, avg(abs(p-p0)) as mean_abs_change, max(abs(p-p0)) as max_abs_change,
    count(*) filter ((p>=0.5)<>(p0>=0.5)) as flips, avg(((p0>=0.5)=(y=1))::int) as accuracy_before,
    avg(((p>=0.5)=(y=1))::int) as accuracy_after from o join v using (call_id) group by variant""",
       r="mean_abs_change max_abs_change accuracy_before accuracy_after")
def _(t):
    o = with_p(t).select("call_id", "y", "score", "p")
    shift = F.explode(F.array(F.struct(F.lit("low").alias("variant"), F.lit(-0.3).alias("d")),
                              F.struct(F.lit("high").alias("variant"), F.lit(0.2).alias("d")))).alias("v")
    v = o.select("call_id", "y", "score", shift).select("call_id", "y", "v.variant", sigmoid(F.col("score") + F.col("v.d")).alias("p"))
    return M.perturbation_report(o.select("call_id", "p"), v)


@query("met_20_stress_matrix", f"""with c as ({curve_sql('d_preds', 'condition')}), a as (select condition, {AUC} as auc from c group by all),
  d as (select condition, count(*) as n, avg(((score>=0)=(y=1))::int) as accuracy from d_preds group by all),
  m as (select * from d join a using (condition))
  select condition, n, accuracy, auc, (select avg(auc) from m where condition<>'5-LOW') as mean_auc_stressed,
    (select avg(accuracy) from m where condition<>'5-LOW') as mean_accuracy_stressed, (select min(auc) from m) as worst_auc,
    (select condition from m order by auc, condition limit 1) as worst_condition from m""",
       r="accuracy auc mean_auc_stressed mean_accuracy_stressed worst_auc")
def _(t):
    return M.stress_matrix(t.predictions(), clean="5-LOW")


def two_scores(t):
    return t.predictions().withColumn("other", F.col("score") + (F.col("call_id") % 7 - 3) / 2)


@query("met_21_bootstrap_auc_difference")
def _(t):
    return bootstrap_auc_difference(two_scores(t), "call_id", "score", "other")


@query("met_21_auc_difference", f"""with s as (select 'a' as which, y, score from d_preds union all select 'b', y, score + (call_id % 7 - 3)/2.0::double from d_preds),
  c as ({curve_sql('s', 'which')}), u as (select which, {AUC} as auc from c group by which)
  select max(auc) filter (which='a') - max(auc) filter (which='b') as delta_auc, 1000::bigint as replicates, true as within from u""", r="delta_auc")
def _(t):
    d = bootstrap_auc_difference(two_scores(t), "call_id", "score", "other")
    return d.select("delta_auc", "replicates", F.col("delta_auc").between(F.col("lo"), F.col("hi")).alias("within"))


@query("met_22_error_free_lower_bound", """select domain, count(*) as n, count(*) filter ((score>=2)<>(score>=2 and y>=0)) as errors,
  case when count(*) filter ((score>=2)<>(score>=2 and y>=0)) = 0 then pow(0.05, 1.0/count(*)) end as lower_bound
  from d_preds group by domain union all select 'wrong', count(*), count(*) filter ((score>=0)<>(y=1)),
  case when count(*) filter ((score>=0)<>(y=1)) = 0 then pow(0.05, 1.0/count(*)) end from d_preds""", r="lower_bound")
def _(t):
    p = t.predictions()
    right = M.error_free_lower_bound(p, ["domain"], F.col("y") >= 0)
    wrong = M.error_free_lower_bound(p.withColumn("domain", F.lit("wrong")), ["domain"], (F.col("score") >= 0) == (F.col("y") == 1))
    return right.unionByName(wrong)


@query("met_23_contributions", """select l_orderkey as call_id,
  sum(case when l_returnflag='R' then abs(round(l_tax*100-4)) else 0 end)/greatest(sum(abs(round(l_tax*100-4))),1e-12) as flag_share,
  abs(sum(case when l_returnflag='R' then round(l_tax*100-4) else 0 end)) > abs(sum(case when l_returnflag='R' then 0 else round(l_tax*100-4) end)) as flags_dominate
  from lineitem group by l_orderkey""", r="flag_share")
def _(t):
    li = t.raw("lineitem").select(F.col("l_orderkey").alias("call_id"), F.round(F.col("l_tax") * 100 - 4).alias("value"),
                                  (F.col("l_returnflag") == "R").alias("is_flag"))
    return M.term_contributions(li)


@query("met_24_missingness_support", """with w as (select (p_partkey % 2)::int as y, case when p_size > 10 then p_size end as size,
    case when p_partkey % 3 > 0 then p_retailprice end as price from part)
  select y, 'size' as feature, count(size) as n_known from w group by y union all select y, 'price', count(price) from w group by y""")
def _(t):
    p = t.raw("part").select((F.col("p_partkey") % 2).cast("int").alias("y"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"),
                             F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")).alias("price"))
    return M.missingness_support(p, ["size", "price"])


@query("met_25_claims_check", """with c as (select domain, avg(((score>=0)=(y=1))::int) as computed from d_preds group by domain),
  s as (select * from (values ('F',0.7::double),('O',0.0::double),('X',0.5::double)) s(domain, stated))
  select s.domain, stated, computed, coalesce(abs(stated-computed)<=0.2,false) as ok from s left join c using (domain)""", r="stated computed")
def _(t):
    stated = t.spark.createDataFrame([("F", 0.7), ("O", 0.0), ("X", 0.5)], "domain string, stated double")
    got = M.decision_metrics(t.predictions(), ["domain"]).select("domain", F.col("accuracy").alias("computed"))
    return M.claims_check(stated, got, ["domain"], 0.2)


@query("met_26_roc_points", f"with c as ({curve_sql('d_preds', 'model')}) select model, score as threshold, fpr, tp/p_all as tpr from c",
       r="threshold fpr tpr")
def _(t):
    return M.roc_points(t.predictions(), ["model"])


@query("met_26_pr_points", f"with c as ({curve_sql('d_preds', 'model')}) select model, score as threshold, tp/p_all as recall, tp/(tp+fp) as \"precision\" from c",
       r='threshold recall "precision"')
def _(t):
    return M.pr_points(t.predictions(), ["model"])


@query("met_27_spearman_matrix", f"""with w as (select l_orderkey, sum(l_quantity) as q, max(l_discount) as d, count(*)::double as n from lineitem group by all),
  r as (select {RANK.format(by='1', c='q')} as q, {RANK.format(by='1', c='d')} as d, {RANK.format(by='1', c='n')} as n from w)
  select 'q' as a, 'd' as b, corr(q,d) as r from r union all select 'q','n',corr(q,n) from r union all select 'd','n',corr(d,n) from r""", r="r")
def _(t):
    w = t.raw("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"),
                                                    F.count(F.lit(1)).cast("double").alias("n"))
    return M.spearman_matrix(w, "l_orderkey", ["q", "d", "n"])
