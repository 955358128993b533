"""Queries that fit and evaluate models on feature tables derived from the driver's tables."""

from pyspark.sql import functions as F

from ..functions.feature_sets import ALL_BEHAVIOUR, BEHAVIOUR_SETS
from ..operators import models as O
from ..operators import scoring as A
from ..operators.manyfits import out_of_fold_many
from ..operators.metrics import spearman_matrix
from ..operators.sampling import best_model
from .corpus_queries import vectors
from .event_queries import features as behaviour
from .metrics_queries import RANK
from .registry import query
from .tables import VIEWS

COLS = ["signal", "qty", "tax", "sparse"]

VIEWS["d_table"] = """select p.call_id, p.y, p.split, p.domain, p.condition, p.score as signal, q.qty, q.tax, case when p.call_id % 4 > 0 then p.score + p.call_id % 3 end as sparse
  from d_preds p left join (select l_orderkey as call_id, sum(l_quantity) as qty, max(l_tax) as tax from lineitem group by l_orderkey) q using (call_id)"""


def table(t):
    q = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.sum("l_quantity").alias("qty"), F.max("l_tax").alias("tax"))
    p = t.predictions().select("call_id", "y", "split", "domain", "condition", F.col("score").alias("signal"))
    return p.join(q, "call_id", "left").withColumn("sparse", F.when(F.col("call_id") % 4 > 0, F.col("signal") + F.col("call_id") % 3))


def chunks(t):
    e = t.chunk_embeddings()
    v = F.when(F.col("call_id") % 4 == 0, "val").otherwise("train")
    return e.withColumns({"split": v, "y": (F.col("call_id") % 2).cast("int")})


def behaviour_table(t):
    return behaviour(t).join(t.calls().select("call_id", "y", "split"), "call_id")


FROZEN = O.LinearModel(COLS, [0.1, 60.0, 0.04, 0.5], [1, 3], [0.1, 80.0, 0.05, 1.0, 0.1, 0.25], [1.0, 40.0, 0.02, 1.5, 0.3, 0.4],
                       [0.9, -0.1, 0.05, 0.2, -0.3, 0.1], -0.05, 1.2, 0.1)


def term(name, i, missing=False):
    raw = f"({name} is null)::int" if missing else f"coalesce({name}, {FROZEN.impute[COLS.index(name)]})"
    j = len(COLS) + FROZEN.flagged.index(COLS.index(name)) if missing else i
    return f"{FROZEN.coef[j]}*least(greatest(({raw} - {FROZEN.mean[j]})/{FROZEN.scale[j]},-6),6)"


LOGIT = "1.2*(-0.05 + " + " + ".join([term(n, i) for i, n in enumerate(COLS)] + [term("qty", 0, True), term("sparse", 0, True)]) + ") + 0.1"


def term_sql(name, impute, flag):
    x = f"({name} is null)::int" if flag else f"coalesce({name}, {impute})"
    gaps = f" having count({name}) < count(*)" if flag else ""
    return f"select '{name}{' missing' if flag else ''}' as term, avg({x}) as mean, stddev_pop({x}) as scale, 0.0::double as slope from d_table where split='train'{gaps}"


@query("mod_01_optimum", "with m as (select median(signal) as signal, median(qty) as qty, median(tax) as tax, median(sparse) as sparse from d_table where split='train') select * from ("
       + " union all ".join([term_sql(c, f"(select {c} from m)", False) for c in COLS] + [term_sql(c, None, True) for c in COLS]) + ") union all select 'intercept', 0, 1, 0", r="mean scale slope")
def _(t):
    """Where the fit ends the slope of the regularised loss is zero in every direction, computed anew from columns."""
    d = table(t).where("split = 'train'")
    m = O.fit_logistic(d, COLS)
    n = {r.y: r["count"] for r in d.groupBy("y").count().collect()}
    w = F.when(F.col("y") == 1, sum(n.values()) / (2 * n[1])).otherwise(sum(n.values()) / (2 * n[0]))
    terms = d.select(m.terms().alias("z"), (w * (m.probability() - F.col("y"))).alias("e"))
    names = [*m.names, *[f"{m.names[i]} missing" for i in m.flagged], "intercept"]
    sums = terms.agg(*[F.sum(F.col("e") * F.get("z", F.lit(i))).alias(f"s{i}") for i in range(len(m.coef))], F.sum("e").alias("s")).first()
    slope = [float(sums[f"s{i}"] + c) for i, c in enumerate(m.coef)] + [float(sums["s"])]
    return t.spark.createDataFrame([(k, float(a), float(b), abs(round(x, 6))) for k, a, b, x in zip(names, [*m.mean, 0.0], [*m.scale, 1.0], slope)], "term string, mean double, scale double, slope double")


@query("mod_01_logistic")
def _(t):
    d = table(t)
    m = O.fit_logistic(d.where("split = 'train'"), COLS)
    return O.scored_metrics(d, m.logit(), "logistic")


@query("mod_02_preprocess", """select feature, known, distinct_, median from (
  select 'signal' as feature, count(signal) as known, count(distinct signal) as distinct_, median(signal) as median from d_table where split='train'
  union all select 'qty', count(qty), count(distinct qty), median(qty) from d_table where split='train' union all select 'tax', count(tax), count(distinct tax), median(tax) from d_table where split='train'
  union all select 'sparse', count(sparse), count(distinct sparse), median(sparse) from d_table where split='train')""", r="median")
def _(t):
    s = O.training_stats(table(t).where("split = 'train'"), COLS)
    return t.spark.createDataFrame([(n, int(v["known"]), int(v["distinct"]), float(v["median"])) for n, v in s.items()], "feature string, known bigint, distinct_ bigint, median double")


@query("mod_03_linear_score", f"with s as (select call_id, {LOGIT} as z from d_table) select call_id, 1/(1+exp(-least(greatest(z,-40),40))) as p from s", r="p")
def _(t):
    return table(t).select("call_id", FROZEN.probability().alias("p"))


@query("mod_04_behaviour_ladder")
def _(t):
    return O.behaviour_ladder(behaviour_table(t), BEHAVIOUR_SETS)


@query("mod_05_shortcut_models")
def _(t):
    return O.shortcut_models(table(t), {"duration": ["tax"], "all": ["signal", "qty"]}, rounds=10)


@query("mod_06_tree_control")
def _(t):
    d = table(t)
    return O.scored_metrics(O.tree_scores(d.where("split = 'train'"), d, COLS), F.col("score"), "trees")


@query("mod_07_prior", "with p as (select avg(y) as p from d_table where split='train') select split, count(*) as n, ln(any_value(p)/(1-any_value(p))) as score from d_table, p group by split", r="score")
def _(t):
    d = table(t)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max(O.prior_score(d.where("split = 'train'"))).alias("score"))


@query("mod_08_neural_head")
def _(t):
    c = chunks(t)
    return O.call_metrics(O.neural_head_scores(c.where("split = 'train'"), c), "neural")


@query("mod_09_layer_probe")
def _(t):
    c = chunks(t)
    both = c.unionByName(c.withColumns({"layer": F.lit(1), "emb": F.transform("emb", lambda x: x * x)}))
    return O.best_layer(O.layer_probe(both, [0, 1]))


def newton_sql(groups: str, rows: str, keys: str = "") -> str:
    """Newton's method for ``sigmoid(a s + b)`` per group, as SQL over ``rows(keys, s, pos, n)`` and ``groups(keys)``."""
    k, on = (f"{keys}, ", f" using ({keys})") if keys else ("", "")
    join = f"p join c{on}" if keys else "p, c"
    return f"""with recursive c as ({rows}), p as (select {k}0 as i, 0.0::double as a, 0.0::double as b from {groups}
  union all
  select {k}i+1, a - (hbb*ga - hab*gb)/(haa*hbb - hab*hab), b - (haa*gb - hab*ga)/(haa*hbb - hab*hab) from (
    select {k}i, any_value(a) as a, any_value(b) as b, sum((n*q-pos)*s) as ga, sum(n*q-pos) as gb, sum(n*q*(1-q)*s*s) as haa, sum(n*q*(1-q)*s) as hab, sum(n*q*(1-q)) as hbb
    from (select {k}i, a, b, s, pos, n, 1/(1+exp(-(a*s+b))) as q from {join}) where i < 25 group by all)),
  f as (select * from p where i = 25)"""


@query("mod_10_platt", newton_sql("(select 1)", "select score as s, sum(y)::double as pos, count(*)::double as n from d_preds group by score")
       + " select call_id, 1/(1+exp(-least(greatest(a*score+b,-40),40))) as p from d_preds, f", r="p")
def _(t):
    cal = O.fit_platt(t.predictions())
    return t.predictions().select("call_id", O.calibrate(F.col("score"), cal["a"], cal["b"]).alias("p"))


TEMPERATURES = """with g as (select exp(ln(0.05)+i*(ln(50)-ln(0.05))/399) as t from range(400) r(i)), s as (select score, sum(y) as pos, count(*) as n from d_preds group by score),
  q as (select t, pos, n, least(greatest(1/(1+exp(-least(greatest(score/t,-40),40))),1e-7),1-1e-7) as p from s, g),
  l as (select t, sum(-(pos*ln(p)+(n-pos)*ln(1-p)))/sum(n) as log_loss from q group by t)"""


@query("mod_11_temperature", f"{TEMPERATURES} select t, log_loss from l", r="t log_loss")
def _(t):
    return O.temperature_losses(t.predictions())


@query("mod_11_fit_temperature", f"{TEMPERATURES}, b as (select arg_min(t, log_loss) as t from l) select call_id, 1/(1+exp(-least(greatest(score*(1/t),-40),40))) as p from d_preds, b", r="p")
def _(t):
    cal = O.fit_temperature(t.predictions())
    return t.predictions().select("call_id", O.calibrate(F.col("score"), cal["a"]).alias("p"))


@query("mod_12_out_of_fold_calibration", newton_sql("(select unnest(range(5)) as fold)", """select o.fold, score as s, sum(y)::double as pos, count(*)::double as n
  from d_preds, (select unnest(range(5)) as fold) o where call_id % 5 <> o.fold group by all""", "fold")
       + " select call_id, fold::int as fold, 1/(1+exp(-(a*score+b))) as p from d_preds join f on f.fold = call_id % 5", r="p")
def _(t):
    d = t.predictions().withColumn("fold", (F.col("call_id") % 5).cast("int"))
    return O.calibrated_out_of_fold(d, O.fit_platt).select("call_id", "fold", "p")


@query("mod_12_choose_calibration")
def _(t):
    cal = O.choose_calibration(t.predictions(), grouped=True)
    return t.spark.createDataFrame([(cal["method"], float(cal["a"]), float(cal["b"]), float(cal["cv_log_loss"]))], "method string, a double, b double, cv_log_loss double")


@query("mod_01_served_recipe")
def _(t):
    d = table(t)
    m = O.fit_behaviour(d.where("split = 'train'"), COLS)
    return O.scored_metrics(d, m.logit(), "served")


@query("mod_13_repeated_cv")
def _(t):
    return O.cv_summary(O.repeated_cv(table(t), COLS))


@query("mod_14_holdout")
def _(t):
    d = table(t)
    held = O.scored_metrics(d.where("split = 'val'"), O.fit_logistic(d.where("split = 'train'"), COLS).logit(), "train_fit")
    oof = out_of_fold_many(d, {"all": COLS}, 5, [5])
    return held.unionByName(O.scored_metrics(oof.where("split = 'val'"), F.col("score"), "out_of_fold"))


@query("mod_15_family_ablation")
def _(t):
    return O.family_ablation(table(t), COLS, {"no_signal": ["signal", "sparse"], "no_items": ["qty", "tax"]})


@query("mod_16_leave_one_feature_out")
def _(t):
    return O.leave_one_out_auc(table(t), COLS)


@query("mod_17_permutation_control")
def _(t):
    return O.permutation_control(table(t), COLS)


@query("mod_17_permuted_labels", "select split, count(*) as n, sum(y)::bigint as positives from d_table where split='train' group by split")
def _(t):
    p = O.permuted_labels(table(t).where("split = 'train'"), 5)
    return p.groupBy("split").agg(F.count_distinct("call_id").alias("n"), F.sum("y").alias("positives"))


@query("mod_18_cluster_sweep")
def _(t):
    return O.cluster_sweep(vectors(t), max_k=8)[0]


@query("mod_20_leave_one_cluster_out")
def _(t):
    c = chunks(t)
    clusters = O.cluster_sweep(vectors(t), max_k=6)[0]
    return O.recall_of_unseen(O.leave_one_cluster_out(c, "emb", clusters, 1))


@query("mod_21_tiny_training")
def _(t):
    return O.tiny_training(table(t), COLS)


@query("mod_22_domain_class_weight", "select domain, y, sum(w) as total from (select domain, y, 1.0::double/count(*) over (partition by domain, y) as w from d_table) group by all", r="total")
def _(t):
    return O.domain_class_weight(table(t)).groupBy("domain", "y").agg(F.sum("weight").alias("total"))


@query("mod_23_training_variants")
def _(t):
    d = table(t)
    m = O.training_variants(d.where("split = 'train'"), d.where("split = 'val'"), ["signal", "qty"], original="O")
    return best_model(m.withColumnRenamed("experiment", "model"))


@query("mod_24_augmented_training")
def _(t):
    d = table(t)
    tr = d.where("split = 'train'")
    return O.augmented_training(tr.where("condition = '5-LOW'"), tr.where("condition in ('1-URGENT', '2-HIGH')"), d.where("split = 'val'"), ["signal", "qty"])


@query("mod_25_nuisance_diagnostics")
def _(t):
    return O.nuisance_diagnostics(table(t), ["sparse", "qty"], ["tax"])


@query("mod_26_frozen_evaluation", f"""with s as (select split, y, {LOGIT} as z from d_table) select split, count(*) as n, avg(((z>=0)=(y=1))::int) as accuracy,
  avg(pow(least(greatest(1/(1+exp(-z)),1e-6),1-1e-6)-y,2)) as brier from s group by split""", r="accuracy brier")
def _(t):
    return O.frozen_evaluation(table(t), FROZEN).select("split", "n", "accuracy", "brier")


@query("fus_11_meta_model")
def _(t):
    from ..operators.fusion import meta_features
    from ..sources.logs import telemetry_view
    keys = ["acoustic_score", "behavioral_score", "semantic_score"]
    d = meta_features(telemetry_view(t.layer_scores()), keys).join(t.order_calls(), "call_id")
    m = O.fit_logistic(d.where("split = 'train'"), keys)
    return d.select("call_id", m.probability().alias("p"))


NAMES = ", ".join(map(repr, ALL_BEHAVIOUR))


@query("met_27_behaviour_matrix", f"""with u as (unpivot (select call_id, {', '.join(f'{c}::double as {c}' for c in ALL_BEHAVIOUR)} from d_features) on {', '.join(ALL_BEHAVIOUR)} into name metric value val),
  r as (select call_id, metric, list_position([{NAMES}], metric) as i, {RANK.format(by='metric', c='round(val, 9)')} as k from u),
  p as (select a.metric as a, b.metric as b, corr(a.k, b.k) as r from r a join r b on a.call_id=b.call_id and a.i<b.i group by all),
  c as (select unnest([{NAMES}]) as name, unnest(range({len(ALL_BEHAVIOUR)})) as i)
  select x.name as a, z.name as b, case when isfinite(r) then r end as r from c x join c z on x.i<z.i left join p on p.a=x.name and p.b=z.name""", r="r")
def _(t):
    f = behaviour(t).select("call_id", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in ALL_BEHAVIOUR])
    return spearman_matrix(f, "call_id", ALL_BEHAVIOUR)
