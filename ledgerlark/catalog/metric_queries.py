"""Ranking metrics on the rule score, and the tables that compare models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.catalog.common import over, scored_events, scored_sql, stable, stable_sql
from ledgerlark.catalog.views import tx_events
from ledgerlark.functions.rows import RISKY_SEGMENTS, add_bands
from ledgerlark.operators import drift as D
from ledgerlark.operators import metrics as M
from ledgerlark.operators import overlap as O
from ledgerlark.operators import splits as S
from ledgerlark.plans import reports as R
from ledgerlark.session import scratch_folder
from ledgerlark.sources import transactions as T

ORDER = ("ts", "tx_id")
BUDGET_FLOATS = ("threshold", "precision", "recall", "fraud_capture_pct")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: stable(F.col(c)) for c in names})


def _core_sql(source: str, by: str = "") -> str:
    """Definitions of both areas: pairs won through rank sums, and precision at each positive score."""
    part = f"partition by {by} " if by else ""
    head = f"{by}, " if by else ""
    tail = f"group by {by}" if by else ""
    return f"""
, r as (select *, rank() over ({part}order by score) + (count(*) over ({part + ' , ' if part else 'partition by '}score) - 1) / 2.0 as rk,
    count(*) over ({part}order by score desc range between unbounded preceding and current row) as cn,
    sum(label) over ({part}order by score desc range between unbounded preceding and current row) as cp from {source})
select {head}{stable_sql('(sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label)))')} as roc_auc,
  {stable_sql('sum(label * cp / cn) / sum(label)')} as pr_auc, {stable_sql('avg(label)')} as base_rate,
  count(*)::bigint as n, sum(label)::bigint as n_positives from r {tail}"""


def roc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.core_metrics(scored_events(spark, sf_dir), "label", "score"), "roc_auc", "pr_auc", "base_rate")


def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.core_metrics(scored_events(spark, sf_dir, 2), "label", "score", ["segment"])
    return _rounded(out, "roc_auc", "pr_auc", "base_rate")


def metrics_seen_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core metrics of test rows whose account was or was not in the training rows."""
    s = scored_events(spark, sf_dir)
    marked = O.mark_seen(s.where("split = 'test'"), s.where("split = 'train'"), "account")
    return _rounded(M.core_metrics(marked, "label", "score", ["seen"]), "roc_auc", "pr_auc", "base_rate")


SEEN_SQL = scored_sql("""
, m as (select *, account in (select account from s where split = 'train') as seen from s where split = 'test')""" + _core_sql("m", "seen"))


def _budget_sql(ks: str, days: str = "select 1 as days", source: str = "s") -> str:
    """ks: values (perspective, k); days: a query for the number of days."""
    return f"""
, o as (select *, row_number() over (order by score desc, ts, tx_id) rn from {source}),
t as (select count(*) n, sum(label) p from {source}), d as ({days}),
b as (select perspective, k, greatest(1, round_even(n * (case when perspective = 'percentile' then k
       else least(n, greatest(1, k * days)) / n end), 0))::bigint as na from (values {ks}) v(perspective, k), t, d)
select perspective, k::double as k, na as n_alerts, {stable_sql('min(score)')} as threshold,
  {stable_sql('sum(label) / na')} as precision, {stable_sql('sum(label) / greatest(any_value(p), 1)')} as recall,
  sum(label)::bigint as tp, (na - sum(label))::bigint as fp, (any_value(p) - sum(label))::bigint as fn,
  {stable_sql('sum(label) / greatest(any_value(p), 1) * 100')} as fraud_capture_pct
from b join o on o.rn <= b.na, t group by perspective, k, na"""


_SHARES = ", ".join(f"('percentile', {f}::double)" for f in M.TOP_SHARES)
_ALERTS = ", ".join(f"('alerts_per_day', {a}::double)" for a in (1, 5, 20, 50, 1000))


def topk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.at_budgets(scored_events(spark, sf_dir), "label", "score", ORDER, M.standard_budgets(with_days=False))
    return _rounded(out, *BUDGET_FLOATS)


def topk_metrics_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score with about ten different values, so every budget ends inside a run of equal scores."""
    out = M.at_budgets(scored_events(spark, sf_dir, 1), "label", "score", ORDER, M.standard_budgets(with_days=False))
    return _rounded(out, *BUDGET_FLOATS)


def alerts_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_events(spark, sf_dir).where("split = 'test'")
    days = S.split_days(s, "ts").first()["days"]
    budgets = M.standard_budgets(shares=(), per_day=(1, 5, 20, 50, 1000))
    return _rounded(M.at_budgets(s, "label", "score", ORDER, budgets, days), *BUDGET_FLOATS)


ALERTS_SQL = scored_sql(", e as (select * from s where split = 'test')" + _budget_sql(
    _ALERTS, "select greatest(1, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)) as days from e", "e"))


def top_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 rows to look at first."""
    return M.top_rows(scored_events(spark, sf_dir, 2), "score", 100, ORDER).select("tx_id", "score", "label")


TOP_SQL = scored_sql("select tx_id, score, label from s order by score desc, ts, tx_id limit 100", 2)


def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.at_fixed_thresholds(scored_events(spark, sf_dir), "label", "score", (0.1, 0.25, 0.4, 0.6, 0.99))
    return _rounded(out, "precision", "recall", "f1", "f2")


THRESHOLD_SQL = scored_sql(f"""
, c as (select t as threshold, count(*) filter (score < t and label = 0)::bigint tn, count(*) filter (score >= t and label = 0)::bigint fp,
  count(*) filter (score < t and label = 1)::bigint fn, count(*) filter (score >= t and label = 1)::bigint tp
  from s, (values (0.1::double), (0.25), (0.4), (0.6), (0.99)) v(t) group by 1)
select threshold, tn, fp, fn, tp, {stable_sql('case when tp + fp > 0 then tp / (tp + fp) else 0.0 end')} as precision,
  {stable_sql('case when tp + fn > 0 then tp / (tp + fn) else 0.0 end')} as recall,
  {stable_sql('case when 2 * tp + fn + fp > 0 then 2 * tp / (2 * tp + fn + fp) else 0.0 end')} as f1,
  {stable_sql('case when 5 * tp + 4 * fn + fp > 0 then 5 * tp / (5 * tp + 4 * fn + fp) else 0.0 end')} as f2 from c""")


# -- several models side by side --------------------------------------------------------------------

def scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and test rows under three simple scores, each with and without the segment rule."""
    s = scored_events(spark, sf_dir).where("split in ('val', 'test')")
    amount = F.least(F.col("amount") / 400, F.lit(1.0))
    noise = (F.col("tx_id") * 7919 % 1000) / 1000
    full = F.col("score")
    free = full - F.when(F.col("segment").isin(*RISKY_SEGMENTS), 0.05).otherwise(0.0)
    models = {
        ("rule_based", "full"): full, ("rule_based", "demographic_free"): free,
        ("amount", "full"): amount * 0.9 + full * 0.1, ("amount", "demographic_free"): amount * 0.9 + free * 0.1,
        ("noise", "full"): noise + full, ("noise", "demographic_free"): noise + free,
    }
    each = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(v).alias("variant"), stable(x).alias("score")) for (m, v), x in models.items()
    ]))
    rows = s.select("tx_id", "ts", "label", "split", each.alias("m"))
    return rows.select("tx_id", "ts", "label", "split", "m.*")


MODELS_SQL = scored_sql(f"""
, base as (select *, score - case when segment in ('P','Y','KP','A1') then 0.05 else 0.0 end as ns, (tx_id * 7919 % 1000) / 1000 as noise,
   least(amount / 400, 1.0) as am from s where split in ('val', 'test')),
m as (select tx_id, ts, label, split, model, variant, {stable_sql('x')} as score from (
  select *, 'rule_based' model, 'full' variant, score x from base union all select *, 'rule_based', 'demographic_free', ns from base
  union all select *, 'amount', 'full', am * 0.9 + score * 0.1 from base union all select *, 'amount', 'demographic_free', am * 0.9 + ns * 0.1 from base
  union all select *, 'noise', 'full', noise + score from base union all select *, 'noise', 'demographic_free', noise + ns from base)),
days as (select split, greatest(1, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)) as days from base group by 1),
r as (select *, row_number() over w as rn, count(*) over g as n, sum(label) over g as p,
   count(*) over (partition by model, variant, split order by score desc range between unbounded preceding and current row) as cn,
   sum(label) over (partition by model, variant, split order by score desc range between unbounded preceding and current row) as cp
   from m window w as (partition by model, variant, split order by score desc, ts, tx_id), g as (partition by model, variant, split)),
core as (select model, variant, split, sum(label * cp / cn) / sum(label) as pr_auc from r group by model, variant, split),
top as (select model, variant, split, perspective, k, na, min(score) as threshold, sum(label) / na as precision, sum(label) / any_value(p) as recall
  from (select r.*, v.perspective, v.k, greatest(1, round_even(n * (case when v.perspective = 'percentile' then v.k
          else least(n, greatest(1, v.k * days)) / n end), 0))::bigint as na
        from r join days using (split), (values {_SHARES}, {", ".join(f"('alerts_per_day', {a}::double)" for a in M.ALERTS_PER_DAY)}) v(perspective, k))
  where rn <= na group by model, variant, split, perspective, k, na)
""")


def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_models(spark, sf_dir)
    days = {r["split"]: r["days"] for r in S.split_days(rows, "ts").collect()}
    names = [(m, v, s) for m in ("rule_based", "amount", "noise") for v in ("full", "demographic_free") for s in days]
    per_group = {(m, v, s): days[s] for m, v, s in names}
    return M.metrics_table(spark, M.summary_rows(rows, "label", "score", ORDER, per_group, ["model", "variant", "split"]))


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.model_comparison(metrics_table(spark, sf_dir)).drop("roc_auc")
    return _rounded(out, *[c for c in out.columns if c not in ("model", "variant")])


COMPARISON_SQL = MODELS_SQL + f"""
select model, variant, {stable_sql('max(pr_auc)')} as pr_auc, """ + ", ".join(
    f"{stable_sql(f'max(recall) filter (k = {f})')} as recall_{n}" for n, f in R.SHARE_NAMES.items()) + f""",
  {stable_sql('max(precision) filter (k = 0.01)')} as precision_1pct
from core join top using (model, variant, split) where split = 'test' group by 1, 2"""


def ablation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.ablation(metrics_table(spark, sf_dir)), "full", "demographic_free", "delta")


ABLATION_SQL = MODELS_SQL + f"""
select model, {stable_sql('f')} as "full", {stable_sql('d')} as demographic_free, {stable_sql('d - f')} as delta,
  abs(d - f) < 0.02 as prefer_demographic_free
from (select model, max(pr_auc) filter (variant = 'full') f, max(pr_auc) filter (variant = 'demographic_free') d
      from core where split = 'test' group by 1)"""


def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.threshold_table(metrics_table(spark, sf_dir)), *BUDGET_FLOATS)


THRESHOLD_TABLE_SQL = MODELS_SQL + f"""
select model, variant, perspective, k, na as n_alerts, {stable_sql('threshold')} as threshold, {stable_sql('precision')} as precision,
  {stable_sql('recall')} as recall, {stable_sql('recall * 100')} as fraud_capture_pct from top where split = 'test'"""


def recall_by_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recall_by_alerts(metrics_table(spark, sf_dir))


RECALL_SQL = MODELS_SQL + "select model, variant, " + ", ".join(
    f"max(round(recall, 3)) filter (k = {a}) as alerts_{a}" for a in M.ALERTS_PER_DAY) + \
    " from top where split = 'test' and perspective = 'alerts_per_day' group by 1, 2"


def score_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.score_cutoffs(metrics_table(spark, sf_dir)), "HIGH", "MEDIUM")


CUTOFFS_SQL = MODELS_SQL + f"""
select b.model || '__' || b.variant as best_model, {stable_sql('max(threshold) filter (k = 0.001)')} as "HIGH",
  {stable_sql('max(threshold) filter (k = 0.01)')} as "MEDIUM"
from (select model, variant from core where split = 'val' and model <> 'rule_based' and variant = 'demographic_free' order by pr_auc desc limit 1) b
join top t on t.model = b.model and t.variant = b.variant and t.split = 'val' group by 1"""


def saved_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut-offs written as a parameter file, read back, and applied."""
    path = scratch_folder(spark, "cutoffs")
    T.save_parameters(spark, R.score_cutoffs(metrics_table(spark, sf_dir)).first().asDict(), path)
    kept = T.load_parameters(spark, path)
    banded = add_bands(scored_events(spark, sf_dir), "score", {k: kept[k] for k in ("HIGH", "MEDIUM")})
    return banded.groupBy("risk_band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("n_positives"))


SAVED_SQL = MODELS_SQL + """
, c as (select max(threshold) filter (k = 0.001) as high, max(threshold) filter (k = 0.01) as medium
  from (select model, variant from core where split = 'val' and model <> 'rule_based' and variant = 'demographic_free' order by pr_auc desc limit 1) b
  join top t on t.model = b.model and t.variant = b.variant and t.split = 'val')
select case when score >= high then 'HIGH' when score >= medium then 'MEDIUM' else 'LOW' end as risk_band,
  count(*)::bigint as n, sum(label)::bigint as n_positives from s, c group by 1"""


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full run against the run without the segment rule, by model."""
    core = R.model_comparison(metrics_table(spark, sf_dir)).select("model", "variant", "pr_auc", "recall_1pct")
    base, imp = (core.where(F.col("variant") == v).drop("variant") for v in ("full", "demographic_free"))
    out = O.compare_runs(base, imp.where("model <> 'noise'"), ("model",), ("pr_auc", "recall_1pct"))
    return _rounded(out, *[c for c in out.columns if c != "model"])


COMPARE_SQL = MODELS_SQL + """
, c as (select model, variant, max(pr_auc) pr, max(recall) filter (k = 0.01) re from core join top using (model, variant, split)
        where split = 'test' group by 1, 2)
select b.model, """ + ", ".join(
    f"{stable_sql(x)} as {n}" for x, n in (
        ("b.pr", "pr_auc_base"), ("i.pr", "pr_auc_imp"), ("i.pr - b.pr", "pr_auc_delta"),
        ("b.re", "recall_1pct_base"), ("i.re", "recall_1pct_imp"), ("i.re - b.re", "recall_1pct_delta"))) + """
from c b join c i on b.model = i.model and b.variant = 'full' and i.variant = 'demographic_free' where b.model <> 'noise'"""


# -- cut-offs, drift, ensembles ---------------------------------------------------------------------


def cost_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = M.score_curve(scored_events(spark, sf_dir, 2), "label", "score")
    cost = M.threshold_for_cost(curve, 1.0, 12.0).select(F.lit("cost").alias("rule"), "threshold", "n_alerts", F.col("cost").alias("value"))
    prec = M.threshold_for_precision(curve, 0.08).select(F.lit("precision").alias("rule"), "threshold", "n_alerts", F.col("recall").alias("value"))
    return _rounded(cost.unionByName(prec), "value")


COST_SQL = scored_sql(f"""
, g as (select score, count(*) n, sum(label) p from s group by 1),
c as (select score, sum(n) over w cn, sum(p) over w cp, sum(p) over () tp from g window w as (order by score desc))
(select 'cost' as rule, score as threshold, cn::bigint as n_alerts, {stable_sql('(cn - cp) + 12 * (tp - cp)')} as "value"
  from c order by (cn - cp) + 12 * (tp - cp), cn limit 1)
union all (select 'precision', score, cn::bigint, {stable_sql('cp / tp')} from c where cp / cn >= 0.08 order by cn desc limit 1)""", 2)


def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_events(spark, sf_dir)
    out = D.stability_index(s, "split", "train", "test", (("score", 0, 1), ("amount", 0, 300), ("subnet", 0, 53)))
    return _rounded(out, "psi")


def _psi_sql(c: str, lo: float, hi: float) -> str:
    return f"""select '{c}' as feature, {stable_sql('sum((p - q) * ln(p / q))')} as psi from (
  select greatest(count(*) filter (split = 'test') / sum(count(*) filter (split = 'test')) over (), 1e-6) p,
    greatest(count(*) filter (split = 'train') / sum(count(*) filter (split = 'train')) over (), 1e-6) q from s
  where split in ('train', 'test')
  group by case when {c} < {lo} then 0 when {c} >= {hi} then 11 else floor(({c} - {lo}) / ({hi} - {lo}) * 10) + 1 end)"""


def rate_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily label rate of each segment against its training rate, with cumulative sums and alarms."""
    out = D.rate_trend(tx_events(spark, sf_dir), "ts", "label", "segment", F.col("split") == "train")
    return _rounded(out.withColumn("period", F.date_format("period", "yyyy-MM-dd")), "rate", "expected", "up", "down")


TREND_SQL = over("tx_events", f"""
, d as (select coalesce(segment, 'missing') as "group", date_trunc('day', ts) as day, count(*) n, sum(label) hits,
    count(*) filter (split = 'train') tn, coalesce(sum(label) filter (split = 'train'), 0) tk from tx group by 1, 2),
b as (select *, sum(tk) over (partition by "group") / nullif(sum(tn) over (partition by "group"), 0) as p, avg(n) over (partition by "group") as nm from d),
t as (select *, sum(hits - n * p * 1.1) over w as u, sum(n * p * 0.9 - hits) over w as l from b window w as (partition by "group" order by day)),
m as (select *, u - least(min(u) over w, 0) as up, l - least(min(l) over w, 0) as down from t window w as (partition by "group" order by day))
select "group", strftime(day, '%Y-%m-%d') as period, n::bigint as n, hits::bigint as hits, {stable_sql('hits / n')} as rate, {stable_sql('p')} as expected,
  {stable_sql('up')} as up, {stable_sql('down')} as down,
  case when up > 3 * sqrt(nm * p * (1 - p)) then 'up' when down > 3 * sqrt(nm * p * (1 - p)) then 'down' end as alarm from m""")

PSI_SQL = scored_sql(" union all ".join(_psi_sql(*r) for r in (("score", 0.0, 1.0), ("amount", 0.0, 300.0), ("subnet", 0.0, 53.0))))


def rank_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.rank_average(scored_events(spark, sf_dir, 2), ("score", "amount"), "tx_id")
    return out.select("tx_id", stable(F.col("rank_avg")).alias("rank_avg"))


RANK_SQL = scored_sql(f"""
select tx_id, {stable_sql('(percent_rank() over (order by score) + percent_rank() over (order by amount)) / 2')} as rank_avg from s""", 2)

QUERIES = {f.__name__: f for f in (
    roc_pr, metrics_by_group, metrics_seen_unseen, topk_metrics, topk_metrics_ties, alerts_per_day, threshold_metrics, top_alerts,
    model_comparison, ablation_pivot, threshold_table, recall_by_alerts, score_cutoffs, saved_cutoffs, compare_runs, cost_threshold, psi, rate_trend,
    rank_average)}
ORACLES = {
    "roc_pr": scored_sql(_core_sql("s")),
    "metrics_by_group": scored_sql(_core_sql("s", "segment"), 2),
    "metrics_seen_unseen": SEEN_SQL,
    "topk_metrics": scored_sql(_budget_sql(_SHARES)),
    "topk_metrics_ties": scored_sql(_budget_sql(_SHARES), 1),
    "alerts_per_day": ALERTS_SQL,
    "threshold_metrics": THRESHOLD_SQL,
    "top_alerts": TOP_SQL,
    "model_comparison": COMPARISON_SQL,
    "ablation_pivot": ABLATION_SQL,
    "threshold_table": THRESHOLD_TABLE_SQL,
    "recall_by_alerts": RECALL_SQL,
    "score_cutoffs": CUTOFFS_SQL,
    "saved_cutoffs": SAVED_SQL,
    "compare_runs": COMPARE_SQL,
    "cost_threshold": COST_SQL,
    "psi": PSI_SQL,
    "rate_trend": TREND_SQL,
    "rank_average": RANK_SQL,
}
