"""Fitted tables and graph features."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.catalog.common import over, stable, stable_sql
from ledgerlark.catalog.views import tx_events, tx_orders
from ledgerlark.functions.rows import feature_columns
from ledgerlark.operators import encoding as E
from ledgerlark.operators import graph as G
from ledgerlark.plans import training as T
from ledgerlark.plans.levels import RARE, RARE_BELOW

NUMERIC, TEXT = ("amount", "account", "receiver"), ("os", "segment", "tx_type")


def impute_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = tx_orders(spark, sf_dir).where("split = 'train'")
    medians = E.fit_medians(train, NUMERIC).select("feature", stable(F.col("median"), 4).cast("string").alias("fill"))
    return medians.unionByName(E.fit_modes(train, TEXT).withColumnRenamed("mode", "fill")).withColumn(
        "fill", F.regexp_replace("fill", r"\.0$", ""))


IMPUTE_SQL = over("tx_orders", " union all ".join(
    [f"select '{c}' as feature, regexp_replace(({stable_sql(f'median({c})', 4)})::varchar, '\\.0$', '') as fill from tx where split = 'train'" for c in NUMERIC] +
    [f"select '{c}', (select {c} from tx where split = 'train' and {c} is not null group by 1 order by count(*) desc, 1 limit 1)" for c in TEXT]))


def common_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fit_levels(tx_orders(spark, sf_dir).where("split = 'train'"), ("receiver", "segment"), 60)


LEVELS_SQL = over("tx_orders", " union all ".join(
    f"select '{c}' as feature, {c}::varchar as level, count(*)::bigint as n from tx where split = 'train' and {c} is not null group by 2 having count(*) >= 60"
    for c in ("receiver", "segment")))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.class_weights(tx_events(spark, sf_dir).where("split = 'train'"), "label")
    return out.select(F.col("class").cast("bigint").alias("class"), "n", stable(F.col("weight")).alias("weight"))


WEIGHTS_SQL = over("tx_events", f"""
select label::bigint as class, count(*)::bigint as n, {stable_sql('(select count(*) from tx where split = $$train$$) / (2 * count(*))')} as weight
from tx where split = 'train' group by 1""")


def freq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = tx_orders(spark, sf_dir)
    out = E.frequency_encode(tx, tx.where("split = 'train'"), ("account", "receiver"))
    return out.select("tx_id", "account_freq", "receiver_freq")


FREQ_SQL = over("tx_orders", """
, a as (select account, count(*) n from tx where split = 'train' group by 1), r as (select receiver, count(*) n from tx where split = 'train' group by 1)
select tx_id, coalesce(a.n, 0)::bigint as account_freq, coalesce(r.n, 0)::bigint as receiver_freq
from tx left join a on tx.account = a.account left join r on tx.receiver = r.receiver""")


def graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.node_features(tx_orders(spark, sf_dir), "receiver", "account")
    return out.withColumn("neighbour_degree_mean", stable(F.col("neighbour_degree_mean")))


GRAPH_SQL = over("tx_orders", f"""
, e as (select receiver, account, count(*) n from tx where receiver is not null and account is not null group by 1, 2),
d as (select account, count(*) deg from e group by 1)
select receiver, count(*)::bigint as degree, sum(n)::bigint as rows, {stable_sql('avg(deg)')} as neighbour_degree_mean,
  max(deg)::bigint as neighbour_degree_max, sum(deg - 1)::bigint as two_step_paths
from e join d using (account) group by 1""")

_HUB = "case when tx_id % 3 = 0 then 1 else account end"


def shared_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receivers that share a sender with each receiver; one sender has a third of all rows."""
    tx = tx_orders(spark, sf_dir).withColumn("account", F.expr(_HUB))
    return G.shared_neighbours(tx, "receiver", "account")


SHARED_SQL = over("tx_orders", f"""
, e as (select distinct receiver, {_HUB} as account from tx where receiver is not null and account is not null)
select a.receiver, count(distinct b.receiver) filter (b.receiver <> a.receiver)::bigint as shared_neighbours
from e a join e b using (account) group by 1""")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral values of numeric columns without holes, with holes, and without any value."""
    train = tx_orders(spark, sf_dir).where("split = 'train'").select(
        "amount", "account", F.expr("case when tx_id % 5 <> 0 then amount end").alias("amount_holes"),
        F.expr("case when tx_id % 2 = 0 then account end").alias("account_holes"), F.lit(None).cast("double").alias("nothing"),
    )
    found = E.fit_fills(train, train.columns)
    return spark.createDataFrame(list(found.items()), "feature string, fill double").withColumn("fill", stable(F.col("fill"), 4))


FILLS_SQL = over("tx_orders", " union all ".join(
    f"select '{n}' as feature, {stable_sql(f'coalesce(median({e}), 0)::double', 4)} as fill from tx where split = 'train'" for n, e in (
        ("amount", "amount"), ("account", "account"), ("amount_holes", "case when tx_id % 5 <> 0 then amount end"),
        ("account_holes", "case when tx_id % 2 = 0 then account end"), ("nothing", "null::double"))))

LEVEL = """case when tx_id % 23 = 0 then null when split = 'test' and tx_id % 17 = 0 then 'never_seen' when {odd} then 'odd'
  else 'v' || cast(cast(floor(sqrt(account % 400)) as int) as {text}) end"""


def _encoded(spark: SparkSession, sf_dir: str, with_rare: bool) -> DataFrame:
    odd = "tx_id % 4001 = 7" if with_rare else "false"
    tx = tx_orders(spark, sf_dir).withColumn("level", F.expr(LEVEL.format(odd=odd, text="string"))).select("split", "level", "label")
    f = T.Features((), ("level",))
    train = tx.where("split = 'train'")
    stages = T.build_pipeline(train, f, T.Model("logreg", "logreg", T.LOGREG), T.fit_encoders(train, f)).getStages()[:2]
    out = Pipeline(stages=stages).fit(train).transform(tx)
    hot = F.array_position(vector_to_array("level__h"), 1.0) - 1
    return out.groupBy("level", F.col("level__t").alias("filled"), F.col("level__i").cast("bigint").alias("place"), F.when(hot >= 0, hot).alias("hot")).agg(F.count(F.lit(1)).alias("n"))


def encoded_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen, rare, missing and unseen values as the linear model sees them, with and without rare ones."""
    return _encoded(spark, sf_dir, True).withColumn("rare", F.lit(True)).unionByName(_encoded(spark, sf_dir, False).withColumn("rare", F.lit(False)))


def _encoded_sql(rare: bool) -> str:
    odd = "tx_id % 4001 = 7" if rare else "false"
    return over("tx_orders", f"""
, t as (select split, {LEVEL.format(odd=odd, text='varchar')} as level from tx), c as (select level, count(*) n from t where split = 'train' and level is not null group by 1),
m as (select level from c order by n desc, level limit 1),
g as (select t.split, t.level, case when c.n < {RARE_BELOW} then '{RARE}' else coalesce(t.level, (select level from m)) end as filled
      from t left join c on c.level = t.level),
p as (select filled, row_number() over (order by count(*) desc, filled) - 1 as place from g where split = 'train' group by 1)
select g.level, g.filled, coalesce(p.place, (select count(*) from p))::bigint as place, p.place::bigint as hot, count(*)::bigint as n, {str(rare).lower()} as rare
from g left join p on p.filled = g.filled group by 1, 2, 3, 4""")


ENCODED_SQL = f"select * from ({_encoded_sql(True)}) union all select * from ({_encoded_sql(False)})"


def model_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features a model may learn from, by kind, with and without the demographic ones."""
    roles = {"tx_id": "id", "ts": "time", "label": "label", "split": "split", "segment": "demographic", "device": "key", "receiver": "key", "account": "key", "subnet": "key"}
    tx = tx_orders(spark, sf_dir)
    rows = []
    for drop in (False, True):
        numeric, text = feature_columns(tx, roles, drop)
        rows += [(drop, "number", c) for c in numeric] + [(drop, "text", c) for c in text]
    listed = spark.createDataFrame(rows, "demographic_free boolean, kind string, feature string")
    filled = tx.agg(*[F.count(c).alias(c) for c in ("segment", "tx_type", "os", "amount")]).unpivot([], ["segment", "tx_type", "os", "amount"], "feature", "n")
    return listed.join(filled, "feature", "left")


COLUMNS_SQL = over("tx_orders", " union all ".join(
    f"select {d} as demographic_free, '{k}' as kind, '{c}' as feature, count({c})::bigint as n from tx"
    for d in ("false", "true") for k, c in (("number", "amount"), ("text", "tx_type"), ("text", "os"), ("text", "segment")) if not (d == "true" and c == "segment")))

QUERIES = {f.__name__: f for f in (fills, encoded_linear, model_columns, impute_stats, common_levels, class_weights, freq_encode, graph_features, shared_neighbours)}
ORACLES = {
    "fills": FILLS_SQL,
    "encoded_linear": ENCODED_SQL,
    "model_columns": COLUMNS_SQL,
    "impute_stats": IMPUTE_SQL,
    "common_levels": LEVELS_SQL,
    "shared_neighbours": SHARED_SQL,
    "class_weights": WEIGHTS_SQL.replace("$$train$$", "'train'"),
    "freq_encode": FREQ_SQL,
    "graph_features": GRAPH_SQL,
}
