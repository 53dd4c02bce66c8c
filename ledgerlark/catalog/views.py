"""Two transaction views over the driver tables; the same text runs on Spark and on other SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.operators.history import Entity, Roles, label_free_entities

TX_EVENTS = """
select event_id tx_id, cast(ts as timestamp) ts, user_id device,
  cast(regexp_extract(props,'([0-9]+)',1) as int) receiver,
  event_id % 61 sender, (event_id*7) % 9001 account,
  (user_id + cast(regexp_extract(props,'([0-9]+)',1) as int)) % 53 subnet,
  event_type tx_type, value amount,
  case when event_id % 37 = 0 then 1 else 0 end l1h,
  case when event_id % 19 = 0 then 1 else 0 end l8h,
  case when event_id % 5 < 3 then 'Android' else 'IOS' end os,
  value <> floor(value) is_fractional,
  case event_id % 9 when 0 then 'C' when 1 then 'B' when 2 then 'D' when 3 then 'A2' when 4 then 'P'
    when 5 then 'A1' when 6 then 'KP' when 7 then 'T' else 'Y' end segment,
  case when event_id % 50 = 0 then 'full' when event_id % 97 = 0 then 'half' end day_type,
  case when event_type='error' and value > 50 then 1 else 0 end label,
  case when ts < timestamp '2024-01-21 00:00:00' then 'train'
       when ts < timestamp '2024-01-26 00:00:00' then 'val' else 'test' end split
from events
"""

TX_ORDERS = """
select o.o_orderkey tx_id, cast(o.o_orderdate as timestamp) ts, o.o_custkey account,
  o.o_custkey % 211 device, l.receiver receiver, c.c_nationkey subnet, c.c_mktsegment segment,
  o.o_orderpriority tx_type, o.o_orderstatus os, o.o_totalprice amount,
  case when coalesce(l.returned,0)=1 and o.o_totalprice > 350000 then 1 else 0 end label,
  case when o.o_orderdate < timestamp '1999-01-01 00:00:00' then 'train'
       when o.o_orderdate < timestamp '2000-01-01 00:00:00' then 'val' else 'test' end split
from orders o join customer c on o.o_custkey=c.c_custkey
left join (select l_orderkey, min(l_suppkey) receiver,
                  max(case when l_returnflag='R' then 1 else 0 end) returned
           from lineitem group by l_orderkey) l on l.l_orderkey=o.o_orderkey
"""

ROLES = Roles(id="tx_id", ts="ts", amount="amount", label="label")
ENTITIES = label_free_entities("device", "receiver", "subnet", "account", "sender")
ORDER_ENTITIES = (
    Entity("device", "device", True, (1, 7, 30), (("accounts", "account"),), True, True, True),
    Entity("receiver", "receiver", True, (7, 30), (("devices", "device"),), True, True, True),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, text: str, names: tuple[str, ...]) -> DataFrame:
    # the views are defined in UTC whatever the session default is
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TX_EVENTS, ("events",))


def tx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TX_ORDERS, ("orders", "customer", "lineitem"))
