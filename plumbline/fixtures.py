"""References of the driver's tables, and a catalog that reads them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.tables import Table

region = Table("region", {"r_regionkey": "int", "r_name": "string"}, key=["r_regionkey"])
nation = Table("nation", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, key=["n_nationkey"])
customer = Table("customer", {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}, key=["c_custkey"])
supplier = Table("supplier", {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}, key=["s_suppkey"])
part = Table("part", {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}, key=["p_partkey"], does_not_add_up=["p_retailprice"])
orders = Table("orders", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}, key=["o_orderkey"])
lineitem = Table("lineitem", {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"})
events = Table("events", {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}, key=["event_id"])


def catalog(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
