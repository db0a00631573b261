"""Frames that the queries run on, built from whole driver tables.

people: an order with its customer, keyed by o_orderkey. mirrored: the same orders with the
customer at the other end of the key range, a stand-in for synthetic people with the same marginals.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PEOPLE = ["o_totalprice", "c_acctbal", "o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey"]
ITEMS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax", "l_quantity"]
#: A fixed mixture for account balances.
MODES = {"weights": [0.3, 0.5, 0.2], "means": [500.0, 4500.0, 9000.0], "deviations": [610.0, 1530.0, 710.0]}
#: A fixed tree over items: the root and its children.
TREE = [("l_returnflag", None), ("l_linestatus", "l_returnflag"), ("l_linenumber", "l_linestatus")]
#: A fixed undirected tree for degree counts.
EDGES = [("status", "priority"), ("status", "segment"), ("segment", "nation"), ("status", "price"), ("price", "balance")]
SAMPLE_ROWS = 800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the one that driver and executors share; below a temporary one on a local master without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="veilframe-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", *PEOPLE)


def mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    last = customers.agg(F.max("c_custkey").alias("last"))
    flipped = customers.join(F.broadcast(last), how="cross").withColumn("at", F.col("last") - F.col("c_custkey"))
    return orders.join(flipped, F.col("o_custkey") == F.col("at")).select("o_orderkey", *PEOPLE)


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """people with sentinels, blanks, full stops, unparsable numbers and nulls."""
    return people(spark, sf_dir).select(
        "o_orderkey",
        F.when(F.col("c_mktsegment") == "MACHINERY", " ? ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("segment"),
        F.concat("o_orderpriority", F.lit(". ")).alias("priority"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.floor("o_totalprice").cast("long").cast("string")).alias("price_text"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("known_segment"),
        "c_nationkey",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*ITEMS)


# Customers stand for real records, suppliers for synthetic ones, under common names.


def holders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_acctbal").alias("balance")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("string").alias("nation"), F.col("s_acctbal").alias("balance")
    )
    return customers, suppliers
