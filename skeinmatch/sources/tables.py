"""Graphs derived from the sales and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import with_next
from ..operators.graph import LabeledGraph, canonical

CUSTOMER, ORDER, PART, SUPPLIER, NATION = range(5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of consecutive events by (ts, event_id), undirected and distinct."""
    events = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.col("user_id").cast("bigint").alias("user_id"))
    return canonical(with_next(events, "user_id", "at", "event_id").select(F.col("user_id").alias("src"), F.col("next").alias("dst")))


def event_graph(spark: SparkSession, sf_dir: str) -> LabeledGraph:
    edges = event_edges(spark, sf_dir)
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return LabeledGraph.from_frames(ids.withColumn("label", F.pmod("id", F.lit(5)).cast("int")), edges)


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges customer-nation, order-customer, order-part, order-supplier, part-supplier and supplier-nation; ids are key * 5 + label."""

    def vertex(column: str, label: int):
        return F.col(column).cast("bigint") * 5 + label

    def pairs(name: str, a, b) -> DataFrame:
        return table(spark, sf_dir, name).select(vertex(*a).alias("src"), vertex(*b).alias("dst"))

    found = pairs("customer", ("c_custkey", CUSTOMER), ("c_nationkey", NATION))
    for x in (
        pairs("orders", ("o_orderkey", ORDER), ("o_custkey", CUSTOMER)),
        pairs("lineitem", ("l_orderkey", ORDER), ("l_partkey", PART)),
        pairs("lineitem", ("l_orderkey", ORDER), ("l_suppkey", SUPPLIER)),
        pairs("lineitem", ("l_partkey", PART), ("l_suppkey", SUPPLIER)),
        pairs("supplier", ("s_suppkey", SUPPLIER), ("s_nationkey", NATION)),
    ):
        found = found.union(x)
    return canonical(found)


def order_graph(spark: SparkSession, sf_dir: str) -> LabeledGraph:
    """The label is in the id, so edges carry it without a join."""
    edges = order_edges(spark, sf_dir)
    label = lambda c: F.pmod(c, F.lit(5)).cast("int")
    both = edges.union(edges.select("dst", "src")).toDF("src", "dst")
    return LabeledGraph(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("label", label("id")), both.select("src", "dst", label("src").alias("ls"), label("dst").alias("ld")))
