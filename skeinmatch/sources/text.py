"""Readers of graph files, edge lists and run lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import LabeledGraph


def fields(lines: DataFrame) -> DataFrame:
    """lines (value) as arrays of fields between white space, without blank lines and those that begin with #."""
    trimmed = lines.select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")).where("line != '' and not startswith(line, '#')")
    return trimmed.select(F.split("line", " ").alias("f"))


def graph_from_lines(lines: DataFrame) -> LabeledGraph:
    """Lines `t N M`, `v id label [degree]`, `e src dst`. Lines that lack a whole number where one belongs are left out."""
    f = fields(lines)
    vertices = f.where("f[0] = 'v'").select(F.expr("try_cast(get(f, 1) as bigint)").alias("id"), F.expr("try_cast(get(f, 2) as int)").alias("label")).dropna()
    edges = f.where("f[0] = 'e'").select(F.expr("try_cast(get(f, 1) as bigint)").alias("src"), F.expr("try_cast(get(f, 2) as bigint)").alias("dst")).dropna()
    return LabeledGraph.from_frames(vertices, edges)


def read_graph(spark: SparkSession, path: str) -> LabeledGraph:
    return graph_from_lines(spark.read.text(path))


def edge_list(lines: DataFrame) -> DataFrame:
    """Rows (u, v) of lines with exactly two fields; other lines are left out."""
    f = lines.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"))
    pairs = f.where("size(f) = 2").select(F.expr("try_cast(f[0] as bigint)").alias("u"), F.expr("try_cast(f[1] as bigint)").alias("v"))
    return pairs.where("u is not null and v is not null")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    return edge_list(spark.read.text(path))


def run_list(lines: DataFrame) -> DataFrame:
    """Rows (datagraph, querygraph, golden, h1, h2) of a run list; # comments and blank lines are left out."""
    kinds = ["datagraph string", "querygraph string", "golden bigint", "h1 int", "h2 int"]
    return fields(lines).where("size(f) >= 5").select(*(F.expr(f"cast(f[{k}] as {x.split()[1]})").alias(x.split()[0]) for k, x in enumerate(kinds)))
