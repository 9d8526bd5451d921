"""Graph preparation: dense ids, labels, used tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import mixed
from ..functions.numbering import numbered


def remap_dense(edges: DataFrame, position: str) -> DataFrame:
    """(old_id, new_id): ids from 0 in the order in which vertices first appear in edges (src, dst) by `position` (src before dst)."""
    ends = edges.select(F.col(position).cast("bigint").alias("at"), F.posexplode(F.array("src", "dst")).alias("side", "old_id"))
    first = ends.groupBy("old_id").agg(F.min(F.col("at") * 2 + F.col("side")).alias("first"))
    return numbered(first, "first", "old_id", name="new_id").select("old_id", "new_id")


def remap_sorted(vertices: DataFrame) -> DataFrame:
    """(old_id, new_id): ids from 0 in ascending order."""
    return numbered(vertices.select(F.col("id").alias("old_id")).distinct(), "old_id", name="new_id")


def random_labels(vertices: DataFrame, labels: int = 2, seed: int = 0) -> DataFrame:
    """(id, label): a fixed pseudo-random label for each vertex."""
    return vertices.select("id", (mixed("id", seed) % labels).cast("int").alias("label"))


def random_edge_labels(edges: DataFrame, labels: int = 1, seed: int = 0) -> DataFrame:
    """Edges with a fixed pseudo-random label, the same in both directions."""
    return edges.withColumn("label", (mixed(mixed(F.least("src", "dst"), seed) * 31 + mixed(F.greatest("src", "dst"), seed), seed) % labels).cast("int"))


def used_edges(edges: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """The edges of the label pairs that a query uses; on stored graphs a partition filter."""
    tests = [(F.col("ls") == a) & (F.col("ld") == b) for a, b in pairs]
    return edges.where(reduce(lambda x, y: x | y, tests, F.lit(False)))
