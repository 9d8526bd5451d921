"""Labelled graphs as DataFrames: normalised edges with the labels of both ends, statistics, storage by label pair."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected distinct edges (src < dst); loops and nulls are dropped."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src"))


class LabeledGraph:
    """vertices (id, label) and edges (src, dst, ls, ld), each edge in both directions once."""

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices, self.edges, self._sizes = vertices, edges, None

    @classmethod
    def from_frames(cls, vertices: DataFrame, edges: DataFrame) -> LabeledGraph:
        """Edges with an end that is no vertex are dropped; of a vertex with several labels the smallest counts. Labels join the canonical edges once; then they turn round with them."""
        vertices = vertices.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("int").alias("label")).groupBy("id").agg(F.min("label").alias("label"))
        one = canonical(edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")))
        named = one.join(vertices.toDF("src", "ls"), "src").join(vertices.toDF("dst", "ld"), "dst").select("src", "dst", "ls", "ld")
        return cls(vertices, named.union(named.select("dst", "src", "ld", "ls")).toDF("src", "dst", "ls", "ld"))

    def prepare(self) -> LabeledGraph:
        """Keep the edges, dealt by source, for the many joins of one or more matches."""
        return LabeledGraph(self.vertices, self.edges.repartition("src").persist(StorageLevel.MEMORY_AND_DISK))

    def release(self) -> None:
        """Give back what prepare keeps."""
        self.edges.unpersist()

    def pair(self, a: int, b: int) -> DataFrame:
        """Edges from label a to label b: (src, dst)."""
        return self.edges.where((F.col("ls") == a) & (F.col("ld") == b)).select("src", "dst")

    def pair_stats(self) -> DataFrame:
        return self.edges.groupBy("ls", "ld").agg(F.count("*").alias("n_edges"))

    def sizes(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(label, label) to (edges, distinct sources); one row for each pair of labels comes here."""
        if self._sizes is None:
            degrees = self.edges.groupBy("ls", "ld", "src").agg(F.count("*").alias("n"))
            rows = degrees.groupBy("ls", "ld").agg(F.sum("n").alias("n"), F.count("*").alias("sources")).collect()
            self._sizes = {(r["ls"], r["ld"]): (r["n"], r["sources"]) for r in rows}
        return self._sizes

    def histogram_offsets(self) -> DataFrame:
        """Edges of each label pair and how many edges the pairs before it have."""
        before = Window.orderBy("ls", "ld").rowsBetween(Window.unboundedPreceding, -1)
        return self.pair_stats().withColumn("first_edge", F.coalesce(F.sum("n_edges").over(before), F.lit(0)).cast("bigint"))

    def degrees(self) -> DataFrame:
        """(id, degree) of all vertices, 0 without edges."""
        n = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))

    def write(self, path: str) -> None:
        """Parquet by label pair, so that a match reads only the pairs it uses."""
        self.edges.write.partitionBy("ls", "ld").parquet(f"{path}/edges")
        self.vertices.write.parquet(f"{path}/vertices")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LabeledGraph:
        edges = spark.read.parquet(f"{path}/edges").select("src", "dst", F.col("ls").cast("int").alias("ls"), F.col("ld").cast("int").alias("ld"))
        return cls(spark.read.parquet(f"{path}/vertices"), edges)
