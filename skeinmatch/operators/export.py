"""Writers of graph files for subgraph matchers. Each format is a DataFrame (line, text) with line numbers from 0; `save` writes it in order.

Graphs to write are vertices (id, label) with dense ids and edges (src, dst), each once, with an optional edge label column `label`.
Lines of vertices and edges are numbered by vertex id and by edge (src, dst), without a window over all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered


def _lines(*parts: DataFrame) -> DataFrame:
    """Parts (key, tie, text) one after another, keys from 0 and dense where tie is null."""
    return reduce(DataFrame.unionByName, parts)


def _head(df: DataFrame, *texts: str, line: int = 0) -> DataFrame:
    return df.sparkSession.createDataFrame([(line + i, t) for i, t in enumerate(texts)], "line bigint, text string")


def _degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return vertices.join(n, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def _vertex_lines(vertices: DataFrame, first: int, *columns, prefix: str = "v") -> DataFrame:
    return vertices.select((F.col("id") + first).alias("line"), F.concat_ws(" ", *([F.lit(prefix)] if prefix else []), *columns).alias("text"))


def _edge_lines(edges: DataFrame, first: int, *columns, prefix: str = "e", sep: str = " ") -> DataFrame:
    e = numbered(edges, "src", "dst", name="k")
    return e.select((F.col("k") + first).alias("line"), F.concat_ws(sep, *([F.lit(prefix)] if prefix else []), *columns).alias("text"))


def _label(edges: DataFrame) -> DataFrame:
    return edges if "label" in edges.columns else edges.withColumn("label", F.lit(0))


def rm(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n, m = vertices.count(), edges.count()
    return _lines(_head(vertices, f"t {n} {m}"), _vertex_lines(_degrees(vertices, edges), 1, "id", "label", "degree"), _edge_lines(edges, n + 1, "src", "dst"))


def daf_data(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n = vertices.count()
    return _lines(_head(vertices, f"t 1 {n}"), _vertex_lines(vertices, 1, "id", "label"), _edge_lines(edges, n + 1, "src", "dst", F.lit("0")))


def daf_query(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    near = both.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("near"))
    rows = _degrees(vertices, edges).join(near, "id", "left")
    text = F.concat_ws(" ", "id", "label", "degree", F.transform(F.coalesce("near", F.array().cast("array<bigint>")), lambda x: x.cast("string")))
    return _lines(_head(vertices, f"t 0 {vertices.count()} {2 * edges.count()}"), rows.select((F.col("id") + 1).alias("line"), text.alias("text")))


def stmatch_data(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges, and labels, one a line."""
    return _edge_lines(edges, 0, "src", "dst", prefix=""), _vertex_lines(vertices, 0, F.col("label").cast("string"), prefix="")


def stmatch_query(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n = vertices.count()
    return _lines(_head(vertices, "# t 0"), _vertex_lines(vertices, 1, "id", "label"), _edge_lines(edges, n + 1, "src", "dst", F.lit("1")))


def gsi(vertices: DataFrame, edges: DataFrame, vertex_labels: int, edge_labels: int) -> DataFrame:
    n, m = vertices.count(), edges.count()
    head = _head(vertices, "t # 0", f"{n} {m} {vertex_labels + 1} {edge_labels + 1}")
    return _lines(head, _vertex_lines(vertices, 2, "id", "label"), _edge_lines(edges, n + 2, "src", "dst"), _head(vertices, "t # -1", line=n + m + 2))


def gf_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return _edge_lines(_label(edges), 0, "src", "dst", "label", prefix="", sep=",")


def gf_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.select(F.col("id").alias("line"), F.concat_ws(",", "id", "label").alias("text"))


def gf_query(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One line for a query graph, which is small."""
    named = _label(edges).join(vertices.toDF("src", "ls"), "src").join(vertices.toDF("dst", "ld"), "dst")
    text = F.format_string("(%d:%d)-[%d]->(%d:%d)", "src", "ls", "label", "dst", "ld")
    items = F.sort_array(F.collect_list(F.struct("src", "dst", text.alias("t"))))
    return named.agg(F.array_join(F.transform(items, lambda x: x["t"]), ", ").alias("text")).select(F.lit(0).cast("bigint").alias("line"), "text")


def vf3(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Data and query graphs alike: node count, attributes, then a block for each node."""
    n = vertices.count()
    head = _head(vertices, "#Number of nodes", str(n), "", "#Node attributes")
    named = _label(edges)
    both = named.select("src", "dst", "label").union(named.select("dst", "src", "label"))
    near = both.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "label"))).alias("near"))
    none = F.array().cast("array<struct<dst:bigint,label:int>>")
    rows = vertices.join(near, "id", "left").select("id", F.coalesce(F.col("near").cast("array<struct<dst:bigint,label:int>>"), none).alias("near"))
    # A node's block begins after those of all nodes before it: a prefix sum by ranges of ids.
    text = F.concat(F.array(F.lit(""), F.concat(F.lit("#edges of node "), F.col("id")), F.size("near").cast("string")), F.transform("near", lambda x: F.concat_ws(" ", F.col("id"), x["dst"], x["label"])))
    blocks = numbered(rows.withColumn("lines", F.size("near") + 3), "id", name="begin", weight="lines").select("begin", F.posexplode(text).alias("at", "text"))
    return _lines(head, _vertex_lines(vertices, 4, "id", "label", prefix=""), blocks.select((F.col("begin") + F.col("at") + n + 4).alias("line"), "text"))


def ceci(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n = vertices.count()
    return _lines(_head(vertices, "t # 0"), _vertex_lines(vertices, 1, "id", "label"), _edge_lines(_label(edges), n + 1, "src", "dst", "label"))


def save(lines: DataFrame, path: str) -> None:
    """Text files whose names sort in the order of the lines."""
    lines.repartitionByRange("line").sortWithinPartitions("line").select("text").write.text(path)
