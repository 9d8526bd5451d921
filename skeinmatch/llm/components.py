"""Connected components by minimum labels and pointer jumping, on DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, trimmed, written


#: Links that one task joins at once; more go through rounds on the cluster.
ONE_TASK = 1 << 18


def _joined(batches):
    """Rows (v, w, rank): links v-w, and vertices v with w null and a rank. Joins all of them: (v, root, component)."""
    up: dict[bytes, bytes] = {}
    ranks: dict[bytes, int | None] = {}

    def find(v):
        top = v
        while up.get(top, top) != top:
            top = up[top]
        while v != top:
            up[v], v = top, up.get(v, v)
        return top

    for batch in batches:
        for v, w, rank in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if w is None:
                ranks[v] = rank
            else:
                x, y = find(v), find(w)
                up.setdefault(x, x)
                up[y] = x
    least: dict[bytes, tuple] = {}
    for v, rank in ranks.items():
        key, top = (rank is None, rank or 0, v), find(v)
        least[top] = min(key, least.get(top, key))
    rows = [(v, least[find(v)][2], ranks[least[find(v)][2]]) for v in ranks]
    if rows:
        kinds = pa.binary(), pa.binary(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["v", "root", "component"])


def components(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """links (a, b), vertices (v, rank): for each v that has a link, root and component: the vertex of the smallest rank of
    its component (nulls last, then the smallest v) and that rank.

    Up to ONE_TASK links are joined by one task. More go through rounds: each round takes the least label among neighbours, then the label
    of the labelling vertex, so rounds grow with the logarithm of the diameter. Labels are (no rank, rank, v); equal ranks stay
    apart until linked. Lineage is cut by a written table each round. Both ways give the same. No links: an empty frame."""
    if links.count() <= ONE_TASK:
        ends = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        named = vertices.join(F.broadcast(ends), "v", "left_semi").select("v", F.lit(None).cast("binary").alias("w"), "rank")  # at most twice as many as links
        rows = links.select(F.col("a").alias("v"), F.col("b").alias("w"), F.lit(None).cast("bigint").alias("rank")).union(named)
        return written(rows.coalesce(1).mapInArrow(trimmed(_joined), "v binary, root binary, component bigint"), "labels")
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    ends = both.select(F.col("a").alias("v")).distinct()
    labels = written(ends.join(vertices, "v").select("v", F.struct(F.col("rank").isNull().alias("none"), "rank", F.col("v").alias("at")).alias("l")), "labels")
    while True:
        near = both.join(labels, both.a == labels.v).groupBy(F.col("b").alias("v")).agg(F.min("l").alias("m"))
        least = labels.join(near, "v").select("v", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        hop = labels.select(F.col("v").alias("at"), F.col("l").alias("via"))
        stepped = least.join(hop, F.col("l.at") == F.col("at")).select("v", "old", F.least("l", "via").alias("l"))
        before, stepped = labels, written(stepped, "labels")
        discard(before)
        labels = stepped.select("v", "l")
        labels.written_at = stepped.written_at
        if stepped.where("old != l").isEmpty():
            discard(both)
            return labels.select("v", F.col("l.at").alias("root"), F.col("l.rank").alias("component"))
