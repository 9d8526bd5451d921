"""Sharding by vector bin packing (operator 2).

Groups of equal texts have a vector of bytes, tokens and rows. Each is placed in the shard where the dot product of its vector with the
shard's residual capacity is highest, among those with room for all three, or else for its bytes. Groups that fill a notable part of a shard are cut into pieces by a hash of the id first,
so that a group of a third of all rows spreads; all other groups stay whole.

Groups are dealt to tasks by hash and each task packs its own into all shards, the largest in any of the three first; what is left uneven in a task is less than a
small group, and tasks begin with different shards, so the whole is as even as the parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed, written

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: A group over this share of a shard's bytes or rows is cut into pieces.
WHOLE_SHARE = 1 / 4
PIECES = 64
#: Groups that one task packs, about.
TASK_GROUPS = 100_000
#: Rows of a shard that are sorted together for their slots, about.
SLOT_ROWS = 1 << 20
_KEY = ["h", "text_crc32", "size", "piece"]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, tokens (runs between single spaces), text_crc32, h (with the other two: equal texts). Null counts as empty in size and crc."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"), F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).cast("bigint").alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.xxhash64(F.col("text"), F.lit(1)), F.lit(0)).alias("h"))


def place(v: np.ndarray, order: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (row of v), placed in the given order where the dot product with the residual capacity is highest."""
    unit = v / (np.maximum(v.sum(0), 1) / shards)  # in shards' worth
    residual, out = np.ones((shards, v.shape[1])), np.empty(len(v), np.int32)
    for i in order:
        room = (residual >= unit[i]).all(1)
        if not room.any():
            room = residual[:, 0] >= unit[i, 0]
        # With room for all three nowhere, room for the bytes will do; without that, the emptiest shard in bytes takes it.
        s = int(np.argmax(np.where(room, residual @ unit[i], -np.inf))) if room.any() else int(np.argmax(residual[:, 0]))
        residual[s] -= unit[i]
        out[i] = s
    return out


def _packer(shards: int):
    def rows(batches):
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        v = np.column_stack([table.column(c).to_numpy() for c in ("bytes", "tokens", "rows")]).astype(float)
        order = np.lexsort((table.column("h").to_numpy(), -(v / np.maximum(v.sum(0), 1)).max(1)))
        out = (place(v, order, shards) + TaskContext.get().partitionId() % shards) % shards
        for b in table.select(_KEY).append_column("shard", pa.array(out, pa.int32())).to_batches(max_chunksize=50_000):
            yield b

    return rows


def packed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: shards' sums of size are near equal, and so are their tokens (pieces between single spaces) and rows but for what single groups weigh. Null and empty
    texts are groups of rows of the least size; a text longer than a shard's share makes its shard larger. Repeated rows are rows of their own;
    those that agree in id and text cannot be told apart and stay together. Groups of equal size go by their hash. No rows give none. Slots
    run from 0 in each shard, by ranges of a hash of the id, then by id and crc. Other columns are not read."""
    spark = docs.sparkSession
    rows = sized(docs.select("doc_id", "text"))
    pieces = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(PIECES)).cast("int"))
    counts = written(pieces.groupBy(*_KEY).agg(F.count("*").alias("rows"), F.max("tokens").alias("tokens")), "pieces")
    total = counts.agg(F.sum(F.col("rows") * F.col("size")).alias("bytes"), F.sum("rows").alias("rows")).first()
    whole = counts.groupBy("h", "text_crc32", "size").agg(F.sum("rows").alias("rows"), F.max("tokens").alias("tokens"))
    most = [max(1.0, (total[k] or 0) / shards * WHOLE_SHARE) for k in ("bytes", "rows")]
    is_large = (F.col("rows") * F.col("size") > most[0]) | (F.col("rows") > most[1])
    # At most 2 * shards / WHOLE_SHARE groups are that large, so their list may be broadcast.
    large = written(whole.where(is_large & (F.col("rows") > 1)).select("h", "text_crc32", "size"), "large")
    small = whole.join(F.broadcast(large), ["h", "text_crc32", "size"], "left_anti").select("h", "text_crc32", "size", F.lit(-1).alias("piece"), "rows", "tokens")
    cut = counts.join(F.broadcast(large), ["h", "text_crc32", "size"]).select(*_KEY, "rows", "tokens")
    items = small.union(cut).select(*_KEY, (F.col("rows") * F.col("size")).alias("bytes"), (F.col("rows") * F.col("tokens")).alias("tokens"), "rows")
    items = written(items, "groups")
    parts = max(1, -(-items.count() // TASK_GROUPS))
    placed = items.repartition(parts, F.xxhash64(*_KEY)).mapInArrow(trimmed(_packer(shards)), "h bigint, text_crc32 bigint, size bigint, piece int, shard int")
    is_cut = large.withColumn("is_cut", F.lit(True))
    keyed = pieces.join(F.broadcast(is_cut), ["h", "text_crc32", "size"], "left").withColumn("piece", F.when(F.col("is_cut"), F.col("piece")).otherwise(-1))
    ranges = max(1, -(-(total["rows"] or 0) // (shards * SLOT_ROWS)))
    dealt = keyed.join(placed, _KEY).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(3)), F.lit(ranges)).alias("range"))
    dealt = written(dealt, "dealt")
    sizes = {(r["shard"], r["range"]): r["n"] for r in dealt.groupBy("shard", "range").agg(F.count("*").alias("n")).collect()}  # a row for each SLOT_ROWS rows
    offsets, at = [], dict.fromkeys(range(shards), 0)
    for s, r in sorted(sizes):
        offsets.append((s, r, at[s]))
        at[s] += sizes[s, r]
    first = spark.createDataFrame(offsets, "shard int, range bigint, first bigint")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = dealt.withColumn("place", place).join(F.broadcast(first), ["shard", "range"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
