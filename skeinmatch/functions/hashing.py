"""Hashes of vertex ids in plain whole-number arithmetic, two-level buckets of an edge, and fixed-size Bloom filters of label pairs.

A filter is a bitmap of FILTER_BITS places for the indexing vertices of a label pair. Filters only prune: matches do not depend on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRIME = (1 << 31) - 1
#: Places of a filter: what one `bitmap_construct_agg` holds, 4 KB.
FILTER_BITS = 1 << 15


def mixed(column: Column | str, seed: int = 0) -> Column:
    """A whole number from 0 to 2**31 - 2 for a whole number: two multiplications modulo a prime with a shift between."""
    x = F.col(column) if isinstance(column, str) else column
    one = (F.pmod(x.cast("bigint"), F.lit(_PRIME)) * 48271 + seed * 7919 + 12345) % _PRIME
    return (one.bitwiseXOR(F.shiftright(one, 15)) * 69621 + seed) % _PRIME


def mixed_sql(x: str, seed: int = 0) -> str:
    """The same in SQL."""
    one = f"(((({x})::BIGINT % {_PRIME} + {_PRIME}) % {_PRIME} * 48271 + {seed * 7919 + 12345}) % {_PRIME})"
    return f"((xor({one}, {one} >> 15) * 69621 + {seed}) % {_PRIME})"


def bucket(column: Column | str, bits: int) -> Column:
    """The low bits of the vertex's hash."""
    return mixed(column).bitwiseAND(F.lit((1 << bits) - 1))


def bucketed(edges: DataFrame, h1: int, h2: int) -> DataFrame:
    """Edges (src, dst, ls, ld) with bucket1 of the indexing and bucket2 of the indexed vertex."""
    return edges.withColumn("bucket1", bucket("src", h1)).withColumn("bucket2", bucket("dst", h2))


def bucket_fill(edges: DataFrame, h1: int, h2: int, words: int = 2) -> DataFrame:
    """For each (ls, ld, bucket1): edges, used second buckets, and set bits of a Bloom filter of 64 * words bits over the indexed vertices."""
    marked = bucketed(edges, h1, h2).withColumn("_bit", mixed("dst", 1) % (64 * words))
    return marked.groupBy("ls", "ld", "bucket1").agg(F.count("*").alias("n_edges"), F.count_distinct("bucket2").alias("used_buckets"), F.count_distinct("_bit").alias("set_bits"))


def _place(column: Column | str) -> Column:
    return mixed(column, 2) % FILTER_BITS


def pair_filters(edges: DataFrame, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], bytearray]:
    """The filters of the given label pairs: 4 KB for each pair of a pattern, whatever the size of the graph."""
    rows = edges.join(F.broadcast(edges.sparkSession.createDataFrame(sorted(pairs) or [(-1, -1)], "ls int, ld int")), ["ls", "ld"], "left_semi")
    found = rows.groupBy("ls", "ld").agg(F.bitmap_construct_agg(_place("src")).alias("bits")).collect()
    return {p: bytearray(FILTER_BITS // 8) for p in pairs} | {(r["ls"], r["ld"]): r["bits"] for r in found}


def may_pass(vertex: Column | str, filters: list[bytearray]) -> Column:
    """Whether all filters hold the vertex's place: their bitwise AND, tested once. No vertex that is in all of them fails."""
    both = bytes(reduce(lambda a, b: bytes(x & y for x, y in zip(a, b)), map(bytes, filters)))
    place = _place(vertex)
    byte = F.lit(both).substr((F.floor(place / 8) + 1).cast("int"), F.lit(1))
    return F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0
