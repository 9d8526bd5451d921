"""Dense numbers, running sums and neighbours in a global order, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about; ranges of a frame, at most; rows of the sample from which a range's bounds are cut.
RANGE_ROWS, MOST_RANGES, SAMPLED = 1 << 20, 4096, 32
_FAN = 64


def _placed(df: DataFrame, key: str, ties: tuple[str, ...]) -> DataFrame:
    """df with _range: ascending ranges of (key, ties) of about RANGE_ROWS rows, so that one repeated key is no range of its own.

    The bounds come from a bounded sample, the rows of least hash; they are constants, so that repeated tasks place rows alike."""
    ranges = min(MOST_RANGES, -(-df.count() // RANGE_ROWS))
    order = F.struct(*(F.col(c).cast("bigint").alias(f"k{i}") for i, c in enumerate((key, *ties))))
    if ranges < 2:
        return df.withColumn("_range", F.lit(0))
    sample = sorted(tuple(r[0]) for r in df.select(order.alias("o")).orderBy(F.xxhash64("o")).limit(ranges * SAMPLED).collect())
    cuts = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)})

    def bound(c) -> Column:
        return F.struct(*(F.lit(x).cast("bigint").alias(f"k{i}") for i, x in enumerate(c)))

    # Two steps: which run of _FAN cuts, then which cut in it.
    runs = [cuts[k : k + _FAN] for k in range(0, len(cuts), _FAN)]
    run = F.greatest(F.size(F.filter(F.array(*(bound(r[0]) for r in runs)), lambda c: c <= order)), F.lit(1)) - 1
    inside = F.element_at(F.array(*(F.array(*map(bound, r)) for r in runs)), run + 1)
    return df.withColumn("_range", run * _FAN + F.size(F.filter(inside, lambda c: c <= order)))


def numbered(df: DataFrame, key: str, *ties: str, name: str = "n", weight: str | None = None) -> DataFrame:
    """df with numbers from 0 in the order of key, then ties (whole numbers); with a weight, the sum of the rows' weights before each row.

    Rows are ranked in ranges; the ranges' sizes, a bounded list, give the offsets."""
    placed = _placed(df, key, ties)
    first, total = {}, 0
    for r in sorted(placed.groupBy("_range").agg(F.sum(weight) if weight else F.count("*")).collect()):
        first[r[0]] = total
        total += r[1]
    if not first:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    offset = F.create_map(*(F.lit(x).cast("bigint") for p in first.items() for x in p))
    window = Window.partitionBy("_range").orderBy(key, *ties)
    rank = F.coalesce(F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(window) - 1
    return placed.withColumn(name, (rank + offset[F.col("_range").cast("bigint")]).cast("bigint")).drop("_range")


def with_next(df: DataFrame, column: str, key: str, *ties: str, name: str = "next") -> DataFrame:
    """df with the column's (a whole number's) value of the following row in the order of key, then ties; null in the last row.

    A range's last row gets the first value of the next range, one for each of a bounded list of ranges."""
    placed = _placed(df, key, ties)
    order = F.struct(key, *ties)
    heads = sorted(placed.groupBy("_range").agg(F.min_by(column, order)).collect())
    after = [x for (r, _), (_, v) in zip(heads, heads[1:]) for x in (F.lit(r).cast("bigint"), F.lit(v).cast("bigint"))]
    follows = F.lead(column).over(Window.partitionBy("_range").orderBy(key, *ties))
    last = F.lead(F.lit(True)).over(Window.partitionBy("_range").orderBy(key, *ties)).isNull()
    across = F.create_map(*after)[F.col("_range").cast("bigint")] if after else F.lit(None).cast("bigint")
    return placed.withColumn(name, F.when(last, across).otherwise(follows)).drop("_range")
