"""Per-key results over skewed keys.

Every state used here is algebraic (counts, sums, extrema) or a set of distinct values kept as rows, so Spark's
partial HashAggregate combines on the map side in bounded, spilling hash tables and only compact states shuffle.
No task ever sees the raw rows of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per combination of keys: one scan and one shuffle of combined states. Null keys are groups of their own."""
    return rows.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def heavy_values(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(field, value, n) for values that hold at least `share` of all rows, null keys included in the total.

    Nulls are no values and are not reported; an empty table gives no rows. The scan happens once for all fields:
    the combined (key, ...) states are exploded per field and summed again.
    """
    states = pair_counts(rows, keys)
    cells = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("long").alias("value")) for k in keys])
    per = states.select(F.inline(cells), "n").groupBy("field", "value").agg(F.sum("n").alias("n"))
    # every row counts once under each field, so the sum over one field (null values too) is the size of the table
    total = per.where(F.col("field") == keys[0]).agg(F.sum("n").alias("total"))
    return per.where(F.col("value").isNotNull() & (F.col("n") >= total.scalar() * F.lit(share)))


def distinct_profile(rows: DataFrame, keys: list[str], counted: dict[str, str]) -> DataFrame:
    """keys, n, and for each column -> alias of `counted` the number of its distinct non-null values per key.

    Distinct values are counted in two algebraic steps: (key, column, value) states first (a hot key is spread over
    its values, a hot value collapses on the map side), then sums per key. Null keys are groups.
    """
    cols = list(counted)
    kind = "long" if all(_integral(rows, c) for c in cols) else "string"
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast(kind).alias("_v")) for i, c in enumerate(cols)])
    states = rows.select(*keys, F.inline(cells)).groupBy(*keys, "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    aggs = [F.sum(F.when(F.col("_c") == 0, F.col("_n"))).alias("n")]
    aggs += [F.count(F.when(F.col("_c") == i, F.col("_v"))).alias(counted[c]) for i, c in enumerate(cols)]
    return states.groupBy(*keys).agg(*aggs)


def _integral(rows: DataFrame, column: str) -> bool:
    return dict(rows.dtypes)[column] in ("bigint", "int", "smallint", "tinyint")
