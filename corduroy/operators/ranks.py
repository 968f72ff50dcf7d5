"""Running totals, row numbers and exact quantiles over whole tables, without one task or one group that holds all of it.

Rows are written in ranges of the order; a partition's rows are summed within it, and a prefix sum over the partitions' totals (a
row each) gives every partition its start. Quantiles interpolate between neighbouring ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import steps


def running_total(df: DataFrame, order: list[str], amount: Column, name: str = "before") -> DataFrame:
    """df with the sum of ``amount`` over all rows that come earlier in ``order`` (whose values are unique)."""
    placed = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = steps(df.sparkSession)(placed, "ranges")
    sums = placed.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum(amount).over(within), F.lit(0))
    return placed.join(F.broadcast(base), "_part").withColumn(name, before).drop("_part", "_base")


def numbered(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """df with each row's place (from 0) in ``order``."""
    return running_total(df, order, F.lit(1), name)


def quantiles(df: DataFrame, value: str, qs: list[float], keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """keys and ``q``, the array of exact quantiles of ``value`` (nulls don't count) for each of qs; one row without keys.

    With ``weight`` a row stands for so many equal ones.
    """
    keys = keys or []
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).alias("_w"))
    counts = known.groupBy(*keys, "_v").agg(F.sum("_w").alias("_n"))
    at = running_total(counts, [*keys, "_v"], F.col("_n"), "_before")
    spans = at.groupBy(*keys).agg(F.min("_before").alias("_first"), F.sum("_n").alias("_total"))
    spans = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first", "_total")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    placed = at.join(spans, same, "inner") if keys else at.join(F.broadcast(spans))  # one row without keys
    below = F.col("_before") - F.col("_first")
    found = []
    for i, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            found.append(F.max(F.when((below <= rank) & (rank < below + F.col("_n")), F.col("_v"))).alias(f"_{side}{i}"))
        found.append(F.max(place - F.floor(place)).alias(f"_d{i}"))
    row = placed.groupBy(*keys).agg(*found)
    each = [F.col(f"_lo{i}") * (1 - F.col(f"_d{i}")) + F.col(f"_hi{i}") * F.col(f"_d{i}") for i in range(len(qs))]
    return row.select(*keys, F.array(*each).alias("q"))


def every_nth(df: DataFrame, order: str, most: int) -> DataFrame:
    """At most ``most`` evenly spaced rows (systematic sample): row int(j * n / most) for each j; all if there are fewer."""
    total = df.agg(F.count("*").alias("_t"))
    at = numbered(df, [order], "_i").join(F.broadcast(total))  # one row
    hit = F.floor((F.col("_i") + 1) * most / F.col("_t")) > F.floor(F.col("_i") * most / F.col("_t"))
    return at.where((F.col("_t") <= most) | hit).drop("_i", "_t")
