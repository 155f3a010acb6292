"""Numbers of rows in the order of an integer column, without a task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_of(rows: DataFrame, column: str, count: int | None = None) -> Column:
    """The number of the range that a row's value lies in: ranges with about as many rows each, however the values lie. Null is in the first."""
    count = count or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [k / count for k in range(1, count)]
    found = rows.agg(F.percentile_approx(column, steps, max(10000, 10 * count))).first()[0] if steps else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    below = lambda among: F.size(F.filter(among, lambda b: b <= F.col(column)))
    coarse = below(F.array(*[F.lit(g[0]) for g in groups]))
    fine = below(F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.greatest(coarse, F.lit(1))))
    return F.when(coarse > 0, (coarse - 1) * width + fine).otherwise(F.lit(0))


def number(rows: DataFrame, column: str, *more: str, name: str = "at") -> DataFrame:
    """Adds ``name``: the rows' places, from 1, in the order of column (an integer) and more. Rows in a range are counted first."""
    rows = rows.withColumn("_range", range_of(rows, column))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(column, *more))
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + within).drop("_range", "_start")
