"""Exact quantiles and most frequent values of any number of columns or groups, without one task that holds a column.

Values become counts of distinct values, dealt by ranges of (group, value) and written. A range starts from the totals of its
group's ranges before it, which are a row for each range and group, so every row's rank is known where the row is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinsework.session import staged


def quantiles(values: DataFrame, at: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """g, q (an array, interpolated between neighbours): of each group's values that aren't null. values: g, x."""
    counts = values.filter("x is not null").groupBy("g", "x").agg(F.count("*").alias("n"))
    ranged = staged(counts.repartitionByRange("g", "x").withColumn("p", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("g", "p").agg(F.sum("n").alias("own"))
    group = Window.partitionBy("g")
    before = totals.select(F.col("g").alias("b_g"), F.col("p").alias("b_p"), (F.sum("own").over(group.orderBy("p")) - F.col("own")).alias("before"), F.sum("own").over(group).alias("total"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("g", "p").orderBy("x"))
    ranked = ranged.join(before, F.col("g").eqNullSafe(F.col("b_g")) & (F.col("p") == F.col("b_p"))).select("g", "x", "total", upto.alias("upto"))

    def value(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("x")))

    def one(q: float) -> Column:
        place = F.lit(q) * (F.col("total") - 1)
        low, high = value(F.floor(place)), value(F.ceil(place))
        share = F.max(place - F.floor(place))
        return low + (high - low) * share

    return ranked.groupBy("g").agg(F.array(*map(one, at)).alias("q"))


def modes(values: DataFrame) -> DataFrame:
    """g, mode: the most frequent value that isn't null, the first in order on a tie. values: g, x."""
    counts = values.filter("x is not null").groupBy("g", "x").agg(F.count("*").alias("n"))
    return counts.groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("m")).select("g", F.col("m.x").alias("mode"))
