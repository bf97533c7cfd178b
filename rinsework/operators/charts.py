"""Data for charts: each is one small aggregation, however large the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.operators.normalize import quoted
from rinsework.operators.quantiles import quantiles


def coerce_numeric(df: DataFrame, column: str, least: float = 0.7) -> DataFrame:
    """A text column becomes numbers if at least that share of its values are."""
    number = F.trim(F.translate(quoted(column).cast("string"), "$,", "")).try_cast("double")
    share = df.agg(F.try_divide(F.count(number), F.count(quoted(column)))).first()[0]
    return df.withColumn(column, number) if share is not None and share >= least else df


def histogram(df: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """bin, low, high, n for every bin, empty ones too. Two passes: the range, then the counts."""
    x = quoted(column).cast("double")
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    if ends["a"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (ends["b"] - ends["a"]) / bins or 1.0
    at = F.least(F.floor((x - ends["a"]) / width).cast("int"), F.lit(bins - 1))
    counted = df.filter(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (ends["a"] + F.col("bin") * width).alias("low"), (ends["a"] + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    """The most frequent values; a report, so the limit is its purpose."""
    return df.groupBy(quoted(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def mean_by(df: DataFrame, category: str, value: str) -> DataFrame:
    return df.groupBy(quoted(category).alias("category")).agg(F.avg(quoted(value)).alias("mean"), F.count(quoted(value)).alias("n"))


def heatmap(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(quoted(x).alias("x"), quoted(y).alias("y")).agg(F.count("*").alias("n"))


def box(df: DataFrame, category: str, value: str, exact: bool = True) -> DataFrame:
    """Least, quartiles, greatest. exact=False takes quantile sketches."""
    rows = df.select(quoted(category).alias("g"), quoted(value).cast("double").alias("x"))
    ends = rows.groupBy("g").agg(F.min("x").alias("low"), F.percentile_approx("x", [0.25, 0.5, 0.75], 10_000).alias("q") if not exact else F.lit(None).cast("array<double>").alias("q"), F.max("x").alias("high"))
    if exact:
        exactly = quantiles(rows).select(F.col("g").alias("b_g"), F.col("q").alias("b_q"))
        ends = ends.join(exactly, F.col("g").eqNullSafe(F.col("b_g")), "left").withColumn("q", F.col("b_q"))
    return ends.select(F.col("g").alias("category"), "low", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "high")


def line(df: DataFrame, time: str, value: str, unit: str = "month") -> DataFrame:
    return df.groupBy(F.date_trunc(unit, quoted(time)).alias("at")).agg(F.avg(quoted(value)).alias("mean"), F.count("*").alias("n"))


def scatter(df: DataFrame, x: str, y: str, most: int = 2_000) -> DataFrame:
    """About that many points: those whose hash is under a share of all, so the same in every run."""
    n = df.count()
    share = min(1 << 60, (most << 60) // max(n, 1))
    return df.filter(F.pmod(F.xxhash64(quoted(x), quoted(y)), F.lit(1 << 60)) < share).select(quoted(x).alias("x"), quoted(y).alias("y"))
