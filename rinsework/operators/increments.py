"""Profiles that grow with a table: what was measured of each file is stored and merged, so a table with new files is profiled by
reading these alone.

A state is a row for each file and column: counts, moments and counts of patterns, which merge exactly; a HyperLogLog sketch of distinct
values and a KLL sketch of numbers, which merge by union. Files are known by path, size and time of change; states of files
that are gone or rewritten don't count. Only the names of new files reach the driver.

Errors: moments and shares are those of a full run. With lg=12, the number of distinct values is off by 1.6 % (one
standard deviation), less for few values; with k=800, quartiles by 0.5 % of all ranks (at 99 %).
KLL sketches merge by chance, so quartiles may differ between runs within that error; all else is the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.operators.normalize import quoted
from rinsework.operators.profile import PATTERNS, _finite, is_numeric

FILE = ["file", "bytes", "changed"]
STATE = "column_name string, kind string, present long, n long, least double, most double, mean double, m2 double, matches array<long>, distinct_values binary, numbers binary"
ABOUT = [f"_metadata.{x}" for x in ("file_path", "file_size", "file_modification_time")]


def _file(df: DataFrame) -> list[Column]:
    return [F.col(a).alias(f) for a, f in zip(ABOUT, FILE, strict=True)]


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, changed of each Parquet file; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return found.select(*_file(found))


def _state(f: T.StructField, lg: int, k: int) -> Column:
    c = quoted(f.name)
    number, text = is_numeric(f.dataType), isinstance(f.dataType, T.StringType)
    own = F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
    x = _finite(f).cast("double") if number else F.lit(None).cast("double")
    parts = {
        "column_name": F.lit(f.name), "kind": F.lit(f.dataType.simpleString()), "present": F.count(c), "n": F.count(x), "least": F.min(x), "most": F.max(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x),
        "matches": F.array(*(F.count_if(F.trim(c).rlike(p)) for p in PATTERNS.values())) if text else F.lit(None).cast("array<bigint>"),
        "distinct_values": F.hll_sketch_agg(own, F.lit(lg)), "numbers": F.kll_sketch_agg_double(x, F.lit(k)) if number else F.lit(None).cast("binary"),
    }
    return F.struct(*(v.alias(name) for name, v in parts.items()))


def states(df: DataFrame, lg: int = 12, k: int = 800) -> DataFrame:
    """file, bytes, changed, n_rows and STATE, by one aggregation of one scan. df: read from files."""
    if clash := set(FILE) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} have names of the states'")
    measured = [_state(f, lg, k) for f in df.schema.fields]
    found = df.select(*_file(df), *map(quoted, df.columns)).groupBy(*FILE).agg(F.count("*").alias("n_rows"), F.array(*measured).alias("s"))
    return found.select(*FILE, "n_rows", F.inline("s"))


def merge(own: DataFrame, accuracy: int = 800, places: int = 2, least: float = 0.4) -> DataFrame:
    """column_name, n_rows, n_null, card (about; null counts as a value), min, max, mean, std, q25, q50, q75 (about), and the share of each pattern
    above `least`: of all files together. A column that a file lacks is null in it. No files: no rows."""
    total = own.select(*FILE, "n_rows").distinct().agg(F.sum("n_rows").alias("n_rows"))
    columns = own.filter("column_name is not null")
    merged = columns.groupBy("column_name").agg(
        F.sum("present").alias("present"), F.sum("n").alias("n"), F.min("least").alias("min"), F.max("most").alias("max"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"),
        F.array(*(F.sum(F.col("matches")[i]) for i in range(len(PATTERNS)))).alias("matches"), F.hll_sketch_estimate(F.hll_union_agg("distinct_values")).alias("values"),
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("numbers")), F.lit(accuracy)).alias("numbers"),
    )
    spread = columns.filter("n > 0").join(merged.select("column_name", "centre"), "column_name").groupBy("column_name").agg(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("centre")) ** 2).alias("m2"))
    all_ = merged.join(spread, "column_name", "left").join(total)
    n_null = F.col("n_rows") - F.col("present")
    r = lambda c: F.round(c, places)
    quarter = lambda q: F.when(F.col("n") > 0, r(F.kll_sketch_get_quantile_double(F.when(F.col("n") > 0, F.col("numbers")), F.lit(q))))
    share = [F.round(F.col("matches")[i] / F.when(F.col("present") > 0, F.col("present")), 4) for i in range(len(PATTERNS))]
    return all_.select(
        "column_name", "n_rows", n_null.alias("n_null"), (F.col("values") + F.when(n_null > 0, 1).otherwise(0)).alias("card"), r(F.col("min")).alias("min"), r(F.col("max")).alias("max"), r(F.col("centre")).alias("mean"),
        r(F.sqrt(F.col("m2") / F.when(F.col("n") > 1, F.col("n") - 1))).alias("std"), *(quarter(q).alias(c) for q, c in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))), *(F.when(s > least, s).alias(p) for s, p in zip(share, PATTERNS, strict=True)),
    )


class GrowingProfile:
    """The stored states of a folder of Parquet files, at a path of their own."""

    def __init__(self, spark: SparkSession, table: str, at: str):
        self.spark, self.table, self.at = spark, table.rstrip("/"), at.rstrip("/")
        self.read_files = 0  # by the last refresh

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _known(self) -> DataFrame:
        p, fs = self._hadoop(self.at)
        schema = "file string, bytes long, changed timestamp, n_rows long, " + STATE
        return self.spark.read.schema(schema).parquet(self.at) if fs.exists(p) else self.spark.createDataFrame([], schema)

    def refresh(self) -> DataFrame:
        """Measures the files that have no state yet, and returns the states of all files that the table has now. Two refreshes at once
        may both measure a file; it counts once. A file without rows has a state without a column."""
        now = files(self.spark, self.table)
        fresh = now.join(self._known().select(*FILE).distinct(), FILE, "left_anti")
        paths = sorted(r.file for r in fresh.select("file").collect())
        self.read_files = len(paths)
        if paths:
            p, fs = self._hadoop(self.table)
            reader = self.spark.read.option("mergeSchema", "true")
            df = (reader.option("basePath", self.table) if fs.getFileStatus(p).isDirectory() else reader).parquet(*paths)
            own = fresh.join(states(df), FILE, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
            own.write.mode("append").parquet(self.at)
        return self._known().join(now, FILE, "left_semi").dropDuplicates([*FILE, "column_name"])

    def profile(self, **options) -> DataFrame:
        return merge(self.refresh(), **options)
