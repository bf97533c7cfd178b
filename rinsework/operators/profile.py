"""Profiles of tables. All columns are measured by one aggregation; distinct values of all columns by one more, over
(column, value) pairs that are combined before they are shuffled. Only results of the size of the schema reach the driver."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.functions import constants as K
from rinsework.functions.text import name_words
from rinsework.operators.normalize import quoted
from rinsework.operators.quantiles import quantiles

PATTERNS = {"email_ratio": K.EMAIL, "phone_ratio": K.PHONE, "iso_date_ratio": K.ISO_DATE, "us_postal_ratio": K.US_POSTAL, "india_postal_ratio": K.INDIA_POSTAL}
STATS = ["min", "max", "mean", "std", "q25", "q50", "q75"]


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _finite(f: T.StructField) -> Column:
    """NaN would be the largest value and every mean: it is left out of statistics, but isn't null."""
    c = quoted(f.name)
    return F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c


def _stats(f: T.StructField, places: int, accuracy: int | None) -> Column:
    """One column's moments; quartiles from a mergeable sketch if an accuracy is given, otherwise null."""
    x, r = _finite(f), lambda c: F.round(c.cast("double"), places)
    q = F.percentile_approx(x.cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(accuracy)) if accuracy else F.array(*[F.lit(None).cast("double")] * 3)
    parts = [F.min(x), F.max(x), F.avg(x), F.stddev_samp(x), q[0], q[1], q[2]]
    return F.struct(F.lit(f.name).alias("column_name"), F.count_if(quoted(f.name).isNull()).alias("n_null"), *(r(p).alias(s) for p, s in zip(parts, STATS, strict=True)), (F.min(x) == F.max(x)).alias("zero_var"))


def numeric_profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True, accuracy: int = 10_000, places: int = 2) -> DataFrame:
    """column_name, n_null, min, max, mean, std (of a sample), quartiles, zero_var. Exact quartiles come from ranges of distinct
    values; exact=False takes mergeable quantile sketches within the same aggregation as all else."""
    fields = [f for f in df.schema.fields if is_numeric(f.dataType) and (columns is None or f.name in columns)]
    if not fields:
        return df.sparkSession.createDataFrame([], "column_name string, n_null long, min double, max double, mean double, std double, q25 double, q50 double, q75 double, zero_var boolean")
    moments = df.agg(F.array(*(_stats(f, places, None if exact else accuracy) for f in fields)).alias("rows")).select(F.inline("rows"))
    if not exact:
        return moments
    stacked = df.select(F.inline(F.array(*(F.struct(F.lit(f.name).alias("g"), _finite(f).cast("double").alias("x")) for f in fields))))
    found = quantiles(stacked).select(F.col("g").alias("column_name"), *(F.round(F.col("q")[i], places).alias(c) for i, c in enumerate(STATS[4:])))
    return moments.drop(*STATS[4:]).join(found, "column_name", "left").select("column_name", "n_null", *STATS, "zero_var")


def pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value (as a string), n: the distinct values of every column, null included."""
    chosen = df.columns if columns is None else columns
    kinds = dict(df.dtypes)
    text = lambda c: quoted(c).cast("string") if not kinds[c].startswith(("array", "map", "struct")) else F.to_json(quoted(c))
    entry = F.array(*(F.struct(F.lit(c).alias("column_name"), text(c).alias("value")) for c in chosen))
    return df.select(F.explode(entry).alias("e")).groupBy("e.column_name", "e.value").agg(F.count("*").alias("n"))


def distinct_profile(df: DataFrame, columns: list[str] | None = None, samples: int = 3) -> DataFrame:
    """column_name, card (null counts as a value), n_null, samples (the first values in order). Sample lists are bounded in
    every partial aggregate."""
    values = pairs(df, columns)
    n_null = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    counted = values.groupBy("column_name").agg(F.count("*").alias("card"), n_null.alias("n_null"))
    return counted.join(_first_values(values, samples), "column_name", "left").select("column_name", "card", "n_null", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def _first_values(values: DataFrame, samples: int) -> DataFrame:
    """Takes nulls along, after all else, and n: so this reads the very shuffle that the counts read."""
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.asc_nulls_last("value")))
    firsts = values.withColumn("place", place).filter(F.col("place") <= samples).groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("e"))
    return firsts.select("column_name", F.transform(F.filter("e", lambda x: x["value"].isNotNull()), lambda x: x["value"]).alias("samples"))


def _shares(name: str, least: float) -> Column:
    share = {k: F.round(F.avg(F.trim(quoted(name)).rlike(p).cast("double")), 4) for k, p in PATTERNS.items()}
    return F.struct(F.lit(name).alias("column_name"), *(F.when(s > least, s).alias(k) for k, s in share.items()))


def _texts(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]


def pattern_profile(df: DataFrame, columns: list[str] | None = None, least: float = 0.4) -> DataFrame:
    """column_name and the share of values that match each pattern; null where it is not above `least`. Every value is tested."""
    chosen = _texts(df, columns)
    if not chosen:
        return df.sparkSession.createDataFrame([], "column_name string, " + ", ".join(f"{k} double" for k in PATTERNS))
    return df.agg(F.array(*(_shares(c, least) for c in chosen)).alias("rows")).select(F.inline("rows"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows, n_distinct, duplicates."""
    grouped = df.groupBy(*map(quoted, df.columns)).agg(F.count("*").alias("_n"))
    return grouped.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("duplicates", F.col("n_rows") - F.col("n_distinct"))


@dataclass
class Profile:
    meta: dict[str, Any]
    columns: dict[str, dict[str, Any]]
    seconds: float = 0.0
    extra: dict[str, Any] = field(default_factory=dict)

    def as_dict(self) -> dict[str, Any]:
        return {"meta": self.meta, "columns": self.columns}

    def to_json(self) -> str:
        return json.dumps(self.as_dict(), separators=(",", ":"), default=str)

    @property
    def tokens(self) -> int:
        """About four characters each."""
        return len(self.to_json()) // 4


def _type_name(kind: T.DataType) -> str:
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "Float"
    if is_numeric(kind):
        return "Int"
    return {"string": "String", "boolean": "Boolean", "date": "Date"}.get(kind.simpleString(), "Datetime" if kind.simpleString().startswith("timestamp") else kind.simpleString().split("<")[0].title())


def looks_like_identifier(column: str) -> bool:
    return bool(name_words(column) & set(K.IDENTIFIER_WORDS))


def profile(df: DataFrame, exact: bool = False, masked: bool = True) -> Profile:
    """The profile on the driver: one row for each column. Two jobs at once: all counts, moments, quartiles and patterns by one
    aggregation, and all distinct values by another; then repeated rows. exact: quartiles by ranges of values, not by sketches.
    masked: samples with personal data replaced by its class."""
    from rinsework.functions.pii import mask_class

    began = time.time()
    fields = [f for f in df.schema.fields if is_numeric(f.dataType)]
    rows = lambda made, empty: F.array(*made) if made else F.lit(None).cast(empty)
    wide = df.agg(F.count("*").alias("n"), rows([_stats(f, 2, 10_000) for f in fields], "array<struct<column_name:string>>").alias("numbers"), rows([_shares(c, 0.4) for c in _texts(df)], "array<struct<column_name:string>>").alias("patterns"))
    values = distinct_profile(df)
    if masked:
        values = values.withColumn("samples", F.transform("samples", mask_class))
    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(inheritable_thread_target(df.sparkSession)(x.collect)) for x in (wide, values)]
        whole, found = jobs[0].result()[0], jobs[1].result()
    n, distinct = whole["n"], {r["column_name"]: r for r in found}
    numbers = {r["column_name"]: r for r in (numeric_profile(df).collect() if exact else whole["numbers"] or [])}
    patterns = {r["column_name"]: r for r in whole["patterns"] or []}
    columns: dict[str, dict[str, Any]] = {}
    for f in df.schema.fields:
        d = distinct.get(f.name)
        own: dict[str, Any] = {"type": _type_name(f.dataType), "null_pct": round(100 * (d["n_null"] if d else 0) / max(n, 1), 2), "card": d["card"] if d else 0}
        if f.name in numbers:
            own |= {k: numbers[f.name][k] for k in STATS if numbers[f.name][k] is not None}
            if numbers[f.name]["zero_var"]:
                own["zero_var"] = True
        else:
            own["samples"] = [str(x)[:40] for x in d["samples"]] if d else []
            own |= {k: patterns[f.name][k] for k in PATTERNS if f.name in patterns and patterns[f.name][k] is not None}
        columns[f.name] = own
    identifiers = [c for c, x in columns.items() if looks_like_identifier(c) or (n and x["card"] == n)]
    space = reduce(lambda a, x: min(a * max(1, min(x["card"], 10_000)), 10**9), columns.values(), 1)
    event_log = not identifiers and space < n and n > 500
    duplicates = 0 if event_log or not columns else duplicate_rows(df).first()["duplicates"]
    meta = {"rows": n, "cols": len(df.columns), "duplicates": duplicates, "dup_pct": round(100 * duplicates / max(n, 1), 2), "identifiers": identifiers, "state_space": space, "event_log": event_log}
    return Profile(meta, columns, time.time() - began)


def anomalies(found: Profile) -> list[str]:
    """Columns with nulls, without variance, or with ages that can't be."""
    odd = lambda c, x: x["null_pct"] > 0 or x.get("zero_var") or "age" in name_words(c) and "min" in x and (x["min"] < 0 or x["max"] > 120)
    return [c for c, x in found.columns.items() if odd(c, x)]


def quality_score(found: Profile) -> int:
    """0 to 100: half a point off for each per cent of nulls, and of duplicates unless the table is an event log."""
    nulls = sum(x["null_pct"] for x in found.columns.values()) / max(1, len(found.columns))
    off = 0.5 * nulls + (0 if found.meta["event_log"] else 0.5 * found.meta["dup_pct"])
    return int(max(0, min(100, 100 - off)))
