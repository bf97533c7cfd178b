"""Reading and writing tables: the format is sniffed, text formats pass the shield, and every format is cleaned alike."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.functions import constants as K
from rinsework.operators.normalize import normalize, quoted, unwrap
from rinsework.session import prepare, staged
from rinsework.sources import shield as S

SUFFIXES = {".parquet": "parquet", ".pq": "parquet", ".ndjson": "ndjson", ".jsonl": "ndjson", ".tsv": "tsv", ".tab": "tsv", ".csv": "csv", ".json": "json"}
WHOLE, DECIMAL, TRUTH = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", r"(?i)^\s*(true|false)\s*$"
LONG = r"^\s*[+-]?\d{16,}\s*$"


class UnsupportedFormat(ValueError):
    """Neither the name nor the content tells a format that can be read here."""


@dataclass
class Dataset:
    df: DataFrame
    format: str
    path: str
    shield: S.ShieldResult | None = None


def _two_objects(sample: bytes) -> bool:
    lines = [x.strip() for x in sample.decode("utf-8", "replace").replace("\x00", "").splitlines() if x.strip()]

    def is_object(x: str) -> bool:
        try:
            return isinstance(json.loads(x), (dict, list))
        except ValueError:
            return False

    return len(lines) >= 2 and is_object(lines[0]) and is_object(lines[1])


def sniff_format(sample: bytes, name: str = "") -> str:
    """By the name's suffix, then by content; CSV if nothing speaks. A .json of one object a line is NDJSON."""
    suffix = next((f for s, f in SUFFIXES.items() if name.lower().rstrip("/").endswith(s)), None)
    head = sample.lstrip(b"\xef\xbb\xbf \t\r\n\x00")
    if suffix == "json" or suffix is None and head[:1] in (b"{", b"["):
        return "ndjson" if _two_objects(sample) else "json"
    return suffix or ("parquet" if sample[:4] == b"PAR1" else "csv")


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in (x.strip() or "col" for x in names):
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def _kinds(cells: DataFrame) -> list[T.DataType]:
    """The narrowest type that holds every value of each column: one aggregation over all rows. Null tokens fit any type."""
    fits: list[tuple[T.DataType, str, str]] = [(T.IntegerType(), "int", WHOLE), (T.LongType(), "long", WHOLE), (T.DoubleType(), "double", DECIMAL), (T.BooleanType(), "boolean", TRUTH)]
    tests = []
    for name in cells.columns:
        value = quoted(name)
        known = value.isNotNull() & ~F.trim(value).isin(*K.NULL_TOKENS)
        exact = ~value.rlike(LONG)  # a double would round it
        odd = [F.count_if(known & ~(value.rlike(form) & value.try_cast(kind).isNotNull() & (exact if kind == "double" else F.lit(True)))) for _, kind, form in fits]
        tests.append(F.array(F.count_if(known), *odd))
    row = cells.agg(*(t.alias(f"c{i}") for i, t in enumerate(tests))).first()
    return [next((kind for (kind, _, _), bad in zip(fits, r[1:], strict=True) if r[0] and not bad), T.StringType()) for r in row]


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, most: int = S.MAX_BYTES, quotes: bool = True) -> tuple[DataFrame, S.ShieldResult]:
    """Lines that pass the shield, parsed by from_csv. A column's type holds all of its values, the last as the first; what has no
    common type stays text. The first line of a file is left out if it is the header; later lines like it are rows."""
    checked = S.shield(spark, path, most, delimiter, quotes)
    d, header = checked.facts.delimiter, checked.facts.header
    import csv

    if not header:
        return spark.createDataFrame([], T.StructType([])), checked
    names = _unique(next(csv.reader([header], delimiter=d)))
    options = {"sep": d, "nullValue": "", "mode": "PERMISSIVE", "escape": '"'}
    parsed = lambda kinds: checked.body.select(F.from_csv("value", _ddl(T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])), options).alias("r")).select("r.*")
    cells = parsed([T.StringType()] * len(names))
    kinds = _kinds(cells)
    return cells.select(*(quoted(n) if isinstance(k, T.StringType) else F.when(~F.trim(quoted(n)).isin(*K.NULL_TOKENS), F.trim(quoted(n)).try_cast(k)).alias(n) for n, k in zip(names, kinds, strict=True))), checked


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def read_ndjson(spark: SparkSession, path: str, most: int = S.MAX_BYTES) -> tuple[DataFrame, S.ShieldResult]:
    """An object, or a list of objects, on each line; other lines are quarantined."""
    checked = S.shield(spark, path, most, as_json=True)
    return _parsed(spark, checked.valid.select(F.explode(F.when(F.startswith("value", F.lit("[")), F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).otherwise(F.array("value"))).alias("value"))), checked


def _parsed(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Lines of JSON as columns. Spark infers the schema from every line, where the lines are; values of several types become text."""
    jvm = spark.sparkContext._jvm
    as_strings = getattr(lines.select("value")._jdf, "as")(jvm.org.apache.spark.sql.Encoders.STRING())
    schema = T.StructType.fromJson(json.loads(spark._jsparkSession.read().json(as_strings).schema().json()))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*") if schema.fields else spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, most: int = S.MAX_BYTES) -> DataFrame:
    """JSON documents, each read whole by one task, repaired where they are damaged, and unwrapped to their records."""
    S.check_quota(spark, path, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from rinsework.sources.json_repair import lines_of

        for b in batches:
            for text in b["value"]:
                yield pd.DataFrame({"value": list(lines_of(text))})

    prepare(spark)
    return _parsed(spark, staged(spark.read.text(path, wholetext=True).mapInPandas(run, "value string"), "records"))


def read_records(spark: SparkSession, rows: list[dict[str, Any]]) -> DataFrame:
    """Records that came with a request."""
    if not rows:
        raise ValueError("no records")
    return _parsed(spark, spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))


def load(spark: SparkSession, path: str, format: str | None = None, most: int = S.MAX_BYTES, clean: bool = True) -> Dataset:
    kind = format or sniff_format(b"" if path.lower().rstrip("/").endswith((".parquet", ".pq")) else S.first_bytes(spark, path, 4096), path)
    checked = None
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("csv", "tsv"):
        df, checked = read_delimited(spark, path, "\t" if kind == "tsv" else None, most)
    elif kind == "ndjson":
        df, checked = read_ndjson(spark, path, most)
    elif kind == "json":
        df = read_json(spark, path, most)
    elif kind == "orc":
        df = spark.read.orc(path)
    else:
        raise UnsupportedFormat(kind)
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if clean and len(arrays) == 1 and len(df.columns) == 1:
        df = unwrap(df, arrays[0])
    return Dataset(normalize(df) if clean else df, kind, path, checked)


def save(df: DataFrame, path: str, format: str | None = None, header: bool = True) -> str:
    """By the suffix of the path: a folder of Parquet, CSV or JSON lines."""
    kind = format or next((f for s, f in SUFFIXES.items() if path.lower().endswith(s)), "parquet")
    flat = df.select(*(F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else quoted(f.name) for f in df.schema.fields))
    if kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind in ("csv", "tsv"):
        flat.write.mode("overwrite").option("header", header).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    else:
        df.write.mode("overwrite").json(path)
    return path
