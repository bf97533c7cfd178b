"""Steps of a plan as functions from DataFrame to DataFrame. A whole plan folds into one lazy query; nothing is written, and
only the values that fill gaps are computed on the way, one aggregation for a step."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.functions import constants as K
from rinsework.functions.text import name_words, title
from rinsework.operators.gazetteer import renamed
from rinsework.operators.normalize import quoted
from rinsework.operators.profile import is_numeric
from rinsework.operators.quantiles import modes, quantiles
from rinsework.plans.ir import Step

MAP_LITERAL = 1_000  # a mapping of more entries becomes a table that is joined
NO_FILL = {"id", "key", "code", "uuid", "ssn"}


def _kind(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def spellings(mapping: dict[str, Any]) -> dict[str, str | None]:
    """Each key as it is, in lower case, capitals and title case, the former before the latter, and the least key first; values
    trimmed; null is a legal value."""
    out: dict[str, str | None] = {}
    keys = sorted(((str(k).strip(), v) for k, v in mapping.items() if k is not None), key=lambda e: e[0], reverse=True)
    for form in (str.title, str.upper, str.lower, str):
        for k, value in keys:
            out[form(k)] = None if value is None else str(value).strip()
    return out


def spelling_table(own: DataFrame) -> DataFrame:
    """spellings() of a table (y, root): _key, _value, a row for each form."""
    y = F.trim("y")
    forms = F.array(*(F.struct(F.lit(i).alias("rank"), form.alias("key")) for i, form in enumerate((y, F.lower(y), F.upper(y), title(y)))))
    rows = own.filter("y is not null").select(F.explode(forms).alias("f"), y.alias("y"), F.trim("root").alias("root"))
    first = F.min(F.struct("f.rank", "y", "root"))
    return rows.groupBy(F.col("f.key").alias("_key")).agg(first.alias("e")).select("_key", F.col("e.root").alias("_value"))


def standardize(df: DataFrame, column: str, mapping: dict[str, Any]) -> DataFrame:
    """Trimmed values, replaced where the mapping has them. Small mappings are literals; large ones a join with a table."""
    table = spellings(mapping)
    if not table:
        return df
    kind = _kind(df, column)
    value = F.trim(quoted(column)) if isinstance(kind, T.StringType) else quoted(column).cast("string")
    if len(table) <= MAP_LITERAL:
        m = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v).cast("string"))))
        new = F.when(F.coalesce(F.map_contains_key(m, F.coalesce(value, F.lit(""))), F.lit(False)) & value.isNotNull(), F.try_element_at(m, value)).otherwise(value)
        return df.withColumn(column, new.try_cast(kind) if not isinstance(kind, T.StringType) else new)
    own = df.sparkSession.createDataFrame([(k, v) for k, v in table.items()], "_key string, _value string")
    joined = df.withColumn("_own", value).join(own, F.col("_own") == F.col("_key"), "left")
    new = F.when(F.col("_key").isNotNull(), F.col("_value")).otherwise(F.col("_own"))
    return joined.withColumn(column, new.try_cast(kind) if not isinstance(kind, T.StringType) else new).select(*map(quoted, df.columns))


def standardize_by(df: DataFrame, column: str, at: str) -> DataFrame:
    """The same by a written table (y, root) of any size, joined by the trimmed value; it catches the same spellings."""
    kind = _kind(df, column)
    own = spelling_table(df.sparkSession.read.parquet(at))
    joined = df.withColumn("_own", F.trim(quoted(column).cast("string"))).join(own, F.col("_own") == F.col("_key"), "left")
    new = F.when(F.col("_key").isNotNull(), F.col("_value")).otherwise(F.col("_own"))
    return joined.withColumn(column, new if isinstance(kind, T.StringType) else new.try_cast(kind)).select(*map(quoted, df.columns))


def rename(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Names of these kinds, looked up by a join, for columns with too many values for a mapping."""
    kind = _kind(df, column)
    for name in names:
        new = F.col("new") if isinstance(kind, T.StringType) else F.col("new").try_cast(kind)
        df = renamed(df, quoted(column), name).select(*(new.alias(c) if c == column else F.col("row")[c].alias(c) for c in df.columns))
    return df


def clamp(df: DataFrame, column: str, lower: float = 0, upper: float = 120) -> DataFrame:
    """Values outside become the bound; nulls stay (least and greatest would lose them). Text becomes a number or null."""
    kind = _kind(df, column)
    c = quoted(column) if is_numeric(kind) else quoted(column).try_cast("double")
    low, high = (F.lit(x).cast(kind) if is_numeric(kind) else F.lit(float(x)) for x in (lower, upper))
    return df.withColumn(column, F.when(c < low, low).when(c > high, high).otherwise(c))


def centres(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """What fills gaps: the median of numbers, the most frequent value else (the first in order on a tie); null for empty columns.
    One question for all numbers and one for all others, and no task holds the values of a column."""
    numbers = [c for c in columns if is_numeric(_kind(df, c))]
    others = [c for c in columns if c not in numbers]
    stack = lambda names, kind: df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("g"), quoted(c).cast(kind).alias("x")) for c in names))))
    found: dict[str, Any] = dict.fromkeys(columns)
    if numbers:
        found |= {r["g"]: r["q"][0] for r in quantiles(stack(numbers, "double"), (0.5,)).collect()}
    if others:
        found |= {r["g"]: r["mode"] for r in modes(stack(others, "string")).collect()}
    return found


def impute(df: DataFrame, column: str, strategy: str = "median") -> DataFrame:
    numeric = is_numeric(_kind(df, column))
    value = centres(df, [column])[column]
    value = (0.0 if value is None else float(value)) if numeric else ("" if value is None else value)
    c = quoted(column).cast("double") if numeric else quoted(column)
    return df.withColumn(column, F.coalesce(c, F.lit(value) if numeric else F.lit(value).try_cast(_kind(df, column))))


def regex_replace(df: DataFrame, column: str, test: str = "", pattern: str = "", replacement: str = "", lowercase: bool = False, nullify_invalid: bool = False, valid_pattern: str | None = None, **_: Any) -> DataFrame:
    if not valid_pattern and ("email" in test.lower() or "email" in column.lower()):
        valid_pattern = K.EMAIL
    c = quoted(column).cast("string")
    if pattern:
        c = F.regexp_replace(c, pattern, replacement)
    if lowercase:
        c = F.lower(c)
    return df.withColumn(column, F.when(c.rlike(valid_pattern), c) if valid_pattern else c)


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    """A step for a missing column does nothing."""
    column, own = step.target_column, step.parameters
    if step.action == "deduplicate_exact":
        return df.dropDuplicates()
    if column not in df.columns:
        return df
    if step.action == "standardize_values":
        names = own.get("names") or []
        for at in own.get("tables") or []:
            df = standardize_by(df, column, at)
        return rename(standardize(rename(df, column, names), column, own.get("mapping") or {}), column, names)
    if step.action == "clamp_bounds":
        return clamp(df, column, own.get("lower", 0), own.get("upper", 120))
    if step.action == "knn_impute":
        return impute(df, column, own.get("strategy", "median"))
    return regex_replace(df, column, step.test_criterion, **{k: v for k, v in own.items() if k != "test"})


def apply_plan(df: DataFrame, steps: list[Step], columns: list[str] | None = None) -> DataFrame:
    from rinsework.plans.rewrite import scope

    return reduce(apply_step, scope(steps, columns), df)


@dataclass
class NullReport:
    filled: dict[str, Any] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    rows_removed: int = 0


def resolve_nulls(df: DataFrame, columns: list[str] | None = None, kinds: dict[str, str] | None = None, drop: bool = True) -> tuple[DataFrame, NullReport]:
    """Gaps are filled by the column's centre, but not in identifiers, addresses and empty columns; then rows that still have a
    gap in one of the columns go. Integers get the median rounded half to even."""
    chosen = [c for c in df.columns if columns is None or c in columns]
    if not chosen:
        return df, NullReport()
    kinds, report = kinds or {}, NullReport()
    fits = lambda c: not (name_words(c) & NO_FILL or "email" in c.lower() or kinds.get(c, "").lower().endswith("id") or kinds.get(c) in ("Identifier", "Email"))
    simple = [c for c in chosen if is_numeric(_kind(df, c)) or isinstance(_kind(df, c), (T.StringType, T.BooleanType))]
    whole = lambda c: isinstance(_kind(df, c), T.IntegralType)
    nulls = df.agg(*(F.count_if(quoted(c).isNull()).alias(f"c{i}") for i, c in enumerate(simple))).first() if simple else []
    gaps = [c for c, n in zip(simple, nulls, strict=True) if n]
    values = centres(df, [c for c in gaps if fits(c)])
    for c in gaps:
        if values.get(c) is not None:
            report.filled[c] = round(values[c]) if whole(c) else values[c] == "true" if isinstance(_kind(df, c), T.BooleanType) else values[c]
        else:
            report.skipped.append(c)
    out = df.withColumns({c: F.coalesce(quoted(c), F.lit(v).cast(_kind(df, c))) for c, v in report.filled.items()}) if report.filled else df
    if not drop:
        return out, report
    left = out.na.drop(subset=[c.replace("`", "``") if "." not in c else f"`{c}`" for c in chosen])
    missing = reduce(lambda a, b: a | b, [quoted(c).isNull() for c in chosen])
    report.rows_removed = out.filter(missing).count()
    return left, report
