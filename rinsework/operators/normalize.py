"""Clean-up of whole tables: nested columns, null tokens, blanks, numbers in strings. Each step is one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.functions import constants as K
from rinsework.functions.text import name_words


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def unnest(df: DataFrame, deep: bool = False) -> DataFrame:
    """Fields of structs become columns, with the struct's name before theirs where they clash. deep: until none is left."""
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.StructType)]
    taken, out = set(names), []
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.StructType):
            out.append(quoted(f.name))
            continue
        for x in f.dataType.fields:
            name = x.name if x.name not in taken else f"{f.name}_{x.name}"
            taken.add(name)
            out.append(quoted(f.name).getField(x.name).alias(name))
    flat = df.select(*out)
    return unnest(flat, True) if deep and any(isinstance(f.dataType, T.StructType) for f in flat.schema.fields) else flat


def unwrap(df: DataFrame, column: str, outer: bool = False) -> DataFrame:
    """A row for each struct of an array column, with its fields as columns."""
    return df.select((F.inline_outer if outer else F.inline)(quoted(column)))


def null_tokens(df: DataFrame, tokens: list[str] = K.NULL_TOKENS, columns: list[str] | None = None) -> DataFrame:
    chosen = text_columns(df) if columns is None else columns
    return df.withColumns({c: F.when(~quoted(c).isin(*tokens), quoted(c)) for c in chosen})


def trim_blank(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Trimmed strings; empty ones are null."""
    return df.withColumns({c: F.nullif(F.trim(quoted(c), F.lit(" \t\n\x0b\f\r")), F.lit("")) for c in (text_columns(df) if columns is None else columns)})


def _number(c: Column) -> Column:
    return F.trim(F.translate(c, "$,", "")).try_cast("double")


def numeric_strings(df: DataFrame, codes: list[str] = K.CODE_WORDS) -> DataFrame:
    """Text columns that hold numbers only, with $ and commas, become doubles; not those named as codes. One aggregation for all."""
    chosen = [c for c in text_columns(df) if not name_words(c) & set(codes)]
    if not chosen:
        return df
    tests = [F.struct(F.count(quoted(c)).alias("n"), F.count(_number(quoted(c))).alias("good")).alias(f"c{i}") for i, c in enumerate(chosen)]
    row = df.agg(*tests).first()
    good = [c for i, c in enumerate(chosen) if row[i]["n"] and row[i]["n"] == row[i]["good"]]
    return df.withColumns({c: _number(quoted(c)) for c in good}) if good else df


def normalize(df: DataFrame, numbers: bool = True) -> DataFrame:
    """All of it, for any format: a source's format doesn't decide what is cleaned."""
    out = trim_blank(null_tokens(unnest(df)))
    return numeric_strings(out) if numbers else out
