"""Personal data in texts: counts, masks by class, numbered tokens, and the audit for leaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinsework.functions import constants as K
from rinsework.functions.text import digits

#: In the order in which they are masked: longer digit groups before the phones that could cut them.
CLASSES = {"EMAIL": K.PII_EMAIL, "CREDIT_CARD": K.PII_CARD, "GOV_ID": f"{K.PII_AADHAAR}|{K.PII_SSN}", "PHONE": K.PII_PHONE}
#: A phone counts with ten digits or more: its area code isn't optional then.
FULL_PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
#: What every match of a class holds, and what a match of any holds: found by far less work than the matches themselves.
HOLDS = {"EMAIL": r"@[A-Za-z0-9.-]", "CREDIT_CARD": r"\d{4}[-\s]?\d{4}", "GOV_ID": r"\d{4}[-\s]?\d{4}|-\d{2}-\d{4}", "PHONE": r"\d{3}[-.\s]?\d{4}"}
HOLDS_ANY = "|".join(HOLDS.values())


def matches(c: Column, kind: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(CLASSES[kind]), F.lit(0))
    return F.filter(found, lambda x: F.length(digits(x)) >= 10) if kind == "PHONE" else found


def n_matches(c: Column, kind: str) -> Column:
    """0 for null; texts that can't hold the class aren't searched for it."""
    return F.coalesce(F.when(c.rlike(HOLDS[kind]), F.size(matches(c, kind))), F.lit(0))


def counts(df: DataFrame, column: str, *keep: str) -> DataFrame:
    return df.select(*keep, *(n_matches(F.col(column), k).cast("long").alias(f"n_{k.lower()}") for k in CLASSES))


def mask_class(c: Column) -> Column:
    """Every match replaced by its class: one pass for each class, no state."""
    forms = [*list(CLASSES.items())[:-1], ("PHONE", FULL_PHONE)]
    return F.when(~c.rlike(HOLDS_ANY), c).otherwise(reduce(lambda x, kind: F.regexp_replace(x, kind[1], f"[{kind[0]}]"), forms, c))


def leaks(c: Column) -> Column:
    """Whether raw personal data is left."""
    return reduce(lambda a, b: a | b, [n_matches(c, k) > 0 for k in CLASSES])


def _plain(kind: Column, value: Column) -> Column:
    return F.when(kind == "EMAIL", F.lower(value)).when(kind == "PHONE", digits(value)).otherwise(F.translate(value, "- ", ""))


def tokens(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, kind, value, raw, token: each document numbers its values of a class by their first place. Documents are
    independent, so numbering needs no order over the whole table; each class is searched after the ones before it are masked."""

    def listed(c: Column, kind: str) -> Column:
        return F.transform(matches(c, kind), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x.alias("raw")))

    left, parts = F.col(column), []
    for kind, form in CLASSES.items():
        parts.append(listed(left, kind))
        left = F.regexp_replace(left, FULL_PHONE if kind == "PHONE" else form, f"[{kind}]")
    found = df.filter(F.col(column).rlike(HOLDS_ANY)).select(key, F.explode(F.concat(*parts)).alias("m")).select(key, "m.*").withColumn("value", _plain(F.col("kind"), F.col("raw")))
    first = found.groupBy(key, "kind", "value").agg(F.min("at").alias("at"), F.array_sort(F.collect_set("raw")).alias("raw"))
    number = F.row_number().over(Window.partitionBy(key, "kind").orderBy("at"))
    return first.withColumn("token", F.concat(F.lit("["), "kind", F.lit("_"), number.cast("string"), F.lit("]"))).select(key, "kind", "value", "raw", "token")


def mask_numbered(df: DataFrame, column: str) -> DataFrame:
    """df with the column's personal data replaced by numbered tokens, match by match where they stand: equal characters
    elsewhere stay. A text numbers its own values, within its row: whatever the other columns hold, nothing stays raw."""
    out = df.withColumn("_left", F.col(column))
    for kind, form in CLASSES.items():
        plain = lambda x: _plain(F.lit(kind), x)  # noqa: B023, E731
        counted = (lambda x: F.length(digits(x)) >= 10) if kind == "PHONE" else (lambda x: F.lit(True))
        out = out.withColumn("_held", F.when(F.col("_left").rlike(HOLDS[kind]), F.col("_left")))  # null where nothing is to mask, and so is all that follows
        out = out.withColumns({"_raw": F.regexp_extract_all("_held", F.lit(form), F.lit(0)), "_parts": F.split("_held", form, -1)})
        out = out.withColumn("_own", F.array_distinct(F.transform(F.filter("_raw", counted), plain)))
        place = lambda x: F.array_position("_own", plain(x))
        masked = F.transform("_raw", lambda x: F.when(place(x) > 0, F.concat(F.lit(f"[{kind}_"), place(x).cast("string"), F.lit("]"))).otherwise(x))  # noqa: B023
        joined = F.array_join(F.zip_with("_parts", masked, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
        out = out.withColumn("_left", F.coalesce(joined, "_left"))
    return out.withColumn(column, F.col("_left")).select(df.columns)
