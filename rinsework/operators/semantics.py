"""Semantic types of columns: shares of values that look like something, ordered rules on them and on the column's name, and
a linear model where no rule speaks. All columns' shares come from one aggregation over all values."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.functions import constants as K
from rinsework.operators.normalize import quoted

CONFIDENT = 0.80


@dataclass
class SemanticType:
    column: str
    kind: str
    confidence: float
    chances: dict[str, float] = field(default_factory=dict)


def _shares(c: Column) -> dict[str, Column]:
    s = F.trim(c.cast("string"))
    low, size = F.lower(s), F.sum(F.length(F.trim(c.cast("string"))))
    only = lambda form: F.sum(F.length(F.regexp_replace(s, form, "")))
    of_chars = lambda form: F.coalesce(only(form) / F.nullif(size, F.lit(0)), F.lit(0.0))
    share = lambda test: F.coalesce(F.avg(test.cast("double")), F.lit(0.0))
    times = lambda x: F.length(s) - F.length(F.translate(s, x, ""))
    money = F.lit(False)
    for symbol in K.CURRENCY_SYMBOLS:
        money |= F.contains(low, F.lit(symbol))
    has_digit = s.rlike(r"\d")
    separated = (times("-") >= 2) | (times("/") >= 2) | ((times(":") >= 1) & (times("-") >= 1))
    return {
        "n": F.count(c),
        "digits": of_chars(r"[^\p{Nd}]"),
        "letters": of_chars(r"[^\p{L}]"),
        "spaces": of_chars(r"\S"),
        "separators": of_chars("[^-/:]"),
        "emails": share(s.rlike(K.EMAIL)),
        "at_signs": share(F.contains(s, F.lit("@")) & F.contains(s, F.lit("."))),
        "money": share(money & has_digit),
        "dates": share(s.rlike(K.ISO_DATE) | (separated & has_digit)),
        "times": share(((times("-") >= 2) | (times("/") >= 2) | F.contains(s, F.lit(":"))) & has_digit),
        "postal": share(s.rlike(K.ANY_POSTAL)),
        "cities": share(low.isin(*K.CITIES)),
        "states": share(low.isin(*K.INDIAN_STATES, *K.US_STATES)),
        "countries": share(low.isin(*K.COUNTRIES)),
        "length": F.coalesce(F.avg(F.length(s)), F.lit(0.0)),
        "blanks": F.coalesce(F.max(F.contains(s, F.lit(" ")).cast("int")), F.lit(0)).cast("double"),
    }


def features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name and its shares, a row for each column."""
    rows = [F.struct(F.lit(c).alias("column_name"), *(v.alias(k) for k, v in _shares(quoted(c)).items())) for c in (columns or df.columns)]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _named(*words: str) -> Callable[[str], bool]:
    """Whole words: between any characters that aren't letters or digits."""
    form = re.compile(r"\b(?:" + "|".join(words) + r")\b")
    return lambda name: form.search(name) is not None


def _holds(*parts: str) -> Callable[[str], bool]:
    return lambda name: any(p in name for p in parts)


# The rules in their order: type, confidence, test of the name, and share that must be reached.
RULES: list[tuple[str, float, Callable[[str], bool], tuple[str, float] | None]] = [
    ("Email", 0.99, _named("email", "mail"), ("at_signs", 0.50)),
    ("Timestamp", 0.99, _named("date", "time", "timestamp", "created", "updated", "datetime"), ("times", 0.50)),
    ("Country", 0.98, _named("country", "nation"), ("countries", 0.35)),
    ("State", 0.96, _named("state", "province", "region"), ("states", 0.35)),
    ("City", 0.96, _named("city", "town"), ("cities", 0.35)),
    ("PostalCode", 0.97, _named("zip", "postal", "postcode", "pincode"), None),
    ("Currency", 0.97, _holds("price", "cost", "amount", "salary", "fee", "fare", "rate", "subtotal", "total", "balance", "wage", "revenue", "charge"), ("money", 0.30)),
    ("Quantity", 0.96, _named("qty", "quantity", "count", "units", "items", "volume", "inventory"), None),
    ("InvoiceNo", 0.99, _holds("invoice", "inv no"), None),
    ("CustomerID", 0.99, _holds("customer id", "customer no", "customer num", "customerid", "customerno", "cust id", "client id", "user id", "account id", "account no", "account num", "accountid", "accountno"), None),
    ("StockCode", 0.98, _holds("stock code", "stockcode", "stock no", "sku", "item code", "product code", "part number", "part no"), None),
    ("Identifier", 0.95, _named("id", "no", "num", "number", "code", "key", "ref", "guid", "uuid", "pk", "fk"), None),
    ("Description", 0.96, _named("desc", "description", "title", "name", "comment", "note", "summary", "remark", "detail", "item"), None),
]


def model_chances(row: dict[str, float]) -> dict[str, float]:
    """Softmax of the linear model."""
    x = [row["digits"], row["letters"], row["spaces"], row["emails"], row["money"], max(row["separators"], row["dates"]), row["postal"], row["cities"], row["states"], min(row["length"] / 20, 2.0)]
    logits = [b + sum(v * w[j] for v, w in zip(x, K.SEMANTIC_WEIGHTS, strict=True)) for j, b in enumerate(K.SEMANTIC_BIAS)]
    top = max(logits)
    powers = [math.exp(v - top) for v in logits]
    return {c: p / sum(powers) for c, p in zip(K.SEMANTIC_CLASSES, powers, strict=True)}


def classify(column: str, row: dict[str, float]) -> SemanticType:
    if not row["n"]:
        return SemanticType(column, "Unknown", 0.0)
    name = column.strip().lower().replace("_", " ").replace("-", " ")
    for kind, confidence, named, share in RULES:
        described = kind == "Description" and row["length"] > 12 and row["blanks"] > 0
        if named(name) or described or share and row[share[0]] >= share[1]:
            return SemanticType(column, kind, confidence, {kind: confidence})
    chances = model_chances(row)
    best = max(chances, key=chances.__getitem__)
    sure = chances[best] >= CONFIDENT and best != "Other"
    return SemanticType(column, best if sure else "Unknown", round(chances[best], 4), {k: round(v, 4) for k, v in chances.items()})


def infer_types(df: DataFrame, columns: list[str] | None = None, plugin: Callable[[str, list[str]], SemanticType | None] | None = None) -> dict[str, SemanticType]:
    """plugin: a classifier of (column, sample values) that is asked first, such as a language model's."""
    found = {}
    samples = {}
    if plugin is not None:
        from rinsework.operators.profile import distinct_profile

        samples = {r["column_name"]: r["samples"] for r in distinct_profile(df, columns, 20).collect()}
    for r in features(df, columns).collect():
        row = r.asDict()
        said = plugin(row["column_name"], samples.get(row["column_name"], [])) if plugin else None
        found[row["column_name"]] = said or classify(row["column_name"], row)
    return found
