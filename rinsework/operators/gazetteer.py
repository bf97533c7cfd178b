"""Which known name a value means: a city by a short name, a beginning or a misspelling, a state by a misspelling.

Names are an index: a table of the signatures (`operators/spellings.py`) that any text alike enough must share, so distinct values meet by
one join only the few names that can be alike, and only these are compared. The index of the fixed names is small and
Spark broadcasts it by its own check of the size; an index of any other size is joined by signature as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinsework.functions import constants as K
from rinsework.functions.text import phone_india, similar, similarity
from rinsework.operators.spellings import alike_signatures

LEAST = 80.0
SHORTEST_BEGINNING = 3
KINDS: dict[str, set[str]] = {"City": {"city", "town"}, "State": {"state", "province"}, "Phone": {"phone", "mobile", "contact"}}  # words in names of columns


def names_table(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, sorted(set(names))))).alias("name"))


def _signed(df: DataFrame, text: str, least: float, value: bool) -> DataFrame:
    """df's columns, role, s. The shorter text's signatures meet the longer's, and either may be the value."""
    shorter, longer = alike_signatures(F.col(text), least)
    tag = lambda signatures, role: F.transform(F.array_distinct(signatures), lambda s: F.struct(F.lit(role).alias("role"), s.alias("s")))
    return df.select("*", F.inline(F.concat(tag(shorter, 0 if value else 1), tag(longer, 1 if value else 0))))


def nearest(values: DataFrame, names: DataFrame, least: float = LEAST) -> DataFrame:
    """v, name: the most similar name of each value, if its similarity is `least` or more, the first in order on a tie. values: v,
    distinct; names: name. Empty and null ones are like nothing. A value has at most as many candidates as there are names."""
    met = _signed(values.select("v").filter("v <> ''"), "v", least, True).join(_signed(names.select("name").filter("name <> ''").distinct(), "name", least, False), ["role", "s"])
    each = met.groupBy("v").agg(F.sort_array(F.collect_set("name")).alias("names"))
    scored = F.transform(F.filter("names", lambda n: similar(F.col("v"), n, least)), lambda n: F.struct((-similarity(F.col("v"), n)).alias("s"), n.alias("n")))
    return each.select("v", F.array_min(scored)["n"].alias("name")).filter("name is not null")


def beginnings(names: DataFrame, shortest: int = SHORTEST_BEGINNING) -> DataFrame:
    """beginning, name: the first name in order that begins so."""
    cuts = F.when(F.length("name") >= shortest, F.sequence(F.lit(shortest), F.length("name"))).otherwise(F.array().cast("array<int>"))
    each = names.select("name", F.explode(cuts).alias("n"))
    return each.groupBy(F.substr("name", F.lit(1), "n").alias("beginning")).agg(F.min("name").alias("name"))


def meant(values: DataFrame, kind: str) -> DataFrame:
    """v, w: what each value should be written as; null if nothing is known for it. values: v, distinct and trimmed. Blank
    values and nulls mean nothing."""
    if kind == "Phone":
        return values.select("v", F.when(F.col("v") != "", phone_india(F.col("v"))).alias("w"))
    spark = values.sparkSession
    low = values.select("v", F.lower(F.trim("v")).alias("low"))
    if kind == "City":
        names = names_table(spark, K.CITIES)
        short = F.create_map(*(F.lit(x) for pair in K.CITY_SHORT.items() for x in pair))
        low = low.join(beginnings(names), F.col("low") == F.col("beginning"), "left").select("v", "low", F.coalesce(F.try_element_at(short, "low"), F.initcap("name")).alias("sure"))
    else:
        names = names_table(spark, [*K.INDIAN_STATES, *K.US_STATES])
        low = low.select("v", "low", F.lit(None).cast("string").alias("sure"))
    asked = low.filter("sure is null and low <> ''").select(F.col("low").alias("v")).distinct()
    found = nearest(asked, names).select(F.col("v").alias("low"), "name")
    return low.join(found, "low", "left").select("v", F.coalesce("sure", F.initcap("name")).alias("w"))


def renamed(df: DataFrame, value: Column, kind: str) -> DataFrame:
    """row (all of df's columns), new: the value, trimmed, as it is meant; what means nothing stays, but a phone number with too few digits
    becomes null. Distinct values are looked up and joined back, however many there are."""
    own = df.select(F.struct("*").alias("row"), F.trim(value.cast("string")).alias("own"))
    if kind == "Phone":
        return own.select("row", F.when(F.col("own") != "", phone_india(F.col("own"))).otherwise(F.col("own")).alias("new"))
    found = meant(own.filter("own <> ''").select(F.col("own").alias("v")).distinct(), kind).filter("w is not null and v <> w")
    return own.join(found, F.col("own") == F.col("v"), "left").select("row", F.coalesce("w", "own").alias("new"))
