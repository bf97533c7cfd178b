"""Links from attributes to the names they belong to, and the issues that show in the linked records. Joins and aggregations
over rows of entities; names are found by a sweep over places, so nothing pairs all names of a page with all its attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinsework.functions import constants as K
from rinsework.functions.text import digits, mismatches, similar
from rinsework.operators.spellings import candidates

ATTRIBUTES = ["Phone", "Email", "Address", "City", "State", "InvoiceNo", "Date", "Amount", "PostalCode"]
WINDOW = 350


CHUNK = 1 << 16  # characters of a page that one task sweeps


def _at() -> Column:
    """The middle of an entity; one without a place is at the start."""
    return F.coalesce((F.col("span_start") + F.col("span_end")) / F.lit(2.0), F.lit(0.0))


def nearest_names(attributes: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """by..., at, name_id, d, n_names: for each place of an attribute the nearest name of its group, its distance, and the number of the
    group's names; ties go to the name that starts first, then to the lesser id. attributes: by..., at; names: by..., at, name_start, name_id.

    A sweep in both directions that carries the last name along. Equal places are one row before they are sorted, and long groups
    are cut into chunks, which start from the last name of the chunks before them; so no task sorts more than a chunk, however
    many rows a group has, and the work is linear in rows. Null groups have no names."""
    none = F.lit(None).cast(names.select(F.struct("name_start", "name_id").alias("n")).schema["n"].dataType)
    marks = names.select(*by, "at", F.struct("name_start", "name_id").alias("n"), F.lit(False).alias("asked"))
    both = marks.unionByName(attributes.select(*by, "at", none.alias("n"), F.lit(True).alias("asked"))).dropna(subset=by)
    places = both.groupBy(*by, "at").agg(F.min("n").alias("n"), F.count("n").alias("here"), F.max("asked").alias("asked"))
    places = places.withColumn("chunk", F.floor(F.col("at") / CHUNK)).repartition(*by, "chunk")
    mark = F.when(F.col("n").isNotNull(), F.struct("at", "n"))
    ends = places.groupBy(*by, "chunk").agg(F.min(mark).alias("first"), F.max(mark).alias("last"), F.sum("here").alias("here"))
    over = lambda keys, order, upto: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, upto)
    before, after = F.last("last", True).over(over(by, F.col("chunk"), -1)), F.last("first", True).over(over(by, F.col("chunk").desc(), -1))
    carried = ends.select(*by, "chunk", before.alias("before"), after.alias("after"), F.sum("here").over(Window.partitionBy(*by)).alias("n_names"))
    keys = [*by, "chunk"]
    swept = places.withColumns({"behind": F.last(mark, True).over(over(keys, F.col("at"), 0)), "ahead": F.last(mark, True).over(over(keys, F.col("at").desc(), 0))})
    choice = lambda m: F.when(m.isNotNull(), F.struct(F.abs(F.col("at") - m["at"]).alias("d"), m["n"].alias("n")))
    best = F.least(choice(F.coalesce("behind", "before")), choice(F.coalesce("ahead", "after")))
    found = swept.filter("asked").join(carried, keys).select(*by, "at", best.alias("b"), "n_names").filter("b is not null")
    return found.select(*by, "at", F.col("b.n.name_id").alias("name_id"), F.col("b.d").alias("d"), "n_names")


def link(entities: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, source_id, target_id, relation_type, confidence: each attribute to the nearest name of its record; without one
    there, to the page's only name, or to the nearest within the window. Repeated rows of one entity are one."""
    names = entities.filter("type = 'CustomerName'").select("doc_id", "page", "record_id", F.col("entity_id").alias("name_id"), _at().alias("at"), F.col("span_start").alias("name_start"))
    attributes = entities.filter(F.col("type").isin(*ATTRIBUTES)).select("doc_id", "page", "record_id", "entity_id", "type", _at().alias("at")).distinct()
    inside = nearest_names(attributes, names, ["doc_id", "record_id"]).select("doc_id", "record_id", "at", F.col("name_id").alias("own"))
    beside = nearest_names(attributes, names, ["doc_id", "page"]).filter((F.col("n_names") == 1) | (F.col("d") <= window))
    both = attributes.join(inside, ["doc_id", "record_id", "at"], "left").join(beside, ["doc_id", "page", "at"], "left")
    sure = F.when(F.col("own").isNotNull(), 0.98).when(F.col("n_names") == 1, 0.95).otherwise(0.88)
    edges = both.select("doc_id", F.coalesce("own", "name_id").alias("source_id"), F.col("entity_id").alias("target_id"), F.concat(F.lit("has_"), F.lower("type")).alias("relation_type"), sure.alias("confidence"))
    return edges.filter("source_id is not null")


def clusters(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, cluster_id, name, record_id, attributes (map from type to its values in order): a row for each name."""
    said = F.coalesce("normalized_value", "value")
    targets = entities.select("doc_id", F.col("entity_id").alias("target_id"), F.col("type").alias("kind"), said.alias("own"))
    lists = edges.join(targets, ["doc_id", "target_id"]).groupBy("doc_id", "source_id", "kind").agg(F.sort_array(F.collect_list("own")).alias("values"))
    maps = lists.groupBy("doc_id", "source_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "values")))).alias("attributes"))
    names = entities.filter("type = 'CustomerName'").select("doc_id", F.col("entity_id").alias("source_id"), said.alias("name"), "record_id")
    return names.join(maps, ["doc_id", "source_id"], "left").select("doc_id", F.col("source_id").alias("cluster_id"), "name", "record_id", F.coalesce("attributes", F.create_map().cast("map<string,array<string>>")).alias("attributes"))


ISSUE = ["doc_id", "type", "field", "current_value", "other_value", "severity", "evidence"]


def _issue(df: DataFrame, kind: str, field: Column, current: Column, other: Column, severity: str | Column, evidence: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("doc_id", F.lit(kind).alias("type"), field.alias("field"), current.cast("string").alias("current_value"), other.cast("string").alias("other_value"), level.alias("severity"), evidence.alias("evidence"))


def missing(found: DataFrame, fields: tuple[str, ...] = ("Email", "Phone")) -> DataFrame:
    wanted = found.select("doc_id", "name", "attributes", F.explode(F.array(*map(F.lit, fields))).alias("field")).filter(~F.map_contains_key("attributes", F.col("field")))
    return _issue(wanted, "missing", F.col("field"), F.lit(None), F.lit(None), "medium", F.concat(F.lit("no "), "field", F.lit(" for "), "name"))


def conflicts(found: DataFrame, fields: tuple[str, ...] = ("Phone", "City", "State")) -> DataFrame:
    each = found.select("doc_id", "name", F.explode("attributes").alias("field", "values")).filter(F.col("field").isin(*fields)).withColumn("values", F.array_sort(F.array_distinct("values")))
    bad = each.filter(F.size("values") > 1)
    return _issue(bad, "conflict", F.col("field"), F.col("values")[0], F.array_join(F.slice("values", 2, 1_000_000), ", "), "high", F.concat(F.lit("several values for "), "name", F.lit(": "), F.array_join("values", ", ")))


def duplicates(entities: DataFrame, least: float = 85.0) -> DataFrame:
    """Names and phones of a document that are equal, alike, or one character apart. Distinct values of a document and type are compared if they
    share a signature; copies of one value are an issue for each copy after the first, not for each pair."""
    own = entities.filter(F.col("type").isin("CustomerName", "Phone")).withColumn("low", F.lower(F.trim("value")))
    values = own.groupBy("doc_id", "type", "low").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    copies = values.filter("n > 1").select("doc_id", "type", "value", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("copy"))
    same = _issue(copies, "duplicate", F.col("type"), F.col("value"), F.col("value"), "low", F.concat(F.lit("occurs again: "), "value"))
    pairs = candidates(values.select("doc_id", "type", F.col("low").alias("v"), F.col("low").alias("k")), ["doc_id", "type"], least, near=0)
    x, y = F.col("a"), F.col("b")
    apart = F.abs(F.length(x) - F.length(y)) + mismatches(x, y)
    alike = pairs.filter((apart <= 1) | similar(x, y, least)).distinct()
    for side in "ab":  # as it was written
        alike = alike.join(values.select("doc_id", "type", F.col("low").alias(side), F.col("value").alias(f"{side}_value")), ["doc_id", "type", side])
    near = alike
    return same.unionByName(_issue(near, "duplicate", F.col("type"), F.col("a_value"), F.col("b_value"), "medium", F.concat(F.lit("alike: "), "a_value", F.lit(" and "), "b_value")))


def layouts(entities: DataFrame) -> DataFrame:
    """Phones where a document mixes layouts, and dates that aren't ISO."""
    v = F.trim("value")
    layout = F.when(F.startswith(v, F.lit("+91")), "+91").when(F.contains(v, F.lit("-")), "hyphenated").when(v.rlike(r"^\d+$"), "digits")
    phones = entities.filter("type = 'Phone'")
    mixed = phones.groupBy("doc_id").agg(F.count_distinct(layout).alias("n")).filter("n > 1")
    bad = phones.join(mixed, "doc_id", "left_semi").unionByName(entities.filter("type = 'Date'")).filter("value <> normalized_value")
    return _issue(bad, "format_inconsistent", F.col("type"), F.col("value"), F.col("normalized_value"), "low", F.concat(F.lit("written as "), "value", F.lit(", meant is "), "normalized_value"))


def invalid(entities: DataFrame) -> DataFrame:
    n = F.length(digits(F.col("value")))
    mail = (F.col("type") == "Email") & ~F.trim("value").rlike(r"@(?!.*@).*\.")
    phone = (F.col("type") == "Phone") & ((n < 10) | (n > 15))
    return _issue(entities.filter(mail | phone), "invalid", F.col("type"), F.col("value"), F.lit(None), "high", F.concat(F.lit("malformed: "), "value"))


def spellings(entities: DataFrame) -> DataFrame:
    """Cities written in several ways, or by an outdated or short name; and one state's usual misspelling."""
    raw = entities.filter("type = 'City'").groupBy("doc_id", "normalized_value").agg(F.collect_set("value").alias("values"))
    each = raw.select("doc_id", "normalized_value", F.size("values").alias("n"), F.explode("values").alias("value")).filter("value <> normalized_value")
    city = each.filter((F.col("n") > 1) | F.lower("value").isin(*K.OUTDATED_CITIES)).select("doc_id", F.lit("City").alias("field"), "value", "normalized_value")
    state = entities.filter("type = 'State' and lower(value) = 'telengana'").select("doc_id", F.lit("State").alias("field"), "value", "normalized_value")
    both = city.unionByName(state)
    return _issue(both, "semantic", F.col("field"), F.col("value"), F.col("normalized_value"), "low", F.concat("value", F.lit(" stands for "), "normalized_value"))


def issues(entities: DataFrame, found: DataFrame) -> DataFrame:
    """All issues, with an id that follows from their content."""
    parts = [missing(found), duplicates(entities), layouts(entities), conflicts(found), invalid(entities), spellings(entities)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    key = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in ISSUE))
    return out.withColumn("issue_id", F.concat(F.lit("iss_"), F.substring(F.sha2(key, 256), 1, 16)))


def records(entities: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("Phone", "Email", "City", "State", "Date", "Amount", "InvoiceNo", "PostalCode", "Address")) -> DataFrame:
    """A row for each document's name, a column for each type: the most confident value, the first in order on a tie. A city
    of one state only fills in the state."""
    said = F.coalesce("normalized_value", "value")
    targets = entities.select("doc_id", F.col("entity_id").alias("target_id"), F.col("type").alias("kind"), said.alias("own"), F.col("confidence").alias("c"))
    names = entities.filter("type = 'CustomerName'").select("doc_id", F.col("entity_id").alias("source_id"), said.alias("name"))
    flat = names.join(edges.select("doc_id", "source_id", "target_id"), ["doc_id", "source_id"], "left").join(targets, ["doc_id", "target_id"], "left")
    best = F.min_by("own", F.struct((-F.col("c")).alias("c"), F.col("own")))
    wide = flat.groupBy("doc_id", "name").pivot("kind", list(kinds)).agg(best)
    table = F.create_map(*(F.lit(x) for pair in K.CITY_STATE.items() for x in pair))
    return wide.withColumn("State", F.coalesce("State", F.try_element_at(table, F.col("City")))) if {"City", "State"} <= set(kinds) else wide
