"""Names of a gazetteer, and names nearest to attributes, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from rinsework.functions import constants as K
from rinsework.operators import actions, gazetteer, relations

STATES = sorted({*K.INDIAN_STATES, *K.US_STATES})


def alike(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(before[j], row[-1]))
    return 100.0 if a == b else 200.0 * row[-1] / (len(a) + len(b))


def best(value, names, least=80.0):
    s, n = min(((-alike(value, n), n) for n in sorted(names)), default=(0, None))
    return n if -s >= least and value else None


def city(value):
    low = value.strip().lower()
    if low in K.CITY_SHORT:
        return K.CITY_SHORT[low]
    begins = [n for n in sorted(K.CITIES) if n.startswith(low)] if len(low) >= 3 else []
    found = begins[0] if begins else best(low, K.CITIES)
    return found and " ".join(w.capitalize() for w in found.split(" "))


def damaged(names, seed, n):
    own, out = random.Random(seed), set()
    for _ in range(n):
        t = own.choice(names)
        for _ in range(own.randrange(5)):
            i = own.randrange(len(t) + 1)
            t = own.choice([t[:i] + own.choice("abz é7") + t[i:], t[:i] + t[i + 1 :], t[:i] + t[i + 1 : i + 2] + t[i : i + 1] + t[i + 2 :], t.title(), t[:i], t + " x"])
        out.add(t.strip())
    return sorted(out)


def test_names_are_those_of_comparing_all(spark):
    values = [*damaged(K.CITIES, 1, 500), *damaged(STATES, 2, 500), "", "x", "hyd", "SF", "漢字", "a" * 70, "san francisco " * 9]
    df = spark.createDataFrame([(v,) for v in sorted(set(values))], "v string")
    assert {r.v: r.w for r in gazetteer.meant(df, "City").collect()} == {v: city(v) for v in values}
    got = {r.v: r.w and r.w.lower() for r in gazetteer.meant(df, "State").collect()}
    assert got == {v: best(v.strip().lower(), STATES) for v in values}
    assert sum(w is not None for w in got.values()) > 100


@pytest.mark.parametrize("least", [60.0, 90.0, 100.0])
def test_any_names_and_thresholds(spark, least):
    names = [*STATES[::4], "long name " * 8, "long names " * 8, "", "q"]
    values = sorted({*damaged(names, 3, 200), "long nam " * 8, "", "q"})
    table = lambda own, c: spark.createDataFrame([(x,) for x in own], f"{c} string")
    got = {r.v: r.name for r in gazetteer.nearest(table(values, "v"), table([*names, None], "name"), least).collect()}
    assert got == {v: w for v in values if (w := best(v, [n for n in names if n], least))}


def test_renaming_keeps_columns_rows_and_nulls(spark):
    rows = [("hyd", "u", 1), ("hyd", "u", 1), (None, "telengana", 2), (" ", None, 3), ("Nowhere", " Utah ", 4)]
    df = spark.createDataFrame(rows, "`new` string, `row` string, `own.v` long")
    done = actions.rename(actions.rename(df, "new", ["City"]), "row", ["State"])
    assert done.columns == df.columns
    assert sorted(map(tuple, done.collect()), key=repr) == sorted([("Hyderabad", "Utah", 1)] * 0 + [("Hyderabad", "u", 1)] * 2 + [(None, "Telangana", 2), ("", None, 3), ("Nowhere", "Utah", 4)], key=repr)
    assert actions.rename(df.limit(0), "new", ["City"]).collect() == []


ENTITY = "doc_id string, type string, span_start int, span_end int, page int, record_id string, entity_id string"


def links(rows, window):
    names = [r for r in set(rows) if r[1] == "CustomerName"]
    mid, out = (lambda r: (r[2] + r[3]) / 2), set()
    for r in set(rows):
        if r[1] == "CustomerName":
            continue
        key = lambda n, r=r: (abs(mid(r) - mid(n)), n[2], n[6])
        own = [n for n in names if n[0] == r[0] and n[5] is not None and n[5] == r[5]]
        page = [n for n in names if n[0] == r[0] and n[4] is not None and n[4] == r[4]]
        many = sum(n[0] == r[0] and n[4] == r[4] and n[1] == "CustomerName" for n in rows)
        near = page if many == 1 else [n for n in page if key(n)[0] <= window]
        if own or near:
            out.add((r[0], min(own or near, key=key)[6], r[6], "has_" + r[1].lower(), 0.98 if own else 0.95 if many == 1 else 0.88))
    return sorted(out)


@pytest.mark.parametrize("chunk", [7, 200, 1 << 16])
def test_links_are_those_of_all_pairs(spark, monkeypatch, chunk):
    """Also with ties, several chunks, chunks without names, repeated rows, null pages and records."""
    monkeypatch.setattr(relations, "CHUNK", chunk)
    own = random.Random(chunk)
    rows = []
    for i in range(600):
        kind, at = own.choice(["CustomerName", "Phone", "City", "Phone", "Note"]), own.randrange(own.choice([40, 3000]))
        rows.append((own.choice("abcc"), kind, at, at + own.randrange(6), own.choice([1, 2, 3, None]), own.choice([None, None, *"rstuvwxyz"]), f"e{i:03}"))
    rows = [r for r in rows if r[1] != "CustomerName" or r[0] != "b" or r[4] != 2] + [("b", "CustomerName", 5, 9, 2, None, "one"), ("d", "City", 1, 2, 1, "r", "alone")]
    rows += rows[:60]
    got = relations.link(spark.createDataFrame(rows, ENTITY), 30).collect()
    assert sorted(map(tuple, got)) == links([r for r in rows if r[1] != "Note"], 30)


def test_a_hot_page_is_linear(spark):
    """Half of the rows on one page: with all pairs this were 2,500,000,000."""
    df = spark.range(100_000).select(
        F.lit("d").alias("doc_id"), F.when(F.col("id") % 2 == 0, "CustomerName").otherwise("Phone").alias("type"), (F.col("id") * 3).cast("int").alias("span_start"), (F.col("id") * 3 + 2).cast("int").alias("span_end"),
        F.lit(1).alias("page"), F.lit(None).cast("string").alias("record_id"), F.col("id").cast("string").alias("entity_id"),
    )
    got = relations.link(df).agg(F.count("*").alias("n"), F.count_if(F.expr("source_id + 1 = target_id")).alias("before")).first()
    assert (got.n, got.before) == (50_000, 50_000)
