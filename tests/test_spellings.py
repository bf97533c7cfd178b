"""The join of spellings against comparing all with all."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rinsework.functions.text import mismatches, similar, typo_variants
from rinsework.operators import dependencies, relations, spellings


def some(seed, n):
    own = random.Random(seed)
    base = ["Hyderabad", "New Delhi", "Anna", "abc", "ab", "a", "7 Sins", "77", "Straße", "漢字かな", "😀😀b", "Zoë K", "aaaaaaaa", "Secunderabad West 500", "The quick brown fox jumps over the lazy dogs of Hyderabad and some m", "x" * 50 + "yz" * 20]
    out = set()
    while len(out) < n:
        t = own.choice(base)
        for _ in range(own.randrange(4)):
            i = own.randrange(len(t) + 1)
            t = own.choice([t[:i] + own.choice("abZ é7") + t[i:], t[:i] + t[i + 1 :], t[:i], t.upper(), t[:i] + own.choice("xy ") + t[i + 1 :]])
        out.add(t.strip())
    return sorted(out)


@pytest.mark.parametrize("least", [70.0, 85.0, 95.0])
def test_variants_are_those_of_all_pairs(spark, least):
    rows = [(x, y, 1) for x in ("p", "q") for y in some(len(x), 60)]
    pairs = spark.createDataFrame(rows, "x string, y string, n long")
    a, b = pairs.select("x", F.col("y").alias("a")), pairs.select("x", F.col("y").alias("b"))
    wanted = a.join(b, "x").filter((F.col("a") < F.col("b")) & typo_variants(F.col("a"), F.col("b"), least)).select("x", "a", "b")
    assert sorted(dependencies.variants(pairs, least).collect()) == sorted(wanted.collect()) != []


def test_duplicates_are_those_of_all_pairs(spark):
    values = spark.createDataFrame([(t.lower(),) for t in some(9, 80)] + [("9876543210",), ("9876543211",), ("987654321",), ("0000000000",)], "v string").distinct()
    a, b = values.select(F.col("v").alias("a")), values.select(F.col("v").alias("b"))
    alike = lambda df: df.filter((F.abs(F.length("a") - F.length("b")) + mismatches(F.col("a"), F.col("b")) <= 1) | similar(F.col("a"), F.col("b"), 85.0))
    wanted = alike(a.crossJoin(b).filter("a < b"))
    met = spellings.candidates(values.select(F.lit("d").alias("doc"), "v", F.col("v").alias("k")), ["doc"], 85.0)
    assert sorted(alike(met).select("a", "b").distinct().collect()) == sorted(wanted.collect()) != []


def test_pieces_of_hot_signatures_lose_nothing(spark):
    values = spark.createDataFrame([("d", t, t.lower()) for t in some(4, 100)], "doc string, v string, k string")
    found = [sorted(spellings.candidates(values, ["doc"], 85.0, begins=4, near=4, piece=p).distinct().collect()) for p in (2, 10_000)]
    assert found[0] == found[1] != []


def test_nulls_and_none(spark):
    empty = spark.createDataFrame([], "x string, y string, n long")
    assert dependencies.variants(empty).collect() == []
    odd = spark.createDataFrame([(None, "Pune", 1), (None, "Punee", 1), ("x", "", 1), ("x", "a", 1)], "x string, y string, n long")
    assert dependencies.variants(odd).collect() == []


def test_many_spellings_under_one_x(spark):
    """Comparing all pairs of 20,000 would be 200 million; here no more than a fortieth of them meet."""
    own = random.Random(1)
    names = {"".join(own.choice("bcdfghklmnprstvz") + own.choice("aeiou") for _ in range(own.randrange(4, 8))).title() for _ in range(19_000)}
    names |= {n[:3] + own.choice("xqw") + n[4:] for n in sorted(names)[:1000]}
    pairs = spark.createDataFrame([("one", n, 1) for n in names], "x string, y string, n long")
    values = pairs.select("x", F.lit("").alias("d"), F.col("y").alias("v"), F.lower("y").alias("k"))
    met = spellings.candidates(values, ["x", "d"], 85.0, begins=4, near=4, same_digits=True).count()
    assert met < len(names) ** 2 / 2 / 40
    began = time.time()
    assert dependencies.variants(pairs).count() > 500
    assert time.time() - began < 120


def test_texts_alone_in_their_group_need_no_signatures(spark, monkeypatch):
    """Names with digits of their own meet no other name, so only the two others have signatures."""
    rows, plain = {}, spellings.staged

    def counted(df, name):
        out = plain(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(spellings, "staged", counted)
    one = spark.range(500, numPartitions=1).selectExpr("'x' as x", "concat('Customer#', lpad(id, 9, '0')) as y", "1L as n")
    both = one.unionByName(spark.createDataFrame([("x", "Hyderabad", 1), ("x", "Hyderbad", 1)], "x string, y string, n long"))
    assert [(r.a, r.b) for r in dependencies.variants(both).collect()] == [("Hyderabad", "Hyderbad")]
    assert rows["values"] == 2 and rows["signatures-a"] + rows["signatures-b"] < 500
