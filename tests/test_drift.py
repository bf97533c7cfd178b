"""Directions of texts: what numpy adds up in the tasks is what Spark's own functions give, gram by gram."""

import random
import time

from pyspark.sql import functions as F

from rinsework.operators import loss


def slow(df):
    """side, b, w by Spark's functions alone."""
    t = df.select("side", F.trim(F.lower("x")).alias("t"), F.monotonically_increasing_id().alias("i")).filter("length(t) > 0").localCheckpoint()
    grams = t.select("side", "i", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("t") - 2)), lambda k: loss.bucket(F.substr("t", k, F.lit(3))))).alias("b"))
    c = grams.groupBy("side", "i", "b").agg(F.count("*").cast("double").alias("c"))
    n = c.groupBy("side", "i").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    return {(r.side, r.b): r.w for r in c.join(n, ["side", "i"]).groupBy("side", "b").agg(F.sum(F.col("c") / F.col("n")).alias("w")).collect()}


def test_directions_are_those_of_grams(spark, monkeypatch):
    pick = random.Random(7)
    texts = ["".join(pick.choice("abcXYZ 019\x00éßİ\u20ac中😀") for _ in range(pick.randint(0, 14))) for _ in range(400)] + ["a", "ab", "é", "😀x", "  ", "", None, "same text"] * 2
    df = spark.createDataFrame([(x, i % 2) for i, x in enumerate(texts)], "x string, side int")
    wanted = slow(df)
    for most in (1 << 20, 40):
        monkeypatch.setattr(loss, "MOST_CHARS", most)
        found = {(r.side, r.b): r.w for r in loss._directions(df.repartition(3)).collect()}
        assert found.keys() == wanted.keys() and all(abs(found[k] - w) < 1e-9 for k, w in wanted.items())


def test_drift_of_many_texts_in_time(spark):
    """300,000 different texts a side in one task: expressions over each gram took minutes."""
    a = spark.range(300_000, numPartitions=1).selectExpr("concat('Customer number ', id) as c")
    loss.drift(a.limit(10), a.limit(10), "c").collect()
    began = time.time()
    assert loss.drift(a, a, "c").first()[0] == 0
    assert time.time() - began < 20


def test_equal_texts_of_a_batch_get_one_vector(spark, monkeypatch):
    plain = loss._vectors

    def strict(texts, known):
        assert len(set(texts)) == len(texts)
        return plain(texts, known)

    monkeypatch.setattr(loss, "_vectors", strict)
    a = spark.range(5_000, numPartitions=1).selectExpr("concat('Value ', id % 5) as c")
    assert loss.drift(a, a, "c").first()[0] == 0


def test_wording_is_jaccard_and_drift(spark):
    a = spark.createDataFrame([(x,) for x in ["red", "Red", " red ", "", "  ", None, "gr\u00fcn", "blue", "blue", "ab"]], "c string")
    b = spark.createDataFrame([(x,) for x in ["red", "", "blue", "violet", None, "gr\u00fcn"] * 3], "c string")
    for x, y in ((a, b), (b, a), (a, a), (a.limit(0), b), (a.limit(0), b.limit(0)), (a.filter("trim(c) = ''"), b)):
        assert tuple(loss.wording(x, y, "c").first()) == (loss.jaccard(x, y, "c").first()[0], loss.drift(x, y, "c").first()[0])


def test_utility_goes_by_no_partitions(spark):
    """Forests draw rows by partition and position: the score of three classes went by the number of shuffle partitions."""
    rows = spark.range(6_000).selectExpr("cast(id % 97 as double) as a", "concat('w', id % 13) as b", "concat('y', hash(id) % 3) as c")
    kept, found = rows.filter("a > 30"), []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in ("2", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(loss.utility(rows, kept, "c"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0].status == "measured" and found[0] == found[1]
