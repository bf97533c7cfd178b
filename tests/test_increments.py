"""Merged states of files against full runs."""

from pyspark.sql import functions as F

from rinsework.operators import increments, profile

SF = "/root/testdata/sf0.01"


def rows(df):
    return {r.column_name: r.asDict() for r in df.collect()}


def test_new_files_alone_are_read(spark, tmp_path):
    table, own = str(tmp_path / "t"), increments.GrowingProfile(spark, str(tmp_path / "t"), str(tmp_path / "s"))
    c = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey")).alias("c"), F.concat(F.lit("u"), F.col("o_orderkey") % 90, F.lit("@example.com")).alias("mail"))
    hot, rest = c.filter("o_orderkey % 3 = 0"), c.filter("o_orderkey % 3 > 0")
    hot.coalesce(1).write.parquet(table)
    own.refresh()
    assert own.read_files == 1
    rest.repartition(5).write.mode("append").parquet(table)
    got = rows(own.profile())
    assert own.read_files == 5
    fixed = lambda found: {c: {k: v for k, v in r.items() if not k.startswith("q")} for c, r in found.items()}
    assert fixed(rows(own.profile())) == fixed(got) and own.read_files == 0
    full, exact = rows(profile.numeric_profile(c)), rows(profile.distinct_profile(c))
    patterns = rows(profile.pattern_profile(c))
    assert set(got) == set(c.columns)
    n = c.count()
    for name, g in got.items():
        assert (g["n_rows"], g["n_null"]) == (n, exact[name]["n_null"])
        assert abs(g["card"] - exact[name]["card"]) <= 0.05 * exact[name]["card"]
        for k in ("min", "max", "mean", "std"):
            assert g[k] == full[name][k] if name in full else g[k] is None
        for k in profile.PATTERNS:
            assert g[k] == (patterns[name][k] if name in patterns else None)
    for name in full:  # the rank of each quartile
        for q, k in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            below, upto = c.agg(F.avg((F.col(name) < got[name][k] - 0.01).cast("double")), F.avg((F.col(name) <= got[name][k] + 0.01).cast("double"))).first()
            assert below - 0.005 <= q <= upto + 0.005


def test_changes_of_schema_empty_and_lost_files(spark, tmp_path):
    """Also all null and NaN columns, and files that go, are rewritten, or lack a column."""
    table, own = tmp_path / "t", increments.GrowingProfile(spark, str(tmp_path / "t"), str(tmp_path / "s"))
    spark.createDataFrame([], "a long, x double").coalesce(1).write.parquet(str(table / "p=0"))
    assert rows(own.profile()) == {} or all(r["n_rows"] == 0 for r in rows(own.profile()).values())
    spark.createDataFrame([(1, None), (2, float("nan"))], "a long, x double").coalesce(1).write.parquet(str(table / "p=1"))
    spark.createDataFrame([(5, 4.0, "k")], "a long, x double, `b.c` string").coalesce(1).write.parquet(str(table / "p=2"))
    got = rows(own.profile())
    assert own.read_files == 2
    assert (got["a"]["n_rows"], got["a"]["n_null"], got["a"]["card"], got["a"]["min"], got["a"]["max"], got["a"]["std"]) == (3, 0, 3, 1.0, 5.0, 2.08)
    assert (got["x"]["n_null"], got["x"]["mean"], got["x"]["std"], got["x"]["card"]) == (1, 4.0, None, 3)
    assert (got["b.c"]["n_null"], got["b.c"]["card"], got["b.c"]["q50"]) == (2, 2, None)
    spark.createDataFrame([(9, 9.0)], "a long, x double").coalesce(1).write.mode("overwrite").parquet(str(table / "p=1"))
    again = rows(own.profile())
    assert own.read_files == 1 and (again["a"]["n_rows"], again["a"]["min"], again["a"]["max"], again["x"]["mean"]) == (2, 5.0, 9.0, 6.5)
