"""Cases that once went wrong: each must stay right."""

import pytest
from pyspark.sql import functions as F

from rinsework.functions import pii
from rinsework.operators import actions, charts, dependencies, entities
from rinsework.sources import documents
from rinsework.sources.versions import VersionStore


def test_nothing_stays_raw_whatever_the_key(spark):
    text = "mail c@d.com or 123-45-6789, C@D.com again, +1 212-555-0100"
    df = spark.createDataFrame([(None, text), (1, text), (1, "other a@b.org"), (2, None), (3, "")], "doc_id long, text string")
    masked = [r.text for r in pii.mask_numbered(df, "text").collect()]
    assert masked[0] == masked[1] == "mail [EMAIL_1] or [GOV_ID_1], [EMAIL_1] again, [PHONE_1]"
    assert masked[2:] == ["other [EMAIL_1]", None, ""]


def test_pages_that_are_null(spark):
    df = spark.createDataFrame([("d", None, "write to a@b.org"), ("d", 2, "or to c@d.org"), ("e", 1, None)], "doc_id string, page int, text string")
    assert {(r.value, r.page) for r in entities.extract(df).filter("type = 'Email'").collect()} == {("a@b.org", 1), ("c@d.org", 2)}


def test_points_of_any_table(spark):
    df = spark.range(5000).select(F.col("id").alias("x"), F.col("id").alias("y"))
    assert charts.scatter(df, "x", "y", 10_000).count() == 5000 and 300 < charts.scatter(df, "x", "y", 500).count() < 700
    assert charts.scatter(df.limit(0), "x", "y").count() == 0


def test_a_torn_entry_of_the_log(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(1,)], "a int")
    store.commit(df, "one")
    (tmp_path / "s" / "_log" / f"{1:020d}.json").write_text("")
    (tmp_path / "s" / "_log" / f"{2:020d}.json").write_text('{"version": 2, "op')
    assert [e["version"] for e in store.history()] == [0] and store.labels() == {"v0: one": 0} and store.read().count() == 1
    with pytest.raises(KeyError):
        store.read(1)
    assert store.commit(df, "two") == 3 and store.read(3).count() == 1


@pytest.mark.parametrize("mapping", [{"Hyderbad": "Hyderabad"}, {"hyderbad": "A", "Hyderbad": "B", "ßx": "C", " pad ": " D "}, {"x": None}])
def test_mappings_and_tables_catch_the_same(spark, tmp_path, mapping):
    values = ["Hyderbad", "HYDERBAD", "hyderbad", " Hyderbad ", "ßx", "SSX", "pad", "PAD", "x", "X", None, "", "other"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    at = str(tmp_path / "m")
    spark.createDataFrame(list(mapping.items()), "y string, root string").write.parquet(at)
    assert sorted(map(repr, actions.standardize_by(df, "c", at).collect())) == sorted(map(repr, actions.standardize(df, "c", mapping).collect()))


def test_dependencies_of_all_pairs_are_those_of_each(spark):
    rows = [(f"k{i % 5}", ["Pune", "Hyderabad", "Chennai", "Mumbai", "Delhi"][i % 5] if i % 40 else "Hyderbad", f"g{i % 3}", "North West" if i % 50 else "North Wst") for i in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    wanted = [("a", "b"), ("a", "d"), ("c", "d"), ("b", "d")]
    found = {(d.determinant, d.dependent): (d.confidence, d.mapping) for d in dependencies._approximate(df, wanted, 85.0, 0.0, 10_000)}
    for x, y in wanted:
        pairs = dependencies.pair_counts(df, x, y)
        mapping = dependencies.canonical(pairs)
        assert found[x, y] == (dependencies.confidence(pairs, mapping).first().confidence, {r.y: r.root for r in mapping.filter("y <> root").collect()})
    large = {(d.determinant, d.dependent): d for d in dependencies._approximate(df, wanted, 85.0, 0.0, 0)}
    assert all({r.y: r.root for r in spark.read.parquet(d.table).collect()} == found[k][1] for k, d in large.items() if d.table)


def test_documents_that_share_names_types_and_encodings(spark, tmp_path):
    for name, raw in (("x/a.txt", b"one"), ("y/a.txt", "été".encode("latin-1")), ("y/b.txt", "漢字".encode()), ("y/c.odt", b"?"), ("y/big.txt", b"z" * 500)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.doc_id: r.text for r in documents.read_documents(spark, str(tmp_path), most=400).collect()}
    assert got.pop("b") == "漢字" and sorted(got.values()) == ["one", "été"] and all(k.endswith("/a.txt") for k in got) and len(got) == 2
    assert {(r.path.rsplit("/", 1)[1], r.reason) for r in documents.rejected(spark, str(tmp_path), most=400).collect()} == {("c.odt", "unknown_type"), ("big.txt", "too_large")}
