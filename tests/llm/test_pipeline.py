import corpus_pipeline as P
from rinsework.llm import secrets, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def test_stages_of_the_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4] > 0.5 * counts[0]
    rows = docs.collect()
    assert len({r.text for r in rows}) == len(rows)
    assert not any(k != "random" for r in rows for k, _, _ in secrets.scan(r.text) if "[SECRET]" not in r.text)
    assert all(r.n_chars == len(r.text) for r in rows)
    packed = P.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def test_exact_copies_leave_one(spark):
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(i, words if i % 2 else words + "".join(f" x{i}_{k}" for k in range(90)), "en", "s", 1) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    kept = sorted(r.doc_id for r in simhash.keep_first(df, simhash.similar_documents(df)).collect())
    assert kept == [0, 1, *range(2, 40, 2)]


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_odd_rows_and_more_columns(spark):
    """Nulls in any column, repeated ids, repeated rows, and columns that are named like results."""
    words = " ".join(f"word{i} and more of it" for i in range(60))
    other = " ".join(f"other{i} text stands here" for i in range(60))
    key = "password = hunter2hunter2"
    rows = [
        (1, words, "en", "s", 10, True, 0.5, "a"), (1, words, "en", "s", 10, True, 0.5, "a"), (1, other, "en", "s", 10, None, None, None), (2, words, None, None, None, False, 0.1, "b"),
        (None, f"{other} {key}", "en", "s", 10, True, 0.5, "c"), (3, None, "en", "s", 0, True, 0.5, "d"), (4, "", "en", "s", 0, True, 0.5, "e"), (5, f"x{words[1:]} {key} {other} {words}", "en", None, 10, True, 0.5, "f"),
    ]
    docs = spark.createDataFrame(rows, DOCS + ", kept boolean, score double, component_id string")
    at = docs
    for name, stage in P.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, SF).collect(), docs.schema)
        assert at.columns == docs.columns, name
    rows = at.collect()
    assert not any("hunter2" in r.text for r in rows) and all(r.text for r in rows)
    assert len([r for r in rows if r.doc_id == 1]) <= 2 and len({(r.doc_id, r.text) for r in rows}) == len(rows)
    P.STAGES[-1][1](spark, at, SF).collect()
