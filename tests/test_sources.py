"""Formats, the shield, JSON repair, versions, provenance, streams."""

import json

import pytest
from pyspark.sql import functions as F

from rinsework.plans import provenance
from rinsework.sources import formats, json_repair, shield
from rinsework.sources.versions import Conflict, VersionStore


def write(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_formats(spark, tmp_path):
    tsv = formats.load(spark, write(tmp_path / "a.tsv", "id\tcity\tzip\n1\tPune\t411001\n2\tDelhi\t110001\n"))
    assert tsv.format == "tsv" and tsv.df.columns == ["id", "city", "zip"] and rows(tsv.df) == [(1, "Pune", 411001), (2, "Delhi", 110001)]
    tsv.df.write.parquet(str(tmp_path / "a.parquet"))
    assert rows(formats.load(spark, str(tmp_path / "a.parquet")).df) == rows(tsv.df)
    nd = formats.load(spark, write(tmp_path / "a.ndjson", '{"id": 1, "name": "A"}\nbroken\n[{"id": 2, "name": "B"}, {"id": 3, "name": "C"}]\n'))
    assert nd.format == "ndjson" and rows(nd.df) == [(1, "A"), (2, "B"), (3, "C")] and nd.shield.n_quarantined == 1
    assert formats.load(spark, write(tmp_path / "two.json", '{"id": 1}\n{"id": 2}\n')).format == "ndjson"
    assert rows(formats.load(spark, write(tmp_path / "b.json", '[{"id": 1, "val": 5},\n {"id": 2, "val": 6}]')).df) == [(1, 5), (2, 6)]
    assert rows(formats.load(spark, write(tmp_path / "c.json", '{\n"id": 1, "name": "x",\n "active": true}')).df) == [(True, 1, "x")]
    assert rows(formats.load(spark, write(tmp_path / "d.json", '{"status": "ok", "data": [{"id": 1, "score": 9}, {"id": 2, "score": 8}]}')).df) == [(1, 9), (2, 8)]
    assert rows(formats.load(spark, write(tmp_path / "e.json", '{"doc_id": "1\x00", "title": "a"}')).df) == [("1", "a")]
    assert rows(formats.read_records(spark, [{"ID": 1, "City": "hyd"}])) == [("hyd", 1)]
    with pytest.raises(ValueError):
        formats.read_records(spark, [])
    with pytest.raises(FileNotFoundError):
        formats.load(spark, str(tmp_path / "none.csv"))


def test_sniffing():
    say = formats.sniff_format
    assert [say(b"", n) for n in ("a.parquet", "a.PQ", "a.jsonl", "a.tab", "a.csv")] == ["parquet", "parquet", "ndjson", "tsv", "csv"]
    assert [say(b) for b in (b"PAR1..", b"[1]", b'{"a":1}', b'{"a":1}\n{"b":2}', b"a,b\n", b"")] == ["parquet", "json", "json", "ndjson", "csv", "csv"]


def test_csv_values_and_saving(spark, tmp_path):
    text = 'id,name,amount,zip,name\n1," Ann, B ","$1,200",01234,x\n2,N/A,,00000,y\n3,NaN,3,99999,z\n'
    df = formats.load(spark, write(tmp_path / "v.csv", text)).df
    assert df.columns == ["id", "name", "amount", "zip", "name_2"]
    assert rows(df.select("id", "name", "amount")) == [(1, "Ann, B", 1200.0), (2, None, None), (3, None, 3.0)]
    for suffix in ("csv", "tsv", "parquet", "json"):
        at = formats.save(df, str(tmp_path / f"out.{suffix}"))
        assert formats.load(spark, at, format=None if suffix != "json" else "ndjson").df.count() == 3


def test_late_rows_lose_nothing(spark, tmp_path):
    """The last 1,500 of 12,000 rows differ in type and in fields."""
    head, tail = [f"{i},{i % 7},x{i}" for i in range(10_500)], [f"{i},late {i},y" for i in range(10_500, 12_000)]
    df = formats.load(spark, write(tmp_path / "late.csv", "\n".join(["id,v,name", *head, *tail]))).df
    assert dict(df.dtypes) == {"id": "int", "v": "string", "name": "string"}
    got = {r.id: (r.v, r.name) for r in df.collect()}
    assert got == {i: (str(i % 7), f"x{i}") for i in range(10_500)} | {i: (f"late {i}", "y") for i in range(10_500, 12_000)}
    lines = [json.dumps({"id": i, "v": i % 7}) for i in range(10_500)] + [json.dumps({"id": i, "v": f"late {i}", "late": i}) for i in range(10_500, 12_000)]
    for name in ("late.ndjson", "late.json"):
        df = formats.load(spark, write(tmp_path / name, "\n".join(lines) if name.endswith("ndjson") else "[" + ",".join(lines) + "]")).df
        got = {r.id: (r.v, r.late) for r in df.collect()}
        assert got == {i: (str(i % 7), None) for i in range(10_500)} | {i: (f"late {i}", i) for i in range(10_500, 12_000)}


def test_types_hold_every_value(spark, tmp_path):
    text = "a,b,c,d,e,f,g\n1,1,1.5,true,1d,NA,9999999999\n-2,99999999999,2e3,FALSE,2,7,99999999999999999999\n,N/A,NaN,,3,,1\n"
    df = formats.load(spark, write(tmp_path / "t.csv", text), clean=False).df
    assert [k for _, k in df.dtypes] == ["int", "bigint", "double", "boolean", "string", "int", "string"]
    assert [tuple(r) for r in df.drop("g").collect()] == [(1, 1, 1.5, True, "1d", None), (-2, 99999999999, 2000.0, False, "2", 7), (None, None, None, None, "3", None)]


def test_a_row_like_the_header_is_a_row(spark, tmp_path):
    assert rows(formats.load(spark, write(tmp_path / "h.csv", "a,b\n1,2\na,b\n")).df) == [("1", "2"), ("a", "b")]
    (tmp_path / "parts").mkdir()
    for i in range(3):
        write(tmp_path / "parts" / f"p{i}.csv", f"a,b\n{i},x\n")
    assert rows(formats.read_delimited(spark, str(tmp_path / "parts"))[0]) == [(0, "x"), (1, "x"), (2, "x")]


def test_shield(spark, tmp_path):
    good = [f"{i},n{i},e{i}@x.co,{i % 9},2020-01-01" for i in range(12_000)]
    good[7] = '7,"n, 7",e7@x.co,7,2020-01-01'
    good[9] = "9,n\x009,e9@x.co,9,2020-01-01"
    lines = ["id,name,email,score,date", *good[:5000], "," * 500, *good[5000:9000], "", "short,row", "long,row,1,2,3,4,5,6", *good[9000:]]
    path = write(tmp_path / "r.csv", "\n".join(lines) + "\ntail,row")
    found = shield.shield(spark, path)
    assert (found.n_valid, found.n_quarantined, found.null_bytes) == (12_001, 4, True)
    assert found.n_bytes == len("\n".join(lines) + "\ntail,row")
    log = {r.reason: r for r in found.quarantined.filter("reason = 'delimiter_bomb'").collect()}
    assert log["delimiter_bomb"].line_no == 5002 and len(log["delimiter_bomb"].data) == 250
    assert sorted(r.line_no for r in found.quarantined.collect()) == [5002, 9003, 9004, 12005]
    assert "[QUARANTINE] line=5002 reason=delimiter_bomb" in shield.quarantine_lines(found.quarantined.filter("line_no = 5002")).first().value
    assert found.valid.filter(F.contains("value", F.lit("\x00"))).count() == 0
    raw = shield.shield(spark, path, quotes=False)  # every comma counts
    assert raw.n_quarantined == 5
    loaded = formats.load(spark, path)
    assert loaded.df.count() == 12_000 and len(loaded.df.columns) == 5
    with pytest.raises(shield.QuotaExceeded):
        shield.shield(spark, path, most=1000)


def test_shield_facts(spark, tmp_path):
    assert shield.detect_delimiter(["a;b;c", "1;2,5;3", "1;2;3"]) == ";" and shield.detect_delimiter([]) == "," and shield.detect_delimiter(["abc"]) == ","
    df = formats.load(spark, write(tmp_path / "l.csv", "a,b\né,1\nçà,2\nêtre où,3\nnaïve déjà,4\n".encode("latin-1"))).df
    assert {r.a for r in df.collect()} == {"é", "çà", "être où", "naïve déjà"}
    mended = spark.createDataFrame([("cafÃ©",), ("café",), ("plain",), (None,)], "t string").select(shield.mend(F.col("t")).alias("t"))
    assert [r.t for r in mended.collect()] == ["café", "café", "plain", None]
    assert shield.shield(spark, write(tmp_path / "empty.csv", "")).n_valid == 0 and formats.load(spark, str(tmp_path / "empty.csv")).df.columns == []


def test_json_repair():
    say = lambda t: list(json_repair.records(json_repair.repair(t)))
    assert say('{ {"a": 1}, {"a": 2} }') == say('{"a": 1}, {"a": 2}') == say('[{"a": 1}, {"a": 2}') == say('{"a": 1}\n{"a": 2}') == [{"a": 1}, {"a": 2}]
    assert say('x {"a": 1} y {bad {"a": 2}') == [{"a": 1}, {"a": 2}]
    assert say("[1, null]") == [{"value": 1}, {"value": None}] and say('{"a": [1, 2], "b": [3, 4]}') == [{"a": 1, "b": 3}, {"a": 2, "b": 4}]
    assert say('{"k": 1, "other": [{"a": 1}]}') == [{"a": 1}] and say('{"k": 1, "tags": [1]}') == [{"k": 1, "tags": [1]}] and say("[]") == []
    with pytest.raises(ValueError):
        json_repair.repair("no json at all")


# ---- versions and provenance


def test_versions(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    assert not store.exists() and store.current() == -1 and store.history() == []
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    b = a.filter("id = 1")
    assert [store.commit(a, "raw"), store.commit(b, "filter", "id")] == [0, 1]
    assert rows(store.read(0)) == rows(a) and rows(store.read()) == rows(b)
    assert store.restore(0) == 2 and rows(store.read()) == rows(a) and store.entry(2)["restored"] == 0
    assert store.entry(0)["content_hash"] == store.entry(2)["content_hash"] != store.entry(1)["content_hash"]
    assert [e["version"] for e in store.history()] == [2, 1, 0] and store.labels()["v1: filter"] == 1
    with pytest.raises(KeyError):
        store.read(9)
    late = VersionStore(spark, str(tmp_path / "store"))
    late.current = lambda: 1  # as if it had looked before version 2 was there
    with pytest.raises(Conflict):
        late.commit(b, "late")


def test_provenance(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id int, t string")
    assert provenance.content_hash(a) == provenance.content_hash(a.repartition(3).select("t", "id"))
    assert provenance.content_hash(a) != provenance.content_hash(a.distinct()) != provenance.content_hash(a.limit(0))
    record = provenance.sign(provenance.manifest("in", "out", [{"step_id": 1, "action": "<b>"}], {"w1": 0.1}, 3), b"key")
    assert provenance.verified(record, b"key") and not provenance.verified(record | {"version": 4}, b"key") and not provenance.verified(record, b"other")
    with pytest.raises(ValueError):
        provenance.sign({}, b"")
    provenance.write(record, str(tmp_path / "p.json"), str(tmp_path / "p.html"))
    assert json.loads((tmp_path / "p.json").read_text()) == record and "<b>" not in (tmp_path / "p.html").read_text()


# ---- streams


def test_streams(spark, tmp_path):
    from rinsework.streaming import live

    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "1.csv", "a,b\n1,2\n1,2,3\n")
    facts = shield.Facts(",", 1, "a,b")
    where = [str(tmp_path / x) for x in ("good", "bad", "check")]
    live.shield_stream(spark, str(tmp_path / "in"), facts, *where).awaitTermination(60)
    write(tmp_path / "in" / "2.csv", "3,4\n")
    live.shield_stream(spark, str(tmp_path / "in"), facts, *where).awaitTermination(60)
    assert sorted(r.line for r in spark.read.parquet(where[0]).collect()) == ["1,2", "3,4", "a,b"]
    assert [(r.line, r.reason) for r in spark.read.parquet(where[1]).collect()] == [("1,2,3", "ragged_row")]
