"""Encodings from whole inputs: late, mixed, many files, what fits none."""

import pytest

from rinsework.sources import encodings, formats, shield
from tests.test_sources import rows, write

TEXTS = {
    "cp1252": "José a payé 12 € à Zoë – «déjà vu», où êtes-vous ?",
    "cp1250": "Zażółć gęślą jaźń, příliš žluťoučký kůň úpěl ďábelské ódy",
    "cp1251": "Съешь же ещё этих мягких французских булок, да выпей чаю. Москва",
    "koi8_r": "Съешь же ещё этих мягких французских булок, да выпей чаю. Москва",
    "cp1253": "Ο καλύτερος τρόπος να μάθεις είναι η πράξη. Αθήνα",
    "shift_jis": "色は匂へど散りぬるを、我が世誰ぞ常ならむ。カタカナ",
    "euc_jp": "色は匂へど散りぬるを、我が世誰ぞ常ならむ。カタカナ",
    "euc_kr": "다람쥐 헌 쳇바퀴에 타고파. 키스의 고유조건은",
    "gb18030": "天地玄黄，宇宙洪荒。日月盈昃，辰宿列张",
    "big5": "天地玄黃，宇宙洪荒。日月盈昃，辰宿列張",
}


@pytest.mark.parametrize("name", TEXTS)
def test_each_encoding(spark, tmp_path, name):
    lines = ["id,text", *(f"{i};{TEXTS[name].replace(',', '')}".replace(";", ",") for i in range(40))]
    df = formats.load(spark, write(tmp_path / "a.csv", "\n".join(lines).encode(name)), clean=False).df
    assert rows(df) == rows(spark.createDataFrame([(i, TEXTS[name].replace(",", "")) for i in range(40)], "id int, text string"))


def test_late_bytes_load_exactly(spark, tmp_path):
    plain = [f"{i},row {i}" for i in range(5000)]
    late = ["5000,José", "5001,Zoë"]
    path = write(tmp_path / "late.csv", "\n".join(["id,name", *plain]).encode() + b"\n" + "\n".join(late).encode("latin-1") + b"\n")
    found = formats.load(spark, path, clean=False)
    got = dict(rows(found.df))
    assert len(got) == 5002 and got[5000] == "José" and got[5001] == "Zoë" and found.shield.n_quarantined == 0
    assert found.shield.facts.encoding == "cp1252"


def test_a_folder_of_several_encodings(spark, tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    for i, name in enumerate(["utf-8", "cp1252", "cp1251", "utf-8"]):
        text = TEXTS["cp1251"] if name == "cp1251" else TEXTS["cp1252"]
        write(folder / f"{i}.csv", f"id,text\n{i},{text.replace(',', '')}\n".encode(name))
    got = dict(rows(formats.load(spark, str(folder), clean=False).df))
    assert got == {i: (TEXTS["cp1251"] if i == 2 else TEXTS["cp1252"]).replace(",", "") for i in range(4)}


def test_one_file_of_two_encodings(spark, tmp_path):
    body = b"".join(f"{i},naïve {i}\n".encode("utf-8" if i % 2 else "latin-1") for i in range(50))
    got = dict(rows(formats.load(spark, write(tmp_path / "m.csv", b"id,t\n" + body), clean=False).df))
    assert got == {i: f"naïve {i}" for i in range(50)}


def test_valid_by_chance_in_a_file_of_another_encoding(spark, tmp_path):
    body = "".join(f"{i},prix café {i}\n" for i in range(60)) + "60,Ã© odd\n"
    lines = encodings.decoded(encodings.lines_of(spark, path := write(tmp_path / "c.csv", ("id,t\n" + body).encode("latin-1"))), encodings.encodings(encodings.lines_of(spark, path)))
    assert "60,Ã© odd" in {r.value for r in lines.collect()}


def test_what_fits_none_is_quarantined(spark, tmp_path):
    lines = [b"id,t", *(f"{i},été {i}".encode("latin-1") for i in range(400)), b"400,\x81\x8d\x8f"]
    found = shield.shield(spark, write(tmp_path / "q.csv", b"\n".join(lines)))
    assert (found.n_valid, found.n_quarantined) == (401, 1)
    assert [(r.line_no, r.reason) for r in found.quarantined.collect()] == [(402, "unreadable")]
    as_json = [b'{"a": "\xe9t\xe9"}'] * 400 + [b'{"a": "\x81\x8d"}']
    found = shield.shield(spark, write(tmp_path / "q.ndjson", b"\n".join(as_json)), as_json=True)
    assert (found.n_valid, found.n_quarantined) == (400, 1) and found.valid.first().value == '{"a": "été"}'


def test_utf_16_and_plain_files(spark, tmp_path):
    got = formats.load(spark, write(tmp_path / "w.csv", "id,t\n1,été\n2,漢字\n".encode("utf-16")), clean=False)
    assert rows(got.df) == [(1, "été"), (2, "漢字")] and got.shield.facts.encoding == "utf-16"
    for text in ("", "id,t\n1,plain\n", "id,t\n1,漢字 😀\n"):
        assert encodings.read_lines(spark, write(tmp_path / "u.csv", text))[1] == "utf-8"


def test_counts_merge_whatever_the_splits(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        write(folder / f"{i}.txt", ("\n".join(f"{TEXTS['cp1252']} {j}" for j in range(200)) + "\n").encode("latin-1", "ignore"))
    few, many = [], []
    for size, out in (("128MB", few), ("4KB", many)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        lines = encodings.lines_of(spark, str(folder))
        out += [lines.rdd.getNumPartitions(), rows(encodings.histogram(lines)), rows(encodings.encodings(lines))]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert many[0] > few[0] and few[1:] == many[1:] and {r[4] for r in few[2]} == {"cp1252"}
