"""The encoding of each file, from all of its lines.

Spark's text reader cuts lines at the byte 10 and leaves their bytes as they are, so a file in any encoding that has ASCII in it is read
by as many tasks as it has splits. One aggregation counts, for each file, the lines that aren't UTF-8 and the lines that are and hold more
than ASCII. Only files with lines of the first kind are looked at again, and of those only these lines: their high bytes are counted with
the byte before them, and so are the lines that each multi-byte encoding can read. These counts merge by adding, whatever the splits; one
decision a file is made from them:

* high bytes that mostly follow one another, in lines that a multi-byte encoding reads (0.99 of them) and mostly as its own script: that encoding;
* else the one-byte encoding under which they make the most letters, and letters whose case fits their neighbours'; the usual
  one for Latin letters comes first where several are as good.

A file that holds lines of both kinds is mixed: if at least a tenth of its lines beyond ASCII are UTF-8, those stay UTF-8, and the others are read
in the file's other encoding. In a file with fewer, a line that could be UTF-8 is so by chance. A line with a byte that its encoding
doesn't have is no guess: it is marked, and the shield quarantines it.

Files that begin with the mark of UTF-16 have no byte 10 of their own and are read whole, each by one task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinsework.session import staged

#: One-byte encodings, by preference, and multi-byte ones, by preference too, each with the script that speaks for it.
ONE_BYTE = ["cp1252", "cp1250", "cp1251", "koi8_r", "cp1253", "cp1254", "cp1255", "cp1256", "iso8859_2", "iso8859_5", "iso8859_7", "cp437", "cp850", "cp866", "mac_roman"]
MANY_BYTES = {"euc_jp": "ぁ-ヿ", "shift_jis": "ぁ-ヿ", "euc_kr": "가-힣", "gb2312": "一-鿿", "big5": "一-鿿", "gb18030": "一-鿿"}
OWN = {"euc_jp": 0.1, "shift_jis": 0.1, "euc_kr": 0.8}  # the least share of that script in a line; elsewhere half
UTF_8, MIXED = "utf-8", 0.1
SIGNS = "’‘“”„»«…€°–—\u00a0"  # fixed values: signs that texts of any kind have
STRAY = 0.01  # of the high bytes may mean nothing: those are damage, and don't speak against an encoding
HIGH = "".join(map(chr, range(128, 256)))
MISFIT = "�"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """value (bytes as they are, typed as text), file."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def _beyond(c: Column) -> Column:
    """Valid UTF-8 that isn't ASCII alone."""
    return F.is_valid_utf8(c) & (F.length(c) != F.octet_length(c))


def validity(lines: DataFrame) -> DataFrame:
    """file, n, bad (not UTF-8), beyond (UTF-8 and more than ASCII), wide (the mark of UTF-16)."""
    mark = F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).isin("FFFE", "FEFF")
    return lines.groupBy("file").agg(F.count("*").alias("n"), F.count_if(~F.is_valid_utf8("value")).alias("bad"), F.count_if(_beyond(F.col("value"))).alias("beyond"), F.coalesce(F.max(mark), F.lit(False)).alias("wide"))


def histogram(lines: DataFrame) -> DataFrame:
    """file, kind, key, n over lines that aren't UTF-8: pairs of a byte and a high one ("pair", 256 * first + second), high bytes that stand beside another
    ("run"), lines ("lines"), and lines that a multi-byte encoding can read ("reads", its place) and that are in its script then ("speaks")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            counts.update(_counts(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
            if len(counts) > 100_000:
                yield _counted(counts)
                counts = Counter()
        if counts:
            yield _counted(counts)

    bad = lines.filter(~F.is_valid_utf8("value")).select(F.col("value").cast("binary").alias("raw"), "file")
    return bad.mapInArrow(run, "file string, kind string, key int, n long").groupBy("file", "kind", "key").agg(F.sum("n").alias("n"))


CODECS = [(i, name, re.compile(f"[{own}]"), OWN.get(name, 0.5)) for i, (name, own) in enumerate(MANY_BYTES.items())]


def _counts(lines: Iterable[tuple[bytes, str]]) -> Counter:
    """(file, kind, key) of lines with their file."""
    counts: Counter = Counter()
    for raw, file in lines:
        counts[file, "lines", 0] += 1
        before = 10
        for x in raw:
            if x >= 128:
                counts[file, "pair", 256 * before + x] += 1
            before = x
        counts[file, "run", 0] += sum(map(len, re.findall(rb"[\x80-\xff]{2,}", raw)))
        for i, name, own, least in CODECS:
            try:
                text = raw.decode(name)
            except UnicodeDecodeError:
                continue
            counts[file, "reads", i] += 1
            counts[file, "speaks", i] += len(own.findall(text)) >= least * sum(not c.isascii() and c.isalpha() for c in text)
    return counts


def _counted(counts: Counter) -> pa.RecordBatch:
    files, kinds, keys = zip(*counts, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(files), pa.array(kinds), pa.array(keys, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["file", "kind", "key", "n"])


def _table(encoding: str) -> str:
    """What the bytes from 128 on mean; U+FFFD where they mean nothing."""
    return "".join(MISFIT if 128 <= ord(c) < 160 else c for c in (bytes([b]).decode(encoding, "replace") for b in range(128, 256)))


def _latin(letter: str) -> bool:
    return unicodedata.name(letter, "").startswith("LATIN")


def plausibility(pairs: dict[int, int], encoding: str) -> float:
    """Mean over the high bytes: a letter is good, in the script and the case of the letter before it; a sign that may stand in a text is
    middling; other signs after a letter, a capital after a small letter and, if they are many, bytes that mean nothing are bad."""
    meaning, total, size, misfits = _table(encoding), 0.0, 0, 0
    for key, n in pairs.items():
        first, second = divmod(key, 256)
        before, own = chr(first) if first < 128 else meaning[first - 128], meaning[second - 128]
        if own == MISFIT:
            misfits += n
            continue
        if own.isalpha() and before.isalpha() and before.isascii() and not _latin(own):
            value = -1.0  # two scripts in one word
        elif own.isalpha():
            value = 1.0 if not before.isalpha() or own.islower() == before.islower() or before.isupper() else -1.0
            value -= 0.5 * (own in "ıſƒªº")  # hardly a letter of a word
        else:
            value = 1.0 if own in SIGNS else -0.5 if before.isalpha() else 0.2
        total, size = total + n * value, size + n
    return total / max(size, 1) - (4.0 * misfits / max(size + misfits, 1) if misfits > STRAY * (size + misfits) else 0.0)


def decide(counts: pd.DataFrame) -> str:
    """The encoding of the lines that were counted. counts: kind, key, n of one file."""
    by = {kind: dict(zip(own["key"].tolist(), own["n"].tolist(), strict=True)) for kind, own in counts.groupby("kind")}
    pairs, lines = by.get("pair", {}), by.get("lines", {}).get(0, 0)
    if by.get("run", {}).get(0, 0) >= 0.5 * max(sum(pairs.values()), 1):
        told = [name for i, name in enumerate(MANY_BYTES) if by.get("reads", {}).get(i, 0) >= 0.99 * lines and by.get("speaks", {}).get(i, 0) >= 0.5 * lines]
        if told and max(plausibility(pairs, e) for e in ONE_BYTE) < 0.9:
            return told[0]
    return max(ONE_BYTE, key=lambda e: plausibility(pairs, e))


def decode_text(raw: bytes) -> str:
    """One text that is held whole: UTF-8 if it is, else the encoding that its own bytes speak for."""
    try:
        return raw.decode(UTF_8)
    except UnicodeDecodeError:
        if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return raw.decode("utf-16", "replace")
        rows = [(kind, key, n) for (_, kind, key), n in _counts([(x, "") for x in raw.split(b"\n") if not _is_utf8(x)]).items()]
        return raw.decode(decide(pd.DataFrame(rows, columns=["kind", "key", "n"])), "replace")


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode(UTF_8)
    except UnicodeDecodeError:
        return False
    return True


def encodings(lines: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """file, n, bad, beyond, encoding, mixed: one row for each file. found: validity(lines), if it is known."""
    found = validity(lines) if found is None else found
    one = lambda own: pd.DataFrame({"file": own["file"].iloc[:1], "encoding": [decide(own)]})
    told = histogram(lines).groupBy("file").applyInPandas(one, "file string, encoding string")  # a file's counts: at most 33,000 rows
    share = F.col("beyond") >= MIXED * (F.col("bad") + F.col("beyond"))
    both = found.join(told, "file", "left")
    return both.select("file", "n", "bad", "beyond", F.when(F.col("wide"), "utf-16").otherwise(F.coalesce("encoding", F.lit(UTF_8))).alias("encoding"), ((F.col("bad") > 0) & share & ~F.col("wide")).alias("mixed"))


def decoded(lines: DataFrame, told: DataFrame) -> DataFrame:
    """lines (value, file, ...) as text, with misfit: whether a line holds a byte that its encoding doesn't have. told: encodings(), a row a file."""
    used = [r[0] for r in told.select("encoding").distinct().collect()]  # encodings, not files
    joined = lines.join(told.select("file", "encoding", "mixed"), "file", "left")
    bare = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    keep = (F.col("encoding") == UTF_8) | F.is_valid_utf8("value") & (F.col("mixed") | (F.length("value") == F.octet_length("value")))
    text = F.when(keep, F.col("value"))
    for name in used:
        if name in ONE_BYTE:
            text = text.when(F.col("encoding") == name, F.translate(bare, HIGH, _table(name)))
        elif name in MANY_BYTES:
            text = text.when(F.col("encoding") == name, _reader(name)(F.col("value").cast("binary")))
    text = text.otherwise(F.col("value"))
    odd = ~keep & F.contains("_text", F.lit(MISFIT))
    return joined.withColumn("_text", text).withColumn("misfit", odd).withColumn("value", F.col("_text")).drop("_text", "encoding", "mixed")


def _reader(name: str):  # noqa: ANN202 (a pandas UDF)
    @F.pandas_udf("string")
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else bytes(x).decode(name, "replace"))

    return read


def _whole(spark: SparkSession, files: list[str]) -> DataFrame:
    """Lines of UTF-16 files; each file is one task's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, path in zip(b["content"], b["path"], strict=True):
                lines = bytes(content).decode("utf-16", "replace").split("\n")
                for at in range(0, len(lines), 10_000):
                    own = lines[at : at + 10_000]
                    yield pd.DataFrame({"value": own, "file": path, "misfit": [MISFIT in x for x in own]})

    return spark.read.format("binaryFile").load(files).select("content", F.col("_metadata.file_path").alias("path")).mapInPandas(run, "value string, file string, misfit boolean")


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(value, file, misfit) of all lines, each file in its own encoding, and the encoding of the first file by name that isn't UTF-8, or that.

    Where all is UTF-8, as mostly, that costs one aggregation and no join."""
    lines = lines_of(spark, path)
    found = staged(validity(lines), "validity")
    some = found.agg(F.sum("bad"), F.max("wide")).first()
    if not some[0] and not some[1]:
        return lines.withColumn("misfit", F.lit(False)), UTF_8
    told = staged(encodings(lines, found), "encodings")
    first = told.filter(F.col("encoding") != UTF_8).agg(F.min_by("encoding", "file")).first()[0]
    wide = [r.file for r in told.filter("encoding = 'utf-16'").select("file").collect()]  # read whole: few
    narrow = told.filter("encoding <> 'utf-16'")
    out = decoded(lines.join(narrow.select("file"), "file", "left_semi") if wide else lines, narrow)
    return (out.unionByName(_whole(spark, wide)) if wide else out), first or UTF_8
