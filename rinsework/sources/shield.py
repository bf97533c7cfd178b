"""The shield: what raw lines must pass before they are parsed. Each line is classified by expressions over itself and three
facts: the encoding of each file, from all of its lines, and the delimiter and the expected count, from the first ones; valid and quarantined lines are
filters of one classified DataFrame."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinsework.session import staged
from rinsework.sources.encodings import read_lines

MAX_BYTES = 500 * 2**20
DELIMITERS = [",", "\t", ";", "|"]
QUOTED_FIELD = r'"(?:[^"]|"")*"'


class QuotaExceeded(RuntimeError):
    """The input holds more bytes than allowed."""


@dataclass
class Facts:
    delimiter: str = ","
    expected: int | None = None
    header: str = ""
    encoding: str = "utf-8"


@dataclass
class ShieldResult:
    """valid: value, every line that passed; body: the same without the header lines at the head of files."""

    facts: Facts
    valid: DataFrame
    body: DataFrame
    quarantined: DataFrame
    n_valid: int
    n_quarantined: int
    n_bytes: int
    null_bytes: bool


def total_bytes(spark: SparkSession, path: str) -> int:
    """From the files' metadata: nothing is read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(at) or []
    if not found:
        raise FileNotFoundError(path)
    return sum(fs.getContentSummary(s.getPath()).getLength() for s in found)


def check_quota(spark: SparkSession, path: str, most: int = MAX_BYTES) -> int:
    n = total_bytes(spark, path)
    if n > most:
        raise QuotaExceeded(f"{path} holds {n} bytes; at most {most} are allowed")
    return n


def first_bytes(spark: SparkSession, path: str, n: int = 65_536) -> bytes:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(at) or []
    if not found:
        raise FileNotFoundError(path)
    files = sorted((s for s in found if s.isFile()), key=lambda s: s.getPath().toString())
    if not files:
        return b""
    stream = fs.open(files[0].getPath())
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def detect_delimiter(lines: list[str]) -> str:
    """The delimiter with the highest mean count for its variance over the first lines."""
    lines = [x for x in lines if x.strip()][:30]

    def score(d: str) -> float:
        counts = [x.count(d) for x in lines]
        mean = math.fsum(counts) / len(counts)
        return mean / (1 + math.fsum((c - mean) ** 2 for c in counts) / len(counts))

    best = max(DELIMITERS, key=score) if lines else ","
    return best if lines and score(best) > 0 else ","


def count_fields(line: str, delimiter: str, quotes: bool = True) -> int:
    return (re.sub(QUOTED_FIELD, "", line) if quotes else line).count(delimiter)


def expected_count(lines: list[str], delimiter: str, quotes: bool = True) -> int | None:
    counts = sorted(count_fields(x, delimiter, quotes) for x in [x for x in lines if x.strip()][:20])
    return counts[len(counts) // 2] if counts else None


def facts_of(lines: list[str], encoding: str = "utf-8", delimiter: str | None = None, quotes: bool = True) -> Facts:
    lines = [x.replace("\x00", "") for x in lines]
    delimiter = delimiter or detect_delimiter(lines)
    return Facts(delimiter, expected_count(lines, delimiter, quotes), next((x for x in lines if x.strip()), ""), encoding)


def mend(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 is turned back, where all of it can be; only lines with such traces are touched."""
    back = F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))
    fits = ~c.rlike(r"[^\u0000-ÿ]") & c.rlike(r"[Â-ô][\u0080-¿]")
    return F.when(fits, F.coalesce(back, c)).otherwise(c)


def delimiters(line: Column, delimiter: str, quotes: bool = True) -> Column:
    bare = F.regexp_replace(line, QUOTED_FIELD, "") if quotes else line
    return F.length(bare) - F.length(F.translate(bare, delimiter, ""))


def reason(n: Column, expected: Column, first: Column) -> Column:
    """Why a line of text is quarantined, or null."""
    return (
        F.when(expected.isNotNull() & (n > F.greatest(3 * expected, expected + 15)), "delimiter_bomb")
        .when(~first & expected.isNotNull() & (F.abs(n - expected) >= 1), "ragged_row")
        .when(expected.isNull() & (n > 100), "extreme_density")
    )


def classify(lines: DataFrame, facts: Facts, quotes: bool = True) -> DataFrame:
    """line, n, reason, had_null of each line that isn't blank, beside the other columns. lines: value."""
    clean, rest = mend(F.translate("value", "\u0000", "")), [c for c in lines.columns if c != "value"]
    out = lines.select(*rest, F.regexp_replace(clean, r"\r$", "").alias("line"), F.contains("value", F.lit("\u0000")).alias("had_null")).filter(F.trim("line") != "")
    n = delimiters(F.col("line"), facts.delimiter, quotes)
    return _unreadable(out.withColumn("n", n).withColumn("reason", reason(F.col("n"), F.lit(facts.expected).cast("int"), F.col("line") == F.lit(facts.header))))


def _unreadable(classified: DataFrame) -> DataFrame:
    """A line that its file's encoding can't read comes first, whatever its fields. misfit: from read_lines(), if the lines have it."""
    if "misfit" not in classified.columns:
        return classified
    return classified.withColumn("reason", F.when(F.col("misfit"), "unreadable").otherwise(F.col("reason"))).drop("misfit")


def classify_json(lines: DataFrame) -> DataFrame:
    """The same for lines that must be JSON each."""
    out = lines.select(*(c for c in lines.columns if c != "value"), F.trim(F.translate("value", "\u0000", "")).alias("line"), F.contains("value", F.lit("\u0000")).alias("had_null")).filter("line <> ''")
    return out.withColumn("n", F.lit(0)).withColumn("reason", F.when(F.try_parse_json("line").isNull(), "invalid_json")).transform(_unreadable)


def numbered(staged_lines: DataFrame) -> DataFrame:
    """With line_no, from 1, over all lines that aren't blank. _id: as monotonically_increasing_id() gave them when the lines were
    written, so that they are the same in every job; a count for each partition comes to the driver, no row moves."""
    at = staged_lines.withColumn("_p", F.shiftright("_id", 33))
    sizes = at.groupBy("_p").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    before = sizes.select("_p", "first", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))  # a row for each partition
    return at.join(F.broadcast(before), "_p").withColumn("line_no", F.col("_id") - F.col("first") + F.col("_before") + 1).drop("_p", "first", "_before")


def shield(spark: SparkSession, path: str, most: int = MAX_BYTES, delimiter: str | None = None, quotes: bool = True, as_json: bool = False) -> ShieldResult:
    n_bytes = check_quota(spark, path, most)
    lines, encoding = read_lines(spark, path)
    head = [r["value"] for r in lines.limit(200).collect()]
    facts = facts_of(head, encoding, delimiter, quotes)
    classified = (classify_json(lines) if as_json else classify(lines, facts, quotes)).withColumn("_id", F.monotonically_increasing_id())
    classified = staged(classified, "lines")
    s = classified.agg(F.count_if(F.col("reason").isNull()).alias("good"), F.count("reason").alias("bad"), F.max("had_null").alias("nulls")).first()
    log = numbered(classified).filter("reason is not null").select("line_no", "reason", F.substring("line", 1, 250).alias("data"))
    good = classified.filter("reason is null")
    heads = classified.groupBy("file").agg(F.min("_id").alias("_id"))  # the first line of each file that isn't blank
    is_header = F.col("line") == F.lit(facts.header)
    body = good.filter(~is_header).unionByName(good.filter(is_header).join(heads.select("_id"), "_id", "left_anti"))
    value = F.col("line").alias("value")
    return ShieldResult(facts, good.select(value), body.select(value), log, s["good"], s["bad"], n_bytes, bool(s["nulls"]))


def quarantine_lines(log: DataFrame) -> DataFrame:
    """The log's text form."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return log.select(F.concat(F.lit("["), stamp, F.lit("] [QUARANTINE] line="), F.col("line_no").cast("string"), F.lit(" reason="), "reason", F.lit(" data="), "data").alias("value"))
