"""Entities in texts and tables. Spark's own functions say what a pattern matches but not where, and links need places, so
texts go through Arrow batches; everything after that is DataFrame operations on rows of ENTITY."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.functions import constants as K
from rinsework.functions.text import date_iso, phone_e164
from rinsework.session import prepare
from rinsework.sources.documents import table_cells

ENTITY = "doc_id string, type string, value string, span_start int, span_end int, page int, record_id string, confidence double"
#: Kind, pattern, group that holds the value, confidence; the order decides who gets a span that two kinds match.
PATTERNS = [(kind, re.compile(form), group, K.DOC_CONFIDENCE[kind]) for kind, form, group in K.DOC_KINDS]
BOUNDARY = re.compile(K.DOC_BOUNDARY)
LINE_NAME = re.compile(r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})$", re.M)
PLACES = {k: ("City", v, 0.96) for k, v in K.CITY_CANONICAL.items()}
STATES = {k: ("State", k.title(), 0.95) for k in [*K.INDIAN_STATES, *K.US_STATES] if k not in K.CITY_CANONICAL} | {"telengana": ("State", "Telangana", 0.95)}
#: Names of several words come first, so that their parts don't match alone.
GAZETTEER = re.compile(r"\b(?:" + "|".join(re.escape(x) for x in sorted(PLACES | STATES, key=lambda x: (-len(x), x))) + r")\b", re.I)


NOT_NAMES = frozenset([*K.NOT_IN_NAMES, *K.CITIES, *K.INDIAN_STATES, *K.US_STATES])


def plausible_name(words: str) -> bool:
    """Two to four capitalised words, none of which is a heading's, a city's or a state's."""
    bare = [w.strip(K.NAME_EDGES) for w in words.split()]
    alike = re.fullmatch(K.NAME_WORDS, " ".join(bare)) is not None and all(bare)
    return alike and words.strip().lower() not in K.CITY_CANONICAL and NOT_NAMES.isdisjoint(w.lower() for w in bare)


def blocks(text: str) -> list[tuple[int, int]]:
    """Places of the records of a text: parts between blank lines, cut again before a record's label."""
    cuts = [(m.start(), m.end()) for m in BOUNDARY.finditer(text)]
    starts, ends = [0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(text)]
    found = [(a, b) for a, b in zip(starts, ends, strict=True) if text[a:b].strip()]
    return found or [(0, len(text))]


#: Characters beside their own two cases that a letter matches where case is ignored.
FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
UNFOLDED = str.maketrans({odd: c for c, own in FOLDED.items() for odd in own})


def _any_case(*words: str) -> str:
    return "(?:" + "|".join("".join(f"[{x}{x.upper()}{FOLDED.get(x, '')}]" if x.isalpha() else re.escape(x) for x in w) for w in words) + ")"


@cache
def screens() -> dict[str, str]:
    """For each kind, and for lines that are names and places, what a text must hold to have one: regular expressions that Arrow
    runs over whole columns in linear time. They let more through than the patterns do, never less."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    listed = lambda form: "".join(f"\\x{{{ord(a):x}}}-\\x{{{ord(x[-1]):x}}}" for x in _runs(re.findall(form, every)) for a in x[:1])
    d, s, case = f"[{listed(r'\d')}]", listed(r"\s"), _any_case
    end, begin = r"(?:\z|[^A-Za-z0-9_])", r"(?:\A|[^A-Za-z0-9_])"
    street = case("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "nagar", "colony", "hills", "banjara", "sector", "plaza", "floor")
    return {
        "InvoiceNo": f"{case('invoice', 'bill', 'receipt', 'inv')}[-#:{s}]",
        "Email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]",
        "Phone": f"{d}{{3}}[-.{s}]?{d}{{4}}",
        "Date": f"{d}[-/.]{d}{{1,2}}[-/.]{d}",
        "Amount": f"(?:[$€£₹]|{case('usd', 'eur', 'gbp', 'inr', 'rs')}\\.?)[{s}]*(?:{d}|,)|(?:{d}|,)[{s}]*{case('usd', 'eur', 'inr')}",
        "CustomerName": f"{case('customer', 'client', 'name', 'to', 'contact', 'person')}[{s}]*[:-]|{case('mr', 'ms', 'mrs')}\\.",
        "PostalCode": f"{d}{{5}}",
        "Address": f"{d}[/A-Za-z0-9,{''.join(FOLDED.values())}{s}-]+[{s}]{street}{end}",
        "Place": f"{begin}{case(*sorted(PLACES | STATES))}{end}",
        "Line": f"(?m)^[A-Z][a-z]+[{s}]+[A-Z][a-z]+(?:[{s}]+[A-Z][a-z]+)?$",
    }


def _runs(characters: list[str]) -> list[list[str]]:
    """Characters in order, cut where one isn't the next."""
    out: list[list[str]] = []
    for c in characters:
        if out and ord(c) == ord(out[-1][-1]) + 1:
            out[-1].append(c)
        else:
            out.append([c])
    return out


def may_hold(texts: pa.Array) -> dict[int, set[str]]:
    """Row number and kinds of the texts that may hold any."""
    out: dict[int, set[str]] = {}
    for kind, form in screens().items():
        for i in pc.indices_nonzero(pc.match_substring_regex(texts, form)).to_pylist():
            out.setdefault(i, set()).add(kind)
    return out


def find(text: str, page: int = 1, skip_tables: bool = False, kinds: set[str] | None = None) -> Iterator[tuple[str, str, int, int, int, str, float]]:
    """(type, value, start, end, page, record_id, confidence) in the order in which they are found. kinds: those of screens() that
    the text may hold, all if not given."""
    kinds = kinds if kinds is not None else set(screens())
    for number, (begin, end) in enumerate(blocks(text)):
        own, record, seen = text[begin:end], f"p{page}_b{number}", set()
        lines = [x.strip() for x in own.splitlines() if x.strip()]
        if all(x.startswith("#") for x in lines) or skip_tables and len(lines) > 1 and all(x.startswith("|") for x in lines):
            continue
        breaks = [m.start() for m in re.finditer("\n", own)]

        def line_at(start: int, stop: int, own: str = own, breaks: list[int] = breaks) -> str:
            i, j = bisect.bisect_left(breaks, start), bisect.bisect_left(breaks, stop)
            return own[breaks[i - 1] + 1 if i else 0 : breaks[j] if j < len(breaks) else len(own)]

        for kind, form, group, confidence in PATTERNS:
            for m in form.finditer(own) if kind in kinds else ():
                g = group if group is not None else (1 if m[1] else 2)
                value, place = m[g].strip(), m.span(g)
                if place in seen or kind == "CustomerName" and not plausible_name(value):
                    continue
                if kind == "PostalCode" and any(w in line_at(*place).lower() for w in K.NOT_POSTAL):
                    continue
                seen.add(place)
                yield kind, value, begin + place[0], begin + place[1], page, record, confidence
        for m in GAZETTEER.finditer(own) if "Place" in kinds else ():
            kind, _, confidence = (PLACES | STATES)[m[0].translate(UNFOLDED).lower()]
            if m.span() not in seen:
                seen.add(m.span())
                yield kind, m[0], begin + m.start(), begin + m.end(), page, record, confidence
        for m in LINE_NAME.finditer(own) if "Line" in kinds else ():
            if m.span() not in seen and plausible_name(m[1]):
                seen.add(m.span())
                yield "CustomerName", m[1].strip(), begin + m.start(), begin + m.end(), page, record, 0.89


def normalized(kind: Column, value: Column) -> Column:
    cities = F.create_map(*(F.lit(x) for pair in K.CITY_CANONICAL.items() for x in pair))
    state = F.when(F.lower(value) == "telengana", F.lit("Telangana")).otherwise(F.initcap(value))
    return (
        F.when(kind == "Email", F.lower(value))
        .when(kind == "Phone", phone_e164(value))
        .when(kind == "Date", date_iso(value))
        .when(kind == "City", F.coalesce(F.try_element_at(cities, F.lower(value)), F.initcap(value)))
        .when(kind == "State", state)
        .when(kind.isin("CustomerName", "Address"), F.initcap(value))
        .otherwise(value)
    )


def with_ids(entities: DataFrame) -> DataFrame:
    """normalized_value, and an entity_id that follows from the content."""
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "type", "value", "span_start", "span_end", "page", "record_id")))
    return entities.withColumns({"normalized_value": normalized(F.col("type"), F.col("value")), "entity_id": F.concat(F.lit("ent_"), F.substring(F.sha2(key, 256), 1, 16))})


def extract(texts: DataFrame, skip_tables: bool = False) -> DataFrame:
    """ENTITY, normalized_value and entity_id. texts: doc_id, page (null: 1), text. skip_tables: leave tables of bars to from_tables().
    Every text is screened whole; a pattern then runs over the texts that can hold its matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pages, own = b.column("doc_id"), b.column("page"), b.column("text")
            rows = [(ids[i].as_py(), *e) for i, kinds in sorted(may_hold(own).items()) for e in find(own[i].as_py(), pages[i].as_py(), skip_tables, kinds)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    text, whole = pa.string(), pa.int32()
    schema = pa.schema([("doc_id", text), ("type", text), ("value", text), ("span_start", whole), ("span_end", whole), ("page", whole), ("record_id", text), ("confidence", pa.float64())])
    prepare(texts.sparkSession)
    return with_ids(texts.select("doc_id", F.coalesce(F.col("page").cast("int"), F.lit(1)).alias("page"), "text").mapInArrow(run, ENTITY))


def from_tables(docs: DataFrame) -> DataFrame:
    """The same from the cells of documents' tables: a column's header says what its cells are; a row is a record."""
    cells = table_cells(docs).filter("trim(value) <> ''")
    kind = F.lit(None).cast("string")
    low = F.lower("column_name")
    for name, words in reversed(K.HEADERS):
        test = F.lit(False)
        for w in words:
            test |= F.contains(low, F.lit(w))
        kind = F.when(test, F.lit(name)).otherwise(kind)
    found = cells.withColumn("type", kind).filter("type is not null")
    return with_ids(
        found.select(
            "doc_id", "type", F.trim("value").alias("value"), (F.col("row") * 100).cast("int").alias("span_start"), (F.col("row") * 100 + F.length("value")).cast("int").alias("span_end"), F.col("page").cast("int").alias("page"),
            F.concat_ws("_", "table_id", F.lit("r"), F.col("row").cast("string")).alias("record_id"), F.lit(0.98).alias("confidence"),
        )
    )


def dedupe(entities: DataFrame) -> DataFrame:
    """One entity for each type, value (in any case), page and record: the most confident, then the first."""
    key = ["doc_id", "type", "_low", "page", "record_id"]
    row = F.struct(*entities.columns)
    best = F.min_by(row, F.struct((-F.col("confidence")).alias("c"), F.col("span_start"), F.col("entity_id")))
    return entities.withColumn("_low", F.lower("value")).groupBy(*key).agg(best.alias("e")).select("e.*")


def counts(texts: DataFrame) -> DataFrame:
    """type, n by Spark's own functions alone, where places don't matter."""
    kinds = {"Email": K.DOC_EMAIL, "Date": K.DOC_DATE, "Invoice": K.DOC_INVOICE, "Postal": K.DOC_POSTAL}
    row = F.array(*(F.struct(F.lit(k).alias("type"), F.sum(F.coalesce(F.regexp_count("text", F.lit(v)), F.lit(0)).cast("long")).alias("n")) for k, v in kinds.items()))
    return texts.agg(row.alias("r")).select(F.inline("r"))
