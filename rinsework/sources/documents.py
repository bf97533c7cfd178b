"""Documents as rows: TXT and DOCX by the standard library, PDF only where a reader is installed. A corpus is read by
binaryFile and parsed where it is read; every document is one row with nested headings, sections and tables."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinsework.session import prepare
from rinsework.sources.encodings import decode_text
from rinsework.sources.formats import UnsupportedFormat, _unique

MAX_BYTES = 20 * 2**20
SCHEMA = (
    "doc_id string, path string, file_type string, text string, headings array<struct<title:string,level:int,section:int>>, "
    "sections array<struct<title:string,content:string,page:int>>, tables array<struct<table_id:string,header:array<string>,rows:array<array<string>>,page:int>>, n_chars long, is_scanned boolean"
)
DIVIDER = re.compile(r"\|?[\s\-:|]+\|?")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _heading(line: str) -> tuple[str, int] | None:
    if line.startswith("#"):
        return line.lstrip("#").strip(), 1 if line.startswith("# ") else 2
    return (line, 2) if len(line) >= 3 and line.isupper() else None


def _pipe_table(lines: list[str]) -> tuple[list[str], list[list[str]]] | None:
    if len(lines) < 2 or not all("|" in x for x in lines):
        return None
    cells = [[c.strip() for c in x.strip("|").split("|")] for x in lines if not DIVIDER.fullmatch(x)]
    if len(cells) < 2:
        return None
    header = _unique(cells[0])
    return header, [(r + [""] * len(header))[: len(header)] for r in cells[1:]]


def parse_txt(text: str) -> dict[str, Any]:
    text = text.replace("\x00", "")
    headings, sections, tables, title = [], [], [], "General"
    for part in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text))):
        lines = [x.strip() for x in part.splitlines() if x.strip()]
        if found := _heading(lines[0]):
            title = found[0]
            headings.append({"title": title, "level": found[1], "section": len(sections)})
        if table := _pipe_table(lines):
            tables.append({"table_id": f"txt_tbl_{len(tables) + 1}", "header": table[0], "rows": table[1], "page": 1})
        sections.append({"title": title, "content": part, "page": 1})
    return {"file_type": "txt", "text": text, "headings": headings, "sections": sections, "tables": tables, "is_scanned": False}


def parse_docx(content: bytes) -> dict[str, Any]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    headings, sections, tables, lines, title = [], [], [], [], "General"
    for e in body if body is not None else []:
        if e.tag == f"{W}p":
            words = said(e).strip()
            style = e.find(f"{W}pPr/{W}pStyle")
            level = re.fullmatch(r"(?:Heading|Title)\s*(\d*)", style.get(f"{W}val", "") if style is not None else "")
            if words and level:
                title = words
                headings.append({"title": words, "level": int(level[1] or 1), "section": len(sections)})
            if words:
                sections.append({"title": title, "content": words, "page": 1})
                lines.append(words)
        elif e.tag == f"{W}tbl":
            rows = [[said(c).strip() for c in r.iter(f"{W}tc")] for r in e.iter(f"{W}tr")]
            if rows:
                header = _unique(rows[0])
                tables.append({"table_id": f"docx_tbl_{len(tables) + 1}", "header": header, "rows": [(r + [""] * len(header))[: len(header)] for r in rows[1:]], "page": 1})
                lines += [" | ".join(r) for r in rows]
    return {"file_type": "docx", "text": "\n".join(lines), "headings": headings, "sections": sections, "tables": tables, "is_scanned": False}


def parse_pdf(content: bytes) -> dict[str, Any]:
    """By whichever reader of PDF is installed; a page with under 50 characters on the mean is taken as scanned."""
    try:
        import pypdf
    except ImportError as e:
        raise UnsupportedFormat("no reader of PDF is installed") from e
    pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
    out = parse_txt(re.sub(r"(?<![.!?:])\n\n(?=[a-z])", " ", "\n\n".join(pages)))
    return out | {"file_type": "pdf", "is_scanned": sum(map(len, pages)) / max(1, len(pages)) < 50}


def ocr(content: bytes, engine: Any = None) -> dict[str, Any]:
    """With an engine (a function from bytes to text) only."""
    return {"text": "", "skipped": True} if engine is None else {"text": engine(content), "skipped": False}


def parse(path: str, content: bytes) -> dict[str, Any]:
    if len(content) > MAX_BYTES:
        raise ValueError(f"{path} holds {len(content)} bytes; at most {MAX_BYTES} are allowed")
    low = path.lower()
    if low.endswith(".txt"):
        return parse_txt(decode_text(content))
    if low.endswith(".docx"):
        return parse_docx(content)
    if low.endswith(".pdf"):
        return parse_pdf(content)
    raise UnsupportedFormat(path)


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """path, length, name of every file, none of which is opened."""
    return prepare(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.lower("path").alias("name"))


def _known(name: Column) -> Column:
    return name.rlike(r"\.(txt|docx|pdf)$")


def read_documents(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """SCHEMA. Files that are too large or of another type are left out before their content is read; rejected() lists them.
    A document's id is its file's name without the suffix; files that share one are told apart by their whole path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for at, doc_id, content in zip(b["path"], b["doc_id"], b["content"], strict=True):
                own = parse(at, bytes(content))
                rows.append({"doc_id": doc_id, "path": at, "n_chars": len(own["text"])} | own)
            if rows:
                yield pd.DataFrame(rows)[["doc_id", "path", "file_type", "text", "headings", "sections", "tables", "n_chars", "is_scanned"]]

    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    taken = _listed(spark, path).filter(_known(F.col("name")) & (F.col("length") <= most))
    shared = taken.groupBy(stem.alias("stem")).agg(F.count("*").alias("n")).filter("n > 1")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter((F.col("length") <= most) & _known(F.lower("path")))
    ids = taken.withColumn("stem", stem).join(shared, "stem", "left").select(F.col("path").alias("_path"), F.when(F.col("n").isNull(), F.col("stem")).otherwise(F.col("path")).alias("doc_id"))
    named = files.join(ids, F.col("path") == F.col("_path"))
    return named.select("path", "doc_id", "content").mapInPandas(run, SCHEMA)


def rejected(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """path, length, reason ("unknown_type", "too_large") of the files that read_documents() leaves out."""
    reason = F.when(~_known(F.col("name")), "unknown_type").when(F.col("length") > most, "too_large")
    return _listed(spark, path).select("path", "length", reason.alias("reason")).filter("reason is not null")


def texts(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Any table of texts as documents of one page: doc_id, page, text."""
    return df.select(F.col(key).cast("string").alias("doc_id"), F.lit(1).alias("page"), F.col(column).alias("text"))


def table_cells(docs: DataFrame) -> DataFrame:
    """doc_id, table_id, page, row, column_name, value of every cell."""
    t = docs.select("doc_id", F.explode("tables").alias("t")).select("doc_id", "t.*")
    r = t.select("doc_id", "table_id", "page", "header", F.posexplode("rows").alias("row", "cells"))
    return r.select("doc_id", "table_id", "page", "row", F.posexplode(F.arrays_zip("header", "cells")).alias("i", "c")).select("doc_id", "table_id", "page", "row", F.col("c.header").alias("column_name"), F.col("c.cells").alias("value"))
