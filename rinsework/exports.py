"""Files that people open: results of bounded size as CSV, JSON, a workbook of sheets, and a report."""

from __future__ import annotations

import csv
import json
import zipfile
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from rinsework.plans.flow import CleanedDocuments

MOST = 100_000  # rows of a file for people; a table of more goes out by sources.formats.save


def rows_of(df: DataFrame, most: int = MOST) -> list[dict[str, Any]]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table with sources.formats.save")
    return [r.asDict(recursive=True) for r in rows]


def _cell(v: Any) -> str:
    return "" if v is None else json.dumps(v, default=str, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)


def to_csv(rows: list[dict[str, Any]], path: str) -> str:
    with open(path, "w", newline="", encoding="utf-8") as f:
        if rows:
            w = csv.DictWriter(f, list(rows[0]))
            w.writeheader()
            w.writerows({k: _cell(v) for k, v in r.items()} for r in rows)
    return path


def to_json(value: Any, path: str) -> str:
    Path(path).write_text(json.dumps(value, indent=2, default=str, ensure_ascii=False), encoding="utf-8")
    return path


def _column(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def to_xlsx(sheets: dict[str, list[dict[str, Any]]], path: str) -> str:
    """A workbook with inline strings, by the standard library alone."""
    names = list(sheets)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    head = '<?xml version="1.0" encoding="UTF-8"?>'

    def sheet(rows: list[dict[str, Any]]) -> str:
        table = [list(rows[0]), *([_cell(v) for v in r.values()] for r in rows)] if rows else []
        body = "".join(
            f'<row r="{i}">' + "".join(f'<c r="{_column(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(table, 1)
        )
        return f"{head}<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"

    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook {ns} xmlns:r="{rels}"><sheets>{listed}</sheets></workbook>')
        linked = "".join(f'<Relationship Id="rId{i}" Type="{rels}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{linked}</Relationships>')
        for i, n in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", sheet(sheets[n]))
    return path


def report(done: CleanedDocuments, title: str = "Cleaning report") -> str:
    """Markdown with counts by type of issue, the decisions and the validation."""
    issues = rows_of(done.recommendations.groupBy("type", "field", "operation", "risk_level", "decision").count().orderBy("type", "field", "decision"))
    lines = [f"# {title}", "", f"{done.entities.count()} entities, {done.clusters.count()} records.", "", "| issue | field | operation | risk | decision | n |", "|---|---|---|---|---|---|"]
    lines += [f"| {r['type']} | {r['field']} | {r['operation']} | {r['risk_level']} | {r['decision']} | {r['count']} |" for r in issues]
    lines += ["", "## Validation", "", *(f"- {k}: {v}" for k, v in done.validation.items())]
    return "\n".join(lines) + "\n"


def export_all(done: CleanedDocuments, folder: str) -> dict[str, str]:
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    tables = {"records": rows_of(done.records), "entities": rows_of(done.entities), "issues": rows_of(done.issues), "recommendations": rows_of(done.recommendations)}
    (at / "report.md").write_text(report(done), encoding="utf-8")
    return {
        "csv": to_csv(tables["records"], str(at / "records.csv")), "json": to_json(tables["entities"], str(at / "entities.json")), "xlsx": to_xlsx(tables, str(at / "cleaned.xlsx")),
        "validation": to_json(done.validation, str(at / "validation.json")), "report": str(at / "report.md"),
    }
