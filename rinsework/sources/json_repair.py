"""Records from JSON documents that may be damaged, and the many shapes in which documents hold tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from rinsework.functions.constants import CONTAINERS

DECODER = json.JSONDecoder()


def _whole(text: str) -> Any:
    return json.loads(text)


def _outer_braces(text: str) -> Any:
    """{ {...}, {...} } is meant as a list."""
    if not re.match(r"\{\s*\{", text):
        raise ValueError("no braces around records")
    return json.loads("[" + text.strip()[1:].rstrip().removesuffix("}") + "]")


def _brackets(text: str) -> Any:
    """Records without the list's brackets, or with one of them."""
    return json.loads("[" + text.strip().strip("[],") + "]")


def _scan(text: str) -> Any:
    """Every complete object, wherever it stands; what lies between is skipped."""
    found, at = [], text.find("{")
    while at >= 0:
        try:
            value, end = DECODER.raw_decode(text, at)
            found.append(value)
        except ValueError:
            end = at + 1
        at = text.find("{", end)
    if not found:
        raise ValueError("no object")
    return found


def _lines(text: str) -> Any:
    found = []
    for line in text.splitlines():
        try:
            value = json.loads(line.strip().rstrip(","))
        except ValueError:
            continue
        found += value if isinstance(value, list) else [value]
    if not found:
        raise ValueError("no line is JSON")
    return found


def repair(text: str) -> Any:
    """The value of the first reading that works; ValueError if none does."""
    text = text.replace("\x00", "").lstrip("﻿").strip()
    for reading in (_whole, _outer_braces, _brackets, _scan, _lines):
        try:
            return reading(text)
        except ValueError:
            continue
    raise ValueError("not JSON, and beyond repair")


def _is_records(value: Any) -> bool:
    return isinstance(value, list) and bool(value) and all(isinstance(x, dict) for x in value)


def records(value: Any) -> Iterator[dict[str, Any]]:
    """The table in a document: a list of records or of plain values, a container under a usual or any key, columns, or one record."""
    if isinstance(value, list):
        for x in value:
            if isinstance(x, list):
                yield from records(x)
            else:
                yield x if isinstance(x, dict) else {"value": x}
        return
    if not isinstance(value, dict):
        yield {"value": value}
        return
    for key in [*(k for k in CONTAINERS if k in value), *value]:
        if _is_records(value.get(key)):
            yield from value[key]
            return
    lengths = {len(v) for v in value.values() if isinstance(v, list)}
    if value and all(isinstance(v, list) for v in value.values()) and len(lengths) == 1:
        for row in zip(*value.values(), strict=True):
            yield dict(zip(value, row, strict=True))
        return
    yield value


def lines_of(text: str) -> Iterator[str]:
    """One line of JSON for each record."""
    for r in records(repair(text)):
        yield json.dumps(r, ensure_ascii=False)
