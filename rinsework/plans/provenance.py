"""Content hashes and signed manifests."""

from __future__ import annotations

import hashlib
import hmac
import html
import json
import time
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = "decimal(38,0)"


def row_half(df: DataFrame, first: bool) -> Column:
    """A 60-bit half of a row's digest, columns in the order of their names."""
    text = F.to_json(F.struct(*(F.col(f"`{c}`").alias(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    return F.conv(F.substring(F.sha2(text, 256), 1 if first else 16, 15), 16, 10).cast(SCALE)


def digest(df: DataFrame) -> DataFrame:
    """n, a, b: a fingerprint of the rows as a multiset. Order and partitions don't matter; one pass, no shuffle of rows."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_half(df, True)), F.lit(0).cast(SCALE)).alias("a"), F.coalesce(F.sum(row_half(df, False)), F.lit(0).cast(SCALE)).alias("b"))


def content_hash(df: DataFrame) -> str:
    """Of the schema and all rows."""
    r = digest(df).first()
    kinds = ",".join(f"{c}:{t}" for c, t in sorted(df.dtypes))
    return hashlib.sha256(f"{kinds}|{r['n']}|{r['a']}|{r['b']}".encode()).hexdigest()


def manifest(raw_hash: str, clean_hash: str, steps: list[dict[str, Any]], loss: dict[str, Any], version: int | None = None, **more: Any) -> dict[str, Any]:
    return {"input_hash": raw_hash, "output_hash": clean_hash, "steps": steps, "loss": loss, "version": version, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **more}


def _canonical(record: dict[str, Any]) -> bytes:
    return json.dumps({k: v for k, v in record.items() if k != "signature"}, sort_keys=True, default=str).encode()


def sign(record: dict[str, Any], key: bytes) -> dict[str, Any]:
    if not key:
        raise ValueError("a key is needed to sign")
    return record | {"signature": hmac.new(key, _canonical(record), hashlib.sha256).hexdigest()}


def verified(record: dict[str, Any], key: bytes) -> bool:
    return hmac.compare_digest(record.get("signature", ""), sign(record, key)["signature"])


def to_html(record: dict[str, Any]) -> str:
    """A certificate; every value is escaped."""
    say = lambda v: html.escape(json.dumps(v, default=str) if isinstance(v, (dict, list)) else str(v))
    rows = "".join(f"<tr><th>{say(k)}</th><td>{say(v)}</td></tr>" for k, v in record.items() if k != "steps")
    steps = "".join(f"<tr><td>{say(s.get('step_id'))}</td><td>{say(s.get('target_column'))}</td><td>{say(s.get('action'))}</td><td>{say(s.get('confidence'))}</td></tr>" for s in record.get("steps", []))
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Provenance</title></head><body><h1>Provenance</h1><table>{rows}</table><h2>Steps</h2><table><tr><th>step</th><th>column</th><th>action</th><th>confidence</th></tr>{steps}</table></body></html>"


def write(record: dict[str, Any], json_path: str, html_path: str | None = None) -> None:
    with open(json_path, "w") as f:
        json.dump(record, f, indent=2, default=str)
    if html_path:
        with open(html_path, "w") as f:
            f.write(to_html(record))
