"""Rewrites of plans: done on the steps, before there is a DataFrame plan for Catalyst to see."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from rinsework.plans.ir import Step

CONFIDENT = 0.85


def compose(mapping: dict[str, Any], hops: int = 5) -> dict[str, Any]:
    """Chains of replacements become one hop: a to b and b to c gives a to c. Cycles end after `hops`; identities go."""
    out = {}
    for key in mapping:
        value = mapping[key]
        for _ in range(hops):
            if value is None or value not in mapping or mapping[value] == value:
                break
            value = mapping[value]
        if value != key:
            out[key] = value
    return out


def scope(steps: list[Step], columns: list[str] | None) -> list[Step]:
    """Only steps for these columns, or for whole rows."""
    return steps if columns is None else [s for s in steps if s.target_column in (*columns, "ALL")]


def merge_mappings(steps: list[Step]) -> list[Step]:
    """One standardisation for each column: later mappings win, and chains are composed."""
    merged: dict[str, dict[str, Any]] = {}
    lists: dict[tuple[str, str], list[str]] = {}
    for s in steps:
        if s.action == "standardize_values":
            merged[s.target_column] = merged.get(s.target_column, {}) | s.parameters.get("mapping", {})
            for kind in ("names", "tables"):
                if own := s.parameters.get(kind):
                    lists[s.target_column, kind] = list(dict.fromkeys([*lists.get((s.target_column, kind), []), *own]))
    out, seen = [], set()
    for s in steps:
        if s.action != "standardize_values":
            out.append(s)
        elif s.target_column not in seen:
            seen.add(s.target_column)
            own = {kind: v for (column, kind), v in lists.items() if column == s.target_column}
            out.append(replace(s, parameters=s.parameters | {"mapping": compose(merged[s.target_column])} | own))
    return out


def drop_dead(steps: list[Step], columns: list[str]) -> list[Step]:
    """Without steps for missing columns, and without empty mappings, unless they have names or tables."""
    alive = lambda s: (s.target_column in columns or s.target_column == "ALL") and (s.action != "standardize_values" or any(s.parameters.get(k) for k in ("mapping", "names", "tables")))
    return [s for s in steps if alive(s)]


def rewrite(steps: list[Step], columns: list[str]) -> list[Step]:
    kept = drop_dead(merge_mappings(steps), columns)
    return [replace(s, step_id=i + 1) for i, s in enumerate(kept)]


def gate(steps: list[Step], least: float = CONFIDENT) -> tuple[list[Step], list[Step]]:
    """Steps that may run by themselves, and steps for review."""
    sure = [s for s in steps if s.confidence >= least]
    return sure, [s for s in steps if s.confidence < least]
