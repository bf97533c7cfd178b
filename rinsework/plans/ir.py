"""The plan: steps as plain records that are validated, written as JSON, and rewritten before anything runs."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

# The actions and the levels of loss.
ACTIONS = ("standardize_values", "regex_replace", "knn_impute", "deduplicate_exact", "clamp_bounds")
LOSS_LEVELS = ("none", "low", "medium", "high")


class InvalidPlan(ValueError):
    """A step that isn't a legal one."""


@dataclass(frozen=True)
class Step:
    step_id: int
    target_column: str
    issue: str
    rule: str
    action: str
    parameters: dict[str, Any] = field(default_factory=dict)
    confidence: float = 1.0
    justification: str = ""
    loss_potential: str = "low"
    test_criterion: str = ""

    def __post_init__(self) -> None:
        for name, kind in (("step_id", int), ("target_column", str), ("issue", str), ("rule", str), ("action", str), ("parameters", dict), ("justification", str), ("loss_potential", str), ("test_criterion", str)):
            if not isinstance(getattr(self, name), kind):
                raise InvalidPlan(f"{name} must be of type {kind.__name__}")
        if self.action not in ACTIONS:
            raise InvalidPlan(f"unknown action {self.action!r}")
        if isinstance(self.confidence, bool) or not isinstance(self.confidence, (int, float)) or not 0 <= self.confidence <= 1:
            raise InvalidPlan("confidence must be between 0 and 1")
        if self.loss_potential not in LOSS_LEVELS:
            raise InvalidPlan(f"unknown loss potential {self.loss_potential!r}")

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


KEYS = tuple(Step.__dataclass_fields__)


def parse_step(record: Any) -> Step:
    if not isinstance(record, dict):
        raise InvalidPlan("a step must be a record")
    if missing := [k for k in KEYS if k not in record]:
        raise InvalidPlan(f"missing keys: {', '.join(missing)}")
    if extra := sorted(set(record) - set(KEYS)):
        raise InvalidPlan(f"unknown keys: {', '.join(extra)}")
    return Step(**record)


def parse_plan(source: str | list) -> list[Step]:
    """From JSON text or records; text around the outermost list is ignored, as language models write it."""
    if isinstance(source, str):
        begin, end = source.find("["), source.rfind("]")
        if begin < 0 or end < begin:
            raise InvalidPlan("no list of steps")
        try:
            source = json.loads(source[begin : end + 1])
        except json.JSONDecodeError as e:
            raise InvalidPlan(f"not JSON: {e}") from e
    if not isinstance(source, list):
        raise InvalidPlan("a plan must be a list")
    return [parse_step(r) for r in source]


def to_json(steps: list[Step]) -> str:
    return json.dumps([s.as_dict() for s in steps])


def json_schema() -> dict[str, Any]:
    """For writers of plans that take a schema or a grammar."""
    text, number = {"type": "string"}, {"type": "number", "minimum": 0, "maximum": 1}
    kinds = {"step_id": {"type": "integer"}, "parameters": {"type": "object"}, "confidence": number, "action": {"enum": list(ACTIONS)}, "loss_potential": {"enum": list(LOSS_LEVELS)}}
    return {"type": "array", "items": {"type": "object", "required": list(KEYS), "additionalProperties": False, "properties": {k: kinds.get(k, text) for k in KEYS}}}
