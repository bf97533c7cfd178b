"""Rules that write a plan from a profile, dependencies and semantic types. Runs on the driver, over results of the size of
the schema; only entity maps look at the table, at a bounded number of distinct values of name-like columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.functions import constants as K
from rinsework.functions.text import name_words
from rinsework.operators.dependencies import Dependency
from rinsework.operators.gazetteer import KINDS, meant
from rinsework.operators.normalize import quoted
from rinsework.operators.profile import Profile
from rinsework.operators.semantics import SemanticType
from rinsework.plans.ir import Step, parse_plan, to_json
from rinsework.plans.rewrite import CONFIDENT, gate, rewrite, scope

MOST_VALUES = 20_000  # distinct values of a column that a mapping may hold; beyond, the step looks names up in a join


@dataclass
class Plan:
    steps: list[Step]
    auto: list[Step] = field(default_factory=list)
    review: list[Step] = field(default_factory=list)
    source: str = "rules"

    def to_json(self) -> str:
        return to_json(self.steps)

    def approved(self, extra: list[int] | None = None) -> list[Step]:
        """What may run: the sure steps, and those that someone has approved."""
        chosen = {s.step_id for s in self.auto} | set(extra or [])
        return [s for s in self.steps if s.step_id in chosen]


def _step(column: str, action: str, confidence: float, loss: str, issue: str, rule: str, why: str, test: str, **parameters: Any) -> Step:
    return Step(0, column, issue, rule, action, parameters, confidence, why, loss, test)


def duplicate_rules(meta: dict[str, Any], columns: dict[str, Any]) -> Iterator[Step]:
    n, share = meta.get("duplicates", 0), meta.get("dup_pct", 0.0)
    if n <= 0:
        return
    keyed = any(name_words(c) & {"id", "key", "code"} for c in columns)
    if share > 15 and not keyed:
        yield _step("ALL", "deduplicate_exact", 0.40, "high", f"{share:.1f} % of rows repeat and no column identifies them", "rows without a key may be events", "Repeated rows may be separate events; dropping them would lose more than 15 % of the rows.", "rows_are_events_or_unique", keep="first")
    else:
        yield _step("ALL", "deduplicate_exact", 0.99, "low", f"{n} rows are exact copies", "rows are unique", "Copies count twice in every statistic.", "no_duplicate_rows", keep="first")


def null_rules(column: str, own: dict[str, Any]) -> Iterator[Step]:
    share = own.get("null_pct", 0.0)
    if 30 <= share <= 60:
        yield _step(column, "knn_impute", 0.72, "high", f"{share} % of values are missing", "columns are complete enough to fill", "So many filled values would shape the distribution; someone should decide.", "null_percentage_under_10", neighbors=5, strategy="conditional_impute_or_drop")
    elif 0 < share < 15:
        strategy = "median" if own.get("type", "").startswith(("Int", "Float")) else "mode"
        yield _step(column, "knn_impute", 0.92, "low", f"{share} % of values are missing", "few gaps are filled by the centre", "So few filled values leave the distribution as it is.", "non_null", neighbors=3, strategy=strategy)


def range_rules(column: str, own: dict[str, Any]) -> Iterator[Step]:
    words, low, high = name_words(column), own.get("min"), own.get("max")
    if low is None:
        return
    if "age" in words and (low < 0 or (high or 0) > 120):
        yield _step(column, "clamp_bounds", 0.98, "low", f"ages from {low} to {high}", "ages are from 0 to 120", "Nobody has such an age.", "between_0_and_120", lower=0, upper=120)
    if any(w in column.lower() for w in K.MONEY_WORDS) and low < 0:
        yield _step(column, "clamp_bounds", 0.98, "low", f"amounts down to {low}", "amounts aren't negative", "Such an amount can't be negative here.", "non_negative", lower=0.0, upper=float(high) if high is not None else 1e9)


def email_rules(column: str, kind: SemanticType | None) -> Iterator[Step]:
    if kind and kind.kind == "Email":
        yield _step(column, "regex_replace", 0.96, "none", "addresses differ in case and blanks, or aren't any", "addresses are trimmed, in lower case and valid", "Case and outer blanks mean nothing in an address.", "valid_email_regex", pattern=r"^\s+|\s+$", replacement="", lowercase=True, nullify_invalid=True, valid_pattern=K.EMAIL)


def entity_map(df: DataFrame, column: str, kind: str, most: int = MOST_VALUES) -> dict[str, Any] | None:
    """Values that should be written otherwise. Only distinct values are compared; None if more than `most` change."""
    value = F.trim(quoted(column).cast("string"))
    wanted = meant(df.select(value.alias("v")).filter("v is not null and v <> ''").distinct(), kind)
    changed = wanted.filter("w is null or v <> w" if kind == "Phone" else "w is not null and v <> w")  # a number with too few digits is none
    rows = changed.limit(most + 1).collect()
    return {r.v: r.w for r in rows} if len(rows) <= most else None


def mapping_rules(df: DataFrame | None, columns: list[str], dependencies: list[Dependency], kinds: dict[str, SemanticType], most: int = MOST_VALUES) -> Iterator[Step]:
    maps: dict[str, dict[str, Any]] = {}
    names: dict[str, list[str]] = {}
    tables: dict[str, list[str]] = {}
    for d in dependencies:
        if (d.mapping or d.table) and d.dependent in columns:
            maps.setdefault(d.dependent, {}).update(d.mapping)
            if d.table:
                tables.setdefault(d.dependent, []).append(d.table)
    for c in columns if df is not None else []:
        for kind, words in KINDS.items():
            if name_words(c) & words or c in kinds and kinds[c].kind == kind:
                found = entity_map(df, c, kind, most)
                maps.setdefault(c, {}).update(found or {})
                if found is None:
                    names.setdefault(c, []).append(kind)
    for c, mapping in maps.items():
        if mapping or c in names or c in tables:
            own = ({"names": names[c]} if c in names else {}) | ({"tables": tables[c]} if c in tables else {})
            yield _step(c, "standardize_values", 0.98, "none", f"values of {c} differ in spelling, case or format", f"{c} has one spelling for each thing", "Dependencies and known names tell which spelling is meant.", f"standardized_{c.lower()}", mapping=mapping, **own)


def make_plan(found: Profile, dependencies: list[Dependency] | None = None, kinds: dict[str, SemanticType] | None = None, df: DataFrame | None = None, columns: list[str] | None = None, writer: Callable[[str], str] | None = None, least: float = CONFIDENT) -> Plan:
    """writer: something that writes a plan's JSON from the profile's, such as a language model; the rules stand in if its plan is invalid."""
    kinds, chosen = kinds or {}, [c for c in found.columns if columns is None or c in columns]
    steps, source = None, "rules"
    if writer is not None:
        try:
            steps, source = parse_plan(writer(found.to_json())), "writer"
        except Exception:  # whatever an outside writer does, the rules are there
            steps = None
    if steps is None:
        steps = [*duplicate_rules(found.meta, found.columns), *mapping_rules(df, chosen, dependencies or [], kinds)]
        for c in chosen:
            steps += [*null_rules(c, found.columns[c]), *range_rules(c, found.columns[c]), *email_rules(c, kinds.get(c))]
    steps = rewrite(scope(steps, columns), list(found.columns))
    return Plan(steps, *gate(steps, least), source)
