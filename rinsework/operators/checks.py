"""Checks that a plan implies, run over a table in one aggregation, and the split of its rows into valid and quarantined."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.functions import constants as K
from rinsework.operators.normalize import quoted
from rinsework.plans.ir import Step


@dataclass(frozen=True)
class Check:
    column: str
    kind: str  # between, not_null, matches
    low: float | None = None
    high: float | None = None
    pattern: str | None = None

    def fails(self) -> Column:
        """Null fails not_null alone."""
        c = quoted(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "matches":
            return F.coalesce(~c.cast("string").rlike(self.pattern), F.lit(False))
        number = c.try_cast("double")
        return F.coalesce((number < self.low) | (number > self.high), F.lit(False))

    def as_expectation(self) -> dict[str, Any]:
        kinds = {"between": "expect_column_values_to_be_between", "not_null": "expect_column_values_to_not_be_null", "matches": "expect_column_values_to_match_regex"}
        own = {"between": {"min_value": self.low, "max_value": self.high}, "not_null": {}, "matches": {"regex": self.pattern}}[self.kind]
        return {"expectation_type": kinds[self.kind], "kwargs": {"column": self.column} | own}


def checks_of(steps: list[Step], columns: list[str], chosen: list[str] | None = None) -> list[Check]:
    """Ranges of clamps, no nulls after filling, valid addresses in columns named so."""
    out: list[Check] = []
    for s in steps:
        c = s.target_column
        if c not in columns or chosen is not None and c not in chosen:
            continue
        if s.action == "clamp_bounds" or "between" in s.test_criterion:
            out.append(Check(c, "between", float(s.parameters.get("lower", 0)), float(s.parameters.get("upper", 120))))
        elif s.action == "knn_impute" or s.test_criterion == "non_null":
            out.append(Check(c, "not_null"))
        elif s.action == "regex_replace" and "email" in c.lower():
            out.append(Check(c, "matches", pattern=s.parameters.get("valid_pattern") or K.EMAIL))
    return list(dict.fromkeys(out))


def violations(df: DataFrame, checks: list[Check]) -> DataFrame:
    """column_name, kind, failed, total, passed: a row for each check, all from one pass."""
    rows = F.array(*(F.struct(F.lit(x.column).alias("column_name"), F.lit(x.kind).alias("kind"), F.count_if(x.fails()).alias("failed"), F.count(F.lit(1)).alias("total")) for x in checks))
    return df.agg(rows.alias("rows")).select(F.inline("rows")).withColumn("passed", F.col("failed") == 0)


def valid(checks: list[Check]) -> Column:
    return reduce(lambda a, b: a & b, [~x.fails() for x in checks], F.lit(True))


def split(df: DataFrame, checks: list[Check]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with the checks that they fail."""
    reasons = F.concat_ws(";", *(F.when(x.fails(), F.lit(f"{x.column}:{x.kind}")) for x in checks)) if checks else F.lit("")
    return df.filter(valid(checks)), df.filter(~valid(checks)).withColumn("_reasons", reasons)


@dataclass
class Validation:
    passed: bool
    results: list[dict[str, Any]] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)


def validate(df: DataFrame, checks: list[Check]) -> Validation:
    """Checks of missing columns fail."""
    present = [x for x in checks if x.column in df.columns]
    missing = [x.column for x in checks if x.column not in df.columns]
    results = [r.asDict() for r in violations(df, present).collect()] if present else []
    return Validation(all(r["passed"] for r in results) and not missing, results, missing)


def filter_and_validate(df: DataFrame, steps: list[Step], columns: list[str] | None = None) -> tuple[DataFrame, DataFrame, Validation]:
    """The valid rows, the quarantined ones, and the validation of the valid ones; the choice of columns holds for all three."""
    checks = checks_of(steps, df.columns, columns)
    good, bad = split(df, checks)
    return good, bad, validate(good, checks)


def suite(checks: list[Check], name: str = "cleaning_suite") -> dict[str, Any]:
    return {"expectation_suite_name": name, "expectations": [x.as_expectation() for x in checks]}


def export_suite(checks: list[Check], path: str, name: str = "cleaning_suite") -> str:
    with open(path, "w") as f:
        json.dump(suite(checks, name), f, indent=2)
    return path
