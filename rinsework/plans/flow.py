"""The two ways through the engine: a table from file to signed commit, and a corpus of documents to clean records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rinsework.operators import checks, entities, governance, loss, relations
from rinsework.operators.actions import NullReport, apply_plan, apply_step, resolve_nulls
from rinsework.operators.dependencies import Dependency, mine
from rinsework.operators.profile import Profile, profile, quality_score
from rinsework.operators.semantics import SemanticType, infer_types
from rinsework.plans.ir import Step
from rinsework.plans.provenance import content_hash, manifest
from rinsework.plans.rewrite import scope
from rinsework.plans.rules import Plan, make_plan
from rinsework.session import staged
from rinsework.sources.versions import VersionStore


class Blocked(RuntimeError):
    """The cleaning would lose too much."""

    def __init__(self, report: loss.LossReport):
        super().__init__(report.recommendation)
        self.report = report


@dataclass
class Analysis:
    profile: Profile
    kinds: dict[str, SemanticType]
    dependencies: list[Dependency]
    plan: Plan
    score: int


def analyse(df: DataFrame, columns: list[str] | None = None, fuzzy: float | None = 85.0, exact: bool = False, writer: Callable[[str], str] | None = None) -> Analysis:
    found = profile(df, exact=exact)
    kinds = infer_types(df)
    dependencies = mine(df, found, fuzzy)
    return Analysis(found, kinds, dependencies, make_plan(found, dependencies, kinds, df, columns, writer), quality_score(found))


@dataclass
class Cleaned:
    df: DataFrame
    quarantined: DataFrame
    steps: list[Step]
    nulls: NullReport
    validation: checks.Validation
    loss: loss.LossReport | None = None
    version: int | None = None
    manifest: dict[str, Any] = field(default_factory=dict)


def dry_run(df: DataFrame, steps: list[Step], columns: list[str] | None = None, fill: bool = True, filter_invalid: bool = True) -> Cleaned:
    """The result as a lazy DataFrame; nothing is written."""
    steps = scope(steps, columns)
    out, nulls = apply_plan(df, steps), NullReport()
    if fill:
        out, nulls = resolve_nulls(out, columns)
    good, bad, validation = checks.filter_and_validate(out, steps, columns)
    return Cleaned(good if filter_invalid else out, bad, steps, nulls, validation)


def execute(df: DataFrame, steps: list[Step], store: VersionStore, columns: list[str] | None = None, fill: bool = True, filter_invalid: bool = True, per_step: bool = True) -> Cleaned:
    """Version 0 is the raw table; then a version for each step (or one for all), for the filled gaps, and for the rows removed."""
    steps = scope(steps, columns)
    if not store.exists():
        store.commit(df, "raw")
    now = store.read(0) if store.versions() == [0] else df
    if per_step:
        for s in steps:
            store.commit(apply_step(now, s), s.action, s.target_column, step_id=s.step_id)
            now = store.read()
    else:
        now = apply_plan(now, steps)
    nulls = NullReport()
    if fill:
        now, nulls = resolve_nulls(now, columns)
        if nulls.filled or nulls.rows_removed:
            store.commit(now, "resolve_nulls", filled=nulls.filled)
            now = store.read()
    good, bad, validation = checks.filter_and_validate(now, steps, columns)
    version = store.current()
    if filter_invalid and steps or not per_step:
        version = store.commit(good if filter_invalid else now, "filter_invalid" if filter_invalid else "apply_plan")
    return Cleaned(store.read(version), bad, steps, nulls, validation, version=version)


def clean_table(df: DataFrame, store: VersionStore | None = None, columns: list[str] | None = None, approve: bool | list[int] = False, fill: bool = True, limits: loss.Limits | None = None, target: str | None = None, compat: bool = False, per_step: bool = True) -> tuple[Analysis, Cleaned]:
    """Analyse, plan, try, measure the loss of the final table, and commit unless that is too much.

    Without compat only sure steps run, and those approved; with it all steps run and the loss is measured before invalid
    rows go. approve: true lets everything run, and commits a blocked result too."""
    found = analyse(df, columns)
    steps = found.plan.steps if compat or approve is True else found.plan.approved(approve or None)
    tried = dry_run(df, steps, columns, fill, filter_invalid=not compat)
    report = loss.assess(df, tried.df, target, limits)
    if not report.safe and approve is not True:
        raise Blocked(report)
    if store is None:
        tried.loss = report
        return found, tried
    done = execute(df, steps, store, columns, fill, per_step=per_step)
    done.loss = report
    measured = {"volumetric": report.volumetric, "w1": report.w1, "jaccard": report.jaccard, "cosine": report.cosine, "utility_delta": report.utility.delta, "utility": report.utility.status, "safe": report.safe, "reasons": report.reasons}
    done.manifest = manifest(content_hash(df), content_hash(done.df), [s.as_dict() for s in steps], measured, done.version, columns=df.columns)
    return found, done


@dataclass
class CleanedDocuments:
    entities: DataFrame
    edges: DataFrame
    clusters: DataFrame
    issues: DataFrame
    recommendations: DataFrame
    records: DataFrame
    validation: dict[str, Any]


def clean_documents(spark: SparkSession, texts: DataFrame, tables: DataFrame | None = None, approvals: governance.Approvals | None = None, store: VersionStore | None = None) -> CleanedDocuments:
    """texts: doc_id, page, text; tables: documents with their tables. Every document of the corpus goes through one plan; what the
    regular expressions found is written once and reread, so that they run once."""
    found = entities.extract(texts, skip_tables=tables is not None)
    if tables is not None:
        found = found.unionByName(entities.from_tables(tables))
    first = staged(entities.dedupe(found), "entities")
    commit = (lambda df, name: store.commit(df, name)) if store else (lambda df, name: None)
    commit(first, "EXTRACT")
    edges = relations.link(first)
    issues = relations.issues(first, relations.clusters(first, edges))
    decided = staged((approvals or governance.Approvals()).decide(governance.recommend(issues)), "recommendations")
    normal = staged(governance.apply(first, decided), "normalized")
    commit(normal, "NORMALIZE")
    unique = staged(governance.resolve(normal), "resolved")
    commit(unique, "RESOLVE_AND_DEDUPLICATE")
    row = governance.validate(first, unique).first().asDict()
    commit(unique, "VALIDATE")
    links = relations.link(unique)
    return CleanedDocuments(unique, links, relations.clusters(unique, links), decided.select(*relations.ISSUE, "issue_id"), decided, relations.records(unique, links), row)

