"""What to do about issues, what it could cost, who must agree, and the doing. Decision tables as expressions over issues."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.functions import constants as K
from rinsework.functions.text import digits
from rinsework.plans.rewrite import CONFIDENT

# Operation and confidence by type of issue.
OPERATIONS = {"semantic": ("standardize", 0.98), "format_inconsistent": ("standardize", 0.95), "duplicate": ("deduplicate", 0.88), "conflict": ("merge", 0.60), "missing": ("fill", 0.70), "invalid": ("normalize", 0.80)}


def recommend(issues: DataFrame, least: float = CONFIDENT) -> DataFrame:
    """The issues with operation, confidence, loss_score, risk_level, is_reversible, is_blocked and requires_approval."""
    op, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    for kind, (name, confidence) in OPERATIONS.items():
        op = F.when(F.col("type") == kind, name).otherwise(op)
        sure = F.when(F.col("type") == kind, confidence).otherwise(sure)
    with_op = issues.withColumns({"operation": op, "confidence": sure})
    rewritten = F.col("operation").isin("standardize", "normalize")
    # The loss that each kind of repair is taken to risk, the first that fits.
    score = (
        F.when(F.col("type") == "conflict", 0.90)
        .when(F.col("operation") == "deduplicate", 0.50)
        .when((F.col("field") == "Phone") & (F.col("operation") == "standardize"), 0.20)
        .when(F.col("field").isin("City", "State") & rewritten, 0.15)
        .when((F.col("field") == "Date") & rewritten, 0.10)
        .when(F.col("operation") == "fill", 0.35)
        .otherwise(0.15)
    )
    blocked = F.col("type") == "conflict"
    risk = F.when(blocked, "high").when(F.col("operation").isin("deduplicate", "fill"), "medium").otherwise("low")
    out = with_op.withColumns({"loss_score": score, "risk_level": risk, "is_reversible": ~blocked, "is_blocked": blocked})
    return out.withColumn("requires_approval", (F.col("confidence") < least) | F.col("risk_level").isin("medium", "high") | F.col("is_blocked"))


@dataclass
class Approvals:
    """Decisions of people over recommendations; ids only, so that it stays as small as the number of decisions."""

    approved: set[str] = field(default_factory=set)
    rejected: dict[str, str] = field(default_factory=dict)
    all_but_high_risk: bool = False
    all: bool = False

    def approve(self, issue_id: str) -> None:
        self.approved.add(issue_id)
        self.rejected.pop(issue_id, None)

    def reject(self, issue_id: str, why: str = "rejected") -> None:
        self.rejected[issue_id] = why
        self.approved.discard(issue_id)

    def decide(self, recommended: DataFrame) -> DataFrame:
        """With decision: approved, rejected or pending."""
        by_hand = F.col("issue_id").isin(*sorted(self.approved)) if self.approved else F.lit(False)
        no = F.col("issue_id").isin(*sorted(self.rejected)) if self.rejected else F.lit(False)
        batch = F.lit(self.all) | (F.lit(self.all_but_high_risk) & (F.col("risk_level") != "high"))
        return recommended.withColumn("decision", F.when(no, "rejected").when(by_hand | ~F.col("requires_approval") | batch, "approved").otherwise("pending"))

    @staticmethod
    def summary(decided: DataFrame) -> DataFrame:
        return decided.agg(
            F.count("*").alias("total"), F.count_if(F.col("decision") == "approved").alias("approved"), F.count_if(F.col("decision") == "rejected").alias("rejected"),
            F.count_if(F.col("decision") == "pending").alias("pending"), F.count_if(~F.col("requires_approval")).alias("automatic"),
        )


def apply(entities: DataFrame, decided: DataFrame) -> DataFrame:
    """Approved standardisations, by type and value; cities, states, phones and dates take their normal form."""
    changes = decided.filter("decision = 'approved' and operation = 'standardize'").groupBy("doc_id", F.col("field").alias("type"), F.col("current_value").alias("value")).agg(F.min("other_value").alias("new"))
    joined = entities.join(changes, ["doc_id", "type", "value"], "left")
    normal = F.when(F.col("type").isin("City", "State", "Phone", "Date"), F.col("normalized_value"))
    return joined.withColumn("value", F.coalesce("new", normal, "value")).withColumn("normalized_value", F.coalesce("new", "normalized_value")).drop("new").select(entities.columns)


def resolve(entities: DataFrame) -> DataFrame:
    """The first entity of each document, record, type and normal value."""
    row = F.struct(*entities.columns)
    first = F.min_by(row, F.struct("page", "span_start", "entity_id"))
    return entities.groupBy("doc_id", "record_id", "type", F.lower("normalized_value").alias("_v")).agg(first.alias("e")).select("e.*")


def validate(before: DataFrame, after: DataFrame, most: float = 0.15) -> DataFrame:
    """One row: whether types survive, dates are ISO, phones long enough, addresses valid, nothing repeats, and little is lost."""
    kinds = lambda df: df.select("doc_id", "type").distinct()
    lost = kinds(before).join(kinds(after), ["doc_id", "type"], "left_anti").agg(F.count("*").alias("types_lost"))
    n = before.agg(F.count("*").alias("n_before"))
    v = F.col("normalized_value")
    key = F.struct("doc_id", "record_id", "type", F.lower(v))
    now = after.agg(
        F.count("*").alias("n_after"), F.count_if((F.col("type") == "Date") & ~v.rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("bad_dates"), F.count_if((F.col("type") == "Phone") & (F.length(digits(v)) < 10)).alias("bad_phones"),
        F.count_if((F.col("type") == "Email") & ~v.rlike(K.EMAIL)).alias("bad_emails"), (F.count("*") - F.count_distinct(key)).alias("repeats"),
    )
    one = F.lit(1).alias("k")
    row = now.select(one, "*").join(n.select(one, "*"), "k").join(lost.select(one, "*"), "k").drop("k")  # one row each
    loss = F.coalesce(F.round(1 - F.try_divide("n_after", "n_before"), 4), F.lit(0.0))
    good = (F.col("types_lost") == 0) & (F.col("bad_dates") == 0) & (F.col("bad_phones") == 0) & (F.col("bad_emails") == 0) & (F.col("repeats") == 0)
    return row.withColumn("loss", loss).withColumn("passed", good & (F.col("loss") <= most))
