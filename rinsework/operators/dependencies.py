"""Functional dependencies: exact ones, and those that hold once spellings are unified.

An exact one needs no distinct counts: y depends on x if the least and the greatest y of each x are the same, which partial
aggregates settle before anything is shuffled. Spellings are compared as distinct (x, y) pairs, joined by x and by the
digits of y (spellings that differ in digits are different things), so that rows are never paired with rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.functions import constants as K
from rinsework.functions.text import digits, is_title, name_words, typo_variants
from rinsework.operators.components import components
from rinsework.operators.normalize import quoted
from rinsework.operators.profile import Profile, is_numeric
from rinsework.operators.spellings import candidates
from rinsework.session import staged, staged_path

KNOWN = sorted({*K.INDIAN_STATES, *K.US_STATES, *K.CITIES, *K.COUNTRIES, *K.SPECIAL_CASE})
TIME_WORDS = {"date", "time", "timestamp", "dob", "year", "month"}


@dataclass
class Dependency:
    determinant: str
    dependent: str
    exact: bool
    confidence: float
    mapping: dict[str, str] = field(default_factory=dict)
    table: str | None = None  # where the mapping is written, if it has too many entries for the driver
    violations: list[dict[str, str]] = field(default_factory=list)


def canonical_case(name: str) -> str:
    return K.SPECIAL_CASE.get(name.lower(), name.title())


def exact_matrix(df: DataFrame, determinants: list[str], dependents: list[str]) -> DataFrame:
    """determinant, dependent, groups, violating, is_exact: one aggregation for each determinant, all dependents at once."""
    out = None
    for x in determinants:
        ys = [y for y in dependents if y != x]
        pair = [F.struct(F.min(quoted(y)).alias("least"), F.max(quoted(y)).alias("most")).alias(f"_{i}") for i, y in enumerate(ys)]
        groups = df.filter(quoted(x).isNotNull()).groupBy(quoted(x).alias("_x")).agg(*pair)
        rows = F.array(
            *(
                F.struct(F.lit(x).alias("determinant"), F.lit(y).alias("dependent"), F.count(F.col(f"_{i}.least")).alias("groups"), F.count_if(F.col(f"_{i}.least") != F.col(f"_{i}.most")).alias("violating"))
                for i, y in enumerate(ys)
            )
        )
        found = groups.agg(rows.alias("rows")).select(F.inline("rows"))
        out = found if out is None else out.unionByName(found)
    return out.withColumn("is_exact", (F.col("violating") == 0) & (F.col("groups") > 0))


def pair_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, n: distinct pairs without nulls, as strings, y trimmed."""
    return df.select(quoted(x).cast("string").alias("x"), F.trim(quoted(y).cast("string")).alias("y")).filter("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n"))


def variants(pairs: DataFrame, least: float = 85.0, key: tuple[str, ...] = ()) -> DataFrame:
    """key..., x, a, b: spellings of one thing within one x. Only spellings that share a signature are compared."""
    values = pairs.select(*key, "x", digits(F.col("y")).alias("d"), F.col("y").alias("v"), F.lower(F.trim("y")).alias("k"))
    met = candidates(values, [*key, "x", "d"], min(least, 85.0), begins=4, near=4, same_digits=True)
    return met.filter(typo_variants(F.col("a"), F.col("b"), least)).select(*key, "x", "a", "b").distinct()


def known(c: Column) -> Column:
    return F.lower(c).isin(*KNOWN)


def canonical(pairs: DataFrame, least: float = 85.0, spelled: DataFrame | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """key..., y, root: each spelling with a variant and the one that stands for it: a known name, else the most frequent, else the
    one in title case, else the longest, else the last in order. spelled: the variants, if they are known."""
    node = lambda y: F.struct(*key, F.col(y).alias("y")).alias(y)
    links = (variants(pairs, least, key) if spelled is None else spelled).select(node("a"), node("b")).distinct()
    member = components(links).select("node.*", "root")
    total = pairs.groupBy(*key, "y").agg(F.sum("n").alias("n"))
    ranked = member.join(total, [*key, "y"])
    best = F.max_by("y", F.struct(known(F.col("y")).alias("k"), F.col("n"), is_title(F.col("y")).alias("t"), F.length("y").alias("l"), F.col("y")))
    chosen = ranked.groupBy("root").agg(best.alias("chosen"))
    cases = F.create_map(*(F.lit(v) for k in KNOWN for v in (k, canonical_case(k))))
    named = F.coalesce(F.try_element_at(cases, F.lower("chosen")), F.col("chosen"))
    return ranked.join(chosen, "root").select(*key, "y", named.alias("root"))


def confidence(pairs: DataFrame, mapping: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """key..., n_rows, n_kept, confidence: the share of rows that hold their x's most frequent y, once spellings are unified."""
    unified = pairs.join(mapping, [*key, "y"], "left").groupBy(*key, "x", F.coalesce("root", "y").alias("y")).agg(F.sum("n").alias("n"))
    top = unified.groupBy(*key, "x").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    sums = top.groupBy(*key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("top"), F.lit(0)).alias("n_kept"))
    return sums.withColumn("confidence", F.round(F.try_divide(F.col("n_kept"), F.col("n_rows")), 4))


def leaders(pairs: DataFrame, least: float = 85.0) -> DataFrame:
    """x, y, leader: greedy clusters within each x, in order of rank. Order decides, so each x is one task's; it gets
    distinct spellings only."""
    from difflib import SequenceMatcher

    def alike(a: str, b: str) -> bool:
        return "".join(filter(str.isdigit, a)) == "".join(filter(str.isdigit, b)) and (a.lower() == b.lower() or 100 * SequenceMatcher(None, a.lower(), b.lower()).ratio() >= least)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.assign(k=group.y.str.lower().isin(KNOWN), t=group.y.str.istitle(), size=group.y.str.len()).sort_values(["k", "n", "t", "size", "y"], ascending=[False, False, False, False, True])
        heads: list[str] = []
        own = []
        for y in ordered.y:
            head = next((h for h in heads if alike(h, y)), y)
            heads += [y] * (head == y)
            own.append(head)
        return pd.DataFrame({"x": ordered.x, "y": ordered.y, "leader": own})

    return pairs.groupBy("x").applyInPandas(run, "x string, y string, leader string")


def temporal(df: DataFrame, columns: list[str]) -> set[str]:
    """Which columns hold dates or times: by type, by name, or because half of their texts look like dates (one aggregation for all)."""
    kinds = {c: df.schema[c].dataType for c in columns}
    out = {c for c in columns if isinstance(kinds[c], (T.DateType, T.TimestampType, T.TimestampNTZType)) or name_words(c) & TIME_WORDS}
    texts = [c for c in columns if c not in out and isinstance(kinds[c], T.StringType)]
    if texts:
        shares = df.agg(*(F.avg(F.trim(quoted(c)).rlike(K.ANY_DATE).cast("double")) for c in texts)).first()
        out |= {c for c, share in zip(texts, shares, strict=True) if (share or 0) >= 0.5}
    return out


def stacked(df: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """pair (its place in wanted), x, y, n: pair_counts() of many pairs of columns, in one pass over the table."""
    text = lambda c: quoted(c).cast("string")
    rows = F.array(*(F.struct(F.lit(i).alias("pair"), text(x).alias("x"), F.trim(text(y)).alias("y")) for i, (x, y) in enumerate(wanted)))
    return df.select(F.inline(rows)).filter("x is not null and y is not null").groupBy("pair", "x", "y").agg(F.count("*").alias("n"))


def mine(df: DataFrame, found: Profile, fuzzy: float | None = None, least: float | None = None, limit: int = 10_000) -> list[Dependency]:
    """All dependencies between columns whose cardinalities allow them. limit: the most spellings a mapping may bring to the driver;
    a larger one is written as a table (y, root) and joined when it is applied."""
    least = least if least is not None else (0.85 if fuzzy is not None else 0.98)
    n = found.meta["rows"]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    xs = [c for c, v in found.columns.items() if 1 < v["card"] < 0.95 * n and not isinstance(kinds[c], (T.DoubleType, T.FloatType))]
    plain = [c for c in df.columns if not isinstance(kinds[c], (T.ArrayType, T.MapType, T.StructType))]
    xs = [x for x in xs if x in plain]
    if not xs or len(plain) < 2:
        return []
    out, open_pairs = [], []
    for r in exact_matrix(df, xs, plain).collect():
        if r.is_exact:
            out.append(Dependency(r.determinant, r.dependent, True, 1.0))
        else:
            open_pairs.append((r.determinant, r.dependent))
    ys = sorted({y for _, y in open_pairs if not is_numeric(kinds[y]) and not isinstance(kinds[y], T.BooleanType)})
    fits = set(ys) - temporal(df, ys)
    open_pairs = [p for p in open_pairs if p[1] in fits]
    return out + _approximate(df, open_pairs, fuzzy or 85.0, least, limit) if open_pairs else out


def _approximate(df: DataFrame, wanted: list[tuple[str, str]], fuzzy: float, least: float, limit: int) -> list[Dependency]:
    """All pairs of columns at once, as one table with a number for each pair: the number of jobs doesn't depend on theirs."""
    key = ("pair",)
    pairs = staged(stacked(df, wanted), "pairs")
    spelled = staged(variants(pairs, fuzzy, key), "variants")
    mapping = staged(canonical(pairs, fuzzy, spelled, key), "spellings") if not spelled.isEmpty() else spelled.select("pair", F.col("a").alias("y"), F.col("b").alias("root"))
    scores = {r.pair: r.confidence for r in confidence(pairs, mapping, key).collect() if r.confidence is not None and r.confidence >= least}
    if not scores:
        return []
    changed = mapping.filter(F.col("pair").isin(*scores) & (F.col("y") != F.col("root")))
    sizes = {r.pair: r["count"] for r in changed.groupBy("pair").count().collect()}
    small: dict[int, dict[str, str]] = {i: {} for i in scores}
    for r in changed.filter(F.col("pair").isin(*[i for i in scores if sizes.get(i, 0) <= limit])).collect():
        small[r.pair][r.y] = r.root
    shown: dict[int, list[dict[str, str]]] = {i: [] for i in scores}
    place = F.row_number().over(Window.partitionBy("pair").orderBy("x", "a", "b"))
    for r in spelled.filter(F.col("pair").isin(*scores)).withColumn("place", place).filter("place <= 5").orderBy("pair", "place").collect():
        shown[r.pair].append({wanted[r.pair][0]: r.x, "values": f"{r.a} / {r.b}"})
    large = {i: staged_path(changed.filter(F.col("pair") == i).select("y", "root"), "mapping") for i in scores if sizes.get(i, 0) > limit}
    return [Dependency(*wanted[i], False, float(scores[i]), small[i], large.get(i), shown[i]) for i in sorted(scores)]


def top_values(pairs: DataFrame, k: int = 1) -> DataFrame:
    """x, y, n: the most frequent y of each x."""
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("n"), "y"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k).drop("place")
