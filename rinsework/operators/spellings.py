"""Pairs of spellings that may be one thing, without comparing all with all.

A pair of texts within one group (a value of the determinant, a document) is only looked at if the two share a signature:

* the whole of one is a beginning of the other: one is looked up among the beginnings of the other;
* they differ in one place at most, over the shorter: of two halves one is the same, so both are signatures, with the length;
* their longest common subsequence is at least `least` percent: then d deletions and insertions at most turn the shorter into the longer, d
  from both lengths (and as odd as their difference). Of d + 1 segments of the shorter one is untouched, and stands in the longer at its
  place, moved by no more than the segments before it and after it allow. So the shorter has a signature for each length of a partner and
  each segment, and the longer one for each of their places. Above LONG characters, where these grow with the square of the length, the
  bags of characters decide instead: alike texts have as many in common, so of the rarest few of each one is the same.

Candidates are joined by group and signature; a signature that many texts of a group share is cut into a grid
of pieces, so that no task has more than `piece` by `piece` of them however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.session import staged

LONG = 64
FREQUENT = " etaoinshrdlcumwfgypbvkjxqz"  # fixed values: characters from the most frequent on


def _signature(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def _beginnings(k: Column, least: int) -> Column:
    """Of at least `least` characters, and the whole."""
    some = F.when(F.length(k) > least, F.sequence(F.lit(least), F.length(k) - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(_signature("begin", k)), F.transform(some, lambda n: _signature("begin", F.substr(k, F.lit(1), n))))


def _halves(k: Column, short: int, sizes: tuple[int, ...]) -> Column:
    """Of the first n and n - 1 characters (sizes 0, 1), where these are at least `short`."""
    out = []
    for less in sizes:
        m = F.length(k) - less
        for half, text in enumerate((F.substr(k, F.lit(1), F.floor(m / 2).cast("int")), F.substr(k, (F.floor(m / 2) + 1).cast("int"), (m - F.floor(m / 2)).cast("int")))):
            out.append(F.when(m >= short, _signature("half", m, F.lit(half), text)))
    return F.array_compact(F.array(*out))


def _numbers(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def _edits(short: Column, long: Column, least: float) -> Column:
    """The most deletions and insertions between texts of these lengths that are alike."""
    most = F.floor((short + long) * (1 - least / 100) + 1e-9).cast("int")
    return most - F.pmod(most - (long - short), F.lit(2))


def _segment(length: Column, count: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of `count` segments."""
    start = F.floor(i * length / count).cast("int")
    return start, F.floor((i + 1) * length / count).cast("int") - start


def _own_segments(k: Column, least: float) -> Column:
    """Of the shorter text, for each length of the longer."""
    n = F.length(k)

    def of(other: Column) -> Column:
        d = _edits(n, other, least)

        def one(i: Column) -> Column:
            start, size = _segment(n, d + 1, i)
            return _signature("segment", n, other, i, F.substr(k, start + 1, size))

        return F.transform(_numbers(F.lit(0), d), one)

    return F.flatten(F.transform(_numbers(n, F.floor(n * (200 - least) / least + 1e-9)), of))


def _places(k: Column, least: float) -> Column:
    """Of the longer text: where a segment of a shorter one, of each length, may stand."""
    n = F.length(k)

    def of(other: Column) -> Column:
        d, more = _edits(other, n, least), n - other

        def at(i: Column) -> Column:
            start, size = _segment(other, d + 1, i)
            moved = _numbers(F.greatest(-i, more - d + i, -start), F.least(i, more + d - i, n - size - start))
            return F.transform(moved, lambda by: _signature("segment", other, n, i, F.substr(k, start + by + 1, size)))

        return F.flatten(F.transform(_numbers(F.lit(0), d), at))

    return F.flatten(F.transform(_numbers(F.ceil(n * least / (200 - least) - 1e-9), n), of))


def _rarest(k: Column, least: float, same_digits: bool) -> Column:
    """The rarest characters, each with its number among equal ones: as many as must meet those of any text alike enough."""
    chars = F.array_sort(F.filter(F.split(k, ""), lambda c: c != ""))
    n = F.length(k)
    partner = F.ceil(n * least / (200 - least))  # the shortest text that can be alike
    many = F.size(chars) - F.ceil((n + partner) * least / 200 - 1e-9).cast("int") + 1
    digit = lambda c: c.rlike("[0-9]")
    usual = lambda c: F.when(digit(c), 12).when(F.instr(F.lit(FREQUENT), c) > 0, F.instr(F.lit(FREQUENT), c)).otherwise(len(FREQUENT) + 5)
    marked = F.transform(chars, lambda c, i: F.struct(c.alias("c"), (i - F.array_position(chars, c) + 2).alias("at")))
    rare = lambda m: F.when(F.lit(same_digits) & digit(m["c"]), 0).otherwise(usual(m["c"]) + 8 * (m["at"] - 1))
    ranked = F.transform(marked, lambda m: F.struct((-rare(m)).alias("w"), m["c"].alias("c"), m["at"].alias("at")))
    return F.transform(F.slice(F.array_sort(ranked), F.lit(1), F.greatest(many, F.lit(0))), lambda m: _signature("bag", m["c"], m["at"]))


def alike_signatures(k: Column, least: float, same_digits: bool = False) -> tuple[Column, Column]:
    """For the shorter and for the longer of two texts: if they are alike (`similarity` of `least` or more), one of the first is among the
    second. Texts of one length have both roles."""
    none = F.array().cast("array<bigint>")
    segments = lambda f: F.when(F.length(k) <= LONG, f(k, least)).otherwise(none)
    bag = F.when(F.length(k) * (200 - least) / least > LONG, _rarest(k, least, same_digits)).otherwise(none)
    return F.concat(bag, segments(_own_segments)), F.concat(bag, segments(_places))


def candidates(values: DataFrame, by: list[str], least: float, begins: int | None = None, near: int = 0, same_digits: bool = False, piece: int = 2000) -> DataFrame:
    """by..., a, b (a < b): each pair that can be alike, once or more often. values: by..., v (unique in its group) and k, the text that is compared.

    begins: the least length of a text that is a beginning of another; None: beginnings don't count. near: the least length of the
    shorter of two texts that differ in one place. same_digits: all texts of a group have the same digits, so these
    say nothing. Null keys join nothing."""
    many = staged(values.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by), "groups")
    values = staged(values.join(many, by, "left_semi"), "values")  # a text alone in its group meets none: it needs no signatures
    k = F.col("k")
    shorter, longer = alike_signatures(k, least, same_digits)
    left = F.concat(F.array(_signature("begin", k)), _halves(k, near, (0,)), shorter)
    right = F.concat(F.array(_signature("begin", k)) if begins is None else _beginnings(k, begins), _halves(k, near, (0, 1)), longer)
    sides = [staged(values.select(*by, F.col("v").alias(n), F.explode(F.array_distinct(s)).alias("s")), f"signatures-{n}") for n, s in (("a", left), ("b", right))]
    hot = sides[1].groupBy(*by, "s").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces")).filter("pieces > 1")
    hot = staged(hot, "hot")  # both sides of the join are plain shuffles then, which the optimiser may split
    pieces = F.coalesce("pieces", F.lit(1))
    own = lambda n: F.pmod(F.xxhash64(n), pieces).cast("int")
    all_ = F.explode(F.sequence(F.lit(0), pieces - 1))
    cut = [s.join(hot, [*by, "s"], "left") for s in sides]
    a = cut[0].select(*by, "s", "a", own("a").alias("i"), all_.alias("j"))
    b = cut[1].select(*by, "s", "b", all_.alias("i"), own("b").alias("j"))
    met = a.join(b, [*by, "s", "i", "j"]).filter("a <> b")
    return met.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
