"""String expressions: similarity, typo variants, phones, dates, names. All stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; one row of the table at a time. 0 if either is empty."""

    def cell(prev: Column, cur: Column, j: Column, same: Column) -> Column:
        left = lambda row: F.coalesce(F.get(row, j - 2), F.lit(0))
        return F.when(same, 1 + left(prev)).otherwise(F.greatest(F.get(prev, j - 1), left(cur)))

    def row(prev: Column, ca: Column) -> Column:
        start = F.array().cast("array<int>")
        return F.aggregate(F.sequence(F.lit(1), F.length(b)), start, lambda cur, j: F.concat(cur, F.array(cell(prev, cur, j, F.substr(b, j, F.lit(1)) == ca))))

    whole = F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), F.length(b)), row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(whole, -1))


def similarity(a: Column, b: Column) -> Column:
    """0 to 100: twice the longest common subsequence over both lengths."""
    both = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(100.0)).when(both == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b).cast("double") / both)


def similar(a: Column, b: Column, least: float) -> Column:
    """similarity(a, b) >= least. The edit distance is under the subsequence's, so it rules most pairs out cheaply."""
    most = F.floor((1 - least / 100) * (F.length(a) + F.length(b)) + 1e-9)
    return F.when(F.levenshtein(a, b) > most, F.lit(False)).otherwise(similarity(a, b) >= least)


def mismatches(a: Column, b: Column) -> Column:
    """Positions that differ, over the shorter length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), F.lit(1)).otherwise(F.lit(0)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def typo_variants(a: Column, b: Column, least: float = 85.0) -> Column:
    """Whether two spellings mean one thing: the same digits, and alike, a prefix, or one character apart."""
    a, b = F.trim(a), F.trim(b)
    x, y = F.lower(a), F.lower(b)
    shorter = F.least(F.length(x), F.length(y))
    prefix = F.startswith(x, y) | F.startswith(y, x)
    near = (F.abs(F.length(a) - F.length(b)) <= 1) & (mismatches(x, y) <= 1)
    return F.when(a == b, F.lit(True)).when(digits(a) != digits(b), F.lit(False)).when(x == y, F.lit(True)).otherwise((shorter >= 4) & (prefix | near) | similar(x, y, min(least, 85.0)))


def title(c: Column) -> Column:
    """Capitals after anything that isn't a letter, as Python's title() has them; initcap knows white space only."""
    parts = F.regexp_extract_all(c, F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.concat_ws("", F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2), F.length(p))))))


def is_title(c: Column) -> Column:
    return (c == title(c)) & c.rlike(r"\p{L}")


def phone_e164(c: Column) -> Column:
    """+1 and +91 layouts, else the trimmed value."""
    t, d = F.trim(c), digits(c)
    n = F.length(d)
    us = lambda x: F.concat(F.lit("+1-"), F.substr(x, F.lit(1), F.lit(3)), F.lit("-"), F.substr(x, F.lit(4), F.lit(3)), F.lit("-"), F.substr(x, F.lit(7), F.length(x)))
    india = lambda x: F.concat(F.lit("+91-"), F.substr(x, F.lit(1), F.lit(5)), F.lit("-"), F.substr(x, F.lit(6), F.length(x)))
    rest = lambda k: F.substr(d, F.lit(k + 1), F.length(d))
    return (
        F.when(F.startswith(t, F.lit("+1")) | F.startswith(t, F.lit("1-")) | ((n == 11) & F.startswith(d, F.lit("1"))), us(F.when(n == 10, d).otherwise(rest(1))))
        .when(F.startswith(t, F.lit("+91")) | ((n == 12) & F.startswith(d, F.lit("91"))), india(rest(2)))
        .when((n == 10) & d.rlike("^[6-9]"), india(d))
        .when(n == 10, us(d))
        .otherwise(t)
    )


def date_iso(c: Column) -> Column:
    """Year-month-day. A day above 12 in second place means month first; else the day is first. Anything else stays."""
    t = F.translate(F.trim(c), "./", "--")
    part = lambda form, i: F.lpad(F.regexp_extract(t, form, i), 2, "0")
    ymd, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    year = F.regexp_extract(t, dmy, 3)
    month_first = F.regexp_extract(t, dmy, 2).try_cast("int") > 12
    return (
        F.when(t.rlike(ymd), F.concat_ws("-", F.regexp_extract(t, ymd, 1), part(ymd, 2), part(ymd, 3)))
        .when(t.rlike(dmy) & month_first, F.concat_ws("-", year, part(dmy, 1), part(dmy, 2)))
        .when(t.rlike(dmy), F.concat_ws("-", year, part(dmy, 2), part(dmy, 1)))
        .otherwise(F.trim(c))
    )


def phone_india(c: Column) -> Column:
    """For tables: +91- and ten digits; too few digits give null; anything else stays."""
    t, d = F.trim(c), digits(c)
    return (
        F.when(F.length(d) == 10, F.concat(F.lit("+91-"), d))
        .when((F.length(d) == 12) & F.startswith(d, F.lit("91")), F.concat(F.lit("+91-"), F.substr(d, F.lit(3), F.lit(10))))
        .when((F.length(d) > 0) & (F.length(d) < 10), F.lit(None).cast("string"))
        .otherwise(t)
    )


def name_words(column: str) -> set[str]:
    """The words of a column's name, cut at underscores, hyphens, blanks and humps."""
    import re

    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", column)}
