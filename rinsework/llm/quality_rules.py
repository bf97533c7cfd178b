"""Quality rules whose thresholds come from the corpus: quantile sketches by language and source. DataFrame functions only.

Each document is measured by itself (words, symbols, repeated lines and three-word windows). Ratios of those counts go,
as whole per mille, into sketches: counts on a fixed grid for each metric, language and source. Such a sketch merges by
adding, so any partition, order or retry gives the same one, its error is the grid's step, and its size is bounded by
the grid. Sketches of sources are merged to the language's, and those to the corpus's, for groups of too few documents.

A metric's fence lies beyond a quantile of its group by a multiple of the group's own spread: four quartile distances for word
length, on both sides; for symbols three above the upper quartile; and for repeated lines and windows, which most documents
lack, as far above the 99th percentile as that is above the median. So each language and source has thresholds of its
own. Only where the spread is zero, because nearly all documents of a group have one value, a fixed floor stands in for it. A
document is kept if it passes the base rules and is within the fences of its group. Documents that fail the base rules don't
count in the sketches.

Texts are read once: measures are written as a short row each. The join with the fences is by language and source, with the
fences broadcast only if their written size is under Spark's limit, and otherwise a sort-merge join that is split where
a source is hot.

Defined cases: a null text has no words and fails; null languages and sources are groups of their own; ratios with
nothing below the line are 0; repeated rows stay repeated; texts of any length are measured whole, in time n log n; no
rows give no rows; other columns are ignored, and filtering returns the rows as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinsework.session import staged

SPACE = " \t\n\x0b\f\r"
#: metric: lower and upper quantile (per cent), multiple of their distance, floor where that is zero, and whether both sides count
FENCES = {"symbols": (25, 75, 3, 30, False), "dup_lines": (50, 99, 1, 500, False), "repeats": (50, 99, 1, 250, False), "word_length": (25, 75, 4, 250, True)}
LEAST = 100  # documents that a group needs for fences of its own
LONGEST = 10_000  # the last bucket of word lengths, in hundredths: longer words share it
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _covered(marked: Column) -> Column:
    """Where windows that occur twice or more begin. marked: sorted (hash, position) of all windows, or empty if none recurs."""
    near = lambda j, e: F.coalesce(F.get(marked, j)["h"] == e["h"], F.lit(False))
    return F.transform(F.filter(marked, lambda e, j: near(j - 1, e) | near(j + 1, e)), lambda e: e["i"])


def measure(docs: DataFrame, *more: str | Column) -> DataFrame:
    """The counts of each document, with n_lines and base_failed, beside the columns named in more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.trim(text, F.lit(SPACE))
    # a line's words are told from its first visible character on; a window's hash is of its three words
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step1 = docs.select(*more, text.alias("_text"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("_words"), lines.alias("_lines"))
    step2 = step1.withColumns(
        {
            "_hashes": F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(F.array().cast("array<bigint>")),
            "_n": F.size("_words").cast("long"),
            "_chars": F.length(F.array_join("_words", "")).cast("long"),
            "_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
            "_nlines": F.size("_lines").cast("long"),
            "_dups": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_text", "_lines", "_words")
    marked = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)
    step3 = step2.withColumn("_marked", marked).drop("_hashes")
    step4 = step3.withColumn("_starts", F.array_sort(_covered(F.col("_marked")))).drop("_marked")
    spread = F.transform("_starts", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_starts", j + 1) - p, F.lit(3))))
    kept = [c for c in step1.columns if c not in ("_text", "_words", "_lines")]
    # a filter isn't pushed below what isn't deterministic; there it would hold copies of all these expressions
    here = 0 * F.monotonically_increasing_id()
    counted = step4.select(
        *kept,
        (F.col("_n") + here).alias("n_words"),
        F.col("_chars").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        F.col("_dups").alias("n_dup_lines"),
        F.aggregate(spread, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.col("_nlines").alias("n_lines"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ratios() -> dict[str, Column]:
    over = lambda a, b, times=1000: F.floor(times * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {"symbols": over("n_symbols", "word_chars"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"), "word_length": F.least(over("word_chars", "n_words", 100), F.lit(LONGEST))}


def sketch(measured: DataFrame) -> DataFrame:
    """level, lang, source, metric, bucket, n: merged sketches of every source (2), language (1) and the whole (0)."""
    entry = F.array(*(F.struct(F.lit(m).alias("metric"), r.cast("long").alias("bucket")) for m, r in _ratios().items()))
    finest = measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(entry).alias("e")).groupBy("lang", "source", "e.metric", "e.bucket").agg(F.count("*").alias("n"))
    null = F.lit(None).cast("string")
    levels = F.array(*(F.struct(F.lit(k).alias("level"), (F.col("lang") if k else null).alias("lang"), (F.col("source") if k == 2 else null).alias("source")) for k in range(3)))
    return finest.select(F.explode(levels).alias("g"), "metric", "bucket", "n").select("g.*", "metric", "bucket", "n").groupBy("level", "lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(measured: DataFrame) -> DataFrame:
    """lang, source, and a column low_ and high_ for each metric: a row for each group of documents that passes the base rules."""
    group = Window.partitionBy("level", "lang", "source", "metric")
    ranked = sketch(measured).withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("bucket")))
    bounds = sorted({q for lower, upper, *_ in FENCES.values() for q in (lower, upper)})
    quartiles = ranked.groupBy("level", "lang", "source", "metric").agg(*(at(q).alias(f"q{q}") for q in bounds), F.max("all").alias("all"))
    columns = []
    for metric, (lower, upper, times, floor, both) in FENCES.items():
        own, low, high = F.col("metric") == metric, F.col(f"q{lower}"), F.col(f"q{upper}")
        spread = F.when(high > low, times * (high - low)).otherwise(F.lit(floor))
        columns.append(F.max(F.when(own, high + spread)).alias(f"high_{metric}"))
        if both:
            columns.append(F.max(F.when(own, low - spread)).alias(f"low_{metric}"))
    by_group = quartiles.groupBy("level", "lang", "source").agg(F.max("all").alias("all"), *columns)
    names = [c for c in by_group.columns if c.startswith(("high_", "low_"))]
    bound = by_group.select("level", "lang", "source", "all", F.struct(*names).alias("bounds"))
    groups = by_group.filter("level = 2").select("lang", "source")
    null = F.lit(None).cast("string")
    wanted = groups.select("lang", "source", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level")).select(
        "lang", "source", "level", F.when(F.col("level") > 0, F.col("lang")).otherwise(null).alias("l"), F.when(F.col("level") == 2, F.col("source")).otherwise(null).alias("s")
    )
    b = bound.select(F.col("level").alias("b_level"), F.col("lang").alias("b_lang"), F.col("source").alias("b_source"), "all", "bounds")
    met = wanted.join(b, (F.col("level") == F.col("b_level")) & F.col("l").eqNullSafe(F.col("b_lang")) & F.col("s").eqNullSafe(F.col("b_source")))
    enough = (F.col("all") >= LEAST) | (F.col("level") == 0)
    return met.filter(enough).groupBy("lang", "source").agg(F.max_by("bounds", "level").alias("bounds")).select("lang", "source", "bounds.*")


def verdict(measured: DataFrame, found: DataFrame) -> DataFrame:
    """measured with the column kept."""
    within = F.lit(True)
    for metric, ratio in _ratios().items():
        within &= ratio <= F.col(f"high_{metric}")
        if FENCES[metric][-1]:
            within &= ratio >= F.col(f"low_{metric}")
    g = found.withColumnRenamed("lang", "g_lang").withColumnRenamed("source", "g_source")
    joined = measured.join(g, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).select(*measured.columns, "kept")


def _strings(docs: DataFrame) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in ("lang", "source")]


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept."""
    measured = staged(measure(docs, "doc_id", *_strings(docs)), "measures")
    return verdict(measured, staged(fences(measured), "fences")).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rejected ones. Every text is measured once: documents are written with their measures and read again."""
    measured = staged(measure(docs, F.struct(*(F.col(c) for c in docs.columns)).alias("_doc"), *_strings(docs)), "measures")
    return verdict(measured, staged(fences(measured), "fences")).filter("kept").select("_doc.*")
