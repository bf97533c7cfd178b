"""How much a cleaning loses: rows, shape of distributions, categories, wording, and what a model can predict."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.operators.normalize import quoted
from rinsework.operators.profile import is_numeric
from rinsework.session import prepare, staged

DIMS = 64
MOST_CHARS = 1 << 20  # that are turned into vectors at once; a longer text is taken whole


def volumetric(n_raw: int, n_clean: int) -> float:
    return max(0.0, (n_raw - n_clean) / n_raw) if n_raw > 0 else 0.0


def _tagged(raw: DataFrame, clean: DataFrame, column: str, kind: str) -> DataFrame:
    one = lambda df, i: df.select(quoted(column).cast(kind).alias("x"), F.lit(i).alias("side")).filter("x is not null")
    return one(raw, 0).unionByName(one(clean, 1))


def wasserstein(raw: DataFrame, clean: DataFrame, column: str, grid: int | None = None) -> DataFrame:
    """One row, w1: the first Wasserstein distance, in the raw column's population standard deviations.

    Both sides become counts of distinct values, dealt by ranges of the value: each range sums its own part of the area
    between the two distribution functions, starting from the totals of the ranges before it, which are a row each. grid:
    with that many steps, both quantile functions come from mergeable sketches instead and no value is sorted."""
    both = _tagged(raw, clean, column, "double").filter(~F.isnan("x"))
    a = F.when(F.col("side") == 0, F.col("x"))
    spread = F.when(F.stddev_pop(a) > 1e-8, F.stddev_pop(a)).when(F.max(a) != F.min(a), F.max(a) - F.min(a)).otherwise(F.lit(1.0))
    measures = [spread.alias("s"), F.count(a).alias("n0"), F.count(F.when(F.col("side") == 1, 1)).alias("n1")]
    if grid:
        at = F.array(*(F.lit((i + 0.5) / grid) for i in range(grid)))
        q = [F.percentile_approx(F.when(F.col("side") == i, F.col("x")), at, F.lit(10 * grid)) for i in (0, 1)]
        total = F.aggregate(F.zip_with("q0", "q1", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x) / grid / F.col("s")
        return both.agg(*measures, q[0].alias("q0"), q[1].alias("q1")).select(F.when((F.col("n0") == 0) | (F.col("n1") == 0), F.lit(0.0)).otherwise(F.round(total, 4)).alias("w1"))
    scale = both.agg(*measures).first()
    spark = raw.sparkSession
    if not scale["n0"] or not scale["n1"]:
        return spark.range(1).select(F.lit(0.0).alias("w1"))
    values = both.groupBy("x").agg(F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1"))
    ranged = staged(values.repartitionByRange("x").withColumn("p", F.spark_partition_id()), "ranges")  # a lost executor must not deal them anew
    totals = sorted(ranged.groupBy("p").agg(F.min("x").alias("first"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).collect())
    starts, f0, f1 = [], 0, 0
    for i, t in enumerate(totals):
        starts.append((t["p"], f0, f1, totals[i + 1]["first"] if i + 1 < len(totals) else None))
        f0, f1 = f0 + t["c0"], f1 + t["c1"]
    before = spark.createDataFrame(starts, "p int, b0 long, b1 long, following double")
    up = Window.partitionBy("p").orderBy("x")
    run = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = ranged.select("p", F.sum("c0").over(run).alias("f0"), F.sum("c1").over(run).alias("f1"), "x", F.lead("x").over(up).alias("next")).join(before, "p")
    gap = F.abs((F.col("f0") + F.col("b0")) / scale["n0"] - (F.col("f1") + F.col("b1")) / scale["n1"])
    return steps.agg(F.coalesce(F.round(F.sum(gap * F.coalesce(F.coalesce("next", "following") - F.col("x"), F.lit(0.0))) / scale["s"], 4), F.lit(0.0)).alias("w1"))


def jaccard(raw: DataFrame, clean: DataFrame, column: str) -> DataFrame:
    """One row, jaccard_loss: one less the share of distinct values that both sides have."""
    sides = _tagged(raw, clean, column, "string").groupBy("x").agg(F.count_distinct("side").alias("n"))
    return sides.agg(F.round(1 - F.coalesce(F.try_divide(F.count_if(F.col("n") == 2), F.count("*")), F.lit(1.0)), 4).alias("jaccard_loss"))


def bucket(gram: Column) -> Column:
    """0 to 63, the same in any process."""
    return F.pmod(F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long"), F.lit(DIMS))


def _buckets(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """bucket() of grams: three columns of characters, each one more than its code; 0 past a text's end. known: those of ASCII
    grams met before, -1 for others; it is filled in."""

    def digest(*gram: int) -> int:
        return hashlib.md5("".join(chr(x - 1) for x in gram if x).encode()).digest()[3] % DIMS

    out = np.empty(codes.shape[1], np.int64)
    plain = (codes < 128).all(axis=0)
    k = codes[0, plain] << 14 | codes[1, plain] << 7 | codes[2, plain]
    for x in np.unique(k[known[k] < 0]).tolist():
        known[x] = digest(x >> 14, x >> 7 & 127, x & 127)
    out[plain] = known[k]
    if not plain.all():
        k, back = np.unique(codes[0, ~plain] << 42 | codes[1, ~plain] << 21 | codes[2, ~plain], return_inverse=True)
        out[~plain] = np.array([digest(x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF) for x in k.tolist()], np.int64)[back]
    return out


def _vectors(texts: list[str], known: np.ndarray) -> np.ndarray:
    """A unit vector of bucketed 3-grams for each text, none of which is empty; a text under three characters is one gram."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends, grams = np.cumsum(size), np.maximum(1, size - 2)
    row = np.repeat(np.arange(len(texts)), grams)
    at = np.arange(len(row)) + np.repeat(ends - size - (np.cumsum(grams) - grams), grams)
    padded, end = np.append(codes, [0, 0]), ends[row]
    three = np.stack([padded[at], np.where(at + 1 < end, padded[at + 1], 0), np.where(at + 2 < end, padded[at + 2], 0)])
    counts = np.bincount(row * DIMS + _buckets(three, known), minlength=len(texts) * DIMS).reshape(-1, DIMS).astype(float)
    return counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))


def _directions(df: DataFrame, grouped: bool = False) -> DataFrame:
    """side, b, w: the sum over texts of their unit vectors of character 3-grams. Each task adds up its own rows where it reads
    them, equal texts of a batch as one: two vectors leave it, and no text is shuffled. grouped: df has each x once, with its
    numbers on both sides as c0 and c1; then b -1 has the number of values (side 0) and of those that both sides have (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, met, known = np.zeros((2, DIMS)), np.zeros(2), np.full(1 << 21, -1, np.int8)
        for batch in batches:
            coded, n = batch.column("t").dictionary_encode(), np.stack([batch.column(c).to_numpy() for c in ("c0", "c1")])
            met += n.shape[1], np.count_nonzero((n > 0).all(axis=0))
            index, texts = coded.indices.to_numpy(), coded.dictionary
            weights = np.stack([np.bincount(index, x, len(texts)) for x in n])
            size = pc.utf8_length(texts).to_numpy().astype(np.int64)
            weights, texts, size = weights[:, size > 0], texts.filter(pa.array(size > 0)), size[size > 0]
            part = np.cumsum(size) // MOST_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start < stop:
                    sums += weights[:, start:stop] @ _vectors(texts[start:stop].to_pylist(), known)
        i, b = np.nonzero(sums)
        w = sums[i, b]
        if grouped:
            i, b, w = np.append(i, [0, 1]), np.append(b, [-1, -1]), np.append(w, met)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(b, pa.int64()), pa.array(w)], ["side", "b", "w"])

    prepare(df.sparkSession)
    numbers = ["c0", "c1"] if grouped else [(F.col("side") == i).cast("long").alias(f"c{i}") for i in (0, 1)]
    texts = df.select(F.trim(F.lower("x")).alias("t"), *numbers).filter("t is not null")
    return texts.mapInArrow(run, "side int, b long, w double").groupBy("side", "b").agg(F.sum("w").alias("w"))


def _compared(directions: DataFrame) -> tuple[DataFrame, Column]:
    """b, with a and c for both sides; the cosine distance over its rows."""
    sums = directions.groupBy("b").agg(
        F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("w"))), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("w"))), F.lit(0.0)).alias("c")
    )
    a, c = (F.when(F.col("b") >= 0, F.col(x)) for x in ("a", "c"))
    cosine = F.try_divide(F.sum(a * c), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(c * c)))
    return sums, F.round(F.greatest(F.lit(0.0), 1 - F.coalesce(cosine, F.lit(1.0))), 4).alias("cosine_distance")


def drift(raw: DataFrame, clean: DataFrame, column: str) -> DataFrame:
    """One row, cosine_distance between the mean directions of both sides' texts."""
    sums, distance = _compared(_directions(_tagged(raw, clean, column, "string")))
    return sums.agg(distance)


def wording(raw: DataFrame, clean: DataFrame, column: str) -> DataFrame:
    """One row, jaccard_loss and cosine_distance: what jaccard() and drift() give, from one grouping by value. It also deals the
    values out, so that a table of one file or row group doesn't get its vectors from one task."""
    values = _tagged(raw, clean, column, "string").groupBy("x").agg(*(F.count_if(F.col("side") == i).alias(f"c{i}") for i in (0, 1)))
    sums, distance = _compared(_directions(values, grouped=True))
    n, both = (F.sum(F.when(F.col("b") < 0, F.col(x))) for x in ("a", "c"))
    return sums.agg(F.round(1 - F.coalesce(F.try_divide(both, n), F.lit(1.0)), 4).alias("jaccard_loss"), distance)


@dataclass
class Utility:
    raw: float | None = None
    clean: float | None = None
    status: str = "skipped"

    @property
    def delta(self) -> float:
        return round(self.clean - self.raw, 4) if self.status == "measured" else 0.0


def utility(raw: DataFrame, clean: DataFrame, target: str | None = None, least: int = 50, most: int = 2_000) -> Utility:
    """Small boosted trees, learnt from a sample of either side and scored on held-out raw rows. Samples and folds go by a
    hash of the whole row, so they are the same in every run and for any partitions; equal rows are one with their number as its
    weight. A sample, about `most` rows however large the table, is one partition in the order of its hashes: forests draw
    their rows by partition and position. Categories are coded from the raw side for both. With too few rows, or a side without rows to learn from or to
    score, nothing is measured, and the status says why."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    target = target if target in raw.columns else raw.columns[-1]
    inputs = [c for c in raw.columns if c != target and c in clean.columns and (is_numeric(raw.schema[c].dataType) or isinstance(raw.schema[c].dataType, (T.StringType, T.BooleanType)))]
    if not inputs or target not in clean.columns:
        return Utility()
    kinds = {c: raw.schema[c].dataType for c in [*inputs, target]}

    def sample(df: DataFrame) -> tuple[DataFrame, int]:
        n = df.count()
        share = min(1.0, max(least / max(n, 1), min(0.05, most / max(n, 1))))
        cast = [quoted(c).cast("double" if is_numeric(kinds[c]) else "string").alias(c) for c in [*inputs, target]]
        whole = [quoted(f.name).cast("string") if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(quoted(f.name)) for f in df.schema.fields]
        rows = df.select(*cast, F.xxhash64(*(F.coalesce(c, F.lit("\u0000")) for c in whole)).alias("_h"))
        chosen = rows.filter(F.pmod("_h", F.lit(1 << 60)) < int(share * (1 << 60))).na.drop()
        return chosen.groupBy(*map(quoted, chosen.columns)).agg(F.count("*").cast("double").alias("_w")).coalesce(1).sortWithinPartitions("_h"), n

    (own, n_raw), (other, n_clean) = sample(raw), sample(clean)
    own, other = own.persist(), other.persist()
    if n_raw < 20 or n_clean < 20 or own.count() < 10 or other.count() < 10:
        return Utility(status="skipped: too few rows")
    classes = own.select(target).distinct().count()
    classify = not is_numeric(kinds[target]) or classes <= 10
    words = [c for c in inputs if not is_numeric(kinds[c])]
    code = StringIndexer(inputCols=[*words, *([target] if classify else [])], outputCols=[*(f"_{c}" for c in words), *(["_y"] if classify else [])], handleInvalid="keep")
    coded = code.fit(own) if words or classify else None
    assemble = VectorAssembler(inputCols=[f"_{c}" if c in words else c for c in inputs], outputCol="_x", handleInvalid="skip")

    def ready(df: DataFrame) -> DataFrame:
        df = coded.transform(df) if coded else df
        return assemble.transform(df.withColumns({f"_{c}": F.col(f"_{c}") + F.lit(0.0) for c in words}) if words else df)  # codes as numbers: columns may have any number of them

    as_y = (lambda df: df) if classify else (lambda df: df.withColumn("_y", F.col(f"`{target}`")))
    ours, theirs = as_y(ready(own)), as_y(ready(other)).filter(F.col("_y") < classes if classify else F.lit(True))
    fold = F.pmod(F.xxhash64("_h"), F.lit(10))
    test = ours.filter(fold >= 7)
    common = {"featuresCol": "_x", "labelCol": "_y", "weightCol": "_w", "seed": 42, "maxBins": 512}
    if not classify:
        model = GBTRegressor(maxIter=20, maxDepth=3, stepSize=0.1, **common)
    elif classes <= 2:
        model = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.1, **common)
    else:
        model = RandomForestClassifier(numTrees=20, maxDepth=3, **common)

    def score(train: DataFrame) -> float:
        said = model.fit(train.filter(fold < 7)).transform(test)
        if classify:
            return MulticlassClassificationEvaluator(labelCol="_y", weightCol="_w", metricName="accuracy").evaluate(said)
        r = said.agg((F.sum(F.col("_w") * (F.col("_y") - F.col("prediction")) ** 2) / F.sum("_w")).alias("mse"), (F.sum(F.col("_w") * F.col("_y") ** 2) / F.sum("_w") - (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")) ** 2).alias("var")).first()
        return max(0.0, 1 - r["mse"] / (r["var"] + 1e-8))

    try:
        if ours.filter(fold < 7).isEmpty() or theirs.filter(fold < 7).isEmpty() or test.isEmpty():
            return Utility(status="skipped: no rows to learn from or to score")
        return Utility(round(score(ours), 4), round(score(theirs), 4), "measured")
    finally:
        own.unpersist()
        other.unpersist()


@dataclass
class LossReport:
    n_raw: int = 0
    n_clean: int = 0
    volumetric: float = 0.0
    w1: dict[str, float] = field(default_factory=dict)
    jaccard: dict[str, float] = field(default_factory=dict)
    cosine: dict[str, float] = field(default_factory=dict)
    utility: Utility = field(default_factory=Utility)
    reasons: list[str] = field(default_factory=list)

    @property
    def safe(self) -> bool:
        return not self.reasons

    @property
    def recommendation(self) -> str:
        return "commit" if self.safe else "blocked: " + "; ".join(self.reasons)


@dataclass(frozen=True)
class Limits:
    volumetric: float = 0.15
    w1: float = 0.35
    cosine: float = 0.20
    jaccard: float | None = None  # reported; enforced where one is given
    utility: bool = True


def assess(raw: DataFrame, clean: DataFrame, target: str | None = None, limits: Limits | None = None, with_utility: bool = True, grid: int | None = None) -> LossReport:
    """Everything, over the final table, rows removed by validation included."""
    limits = limits or Limits()
    out = LossReport(raw.count(), clean.count())
    out.volumetric = round(volumetric(out.n_raw, out.n_clean), 4)
    for f in raw.schema.fields:
        if f.name not in clean.columns:
            continue
        if is_numeric(f.dataType) and is_numeric(clean.schema[f.name].dataType):
            out.w1[f.name] = wasserstein(raw, clean, f.name, grid).first()[0]
        elif isinstance(f.dataType, T.StringType):
            out.jaccard[f.name], out.cosine[f.name] = wording(raw, clean, f.name).first()
    if with_utility:
        out.utility = utility(raw, clean, target)
    if out.volumetric > limits.volumetric:
        out.reasons.append(f"{out.volumetric:.2%} of the rows are lost, more than {limits.volumetric:.0%}")
    for name, found, most in (("W1", out.w1, limits.w1), ("cosine distance", out.cosine, limits.cosine), ("Jaccard loss", out.jaccard, limits.jaccard)):
        out.reasons += [f"{name} of {c} is {v}, more than {most}" for c, v in found.items() if most is not None and v > most]
    if limits.utility and out.utility.delta < 0:
        out.reasons.append(f"a model predicts worse by {-out.utility.delta}")
    return out
