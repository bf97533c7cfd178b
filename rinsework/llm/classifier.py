"""Quality classifier by co-training: one classifier sees a document's text, another its metadata.

Both start from the labelled documents of a bounded sample. In each round each of them labels the unlabelled documents that
it is most sure of, for the other to learn from. Each view is then calibrated on labels that it has not seen, and a
logistic combination of the two calibrated views, fitted on the same, scores every document of the corpus.

The sample is the documents whose hashed id is under a share (the bound is a parameter). Labelled documents come first: at
least half of the bound is theirs if there are so many, and unlabelled ones fill it up. Its features come to the driver as a
fixed number of bytes each. Scoring reads each document once, where it lies, with a few kilobytes of weights.

Defined cases: a null text is empty; null or unknown languages, sources and lengths have features of their own; labels that
disagree count by their mean; labels of both classes are learnt from however few they are; with labels of one class only, or none, nothing can be learnt and every document is kept with
a score of 1, and a warning says so; of rows that repeat an id one is learnt from; ties in certainty go by id; texts of any length are
read whole; repeated rows are scored as often as they occur; null ids are scored; no rows give no rows; other columns are ignored,
and filtering returns the rows as they were.
"""

from __future__ import annotations

import math
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.llm.workers import tidy
from rinsework.session import staged

BIGRAMS, LANGS, SOURCES = 128, 16, 64
SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
KINDS = [
    np.array([65 <= b <= 90 for b in range(256)]),
    np.array([97 <= b <= 122 for b in range(256)]),
    np.array([48 <= b <= 57 for b in range(256)]),
    SYMBOLS,
    np.array([b == 33 for b in range(256)]),
    np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)]),
    np.array([b == 10 for b in range(256)]),
    np.array([chr(b) in ".,;:?()\"'-" for b in range(256)]),
    np.array([b >= 128 for b in range(256)]),
]


def text_view(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    b = np.frombuffer(raw, np.uint8)
    counts = np.bincount(b, minlength=256)
    shares = [math.sqrt(counts[k].sum() / size) for k in KINDS]
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    pairs = np.bincount((b[:-1].astype(np.int32) * 31 + b[1:]) % BIGRAMS, minlength=BIGRAMS) if len(b) > 1 else np.zeros(BIGRAMS)
    own = [*shares, len(set(words)) / n, again, min(sum(map(len, words)) / n, 40) / 10, math.log1p(len(words)) / 10, float(not words)]
    return np.concatenate([own, np.sqrt(pairs / size)]).astype(np.float32)


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(2 + LANGS + SOURCES, np.float32)
    out[0], out[1] = (math.log1p(max(n_chars, 0)) / 10, 0) if n_chars is not None else (0, 1)
    for at, size, value in ((2, LANGS, lang), (2 + LANGS, SOURCES, source)):
        out[at + (zlib.crc32(value.encode()) % (size - 1) + 1 if value is not None else 0)] = 1
    return out


@dataclass
class Logistic:
    """Ridge logistic regression by Newton's method on standardised features."""

    ridge: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.mean) * self.scale, np.ones((len(x), 1))], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 25) -> Logistic:
        x = x.astype(float)
        self.mean, spread = x.mean(0), x.std(0)
        self.scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)
        wide, weight = self._wide(x), np.ones(len(x)) if weight is None else weight
        penalty = np.full(wide.shape[1], self.ridge)
        penalty[-1] = 1e-6
        w = np.zeros(wide.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(wide @ w, -30, 30)))
            h = (wide * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ wide + np.diag(penalty)
            change = np.linalg.solve(h, wide.T @ (weight * (y - p)) - penalty * w)
            w = w + np.clip(change, -2, 2)
            if np.abs(change).max() < 1e-6:
                break
        self.weights = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._wide(x.astype(float)) @ self.weights, -30, 30)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


@dataclass
class CoTrained:
    """base: what to say if nothing could be learnt."""

    base: float = 1.0
    views: list[Logistic] = field(default_factory=list)
    calibrations: list[Logistic] = field(default_factory=list)
    joint: Logistic | None = None
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chance by text, by metadata, and combined."""
        if self.joint is None:
            same = np.full(len(text), self.base)
            return same, same, same
        logits = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (text, meta), strict=True)]
        by_view = [1 / (1 + np.exp(-x)) for x in logits]
        return *by_view, self.joint.chance(np.stack(logits, 1))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray, rounds: int = 4, sure: float = 0.97, each: int = 400) -> CoTrained:
    """y: 1, 0, or NaN where unlabelled. fold: 1 for labels that are kept for the calibration, 0 for those learnt from, 2 for both."""
    known = ~np.isnan(y)
    if len(np.unique(y[known & (fold != 1)])) < 2 or len(np.unique(y[known & (fold != 0)])) < 2:
        return CoTrained()
    target = [np.where(fold == 1, np.nan, y), np.where(fold == 1, np.nan, y)]  # what each view learns from
    told: list[tuple[int, int]] = []
    fit = lambda v: Logistic().fit(views[v][~np.isnan(target[v])], target[v][~np.isnan(target[v])], np.where(known, 1.0, 0.3)[~np.isnan(target[v])])
    models = [fit(0), fit(1)]
    for _ in range(rounds):
        new = []
        for v in (0, 1):
            p = models[v].chance(views[v])
            free = ~known & np.isnan(target[1 - v])
            for label, certainty in ((1.0, p), (0.0, 1 - p)):
                ready = np.flatnonzero(free & (certainty >= sure))
                new.append((1 - v, ready[np.argsort(-certainty[ready], kind="stable")][:each], label))
        for v, rows, label in new:
            target[v][rows] = label
        told.append((sum(len(r) for v, r, _ in new if v == 1), sum(len(r) for v, r, _ in new if v == 0)))
        models = [fit(0), fit(1)]
        if told[-1] == (0, 0):
            break
    test = known & (fold != 0)
    calibrations = [Logistic(0.1).fit(m.logit(x[test])[:, None], y[test]) for m, x in zip(models, views, strict=True)]
    logits = np.stack([c.logit(m.logit(x[test])[:, None]) for m, c, x in zip(models, calibrations, views, strict=True)], 1)
    return CoTrained(1.0, models, calibrations, Logistic(0.1).fit(logits, y[test]), told)


def folds(y: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each class a quarter is kept for the calibration, one label at least; a class's only label serves both. place: an order by chance."""
    out = np.zeros(len(y), np.int8)
    for label in (0.0, 1.0):
        own = np.flatnonzero(y == label)
        own = own[np.argsort(place[own], kind="stable")]
        out[own[: max(1, len(own) // 4)]] = 1
        if len(own) == 1:
            out[own] = 2
    return out


def _inputs(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")), F.col("n_chars").cast("long").alias("n_chars")]


def _views(b: pa.RecordBatch, at: int = 1) -> tuple[np.ndarray, np.ndarray]:
    text = np.stack([text_view(t.as_py()) for t in b.column(at)])
    meta = np.stack([metadata_view(*x) for x in zip(*(b.column(at + i).to_pylist() for i in (1, 2, 3)), strict=True)])
    return text, meta


def train(docs: DataFrame, labels: DataFrame, sample: int = 16_000) -> CoTrained:
    """docs: doc_id, text, lang, source, n_chars; labels: doc_id, quality. About `sample` documents are looked at."""
    own = staged(labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality")), "labels")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").join(own, "doc_id", "left")
    n, known = ids.agg(F.count("*"), F.count("quality")).first()
    labelled = min(known, max(sample // 2, sample * known // max(n, 1), sample - (n - known)))
    part = lambda want, of: int(min(1.0, want / max(of, 1)) * (1 << 30))
    bound = F.when(F.col("quality").isNull(), part(sample - labelled, n - known)).otherwise(part(labelled, known))
    chosen = staged(ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= bound).distinct(), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                text, meta = _views(b)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r.tobytes() for r in v], pa.binary()) for v in (text, meta))], ["doc_id", "text", "meta"])

    some = docs.select(*_inputs(docs)).join(chosen.select("doc_id"), "doc_id", "left_semi")
    seen = some.mapInArrow(tidy(run), "doc_id long, text binary, meta binary").groupBy("doc_id").agg(F.min(F.struct("text", "meta")).alias("v")).select("doc_id", "v.*")  # one row for an id
    rows = seen.join(chosen, "doc_id").withColumn("place", F.xxhash64("doc_id", F.lit("fold"))).toPandas()
    if not len(rows):
        return CoTrained()
    rows = rows.sort_values("doc_id", ignore_index=True)
    views = tuple(np.stack([np.frombuffer(x, np.float32) for x in rows[c]]) for c in ("text", "meta"))
    y = rows["quality"].to_numpy(float, na_value=np.nan)
    y = np.where(np.isnan(y), np.nan, (y >= 0.5).astype(float))
    model = co_train(views, y, folds(y, rows["place"].to_numpy()))
    if model.joint is None:
        warnings.warn(f"nothing could be learnt from {int((~np.isnan(y)).sum())} labelled documents: every document is kept", stacklevel=2)
    return model


def score(docs: DataFrame, model: CoTrained, least: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = model.score(*_views(b))
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found), pa.array(found[2] >= least)], ["doc_id", "p_text", "p_meta", "score", "kept"])

    return docs.select(*_inputs(docs)).mapInArrow(tidy(run), "doc_id long, p_text double, p_meta double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = 16_000) -> DataFrame:
    """docs without the rejected ones."""
    model = train(docs, labels, sample)
    at = [docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = pa.RecordBatch.from_arrays([b.column(0), *(b.column(i) for i in at)], ["first", "text", "lang", "source", "n_chars"])
                yield b.filter(pa.array(model.score(*_views(own))[2] >= least))

    return docs.mapInArrow(tidy(run), docs.schema)
