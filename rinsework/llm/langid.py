"""Language identification by known words first, with shorter and shorter character n-grams for unseen words.

Learning counts words and n-grams by language over a bounded sample of the labelled rows (bounds are parameters; the
sample is the rows whose hashed id and text are under a share, so no row is sorted or collected for it). Only the frequent ones of
both go into the model; it is counted by Spark and sent to the executors with the function. It holds a frequency for each word or
n-gram and language that has it, and one for all others of a language, so its size is bounded by the numbers of words and n-grams
however many languages there are. A worker spells rows out for all languages as it needs them, up to a number of bytes.

A known word adds its log frequency in each language. An unseen word adds the mean log frequency of its longest n-grams
that are known, at a discount for each step down; one with no known character adds nothing. The score is the share that
the winner has of the likelihood, tempered by the square root of the number of words.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn from, every text is
``und``; a null lang is not learnt; a row with a null id is neither learnt from nor held out; ties go to the first
language by name; texts of any length are read whole, a worker remembering a bounded number of words; repeated rows are
repeated; no rows give no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinsework.llm.workers import tidy
from rinsework.session import staged

UNKNOWN = "und"
LONGEST = 4
KEPT_WORDS = 200_000  # a worker's memory of scored words
KEPT_BYTES = 64 << 20  # and the most that it, or a table's rows, take
STRIP = ".,;:!?\"'()[]{}<>|#*$%&-_/\\0123456789"
CUT = str.maketrans(STRIP, " " * len(STRIP))  # words end at these, when learning as when predicting
BLANK = r"(?U)[\s\x1c-\x1f]+"  # what str.split() takes for white space


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _rows_kept(languages: int) -> int:
    return max(1, min(KEPT_WORDS, KEPT_BYTES // (8 * languages + 200)))


class Table:
    """Log frequencies of keys by language, less their mean over the languages: only the differences count. The i-th key has `logs` from
    starts[i] on, in the languages `at`; all other languages have `base`."""

    def __init__(self, keys: list[str], starts: np.ndarray, at: np.ndarray, logs: np.ndarray, base: np.ndarray):
        self.parts = keys, starts, at, logs, base
        self.places, self.rows, self.most = dict(zip(keys, range(len(keys)), strict=True)), {}, _rows_kept(len(base))

    @classmethod
    def of(cls, counts: dict[str, dict[int, float]], totals: np.ndarray) -> Table:
        room = totals + 0.5 * len(counts) + 1
        at = np.array([i for by in counts.values() for i in by], np.int32)
        logs = np.log((np.array([n for by in counts.values() for n in by.values()], float) + 0.5) / room[at])
        return cls(list(counts), np.cumsum([0, *map(len, counts.values())]), at, logs, np.log(0.5 / room))

    def __len__(self) -> int:
        return len(self.places)

    def __contains__(self, key: str) -> bool:
        return key in self.places

    def get(self, key: str) -> np.ndarray | None:
        row = self.rows.get(key)
        if row is None and (i := self.places.get(key)) is not None:
            _, starts, at, logs, base = self.parts
            row = base.copy()
            row[at[starts[i] : starts[i + 1]]] = logs[starts[i] : starts[i + 1]]
            row -= row.mean()
            if len(self.rows) >= self.most:
                self.rows.clear()
            self.rows[key] = row
        return row

    __getitem__ = get


class Model:
    """Log frequencies by language: of words, and of n-grams of each length."""

    def __init__(self, languages: list[str], words: Table | dict[str, np.ndarray], grams: list[Table | dict[str, np.ndarray]]):
        self.languages, self.words, self.grams, self.kept = languages, words, grams, {}
        self.most = _rows_kept(len(languages))

    def score(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        padded = f" {word} "
        for n in range(LONGEST, 0, -1):
            table = self.grams[n - 1]
            found = [table[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in table and g != " "]
            if found:
                return np.sum(found, 0) * (n / LONGEST / max(1, len(found)) ** 0.5)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        n, kept, rows = 0, self.kept, []
        for w in text.lower().split():
            known = kept.get(w)
            if known is None:
                bare = w.strip(STRIP)
                if bare.isalpha():  # most words: nothing to cut inside
                    known = (self.score(bare), 1)
                else:
                    parts = [self.score(x) for x in bare.translate(CUT).split() if any(map(str.isalpha, x))]
                    known = (np.sum(parts, 0), len(parts)) if parts else False
                if len(kept) >= self.most:
                    kept.clear()
                kept[w] = known
            if known is not False:
                rows.append(known[0])
                n += known[1]
        if not n:
            return UNKNOWN, 0.0
        total = np.array(rows).sum(0) / n**0.5
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def learn(docs: DataFrame, usable: Column, sample: int = 12_000, words: int = 60_000, grams: int = 30_000) -> Model:
    """docs: doc_id, text, lang. usable: the rows that may be learnt from. About `sample` of them are, and
    up to as many again so that each language has an equal part of the bound; words and n-grams are cut likewise."""
    ready = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in ready.groupBy("lang").count().collect()}
    n = sum(sizes.values())
    share = F.lit(0)
    if sizes:  # a language has its part of the bound at least
        most = {lang: int(min(1.0, max(sample / n, sample / len(sizes) / own)) * (1 << 30)) + 1 for lang, own in sizes.items()}
        share = F.try_element_at(F.create_map(*(F.lit(x) for pair in most.items() for x in pair)), "lang")
    some = ready.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share)  # an id that many rows share doesn't bring them all
    cleaned = F.translate(F.lower("text"), STRIP, " " * len(STRIP))
    counts = some.select("lang", F.explode(F.split(cleaned, BLANK)).alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = staged(counts, "words")  # read again for each length of n-grams
    by_lang = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    languages = sorted(by_lang)
    at = {x: i for i, x in enumerate(languages)}
    totals = np.array([by_lang[x] for x in languages], float)

    def table(of: DataFrame, most: int) -> dict[str, dict[int, float]]:
        found: dict[str, dict[int, float]] = {}
        order = [F.desc("n"), "key"]
        own = of.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_r") <= most // max(len(languages), 1)).drop("_r")
        for r in of.orderBy(*order, "lang").limit(most).unionByName(own).distinct().orderBy(*order, "lang").toLocalIterator():
            found.setdefault(r.key, {})[at[r.lang]] = float(r.n)
        return found

    word_logs = Table.of(table(counts.filter("n >= 3").select("lang", F.col("word").alias("key"), "n"), words), totals)
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    gram_logs = []
    for size in range(1, LONGEST + 1):
        cut = F.transform(F.sequence(F.lit(1), F.length("word") + 3 - size), lambda i: F.substring(padded, i, F.lit(size)))
        of = counts.filter(F.length("word") + 2 >= size).select("lang", F.explode(cut).alias("key"), "n").groupBy("lang", "key").agg(F.sum("n").alias("n"))
        found = table(of.filter("n >= 2"), grams)
        gram_logs.append(Table.of(found, np.array([sum(v.get(i, 0) for v in found.values()) for i in range(len(languages))], float)))
    return Model(languages, word_logs, gram_logs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score. Reads the text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, [t.parts for t in (model.words, *model.grams)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, (words, *grams) = shipped.value
        own = Model(languages, Table(*words), [Table(*g) for g in grams])
        for b in batches:
            found = [own.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from the rows that aren't held out, predicts all."""
    model = learn(docs, (F.crc32(F.col("doc_id").cast("string")) % 3 != 1), **sizes)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
