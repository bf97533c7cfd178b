"""Substring dedup: passages that a document with a smaller id already has, found by prefix-partitioned suffix trees.

A passage is `window` words or more; every window that occurs in documents of different ids is part of one. Suffixes are cut after
`window` words, which is as deep as trees must go.

* Suffixes that can't be in a deep node stay out of the trees. Of each window the k words with the least hash are its anchor, so equal
  windows have equal anchors wherever they stand; a window is a candidate if its anchor occurs in documents of different ids. Anchors are about
  a fifth of the words, and only their hashes are shuffled. Equal hashes of other words only make more candidates.
* Prefixes partition the suffixes: a window goes by the words from its anchor on, so equal windows go together, and neighbours with one anchor
  travel as one span of words. All with a common prefix belong to one group, several prefixes to a group. Groups are counted for prefixes of
  1, 2, 4 and k words; where a group would hold more suffixes than `most`, its prefixes are extended to the next length.
* A group is one task's: its suffixes are sorted, the common prefixes of neighbours give the tree's internal nodes, and a node as deep as a window
  whose leaves come from several documents is a repeat. Each leaf but those of the least id is removed.
* Where a group is over `most` even so, each window is a prefix and a node by itself, without a tree: its least document comes from an
  aggregation that is combined before the shuffle, and its places from a join that the optimiser splits.

Equal whole texts are told by a 128-bit digest: only the least id of each text goes into the trees, the others are removed whole.
Whatever is removed touching each other in a document is the maximal repeat.

Texts are compared as words, never by hashes. A task holds some megabytes of text or one group; suffixes travel as compressed blocks; the
groups that are over `most` are a bit each on the driver, of at most 2^20 for each length of prefix.

Defined cases: a null text has no words; a null id is neither smaller nor larger than any other, so such a document stays whole and removes
nothing; of rows with the same id none removes from another; repeated rows are cut alike; texts under a window stay whole; texts of any length
are cut whole; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.llm import spans
from rinsework.llm.workers import drop_shuffles, drop_table, tidy
from rinsework.session import staged, staged_path

ANCHOR = 6  # words
GROUPS = 1 << 20
AT_ONCE = 1 << 20  # bytes of passages whose suffixes are made at once
HELD = 200_000  # spans a task gathers before it writes blocks
LOOKED = "doc_id long, n_words long, n_removed long, kept string, text string, starts array<int>, passages array<string>"
PLACES = "id long, start int"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Words:
    """The words of many texts: hashes, and where each begins and ends in their bytes. first: each text's first word, with the end."""

    def __init__(self, texts: pa.Array):
        self.data, bounds = spans.flat(texts)
        space = spans.SPACE[self.data]
        starts = np.zeros(len(self.data) + 1, bool)
        starts[1:-1] = space[1:] != space[:-1]
        starts[bounds] = True
        at = np.flatnonzero(starts)
        own = np.flatnonzero(~space[at[:-1]])
        self.begin, self.end = at[:-1][own], at[1:][own]
        self.first = np.searchsorted(self.begin, bounds)
        known = spans.chunks(self.data, at).take(pa.array(own)).dictionary_encode()
        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter(map(digest, known.dictionary.to_pylist()), np.uint64, len(known.dictionary))
        self.hashes = hashes[known.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * _A + b
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive hashes, by doubling."""
    out, done, power, size = None, 0, h, 1
    while True:
        if n & size:
            part = power[done : len(h) - n + 1 + done]
            out = part if out is None else _mix(out, part)
            done += size
        size *= 2
        if size > n:
            return out if out is not None else h[:0]
        power = _mix(power[: len(power) - size // 2], power[size // 2 :]) if len(power) > size // 2 else power[:0]


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, anchor, hash of the anchor) of each window; the first two as places in words."""
    n, k = len(words.hashes), min(ANCHOR, window)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    begin = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    hashes = run_hashes(words.hashes, k)
    at = np.arange(n - window + 1) + sliding_window_view(hashes, window - k + 1).argmin(1)
    return begin, at[begin], hashes[at[begin]]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("text_key"))


def sketches(docs: DataFrame, window: int) -> str:
    """Where doc_id, text_key, anchors, id of every document with an id are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in spans.slices(b.column(1)):
                words = Words(texts)
                _, place, _ = anchors(words, window)
                place = np.unique(place)
                hashes = run_hashes(words.hashes, min(ANCHOR, window))[place].view(np.int64) if len(place) else np.zeros(0, np.int64)
                ends = np.searchsorted(place, words.first).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(2).slice(at, len(texts)), found], ["doc_id", "text_key", "anchors"])
                at += len(texts)

    keyed = _keyed(docs).filter("doc_id is not null")
    return staged_path(keyed.mapInArrow(tidy(run), "doc_id long, text_key binary, anchors array<long>").withColumn("id", F.monotonically_increasing_id()), "anchors")


def firsts(sketched: DataFrame) -> DataFrame:
    """doc_id, text_key, shared: the least id of each text, with its anchors that documents of other ids have too, or null."""
    places = sketched.select("id", "doc_id", F.explode("anchors").alias("h"))
    shared = staged(places.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("h"), "shared")
    drop_shuffles(sketched.sparkSession)
    marks = places.select("id", "h").join(shared, "h").groupBy("id").agg(F.collect_list("h").alias("shared"))
    reps = sketched.groupBy("text_key").agg(F.min(F.struct("doc_id", "id")).alias("r")).select("text_key", "r.doc_id", "r.id")
    return staged(reps.join(marks, "id", "left").drop("id"), "firsts")


def _runs(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cuts = np.flatnonzero(np.diff(begin) != 1) + 1
    return begin[np.concatenate([[0], cuts])], begin[np.concatenate([cuts - 1, [len(begin) - 1]])]


def _passages(words: Words, begin: np.ndarray, hashes: np.ndarray, shared: pa.Array, first: int, window: int) -> tuple[list[int], list[str]]:
    """Where runs of candidates begin in their document (whose first word is `first`), and their words, joined by one space."""
    begin = begin[np.isin(hashes, shared.to_numpy().view(np.uint64))]
    if not len(begin):
        return [], []
    s, e = _runs(begin)
    raw, a, z = words.data, words.begin, words.end
    texts = [b" ".join(raw[a[i] : z[j + window - 1]].tobytes().split()).decode() for i, j in zip(s.tolist(), e.tolist(), strict=True)]
    return (s - first).tolist(), texts


def _end(words: list[bytes], digest: bool) -> str:
    kept = b" ".join(words)
    return hashlib.sha256(kept).hexdigest() if digest else kept.decode()


def look(docs: DataFrame, first: DataFrame, window: int, digest: bool) -> DataFrame:
    """LOOKED and id. Documents that hold no candidate are done (kept); of the others the passages of candidates come with their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], 0
            for texts in spans.slices(b.column(1)):
                ids, is_first, shared = (b.column(i).slice(at, len(texts)) for i in (0, 2, 3))
                at += len(texts)
                asked = np.flatnonzero(shared.is_valid().to_numpy(zero_copy_only=False))
                words = Words(texts.take(pa.array(asked)))
                begin, _, hashes = anchors(words, window)
                ends = np.searchsorted(begin, words.first)
                passages = {i: _passages(words, begin[ends[k] : ends[k + 1]], hashes[ends[k] : ends[k + 1]], shared[i].values, int(words.first[k]), window) for k, i in enumerate(asked.tolist())}
                for i, (doc_id, text, first_one) in enumerate(zip(ids.to_pylist(), texts.to_pylist(), is_first.to_pylist(), strict=True)):
                    starts, found = passages.get(i, ([], []))
                    own = [] if starts else text.split()
                    n = int(np.diff(words.first[np.searchsorted(asked, i) :][:2])[0]) if starts else len(own)
                    if starts:
                        rows.append((doc_id, n, None, None, text.decode(), starts, found))
                    elif doc_id is not None and first_one is None and n >= window:
                        rows.append((doc_id, n, n, _end([], digest), None, None, None))
                    else:
                        rows.append((doc_id, n, 0, _end(own, digest), None, None, None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in LOOKED.split(", ")])

    told = first.select("doc_id", "text_key", F.lit(True).alias("is_first"), "shared")
    joined = _keyed(docs).join(told, ["doc_id", "text_key"], "left").select("doc_id", "text", "is_first", "shared")
    return staged(joined.mapInArrow(tidy(run), LOOKED).withColumn("id", F.monotonically_increasing_id()), "looked")


def lengths(window: int) -> list[int]:
    k = min(ANCHOR, window)
    return [*(1 << i for i in range(k.bit_length()) if 1 << i < k), k]


@dataclass
class Spans:
    """Runs of windows that share an anchor. place: a run's first word in words; many: its number of windows; of: groups by length of prefix."""

    doc: np.ndarray
    id: np.ndarray
    start: np.ndarray
    words: Words
    place: np.ndarray
    many: np.ndarray
    of: np.ndarray

    def texts(self, rows: np.ndarray, window: int) -> list[bytes]:
        return _texts(self.words, self.place[rows], self.many[rows] + window - 1)


def _spans(b: pa.RecordBatch, window: int, groups: int) -> Iterator[Spans]:
    """The windows of the passages, some at a time. b: doc_id, id, starts, passages."""
    per = b.column(3).value_lengths().to_numpy()
    doc, id_ = (np.repeat(b.column(i).to_numpy(), per) for i in (0, 1))
    start, at = b.column(2).flatten().to_numpy(), 0
    for texts in spans.slices(b.column(3).flatten(), AT_ONCE):
        words = Words(texts)
        begin, anchor, _ = anchors(words, window)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(begin) != 1)]))
        place, many, anchor = begin[first], np.diff(np.concatenate([first, [len(begin)]])), anchor[first]
        own = np.searchsorted(words.first, place, "right") - 1
        of = np.stack([run_hashes(words.hashes, n)[anchor] % np.uint64(groups) for n in lengths(window)]).astype(np.int64)
        yield Spans(doc[own + at], id_[own + at], (start[own + at] + place - words.first[own]).astype(np.int32), words, place, many, of)
        at += len(texts)


def _windows(texts: pa.Array, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(span, start, text) of each window in spans of words that are joined by one space."""
    words = Words(texts)
    many = np.diff(words.first) - (window - 1)
    span = np.repeat(np.arange(len(texts)), many)
    inside = np.arange(len(span)) - np.repeat(np.cumsum(many) - many, many)
    return span, start[span] + inside.astype(np.int32), _texts(words, words.first[span] + inside, window)


def overfull(passages: DataFrame, window: int, groups: int, most: int) -> np.ndarray:
    """Which groups of each length of prefix would hold more than `most` suffixes."""
    size = len(lengths(window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size * groups, np.int64)
        for b in batches:
            for s in _spans(b, window, groups):
                for level in range(size):
                    counts[level * groups : (level + 1) * groups] += np.bincount(s.of[level], s.many, groups).astype(np.int64)
        found = np.flatnonzero(counts)
        for at in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 10_000]), pa.array(counts[found[at : at + 10_000]])], ["g", "n"])

    big = passages.mapInArrow(tidy(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
    out = np.zeros(size * groups, bool)
    out[[r.g for r in big.select("g").toLocalIterator()]] = True
    return out.reshape(size, groups)


def _chosen(of: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The first length of prefix whose group isn't overfull, or one more than there are."""
    over = np.stack([full[level][of[level]] for level in range(len(of))])
    return np.where(over.all(0), len(of), over.argmin(0))


def _texts(words: Words, place: np.ndarray, many: np.ndarray | int) -> list[bytes]:
    raw = words.data.tobytes()
    return [raw[a:b] for a, b in zip(words.begin[place].tolist(), words.end[place + many - 1].tolist(), strict=True)]


def grouped(passages: DataFrame, window: int, full: np.ndarray) -> DataFrame:
    """g, block: spans of a group, compressed."""
    groups = full.shape[1]
    shipped = passages.sparkSession.sparkContext.broadcast(np.packbits(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_full = np.unpackbits(shipped.value, count=full_size).reshape(-1, groups).astype(bool)
        kept: list[pa.Table] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            whole = pa.concat_tables(kept).combine_chunks()
            kept.clear()
            whole = whole.take(pa.array(np.argsort(whole["g"].to_numpy(), kind="stable")))  # places stay in order, which compresses well
            g = whole["g"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            rest = whole.drop_columns("g")
            for a, z in zip(first.tolist(), [*first[1:].tolist(), len(g)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(g[a])], pa.int64()), pa.array([_pack(rest.slice(a, z - a))], pa.binary())], ["g", "block"])

        for b in batches:
            for s in _spans(b, window, groups):
                level = _chosen(s.of, own_full)
                deep = np.flatnonzero(level < len(s.of))
                if len(deep):
                    g = level[deep] * groups + s.of[level[deep], deep]
                    kept.append(pa.table({"g": g, "doc": s.doc[deep], "id": s.id[deep], "start": s.start[deep], "text": pa.array(s.texts(deep, window), pa.large_binary())}))
                if sum(t.num_rows for t in kept) > HELD:
                    yield from blocks()
        if kept:
            yield from blocks()

    full_size = full.size
    return passages.mapInArrow(tidy(run), "g long, block binary")


def _pack(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


class SuffixTree:
    """Of suffixes with `depth` words each, joined by one space. The leaves are the suffixes in their order; an internal node is a range of
    leaves whose neighbours have as many words in common."""

    def __init__(self, texts: pa.Array, depth: int):
        self.depth = depth
        self.order = pc.sort_indices(texts).to_numpy()
        data, bounds = spans.flat(texts.take(pa.array(self.order)))
        cuts = np.zeros(len(data) + 1, bool)
        cuts[1:] = data == 32
        cuts[bounds] = True
        words = spans.chunks(data, np.flatnonzero(cuts)).dictionary_encode()  # a word's space is the end of it
        words = words.indices.to_numpy().reshape(len(texts), depth)
        self.common = np.cumprod(words[1:] == words[:-1], axis=1, dtype=np.int8).sum(1)  # words in common with the next leaf

    def nodes(self, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, first leaf, leaf after the last) of the internal nodes at each depth from `least` on."""
        for depth in range(least, self.depth + 1):
            apart = np.flatnonzero(self.common < depth) + 1
            first, end = np.concatenate([[0], apart]), np.concatenate([apart, [len(self.order)]])
            several = end - first > 1
            yield depth, first[several], end[several]


def repeated(doc: np.ndarray, texts: pa.Array, window: int) -> np.ndarray:
    """Which suffixes begin with a window that a document with a smaller id has too."""
    tree = SuffixTree(texts, window)
    own, out = doc[tree.order], np.zeros(len(doc), bool)
    for _, first, end in tree.nodes(window):
        if len(first):
            least = np.minimum.reduceat(own, np.stack([first, end], 1).ravel()[: None if end[-1] < len(own) else -1])[::2]
            inside = np.repeat(np.arange(len(first)), end - first)
            leaves = np.arange(len(inside)) - np.repeat(np.cumsum(end - first) - (end - first), end - first) + np.repeat(first, end - first)
            out[tree.order[leaves]] |= own[leaves] > least[inside]
    return out


def in_trees(blocks: DataFrame, window: int) -> DataFrame:
    """PLACES: where windows begin that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for b in batches:
            for g, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if g != now and kept:
                    yield from one(kept)
                    kept = []
                now = g
                kept.append(block)
        if kept:
            yield from one(kept)

    def one(kept: list[bytes]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(b)).read_all() for b in kept])
        span, start, texts = _windows(t["text"].combine_chunks(), t["start"].to_numpy(), window)
        gone = np.flatnonzero(repeated(t["doc"].to_numpy()[span], pa.array(texts, pa.large_binary()), window))
        yield pa.RecordBatch.from_arrays([pa.array(t["id"].to_numpy()[span[gone]]), pa.array(start[gone])], ["id", "start"])

    return blocks.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(run), PLACES)


def by_themselves(passages: DataFrame, window: int, full: np.ndarray) -> DataFrame:
    """PLACES for windows whose whole sequence is a group over `most`: nodes without a tree."""
    groups = full.shape[1]
    shipped = passages.sparkSession.sparkContext.broadcast(np.packbits(full))
    full_size = full.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_full = np.unpackbits(shipped.value, count=full_size).reshape(-1, groups).astype(bool)
        for b in batches:
            for s in _spans(b, window, groups):
                hot = np.flatnonzero(_chosen(s.of, own_full) == len(s.of))
                span, start, texts = _windows(pa.array(s.texts(hot, window), pa.large_binary()), s.start[hot], window)
                yield pa.RecordBatch.from_arrays([pa.array(s.doc[hot][span]), pa.array(s.id[hot][span]), pa.array(start), pa.array(texts, pa.binary())], ["doc_id", "id", "start", "text"])

    rows = staged(passages.mapInArrow(tidy(run), "doc_id long, id long, start int, text binary"), "hot")
    least = staged(rows.groupBy("text").agg(F.min("doc_id").alias("least")), "least")
    return rows.join(least, "text").filter("doc_id > least").select("id", "start")


def remove_repeats(docs: DataFrame, window: int = 13, digest: bool = False, most: int = 300_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words that stay, joined by one space, or with `digest` the SHA-256 of that."""
    if window < 1:
        raise ValueError("a window has a word at least")
    spark = docs.sparkSession
    at = sketches(docs, window)
    first = firsts(spark.read.parquet(at))
    drop_table(spark, at)  # firsts() are written
    drop_shuffles(spark)
    looked = look(docs, first, window, digest)
    open_ = looked.filter("starts is not null")
    passages = open_.select("doc_id", "id", "starts", "passages")
    words = F.aggregate("passages", F.lit(0).cast("long"), lambda acc, p: acc + F.size(F.split(p, " ")) - (window - 1))
    n = passages.agg(F.sum(words)).first()[0] or 0
    groups = min(GROUPS, max(1, -(-2 * n // most)))
    full = overfull(passages, window, groups, most)
    drop_shuffles(docs.sparkSession)
    places = in_trees(grouped(passages, window, full), window)
    if full[-1].any():
        places = places.unionByName(by_themselves(passages, window, full))
    gone = staged(places.groupBy("id").agg(F.collect_list("start").alias("gone")), "gone")
    drop_shuffles(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = text.encode().split()
                if found.is_valid:
                    steps = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(found.values.to_numpy())
                    steps[at] += 1
                    steps[at + window] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
                else:
                    kept = words
                rows.append((doc_id, len(words), len(words) - len(kept), _end(kept, digest)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept"])

    cut = open_.select("doc_id", "text", "id").join(gone, "id", "left").select("doc_id", "text", "gone").mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept string")
    return looked.filter("starts is null").select("doc_id", "n_words", "n_removed", "kept").unionByName(cut)
