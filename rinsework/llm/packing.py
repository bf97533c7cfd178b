"""Cost-balanced packing of token sequences.

A document's ids are cut into full sequences from its start on; each of those is a sequence of its own, and the rest, of
less than a sequence, is packed. The cost of a piece is linear plus quadratic in its length, as attention's is. Pieces
go, the longest first, to the sequence with the lowest cost so far among those with room for them; the number of
sequences is what the tokens need, and a piece that fits nowhere opens another one.

Tokens are counted once: the pass over the texts writes a short row for each piece. Pieces are dealt by a hash to
shards of bounded size, each packed by one task; a shard holds thousands of pieces, so that its last sequence,
the only one that is expected to be short, is a small part.

Defined cases: a null text is empty and has the end id alone; repeated rows are packed as often as they occur; any length
of text is cut whole; pieces of equal length go by id and start, and of sequences with equal cost the first opened is taken; a null
doc_id stays null, and ids beside it keep all their digits; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.llm import spans
from rinsework.llm.bpe import byte_map
from rinsework.llm.workers import shorten, tidy
from rinsework.session import staged

CACHED = 500_000  # parts of words, and unusual words, a task remembers
KEPT = 100_000  # of each, those that the next task finds
AT_ONCE = 50_000  # of each, those encoded by one call
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordTokens:
    """A tokenizer whose pre-tokens never hold ASCII white space: words between it are encoded by themselves, and once.

    Only distinct words of some megabytes of text are looked at. Words without an apostrophe, which could start an ending, and of ASCII
    and U+00C0 to U+00FF alone fall into letters, single digits and runs of signs whatever their case. They are cut into those in lower case,
    as the tokenizer does; parts that are new are encoded many by one call, by the tokenizer's own merges, with its byte-level
    characters and without its normaliser and pattern, which have nothing left to do. Each ends with a token that is marked as a word's end,
    which tells them apart. Words that hold anything unusual go to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer.from_str(json.dumps(json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.mapped = "".join("\n" if b == 10 else c for b, c in enumerate(byte_map()))
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) or rb"(?!)")
        self.opens = np.zeros(256, bool)
        self.opens[[t[0] for t in special]] = True
        self.seen: dict[bytes, bytes] = {}  # unusual words
        self.parts: dict[bytes, bytes] = {}

    def forget(self) -> None:
        shorten(self.seen, KEPT)
        shorten(self.parts, KEPT)

    def _known(self, table: dict[bytes, bytes], keys: list[bytes], learn: Callable[[list[bytes]], None]) -> list[bytes]:
        new = [k for k in dict.fromkeys(keys) if k not in table]
        if new and len(table) + len(new) > CACHED:
            table.clear()
            new = list(dict.fromkeys(keys))
        for at in range(0, len(new), AT_ONCE):
            learn(new[at : at + AT_ONCE])
        return list(map(table.__getitem__, keys))

    def _learn_parts(self, new: list[bytes]) -> None:
        self.parts.update((p, b"") for p in new if p.isspace())
        new = [p for p in new if not p.isspace()]
        ids = np.array(self.merges.encode_batch_fast([codecs.charmap_decode(b"\n".join(new), "strict", self.mapped)[0]], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(new):
            raise RuntimeError("the tokenizer cuts pre-tokens elsewhere")
        raw = ids.tobytes()
        self.parts.update((p, raw[a:b]) for p, (a, b) in zip(new, pairwise([0, *(4 * ends).tolist()]), strict=True))

    def _learn_whole(self, new: list[bytes]) -> None:
        for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            self.seen[w] = np.array(e.ids, "<u4").tobytes()

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each word; white space before it has none."""
        data, bounds = spans.flat(words)
        odd = spans.unusual(data, bounds)
        for i in np.flatnonzero(spans.unusual(data, bounds, self.opens)).tolist():
            odd[i] |= self.special.search(data[bounds[i] : bounds[i + 1]].tobytes()) is not None
        others = self._known(self.seen, [w.strip() for w in words.filter(pa.array(odd)).to_pylist()], self._learn_whole)
        data, bounds = spans.flat(words.filter(pa.array(~odd)))
        data = np.frombuffer(data.tobytes().decode().lower().encode(), np.uint8)  # as long as before, in these characters
        kind = spans.KIND[data]
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        parts, first = spans.cut(data, starts, bounds)
        ids = self._known(self.parts, parts.dictionary.to_pylist(), self._learn_parts)
        return spans.merged(spans.gather(pa.array(ids, pa.large_binary()), parts, first), others, odd)

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Little-endian unsigned 32-bit ids of each text (large_binary without nulls)."""
        data, bounds = spans.flat(texts)
        space = spans.SPACE[data]
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = space[1:] & ~space[:-1]
        words, first = spans.cut(data, starts, bounds)
        return spans.gather(self._words(words.dictionary), words, first)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text.encode()], pa.large_binary()))[0].as_py()


@lru_cache(2)
def _loaded(path: str) -> WordTokens:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokens(path)


def cut(docs: DataFrame, path: str, end_id: int = 2, room: int = 4096) -> DataFrame:
    """A row for each piece: full sequences, then the rest of the document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded(path)
        for b in batches:
            rows = []
            encoded = (ids for texts in spans.slices(b.column(1)) for ids in words.encode_all(texts))
            for doc_id, own_ids in zip(b.column(0).to_pylist(), encoded, strict=True):
                ids = own_ids.as_py() + end
                for at in range(0, len(ids), 4 * room):
                    own = ids[at : at + 4 * room]
                    rows.append((doc_id, at // 4, len(own) // 4, zlib.crc32(own), len(ids) // 4))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, lambda: _loaded(path).forget()), PIECES)


def balance(lengths: np.ndarray, room: int, per_token: float = 1.0, per_pair: float = 1 / 2048) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its offset there."""
    cost = per_token * lengths + per_pair * lengths.astype(float) ** 2
    count = max(1, -(-int(lengths.sum()) // room))
    spent, left = np.zeros(count), np.full(count, room, np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = lengths[i]
        at = int(np.where(left >= n, spent, np.inf).argmin())
        if left[at] < n:
            at = len(left)
            spent, left = np.append(spent, 0.0), np.append(left, room)
        bins[i], offsets[i] = at, room - left[at]
        spent[at] += cost[i]
        left[at] -= n
    return bins, offsets


def pack(docs: DataFrame, path: str, end_id: int = 2, room: int = 4096, shard: int = 12_000) -> DataFrame:
    """PIECES and sequence_id, offset. A sequence_id has its shard in the upper bits; full sequences are numbered apart."""
    pieces = staged(cut(docs, path, end_id, room), "pieces").withColumn("row", F.monotonically_increasing_id())
    rests = pieces.filter(F.col("length") < room)
    shards = max(1, -(-rests.count() // shard))

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row", "ascending")])  # null ids come last
        bins, offsets = balance(group["length"].to_numpy(), room)
        return group.drop_columns(["row", "shard"]).append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(offsets))

    dealt = rests.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(run, PIECES + ", sequence_id long, offset long")
    full = pieces.filter(F.col("length") == room).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
