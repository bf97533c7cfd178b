"""Byte-level BPE by a sentencepiece model that is written out from a rank file, never trained.

Each token's bytes are mapped to printable characters, one a byte, and become a piece with its negative rank as score;
normalisation is the identity. sentencepiece then merges, as the rank file's own library would, the neighbours whose
joined piece has the highest score, that is the lowest rank, the leftmost first. A text is cut by the pattern into
pre-tokens, and each is encoded by itself. Decoding maps ids to pieces and pieces back to bytes.

A pre-token that is a token as a whole gets that token. Words recur, so texts are first cut into words, where the pattern
always cuts: before the last white space of a run that something follows, after it unless it is a blank, and before other
runs. Only distinct words of some megabytes of text are cut by the pattern, and only distinct pre-tokens are encoded; a task keeps
the ids of pre-tokens it has seen up to a fixed number. That changes no result.

Defined cases: a null text is empty and has no ids; texts of any length are encoded whole; of joins with equal rank the leftmost
comes first; a null doc_id stays null; repeated rows stay repeated; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.llm import spans
from rinsework.llm.workers import shorten, tidy

CACHED = 400_000  # pre-tokens a task remembers
KEPT = 100_000  # pre-tokens that the next task finds
AT_ONCE = 20_000  # pre-tokens merged by one call
#: White space beyond ASCII in UTF-8, by all but the last byte.
WIDE = {b"\xc2": [0x85, 0xA0], b"\xe1\x9a": [0x80], b"\xe2\x80": [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF], b"\xe2\x81": [0x9F], b"\xe3\x80": [0x80]}


def byte_map() -> list[str]:
    """A printable character for each byte: itself where Latin-1 has a visible one, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    n, out = n % 2**64, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    return [found[i] for i in range(len(found))]


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece ModelProto: piece i is token i; one more piece stands for the unknown, as the format wants."""
    mapped = byte_map()
    pieces = [_field(1, _field(1, "".join(mapped[b] for b in t).encode()) + _field(2, -float(rank)) + _field(3, 1)) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        # \s is written out: what counts as white space must not depend on the library
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        mapped = byte_map()
        self.to_piece = str.maketrans({chr(b): c for b, c in enumerate(mapped)})
        self.mapped = "".join(mapped)
        self.to_byte = {c: b for b, c in enumerate(mapped)}
        self.bytes_of = pa.array([bytes(self.to_byte[c] for c in self.model.id_to_piece(i)) for i in range(len(self.tokens))], pa.large_binary())
        self.digits_of = pa.array([b"%d " % i for i in range(len(self.tokens))], pa.large_binary())
        self.seen: dict[bytes, bytes] = {}

    def forget(self) -> None:
        shorten(self.seen, KEPT)

    def _known(self, pre_tokens: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each."""
        new = [w for w in dict.fromkeys(pre_tokens) if w not in self.seen]
        if len(self.seen) + len(new) > CACHED:
            self.seen.clear()
            new = list(dict.fromkeys(pre_tokens))
        self.seen.update((w, self.whole[w]) for w in new if w in self.whole)
        split = [w for w in new if w not in self.whole]
        for at in range(0, len(split), AT_ONCE):
            own = split[at : at + AT_ONCE]
            found = self.model.encode([codecs.charmap_decode(w, "strict", self.mapped)[0] for w in own], out_type=int, num_threads=1)
            data = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
            ends = accumulate((4 * len(ids) for ids in found), initial=0)
            self.seen.update((w, data[a:b]) for w, (a, b) in zip(own, pairwise(ends), strict=True))
        return list(map(self.seen.__getitem__, pre_tokens))

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each word: the pattern cuts where letters, digits and signs meet, a blank before them included; words that hold
        anything unusual are left to the pattern itself."""
        data, bounds = spans.flat(words)
        odd = spans.unusual(data, bounds)
        others = [self.find(w.decode()) for w in words.filter(pa.array(odd)).to_pylist()]
        data, bounds = spans.flat(words.filter(pa.array(~odd)))
        kind = spans.KIND[data]
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        pre_tokens, first = spans.cut(data, starts, bounds)
        plain = spans.gather(pa.array(self._known(pre_tokens.dictionary.to_pylist()), pa.large_binary()), pre_tokens, first)
        if not others:
            return plain
        found = iter(self._known([p.encode() for own in others for p in own]))
        return spans.merged(plain, [b"".join(islice(found, len(own))) for own in others], odd)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (large_binary without nulls) one after another, and where each text's begin, with the end."""
        data, bounds = spans.flat(texts)
        words, first = spans.cut(data, word_starts(data, bounds), bounds)
        ids, ends = spans.flat(spans.gather(self._words(words.dictionary), words, first))
        return ids.view("<u4"), ends // 4

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text.encode()], pa.large_binary()))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return spans.flat(self.bytes_of.take(pa.array(ids, pa.int64())))[0].tobytes()


def word_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Flags, one more than bytes, of places where the pattern always cuts."""
    starts = np.zeros(len(data) + 1, bool)
    if not len(data):
        return starts
    space = spans.SPACE[data]
    for lead, ends in WIDE.items():
        at = np.flatnonzero(data == lead[0])
        for place, byte in enumerate(lead[1:], 1):
            at = at[data[at + place] == byte]
        at = at[np.isin(data[at + len(lead)], ends)]
        for place in range(len(lead) + 1):
            space[at + place] = True
    starts[1:-1] = space[1:] & ~space[:-1]
    last = np.flatnonzero(space[:-1] & ~space[1:])  # the last byte of a run that something follows, though not in another text
    inner = np.zeros(len(data) + 1, bool)
    inner[bounds] = True
    last = last[~inner[last + 1]]
    starts[last[data[last] != 0x20] + 1] = True
    wide = data[last] >= 0x80
    starts[last - wide * np.where(data[last - 1] == 0xC2, 1, 2)] = True
    return starts


@lru_cache(2)
def _loaded(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. No shuffle: documents are encoded where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for b in batches:
            counts, rows = [], []
            for texts in spans.slices(b.column(1)):
                ids, ends = bpe.encode_all(texts)
                counts.extend(np.diff(ends).tolist())
                chosen = pa.array(ids)
                decimal, decoded = (spans.flat(table.take(chosen)) for table in (bpe.digits_of, bpe.bytes_of))
                for at, to in pairwise(ends.tolist()):
                    # a blank ends each number; the last one doesn't count
                    rows.append(tuple(hashlib.sha256(data[cuts[at] : max(cuts[at], cuts[to] - less)]).hexdigest() for (data, cuts), less in ((decimal, 1), (decoded, 0))))
            own = [pa.array(counts, pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in range(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), *own], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, lambda: _loaded(path, pattern).forget()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>): the operator's real output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for b in batches:
            at = 0
            for texts in spans.slices(b.column(1)):
                ids, ends = bpe.encode_all(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), lists], ["doc_id", "ids"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, lambda: _loaded(path, pattern).forget()), "doc_id long, ids array<int>")
