"""Texts as one run of UTF-8 bytes that is cut, compared and put together again in whole columns.

Where a tokenizer's pre-tokens never cross a place, the text may be cut there. The cuts of many texts are found at once, equal
chunks are told by one dictionary, only distinct ones are looked at, and their ids are put together by one gathering.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 8 << 20  # bytes of text that are cut at once; a longer text is taken alone

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The first bytes of characters, or signs, that chunks cut by bytes mustn't hold: controls, the apostrophe, all but ASCII and U+00C0 to U+00FF.
UNUSUAL = np.zeros(256, bool)
UNUSUAL[[*range(9), *range(14, 32), 39, 127, *range(0xC0, 0xC3), *range(0xC4, 256)]] = True
#: 0 white space, 1 letters, 2 digits, 3 signs; holds for lower and upper case where nothing is unusual.
KIND = np.full(256, 3, np.uint8)
KIND[SPACE] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2


def slices(texts: pa.Array, size: int | None = None) -> Iterator[pa.Array]:
    """Consecutive rows of at most `size` bytes (SLICE), one at least; nulls become empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = flat(texts)[1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + (size or SLICE), "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary column one after another, and where each value begins, with the end."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def chunks(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes between consecutive ends, as a large_binary column on the same memory."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def cut(data: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Chunks that begin where `starts` is true (one flag more than bytes) or a value does, and each value's first chunk, with the end."""
    starts[bounds] = True
    at = np.flatnonzero(starts)
    return chunks(data, at).dictionary_encode(), np.searchsorted(at, bounds)


def gather(values: pa.Array, chosen: pa.DictionaryArray, first: np.ndarray) -> pa.Array:
    """What the chosen values of each group hold, joined: group i has the chunks from first[i] to first[i + 1]."""
    data, ends = flat(values.take(chosen.indices))
    return chunks(data, ends[first])


def unusual(data: np.ndarray, bounds: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Which values hold something unusual, or a byte of `more`."""
    odd = (UNUSUAL if more is None else more)[data]
    if more is None:
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs × and ÷
    found = np.zeros(len(bounds) - 1, bool)
    found[np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1] = True
    return found


def merged(plain: pa.Array, others: list[bytes], odd: np.ndarray) -> pa.Array:
    """One column: of `others` where odd, else of plain, each in its order."""
    if not others:
        return plain
    place = np.empty(len(odd), np.int64)
    place[~odd] = np.arange(len(plain))
    place[odd] = np.arange(len(plain), len(odd))
    return pa.concat_arrays([plain, pa.array(others, pa.large_binary())]).take(pa.array(place))
