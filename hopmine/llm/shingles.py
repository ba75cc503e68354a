"""Word shingles of Arrow text batches as 64-bit hashes, by array operations over the UTF-8 bytes.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D] of the lower-cased text. A text with fewer words than a
shingle has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_random = np.random.default_rng(20_240_501)
_BYTES = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACES = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def _chunk_hashes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order with repeats, and where each text's begin (one more entry at the end)."""
    low = pc.utf8_lower(texts)
    offsets = np.frombuffer(low.buffers()[1], np.int32, len(low) + 1, low.offset * 4).astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(low) + 1, np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
    offsets = offsets - offsets[0]
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    first[at] = word[at]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    ends = np.concatenate([[0], np.cumsum(counts)])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(low) + 1, np.int64)
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(np.append(starts, 0)[:-1], spans) if starts[0] == 0 else np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    powers = _POWERS if place.max(initial=0) < len(_POWERS) else _powers(int(place.max()) + 1)
    tail = slice(starts[0], None)
    value = _BYTES[data[tail]] * powers[place]
    value[~word[tail]] = 0
    words = mix(np.add.reduceat(value, starts - starts[0]))
    total = len(words)
    if total >= n:
        grams = np.zeros(total - n + 1, np.uint64)
        for i in range(n):
            grams += words[i : total - n + 1 + i] * _PLACES[i]
        grams = mix(grams)
    else:
        grams = np.zeros(0, np.uint64)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(begin[-1], np.uint64)
    full = np.repeat(counts >= n, per)
    take = np.repeat(ends[:-1] - begin[:-1], per) + np.arange(begin[-1])
    out[full] = grams[take[full]]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        own = words[ends[i] : ends[i + 1]]
        out[begin[i]] = mix(np.array([(own * _PLACES[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0]
    return out, begin


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (null: none), in order, a bounded number of bytes at a time."""
    texts = texts.cast(pa.string()).fill_null("")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i in range(len(lengths) + 1):
        if i == len(lengths) or held + lengths[i] > CHUNK_BYTES:
            if i > start:
                hashes, begin = _chunk_hashes(pa.concat_arrays([texts.slice(start, i - start)]), n)
                for a, b in zip(begin[:-1], begin[1:], strict=True):
                    yield np.unique(hashes[a:b])
            start, held = i, 0
        if i < len(lengths):
            held += lengths[i]
