"""Vectorised words and n-gram hashes of Arrow string batches.

Texts are UTF-8, where the white space of the contracts ([\\x20\\x09-\\x0D]) is
single bytes, so words are found on the flat byte buffer of a batch.  Work goes in
windows of about a megabyte, cut at white space or between texts, so memory does
not follow the length of a text.  Word and shingle hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]
STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and each text's bounds; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def windows(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that cut no word, of about WINDOW bytes."""
    start, total = 0, len(raw)
    while start < total:
        end = min(total, start + WINDOW)
        if end < total:
            cut = bounds[np.searchsorted(bounds, end, side="right") - 1]
            if cut <= start:  # one long text: cut it at white space
                spaces = np.flatnonzero(SPACE[raw[start:end]])
                while not len(spaces) and end < total:
                    end = min(total, end + WINDOW)
                    spaces = np.flatnonzero(SPACE[raw[start:end]])
                cut = start + spaces[-1] + 1 if len(spaces) else end
                after = bounds[np.searchsorted(bounds, start, side="right")]
                cut = min(cut, after)
            end = int(cut)
        yield start, end
        start = end


def word_spans(raw: np.ndarray, bounds: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words in a window."""
    space = SPACE[raw[start:end]]
    first = ~space
    last = first.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = bounds[np.searchsorted(bounds, start, side="right") : np.searchsorted(bounds, end, side="left")] - start
    first[inner] |= ~space[inner]
    last[inner - 1] |= ~space[inner - 1]
    return np.flatnonzero(first) + start, np.flatnonzero(last) + start + 1


def word_hashes(raw: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and where each text's words begin and end among them."""
    codes = LOWER_CODES if lower else BYTE_CODES
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in windows(raw, bounds):
        first, end = word_spans(raw, bounds, lo, hi)
        if not len(first):
            continue
        value = codes[raw[lo:hi]]
        lengths = end - first
        place = np.arange(lo, hi) - np.repeat(first, np.diff(np.append(first, hi)), axis=0) if first[0] == lo else None
        if place is None:
            place = np.zeros(hi - lo, np.int64)
            place[first[0] - lo :] = np.arange(first[0], hi) - np.repeat(first, np.diff(np.append(first, hi)))
        power = np.ones(int(place.max()) + 1, np.uint64)
        power[1:] = STEP
        value *= np.cumprod(power, dtype=np.uint64)[place]
        value[SPACE[raw[lo:hi]]] = 0
        sums = np.add.reduceat(value, first - lo)
        hashes.append(mix(sums + lengths.astype(np.uint64) * STEP))
        starts.append(first)
    first = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(first, bounds)


def shingle_sets(texts: pa.Array | pa.ChunkedArray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles.

    Fewer words than `size` make one shingle; a text without words has none.
    """
    raw, bounds = flat(texts)
    words, ends = word_hashes(raw, bounds)
    factor = np.cumprod(np.full(size, STEP, np.uint64), dtype=np.uint64)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        n = b - a
        if n == 0:
            yield np.zeros(0, np.uint64)
        elif n < size:
            yield mix((words[a:b] * factor[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            total = np.zeros(n - size + 1, np.uint64)
            for k in range(size):
                total += words[a + k : b - size + 1 + k] * factor[k]
            yield np.unique(mix(total))


def shingle_hashes(texts: pa.Array | pa.ChunkedArray, size: int = 5) -> np.ndarray:
    """Hashes of all word shingles of all texts, repeats included; texts of fewer words than `size` have none."""
    words, ends = word_hashes(*flat(texts))
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    total, factor = np.zeros(n, np.uint64), np.cumprod(np.full(size, STEP, np.uint64), dtype=np.uint64)
    for k in range(size):
        total += words[k : n + k] * factor[k]
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    return mix(total[owner[:n] == owner[size - 1 :]])
