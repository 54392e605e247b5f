"""Word shingles of whole batches of texts as 64-bit numbers.

The bytes of a batch stand in one buffer. A word's number is the sum of its bytes' numbers times the powers of an odd base,
taken from running sums of the whole buffer and moved to power 0 by the base's inverse; a shingle's number mixes those of
its words. Equal words and shingles have equal numbers wherever they stand; two that differ have equal numbers with odds
of about 1 in 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from signalspark.llm.shared import LOWER_TABLE

#: Bytes whose running sums are held at once.
SEGMENT = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A number for each byte, and one for each place in a shingle.
OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
OF_PLACE = mixed(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.frombuffer(LOWER_TABLE, np.uint8)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


UP, DOWN = powers(BASE, SEGMENT + 1), powers(INVERSE, SEGMENT + 1)


def numbers_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the words at ``starts`` to ``ends`` of a buffer, which lie in order and don't overlap. Words longer than a
    segment are summed over several."""
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(data), SEGMENT):
        end = min(at + SEGMENT, len(data))
        low, high = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, end)
        if low == high:
            continue
        sums = np.zeros(end - at + 1, np.uint64)
        np.cumsum(OF_BYTE[data[at:end]] * UP[: end - at], out=sums[1:])
        a, b = np.maximum(starts[low:high], at), np.minimum(ends[low:high], end)
        part = (sums[b - at] - sums[a - at]) * DOWN[a - at]
        behind = a - starts[low:high]  # bytes of the word before this segment
        if behind.any():
            far = np.flatnonzero(behind)
            part[far] *= np.array([pow(BASE, int(n), 1 << 64) for n in behind[far]], np.uint64)
        out[low:high] += part
    return mixed(out)


def shingles(texts: pa.Array, words: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all shingles of a column of texts, repeats included, and where each text's begin (one more than texts).
    A-Z are lower-cased; words are runs of bytes other than white space; a text of fewer words has one shingle of all of
    them; null and blank texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low:high]]
    offsets = offsets - low
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # no word goes on from one text to the next
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    numbers = numbers_of(data, starts, ends)
    first = np.searchsorted(starts, offsets)  # of each text, its first word
    n_words = np.diff(first)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    begins = np.concatenate([[0], np.cumsum(n_shingles)])
    at = np.repeat(first[:-1] - begins[:-1], n_shingles) + np.arange(begins[-1])
    last = np.repeat(first[1:], n_shingles)
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([numbers, np.zeros(words, np.uint64)])
    for i in range(words):
        total += np.where(at + i < last, padded[at + i] * OF_PLACE[i], np.uint64(0))
    return mixed(total), begins


def sets(texts: pa.Array, words: int = 4) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    numbers, begins = shingles(texts, words)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        yield np.unique(numbers[a:b])
