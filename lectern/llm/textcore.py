"""Vectorised text work on whole batches: words, shingle hashes and character n-grams with numpy."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are taken in groups of about so many bytes, so that the arrays at hand stay small.
GROUP_BYTES = 500_000

_lower = bytes(range(256)).lower()
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_kept: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next call unless very many."""
    got = _kept.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, GROUP_BYTES), base, dtype=U)
        steps[0] = 1
        got = np.cumprod(steps)
        if n <= 1 << 21:
            _kept[base] = got
    return got[:n]


def sliced(batches, rows: int = 500):
    """The same rows in smaller batches (views), so that what Python holds of them at a time stays small; at the end, freed memory goes back to the system, as workers live on."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    trimmed()


def trimmed() -> None:
    """Give freed memory back to the system, as far as the platform can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def groups(texts: list[bytes]):
    """(from, to) of runs of texts of about GROUP_BYTES."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_BYTES or k + 1 == len(texts):
            yield at, k + 1
            at, size = k + 1, 0


def spans_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; spans are in order and apart.

    It is a polynomial over the bytes modulo 2 ** 64, taken as a difference of running sums and
    shifted back to the span's start, then finalised together with the length. Spans are taken a
    few bytes' worth at a time, so that a very long text needs no large arrays.
    """
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + GROUP_BYTES)))
        first, last = starts[i:j] - lo, stops[i:j] - lo
        part = data[lo : int(stops[j - 1])]
        sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum((part.astype(U) + U(1)) * powers(BASE, len(part)))))
        value = (sums[last] - sums[first]) * powers(INVERSE, len(part))[first]
        out[i:j] = mix(mix(value) + (last - first).astype(U))
        i = j
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts, end to end, and each text's number of words."""
    return word_spans(texts)[:2]


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes, then each word's start and stop in the texts joined by one blank, and those bytes, lower-cased."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined.lower(), dtype=np.uint8)
    space = IS_SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    stops = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    value = spans_of(data, starts, stops)
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    upto = np.searchsorted(starts, text_ends)
    return value, np.diff(upto, prepend=0), starts, stops, data
