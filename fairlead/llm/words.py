"""Words of whole texts as numpy arrays, for the operators that run in Arrow batches.

Words are maximal runs of bytes other than space and tab to carriage return, or, where punctuation shall
not matter, other than any ASCII byte that is no letter or digit; A-Z count as a-z. A word is
its 64-bit hash. Nothing here looks beyond one Arrow batch, and working arrays are bounded by ``BLOCK``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
PUNCTUATION = ~(np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)]) | (np.arange(256) >= 128))
_FOLDED = np.arange(256, dtype=np.uint64) + 1
_FOLDED[ord("A") + np.arange(26)] += 32
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which all bits depend on all."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, one after the other, and where each begins and the last ends. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(bounds) == 0:
        bounds = np.zeros(1, np.int64)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _blocks(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about ``BLOCK`` bytes that no word crosses: between texts, or at a separator inside one."""
    at, total = 0, len(data)
    while at < total:
        end = min(at + BLOCK, total)
        if end < total:
            between = bounds[np.searchsorted(bounds, end, "right") - 1]
            if between > at:
                end = int(between)
            else:
                gaps = np.flatnonzero(separator[data[at:end]])
                limit = int(bounds[np.searchsorted(bounds, at, "right")])
                while not len(gaps) and end < limit:
                    end = min(end + BLOCK, limit)
                    gaps = np.flatnonzero(separator[data[at:end]])
                end = end if end == limit or not len(gaps) else at + int(gaps[-1]) + 1
        yield at, end
        at = end


def word_hashes(
    column: pa.Array | pa.ChunkedArray, separator: np.ndarray = SPACE, heads: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes in order, and where each text's words begin (and the last end).

    With ``heads``, each word gives a row of hashes: its own, then those of its first bytes of these
    lengths, 0 where it is shorter.
    """
    data, bounds = text_bytes(column)
    hashes, places = [np.zeros((0, 1 + len(heads)), np.uint64)], [np.zeros(0, np.int64)]
    for low, high in _blocks(data, bounds, separator):
        part = data[low:high]
        inside = ~separator[part]
        cuts = bounds[np.searchsorted(bounds, low, "right") : np.searchsorted(bounds, high)] - low
        # A word begins after a separator or a cut between texts, and ends before one.
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[cuts] = inside[cuts]
        ends[:-1] &= ~inside[1:]
        ends[cuts - 1] = inside[cuts - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_FOLDED[part] * up[: len(part)], out=sums[1:])
        rows = np.empty((len(first), 1 + len(heads)), np.uint64)
        rows[:, 0] = scramble((sums[last] - sums[first]) * down[first])
        for j, length in enumerate(heads, 1):
            end = np.minimum(first + length, last)
            head = scramble((sums[end] - sums[first]) * down[first] + np.uint64(length))
            rows[:, j] = np.where(last - first >= length, head, np.uint64(0))
        hashes.append(rows)
        places.append(first + low)
    at = np.concatenate(places)
    found = np.concatenate(hashes)
    return found if heads else found[:, 0], np.searchsorted(at, bounds)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per text, its distinct shingles of ``width`` words as sorted hashes.

    A text with fewer words has one: its whole sequence. A text without words has none.
    """
    weights = scramble(np.arange(1, width + 2, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    count = max(len(words) - width + 1, 0)
    runs = np.zeros(count, np.uint64)
    for j in range(width):
        runs += scramble(words[j : j + count] ^ weights[j]) * weights[j]
    runs = scramble(runs)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low >= width:
            found = np.sort(runs[low : high - width + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif high > low:
            n = high - low
            yield scramble(
                (scramble(words[low:high] ^ weights[:n]) * weights[:n]).sum(dtype=np.uint64, keepdims=True)
                + weights[-1:] * np.uint64(n)
            )
        else:
            yield np.zeros(0, np.uint64)
