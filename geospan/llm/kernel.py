"""Vectorised reading of texts in Arrow batches, shared by the operators of this subpackage.

A word is a maximal run of letters, digits and combining marks, lower-cased. Texts of any
length are read whole: a long one is cut into pieces between words for the conversion to
code points only, and its words or character windows are put together again by document.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_LAST = 0x32400
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64), on a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def letters(digits: bool = True) -> np.ndarray:
    """For each code point, whether it belongs to a word."""
    table = np.zeros(0x110000, np.bool_)
    for i in range(1, _LAST):
        c = unicodedata.category(chr(i))
        table[i] = c[0] in "LM" or (digits and c[0] == "N")
    return table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_powers() of at least n; only those of the usual length are kept, not those of a text that can't be cut."""
    usual = 4 * CHUNK
    return _usual() if n <= usual else _powers(n)


@functools.cache
def _usual() -> tuple[np.ndarray, np.ndarray]:
    return _powers(4 * CHUNK)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(p: int) -> np.ndarray:
        out = np.full(n, p, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_P), run(_P_INV)


def strings(column: pa.Array) -> list[str]:
    """Nulls become empty texts; bytes that aren't UTF-8 become U+FFFD."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LMN"


def pieces(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, str]]:
    """(document, piece): a text longer than limit is cut where a character isn't of a word, never within one, so that only a single word is longer."""
    for i, t in enumerate(texts):
        if len(t) <= limit:
            yield i, t
            continue
        at = 0
        while len(t) - at > limit:
            end = at + limit
            while end < len(t) and letter(t[end]):
                end += 1
            yield i, t[at:end]
            at = end
        yield i, t[at:]


def folded(texts: list[str], lower: bool = True, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, bounds, documents): piece k, of document documents[k], lies between the zeros at bounds[k] and bounds[k + 1]."""

    def made(group: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = "\0" + "\0".join(t.replace("\0", " ") if "\0" in t else t for _, t in group) + "\0"
        codes = np.frombuffer((s.lower() if lower else s).encode("utf-32-le", "replace"), np.uint32)
        return codes, np.flatnonzero(codes == 0), np.array([i for i, _ in group], np.int64)

    group, size = [], 0
    for i, t in pieces(texts, limit):
        if group and size + len(t) > limit:
            yield made(group)
            group, size = [], 0
        group.append((i, t))
        size += len(t) + 1
    if group:
        yield made(group)


def edges(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True; the first and last entries are False."""
    at = np.flatnonzero(member[1:] != member[:-1]) + 1
    return at[0::2], at[1::2]


def words(texts: list[str], prefix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(hashes, offsets, prefixes): 64-bit hashes of the words of all texts in order; text i has those from offsets[i] to offsets[i + 1].

    prefixes: with prefix > 0, the hashes of the words' first characters, so many.
    """
    table, found, heads, counts = letters(), [], [], np.zeros(len(texts) + 1, np.int64)
    for codes, bounds, docs in folded(texts):
        starts, ends = edges(table[codes])
        if not len(starts):
            continue
        power, inverse = powers(len(codes) + 1)
        x = codes.astype(np.uint64)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= power[: len(x)]
        total = np.cumsum(x)
        before, scale = total[starts - 1], inverse[starts]
        found.append(mix((total[ends - 1] - before) * scale))
        if prefix:
            heads.append(mix((total[np.minimum(ends, starts + prefix) - 1] - before) * scale + np.uint64(1)))
        counts[1:] += np.bincount(docs, np.diff(np.searchsorted(starts, bounds)), len(texts)).astype(np.int64)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return join(found), np.cumsum(counts), join(heads) if prefix else None


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about limit entries each; a longer document makes a block of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + lengths[i] - 1, for all i."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    return np.arange(n) + np.repeat(starts - (ends - lengths), lengths)


def mapped(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 2000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: f on slices of at most so many rows, so that a worker's memory doesn't depend on the session's batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = f(batch.slice(at, rows))
                if out is not None:
                    yield out
        trimmed()

    return run


def trimmed() -> None:
    """Give memory that a finished task has freed back to the system: workers are used again, and those that wait should be small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
