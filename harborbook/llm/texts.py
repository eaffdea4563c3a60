"""Words and their hashes, as Spark columns and for whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_GAP = "[ \\t-\\r]+"

#: Bytes of text that one step inside a task works on; a longer document is a step of its own.
STEP_BYTES = 1 << 21


def fold_case(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the folded text; none for null."""
    return F.filter(F.split(F.coalesce(fold_case(text), F.lit("")), WORD_GAP), lambda w: w != "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, also where ``f`` uses it inside another function of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingle_hashes(words: Column, size: int = 5) -> Column:
    """Distinct 64-bit hashes of the word shingles; fewer words than ``size`` are one shingle, no words none."""

    def of(w: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
        some = F.when(F.size(w) >= size, F.array_distinct(rolled)).otherwise(F.array(F.xxhash64(w)))
        return F.when(F.size(w) > 0, some).otherwise(F.array().cast("array<bigint>"))

    return bound(words, of)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (or large binary values) of a batch and where each starts (one more than texts); null is empty."""
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, starts - starts[0]


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts) of runs of rows with about ``most`` bytes of text."""
    body, starts = text_buffer(texts)
    row, rows = 0, len(starts) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + most, side="right")) - 1)
        yield row, body[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        row = end


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits; fixed values of a common finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.arange(256) >= 0x80
_PLAIN[[*b"0123456789", *UPPER.encode(), *LOWER.encode()]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_CODE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_FOLD]
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(max(count, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _edges(body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end byte) of each word."""
    size = len(body)
    inside = ~_SPACE[body]
    cut = np.zeros(size + 1, bool)
    cut[starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:size]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:size]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _hashed(body: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = len(body)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_CODE[body] * powers(_BASE, size), out=total[1:])
    back = powers(_INVERSE, size)
    return _mix((total[end] - total[first]) * back[first])


def word_hashes(body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each folded word, and the number of words before each text (one more than texts).

    Equal words have equal hashes on every machine, wherever they stand.
    """
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    first, end = _edges(body, starts)
    return _hashed(body, first, end), first, end, np.searchsorted(first, starts)


def bare_word_hashes(body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each folded word without the signs at its edges, its number among all words, and the numbers of such words
    and of all words before each text (one more than texts).

    Words of signs alone are passed over.  ASCII but letters and digits, and U+2000 to U+203F (curly quotes, dashes, bullets)
    are signs.
    """
    none = np.zeros(len(starts), np.int64)
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), none, none
    first, end = _edges(body, starts)
    before = np.searchsorted(first, starts)
    plain = _PLAIN[body]
    lead = np.flatnonzero(body[:-2] == 0xE2)
    lead = lead[body[lead + 1] == 0x80]
    for k in range(3):
        plain[lead + k] = False
    at, upto = np.flatnonzero(plain), np.concatenate([[0], np.cumsum(plain)])
    number = np.flatnonzero(upto[end] > upto[first])
    first, end = at[upto[first[number]]], at[upto[end[number]] - 1] + 1
    return _hashed(body, first, end), number, np.searchsorted(first, starts), before


def rolled(values: np.ndarray, size: int) -> np.ndarray:
    """One hash for every ``size`` neighbours."""
    count = max(0, len(values) - size + 1)
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = (out ^ values[k : k + count]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return _mix(out)


def shingle_sets(words: np.ndarray, before: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, by the rule of ``shingle_hashes`` (other hash values)."""
    whole = rolled(words, size)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(rolled(words[a:b], b - a))
        else:
            out.append(whole[:0])
    return out
