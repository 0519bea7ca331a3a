"""Words and word n-grams of whole Arrow columns as numpy arrays, without a Python loop over words.

A word is a longest run of letters, marks and digits by Unicode, in lower case; other characters part words. In scripts
that are written without spaces each character, with the marks after it, is a word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: What a character is to words: it parts them, it stands in one, it is one, it goes on with the one before.
SIGN, INNER, ALONE, MARK = range(4)
ASCII_WORD = np.array([c < 0x80 and chr(c).isalnum() for c in range(256)])
#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, Tai Le to Tai Tham, kana, bopomofo, Han, Yi, Myanmar's extensions, the
#: half-width kana, and what stands above the first plane.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x312F)]
UNSPACED += [(0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA48F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F)]
UNSPACED += [(0x16FE0, 0x18DFF), (0x1AFF0, 0x1B16F), (0x20000, 0x323AF)]


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """SIGN, INNER, ALONE or MARK for each code point. Variation selectors and enclosing marks are signs."""
    by = {"L": INNER, "N": INNER, "M": MARK}
    out = np.zeros(0x110000, np.uint8)
    out[:0x32400] = [SIGN if c.startswith("Me") else by.get(c[0], SIGN) for c in map(unicodedata.category, map(chr, range(0x32400)))]
    out[0xFE00:0xFE10] = SIGN
    for a, b in UNSPACED:
        part = out[a : b + 1]
        part[part == INNER] = ALONE
    return out


def classify(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of UTF-8: whether it stands in a word, whether one starts there even if the byte before stands in one, and
    whether it belongs to a character that is a word by itself."""
    inside = ASCII_WORD[data]
    forced, alone = np.zeros(len(data), bool), np.zeros(len(data), bool)
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return inside, forced, alone
    first = data[lead]
    size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
    code = first.astype(np.int64) & (0x7F >> size)
    for j in (1, 2, 3):
        more = size > j
        code[more] = code[more] << 6 | (data[lead[more] + j] & 0x3F)
    kind = kinds()[code]
    for j in range(4):
        more = size > j
        inside[lead[more] + j] = kind[more] != SIGN
        alone[lead[more] + j] = kind[more] == ALONE
    one = lead[kind == ALONE]
    forced[one] = True
    # what follows such a character, its marks passed over, starts anew
    begins = np.ones(len(data), bool)
    begins[(data & 0xC0) == 0x80] = False
    begins[lead[kind == MARK]] = False
    at = np.flatnonzero(begins)
    after = at[1:][alone[at[:-1]]]
    forced[after] = True
    return inside, forced, alone


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """The words of rows first ... first+rows-1 of a column; word i is data[start[i]:end[i]], row r has words at[r] ... at[r+1]-1.

    alone[i]: word i is one character of a script without spaces.
    """

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray
    alone: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.at))


def words(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of all rows, some rows at a time (null counts as empty). A row is never cut, however long."""
    tables: dict[str, np.ndarray] = {}
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, total[a] + chunk_bytes, "right")) - 1)
        lower = pc.utf8_lower(pc.fill_null(column.slice(a, b - a).cast(pa.large_string()), ""))
        if isinstance(lower, pa.ChunkedArray):
            lower = lower.combine_chunks()
        _, off, buf = lower.buffers()
        offsets = np.frombuffer(off, np.int64)[lower.offset : lower.offset + b - a + 1]
        data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if len(tables.get("up", ())) < len(data):
            size = max(len(data), chunk_bytes + chunk_bytes // 8)
            tables = {"up": powers(BASE, size), "down": powers(inverse(BASE), size)}
        inside, forced, alone = classify(data)
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[offsets] = False  # rows part words
        starts = inside & (forced | ~before[: len(data)])
        after = np.zeros(len(data) + 1, bool)
        after[: len(data)] = inside & ~starts
        after[offsets] = False
        start = np.flatnonzero(starts)
        end = np.flatnonzero(inside & ~after[1:]) + 1
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * tables["up"][: len(data)], out=prefix[1:])
        h = mix((prefix[end] - prefix[start]) * tables["down"][start]) if len(start) else np.zeros(0, np.uint64)
        yield Words(a, b - a, data, offsets, start, end, h, np.searchsorted(start, offsets), alone[start])
        a = b


def hash_word(word: str) -> int:
    """The hash that words() gives this word."""
    return int(next(words(pa.array([word]))).hash[0])


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for every i with k words left, rows not regarded."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(WORD_BASE, n), out=prefix[1:])
    return mix((prefix[k:] - prefix[: n + 1 - k]) * powers(inverse(WORD_BASE), n + 1 - k))


def whole(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """For ngrams(): whether n-gram i lies in one row."""
    m = max(0, n - k + 1)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return row[:m] == row[k - 1 :][:m] if m else np.zeros(0, bool)
