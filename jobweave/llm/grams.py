"""Words, rolling hashes and minimizers over Arrow text columns, a block of documents at a time.

All functions work on whole numpy arrays: a batch of texts is one run of bytes
with the offsets of its documents. Memory is bounded by ``BLOCK`` bytes of text
(longer documents are cut into overlapping pieces), not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
#: Bytes that separate words: space and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Two independent random values for each byte, and odd multipliers with their inverses modulo 2**64.
BYTE_VALUES = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for _ in range(2)]
MULTIPLIERS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        out = np.full(max(n, BLOCK + 4096), base % 2**64, dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if len(out) > 8 * BLOCK:
            return out[:n]
        _POWERS[base] = known = out
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def prefix_sums(values: np.ndarray, multiplier: int) -> np.ndarray:
    """Sums of values[i] * multiplier**i, with a leading zero."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.multiply(values, powers(multiplier, len(values)), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def stretch(sums: np.ndarray, multiplier: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], whatever stands before start."""
    inverse = pow(multiplier, -1, 2**64)
    return (sums[end] - sums[start]) * powers(inverse, len(sums))[start]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows with at most ``limit`` in total, one row at least."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; a word never crosses the end of a document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words_of(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK, hashes: int = 2):
    """Words of a block of documents.

    Returns start, end (byte positions), hashes (a list of 64-bit arrays, each
    from its own random byte values) and the offsets of the documents in words.
    """
    if len(data) <= 2 * BLOCK:
        start, end = word_bounds(data, offsets, blank)
        found = []
        for j in range(hashes):
            sums = prefix_sums(BYTE_VALUES[j][data], MULTIPLIERS[j])
            found.append(mix(stretch(sums, MULTIPLIERS[j], start, end) + (end - start).astype(np.uint64)))
        return start, end, found, np.searchsorted(start, offsets)
    # a very long document: pieces that end with a blank, so that no word is cut
    parts, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + BLOCK)
        while hi < len(data) and not (gaps := np.flatnonzero(blank[data[max(lo, hi - 4096) : hi]])).size:
            hi = min(len(data), hi + 4096)
        if hi < len(data):
            hi = max(lo, hi - 4096) + int(gaps[-1]) + 1
        inner = offsets[(offsets > lo) & (offsets < hi)]
        piece = data[lo:hi]
        start, end = word_bounds(piece, np.concatenate([[0], inner - lo, [hi - lo]]), blank)
        found = []
        for j in range(hashes):
            sums = prefix_sums(BYTE_VALUES[j][piece], MULTIPLIERS[j])
            found.append(mix(stretch(sums, MULTIPLIERS[j], start, end) + (end - start).astype(np.uint64)))
        parts.append((start + lo, end + lo, found))
        lo = hi
    start, end = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    found = [np.concatenate([p[2][j] for p in parts]) for j in range(hashes)]
    return start, end, found, np.searchsorted(start, offsets)


def gram_hashes(values: np.ndarray, k: int, multiplier: int) -> np.ndarray:
    """Hash of every k neighbouring values."""
    sums = prefix_sums(values, multiplier)
    n = max(0, len(values) - k + 1)
    inverse = pow(multiplier, -1, 2**64)
    return mix((sums[k : k + n] - sums[:n]) * powers(inverse, n))


def leftmost_minimum(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the first minimum in every window of w neighbouring values."""
    value, place, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < w:
        step = min(have, w - have)
        later = value[step:] < value[:-step]
        value = np.where(later, value[step:], value[:-step])
        place = np.where(later, place[step:], place[:-step])
        have += step
    return place


def window_runs(first: np.ndarray, second: np.ndarray, offsets: np.ndarray, span: int, k: int):
    """Runs of neighbouring windows of ``span`` values with the same minimizer.

    A window's minimizer is its first smallest k-gram. Equal windows have equal
    minimizers at equal places, so equal windows are always found under equal
    gram hashes; a run holds at most span - k + 1 windows. Windows lie within one
    document. Returns document, first window (counted in its document), number of
    windows, hash of the minimizer gram (from ``first``) and hash of all values
    that the run covers (from ``second``).
    """
    n = len(first) - span + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    grams = gram_hashes(first, k, MULTIPLIERS[2])
    place = leftmost_minimum(grams, span - k + 1)[:n]
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    whole = np.arange(n) + span <= offsets[document + 1]
    head = np.ones(n, bool)
    head[1:] = (place[1:] != place[:-1]) | (document[1:] != document[:-1])
    start = np.flatnonzero(head & whole)
    if not len(start):
        return none, none, none, none, none
    # a run ends before the next head or where its document has no more whole windows
    heads = np.flatnonzero(head)
    following = np.append(heads[1:], n)[np.searchsorted(heads, start)]
    end = np.minimum(following, offsets[document[start] + 1] - span + 1)
    sums = prefix_sums(second, MULTIPLIERS[3])
    covered = mix(stretch(sums, MULTIPLIERS[3], start, end + span - 1) + (end - start).astype(np.uint64))
    return (
        document[start], start - offsets[document[start]], end - start,
        grams[place[start]].view(np.int64), covered.view(np.int64),
    )
