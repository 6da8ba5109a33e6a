"""Word splitting and hashing over whole Arrow string columns with numpy.

Two word classes are used: ``SPACED`` (anything between white space) and ``ALNUM``
(runs of digits, letters and non-ASCII bytes).  A-Z are lower-cased in both.  Words
are hashed to 64 bits with a polynomial over their bytes followed by a mixer, so a
batch of texts costs a few vector operations and no Python string per word.
Texts are cut into windows at word ends, so memory stays bounded for any text size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
WINDOW = 1 << 20


def _values(is_word) -> np.ndarray:
    """0 for separators, else 1 + the lower-cased byte."""
    return np.array([(1 + (b + 32 if 65 <= b <= 90 else b)) if is_word(b) else 0 for b in range(256)], dtype=np.uint64)


SPACED = _values(lambda b: not (b == 32 or 9 <= b <= 13))
ALNUM = _values(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)

_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, WINDOW + 1), base, dtype=U64)
        steps[0] = 1
        have = _POW[base] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chain(*hashes: np.ndarray, salt: int = 0) -> np.ndarray:
    """An order-sensitive hash of several hashes."""
    out = np.full(len(hashes[0]), salt + 0x51ED270B, dtype=U64)
    for h in hashes:
        out = mix(out * U64(0xD6E8FEB86659FD93) + h)
    return out


def _cuts(data: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(data)
    while at < n:
        end = min(at + WINDOW, n)
        while end < n:
            gap = np.flatnonzero(values[data[at:end]][::-1] == 0)
            if len(gap):
                end -= int(gap[0])
                break
            end = min(end + WINDOW, n)  # one word longer than the window
        yield at, end
        at = end


def words(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and byte ends of all words of ``data`` (uint8)."""
    hashes, starts, ends = [], [], []
    for a, b in _cuts(data, values):
        v = values[data[a:b]]
        edge = np.diff(np.concatenate(([0], (v != 0).view(np.int8), [0])))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(s):
            continue
        prefix = np.zeros(b - a + 1, dtype=U64)
        np.cumsum(v * _powers(_BASE, b - a)[: b - a], out=prefix[1:])
        hashes.append(mix((prefix[e] - prefix[s]) * _powers(_INVERSE, b - a)[s] + (e - s).astype(U64)))
        starts.append(s + a)
        ends.append(e + a)
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def word_hash(word: str, values: np.ndarray = ALNUM) -> int:
    """The hash of one word, as :func:`words` gives it."""
    return int(words(np.frombuffer(word.encode(), np.uint8), values)[0][0])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a space, and each text's start (n + 1 offsets). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    blank, gap = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    padded = pc.binary_join_element_wise(pc.fill_null(column, blank), blank, gap)
    if isinstance(padded, pa.ChunkedArray):
        padded = padded.combine_chunks()
    _, offsets, data = padded.buffers()
    off = np.frombuffer(offsets, np.int64)[padded.offset : padded.offset + len(padded) + 1] if len(padded) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together (a longer text stands alone)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def runs(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts of about ``most`` bytes: first and last + 1 row, bytes, and offsets, as :func:`utf8` gives them."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    for a, b in slices(np.concatenate(([0], np.cumsum(sizes))), most):
        yield a, b, *utf8(column.slice(a, b - a))


def text_words(column: pa.Array, values: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first and last + 1 row, word hashes, and each word's row within the run."""
    for a, b, data, offsets in runs(column, most):
        h, s, _ = words(data, values)
        yield a, b, h, np.searchsorted(offsets, s, "right") - 1
