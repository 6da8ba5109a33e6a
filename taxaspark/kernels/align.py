"""Semiglobal alignment of one motif with many sequences, free end gaps, affine gap costs.

Scores follow the EDNAFULL convention (5 for equal bases, -4 for others); a code that
stands for several bases scores the mean over what it may be.  All sequences of a batch
advance together, so each cell of the matrix is one vector operation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GAP_OPEN, GAP_EXTEND = 16.0, 4.0
MATCH, MISMATCH = 5.0, -4.0
_SETS = {"A": 1, "C": 2, "G": 4, "T": 8, "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12, "V": 7, "H": 11, "D": 13, "B": 14, "N": 15, "I": 15}
_MASK = np.full(256, 15, np.uint8)
for _c, _m in _SETS.items():
    _MASK[ord(_c)] = _MASK[ord(_c.lower())] = _m

_BITS = np.array([bin(i).count("1") for i in range(16)])
#: expected score of two codes: share of equal bases among the pairs they stand for
SCORE = np.array([[MISMATCH + (MATCH - MISMATCH) * (_BITS[a & b] / max(1, _BITS[a] * _BITS[b])) for b in range(16)] for a in range(16)])


def encode(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Padded codes and lengths."""
    n = np.array([len(s) for s in seqs])
    out = np.zeros((len(seqs), max(1, n.max() if len(n) else 1)), np.uint8)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = _MASK[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
    return out, n


def best_runs(motif: str) -> tuple[str, float] | None:
    """The runs of letters that no alignment with the motif can beat, as a regular expression, and their score.

    Each residue scores the most it can against any part of what it stands for, so a gap or an overhang
    is worse wherever every head and every tail of the motif is worth something; else None.
    """
    mask = _MASK[np.frombuffer(motif.encode(), np.uint8)]
    most = SCORE.max(axis=1)[mask]
    if not len(mask) or (np.cumsum(most) <= 0).any() or (np.cumsum(most[::-1]) <= 0).any():
        return None
    kinds = []
    for i, top in zip(mask, most):
        fit = [x for x in map(chr, range(1, 128)) if SCORE[i, _MASK[ord(x)]] == top]
        kinds.append("[" + "".join(f"\\x{ord(x):02x}" for x in fit) + "]")
    return "".join(kinds), float(most.sum())


def semiglobal(motif: str, seqs: list[str]) -> dict[str, np.ndarray]:
    """Best alignment of the motif with each sequence.

    score; first and last (1-based, inclusive) residue of the sequence within the motif's
    span, last = first - 1 if there is none; head and tail: motif residues that overhang
    the sequence's start and end.  Where the motif stands in full its place is the alignment:
    the one at the sequence's end, else the first.  Only other sequences are aligned.
    """
    runs = best_runs(motif)
    if runs is None or not len(seqs):
        return _aligned(motif, seqs)
    pattern, score = runs
    text = pa.array(seqs, pa.string())
    n = np.array([len(s) for s in seqs], np.int64)
    at = pc.find_substring_regex(text, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    at[~pc.string_is_ascii(text).to_numpy(zero_copy_only=False)] = -1  # places are bytes
    found = np.flatnonzero(at >= 0)
    closing = pc.match_substring_regex(text.take(pa.array(found)), pattern + r"\z").to_numpy(zero_copy_only=False)
    at[found[closing]] = n[found[closing]] - len(motif)
    zero = np.zeros(len(seqs), np.int64)
    out = {"score": np.full(len(seqs), score), "first": at + 1, "last": at + len(motif), "head": zero, "tail": zero.copy()}
    rest = np.flatnonzero(at < 0)
    if len(rest):
        for name, x in _aligned(motif, [seqs[i] for i in rest.tolist()]).items():
            out[name][rest] = x
    return out


def _aligned(motif: str, seqs: list[str]) -> dict[str, np.ndarray]:
    """:func:`semiglobal` of sequences in which the motif need not stand."""
    codes, n = encode(seqs)
    codes = np.ascontiguousarray(codes.T)  # one row per position, so a cell of all sequences is contiguous
    m, (width, count) = len(motif), codes.shape
    mask = _MASK[np.frombuffer(motif.encode(), np.uint8)]
    low = -1e9
    # Row i holds the best alignments that end at motif residue i; start is where they began:
    # j >= 0 for sequence residues skipped, -i for motif residues that overhang.
    h = np.zeros((width + 1, count))
    start = np.tile(np.arange(width + 1, dtype=np.int32)[:, None], (1, count))
    up, up_start = np.full((width + 1, count), low), np.zeros((width + 1, count), np.int32)
    cols = np.arange(count)
    best, best_start = np.full(count, low), np.zeros(count, np.int32)
    best_last, best_tail = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for i in range(1, m + 1):
        open_up, more_up = h - GAP_OPEN, up - GAP_EXTEND
        up = np.maximum(open_up, more_up)
        up_start = np.where(open_up >= more_up, start, up_start)
        # All but the gap in the motif is known from the row before.
        diagonal = h[:-1] + SCORE[mask[i - 1]][codes]
        vertical = up[1:] > diagonal
        new, new_start = np.empty_like(h), np.empty_like(start)
        new[0], new_start[0] = 0.0, -i
        new[1:], new_start[1:] = np.where(vertical, up[1:], diagonal), np.where(vertical, up_start[1:], start[:-1])
        left, left_start = np.full(count, low), np.zeros(count, np.int32)
        for j in range(1, width + 1):
            a = new[j - 1] - GAP_OPEN
            left -= GAP_EXTEND
            fresh = a >= left
            np.copyto(left, a, where=fresh)
            np.copyto(left_start, new_start[j - 1], where=fresh)
            across = left > new[j]
            if across.any():
                np.copyto(new[j], left, where=across)
                np.copyto(new_start[j], left_start, where=across)
        h, start = new, new_start
        end = h[n, cols]  # the sequence is used up; the rest of the motif overhangs
        better = end > best
        best, best_start = np.where(better, end, best), np.where(better, start[n, cols], best_start)
        best_last, best_tail = np.where(better, n, best_last), np.where(better, m - i, best_tail)
    inside = np.where(np.arange(width + 1)[:, None] <= n[None], h, low)
    at = inside.argmax(axis=0)
    better = inside[at, cols] > best
    best, best_start = np.where(better, inside[at, cols], best), np.where(better, start[at, cols], best_start)
    best_last, best_tail = np.where(better, at, best_last), np.where(better, 0, best_tail)
    return {"score": best, "first": np.maximum(best_start, 0) + 1, "last": best_last, "head": np.maximum(-best_start, 0), "tail": best_tail}
