"""Profile hidden Markov models: emission and transition logs, forward, Viterbi, training.

A model of size L has match states 1..L, insert states 0..L, delete states 1..L.
``a`` is 9 x (L + 1): log probabilities of DD DM DI MD MM MI ID IM II from each position,
``e`` is R x L: log emission of residues at match states; inserts emit the background.
Forward scores are log P(sequence | model) over all paths, without odds.  The sequences of
a batch advance together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

DD, DM, DI, MD, MM, MI, ID, IM, II = range(9)
LOW = -1e9
DNA = "ACGT"
AMINO = "ACDEFGHIKLMNPQRSTVWY"


@dataclass
class Phmm:
    size: int
    a: np.ndarray
    e: np.ndarray
    qa: np.ndarray
    qe: np.ndarray

    @property
    def letters(self) -> str:
        return DNA if self.e.shape[0] == 4 else AMINO


def encode(seqs: list[str], letters: str = DNA) -> tuple[np.ndarray, np.ndarray]:
    """Padded residue numbers (-1 for others, which score as background) and lengths."""
    table = np.full(256, -1, np.int64)
    table[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    n = np.array([len(s) for s in seqs], dtype=np.int64)
    out = np.full((len(seqs), max(1, int(n.max()) if len(n) else 1)), -1, np.int64)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = table[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
    return out, n


def _emissions(model: Phmm, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Match emissions (size, batch, position) and insert emissions (batch, position)."""
    wide = np.vstack((model.e, np.log(np.maximum(np.exp(model.qe) @ np.exp(model.e), 1e-12))))
    inserts = np.append(model.qe, np.log(np.sum(np.exp(model.qe) ** 2)))
    return wide[codes].transpose(2, 0, 1), inserts[codes]


#: tables of one part of a batch are at most this many bytes
TABLE_BYTES = 64 << 20

#: the moves into a match (or the end), an insert and a delete state from match, insert and delete
INTO = np.array([[MM, IM, DM], [MI, II, DI], [MD, ID, DD]])


def parts(model: Phmm, seqs: list[str]) -> Iterator[slice]:
    """Slices of a batch whose tables are within TABLE_BYTES, one sequence at least."""
    widest = max(map(len, seqs), default=0) + 1
    step = max(1, TABLE_BYTES // (24 * (model.size + 1) * widest))
    return (slice(i, i + step) for i in range(0, len(seqs), step))


def forward(model: Phmm, seqs: list[str]) -> np.ndarray:
    """Log P(sequence | model) of each sequence.

    Probabilities are added up as they are. Where some may vanish beside the largest (see :func:`scaled`), sequences that
    come out under exp(FLOOR) are done again by logs: what vanished was under exp(-708) each and only shrinks, so above it does not count.
    """
    out, width = np.empty(len(seqs)), max(map(len, seqs), default=0)
    step = max(1, SUM_BYTES // (8 * (model.size + 1)))
    for i in range(0, len(seqs), step):
        out[i : i + step] = _sums(model, seqs[i : i + step])
    fine = np.isfinite(out) if scaled(model, width) else np.isfinite(out) & (out > FLOOR)
    todo = np.flatnonzero(~fine).tolist()
    rest = [seqs[i] for i in todo]
    for p in parts(model, rest):
        out[todo[p]] = _run(model, rest[p], np.logaddexp)[0]
    return out


#: the states of one kind of the sequences that :func:`_sums` advances together are about this many bytes
SUM_BYTES = 1 << 20
FLOOR = -600.0


def scaled(model: Phmm, width: int) -> bool:
    """Whether states of sequences of this length stay within exp(-600) of each other, if a path can lead to them.

    A path to one state can be turned to any other by no more than ``size`` of the least likely moves
    and residues; meanwhile others may stay in inserts that are likelier by the range of theirs.
    """
    moves = model.a[model.a > LOW / 2]
    worst = -2 * moves.min() - min(model.e.min(), model.qe.min())
    stay = model.a[II]
    return bool(worst * (model.size + 1) + (stay.max() - stay.min()) * width < 600)


def _sums(model: Phmm, seqs: list[str]) -> np.ndarray:
    """As :func:`_run` with ``logaddexp``, residue by residue: each column of states is scaled by its largest."""
    codes, n = encode(seqs, model.letters)
    order = np.argsort(-n, kind="stable")
    codes, left = np.ascontiguousarray(codes[order].T), n[order]
    wide = np.exp(np.vstack((model.e, np.log(np.maximum(np.exp(model.qe) @ np.exp(model.e), 1e-12)))).T)
    wide = np.vstack((np.zeros(wide.shape[1]), wide))  # no match at position 0
    inserts = np.exp(np.append(model.qe, np.log(np.sum(np.exp(model.qe) ** 2))))
    p, size = np.exp(model.a)[:, :, None], model.size
    m, i, d = (np.zeros((size + 1, len(seqs))) for _ in range(3))
    m[0] = 1.0
    log, out = np.zeros(len(seqs)), np.empty(len(seqs))

    def delete(m, i, d):
        into = m[:-1] * p[MD, :-1] + i[:-1] * p[ID, :-1]
        for k in range(1, size + 1):
            np.multiply(d[k - 1], p[DD, k - 1], out=d[k])
            d[k] += into[k - 1]

    delete(m, i, d)
    live = len(seqs)
    with np.errstate(divide="ignore"):
        for j in range(codes.shape[0] + 1):
            done = int((left[:live] > j).sum())
            if done < live:  # sequences are by falling length
                end = m[-1, done:] * p[MM, size] + i[-1, done:] * p[IM, size] + d[-1, done:] * p[DM, size]
                out[done:live] = np.log(end) + log[done:live]
                live = done
                m, i, d = (np.ascontiguousarray(x[:, :live]) for x in (m, i, d))
            if not live:
                break
            c = codes[j, :live]
            new = np.zeros_like(m)
            new[1:] = m[:-1] * p[MM, :-1]
            new[1:] += i[:-1] * p[IM, :-1]
            new[1:] += d[:-1] * p[DM, :-1]
            new *= np.take(wide, c, axis=1)
            i *= p[II]
            i += m * p[MI]
            i += d * p[DI]
            i *= inserts[c]
            m = new
            delete(m, i, d)
            if j % 16 == 15:
                top = np.maximum(np.maximum(m.max(axis=0), i.max(axis=0)), d.max(axis=0))
                top = np.where(top > 0, top, 1.0)
                m, i, d = m / top, i / top, d / top
                log[:live] += np.log(top)
    back = np.empty(len(seqs))
    back[order] = out
    return back


def viterbi(model: Phmm, seqs: list[str]) -> tuple[np.ndarray, list[list[tuple[str, int, int]]]]:
    """Log probability and states of the best path: (M, I or D; position; residue index or -1)."""
    scores, paths = [np.zeros(0)], []
    for p in parts(model, seqs):
        score, tables = _run(model, seqs[p], np.maximum, keep=True)
        scores.append(score)
        found: list[list] = [[] for _ in score]
        for rows, _, state, k, j in _steps(model, tables, np.array([len(s) for s in seqs[p]])):
            for row, st, kk, jj in zip(rows.tolist(), state.tolist(), k.tolist(), j.tolist()):
                if st or kk:
                    found[row].append(("MID"[st], kk, jj - 1 if st != 2 else -1))
        paths += [x[::-1] for x in found]
    return np.concatenate(scores), paths


def _steps(model: Phmm, tables: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """Steps back along the best paths of all sequences at once: (rows, move, state it leaves, its position, residues read).

    A path's last step leaves match state 0, the start.  Of equal paths (to nine decimals) the
    one that comes from a match is taken, then from an insert.
    """
    rows, k, j = np.arange(len(n)), np.full(len(n), model.size), n
    into = np.zeros(len(n), np.int64)
    while len(rows):
        moves = INTO[into]
        state = np.round(tables[:, k, rows, j].T + model.a[moves, k[:, None]], 9).argmax(axis=1)
        yield rows, moves[np.arange(len(rows)), state], state, k, j
        going = (state != 0) | (k > 0)
        rows, into, k, j = rows[going], state[going], k[going], j[going]
        k, j = k - (into != 1), j - (into != 2)


def _run(model: Phmm, seqs: list[str], add, keep: bool = False):
    """Scores, and the tables of match, insert and delete states (state, position, sequence, residues read) if kept."""
    codes, n = encode(seqs, model.letters)
    batch, width = codes.shape
    match, insert = _emissions(model, codes)
    a = model.a
    rows = np.arange(batch)
    m, i, d = (np.full((batch, width + 1), LOW) for _ in range(3))
    m[:, 0] = 0.0
    tables = np.empty((3, model.size + 1, batch, width + 1)) if keep else None
    read, steps = np.cumsum(insert, axis=1), np.arange(width)
    for k in range(model.size + 1):
        if k:
            nm = np.full_like(m, LOW)
            into = add(add(m + a[MM, k - 1], i + a[IM, k - 1]), d + a[DM, k - 1])
            nm[:, 1:] = into[:, :-1] + match[k - 1]
            d = add(add(m + a[MD, k - 1], i + a[ID, k - 1]), d + a[DD, k - 1])
            m = nm
        # A run of inserts: without what the run itself costs, its recursion is a running maximum or sum.
        run = read + a[II, k] * steps
        i = np.full_like(m, LOW)
        opened = add(m[:, :-1] + a[MI, k], d[:, :-1] + a[DI, k])
        i[:, 1:] = add.accumulate(opened + insert - run, axis=1) + run
        if keep:
            tables[:, k] = m, i, d
    score = add(add(m[rows, n] + a[MM, model.size], i[rows, n] + a[IM, model.size]), d[rows, n] + a[DM, model.size])
    return score, tables


def from_counts(emit: np.ndarray, moves: np.ndarray, background: np.ndarray, pseudo: float = 1.0) -> Phmm:
    """A model of weighted counts: emit R x L, moves 9 x (L + 1); pseudo-counts are added."""
    size = emit.shape[1]
    e = np.log((emit + pseudo * background[:, None]) / (emit.sum(axis=0) + pseudo))
    prior = np.array([0.3, 0.6, 0.1, 0.02, 0.96, 0.02, 0.1, 0.6, 0.3])
    a = np.empty((9, size + 1))
    for part in (slice(0, 3), slice(3, 6), slice(6, 9)):
        c = moves[part] + pseudo * 4 * prior[part, None]
        a[part] = np.log(c / c.sum(axis=0))
    # There is no delete state before the first position, and none to move to after the last.
    a[:3, 0] = LOW
    for into, others in ((DD, (DM, DI)), (MD, (MM, MI)), (ID, (IM, II))):
        left = np.logaddexp(a[others[0], size], a[others[1], size])
        a[others[0], size] -= left
        a[others[1], size] -= left
        a[into, size] = LOW
    return Phmm(size, a, e, np.log(prior), np.log(background))


def derive(seqs: list[str], weights: np.ndarray | None = None, letters: str = DNA, rounds: int = 2) -> Phmm:
    """A model of a set of sequences: the one of median length is the first draft, Viterbi training refines it."""
    w = np.ones(len(seqs)) if weights is None else np.asarray(weights, float)
    order = sorted(range(len(seqs)), key=lambda i: (len(seqs[i]), seqs[i]))
    draft = seqs[order[len(order) // 2]]
    codes, _ = encode([draft], letters)
    emit = np.zeros((len(letters), max(1, len(draft))))
    for k, c in enumerate(codes[0][: len(draft)]):
        emit[:, k] = 1 / len(letters)
        if c >= 0:
            emit[:, k] = 0
            emit[c, k] = 4.0
    background = np.full(len(letters), 1 / len(letters))
    return train(from_counts(emit, np.zeros((9, emit.shape[1] + 1)), background), seqs, w, rounds)


def count_paths(model: Phmm, seqs: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted emissions and moves along the best paths."""
    emit, moves = np.zeros_like(model.e), np.zeros_like(model.a)
    for p in parts(model, seqs):
        (codes, n), w = encode(seqs[p], model.letters), weights[p]
        for rows, move, state, k, j in _steps(model, _run(model, seqs[p], np.maximum, keep=True)[1], n):
            np.add.at(moves, (move, k), w[rows])
            at = np.flatnonzero((state == 0) & (k > 0))
            at = at[codes[rows[at], j[at] - 1] >= 0]
            np.add.at(emit, (codes[rows[at], j[at] - 1], k[at] - 1), w[rows[at]])
    return emit, moves


def expected_counts(model: Phmm, seqs: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted emissions and moves expected over all paths (forward and backward sums)."""
    found = [_expected(model, seqs[p], weights[p]) for p in parts(model, seqs)]
    return sum(e for e, _ in found), sum(m for _, m in found)


def _expected(model: Phmm, seqs: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, n = encode(seqs, model.letters)
    batch, width = codes.shape
    match, insert = _emissions(model, codes)
    score, (fm, fi, fd) = _run(model, seqs, np.logaddexp, keep=True)
    a, size, rows = model.a, model.size, np.arange(batch)
    emit, moves = np.zeros_like(model.e), np.zeros_like(a)
    end = np.full((batch, width + 1), LOW)
    end[rows, n] = 0.0
    shift = lambda x: np.hstack((x[:, 1:], np.full((batch, 1), LOW)))
    bm, bd = None, None
    for k in range(size, -1, -1):
        # What follows from a state at (k, j): the next match emits residue j, so it is read one to the right.
        to_match = end if k == size else shift(bm + np.hstack((np.full((batch, 1), LOW), match[k])))
        to_delete = np.full((batch, width + 1), LOW) if k == size else bd
        bi = np.full((batch, width + 1), LOW)
        to_insert = np.full((batch, width + 1), LOW)
        for j in range(width, -1, -1):
            if j < width:
                to_insert[:, j] = bi[:, j + 1] + insert[:, j]
            bi[:, j] = np.logaddexp(np.logaddexp(to_match[:, j] + a[IM, k], to_insert[:, j] + a[II, k]), to_delete[:, j] + a[ID, k])
        for (src, f), (m, i, d) in zip((("M", fm[k]), ("I", fi[k]), ("D", fd[k])), ((MM, MI, MD), (IM, II, ID), (DM, DI, DD))):
            for move, to in ((m, to_match), (i, to_insert), (d, to_delete)):
                moves[move, k] += weights @ np.exp(np.minimum(f + a[move, k] + to - score[:, None], 0)).sum(axis=1)
        new_m = np.logaddexp(np.logaddexp(to_match + a[MM, k], to_insert + a[MI, k]), to_delete + a[MD, k])
        new_d = np.logaddexp(np.logaddexp(to_match + a[DM, k], to_insert + a[DI, k]), to_delete + a[DD, k])
        if k:
            post = np.exp(np.minimum(fm[k] + new_m - score[:, None], 0))[:, 1:] * weights[:, None]
            for c in range(emit.shape[0]):
                emit[c, k - 1] += post[codes == c].sum()
        bm, bd = new_m, new_d
    return emit, moves


def train(model: Phmm, seqs: list[str], weights: np.ndarray | None = None, rounds: int = 10, method: str = "Viterbi") -> Phmm:
    """Viterbi or Baum-Welch training until the total score stops rising, ``rounds`` times at most."""
    w = np.ones(len(seqs)) if weights is None else np.asarray(weights, float)
    counting = {"Viterbi": count_paths, "BaumWelch": expected_counts}[method]
    last = -np.inf
    for _ in range(rounds):
        emit, moves = counting(model, seqs, w)
        model = from_counts(emit, moves, np.exp(model.qe))
        total = float(forward(model, seqs) @ w)
        if total <= last + 1e-6:
            break
        last = total
    return model


def henikoff(seqs: list[str], k: int = 5) -> np.ndarray:
    """Sequence weights with mean 1: each k-mer shares one unit among the sequences that have it."""
    sets = [{s[i : i + k] for i in range(max(1, len(s) - k + 1))} for s in seqs]
    shared: dict[str, int] = {}
    for x in sets:
        for g in x:
            shared[g] = shared.get(g, 0) + 1
    w = np.array([sum(1 / shared[g] for g in x) / len(x) for x in sets])
    return w * len(w) / w.sum() if len(w) else w


def akaike(scores: np.ndarray) -> np.ndarray:
    """exp(score - log sum exp) along the last axis."""
    top = scores.max(axis=-1, keepdims=True)
    x = np.exp(scores - top)
    return x / x.sum(axis=-1, keepdims=True)
