"""Substring dedup by collinear chaining: fuzzy passages that texts share.

1. Seeds are runs of ``SEED`` words whose hash is divisible by ``EVERY``: the choice does not
   depend on the words around, so a changed word costs only the seeds over it.  The n-th
   place of a seed in a text matches the n-th in others (repeated lines).  Each chunk of texts
   sends its distinct seeds once to buckets, which tell those of two or more texts.
2. Of these, seeds with ``FEW`` of them within reach of a chain go on, with their places.  A
   bucket joins the places of a seed: up to ``MEET`` texts all meet each other; of more, every
   text meets two hubs, the first and the last in an order by hash that is the same for all
   seeds.  So a seed of a third of all texts costs a few places per chunk, and no pairs.
   Hubs of crowded seeds may share no more than the seed, so runs of ``RUN`` words, of which every
   ``RUN + WINNOW - 1`` equal words hold one and the same (winnowing), meet hubs of their own:
   all texts with such a run share a passage over it with its first hub, whatever their seeds met.
3. Matches of a text with another become blocks (runs on one diagonal), and blocks chains: in
   order in both texts, each worth its words, less ``GAP`` per word skipped; the best
   predecessor comes from a prefix maximum in a Fenwick tree.
4. Each chain goes with its words to the chunk of the other text.  Chunks that many chains
   ask for are dealt to several tasks.  There the real words are aligned: blocks by place,
   what lies between by longest common subsequence, and both ends extended past changed
   words until ``DROP`` is lost.  A passage counts from ``MIN_WORDS`` words, if at least
   ``IDENTITY`` of it is equal; of a chain that is too unlike as a whole the good parts count.

5. Where no passage of a text covers its crowded seeds, it also meets others by spans, pairs of seeds
   ``SPAN`` words apart: the first ``HOLDERS`` texts with the span, covered or not, and as long as the
   span stays uncovered and there are more, 16 times as many in the next round.  So a place of a text is left out
   only after all holders of each of its spans were met; texts found at a place with others are not all paired.

Words are runs of letters and digits, lower-cased; alignment compares 16 bits of their
hashes.  Null, empty and short texts share nothing.  Null doc_ids are left out; rows that
repeat a doc_id are one text at a time and are not matched with each other.  Repeats within
one text are not reported.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .chunks import ANSWER, bucket_bits, by_bucket, grouped, joined, make_chunks, pack_keys, squeeze, unpack, unpack_keys, unsqueeze
from .scratch import Scratch

SEED, EVERY = 5, 2
FEW = 3
MEET = 4
MIN_WORDS = 40
#: a run is SEED words doubled until it is a passage by itself
RUN, WINNOW = 40, 12
IDENTITY = 0.8
GAP = 0.08
MAX_GAP = 40
#: seeds of one diagonal that are as near as this make one block
JOIN = 12
#: a changed word costs LOSS when ends are extended; they end where DROP more than gained is lost
LOSS, DROP = 1.5, 6.0
REACH = 64
CHUNK_BYTES = 6 << 20
#: texts are on disk twice in each step, as a table and in its shuffle
LEVEL = 12
TASK_BYTES = 24 << 20
#: words that go with chains in one batch
SEND = 8 << 20
#: bits of a text's place within its chunk
PLACE_BITS = 22
#: two seeds this many words apart are a span; its first HOLDERS holders meet in one round
SPAN = (16, 40)
HOLDERS = 16
LEFT = 1 << 30
#: half keys are flagged by as many bits, in parts
FLAG_BITS, PART_BITS = 24, 18


def grams(h: np.ndarray, n: int, have: int = 1) -> np.ndarray:
    """Polynomials over ``n`` successive words, of those over ``have`` words (``n`` is ``have`` doubled, or ``have`` is 1)."""
    if have == 1 and n & (n - 1):
        out = h[: len(h) - n + 1] * _POINT
        for i in range(1, n - 1):
            out = (out + h[i : len(h) - n + 1 + i]) * _POINT
        return out + h[n - 1 :]
    while have < n:
        h, have = h[:-have] * T.U64(pow(int(_POINT), have, 1 << 64)) + h[have:], 2 * have
    return h


_POINT = T.U64(0xD6E8FEB86659FD93)


def seeds_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of the seeds of one text's words."""
    return _seeds(h, np.array([0, len(h)]))[1:]


def _seeds(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and key of each seed, of the words of texts that end at ``ends``."""
    if len(h) < SEED:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h[:0]
    run = T.mix(grams(h, SEED))
    at = np.flatnonzero(run % T.U64(EVERY) == 0)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[at]
    inside = at + SEED <= ends[text + 1]
    at, text = at[inside], text[inside]
    return text, at - ends[text], numbered(run[at], text)


def numbered(key: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
    """Keys told apart by how often they came before in their text, so repeats in a text match repeats in order."""
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))[: len(key)]
    if not len(twice):
        return key
    order = order[twice][np.lexsort((order[twice], ranked[twice]))]  # equal keys in the order of their places
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    if text is not None:
        new[1:] |= text[order[1:]] != text[order[:-1]]
    first = np.flatnonzero(new)
    again = (np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))).astype(np.uint64)
    order, again = order[again > 0], again[again > 0]
    out = key.copy()
    out[order] = T.mix(key[order] + again * T.U64(0x9FB21C651E98DF25))
    return out


def seeds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and the texts' borders in them; text, position and key of each seed."""
    h, s, _ = T.words(data, T.ALNUM)
    ends = np.searchsorted(s, offsets)
    return h, ends, *_seeds(h, ends)


def winnowed(v: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
    """Places of the least of each WINNOW successive values (of all, if there are fewer).

    ``valid`` marks the values of several stretches, which stand WINNOW or more apart.
    """
    if valid is None:
        valid = np.ones(len(v), bool)
    last = T.U64(0xFFFFFFFFFFFFFFFF)
    gap = np.full(WINNOW, last)
    v, valid = np.concatenate((np.where(valid, v, last), gap)), np.concatenate((valid, np.zeros(WINNOW, bool)))
    least = _sliding(np.minimum, v, WINNOW)
    begin = valid & ~np.concatenate(([False], valid[:-1]))
    whole = valid[: len(least)] & (valid[WINNOW - 1 :] | begin[: len(least)] & ~valid[WINNOW - 1 :])
    least = np.where(whole, least, T.U64(0))
    around = np.concatenate((np.zeros(WINNOW - 1, np.uint64), least, np.zeros(WINNOW - 1, np.uint64)))
    return np.flatnonzero((v == _sliding(np.maximum, around, WINNOW)) & valid)


def _sliding(best: np.ufunc, v: np.ndarray, width: int) -> np.ndarray:
    """The least or largest of each ``width`` successive values."""
    n = 1
    while n < width:
        step = min(n, width - n)
        v, n = best(v[:-step], v[step:]), n + step
    return v


def long_runs(h: np.ndarray, ends: np.ndarray, text: np.ndarray, at: np.ndarray, key: np.ndarray, shared: np.ndarray, crowd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and key of the winnowed runs of RUN words, in texts with ``shared`` seeds.

    With ``crowd``, runs are left out that hold a seed, the first of its kind in the text, that is not shared (nobody has
    the run), or FEW seeds that are not crowded (all texts with the run meet by them).
    """
    some = np.zeros(len(ends) - 1, bool)
    some[text[shared if crowd is None else shared & crowd]] = True
    if len(h) < RUN or not some.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base = grams(h, SEED)
    run = T.mix(grams(base, RUN, SEED))
    left = np.repeat(ends[1:], np.diff(ends))[: len(run)] - np.arange(len(run))
    mine = winnowed(run, (left >= RUN) & np.repeat(some, np.diff(ends))[: len(run)])
    owner = np.repeat(np.arange(len(some)), np.diff(ends))[mine]
    name = numbered(run[mine], owner)
    if crowd is not None:
        where = ends[text] + at
        lone, calm = where[~shared & (key == T.mix(base[where]))], where[~crowd]
        inside = [np.searchsorted(x, mine + RUN - SEED, "right") - np.searchsorted(x, mine) for x in (lone, calm)]
        keep = (inside[0] == 0) & (inside[1] < FEW)
        mine, owner, name = mine[keep], owner[keep], name[keep]
    return owner, mine - ends[owner], name


def run_blocks(text: np.ndarray, at: np.ndarray, key: np.ndarray, met: tuple, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, other and blocks (x, y, words) that long runs make, those of one diagonal that touch as one."""
    some = np.isin(key, met[0])
    text, x, key = text[some], at[some], key[some]
    place = np.searchsorted(met[0], key)  # the first hub, whom all texts with the run meet
    other, y = met[1][place], met[2][place].astype(np.int64)
    keep = other != own[text]
    text, x, other, y = text[keep], x[keep], other[keep], y[keep]
    order = np.lexsort((x, y - x, other, text))
    text, x, other, y = text[order], x[order], other[order], y[order]
    first, last = _stretches(_changes(text, other, y - x) | _changes(x, more=RUN))
    return text[first], other[first], np.stack([x[first], y[first], x[last] - x[first] + RUN], axis=1)


def _changes(*columns: np.ndarray, more: int = 0) -> np.ndarray:
    """Which rows differ in a column (by more than ``more``) from the one before."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        out[1:] |= np.diff(c) > more if more else c[1:] != c[:-1]
    return out


def _stretches(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last rows of the stretches that begin at ``new`` rows; the first row begins one."""
    first = np.flatnonzero(np.concatenate(([True], new[1:]))[: len(new)])
    return first, np.append(first[1:], len(new))[: len(first)] - 1


def _distinct(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's distinct seeds, and how many of its texts hold them."""
    key = np.sort(seeds(*unpack(body))[4])
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    return key[first], np.diff(np.append(first, len(key)))  # numbered, so a text holds a key once


REQUEST = "bucket int, chunk bigint, keys binary, payload binary"


def _request(chunk: int, key: np.ndarray, bits: int, payload) -> pa.RecordBatch:
    """Rows of REQUEST for sorted keys; ``payload(a, b)`` goes with keys a to b."""
    cut = list(by_bucket(key, bits))
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _, _ in cut], pa.int32()), pa.array([chunk] * len(cut), pa.int64()), pa.array([pack_keys(key[a:b]) for _, a, b in cut], pa.binary()), pa.array([payload(a, b) for _, a, b in cut], pa.binary())],
        names=["bucket", "chunk", "keys", "payload"],
    )


def _reply(chunks: list, buckets: list, payload: list) -> pa.RecordBatch:
    n = len(chunks)
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(buckets, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.bool_())), pa.array(payload, pa.binary())], names=["chunk", "bucket", "ids", "flags", "payload"])


def _ask(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist()):
            key, n = _distinct(body)
            if len(key):
                yield _request(chunk, key, bits, lambda a, b, n=n: squeeze(np.packbits(n[a:b] > 1).tobytes() + np.packbits(n[a:b] > MEET).tobytes()))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two bits for each key of each chunk: whether two texts hold it, and whether more than MEET may."""
    for group in grouped(batches, "bucket"):
        chunks, keys = group["chunk"].to_pylist(), [unpack_keys(k) for k in group["keys"].to_pylist()]
        most = np.concatenate([_at_most(unsqueeze(p), len(k)) for p, k in zip(group["payload"].to_pylist(), keys)])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        size, n = np.diff(np.append(first, len(key))), np.add.reduceat(most[order], first)
        both, crowd = np.empty(len(key), bool), np.empty(len(key), bool)
        both[order], crowd[order] = np.repeat(n > 1, size), np.repeat(n > MEET, size)
        edge = np.cumsum([0, *(len(k) for k in keys)]).tolist()
        yield _reply(chunks, group["bucket"].to_pylist(), [squeeze(np.int64(b - a).tobytes() + np.packbits(both[a:b]).tobytes() + np.packbits(crowd[a:b]).tobytes()) for a, b in zip(edge, edge[1:])])


def _at_most(raw: bytes, n: int) -> np.ndarray:
    """How many texts of a chunk hold each key, at most: 1, MEET or more."""
    many, crowd = (np.unpackbits(x, count=n).astype(np.int64) for x in np.frombuffer(raw, np.uint8).reshape(2, -1))
    return 1 + many * (MEET - 1) + crowd


def _bits(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk's sorted keys: those of two texts, and those of more than MEET, maybe."""
    out = [np.zeros((2, 0), np.uint8)]
    for blob in payloads:
        raw = unsqueeze(blob)
        out.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=8).reshape(2, -1), axis=1, count=int(np.frombuffer(raw, np.int64, 1)[0])))
    both, crowd = np.concatenate(out, axis=1).astype(bool)
    return both, crowd


def in_reach(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the seeds (by text and position) may be in a chain of ``FEW``: those with as many from FEW - 1 steps before to after."""
    where = text.astype(np.int64) << 32 | at
    near = (FEW - 1) * MAX_GAP
    return np.searchsorted(where, where + near, "right") - np.searchsorted(where, where - near) >= FEW


def _places(rows: Iterator[tuple], bits: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's places of shared seeds: all of a seed in up to MEET texts, else its first and last by hash."""
    for chunk, _, _, data, offsets, payloads in rows:
        h, ends, text, at, key = seeds(data, offsets)
        shared, crowd = _some(key, payloads)
        runs = long_runs(h, ends, text, at, key, shared, crowd)
        text, at, key = (np.concatenate(c) for c in zip(_kept(text, at, key, shared), runs))
        if not len(key):
            continue
        address = (np.int64(chunk) << PLACE_BITS) | text
        order = np.lexsort((T.mix(address.astype(np.uint64)), key))
        key, address, at = key[order], address[order], at[order]
        few, start, end = _ranks(key)
        keep = few | (start == np.arange(len(key))) | (end == np.arange(len(key)) + 1)
        large = ~few[keep]
        key, place = key[keep], np.stack([address[keep] & ((1 << PLACE_BITS) - 1), at[keep]]).astype(np.uint32)
        yield _request(chunk, key, bits, lambda a, b, place=place, large=large: squeeze(np.ascontiguousarray(place[:, a:b]).tobytes() + np.packbits(large[a:b]).tobytes()))


def _some(key: np.ndarray, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which seeds are shared, and which may be in more than MEET texts."""
    order = np.argsort(key)
    ranked = key[order]
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(np.concatenate(([False], ranked[1:] != ranked[:-1]))[: len(key)])
    both, crowd = _bits(payloads)
    return both[at], crowd[at]


def _kept(text: np.ndarray, at: np.ndarray, key: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the shared seeds those that may be in a chain."""
    text, at, key = text[some], at[some], key[some]
    some = in_reach(text, at)
    return text[some], at[some], key[some]


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: whether there are at most MEET of a kind, where the kind starts and ends."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    return np.repeat(size <= MEET, size), np.repeat(first, size), np.repeat(first + size, size)


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk's seeds the places they meet: key, address and position of all holders, or of two hubs."""
    for group in grouped(batches, "bucket"):
        chunks, keys, places, large = group["chunk"].to_pylist(), [], [], []
        for chunk, k, p in zip(chunks, group["keys"].to_pylist(), group["payload"].to_pylist()):
            k, raw = unpack_keys(k), unsqueeze(p)
            place = np.frombuffer(raw, np.uint32, 2 * len(k)).reshape(2, -1).astype(np.int64)
            keys.append(k)
            places.append(np.stack([(np.int64(chunk) << PLACE_BITS) | place[0], place[1]]))
            large.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 * len(k)), count=len(k)))
        key, place, large = np.concatenate(keys), np.concatenate(places, axis=1), np.concatenate(large).astype(bool)
        order = np.lexsort((T.mix(place[0].astype(np.uint64)), key))
        ranked, place, large = key[order], place[:, order], large[order]
        few, start, end = _ranks(ranked)
        crowd = np.zeros(len(ranked), bool)
        first = np.flatnonzero(start == np.arange(len(ranked)))
        crowd[first] = np.add.reduceat(large.astype(np.int64), first) > 0
        few &= ~crowd[start]
        hub = few | (start == np.arange(len(ranked))) | (end == np.arange(len(ranked)) + 1)
        hub &= (end - start > 1)  # a seed that nobody else kept
        hubs, places, many = ranked[hub], place[:, hub], ~few[hub]
        payload = []
        for k in keys:
            lo, hi = np.searchsorted(hubs, np.unique(k)), np.searchsorted(hubs, np.unique(k), "right")
            at = np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))
            payload.append(squeeze(np.int64(len(at)).tobytes() + hubs[at].tobytes() + places[0, at].tobytes() + places[1, at].astype(np.int32).tobytes() + np.packbits(many[at]).tobytes()))
        yield _reply(chunks, group["bucket"].to_pylist(), payload)


def _met(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, addresses and positions that a chunk was sent, and which are hubs only."""
    key, address, at, many = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
    for blob in payloads:
        raw = unsqueeze(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        key.append(np.frombuffer(raw, np.uint64, n, 8))
        address.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
        at.append(np.frombuffer(raw, np.int32, n, 8 + 16 * n))
        many.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 + 20 * n), count=n).astype(bool))
    key, address, at, many = (np.concatenate(x) for x in (key, address, at, many))
    order = np.argsort(key, kind="stable")
    return key[order], address[order], at[order], many[order]


def matches(text: np.ndarray, at: np.ndarray, key: np.ndarray, met: tuple, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, other, x, y) of seeds with the places they meet, without pairs that have no FEW of them together; ordered by text, other, x."""
    lo, hi = np.searchsorted(met[0], key), np.searchsorted(met[0], key, "right")
    n = hi - lo
    place = np.repeat(hi - np.cumsum(n), n) + np.arange(int(n.sum()))
    text, x, other, y = np.repeat(text, n), np.repeat(at, n), met[1][place], met[2][place].astype(np.int64)
    keep = other != own[text]
    text, x, other, y = text[keep], x[keep], other[keep], y[keep]
    if not len(text):
        return text, other, x, y
    _, pair = np.unique(np.stack([text, other]), axis=1, return_inverse=True) if len(text) < 1000 else (None, _pairs(text, other))
    together = np.zeros(len(text), bool)
    wide, drift = (FEW - 1) * MAX_GAP, 64
    for a in (0, wide // 2):
        for b in (0, drift // 2):
            cell = T.chain(pair.astype(np.uint64), ((x + a) // wide).astype(np.uint64), ((y - x + b + (1 << 32)) // drift).astype(np.uint64))
            _, which, count = np.unique(cell, return_inverse=True, return_counts=True)
            together |= count[which] >= FEW
    good = np.zeros(int(pair.max()) + 1, bool)
    good[pair[together]] = True
    keep = good[pair]
    text, x, other, y, pair = text[keep], x[keep], other[keep], y[keep], pair[keep]
    order = np.lexsort((y, x, pair))
    return text[order], other[order], x[order], y[order]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct (a, b)."""
    b = np.unique(b, return_inverse=True)[1]
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


def blocks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Runs of matches on one diagonal, at most JOIN apart: rows (x, y, words), by x."""
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    new = np.concatenate(([True], (np.diff(y - x) != 0) | (np.diff(x) > JOIN + SEED)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    out = np.stack([x[first], y[first], x[last] - x[first] + SEED], axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def chain(found: list[tuple[int, int, int]]) -> list[list[int]]:
    """Chains of blocks (x, y, words), each after the one before in both texts, best first and disjoint; indexes into the list.

    A block may begin within the last words of its predecessor (a seed less one); these count once.
    """
    n, slack = len(found), SEED - 1
    by_end = sorted(range(n), key=lambda i: found[i][0] + found[i][2])
    ranks = {v: k + 1 for k, v in enumerate(sorted({y + m for _, y, m in found}))}
    edges = sorted(ranks)
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(ranks) + 1)
    score, before, nxt = [0.0] * n, [-1] * n, 0
    from bisect import bisect_right

    for i in sorted(range(n), key=lambda i: (found[i][0], found[i][1])):
        x, y, m = found[i]
        while nxt < n and found[by_end[nxt]][0] + found[by_end[nxt]][2] <= x + slack:
            j = by_end[nxt]
            nxt += 1
            if not score[j]:
                continue
            end_x, end_y = found[j][0] + found[j][2], found[j][1] + found[j][2]
            entry, k = (score[j] + GAP * (end_x + end_y), j), ranks[end_y]
            while k < len(tree):
                if entry > tree[k]:
                    tree[k] = entry
                k += k & -k
        k, best = bisect_right(edges, y + slack), (0.0, -1)
        while k:
            if tree[k] > best:
                best = tree[k]
            k &= k - 1
        score[i] = float(m)
        j = best[1]
        if j >= 0 and found[j][0] < x and found[j][1] < y:
            twice = max(0, found[j][0] + found[j][2] - x, found[j][1] + found[j][2] - y)
            gain = best[0] - GAP * (x + y) - twice
            if gain > 0 and m > twice:
                score[i], before[i] = gain + m, j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            out.append(path[::-1])
    return out


def chains(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """The blocks of each chain of one pair's matches, cut where more than MAX_GAP is skipped, that may hold a passage."""
    return _chains_of(blocks(x, y))


def _chains_of(found: np.ndarray) -> Iterator[np.ndarray]:
    """The chains of one pair's blocks."""
    for path in chain([tuple(b) for b in found.tolist()]):
        mine = found[path]
        ends = mine[:-1, :2] + mine[:-1, 2:]
        for part in np.split(mine, np.flatnonzero((mine[1:, :2] - ends > MAX_GAP).any(axis=1)) + 1):
            if int((part[:, 2] - SEED).sum()) // EVERY + 2 * len(part) >= FEW:
                yield part


def all_chains(text: np.ndarray, other: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """The chains of all pairs: text, other and number of blocks of each, and the blocks of all, one after the other.

    Most pairs have one block, which is a chain by itself; pair by pair go only the others.
    """
    order = np.lexsort((x, y - x, other, text))
    text, other, x, y = text[order], other[order], x[order], y[order]
    first, last = _stretches(_changes(text, other, y - x) | _changes(x, more=JOIN + SEED))
    text, other, block = text[first], other[first], np.stack([x[first], y[first], x[last] - x[first] + SEED], axis=1)
    order = np.lexsort((block[:, 1], block[:, 0], other, text))
    text, other, block = text[order], other[order], block[order]
    first, last = _stretches(_changes(text, other))
    lone = first[(first == last) & ((block[first, 2] - SEED) // EVERY + 2 >= FEW)]
    pair, size, out = [lone], [np.ones(len(lone), np.int64)], [block[lone]]
    for a, b in zip(first[first < last].tolist(), last[first < last].tolist()):
        paths = list(_chains_of(block[a : b + 1]))
        pair.append(np.full(len(paths), a))
        size.append(np.array([len(p) for p in paths], np.int64))
        out += paths
    pair = np.concatenate(pair)
    return text[pair], other[pair], np.concatenate(size), np.concatenate(out)


def equal_words(a: list[int], b: list[int]) -> int:
    """Words that the best alignment of two short runs makes equal."""
    if len(a) == len(b):
        same = sum(p == q for p, q in zip(a, b))
        if 2 * same >= len(a):
            return same
    row = [0] * (len(b) + 1)
    for p in a:
        diagonal = 0
        for k, q in enumerate(b, 1):
            diagonal, row[k] = row[k], diagonal + 1 if p == q else max(row[k], row[k - 1])
    return row[-1]


def good_runs(worth: list[float]) -> list[tuple[int, int]]:
    """Runs [i, j) of pieces to report: all of them if their worth is not negative together, else the best run, and so on beside it."""
    out, todo = [], [(0, len(worth))]
    while todo:
        lo, hi = todo.pop()
        if lo >= hi:
            continue
        if sum(worth[lo:hi]) >= 0:
            out.append((lo, hi))
            continue
        best, run, total, start = 0.0, None, 0.0, lo
        for k in range(lo, hi):
            total += worth[k]
            if total > best:
                best, run = total, (start, k + 1)
            if total < 0:
                total, start = 0.0, k + 1
        if run:
            out.append(run)
            todo += [(lo, run[0]), (run[1], hi)]
    return out


def extend(a: np.ndarray, b: np.ndarray) -> int:
    """How many words of both to add at an end: up to the best total, given up where DROP more is lost."""
    n = min(len(a), len(b))
    if not n:
        return 0
    total = np.cumsum(np.where(a[:n] == b[:n], 1.0, -LOSS))
    stop = np.flatnonzero(np.maximum(np.maximum.accumulate(total), 0) - total > DROP)
    total = total[: stop[0]] if len(stop) else total
    return int(total.argmax()) + 1 if len(total) and total.max() > 0 else 0


def align(mine: np.ndarray, theirs: np.ndarray, path: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Aligned passages of one chain: (start, end, other start, other end, equal words)."""
    pieces = []  # (x, end, y, other end, equal)
    px, py = int(path[0, 0]), int(path[0, 1])
    for x, y, n in path.tolist():
        cut = max(0, px - x, py - y) if pieces else 0
        x, y, n = x + cut, y + cut, n - cut
        if n <= 0:
            continue
        if pieces and (x > px or y > py):
            pieces.append((px, x, py, y, equal_words(mine[px:x].tolist(), theirs[py:y].tolist())))
        pieces.append((x, x + n, y, y + n, int((mine[x : x + n] == theirs[y : y + n]).sum())))
        px, py = x + n, y + n
    penalty = IDENTITY / (1 - IDENTITY)
    worth = [s - penalty * (max(e - x, f - y) - s) for x, e, y, f, s in pieces]
    out = []
    for i, j in good_runs(worth):
        x, y, e, f, same = pieces[i][0], pieces[i][2], pieces[j - 1][1], pieces[j - 1][3], sum(p[4] for p in pieces[i:j])
        left, right = extend(mine[:x][::-1], theirs[:y][::-1]), extend(mine[e:], theirs[f:])
        same += int((mine[x - left : x] == theirs[y - left : y]).sum() + (mine[e : e + right] == theirs[f : f + right]).sum())
        out.append((x - left, e + right, y - left, f + right, same))
        if same < IDENTITY * max(e + right - x + left, f + right - y + left) <= same + left + right:
            out.append((x, e, y, f, sum(p[4] for p in pieces[i:j])))
    return out


def align_blocks(mine: np.ndarray, theirs: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """As :func:`align`, for many chains of one block: (chain, words added before, after, equal words) of each passage.

    Both texts have at least ``before`` and ``after`` words around a block, which is extended by no more.
    """
    equal = mine[_ranges(x, x + n)] == theirs[_ranges(y, y + n)]
    same = np.add.reduceat(equal, np.cumsum(n) - n, dtype=np.int64) if len(n) else n
    which = np.flatnonzero(same - IDENTITY / (1 - IDENTITY) * (n - same) >= 0)
    x, y, n, before, after, same = (c[which] for c in (x, y, n, before, after, same))
    left, more = _extended(mine, theirs, x - 1, y - 1, -1, before)
    right, most = _extended(mine, theirs, x + n, y + n, 1, after)
    whole, added = same + more + most, left + right
    again = np.flatnonzero((whole < IDENTITY * (n + added)) & (IDENTITY * (n + added) <= whole + added))
    none = np.zeros(len(again), np.int64)
    return np.append(which, which[again]), np.append(left, none), np.append(right, none), np.append(whole, same[again])


def _extended(mine: np.ndarray, theirs: np.ndarray, x: np.ndarray, y: np.ndarray, step: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`extend`, for many places at once, up to ``room`` words: how many words to add, and how many of them are equal."""
    steps = np.arange(int(room.max(initial=0)))
    if not len(steps):
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    inside, far = steps < room[:, None], step * steps
    total = np.where(mine[np.where(inside, x[:, None] + far, 0)] == theirs[np.where(inside, y[:, None] + far, 0)], 1.0, -LOSS).cumsum(axis=1)
    lost = np.maximum(np.maximum.accumulate(total, axis=1), 0) - total > DROP
    total[np.logical_or.accumulate(lost, axis=1) | ~inside] = 0
    best = total.argmax(axis=1)
    gain = total[np.arange(len(x)), best]
    words = np.where(gain > 0, best + 1, 0)
    return words, np.where(gain > 0, np.rint((gain + LOSS * words) / (1 + LOSS)), 0).astype(np.int64)


CANDIDATE = "doc_id bigint, own bigint, other bigint, first int, blocks binary, words binary"


def _rows(out: list) -> pa.RecordBatch:
    """Rows of CANDIDATE."""
    return pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in CANDIDATE.split(", ")])


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of the bytes of ``data`` that end at ``ends``."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8).reshape(-1))])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values, one after the other, and where each starts and ends."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy(), at - at[0]


def _chain_rows(ids: list, own: np.ndarray, words: np.ndarray, ends: np.ndarray, text: np.ndarray, other: np.ndarray, size: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Chains with the 16-bit words around them, of texts whose words end at ``ends``; about SEND bytes in a batch."""
    edge = np.concatenate(([0], np.cumsum(size)))
    first = np.maximum(0, block[edge[:-1], 0] - REACH)
    lo = ends[text] + first
    hi = np.minimum(ends[text] + block[edge[1:] - 1, 0] + block[edge[1:] - 1, 2] + REACH, ends[text + 1])
    ids = np.array(ids, np.int64)
    for a, b in T.slices(np.concatenate(([0], np.cumsum(2 * (hi - lo)))), SEND):
        mine = block[edge[a] : edge[b]].astype(np.int32)
        yield _rows([
            pa.array(ids[text[a:b]]), pa.array(own[text[a:b]]), pa.array(other[a:b]), pa.array(first[a:b].astype(np.int32)),
            _binary(mine, 12 * (edge[a + 1 : b + 1] - edge[a])), _binary(words[_ranges(lo[a:b], hi[a:b])], 2 * np.cumsum(hi[a:b] - lo[a:b])),
        ])


def _unseen(run: tuple, text: np.ndarray, other: np.ndarray, size: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Which blocks of long runs (text, other, block) no chain has half of in a block on its diagonal; from such a half the rest is found."""
    n = len(run[0])
    pair = _pairs(np.concatenate((run[0], np.repeat(text, size))), np.concatenate((run[1], np.repeat(other, size))))
    order = np.argsort(pair[n:], kind="stable")
    ranked = pair[n:][order]
    lo, hi = np.searchsorted(ranked, pair[:n]), np.searchsorted(ranked, pair[:n], "right")
    (p, q, m), (x, y, k), which = run[2][np.repeat(np.arange(n), hi - lo)].T, block[order[_ranges(lo, hi)]].T, np.repeat(np.arange(n), hi - lo)
    seen = np.zeros(n, bool)
    seen[which[(y - x == q - p) & (np.minimum(x + k, p + m) - np.maximum(x, p) >= m // 2)]] = True
    return ~seen


def _candidates(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Each chunk's chains: the text's id and address, the other text, and the blocks and words from ``first`` on; and its marks, without blocks."""
    for chunk, ids, _, data, offsets, payloads in rows:
        met = _met(payloads)
        if not len(met[0]):
            continue
        h, ends, text, at, key = seeds(data, offsets)
        some = np.isin(key, met[0])
        own = (np.int64(chunk) << PLACE_BITS) | np.arange(len(ids))
        whole = run_blocks(*long_runs(h, ends, text, at, key, some), met, own)
        text, at, key = text[some], at[some], key[some]
        marks = pack_marks(text, at, key, met)
        found = all_chains(*matches(text, at, key, met, own))
        if len(whole[0]):
            more = _unseen(whole, *found)
            found = tuple(np.concatenate(c) for c in zip(found, (whole[0][more], whole[1][more], np.ones(int(more.sum()), np.int64), whole[2][more])))
        if len(found[0]):
            yield from _chain_rows(ids, own, (h & T.U64(0xFFFF)).astype(np.uint16), ends, *found)
        if marks is not None:
            yield _rows([[None], [int(own[0])], [None], [None], [None], [marks]])


def pack_marks(text: np.ndarray, at: np.ndarray, key: np.ndarray, met: tuple) -> bytes | None:
    """Text, position and half of the key of the crowded seeds and of the others that a span may join with one, and which are crowded."""
    crowd, where = met[3][np.searchsorted(met[0], key)], text.astype(np.int64) << 32 | at
    hot = where[crowd]
    near = np.searchsorted(hot, where + SPAN[1], "right") > np.searchsorted(hot, where - SPAN[1])
    return _pack(text[near], at[near], key[near] >> T.U64(32), crowd[near]) if len(hot) else None


def _pack(*columns: np.ndarray) -> bytes:
    planes = [np.ascontiguousarray(c.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]
    return squeeze(np.int64(len(columns[0])).tobytes() + b"".join(planes))


def unpack_marks(blob: bytes) -> tuple[np.ndarray, ...]:
    """What was packed: text, position, half key, whether it is crowded, and open if that is known."""
    raw = unsqueeze(blob)
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, 4, int(np.frombuffer(raw, np.int64, 1)[0]))
    return tuple(np.ascontiguousarray(p.T).view(np.uint32)[:, 0] for p in planes)


MARKED = "chunk bigint, payload binary"


def _marked(chunks: list, payload: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(payload, pa.binary())], names=["chunk", "payload"])


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of each chunk, with 1 for the seeds that no passage of their text covers."""
    for group in grouped(batches, "chunk"):
        payload, *_ = group["payload"].to_pylist()  # marks come first
        if payload is not None:
            text, at, key, crowd = unpack_marks(payload)
            chunk = group["chunk"][0].as_py()
            yield _marked([chunk], [_pack(text, at, key, crowd, _open(group, chunk, text, at, at.astype(np.int64) + SEED))])


def _open(group: pa.Table, chunk: int, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words, ``start`` to ``end`` of a text of the chunk, lie within no passage of that text among the rows."""
    group = group.filter(group["own"].is_valid())
    own, a, b = (group[c].to_numpy() for c in ("own", "start_word", "end_word"))
    # Of passages by start the furthest end so far, text by text, tells whether one covers a place.
    own = own - (np.int64(chunk) << PLACE_BITS)
    order = np.lexsort((a, own))
    begin, far = (own << 32 | a)[order], np.maximum.accumulate((own << 32 | b)[order])
    last = np.searchsorted(begin, text.astype(np.int64) << 32 | start, "right") - 1
    return (last < 0) | (np.append(far, 0)[last] < (text.astype(np.int64) << 32 | end))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from each ``lo`` up to its ``hi``, one range after the other."""
    n = hi - lo
    return np.repeat(hi - np.cumsum(n), n) + np.arange(int(n.sum()))


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of 2 ** ``FLAG_BITS`` values the uncovered seeds have, in parts."""
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            _, _, key, crowd, alone = unpack_marks(payload)
            flag = np.unique(key[(crowd & alone) > 0] & np.uint32((1 << FLAG_BITS) - 1))
            part = flag >> np.uint32(PART_BITS)
            edge = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
            if len(flag):
                yield _marked(part[edge].tolist(), [squeeze(x.tobytes()) for x in np.split(flag & np.uint32((1 << PART_BITS) - 1), edge[1:])])


def _all_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of each part."""
    for group in grouped(batches, "chunk"):
        bits = np.zeros(1 << PART_BITS, bool)
        for blob in group["payload"].to_pylist():
            bits[np.frombuffer(unsqueeze(blob), np.uint32)] = True
        yield _marked([group["chunk"][0].as_py()], [squeeze(np.packbits(bits).tobytes())])


def _spans(batches: Iterator[pa.RecordBatch], bits: int, flags: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    """Each chunk's spans: two seeds of a text, SPAN words apart, of which one is crowded and uncovered in some text."""
    flag = np.zeros((1 << FLAG_BITS - PART_BITS, 1 << PART_BITS), bool)
    for part, blob in flags.items():
        flag[part] = np.unpackbits(np.frombuffer(unsqueeze(blob), np.uint8)).astype(bool)
    flag = flag.reshape(-1)
    for batch in batches:
        for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist()):
            text, at, key, crowd, alone = unpack_marks(payload)
            at, alone, calm = at.astype(np.int64), alone > 0, crowd == 0
            wanted, where = calm | flag[key & np.uint32((1 << FLAG_BITS) - 1)], text.astype(np.int64) << 32 | at
            wanted = np.flatnonzero(wanted)
            where = where[wanted]
            lo, hi = np.searchsorted(where, where + SPAN[0]), np.searchsorted(where, where + SPAN[1], "right")
            i, j = wanted[np.repeat(np.arange(len(where)), hi - lo)], wanted[_ranges(lo, hi)]
            some = ~(calm[i] & calm[j])
            i, j = i[some], j[some]
            far = (at[j] - at[i]).astype(np.uint64)
            yield from _ask_spans(chunk, T.mix((key[i].astype(np.uint64) << T.U64(32) | key[j]) + far * _POINT), text[i], at[i], far, alone[i] & alone[j], bits)


def _ask_spans(chunk: int, name: np.ndarray, text: np.ndarray, at: np.ndarray, far: np.ndarray, open_: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of REQUEST for spans: their places, widths, and whether they are open."""
    if len(name):
        order = np.argsort(name)
        place, far, open_ = np.stack([text, at]).astype(np.uint32)[:, order], far[order].astype(np.uint8), open_[order]
        yield _request(chunk, name[order], bits, lambda a, b: squeeze(np.ascontiguousarray(place[:, a:b]).tobytes() + far[a:b].tobytes() + np.packbits(open_[a:b]).tobytes()))


def _left(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Requests for the spans of too many holders: open are those that still no passage of their text covers."""
    for group in grouped(batches, "chunk"):
        chunk, rest = group["chunk"][0].as_py(), [p for p in group["payload"].to_pylist() if p is not None]
        if rest:
            text, at, far, was, name = np.concatenate([np.frombuffer(unsqueeze(p), np.int64).reshape(5, -1) for p in rest], axis=1)
            still = (was > 0) & _open(group, chunk, text, at, at + SEED) & _open(group, chunk, text, at + far, at + far + SEED)
            yield from _ask_spans(chunk, name.view(np.uint64), text, at, far, still, bits)


def _meet(batches: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
    """For each chunk's open spans the holders ``lo`` to ``hi`` of the same span; as buckets from LEFT on the holders of open spans with more."""
    for group in grouped(batches, "bucket"):
        chunks, bucket, parts = group["chunk"].to_pylist(), group["bucket"][0].as_py(), []
        for k, (chunk, name, p) in enumerate(zip(chunks, group["keys"].to_pylist(), group["payload"].to_pylist())):
            name, raw = unpack_keys(name), unsqueeze(p)
            n = len(name)
            place = np.frombuffer(raw, np.uint32, 2 * n).reshape(2, -1).astype(np.int64)
            parts.append((name, np.full(n, k), (np.int64(chunk) << PLACE_BITS) | place[0], place[1], np.frombuffer(raw, np.uint8, n, 8 * n), np.unpackbits(np.frombuffer(raw, np.uint8, offset=9 * n), count=n).astype(bool)))
        name, source, address, at, far, open_ = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((T.mix(address.astype(np.uint64)), name))
        name, source, address, at, far, open_ = (c[order] for c in (name, source, address, at, far, open_))
        first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        size = np.diff(np.append(first, len(name)))
        start, size = np.repeat(first, size), np.repeat(size, size)
        asks = np.flatnonzero(open_ & (size > max(lo, 1)))
        ends = start[asks] + np.minimum(size[asks], hi)
        mine, theirs = np.repeat(asks, ends - start[asks] - lo), _ranges(start[asks] + lo, ends)
        keep = address[mine] != address[theirs]
        mine, theirs = mine[keep], theirs[keep]
        place = address & ((1 << PLACE_BITS) - 1)
        many = np.flatnonzero((size > hi) & np.repeat(np.add.reduceat(open_.astype(np.int64), first) > 0, size[first]))
        for number, who, made in (
            (bucket, mine, lambda m, t: [place[m], at[m], far[m], address[t], at[t]]),
            (bucket + LEFT, many, lambda m, t: [place[m], at[m], far[m], open_[m], name[m].view(np.int64)]),
        ):
            by = np.argsort(source[who], kind="stable")
            edge = np.searchsorted(source[who][by], np.arange(len(chunks) + 1)).tolist()
            out = [(c, by[a:b]) for c, a, b in zip(chunks, edge, edge[1:]) if a < b]
            yield _reply([c for c, _ in out], [number] * len(out), [squeeze(np.stack([np.asarray(x, np.int64) for x in made(who[b], theirs[b] if who is mine else None)]).tobytes()) for _, b in out])


def _span_candidates(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Chains of the texts that spans bring together."""
    for chunk, ids, _, data, offsets, payloads in rows:
        if not payloads:
            continue
        text, x, far, other, y = np.concatenate([np.frombuffer(unsqueeze(p), np.int64).reshape(5, -1) for p in payloads], axis=1)
        found = all_chains(*(np.concatenate(c) for c in ((text, text), (other, other), (x, x + far), (y, y + far))))
        if len(found[0]):
            need, which = np.unique(found[0], return_inverse=True)
            own = (np.int64(chunk) << PLACE_BITS) | need
            yield from _chain_rows(np.array(ids, np.int64)[need], own, *_small_words(data, offsets, need), which, *found[1:])


def _small_words(data: np.ndarray, offsets: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit words of the texts ``need``, and where each text's start and end."""
    if not len(need):
        return np.zeros(0, np.uint16), np.zeros(1, np.int64)
    parts = [data[a:b] for a, b in zip(offsets[need].tolist(), offsets[need + 1].tolist())]
    h, s, _ = T.words(np.concatenate(parts), T.ALNUM)
    return (h & T.U64(0xFFFF)).astype(np.uint16), np.searchsorted(s, np.cumsum([0, *(len(p) for p in parts)]))


RESULT = "doc_id bigint, start_word bigint, end_word bigint, other_id bigint, other_start bigint, other_end bigint, equal_words bigint, identity double"


#: addresses of both texts go with a passage until all are found
PLACED = RESULT + ", own bigint, other bigint"


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of the chains that meet one chunk: rows of a cell, of which that without blocks has the chunk's texts."""
    kinds = [pa.int64()] * 7 + [pa.float64()] + [pa.int64()] * 2
    held, ids, data, offsets = None, None, None, None
    for batch in batches:
        heads = np.flatnonzero(batch.column("blocks").is_null().to_numpy(zero_copy_only=False)).tolist()
        for a, b in zip([-1, *heads], [*heads, batch.num_rows]):
            if a >= 0:
                head = batch.slice(a, 1).to_pylist()[0]
                held, ids = head["cell"], np.array(head["ids"], np.int64)
                data, offsets = unpack(head["words"])
            if a + 1 < b:
                asks = batch.slice(a + 1, b - a - 1)
                assert held == asks.column("cell")[0].as_py() == asks.column("cell")[len(asks) - 1].as_py()
                out = _passages_of(asks, ids, data, offsets)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in PLACED.split(", ")])


def _passages_of(asks: pa.RecordBatch, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """The passages of chains that meet texts of one chunk, as PLACED says."""
    doc_id, own, other, first = (asks.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "own", "other", "first"))
    (block, at), (mine, edge) = _bytes(asks.column("blocks")), _bytes(asks.column("words"))
    block, at, mine, edge = block.view(np.int32).reshape(-1, 3).astype(np.int64), at // 12, mine.view(np.uint16), edge // 2
    text = other & ((1 << PLACE_BITS) - 1)
    use = ids[text] != doc_id
    need, which = np.unique(text[use], return_inverse=True)
    theirs, ends = _small_words(data, offsets, need)
    begin, end = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    begin[use], end[use] = ends[which], ends[which + 1]

    k = np.flatnonzero(use & (np.diff(at) == 1))
    x, y, n = block[at[k]].T
    before = np.minimum(x - first[k], np.minimum(y, REACH))
    after = np.minimum(edge[k + 1] - edge[k] - (x - first[k] + n), np.minimum(end[k] - begin[k], y + n + REACH) - y - n)
    c, left, right, same = align_blocks(mine, theirs, edge[k] + x - first[k], begin[k] + y, n, before, after)
    k, s, e, hs, he = k[c], x[c] - left, x[c] + n[c] + right, y[c] - left, y[c] + n[c] + right
    identity = same / (e - s)
    keep = (e - s >= MIN_WORDS) & (identity >= IDENTITY)
    out = set(zip(*(v[keep].tolist() for v in (doc_id[k], s, e, ids[text[k]], hs, he, same, identity, own[k], other[k]))))
    for i in np.flatnonzero(use & (np.diff(at) > 1)).tolist():
        path, here = block[at[i] : at[i + 1]], int(first[i])
        start = max(0, int(path[0, 1]) - REACH)
        their = theirs[begin[i] : end[i]][start : int(path[-1, 1] + path[-1, 2]) + REACH]
        for s, e, hs, he, same in align(mine[edge[i] : edge[i + 1]], their, path - [here, start, 0]):
            identity = same / max(e - s, he - hs)
            if min(e - s, he - hs) >= MIN_WORDS and identity >= IDENTITY:
                out.add((int(doc_id[i]), s + here, e + here, int(ids[text[i]]), hs + start, he + start, same, identity, int(own[i]), int(other[i])))
    return sorted(out)


def shared_passages(docs: DataFrame) -> DataFrame:
    """One row per passage a text shares with a text it meets; see RESULT."""
    scratch = Scratch(docs.sparkSession, "substring_dedup")
    chunks = make_chunks(docs.where("doc_id IS NOT NULL"), scratch, most=CHUNK_BYTES, level=LEVEL)
    bits = bucket_bits(chunks, 0.08)
    bodies = chunks.select("chunk", F.lit(-1).alias("bucket"), "ids", "flags", F.col("body").alias("payload"))
    asked = chunks.select("chunk", "body").mapInArrow(lambda b: _ask(b, bits), REQUEST)
    shared = scratch.write(asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_shared, ANSWER), "shared", compression="none")
    scratch.release()
    placed = joined(bodies.unionByName(shared), lambda rows: _places(rows, bits), REQUEST)
    met = scratch.write(placed.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_hubs, ANSWER), "met", compression="none")
    scratch.drop("shared")
    scratch.release()
    found = scratch.write(joined(bodies.unionByName(met), _candidates, CANDIDATE), "candidates")
    scratch.drop("met")
    scratch.release()
    passages = _passages(found.where("blocks IS NOT NULL"), chunks, scratch, "passages")
    scratch.release()
    every = [passages, *_of_spans(found.where("blocks IS NULL"), passages, chunks, bodies, bits, scratch)]
    scratch.drop("chunks")
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return (out.distinct() if len(every) > 1 else out).select(*[c.split()[0] for c in RESULT.split(", ")])


def _passages(found: DataFrame, chunks: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The passages (PLACED) of chains (CANDIDATE)."""
    # Chunks that much is asked of are several cells, each with the chunk's texts.
    chunk, null = F.shiftrightunsigned("other", PLACE_BITS), F.lit(None)
    sizes = scratch.write(found.groupBy(chunk.alias("at")).agg(F.ceil(F.sum(F.octet_length("words") + F.octet_length("blocks") + 64) / TASK_BYTES).alias("parts")), f"{name}_sizes")
    scratch.release()
    texts = chunks.join(sizes, chunks["chunk"] == sizes["at"]).select("chunk", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), "ids", *(null.cast("bigint").alias(c) for c in ("doc_id", "own", "other")), F.lit(0).alias("first"), null.cast("binary").alias("blocks"), F.col("body").alias("words"))
    asks = found.join(sizes, chunk == sizes["at"]).select(F.col("at").alias("chunk"), F.pmod(F.xxhash64("doc_id", "first", "other"), F.col("parts")).cast("int").alias("part"), null.cast("array<bigint>").alias("ids"), "doc_id", "own", "other", "first", "blocks", "words")
    rows = texts.unionByName(asks).withColumn("cell", F.xxhash64("chunk", "part"))
    dealt = rows.repartition("cell").sortWithinPartitions("cell", F.col("blocks").isNotNull(), "other")
    return scratch.write(dealt.mapInArrow(_aligned, PLACED), name)


def _of_spans(marks: DataFrame, passages: DataFrame, chunks: DataFrame, bodies: DataFrame, bits: int, scratch: Scratch) -> Iterator[DataFrame]:
    """The passages (PLACED) of texts that share a span of which no passage of theirs covers the seeds yet."""
    chunk, null = F.shiftrightunsigned("own", PLACE_BITS).alias("chunk"), F.lit(None)

    def with_covers(rows: DataFrame, found: list[DataFrame]) -> DataFrame:
        """Rows (chunk, payload) before the passages of the chunk's texts."""
        rows = rows.select("chunk", *(null.cast("bigint").alias(c) for c in ("own", "start_word", "end_word")), "payload")
        for df in found:
            rows = rows.unionByName(df.select(chunk, "own", "start_word", "end_word", null.cast("binary").alias("payload")))
        return rows.repartition("chunk").sortWithinPartitions("chunk", F.col("payload").isNull())

    marked = scratch.write(with_covers(marks.select(chunk, F.col("words").alias("payload")), [passages]).mapInArrow(_uncovered, MARKED), "marked", compression="none")
    scratch.drop("candidates")
    scratch.release()
    parts = marked.mapInArrow(_bits_of, MARKED).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_all_bits, MARKED).collect()  # at most 2 ** FLAG_BITS bits
    flags = {r["chunk"]: bytes(r["payload"]) for r in parts}
    if not flags:
        return
    asked, found, lo, hi = marked.mapInArrow(lambda b: _spans(b, bits, flags), REQUEST), [passages], 0, HOLDERS
    while True:
        met = scratch.write(asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(lambda b, lo=lo, hi=hi: _meet(b, lo, hi), ANSWER), f"holders{lo}", compression="none")
        scratch.release()
        met, left = met.where(F.col("bucket") < LEFT), met.where(F.col("bucket") >= LEFT).select("chunk", "payload")
        made = scratch.write(joined(bodies.unionByName(met), _span_candidates, CANDIDATE), f"candidates{lo}")
        scratch.release()
        found.append(_passages(made, chunks, scratch, f"passages{lo}"))
        scratch.drop(f"candidates{lo}")
        scratch.release()
        yield found[-1]
        if not left.limit(1).count():
            break
        asked, lo, hi = with_covers(left, found).mapInArrow(lambda b: _left(b, bits), REQUEST), hi, 16 * hi
