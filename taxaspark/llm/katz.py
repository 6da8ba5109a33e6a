"""Katz backoff language model over words: Good-Turing discounts, exactly normalised backoff.

With c the counts in training texts (crc32(doc_id) mod 10 <> 0) and d_r the Good-Turing
discount of a count r, a word w after the history h = (u, v) scores, recursively,

    P(w | u v) = d_c(u v w) * c(u v w) / c(u v)    if c(u v w) > 0
                 alpha(u v) * P(w | v)             otherwise
    P(w | v), likewise, from P(w);  P(w) = d_c(w) * c(w) / N, else what is left / UNSEEN
    alpha(h) = (1 - sum of P(w | h) over followers) / (1 - sum of P(w | shorter h) over them)

so that for each history all words and ``UNSEEN`` unknown ones sum to 1.  An unknown history
is skipped (alpha 1).  Counts up to ``K`` have Katz's discounts, larger ones those of the
log-linear fit of the counts of counts (Gale and Sampson's smoothed Good-Turing), which come
near 1 and leave every history something to back off to.  The score of a text is the sum of
log10 P over its words and one end token.  The first word has a start symbol for history, the
second the start symbol and the first.  ``ORDER`` is 3; 2 leaves the trigrams out.

All counts are over all training texts.  Each chunk of texts sends its distinct words and
pairs, each pair with its distinct followers, once to buckets; a bucket adds up (a pair's
count is that of its followers, and of where it ends a text) and answers each chunk with the
totals.  The answers are the count tables, partitioned by pair; a frequent n-gram is one
entry per chunk.  Each distinct n-gram has one owner among the chunks, which adds it to its
history's sums.  A text's n-gram is unseen only in held-out texts; the sums of two-word
histories are sent only for those that an unseen triple asks for (the bucket sees both).
Sums and asking texts meet by history; what they cost is added up per text.

Words are what stands between white space, A-Z lower-cased.  A null text is empty: it
scores its end token alone.  Null ids are training texts; rows that repeat are texts of
their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .chunks import ANSWER, bucket_bits, grouped, joined, make_chunks, squeeze, unpack, unsqueeze
from .scratch import Scratch
from .toxicity import held_out

ORDER = 3
K = 5
#: counts of counts that the fit for larger counts uses
FITTED = 32
#: words assumed unseen, which share what Good-Turing leaves for them
UNSEEN = 1_000_000.0
#: bounds of a task's memory: text of a chunk, and histories' sums held before they are sent
CHUNK_BYTES = 4 << 20
HELD_KEYS = 1 << 19
END, START = 0xE4D00001, 0x57A70001
PARTS = 10
#: bits of a group's number, of which the last tells words from pairs
BITS = 46
MANY = 31


def _number(h: np.ndarray, pair: int) -> np.ndarray:
    """Numbers of groups: of words (0) or of pairs (1)."""
    return ((h >> T.U64(64 - BITS)) & ~T.U64(1)) | T.U64(pair)


class Tokens:
    """The tokens of a chunk's texts and their distinct n-grams.

    Words and pairs are groups; a pair's group holds the triples that begin with it.  A group's own
    count is what its triples do not tell: all of it for words, the pairs that end a text otherwise.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, order: int = ORDER):
        h, s, _ = T.words(data, T.SPACED)
        n = self.n = len(offsets) - 1
        ends = np.searchsorted(s, offsets)
        count = np.diff(ends)
        self.row = np.repeat(np.arange(n), count + 1)
        said = np.full(len(h) + n, END, np.uint64)
        said[np.arange(len(h)) + np.repeat(np.arange(n), count)] = h
        first = np.cumsum(count + 1) - count - 1
        words, self.word = np.unique(said, return_inverse=True)
        v = self.v = len(words)
        self.before = np.empty_like(self.word)  # each token's history as a word, v for the start
        self.before[1:] = self.word[:-1]
        self.before[first] = v
        pairs, self.pair = np.unique(self.before * (v + 1) + self.word, return_inverse=True)
        self.pair_history, self.pair_word = pairs // (v + 1), pairs % (v + 1)
        self.named = np.append(words, T.U64(START))
        #: place of each token's triple, -1 where there is none (a text's first word; order 2)
        self.triple = np.full(len(said), -1)
        self.prefix = self.suffix = np.zeros(0, np.int64)
        if order > 2:
            inner = np.ones(len(said), bool)
            inner[first] = False
            triples, self.triple[inner] = np.unique(self.pair[np.flatnonzero(inner) - 1] * (v + 1) + self.word[inner], return_inverse=True)
            #: of each triple, its first two words and its last two, as pairs
            self.prefix, self.suffix = triples // (v + 1), np.zeros(len(triples), np.int64)
            self.suffix[self.triple[inner]] = self.pair[inner]
        self.tail = (T.chain(words[self.pair_word[self.suffix]], salt=6) & T.U64(0xFFFFFFFF)).astype(np.uint32)
        number = np.concatenate([_number(T.chain(words, salt=1), 0), _number(T.chain(self.named[self.pair_history], words[self.pair_word], salt=2), 1)])
        length = np.concatenate([np.zeros(v, np.int64), np.bincount(self.prefix, minlength=len(pairs))])
        start = np.cumsum(length) - length
        #: groups by number, and triples by their groups' numbers
        self.groups = np.argsort(number, kind="stable")
        self.number, self.length = number[self.groups], length[self.groups]
        self.triples = np.repeat(start[self.groups] - np.cumsum(self.length) + self.length, self.length) + np.arange(len(self.prefix))

    def histories(self, order: int) -> np.ndarray:
        """Numbers of all histories: for order 2 of words (the start last), for order 3 of pairs."""
        if order == 2:
            return _number(T.chain(self.named, salt=7), 0)
        return _number(T.chain(self.named[self.pair_history], self.named[self.pair_word], salt=8), 1)

    def history(self, order: int, at: np.ndarray) -> np.ndarray:
        """Of tokens ``at``, the place of their history among :meth:`histories`."""
        return self.before[at] if order == 2 else self.pair[at - 1]

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own counts of groups and counts of triples in training texts, as they are sent."""
        used = train[self.row]
        triple = np.bincount(self.triple[used & (self.triple >= 0)], minlength=len(self.prefix))
        pair = np.bincount(self.pair[used], minlength=len(self.pair_word)) - np.bincount(self.prefix, triple, len(self.pair_word)).astype(np.int64)
        return np.concatenate([np.bincount(self.word[used], minlength=self.v), pair])[self.groups], triple[self.triples]


def pack_groups(number: np.ndarray, length: np.ndarray, own: np.ndarray, tail: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted groups: numbers as steps of the bytes they need, tails whole, lengths and counts compressed."""
    steps = np.diff(number, prepend=number[:1])
    wide = max(1, -(-int(steps.max()).bit_length() // 8))
    rest = squeeze(np.concatenate((length, own, counts)).astype(np.uint32).tobytes())
    head = np.array([len(number), len(tail), wide, len(rest)], np.int64).tobytes() + number[:1].tobytes()
    return head + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes() + tail.tobytes() + rest


def unpack_groups(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    groups, entries, wide, size = np.frombuffer(blob, np.int64, 4).tolist()
    steps = np.zeros((groups, 8), np.uint8)
    steps[:, :wide] = np.frombuffer(blob, np.uint8, wide * groups, 40).reshape(groups, wide)
    number = np.frombuffer(blob, np.uint64, 1, 32) + np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)
    at = 40 + wide * groups
    tail = np.frombuffer(blob[at : at + 4 * entries], np.uint32)
    rest = np.frombuffer(unsqueeze(blob[at + 4 * entries :][:size]), np.uint32)
    return number, rest[:groups].astype(np.int64), rest[groups : 2 * groups], tail, rest[2 * groups :]


REQUEST = "bucket int, chunk bigint, body binary"


def _cuts(number: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last + 1) of sorted history numbers."""
    top = (number >> T.U64(BITS - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(top, prepend=-1))
    yield from zip(top[first].tolist(), first.tolist(), [*first[1:].tolist(), len(number)])


def _ask(batches: Iterator[pa.RecordBatch], bits: int, order: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct n-grams and their counts, by bucket."""
    for batch in batches:
        for chunk, flags, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "flags", "body"))):
            tok = Tokens(*unpack(body), order)
            (own, counts), tail = tok.counts(~np.array(flags, dtype=bool)), tok.tail[tok.triples]
            edge = np.concatenate(([0], np.cumsum(tok.length)))
            rows = list(_cuts(tok.number, bits))
            bodies = [pack_groups(tok.number[a:b], tok.length[a:b], own[a:b], tail[edge[a] : edge[b]], counts[edge[a] : edge[b]]) for _, a, b in rows]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array(bodies, pa.binary())], names=["bucket", "chunk", "body"])


def _add_up(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all keys, the total and whether they are the first of their kind; and the totals and places of the distinct ones."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))[: len(key)]
    sums = np.add.reduceat(n[order].astype(np.int64), first) if len(key) else np.zeros(0, np.int64)
    total, owner = np.empty(len(key), np.int64), np.zeros(len(key), bool)
    total[order] = np.repeat(sums, np.diff(np.append(first, len(key))))
    owner[order[first]] = True
    return total, owner, sums, order[first]


def _pack_totals(total: np.ndarray, owner: np.ndarray, asked: np.ndarray) -> bytes:
    code = np.minimum(total, MANY).astype(np.uint8) | (owner.astype(np.uint8) << 5) | (asked.astype(np.uint8) << 6)
    return code.tobytes() + total[total >= MANY].astype(np.int64).tobytes()


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals for each chunk, and the bucket's counts of counts as (order, count, n-grams) in a row of chunk -1."""
    for group in grouped(batches, "bucket"):
        chunks, asked = group["chunk"].to_pylist(), [unpack_groups(b) for b in group["body"].to_pylist()]
        number, length, own, tail, counts = (np.concatenate(x) for x in zip(*asked))
        known, at = np.unique(number, return_inverse=True)
        of = np.repeat(at, length)
        total, owner, sums, place = _add_up((of.astype(np.uint64) << T.U64(32)) | tail, counts)
        missed = np.zeros(len(known), bool)
        missed[of[place[sums == 0]]] = True  # a held-out text has a triple that no training text has
        whole = np.bincount(at, own, len(known)) + np.bincount(of[place], sums, len(known))
        group_total, group_owner, _, _ = _add_up(at, np.zeros(len(at), np.int64))
        group_total = whole.astype(np.int64)[at]
        payload, g, e = [], 0, 0
        for n, m in ((len(x[0]), len(x[3])) for x in asked):
            parts = _pack_totals(group_total[g : g + n], group_owner[g : g + n], missed[at[g : g + n]]), _pack_totals(total[e : e + m], owner[e : e + m], missed[of[e : e + m]])
            payload.append(squeeze(np.array([n, m, len(parts[0])], np.int64).tobytes() + parts[0] + parts[1]))
            g, e = g + n, e + m
        order = (known & T.U64(1)).astype(np.int64) + 1
        value, n = np.unique(np.concatenate([(order << 48) | whole.astype(np.int64), (3 << 48) | sums]), return_counts=True)
        value, n = value[some := (value & ((1 << 48) - 1)) > 0], n[some]
        summary = np.stack([value >> 48, value & ((1 << 48) - 1), n]).T.reshape(-1).tolist()
        rows = len(chunks) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([*chunks, -1], pa.int64()), pa.array([group["bucket"][0].as_py()] * rows, pa.int32()), pa.array([None] * len(chunks) + [summary], pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.bool_())), pa.array([*payload, None], pa.binary())],
            names=["chunk", "bucket", "ids", "flags", "payload"],
        )


def _unpack_totals(raws: list[bytes], sizes: list[int], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals, and codes with their flags, at their places."""
    code = np.frombuffer(b"".join(r[:n] for r, n in zip(raws, sizes)), np.uint8)
    total = (code & MANY).astype(np.int64)
    total[total == MANY] = np.frombuffer(b"".join(r[n:] for r, n in zip(raws, sizes)), np.int64)
    out = np.empty_like(total), np.empty_like(code)
    out[0][place], out[1][place] = total, code
    return out


def _totals(payloads: list[bytes], tok: Tokens) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(totals, codes) of words and pairs, and of triples; code & 32: this chunk is the owner, & 64: its group's sums are asked for."""
    raws = [unsqueeze(blob) for blob in payloads]
    heads = [np.frombuffer(r, np.int64, 3).tolist() for r in raws]
    groups = _unpack_totals([r[24 : 24 + k] for r, (_, _, k) in zip(raws, heads)], [n for n, _, _ in heads], tok.groups)
    return groups, _unpack_totals([r[24 + k :] for r, (_, _, k) in zip(raws, heads)], [m for _, m, _ in heads], tok.triples)


def discounts(n: np.ndarray, k: int = K) -> tuple[np.ndarray, float]:
    """d_0 .. d_k (d_0 unused) by Katz from the counts of counts 1, 2 ..., and the slope for larger counts.

    Where the counts do not allow one, d_r is (r - 1/2) / r, and the slope -2.
    """
    n = np.asarray(n, float)
    d = (np.maximum(np.arange(k + 1), 1) - 0.5) / np.maximum(np.arange(k + 1), 1)
    if n[0] > 0:
        common = (k + 1) * n[k] / n[0]
        for r in range(1, k + 1):
            if n[r - 1] > 0 and n[r] > 0 and common < 1:
                x = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                if 0 < x < 1:
                    d[r] = x
    some = np.flatnonzero(n > 0)
    slope = np.polyfit(np.log(some + 1), np.log(n[some]), 1)[0] if len(some) > 2 else -2.0
    return d, float(min(slope, -1.1))


class Model:
    """What all texts share: discounts by order, totals and what is left for unseen words."""

    def __init__(self, counts: np.ndarray, vocabulary: int, tokens: int, texts: int):
        #: by order: discounts up to K, slope beyond
        self.d = {order: discounts(counts[order - 1]) for order in range(1, len(counts) + 1)}
        self.vocabulary, self.tokens, self.texts, self.unseen = vocabulary, tokens, texts, 0.0

    def kept(self, c: np.ndarray, order: int) -> np.ndarray:
        """Discounted counts."""
        d, slope = self.d[order]
        c = np.asarray(c)
        return np.where(c <= K, d[np.minimum(c, K)], (1 + 1 / np.maximum(c, 1)) ** (slope + 1)) * c

    def share_unseen(self, kept: float) -> None:
        """``kept`` is the sum of all words' discounted counts."""
        self.unseen = (1 - kept / self.tokens if self.tokens else 1.0) / UNSEEN

    def p_word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.kept(c, 1) / max(self.tokens, 1), self.unseen)

    def p(self, order: int, c: np.ndarray, history: np.ndarray) -> np.ndarray:
        """P(w | h) of seen n-grams."""
        return self.kept(c, order) / np.maximum(history, 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))


def backoff(seen: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """alpha of histories from their sums of P(w | h) and of P(w | shorter h) over followers."""
    return (1 - seen) / (1 - lower)


def fitted(answers: DataFrame, order: int, texts: int) -> Model:
    """The model's totals, added up from the buckets' counts of counts."""
    rows = answers.where("chunk < 0").select(F.explode(F.expr("transform(filter(sequence(0, size(ids) div 3), i -> 3 * i < size(ids)), i -> struct(ids[3 * i] AS kind, ids[3 * i + 1] AS r, ids[3 * i + 2] AS n))")).alias("x")).select("x.*")
    low = F.col("r") <= FITTED
    found = rows.groupBy("kind", F.when(low, F.col("r")).alias("r")).agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("n")).alias("m")).collect()
    counts = np.zeros((order, FITTED))
    for r in found:
        if r["r"] is not None:
            counts[r["kind"] - 1, r["r"] - 1] = r["n"]
    words = [r for r in found if r["kind"] == 1]
    model = Model(counts, sum(r["n"] for r in words), sum(r["m"] for r in words), texts)
    r = F.col("r").cast("double")
    beyond = rows.where(F.col("kind") == 1).where(~low).agg(F.sum(F.pow(1 + 1 / r, F.lit(model.d[1][1] + 1)) * r * F.col("n")).alias("x")).first()["x"]
    some = np.arange(1, FITTED + 1)
    model.share_unseen(float((model.kept(some, 1) * counts[0]).sum()) + (beyond or 0.0))
    return model


#: kind 0: a chunk's texts; 1: sums of histories; 2: texts that back off from a history
PART = "bucket int, kind int, chunk bigint, ids array<bigint>, flags array<boolean>, keys binary, x binary, y binary"
ROWS = "chunk bigint, row int, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _part(bucket, kind, chunk, keys, x, y, ids=None, flags=None) -> pa.RecordBatch:
    n = len(bucket)
    fill = (lambda v, t: pa.array(v, t) if v is not None else pa.nulls(n, t))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(chunk, pa.int64()), fill(ids, pa.list_(pa.int64())), fill(flags, pa.list_(pa.bool_())), pa.array(keys, pa.binary()), pa.array(x, pa.binary()), pa.array(y, pa.binary())],
        names=["bucket", "kind", "chunk", "ids", "flags", "keys", "x", "y"],
    )


def _rows(chunk, row, ids, flags, tokens, known, base, score) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((chunk, row, ids, flags, tokens, known, base, score), kinds)], names=[x.split()[0] for x in ROWS.split(", ")])


def _finish(rows: Iterator[tuple], model: Model, bits: int, order: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's scores without alphas, the sums of its own n-grams, and what its texts back off from."""
    held: list[tuple] = []

    def sums() -> pa.RecordBatch:
        keys, x, y = (np.concatenate(v) for v in zip(*held))
        known, at = np.unique(keys, return_inverse=True)
        x, y = np.bincount(at, x), np.bincount(at, y)
        cut = list(_cuts(known, bits))
        return _part([b for b, _, _ in cut], 1, [-1] * len(cut), [known[a:b].tobytes() for _, a, b in cut], [x[a:b].tobytes() for _, a, b in cut], [y[a:b].tobytes() for _, a, b in cut])

    for chunk, ids, flags, data, offsets, payloads in rows:
        tok = Tokens(data, offsets, order)
        plain = {k: tok.histories(k) for k in range(2, order + 1)}
        (total, code), (triple_c, triple_code) = _totals(payloads, tok)
        v, word_c = tok.v, total[tok.word]
        # c(h) of one-word histories: the word's count, for the start that of all training texts.
        of_word = np.append(total[:v], model.texts)
        pair_c = total[v:]
        p1 = model.p_word(total[:v])
        p2 = model.p(2, pair_c, of_word[tok.pair_history])
        chosen = np.where(pair_c[tok.pair] > 0, p2[tok.pair], p1[tok.word])
        backs = [(2, np.flatnonzero((pair_c[tok.pair] == 0) & (of_word[tok.before] > 0)))]
        own = np.flatnonzero((code[v:] & 32 > 0) & (pair_c > 0))
        if len(own):
            held.append((plain[2][tok.pair_history[own]], p2[own], p1[tok.pair_word[own]]))
        if order > 2:
            p3 = model.p(3, triple_c, pair_c[tok.prefix])
            inner = np.flatnonzero(tok.triple >= 0)
            seen = triple_c[tok.triple[inner]] > 0
            chosen[inner[seen]] = p3[tok.triple[inner[seen]]]
            lost = inner[~seen]
            backs.append((3, lost[pair_c[tok.pair[lost - 1]] > 0]))
            own = np.flatnonzero((triple_code & 96 == 96) & (triple_c > 0))
            if len(own):
                held.append((plain[3][tok.prefix[own]], p3[own], p2[tok.suffix[own]]))
        cols = (np.bincount(tok.row, minlength=tok.n), np.bincount(tok.row, word_c > 0, tok.n), np.bincount(tok.row, model.base(word_c), tok.n), np.bincount(tok.row, np.log10(chosen), tok.n))
        yield _part([chunk % (1 << min(bits, 30))], 0, [chunk], [b""], [np.array(cols, np.float64).tobytes()], [b""], [ids], [flags])
        number = np.concatenate([plain[k][tok.history(k, at)] for k, at in backs])
        row = np.concatenate([tok.row[at] for _, at in backs])
        if len(number):
            # A text that backs off from a history again and again is one entry.
            index = np.lexsort((row, number))
            number, row = number[index], row[index]
            first = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (row[1:] != row[:-1]))))
            times = np.diff(np.append(first, len(row))).astype(np.int32)
            number, row = number[first], row[first].astype(np.int32)
            cut = list(_cuts(number, bits))
            yield _part([b for b, _, _ in cut], 2, [chunk] * len(cut), [squeeze(number[a:b].tobytes()) for _, a, b in cut], [squeeze(times[a:b].tobytes()) for _, a, b in cut], [squeeze(row[a:b].tobytes()) for _, a, b in cut])
        if sum(len(k) for k, _, _ in held) > HELD_KEYS:
            yield sums()
            held = []
    if held:
        yield sums()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What texts back off to costs; a bucket's sums are held, its texts pass one chunk at a time."""
    bucket, keys, x, y, known, alpha = None, [], [], [], np.zeros(0, np.uint64), np.zeros(0)
    for batch in batches:
        for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # by bucket and kind
            if r["bucket"] != bucket:
                bucket, keys, x, y, alpha = r["bucket"], [], [], [], None
            if r["kind"] == 0:
                n = len(r["ids"])
                v = np.frombuffer(r["x"], np.float64).reshape(4, n)
                yield _rows([r["chunk"]] * n, list(range(n)), r["ids"], r["flags"], v[0].astype(np.int64), v[1].round().astype(np.int64), v[2], v[3])
            elif r["kind"] == 1:
                keys.append(np.frombuffer(r["keys"], np.uint64))
                x.append(np.frombuffer(r["x"], np.float64))
                y.append(np.frombuffer(r["y"], np.float64))
            else:
                if alpha is None:
                    known, at = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.uint64), None)
                    alpha = backoff(np.bincount(at, np.concatenate(x)), np.bincount(at, np.concatenate(y))) if keys else np.zeros(0)
                key, times, row = (np.frombuffer(unsqueeze(r[c]), t) for c, t in (("keys", np.uint64), ("x", np.int32), ("y", np.int32)))
                at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                cost = np.where(known[at] == key, np.log10(alpha[at]), 0.0) * times if len(known) else np.zeros(len(key))
                row, at = np.unique(row, return_inverse=True)
                m = len(row)
                yield _rows([r["chunk"]] * m, row, [None] * m, [None] * m, [0] * m, [0] * m, [0.0] * m, np.bincount(at, cost))


def score_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "katz")
    chunks = make_chunks(docs, scratch, held_out(F.col("doc_id"), PARTS), CHUNK_BYTES)
    bits = bucket_bits(chunks, 0.15 * order)
    asked = chunks.select("chunk", "flags", "body").mapInArrow(lambda b: _ask(b, bits, order), REQUEST)
    answers = scratch.write(asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_answer, ANSWER), "counts", compression="none")
    model = fitted(answers, order, chunks.agg(F.sum(F.size(F.filter("flags", lambda f: ~f))).alias("n")).first()["n"] or 0)
    scratch.release()  # the requests have been answered
    bodies = chunks.select("chunk", F.lit(-1).alias("bucket"), "ids", "flags", F.col("body").alias("payload"))
    parts = joined(bodies.unionByName(answers.where("chunk >= 0")), lambda rows: _finish(rows, model, bits, order), PART)
    settled = parts.repartition("bucket").sortWithinPartitions("bucket", "kind", "chunk").mapInArrow(_settle, ROWS)
    out = settled.groupBy("chunk", "row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score")
    )
    out = out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
    out = scratch.write(out, "scores")
    scratch.drop("chunks")
    scratch.drop("counts")
    return out
