"""Benchmark decontamination: BM25 retrieval by block-max WAND, then overlap checks.

Test items (long ones in pieces) are indexed; every passage of every training text is a
query.  Impacts are divided by each item's own threshold, ``TAU`` times the score the
item gives itself, so "above threshold" is a sum of at least 1 for all items.  Document
frequencies, their number and their mean length are those of all items.  Items are
numbered so that alike ones are neighbours.  Numbers are cut into blocks of ``BLOCK``, these
into blocks of ``FAN``, and so on; for each word and block that holds it the index keeps the
largest impact, so it grows with the postings.  From the largest blocks down, those whose
maxima over a passage's words do not reach 1 are left, with all in them.  WAND then goes
through the postings of the passage's words and skips from one remaining block to the
next.  That is exact: every item above threshold is found.
A pair counts as contaminated if enough of the item's question and of its answer stand
in the passage (share of their word trigrams).

The question is the text up to the last ``?``, else all sentences but the last, else
the first three quarters; the answer is the rest.

The index is broadcast in shards of about ``SHARD_BYTES`` of item text (measured first);
texts are read once and meet one shard after the other, of which a worker holds one.
Passages overlap by half and are twice as long as the longest piece of all items, so each
piece stands whole in some passage.

Null and empty texts or items match nothing.  Items that repeat count once; different texts
under one item_id are one item with the best of their rows.  Repeated rows and null doc_ids
give rows of their own.  Extra columns are ignored; with no rows on either side the result is empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

TAU = 0.5
QUESTION, ANSWER = 0.5, 0.5
PIECE = 128
SHARD_BYTES = 4 << 20
BLOCK = 4
FAN = 16
TEXT_BYTES = 4 << 20
K1, B = 1.2, 0.75


class Part(NamedTuple):
    item_id: int
    length: int
    question: np.ndarray
    answer: np.ndarray


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    at = text.rfind("?")
    if at >= 0 and text[at + 1 :].strip():
        return text[: at + 1], text[at + 1 :]
    ends = [m.end() for m in re.finditer(r"[.!?\n]+\s*", text.rstrip(" .!?\n\t\r"))]
    if ends:
        return text[: ends[-1]], text[ends[-1] :]
    words = text.split()
    cut = max(1, len(words) * 3 // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _hashes(text: str) -> np.ndarray:
    return T.words(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), T.ALNUM)[0]


def grams(h: np.ndarray, n: int = 3) -> np.ndarray:
    """Distinct hashes of runs of n words (of all words if there are fewer)."""
    n = min(n, len(h))
    return np.unique(T.chain(*(h[i : len(h) - n + 1 + i] for i in range(n)), salt=n)) if n else h


def pieces(items: list[tuple[int, str]]) -> list[tuple[np.ndarray, Part]]:
    """Words of each item, long ones in pieces, with what each piece holds of question and answer."""
    out = []
    for item_id, text in items:
        h = _hashes(text or "")
        if not len(h):
            continue
        question, answer = (_hashes(x) for x in split_item(text))
        for a in range(0, len(h), PIECE):
            inside = lambda part, lo: part[max(0, a - lo) : max(0, a - lo + PIECE)]
            piece = h[a : a + PIECE]
            out.append((piece, Part(item_id, len(piece), inside(question, 0), inside(answer, len(question)))))
    return out


class Statistics:
    """Pieces, words and document frequencies of all test items, added up shard by shard."""

    def __init__(self):
        self.n, self.words, self.longest = 0, 0, 0
        self.vocabulary, self.df = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, found: list[tuple[np.ndarray, Part]]) -> None:
        if not found:
            return
        self.n += len(found)
        self.words += sum(len(p) for p, _ in found)
        self.longest = max(self.longest, *(len(p) for p, _ in found))
        keys = np.concatenate([self.vocabulary, *(np.unique(p) for p, _ in found)])
        n = np.concatenate([self.df, np.ones(len(keys) - len(self.df), np.int64)])
        self.vocabulary, at = np.unique(keys, return_inverse=True)
        self.df = np.bincount(at, n).astype(np.int64)

    def idf(self, words: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.vocabulary, words)]
        return np.log(1 + (self.n - df + 0.5) / (df + 0.5))


class Level(NamedTuple):
    """Block maxima: entries (word, block) in order, with the word's largest impact in that block of items."""

    keys: np.ndarray
    most: np.ndarray
    width: int


class Index:
    """Postings with impacts in units of each item's threshold, and block maxima in levels of ``FAN`` blocks each."""

    def __init__(self, found: list[tuple[np.ndarray, Part]], stats: Statistics):
        bags = [np.unique(p, return_counts=True) for p, _ in found]
        self.vocabulary = np.unique(np.concatenate([w for w, _ in bags])) if bags else np.zeros(0, np.uint64)
        mean, scored = stats.words / max(1, stats.n), []
        for (w, tf), (_, part) in zip(bags, found):
            impact = stats.idf(w) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * part.length / mean))
            scored.append((impact.sum(), np.searchsorted(self.vocabulary, w), impact / (TAU * impact.sum()), part))
        df = np.bincount(np.concatenate([t for _, t, _, _ in scored]), minlength=len(self.vocabulary)) if scored else np.zeros(0)
        common = set(np.argsort(-df, kind="stable")[:12].tolist())  # alike items become neighbours
        scored.sort(key=lambda x: (sorted(common & set(x[1].tolist())), x[0], x[3].item_id))
        self.self_score = [s for s, *_ in scored]
        self.parts = [p for *_, p in scored]
        self.window = 2 * max(32, stats.longest)
        if not scored:
            return
        word = np.concatenate([t for _, t, _, _ in scored])
        item = np.repeat(np.arange(len(scored)), [len(t) for _, t, _, _ in scored])
        impact = np.concatenate([v for _, _, v, _ in scored])
        order = np.lexsort((item, word))
        word, self.items, self.impacts = word[order], item[order].astype(np.int32), impact[order]
        #: postings of word w: starts[w] to starts[w + 1]
        self.starts = np.searchsorted(word, np.arange(len(self.vocabulary) + 1))
        self.levels: list[Level] = []
        block, most = self.items // BLOCK, self.impacts
        width = -(-len(scored) // BLOCK)
        while True:
            first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (block[1:] != block[:-1]))))
            word, block, most = word[first], block[first], np.maximum.reduceat(most, first)
            self.levels.insert(0, Level(word.astype(np.int64) * width + block, most.astype(np.float32) * np.float32(1 + 1e-6), width))
            if width <= FAN:
                break
            block, width = block // FAN, -(-width // FAN)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.vocabulary, self.items, self.impacts, self.starts, *(y for level in self.levels for y in level[:2])))

    def live_blocks(self, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) whose block maxima add up to 1; passage k has the words first[k] to first[k + 1]."""
        passage, node = np.arange(len(first) - 1), np.zeros(len(first) - 1, np.int64)
        size = np.diff(first)
        for level in self.levels:
            out = []
            for a, b in _slices(size[passage], 1 << 19):  # bounded memory
                p, lo = passage[a:b], node[a:b] * FAN
                n = size[p]
                pair = np.repeat(np.arange(b - a), n)
                w = word[np.repeat(first[p], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
                key = w.astype(np.int64) * level.width
                s = np.searchsorted(level.keys, key + lo[pair])
                m = np.searchsorted(level.keys, key + np.minimum(lo[pair] + FAN, level.width)) - s
                at = np.repeat(s - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
                child = level.keys[at] - np.repeat(key + lo[pair], m)
                total = np.bincount(np.repeat(pair, m) * FAN + child, level.most[at], (b - a) * FAN)
                k = np.flatnonzero(total >= 1 - 1e-4)
                out.append((p[k // FAN], lo[k // FAN] + k % FAN))
            if not out:
                return passage[:0], node[:0]
            passage, node = (np.concatenate(x) for x in zip(*out))
        return passage, node

    def retrieve(self, words: list[int], blocks: list[int], least: float = 1.0 - 1e-9) -> list[tuple[int, float]]:
        """Items whose summed impacts over these distinct words reach ``least``: WAND over the postings, skipping to the next of ``blocks``."""
        lists = []
        for w in words:
            a, b = int(self.starts[w]), int(self.starts[w + 1])
            items = self.items[a:b]
            lists.append([int(items[0]), 0, items, self.impacts[a:b], float(self.impacts[a:b].max())])
        found, n, nxt, end = [], len(self.parts), 0, len(blocks)

        def skip(c: list, to: int) -> None:
            c[1] += int(np.searchsorted(c[2][c[1] :], to))
            c[0] = int(c[2][c[1]]) if c[1] < len(c[2]) else n

        while lists:
            lists.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(lists):
                total += c[4]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while nxt < end and blocks[nxt] < item // BLOCK:
                nxt += 1
            if nxt == end:
                return found
            if item // BLOCK < blocks[nxt]:  # the block's maxima cannot reach ``least``
                to = blocks[nxt] * BLOCK
            elif lists[0][0] == item:
                score = sum(float(c[3][c[1]]) for c in lists if c[0] == item)
                if score >= least:
                    found.append((item, score))
                to = item + 1
            else:
                to = item
            for c in lists:
                if c[0] < to:
                    skip(c, to)
            lists = [c for c in lists if c[0] < n]
        return found


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of about ``most`` in total."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b
        a = b


def match_text(index: Index, h: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(item_id, first word, BM25, question overlap, answer overlap) of one text; each item's best passage."""
    return [x[1:] for x in match_texts(index, h, np.zeros(len(h), np.int64), 1)]


def match_texts(index: Index, h: np.ndarray, rows: np.ndarray, n: int) -> list[tuple[int, int, int, float, float, float]]:
    """As :func:`match_text` for several texts; ``rows`` is the text of each word, given first in each result."""
    if not len(h) or not len(index.vocabulary):
        return []
    word = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
    at = np.flatnonzero(index.vocabulary[word] == h)
    if not len(at):
        return []
    ends = np.searchsorted(rows, np.arange(n + 1))
    half = index.window // 2
    count = np.maximum(1, -(-(ends[1:] - ends[:-1] - half) // half))
    count[ends[1:] == ends[:-1]] = 0
    base = np.cumsum(count) - count
    text = np.repeat(np.arange(n), count)
    start = ends[text] + (np.arange(len(text)) - base[text]) * half
    # A word stands in the passage that starts in its half, and in the one before.
    nth = (at - ends[rows[at]]) // half
    own = base[rows[at]]
    key = np.concatenate((own + np.minimum(nth, count[rows[at]] - 1), (own + nth - 1)[(nth > 0) & (nth < count[rows[at]])]))
    key = np.unique(key * len(index.vocabulary) + np.concatenate((word[at], word[at][(nth > 0) & (nth < count[rows[at]])])))
    passage, word = np.divmod(key, len(index.vocabulary))
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    edge = np.append(first, len(passage))
    best: dict[tuple[int, int], tuple] = {}
    who, block = index.live_blocks(word, edge)
    order = np.lexsort((block, who))
    who, block = who[order], block[order]
    runs = np.flatnonzero(np.diff(who, prepend=-1))
    for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(who)]):
        k = int(who[a])
        hits = index.retrieve(word[edge[k] : edge[k + 1]].tolist(), block[a:b].tolist())
        if not hits:
            continue
        k = int(passage[first[k]])
        stop = min(start[k] + index.window, ends[text[k] + 1])
        have = {m: grams_all(h[start[k] : stop], m) for m in (1, 2, 3)}
        for i, score in hits:
            part = index.parts[i]
            q, a_ = (overlap(x, have) for x in (part.question, part.answer))
            if q >= QUESTION and a_ >= ANSWER:
                key = (int(text[k]), part.item_id)
                row = (int(text[k]), part.item_id, int(start[k] - ends[text[k]]), float(score * TAU * index.self_score[i]), float(q), float(a_))
                if key not in best or row[3] > best[key][3]:
                    best[key] = row
    return list(best.values())


def grams_all(h: np.ndarray, n: int) -> np.ndarray:
    return np.unique(T.chain(*(h[i : len(h) - n + 1 + i] for i in range(n)), salt=n)) if len(h) >= n else h[:0]


def overlap(part: np.ndarray, have: dict[int, np.ndarray]) -> float:
    """Share of a part's runs of three words (fewer if it is shorter) that are present; 1 for an empty part."""
    n = min(3, len(part))
    return float(np.isin(grams(part), have[n]).mean()) if n else 1.0


SCHEMA = "doc_id bigint, item_id bigint, first_word bigint, bm25 double, question_overlap double, answer_overlap double"


class Shards:
    """The broadcast indexes of all test items; statistics are those of all items, so scores do not depend on the shards."""

    def __init__(self, benchmark: DataFrame):
        spark = benchmark.sparkSession
        items = benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL")
        size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
        n, stats = max(1, -(-size // SHARD_BYTES)), Statistics()

        def shard(k: int) -> list[tuple[np.ndarray, Part]]:
            mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items
            return pieces(sorted({(r["item_id"], r["text"]) for r in mine.collect()}))

        held = [shard(0)]
        for k in range(n):
            stats.add(shard(k) if k else held[0])
        self.sent = []
        for k in range(n):
            self.sent.append(spark.sparkContext.broadcast(Index(held.pop() if held else shard(k), stats)))

    def match(self, h: np.ndarray, rows: np.ndarray, n: int) -> list[tuple[int, int, int, float, float, float]]:
        """All shards' matches; of several shards only one is held at a time."""
        out = []
        for shard in self.sent:
            out += match_texts(shard.value, h, rows, n)
            if len(self.sent) > 1:
                shard.__dict__.pop("_value", None)
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item it contains; see SCHEMA."""
    shards = Shards(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        for batch in batches:
            ids = batch.column(0)
            for a, b, h, rows in T.text_words(batch.column(1), T.ALNUM, TEXT_BYTES):
                out = shards.match(h, rows, b - a)
                if out:
                    at, *rest = zip(*out)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + i for i in at])), *(pa.array(x, kind) for x, kind in zip(rest, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no test item, all columns as they were (each row is judged where it is read)."""
    schema, shards = docs.schema, Shards(benchmark)
    at_text = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for a, b, h, rows in T.text_words(batch.column(at_text), T.ALNUM, TEXT_BYTES):
                clean[[a + x[0] for x in shards.match(h, rows, b - a)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, schema)
