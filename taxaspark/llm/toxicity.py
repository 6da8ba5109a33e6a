"""Toxicity scores: FTRL-proximal logistic regression over hashed word features.

Features of a text are its distinct hashed words, word pairs and one-word-skip pairs
(``BITS`` of a 64-bit hash).  The model is fitted online with FTRL-proximal: a learning
rate per coordinate and L1 regularisation, so only few thousand weights are not zero
and the broadcast is two short arrays (bounded by ``2**BITS``).

Fitting uses a bounded sample: of the labelled documents with crc32(doc_id) mod 5 <> 0, the
``MAX_PER_CLASS`` with the lowest hash of their id from each class, all features of each.  A
step moves a coordinate's z by less than 1 while its weight is 0, so a feature in n rows that
has n * ``EPOCHS`` <= ``L1`` keeps weight 0 whatever comes: it is left out without any effect.
What remains is written in parts of about ``PART_BYTES`` and streamed part by part in each
epoch, so the driver's memory does not depend on the length of texts.  Scoring covers all
whole texts.

A null or empty text has no features and gets the intercept's score.  A document that
is labelled more than once is toxic if any label says so; null labels are ignored.  Of
rows that repeat a labelled doc_id the model learns from the least text.
With no usable labels all scores are 0.0.  Repeated rows give a row each, extra
columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch

BITS = 22
MAX_PER_CLASS = 4096
PART_BYTES = 48 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def features(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of words, neighbours and skip pairs; pairs never cross texts."""
    shift = T.U64(64 - BITS)
    out_r, out_f = [rows], [T.chain(hashes, salt=1) >> shift]
    for gap in (1, 2):
        same = rows[gap:] == rows[:-gap]
        out_r.append(rows[gap:][same])
        out_f.append(T.chain(hashes[:-gap][same], hashes[gap:][same], salt=1 + gap) >> shift)
    return np.concatenate(out_r), np.concatenate(out_f).astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss over sparse 0/1 features."""

    def __init__(self, size: int = 1 << BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the intercept, without L1
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        some = np.flatnonzero(np.abs(self.z[:-1]) > self.l1)
        return some, self.weights(some), float(self.weights(np.array([len(self.z) - 1]))[0])


def sample(labels: DataFrame, most: int = MAX_PER_CLASS) -> DataFrame:
    """The documented bounded sample: doc_id, label."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return known.where("label = 1").orderBy(*order).limit(most).unionByName(known.where("label = 0").orderBy(*order).limit(most))


def _of_rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Each row's sorted features."""
    yield from (np.frombuffer(f, np.uint32) for f in batch.column("features").to_pylist())


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Nonzero features, their weights, and the intercept; None if nothing is labelled."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, rows in T.text_words(batch.column(1), T.ALNUM):
                r, f = features(h, rows)
                key = np.unique((r.astype(np.int64) << BITS) | f)
                ends = np.searchsorted(key >> BITS, np.arange(b - a + 1))
                mine = [(key[s:e] & ((1 << BITS) - 1)).astype(np.uint32).tobytes() for s, e in zip(ends[:-1], ends[1:])]
                turn = (T.mix(batch.column(0).slice(a, b - a).to_numpy().astype(np.uint64) + T.U64(7)) >> T.U64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(turn), pa.array(mine, pa.binary())], names=["doc_id", "label", "turn", "features"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for f in _of_rows(batch):
                n[f] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["feature", "n"])

    few = docs.select("doc_id", "text").join(F.broadcast(sample(labels)), "doc_id")  # at most 2 * MAX_PER_CLASS ids
    few = few.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("doc_id", "text", "label")
    rows = scratch.write(few.mapInArrow(featured, "doc_id bigint, label int, turn bigint, features binary"), "sample")
    counts = rows.select("features").mapInArrow(counted, "feature int, n int").groupBy("feature").agg(F.sum("n").alias("n"))
    used = np.zeros(1 << BITS, bool)  # at most 2 ** BITS features
    used[counts.where(f"n * {EPOCHS} > {L1}").select("feature").toArrow()["feature"].to_numpy()] = True
    packed = np.packbits(used)

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.unpackbits(packed).astype(bool)
        for batch in batches:
            left = [f[used[f]].tobytes() for f in _of_rows(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(left, pa.binary())], names=["doc_id", "label", "turn", "features"])

    rows = scratch.write(rows.mapInArrow(pruned, rows.schema), "pruned")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("features") + 24).alias("bytes")).first()
    if not found["n"]:
        return None
    parts = -(-found["bytes"] // PART_BYTES)
    width = -(-(1 << 63) // parts)

    def part(k: int) -> dict:
        mine = rows.where(F.col("turn").between(k * width, min((k + 1) * width, 1 << 63) - 1)) if parts > 1 else rows
        return mine.toArrow().sort_by([("turn", "ascending"), ("doc_id", "ascending")]).select(["label", "features"]).to_pydict()

    held = part(0)
    model = Ftrl()
    for epoch in range(EPOCHS):
        for k in range(parts):
            held = held if parts == 1 or epoch == k == 0 else part(k)
            for label, f in zip(held["label"], held["features"]):
                model.learn(np.frombuffer(f, np.uint32).astype(np.int64), label)
    scratch.drop("sample")
    scratch.drop("pruned")
    return model.sparse()


def scorer(model: tuple[np.ndarray, np.ndarray, float] | None):
    """A function from a column of texts to their probabilities."""
    weights, base = np.zeros(1 << BITS), -np.inf
    if model is not None:
        at, w, base = model
        weights[at] = w

    def score(texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), base)
        for a, _, h, rows in T.text_words(texts, T.ALNUM):
            r, f = features(h, rows)
            some = np.flatnonzero(weights[f])
            key = np.unique((r[some].astype(np.int64) << BITS) | f[some])
            np.add.at(total, a + (key >> BITS), weights[key & ((1 << BITS) - 1)])
        p = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
        return np.where(np.isneginf(total), 0.0, p)

    return score


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    spark = docs.sparkSession
    model = fit(docs, labels)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(sent.value)
        for batch in batches:
            p = score(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit(docs, labels))
    schema = docs.schema
    at_text = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at_text)) < 0.5))

    return docs.mapInArrow(run, schema)
