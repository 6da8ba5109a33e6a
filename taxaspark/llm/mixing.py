"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source shall be taken ``target / size of source`` times in
expectation.  The whole part of that ratio is taken for certain; the fractional part is
an inclusion probability, and the cube method turns probabilities into 0 or 1 while it
keeps the document total and the word total of each source: probabilities move along
the null space of the two balancing equations until a unit reaches 0 or 1 (large units
against many others, then three units at a time, where it has a closed form).  A block of ``BLOCK`` documents
leaves at most two undecided units; these meet in the next, 2048 times smaller level,
until one block per source is left, where a small landing problem drops the document
total, then the word total.

Blocks are dealt by (source, hash of doc_id), so a source with a third of all rows is
many blocks, in as many tasks.  Seeds depend on level, source and block only, so reruns agree.

A null text has size 0; a null source is a source of its own, last in order.  Documents
of size 0 take 0 words.  Repeated rows are documents of their own; extra columns are
ignored; an empty table gives no rows.  The list of sources (not of documents) is held
by the driver, up to ``MAX_SOURCES``; more raise an error.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 4096
SALTS = 32
MAX_SOURCES = 1_000_000
SEED = 20240611


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of sum(sizes) by weight, each at most cap times its size; the excess goes to the others by weight."""
    out, left, total = [0.0] * len(sizes), float(sum(sizes)), float(sum(weights))
    order = sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i])  # the first to be full comes first
    for i in order:
        out[i] = min(left * weights[i] / total, float(cap * sizes[i]))
        left, total = left - out[i], total - weights[i]
    return out


def settle_large(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Decide units of over twice the mean size, in place, moving up to 1024 others against each.

    Three-unit steps would leave the extremes of size for last, where landing costs most.
    """
    large = size > 2 * size.mean()
    for i in np.flatnonzero(large & (p > 0) & (p < 1)):
        for _ in range(64):
            others = np.flatnonzero((p > 0) & (p < 1) & ~large)[:1024]
            s = size[others].astype(float)
            det = len(s) * (s @ s) - s.sum() ** 2
            if not 0 < p[i] < 1 or len(s) < 8 or det <= 0:
                break
            x, y = (s.sum() * size[i] - s @ s) / det, (s.sum() - len(s) * size[i]) / det
            at, u = np.append(others, i), np.append(x + y * s, 1.0)
            room_up = np.where(u > 0, (1 - p[at]) / np.where(u == 0, 1, np.abs(u)), np.where(u < 0, p[at] / np.where(u == 0, 1, np.abs(u)), np.inf)).min()
            room_down = np.where(u > 0, p[at] / np.where(u == 0, 1, np.abs(u)), np.where(u < 0, (1 - p[at]) / np.where(u == 0, 1, np.abs(u)), np.inf)).min()
            step = room_up if rng.random() * (room_up + room_down) < room_down else -room_down
            v = p[at] + step * u
            p[at] = np.where(v < 1e-9, 0.0, np.where(v > 1 - 1e-9, 1.0, v))


def flight(p: list[float], size: list[int], rng: np.random.Generator, land: bool) -> list[float]:
    """Move probabilities to 0 or 1 with sum(p) and sum(p * size) kept; at most two small units stay between, none if ``land``."""
    start = np.array(p, dtype=float)
    if len(p):
        settle_large(start, np.array(size), rng)
    p, active, nxt = start.tolist(), [], 0
    while True:
        while len(active) < 3 and nxt < len(p):
            if 0 < p[nxt] < 1:
                active.append(nxt)
            nxt += 1
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = (b - c, c - a, a - b) if a != b or b != c else (1, -1, 0)
        elif len(active) == 2 and (land or size[active[0]] == size[active[1]]):
            u = (size[active[1]], -size[active[0]])
        elif len(active) == 1 and land:
            u = (1,)
        else:
            return p
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(active, u):
            v = p[i] + step * x
            p[i] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
        active = [i for i in active if 0 < p[i] < 1]


def _mixed(ids: np.ndarray) -> np.ndarray:
    from .text import U64, mix

    return mix(ids.astype(np.uint64) + U64(SEED))


UNIT = "doc_id bigint, size bigint, source_no int, source_size bigint, target double, whole int, p double, blocks bigint"


def _level(units: DataFrame, level: int, scratch: Scratch) -> DataFrame:
    """One flight over all blocks of a level; units come out with the number of blocks of the next."""
    block = F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED + level)), F.col("blocks")).cast("int")

    def run(key, table):
        source, at, n = (k.as_py() for k in key)
        ids = np.array([i or 0 for i in table["doc_id"].to_pylist()], dtype=np.int64)
        size = table["size"].to_numpy()
        table = table.take(pa.array(np.lexsort((ids, _mixed(ids), -size))))  # large documents are decided first, so what is left is small
        rng = np.random.default_rng([SEED, level, source, at])
        p = flight(table["p"].to_pylist(), table["size"].to_pylist(), rng, land=n == 1)
        done = {"p": pa.array(p, pa.float64()), "blocks": pa.array([next_blocks(n)] * len(p), pa.int64())}
        names = [x.split()[0] for x in UNIT.split(", ")]
        return pa.table([done.get(c, table[c]) for c in names], names=names)

    return scratch.write(units.withColumn("block", block).groupBy("source_no", "block", "blocks").applyInArrow(run, UNIT), f"level{level}")


def next_blocks(n: int) -> int:
    """Blocks of the next level: each leaves at most two units."""
    return -(-2 * n // BLOCK)


def mix_sources(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = scratch.write(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size")), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.sum((F.col("size") > 0).cast("int")).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([r["size"] for r in found], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))])
    plan, most = [], 0
    for i, (r, t) in enumerate(zip(found, goal)):
        ratio = min(t / r["size"], float(CAP)) if r["size"] else 0.0
        whole = int(ratio + 1e-12)
        part = max(0.0, ratio - whole)
        blocks = -(-r["n"] // BLOCK)
        plan.append((r["source"], i, r["size"], t, whole, part if part > 1e-12 else 0.0, max(1, blocks)))
        most = max(most, blocks if part > 1e-12 else 0)
    # A written table's size is known, so Spark broadcasts it only under its threshold; beyond that, salts make a hot
    # source many tasks.  Nothing is joined later: each unit carries what its source says.
    table = scratch.write(spark.createDataFrame(plan, "source string, source_no int, source_size bigint, target double, whole int, p double, blocks bigint"), "sources")
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    units = salted.join(table, salted["source"].eqNullSafe(table["source"]) & (salted["salt"] == table["salt"])).select(*(x.split()[0] for x in UNIT.split(", ")))
    undecided = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0)
    done, units, level = [units.where(~undecided)], units.where(undecided), 0
    while most:
        out = _level(units, level, scratch)
        done.append(out.where(~undecided))
        units, level = out.where(undecided), level + 1
        most = next_blocks(most) if most > 1 else 0
    taken = ((F.col("whole") + F.col("p").cast("int")) * F.col("size")).cast("bigint")
    return reduce(DataFrame.unionByName, done).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
