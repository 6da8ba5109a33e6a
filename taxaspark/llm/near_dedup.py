"""MinHash near-dedup: improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. Five-word shingles of every whole text are counted over the corpus (``chunks``).  The
   weight of a shingle is tf * idf with the smoothed ``idf = 1 + ln((1 + N) / (1 + df))``.
2. A text whose shingles of df >= 2 weigh less than ``SIMILARITY`` of its total cannot
   reach that weighted Jaccard similarity with any text; it is done, without loss.
3. ICWS gives the others ``BANDS`` x ``ROWS`` samples.  What a text shares with nobody is
   one element of its own, since it can match nothing.  Texts with equal weighted sets
   are one *representative* from here on.
4. Representatives meet in bands.  Within a small bucket all pairs are candidates; in a
   larger one every member is compared with ``HUBS`` hubs, then those that are not yet in
   the bucket's main class with hubs of that class.  Those still outside it (stragglers) are
   compared with the whole bucket in blocks by ``BINS`` partial weights per set: the sum of the
   smaller partial weights bounds what two sets share, so only pairs whose bound reaches
   ``SIMILARITY`` can be links.  Of these the ``MOST`` best of a straggler and block become rows;
   stragglers with more that are then still outside are verified within blocks, from which only
   links that join two classes become rows.  Members of the main class are not compared with
   each other, so no bucket emits all its pairs, and no link between classes is dropped.
5. Every candidate is verified by weighted Jaccard similarity over all shingles; classes
   are the connected components of verified links.

Words are runs of letters and digits, lower-cased.  A text of one to four words is one
shingle of all its words; null, empty and wordless texts resemble nothing and are
classes of their own.  A null doc_id takes part in no class (class_id null).  Rows that
repeat a doc_id share its class.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .chunks import bucket_bits, count_keys, grouped, make_chunks, with_answers
from .components import components
from .scratch import Scratch

WORDS = 5
#: of weights, not of shingles: a changed word costs rare shingles, and what a large group shares is worth the less
#: the larger the group, so a copy of 0.8 by shingles is one of 0.73 where 3,000 of 3,000,000 texts are alike
SIMILARITY = 0.5
#: a pair of SIMILARITY 0.5 meets in a band with probability 0.992, one of 0.6 with 0.9998
BANDS, ROWS = 36, 3
HUBS = 2
SMALL = 12
BINS = 64
BLOCK = 512
#: pairs of a straggler and block that become rows at once; the blocks in which the rest is verified are smaller, as they hold sets
MOST, INNER = 4, 128
CHUNK_BYTES = 6 << 20


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles and their counts, for each text."""
    h, s, _ = T.words(data, T.ALNUM)
    ends = np.searchsorted(s, offsets)
    if len(h) >= WORDS:
        run = T.chain(*(h[i : len(h) - WORDS + 1 + i] for i in range(WORDS)))
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(run[a : b - WORDS + 1], return_counts=True))
        else:
            out.append((T.chain(*(h[i : i + 1] for i in range(a, b)), salt=b - a), np.ones(1, np.int64)) if b > a else (h[:0], np.zeros(0, np.int64)))
    return out


def _keyer(data: np.ndarray, offsets: np.ndarray, flags: list) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([k for k, _ in shingles(data, offsets)]), return_counts=True)


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return 1 + np.log((1 + n) / (1 + df))


_TABLES: dict[int, tuple] = {}


def _tables() -> tuple:
    """Quantiles of the distributions ICWS draws from, indexed by 16 bits of a hash."""
    if 0 not in _TABLES:
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        gamma = _gamma2(u)
        _TABLES[0] = (gamma.astype(np.float32), np.log(gamma).astype(np.float32), u.astype(np.float32))
    return _TABLES[0]


def _gamma2(u: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), by bisection of 1 - (1 + x) exp(-x)."""
    lo, hi = np.zeros_like(u), np.full_like(u, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def icws(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """BANDS band hashes of a weighted set (Ioffe's r, c, beta per element and sample)."""
    gamma, log_gamma, uniform = _tables()
    k = BANDS * ROWS
    salt = T.mix(np.arange(1, k + 1, dtype=np.uint64))
    best = np.full(k, np.inf, np.float32)
    who, level = np.zeros(k, np.uint64), np.zeros(k, np.int64)
    for a in range(0, len(keys), 1024):  # bounded memory for long texts
        key, logw = keys[a : a + 1024, None], np.log(weights[a : a + 1024, None]).astype(np.float32)
        bits = T.mix(key ^ salt)
        r = gamma[bits & T.U64(0xFFFF)]
        beta = uniform[(bits >> T.U64(16)) & T.U64(0xFFFF)]
        t = np.floor(logw / r + beta)
        value = log_gamma[(bits >> T.U64(32)) & T.U64(0xFFFF)] - r * (t - beta + 1)
        at = value.argmin(axis=0)
        low = value[at, np.arange(k)]
        better = low < best
        best[better] = low[better]
        who[better] = keys[a : a + 1024][at[better]]
        level[better] = t[at, np.arange(k)][better].astype(np.int64)
    sample = T.mix(who ^ T.mix(level.astype(np.uint64))).reshape(BANDS, ROWS)
    return T.chain(*sample.T)


def pack_set(keys: np.ndarray, weights: np.ndarray) -> bytes:
    """Shared shingles by weight, for :func:`similarity`: 32-bit keys, which are ample within a pair."""
    order = np.lexsort((keys, weights))
    values, n = np.unique(weights, return_counts=True)
    return np.int64(len(values)).tobytes() + values.astype(np.float64).tobytes() + n.astype(np.int64).tobytes() + (keys[order] & T.U64(0xFFFFFFFF)).astype(np.uint32).tobytes()


def partial_weights(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.bincount((keys >> T.U64(58)).astype(np.int64), weights, BINS).astype(np.float32)


def reaches(least: np.ndarray, total_a: np.ndarray, total_b: np.ndarray) -> np.ndarray:
    """Whether sets that share at most ``least`` may be as similar as SIMILARITY."""
    return least * (1 + 1e-4) >= SIMILARITY * (total_a + total_b - least)


def unpack_set(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    values, counts = np.frombuffer(blob, np.float64, n, 8), np.frombuffer(blob, np.int64, n, 8 + 8 * n)
    return np.frombuffer(blob, np.uint32, offset=8 + 16 * n), np.repeat(values, counts)


def similarity(a: bytes, b: bytes, total_a: float, total_b: float) -> float:
    """Weighted Jaccard similarity; totals hold all shingles, the sets those that others share."""
    (ka, wa), (kb, wb) = unpack_set(a), unpack_set(b)
    if len(ka) > len(kb):
        ka, wa, kb, wb = kb, wb, ka, wa
    order = np.argsort(kb)
    at = np.minimum(np.searchsorted(kb, ka, sorter=order), len(kb) - 1)
    same = kb[order[at]] == ka
    least = float(np.minimum(wa, wb[order[at]])[same].sum())
    return least / (total_a + total_b - least)


CANDIDATE = "doc_id bigint, digest binary, total double, shared binary, bins binary, bands array<bigint>"


def candidates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The texts that may have a partner, with their bands and weighted sets."""
    chunks = make_chunks(docs.where("doc_id IS NOT NULL"), scratch, most=CHUNK_BYTES)
    n = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    answers = count_keys(chunks, _keyer, bucket_bits(chunks, 0.15))

    def finish(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for _, ids, _, data, offsets, totals, _ in rows:
            sets = shingles(data, offsets)
            known = np.unique(np.concatenate([k for k, _ in sets]))
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, (keys, tf) in zip(ids, sets):
                if not len(keys):
                    continue
                df = totals[np.searchsorted(known, keys)]
                w = tf * idf(df, n)
                total, shared = float(w.sum()), df >= 2
                if float(w[shared].sum()) < SIMILARITY * total * (1 - 1e-9):
                    continue
                mark = T.mix(keys + T.mix(tf.astype(np.uint64)))
                digest = np.array([mark.sum(dtype=np.uint64), T.mix(mark ^ T.U64(0x5BD1E995)).sum(dtype=np.uint64)], np.uint64)
                alone = float(w[~shared].sum())
                k, v = (np.append(keys[shared], digest[0]), np.append(w[shared], alone)) if alone > 0 else (keys[shared], w[shared])
                for col, x in zip(out, (doc_id, digest.tobytes(), total, pack_set(keys[shared], w[shared]), partial_weights(keys[shared], w[shared]).tobytes(), icws(k, v).view(np.int64).tolist())):
                    col.append(x)
            kinds = (pa.int64(), pa.binary(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["doc_id", "digest", "total", "shared", "bins", "bands"])

    out = scratch.write(with_answers(chunks, answers, finish, CANDIDATE), "candidates")
    scratch.drop("chunks")
    return out


def verify(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, similarity of distinct pairs of representatives, those of at least SIMILARITY."""
    left = reps.select(F.col("rep").alias("a"), F.col("total").alias("total_a"), F.col("shared").alias("shared_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("total").alias("total_b"), F.col("shared").alias("shared_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb, sa, sb = (batch.column(c).to_pylist() for c in ("a", "b", "total_a", "total_b", "shared_a", "shared_b"))
            s = [similarity(*x) for x in zip(sa, sb, ta, tb)]
            keep = [i for i, x in enumerate(s) if x >= SIMILARITY]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array([s[i] for i in keep], pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint, similarity double")


def _pairs(x: F.Column, y: F.Column) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _hubs(members: DataFrame, seed: int) -> DataFrame:
    """Up to HUBS members of each bucket, by different hashes."""
    return members.groupBy("bucket").agg(F.array_distinct(F.array(*(F.min_by("rep", F.xxhash64("rep", F.lit(seed + i))) for i in range(HUBS)))).alias("hubs"))


def _cells(rest: DataFrame, reps: DataFrame, block: int, lone: F.Column, *more: str) -> DataFrame:
    """Members of each bucket, dealt to cells in which every ``lone`` one meets every member, sorted by cell.

    ``rest`` has (bucket, rep, label, main, n, out): ``out`` of the bucket's ``n`` members are ``lone``.  Blocks of about
    ``block`` of them meet blocks of about ``block`` members, so rows grow with n * out / block, not with the square of n.
    """
    ours, theirs = (F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int") for c in ("out", "n"))
    mark = F.xxhash64("rep")
    held = rest.join(reps.select("rep", "total", "bins", *more), "rep").withColumn("ours", ours).withColumn("theirs", theirs)
    some = held.where(lone).select("*", F.pmod(mark, "ours").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)).alias("j"), F.lit(True).alias("lone"))
    every = held.select("*", F.explode(F.sequence(F.lit(0), F.col("ours") - 1)).alias("i"), F.pmod(mark, "theirs").cast("int").alias("j"), F.lit(False).alias("lone"))
    cells = some.unionByName(every).select(F.xxhash64("bucket", "i", "j").alias("cell"), "bucket", "lone", "rep", "label", "total", "bins", *more)
    return cells.repartition("cell").sortWithinPartitions("cell", "rep")


def _bounds(group: pa.Table) -> Iterator[tuple]:
    """(lone members, members, bound of each pair, whether it may be a link) of a cell, by up to 16 lone ones."""
    lone, label, total = (group[c].to_numpy() for c in ("lone", "label", "total"))
    bins = np.frombuffer(b"".join(group["bins"].to_pylist()), np.float32).reshape(-1, BINS)
    mine, others = np.flatnonzero(lone), np.flatnonzero(~lone)
    for a in range(0, len(mine), 16):
        some = mine[a : a + 16]
        least = np.minimum(bins[some][:, None, :], bins[others][None]).sum(axis=2)
        bound = least / (total[some][:, None] + total[others][None] - least)
        yield some, others, bound, reaches(least, total[some][:, None], total[others][None]) & (label[some][:, None] != label[others][None])


def best_pairs(rest: DataFrame, reps: DataFrame, most: int) -> DataFrame:
    """bucket, rep, a, b, more: pairs (a, b) of a straggler ``rep`` with members of other labels whose bound reaches SIMILARITY.

    ``rest`` has (bucket, rep, label, main, n, out): ``main`` is the bucket's most frequent label, ``out`` the number
    of its ``n`` members with another (stragglers).  Of each straggler and block the ``most`` pairs with the highest
    bounds are given; ``more`` tells that there are others.  A pair of two stragglers is one of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "cell"):
            rep, bucket = group["rep"].to_numpy(), group["bucket"].to_numpy()
            for some, others, bound, ok in _bounds(group):
                best = np.argsort(np.where(ok, -bound, np.inf), axis=1, kind="stable")[:, :most]
                i, j = np.nonzero(np.take_along_axis(ok, best, axis=1))
                if len(i):
                    x, y = rep[some[i]], rep[others[best[i, j]]]
                    cols = [bucket[some[i]], x, np.minimum(x, y), np.maximum(x, y), ok.sum(axis=1)[i] > most]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "rep", "a", "b", "more"])

    return _cells(rest, reps, BLOCK, F.col("label") != F.col("main")).mapInArrow(run, "bucket bigint, rep bigint, a bigint, b bigint, more boolean")


def bounded_pairs(rest: DataFrame, reps: DataFrame) -> DataFrame:
    """All pairs (a, b) that :func:`best_pairs` takes from, once for each bucket."""
    return best_pairs(rest, reps, 1 << 30).select("bucket", "a", "b").distinct().drop("bucket")


def joining_links(rest: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, similarity of links that join the classes of ``open`` members with all classes of their bucket that they reach.

    ``rest`` is as for :func:`best_pairs`, with ``open`` and their number as ``out``.  All pairs that may be links
    are verified in their cell, the likeliest first, except between classes that it has joined by then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "cell"):
            rep, label, total, shared = *(group[c].to_numpy() for c in ("rep", "label", "total")), group["shared"]
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            found = []
            for some, others, bound, ok in _bounds(group):
                i, j = np.nonzero(ok)
                order = np.argsort(-bound[i, j], kind="stable")
                for x, y in zip(some[i[order]].tolist(), others[j[order]].tolist()):
                    p, q = root(int(label[x])), root(int(label[y]))
                    if p != q and (s := similarity(shared[x].as_py(), shared[y].as_py(), total[x], total[y])) >= SIMILARITY:
                        up[p] = q
                        found.append((min(rep[x], rep[y]), max(rep[x], rep[y]), s))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return _cells(rest, reps, INNER, F.col("open"), "shared").mapInArrow(run, "a bigint, b bigint, similarity double")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), group_size (documents of the class), links, kept.

    ``links`` is the number of verified links of the document's representative; in band buckets of over
    SMALL members links go through hubs or are those that join classes, so there it counts those, not all similar documents.
    """
    scratch = Scratch(docs.sparkSession, "near_dedup")
    cand = candidates(docs, scratch)
    reps = scratch.write(
        cand.groupBy("digest").agg(F.min(F.struct("doc_id", "total", "shared", "bins", "bands")).alias("m")).select("digest", F.col("m.doc_id").alias("rep"), "m.total", "m.shared", "m.bins", "m.bands"), "reps"
    )
    banded = reps.select("rep", "total", F.posexplode("bands").alias("band", "value")).select("rep", "total", F.xxhash64("band", "value").alias("bucket"))
    sizes = scratch.write(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    members = scratch.write(banded.join(sizes, "bucket"), "members")
    small, large = members.where(f"size <= {SMALL}"), members.where(f"size > {SMALL}")

    lists = small.groupBy("bucket").agg(F.collect_list("rep").alias("reps"))
    close = lists.select("bucket", F.explode("reps").alias("x"), "reps").select("x", F.explode("reps").alias("y")).where("x < y").select(*_pairs(F.col("x"), F.col("y")))
    hubs = scratch.write(_hubs(large, 1), "hubs1")
    starred = large.join(hubs, "bucket").select("rep", F.explode("hubs").alias("hub")).where("rep <> hub").select(*_pairs(F.col("rep"), F.col("hub")))
    tried = scratch.write(close.unionByName(starred).distinct(), "tried1")
    links = scratch.write(verify(tried, reps), "links1")

    if large.limit(1).count():
        # Buckets in which some members are not yet in the class that most of the bucket is in.
        labels = components(links, scratch, "cc1")
        labelled = large.join(labels, large["rep"] == labels["node"], "left").select("bucket", "rep", "total", F.coalesce("label", "rep").alias("label"))
        labelled = scratch.write(labelled, "labelled1")
        per = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        main = scratch.write(per.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels"), "main")
        open_ = labelled.drop("total").join(main, "bucket")
        hubs = scratch.write(_hubs(open_.where("label = main"), 101), "hubs2")
        again = open_.where("label <> main").join(hubs, "bucket").select("rep", F.explode("hubs").alias("hub")).select(*_pairs(F.col("rep"), F.col("hub"))).distinct()
        tried2 = scratch.write(again.join(tried, ["a", "b"], "left_anti"), "tried2")
        more = scratch.write(verify(tried2, reps), "links2")
        links = links.unionByName(more)

        # The rest: members of one bucket that are still in different classes.
        labels = components(more, scratch, "cc2", labels)
        rest = open_.select("bucket", "rep").join(labels, F.col("rep") == labels["node"], "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"))
        rest = scratch.write(rest, "labelled2")
        per = rest.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        apart = per.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("most < n")
        apart = scratch.write(apart.select("bucket", "main", "n", (F.col("n") - F.col("most")).alias("out")), "apart")
        rest = rest.join(apart, "bucket")
        best = scratch.write(best_pairs(rest, reps, MOST), "best")
        left = best.select("a", "b").distinct()
        tried3 = scratch.write(left.join(tried, ["a", "b"], "left_anti").join(tried2, ["a", "b"], "left_anti"), "tried3")
        more = scratch.write(verify(tried3, reps), "links3")
        links, labels = links.unionByName(more), components(more, scratch, "cc3", labels)

        # Stragglers with more such pairs, if they are not yet in what has become of their bucket's main class.
        open_ = best.where("more").select("bucket", "rep").distinct().withColumn("open", F.lit(True))
        now = rest.select("bucket", "rep", F.col("main").alias("was"), "n").join(open_, ["bucket", "rep"], "left")
        now = now.join(labels.toDF("rep", "label"), "rep", "left").join(labels.toDF("was", "main"), "was", "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"), F.coalesce("main", "was").alias("main"), "n", "open")
        now = scratch.write(now.withColumn("open", F.coalesce("open", F.lit(False)) & (F.col("label") != F.col("main"))), "labelled3")
        out = now.where("open").groupBy("bucket").agg(F.count(F.lit(1)).alias("out"))
        more = scratch.write(joining_links(now.join(out, "bucket"), reps).dropDuplicates(["a", "b"]), "links4")
        links, labels = links.unionByName(more), components(more, scratch, "cc4", labels)
    else:
        labels = components(links, scratch, "cc1")

    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    classes = reps.select("digest", "rep").join(labels, F.col("rep") == labels["node"], "left").join(degree, "rep", "left")
    classes = scratch.write(classes.select("digest", F.coalesce("label", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    # One row of ``classes`` per digest; Spark may split the documents' side where one digest is hot.
    of_docs = scratch.write(cand.select("doc_id", "digest").join(classes, "digest").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links")), "of_docs")
    sizes = scratch.write(of_docs.groupBy("class_id").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("first")), "class_sizes")
    found = of_docs.join(sizes, "class_id").select(F.col("doc_id").alias("__id"), F.col("first").alias("class_id"), "group_size", "links")
    ids = docs.select("doc_id")
    joined = ids.join(found, ids["doc_id"] == found["__id"], "left")
    return joined.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
        F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that a kept row of their class resembles; columns as they were.

    Of a class the row with the smallest doc_id stays.  Rows are told by doc_id and text, so of different texts
    under one doc_id each is judged by itself; rows that agree in both are kept or dropped together.  Rows with a
    null doc_id stay.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    scratch = Scratch(docs.sparkSession, "near_kept")
    names = scratch.write(docs.where("doc_id IS NOT NULL").select(row.alias("row"), F.col("doc_id").alias("id")).distinct(), "names")
    found = near_duplicates(docs.select(row.alias("doc_id"), "text")).where("group_size > 1").select(F.col("doc_id").alias("row"), "class_id").distinct()
    found = scratch.write(found.join(names, "row"), "found")
    first = found.groupBy("class_id").agg(F.min(F.struct("id", "row")).alias("m")).select("class_id", F.col("m.row").alias("first"))
    gone = found.join(first, "class_id").where("row <> first").select(F.col("row").alias("__gone"))
    marked = docs.withColumn("__row", row)
    return marked.join(gone, marked["__row"] == gone["__gone"], "left_anti").drop("__row")
