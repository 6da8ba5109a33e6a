"""Taxon assignment: exact hash, then nearest neighbours, then descent through a tree of profile models.

A classifier is a set of tables: ``key`` (md5, taxID), ``training`` (train, seq, taxID),
``nodes`` (clade, parent, child, taxID, minscore, minlength, maxlength, ntotal, model) and
the taxonomy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import seq_hash, translate_codons
from ..kernels.codec import decode_phmm
from ..kernels.phmm import akaike, forward
from .kmers import nearest
from .taxonomy import ancestor_by, kept, levels, rank_of

RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]
#: a broadcast tree is at most this many bytes of packed models
TREE_BYTES = 512 << 20
#: why a descent ended (fixed values)
THRESHOLD, SCORE, SHORT, LONG, COUNT = 1, 2, 3, 4, 6


@dataclass
class Classifier:
    taxonomy: DataFrame
    key: DataFrame
    training: DataFrame
    nodes: DataFrame | None = None
    members: DataFrame | None = None
    k: int = 4
    numcode: int | None = None
    frame: int = 0
    remainder: int = 0

    def save(self, path: str) -> None:
        """One Parquet table each under ``path``."""
        for name in ("taxonomy", "key", "training", "nodes", "members"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        meta = [(self.k, self.numcode, self.frame, self.remainder)]
        self.key.sparkSession.createDataFrame(meta, "k int, numcode int, frame int, remainder int").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark, path: str, tree: bool = True) -> Classifier:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        meta = read("meta").first()
        return Classifier(read("taxonomy"), read("key"), read("training"), read("nodes") if tree else None, read("members") if tree else None, meta["k"], meta["numcode"], meta["frame"], meta["remainder"])


def build_key(training: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(md5, taxID): the lowest common ancestor of all sequences with one hash; only hashes of several taxa need lineages."""
    lin = levels(taxonomy).select("taxID", F.array_join(F.transform("lineage", lambda x: x["taxID"].cast("string")), "; ").alias("lineage"))
    taxa = training.select(seq_hash(F.col("seq")).alias("md5"), "taxID").groupBy("md5").agg(F.collect_set("taxID").alias("taxa"))
    single = taxa.where(F.size("taxa") == 1).select("md5", F.element_at("taxa", 1).cast("int").alias("taxID"))
    single = single.join(lin.select("taxID"), "taxID", "left_semi").select("md5", "taxID")
    rows = taxa.where(F.size("taxa") > 1).select("md5", F.explode("taxa").alias("taxID")).join(lin, "taxID")
    return single.unionByName(ancestor_by(rows, "md5").select("md5", F.element_at(F.split("ancestor", "; "), -1).cast("int").alias("taxID")))


def ping(unique: DataFrame, model: Classifier, threshold: float = 0.98, mincount: int = 5) -> DataFrame:
    """(uid, seq, taxID, exact): a taxID for sequences found by hash or by near neighbours, null for others.

    Neighbours are distinct training sequences, each with the taxon of its hash, so copies of one do not
    count several times towards ``mincount`` or the 50 nearest.
    """
    searched = 0 < threshold < 1
    key = kept(model.key) if searched else model.key  # read three times
    exact = unique.join(key.select(F.col("md5").alias("uid"), F.col("taxID").alias("hit")), "uid", "left")
    if not searched:
        return exact.select("uid", "seq", F.col("hit").alias("taxID"), F.col("hit").isNotNull().alias("exact"))
    known = exact.where("hit IS NOT NULL").select("uid", "seq", F.col("hit").alias("taxID"), F.lit(True).alias("exact"))
    misses = kept(exact.where("hit IS NULL").select("uid", "seq", "ord"))
    distinct = kept(model.training.groupBy("seq").agg(F.min("train").alias("train")))
    near = nearest(misses.select(F.col("ord").alias("query"), "seq"), distinct.select("train", "seq"), 50, model.k, within=1 - threshold)
    lin = levels(model.taxonomy).select("taxID", F.array_join(F.transform("lineage", lambda x: x["taxID"].cast("string")), "; ").alias("lineage"))
    hits = near.join(distinct.select("train", seq_hash(F.col("seq")).alias("md5")), "train").join(key, "md5").select("query", "train", "taxID")
    enough = hits.groupBy("query").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= mincount).select("query")
    ancestors = ancestor_by(hits.join(enough, "query", "left_semi").join(lin, "taxID"), "query")
    found = ancestors.select(F.col("query").alias("ord"), F.element_at(F.split("ancestor", "; "), -1).try_cast("int").alias("taxID"))
    return known.unionByName(misses.join(found, "ord", "left").select("uid", "seq", "taxID", F.lit(False).alias("exact")))


@dataclass
class _Node:
    clade: str
    taxID: int
    minscore: float
    minlength: int
    maxlength: int
    ntotal: int
    model: bytes
    aaleaf: bool = False


def descend_batch(children: dict[str, list[_Node]], seqs: list[str], threshold: float, decay: bool, mincount: int, offset: float, cache: dict, starts: list[tuple] | None = None) -> list[tuple]:
    """(taxID, score, path, weights, reason) of each sequence, level by level: all that stand at a node are scored together."""
    # taxID, weight, product, path, weights, reason; a second pass goes on from where the first one ended.
    state = [[1, 1.0, 1.0, "", [], 0] for _ in seqs] if starts is None else [[t, 1.0, 1.0, p, list(w), 0] for t, p, w in starts]
    front: dict[str, list[int]] = {}
    for r, s in enumerate(state):
        front.setdefault(s[3], []).append(r)
    while front:
        below: dict[str, list[int]] = {}
        for clade, rows in front.items():
            kids = children.get(clade)
            if not kids:
                continue
            scores = np.empty((len(rows), len(kids)))
            for c, kid in enumerate(kids):
                if kid.clade not in cache:
                    cache[kid.clade] = decode_phmm(kid.model)
                scores[:, c] = forward(cache[kid.clade], [seqs[r] for r in rows])
            weights = akaike(scores)
            best = weights.argmax(axis=1)
            for i, r in enumerate(rows):
                kid, w, s = kids[best[i]], float(weights[i, best[i]]), state[r]
                fits = {
                    THRESHOLD: (s[2] * w if decay else w) >= threshold,
                    SCORE: scores[i, best[i]] >= kid.minscore + offset,
                    SHORT: len(seqs[r]) >= kid.minlength,
                    LONG: len(seqs[r]) <= kid.maxlength,
                    COUNT: kid.ntotal >= mincount,
                }
                if not all(fits.values()):
                    s[5] = next(code for code, fine in fits.items() if not fine)
                    continue
                s[0], s[1], s[2] = kid.taxID, w, s[2] * w
                s[3] += kid.clade[-1]
                s[4].append(round(100 * w))
                if kid.aaleaf and starts is None:
                    s[5] = 100
                else:
                    below.setdefault(kid.clade, []).append(r)
        front = below
    return [(s[0], round(s[2] if decay else s[1], 4), s[3], s[4], s[5]) for s in state]


DESCENT = "uid string, taxID int, score double, path string, weights array<int>, reason int"


def descend(unique: DataFrame, model: Classifier, threshold: float = 0.8, decay: bool = False, mincount: int = 5, offset: float = 0) -> DataFrame:
    """(uid, taxID, score, path, weights, reason) of (uid, seq) by descent through the tree.

    Reasons: 0 a leaf, 1 threshold, 2 score, 3 and 4 length, 6 count, 8 and 9 not translatable.
    A tree of translated sequences takes the distinct translations first; what reaches one of
    its ends goes on from there with the DNA itself.  The packed size is checked before the broadcast.
    """
    spark, nodes = unique.sparkSession, model.nodes
    size = nodes.agg(F.coalesce(F.sum(F.octet_length("model")), F.lit(0)).alias("n")).first()["n"]
    if size > TREE_BYTES:
        raise ValueError(f"the tree has {size} bytes of models; split it by its first clades")
    rows = nodes.where("clade <> ''").select("clade", "taxID", "minscore", "minlength", "maxlength", "ntotal", "model", "aaleaf").collect()
    children: dict[str, list[_Node]] = {}
    for r in sorted(rows, key=lambda r: r["clade"]):
        children.setdefault(r["clade"][:-1], []).append(_Node(r["clade"], r["taxID"], r["minscore"], r["minlength"], r["maxlength"], r["ntotal"], bytes(r["model"]), r["aaleaf"]))
    sent = spark.sparkContext.broadcast(children)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                starts = list(zip(*(c.to_pylist() for c in part.columns[2:]))) if part.num_columns > 2 else None
                out = descend_batch(sent.value, part.column(1).to_pylist(), threshold, decay, mincount, offset, cache, starts)
                cols = list(zip(*out))
                kinds = (pa.int32(), pa.float64(), pa.string(), pa.list_(pa.int32()), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["uid", "taxID", "score", "path", "weights", "reason"])

    if model.numcode is None:
        return unique.select("uid", "seq").mapInArrow(run, DESCENT)
    amino = unique.select("uid", "seq", translate_codons(F.col("seq"), model.numcode, model.frame).alias("amino"))
    reason = F.when(F.length("seq") % 3 != model.remainder, 8).when(F.contains("amino", F.lit("*")), 9)
    failed = amino.where(reason.isNotNull()).select("uid", F.lit(1).alias("taxID"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<int>").alias("weights"), reason.alias("reason"))
    coding = amino.where(reason.isNull()).withColumn("aa", seq_hash(F.col("amino")))
    first = coding.select(F.col("aa").alias("uid"), F.col("amino").alias("seq")).distinct().mapInArrow(run, DESCENT).withColumnRenamed("uid", "aa")
    both = coding.select("uid", "seq", "aa").join(first, "aa").drop("aa")
    second = both.where("reason = 100").select("uid", "seq", "taxID", "path", "weights").mapInArrow(run, DESCENT)
    return failed.unionByName(both.where("reason <> 100").drop("seq")).unionByName(second)


def mask_species(rows: DataFrame, taxonomy: DataFrame, mode: str = "ping100", rank: str = "species") -> DataFrame:
    """Results at the lowest rank replaced by their parent, unless backed up as ``mode`` says.

    Only where most names of that rank look like binomials.  rows: taxID, score, exact.
    """
    if mode == "all":
        return rows
    if mode not in ("ping", "ping100", "none"):
        raise ValueError(f"species: {mode}")
    low = taxonomy.where(F.col("rank") == rank)
    share = low.agg((F.sum(F.col("name").rlike("[a-z][ _][a-z]").cast("int")) / (F.count(F.lit(1)) + 1)).alias("s")).first()["s"]
    if not share or share <= 0.5:
        return rows
    spared = {"ping": F.col("score").isNull(), "ping100": F.col("exact"), "none": F.lit(False)}[mode]
    lin = levels(taxonomy).select("taxID", F.when(F.size("lineage") > 1, F.element_at("lineage", -2)["taxID"]).otherwise(F.col("taxID")).alias("__up"))
    flagged = low.select("taxID", F.lit(True).alias("__low"))
    out = rows.join(flagged, "taxID", "left").join(lin, "taxID", "left")
    change = F.coalesce("__low", F.lit(False)) & ~F.coalesce(spared, F.lit(False))
    return out.withColumn("taxID", F.when(change, F.col("__up")).otherwise(F.col("taxID"))).drop("__low", "__up")


def score_text(weights: str) -> F.Column:
    """Percentages as one code point each."""
    return F.array_join(F.transform(weights, lambda w: F.chr(w)), "")


def rollup(results: DataFrame, by: str = "taxID") -> DataFrame:
    """One row per taxon: the first row's descriptive columns and the sums of the count columns (whole numbers but ``by`` and ``ord``)."""
    counts = [c for c, t in results.dtypes if t in ("int", "bigint") and c not in (by, "ord")]
    rest = [c for c in results.columns if c not in (by, "ord", *counts)]
    return results.groupBy(by).agg(*[F.min_by(c, "ord").alias(c) for c in rest], *[F.sum(c).alias(c) for c in counts])


def classify(
    reads: DataFrame,
    model: Classifier,
    threshold: float = 0.8,
    decay: bool = False,
    ping_at: float = 0.98,
    mincount: int = 5,
    offset: float = 0,
    ranks: list[str] | None = None,
    species: str = "ping100",
    tabulize: bool = False,
    metadata: bool = False,
) -> DataFrame:
    """One row per read (ord, representative, taxID, taxon, rank, score, ranks...), or per unique sequence with counts per sample.

    ``metadata`` adds path, scores, reason (-1 for a ping) and the nearest training sequence's
    NNtaxID, NNtaxon, NNrank and NNdistance.

    Work is done once per unique sequence: hash join, neighbours for the misses, descent for
    what is still open, then lineage columns; reads are joined back at the end.
    """
    ranks = RANKS if ranks is None else ranks
    hashed = reads.withColumn("uid", seq_hash(F.col("seq")))
    unique = hashed.groupBy("uid").agg(F.min_by("seq", "ord").alias("seq"), F.min("ord").alias("ord"))
    if ping_at > 0:
        pinged = ping(unique, model, ping_at, mincount)
    else:
        pinged = unique.select("uid", "seq", F.lit(None).cast("int").alias("taxID"), F.lit(False).alias("exact"))
    blank = [F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<int>").alias("weights")]
    if model.nodes is None:
        miss = F.col("taxID").isNull()
        results = pinged.select("uid", F.coalesce("taxID", F.lit(1)).alias("taxID"), F.when(miss, F.lit(1.0)).alias("score"), "exact", *blank, F.when(miss, 0).otherwise(-1).alias("reason"))
    elif ping_at <= 0:
        results = descend(pinged, model, threshold, decay, mincount, offset).select("uid", "taxID", "score", F.lit(False).alias("exact"), "path", "weights", "reason")
    else:
        hits = pinged.where("taxID IS NOT NULL").select("uid", "taxID", F.lit(None).cast("double").alias("score"), "exact", *blank, F.lit(-1).alias("reason"))
        open_ = descend(pinged.where("taxID IS NULL"), model, threshold, decay, mincount, offset)
        results = hits.unionByName(open_.select("uid", "taxID", "score", F.lit(False).alias("exact"), "path", "weights", "reason"))
    results = mask_species(results, model.taxonomy, species, (ranks or ["species"])[-1])
    lin = levels(model.taxonomy)
    last = F.element_at("lineage", -1)
    named = results.join(lin, "taxID", "left").select("uid", "taxID", last["name"].alias("taxon"), last["rank"].alias("rank"), "score", *[rank_of(F.col("lineage"), r).alias(r) for r in ranks], *(["path", score_text("weights").alias("scores"), "reason"] if metadata else []))
    if metadata:
        near = nearest(unique.select(F.col("ord").alias("query"), "seq"), model.training.select("train", "seq"), 1, model.k)
        taxon = near.join(model.training.select("train", F.col("taxID").alias("NNtaxID")), "train").join(lin.withColumnRenamed("taxID", "NNtaxID"), "NNtaxID", "left")
        taxon = taxon.select(F.col("query").alias("ord"), "NNtaxID", last["name"].alias("NNtaxon"), last["rank"].alias("NNrank"), F.round("distance", 4).alias("NNdistance"))
        named = named.join(unique.select("uid", "ord").join(taxon, "ord", "left").drop("ord"), "uid", "left")
    if tabulize:
        counts = hashed.groupBy("uid", "sample").agg(F.count(F.lit(1)).alias("n"))
        return counts.join(named, "uid")
    return hashed.select("ord", F.col("name").alias("representative"), "uid").join(named, "uid").drop("uid")
