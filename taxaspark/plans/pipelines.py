"""The documented chains of operators.

Each step's rows are materialised in the cluster's checkpoint folder: predicates on computed
columns would else be pushed through all steps before, and their expressions multiply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import Classifier, classify
from ..operators.curate import purge, virtual_fish, virtual_pcr
from ..operators.learn import learn
from ..operators.taxonomy import kept
from ..operators.reads import demultiplex_pairs, quality_filter, stitch, tabulate, trim


def paired_reads_to_asvs(pairs: DataFrame, tags: dict[str, str], up: str, down: str, inner_up: str, inner_down: str | None = None, **limits) -> DataFrame:
    """Counts of clean sequences per sample: demultiplex, stitch, trim, filter, tabulate.

    Use the sinks to keep a step's reads as files.
    """
    split = kept(demultiplex_pairs(pairs, tags, up, down))
    joined = kept(stitch(split).join(split.select("ord", F.col("sample_id").alias("sample")), "ord"))
    cut = kept(trim(joined, inner_up, inner_down))
    return tabulate(quality_filter(cut, **limits))


def reference_classifier(seqs: DataFrame, taxonomy: DataFrame, up: str, down: str, level: str = "order", probe: str | None = None, **training) -> Classifier:
    """A classifier of reference sequences (ord, name, seq, tax_id, otu): in-silico PCR, a probe for what lacks primers, purging, learning."""
    found = kept(virtual_pcr(seqs, up, down, trim_primers=True)).drop("forscore", "revscore")
    if probe:
        missed = seqs.join(found.select("ord"), "ord", "left_anti")
        found = found.unionByName(virtual_fish(missed, probe, up=up, down=down).drop("score").select(found.columns))
    clean = kept(purge(found, taxonomy, level))
    return learn(clean.select(F.col("ord").alias("train"), "seq", F.col("tax_id").alias("taxID")), taxonomy, **training)


def classify_samples(counts: DataFrame, model: Classifier, **options) -> DataFrame:
    """Taxa of tabulated sequences (uid, seq, sample, n), with their counts."""
    unique = counts.groupBy("seq").agg(F.min("uid").alias("name")).withColumn("ord", F.xxhash64("seq")).withColumn("sample", F.lit("all"))
    taxa = classify(unique, model, **options).drop("ord")
    return counts.join(taxa.withColumnRenamed("representative", "uid"), "uid")


__all__ = ["classify_samples", "paired_reads_to_asvs", "reference_classifier"]
