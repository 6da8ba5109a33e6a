"""Sequence functions as column expressions: all run inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC nucleotide codes, their complements and the bases they stand for.
IUPAC = "ACGTMRWSYKVHDBNI"
COMPLEMENT = "TGCAKYWSRMBDHVNI"
AMBIGUITY = {
    "M": "[AC]",
    "R": "[AG]",
    "W": "[AT]",
    "S": "[CG]",
    "Y": "[CT]",
    "K": "[GT]",
    "V": "[ACG]",
    "H": "[ACT]",
    "D": "[AGT]",
    "B": "[CGT]",
    "N": "[ACGT]",
    "I": "[ACGT]",
}
# One-letter amino acid codes accepted as residues.
AMINO_ACIDS = "ABCDEFGHIKLMNPQRSTVWXYZ*-?"
DNA_LETTERS = "ACGTMRWSYKVHDBNI?-"

# Genetic codes by number, codons in the order TTT TTC TTA TTG TCT ... GGG.
GENETIC_CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}


def reverse_complement(seq: Column) -> Column:
    """Upper-case, drop what is no nucleotide code (gaps too), reverse and complement."""
    kept = F.regexp_replace(F.upper(seq), f"[^{IUPAC}]", "")
    return F.reverse(F.translate(kept, IUPAC, COMPLEMENT))


def rc(seq: str) -> str:
    """:func:`reverse_complement` of a literal."""
    kept = re.sub(f"[^{IUPAC}]", "", seq.upper())
    return kept.translate(str.maketrans(IUPAC, COMPLEMENT))[::-1]


def disambiguate(primer: str) -> str:
    """A primer as a regular expression: ambiguity codes become classes."""
    text = primer.replace(" ", "").upper()
    if re.search(f"[^{IUPAC}]", text):
        raise ValueError(f"not a nucleotide sequence: {primer}")
    return "".join(AMBIGUITY.get(c, c) for c in text)


def disambiguated(seq: Column) -> Column:
    """:func:`disambiguate` for a column; null where a residue is invalid."""
    text = F.upper(F.replace(seq, F.lit(" "), F.lit("")))
    out = text
    for code, bases in AMBIGUITY.items():
        out = F.replace(out, F.lit(code), F.lit(bases))
    return F.when(~text.rlike(f"[^{IUPAC}]"), out)


def to_dna(seq: Column) -> Column:
    """Upper case with I read as N."""
    return F.translate(F.upper(seq), "I", "N")


def seq_hash(seq: Column) -> Column:
    """MD5 of the residues, lowercase hex."""
    return F.md5(seq.cast("binary"))


def letters(text: Column) -> Column:
    """The characters of a string; none of an empty one."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def phred(qual: Column) -> Column:
    """Phred scores (0 to 93) of a quality string."""
    return F.transform(letters(qual), lambda c: F.ascii(c) - 33)


def from_phred(scores: Column) -> Column:
    """The quality string of an array of scores."""
    return F.array_join(F.transform(scores, lambda v: F.chr(v + 33)), "")


def mean_phred(qual: Column) -> Column:
    """Mean score, from the sum of the codes; null for an empty string."""
    n = F.length(qual)
    total = F.aggregate(F.split(qual, ""), F.lit(0), lambda a, c: a + F.ascii(c))
    return F.when(n > 0, (total - 33 * n).cast("double") / n)


def ambiguous_count(seq: Column) -> Column:
    """Residues other than A, C, G, T."""
    return F.length(F.regexp_replace(seq, "[ACGT]+", ""))


def n_fraction(seq: Column) -> Column:
    """Share of N; null for an empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, (n - F.length(F.replace(seq, F.lit("N"), F.lit("")))).cast("double") / n)


def strip_gaps(seq: Column) -> Column:
    return F.regexp_replace(seq, "[-?]", "")


def wrap(seq: Column, width: int) -> Column:
    """Line breaks after every ``width`` residues."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def is_dna(seq: Column) -> Column:
    return seq.rlike(f"^[{re.escape(DNA_LETTERS)}]*$")


def is_amino(seq: Column) -> Column:
    return seq.rlike(f"^[{re.escape(AMINO_ACIDS)}]*$")


def tax_id_of(name: Column) -> Column:
    """The number after the last ``|``; null if there is none."""
    return F.regexp_extract(name, r"^.*\|([0-9]+)$", 1).try_cast("int")


def sample_of(name: Column, all_named: Column) -> Column:
    """The text before the first ``_`` if all names have one, else ``sample1``."""
    return F.when(all_named, F.regexp_extract(name, "^([^_]*)", 1)).otherwise(F.lit("sample1"))


def study_of(name: Column) -> Column:
    """The study, the name's first four characters."""
    return F.substring(name, 1, 4)


def last_of(lineage: Column) -> Column:
    """The last element of a lineage joined by ``; ``."""
    return F.element_at(F.split(lineage, "; "), -1)


def translate_codons(seq: Column, code: int = 1, frame: int = 0) -> Column:
    """Amino acids of the codons from ``frame`` on; a codon with other letters than ACGT is X."""
    codons = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
    known = F.create_map(*(F.lit(x) for pair in zip(codons, GENETIC_CODES[code]) for x in pair))
    amino = lambda i: F.coalesce(F.element_at(known, F.substring(seq, i * 3 + frame + 1, F.lit(3))), F.lit("X"))
    n = F.floor((F.length(seq) - frame) / 3).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), amino), "")).otherwise(F.lit(""))


def kmers(seq: Column, k: int) -> Column:
    """All runs of k residues, in order, that hold only A, C, G, T."""
    n = F.length(seq) - k + 1
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))
    plain = seq.rlike("^[ACGT]*$")  # most sequences need no check of each run
    return F.when((n > 0) & plain, all_).when(n > 0, F.filter(all_, lambda x: x.rlike(f"^[ACGT]{{{k}}}$"))).otherwise(F.array().cast("array<string>"))


def lowest_ancestor(lineages: Column) -> Column:
    """Lowest common ancestor of an array of lineages (arrays, root first).

    As many of the first elements of the shortest lineage (on ties the first in order) as it has elements
    that all lineages share; lineages that part and meet again count what they share below as well.
    """
    guide = F.element_at(F.array_sort(F.transform(lineages, lambda x: F.struct(F.size(x).alias("n"), x.alias("x")))), 1)["x"]
    shared = F.aggregate(lineages, guide, lambda a, b: F.array_intersect(a, b))
    return F.slice(guide, 1, F.size(F.filter(guide, lambda x: F.array_contains(shared, x))))


def akaike_weights(scores: Column) -> Column:
    """exp(score - log sum exp) of an array of log likelihoods, shifted by the largest."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(scores, lambda x: F.exp(x - top) / total)


def score_string(weights: Column) -> Column:
    """Weights as percentages, one code point each."""
    return F.array_join(F.transform(weights, lambda w: F.chr(F.round(w * 100).cast("int"))), "")
