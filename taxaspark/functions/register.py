"""SQL names for the sequence functions, per session.

Plain ones are SQL functions, which Catalyst inlines; alignment and model scores are
Arrow-batched Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..kernels.align import semiglobal
from ..kernels.codec import decode_phmm
from ..kernels.phmm import forward
from .sequences import AMBIGUITY, COMPLEMENT, IUPAC

_REGEX = "upper(replace(s, ' ', ''))"
for _code, _bases in AMBIGUITY.items():
    _REGEX = f"replace({_REGEX}, '{_code}', '{_bases}')"

SQL_FUNCTIONS = {
    "dna_rc(s STRING) RETURNS STRING": f"reverse(translate(regexp_replace(upper(s), '[^{IUPAC}]', ''), '{IUPAC}', '{COMPLEMENT}'))",
    "dna_regex(s STRING) RETURNS STRING": _REGEX,
    "seq_md5(s STRING) RETURNS STRING": "md5(cast(s AS BINARY))",
    "phred_mean(q STRING) RETURNS DOUBLE": "aggregate(filter(split(q, ''), c -> c <> ''), 0D, (a, c) -> a + ascii(c) - 33) / length(q)",
    "ambiguous(s STRING) RETURNS INT": "length(regexp_replace(s, '[ACGT]', ''))",
    "n_share(s STRING) RETURNS DOUBLE": "(length(s) - length(replace(s, 'N', ''))) / length(s)",
    "kmers(s STRING, k INT) RETURNS ARRAY<STRING>": "CASE WHEN length(s) >= k THEN filter(transform(sequence(1, length(s) - k + 1), i -> substring(s, i, k)), x -> x RLIKE '^[ACGT]+$') ELSE array() END",
    "last_taxon(lineage STRING) RETURNS STRING": "element_at(split(lineage, '; '), -1)",
}


@F.pandas_udf("struct<score: double, first: int, last: int, head: int, tail: int>")
def align_motif(motif: pd.Series, seq: pd.Series) -> pd.DataFrame:
    """Semiglobal alignment of motif and sequence."""
    out = pd.DataFrame({"score": 0.0, "first": 1, "last": 0, "head": 0, "tail": 0}, index=range(len(seq)))
    motif, seq = motif.reset_index(drop=True), seq.fillna("").reset_index(drop=True)
    for m, at in motif.groupby(motif).groups.items():
        found = semiglobal(m, seq.loc[at].tolist())
        for c in out.columns:
            out.loc[at, c] = found[c].astype(float if c == "score" else int)
    return out


@F.pandas_udf("double")
def phmm_forward(model: pd.Series, seq: pd.Series) -> pd.Series:
    """Log P(sequence | packed model)."""
    out = pd.Series(0.0, index=range(len(seq)))
    model, seq = model.map(bytes).reset_index(drop=True), seq.fillna("").reset_index(drop=True)
    for m, at in model.groupby(model).groups.items():
        out.loc[at] = forward(decode_phmm(m), seq.loc[at].tolist())
    return out


def register(spark: SparkSession) -> list[str]:
    """Define all functions in the session; their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("align_motif", align_motif)
    spark.udf.register("phmm_forward", phmm_forward)
    return [h.split("(")[0] for h in SQL_FUNCTIONS] + ["align_motif", "phmm_forward"]
