"""Registered queries over the stand-in views, and the same in SQL.

Each query runs one operator over the whole tables.  Operators that SQL cannot express
(alignment, profile models, clustering) have no SQL and are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequences as S
from .kernels import codec, phmm
from .operators import classify as C
from .operators import curate as U
from .operators import kmers as K
from .operators import learn as L
from .operators import reads as R
from .operators import taxonomy as T
from .plans import fixtures as X
from .sources import fastx, ncbi

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


V = X.with_views


# --- scalar functions -------------------------------------------------------------------


@query(V("SELECT ord, md5(seq) AS md5 FROM reads"))
def q_md5_hash(spark: SparkSession, sf: str) -> DataFrame:
    return X.reads(spark, sf).select("ord", S.seq_hash(F.col("seq")).alias("md5"))


@query(V(f"SELECT ord, {X.rc_sql('seq')} AS rc, reverse(qual) AS qual FROM reads_ambig"))
def q_revcomp(spark: SparkSession, sf: str) -> DataFrame:
    r = X.reads(spark, sf, X.AMBIGUOUS)
    return r.select("ord", S.reverse_complement(F.col("seq")).alias("rc"), F.reverse("qual").alias("qual"))


@query(V("SELECT ord, CAST(length(regexp_replace(seq, '[^N]', '', 'g')) AS BIGINT) AS n, replace(seq, 'N', '[ACGT]') AS pattern FROM reads_ambig"))
def q_disambiguate_count(spark: SparkSession, sf: str) -> DataFrame:
    r = X.reads(spark, sf, X.AMBIGUOUS)
    return r.select("ord", F.regexp_count("seq", F.lit("N")).cast("bigint").alias("n"), S.disambiguated(F.col("seq")).alias("pattern"))


@query(V("SELECT ord, round(list_avg(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)), 6) AS mean_phred FROM reads"))
def q_phred_mean(spark: SparkSession, sf: str) -> DataFrame:
    return X.reads(spark, sf).select("ord", F.round(S.mean_phred(F.col("qual")), 6).alias("mean_phred"))


@query(V("SELECT ord, qual, CAST(list_min(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS BIGINT) AS least FROM reads"))
def q_phred_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    scores = S.phred(F.col("qual"))
    return X.reads(spark, sf).select("ord", S.from_phred(scores).alias("qual"), F.array_min(scores).cast("bigint").alias("least"))


@query(V("SELECT ord, CAST(length(regexp_replace(seq, '[ACGT]', '', 'g')) AS BIGINT) AS ambigs FROM reads_ambig"))
def q_ambig_count(spark: SparkSession, sf: str) -> DataFrame:
    return X.reads(spark, sf, X.AMBIGUOUS).select("ord", S.ambiguous_count(F.col("seq")).cast("bigint").alias("ambigs"))


@query(V("SELECT ord, round(CAST(length(seq) - length(replace(seq, 'N', '')) AS DOUBLE) / length(seq), 6) AS n_share FROM reads_ambig"))
def q_nfraction(spark: SparkSession, sf: str) -> DataFrame:
    return X.reads(spark, sf, X.AMBIGUOUS).select("ord", F.round(S.n_fraction(F.col("seq")), 6).alias("n_share"))


@query(V("SELECT ord, TRY_CAST(regexp_extract(name, '^.*\\|([0-9]+)$', 1) AS INTEGER) AS tax_id, substr(name, 1, 4) AS study, regexp_extract(name, '^([^|]*)', 1) AS accession FROM refseqs"))
def q_parse_names(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name")
    return X.refseqs(spark, sf).select("ord", S.tax_id_of(n).alias("tax_id"), S.study_of(n).alias("study"), F.regexp_extract(n, r"^([^|]*)", 1).alias("accession"))


@query(V("SELECT ord, CASE WHEN (SELECT bool_and(contains(name, '_')) FROM reads) THEN regexp_extract(name, '^([^_]*)', 1) ELSE 'sample1' END AS sample FROM reads"))
def q_sample_names(spark: SparkSession, sf: str) -> DataFrame:
    r = X.reads(spark, sf)
    every = r.agg(F.bool_and(F.contains("name", F.lit("_"))).alias("every"))
    return r.crossJoin(F.broadcast(every)).select("ord", S.sample_of(F.col("name"), F.col("every")).alias("sample"))  # one row


@query(
    V(
        f"SELECT ord, coalesce(array_to_string(list_transform(range(length(seq) // 3), lambda i: CASE WHEN regexp_matches(substr(seq, CAST(3 * i + 1 AS BIGINT), 3), '^[ACGT]{{3}}$') THEN "
        f"substr('{S.GENETIC_CODES[5]}', CAST((instr('TCAG', substr(seq, CAST(3 * i + 1 AS BIGINT), 1)) - 1) * 16 + (instr('TCAG', substr(seq, CAST(3 * i + 2 AS BIGINT), 1)) - 1) * 4 + instr('TCAG', substr(seq, CAST(3 * i + 3 AS BIGINT), 1)) AS BIGINT), 1) ELSE 'X' END), ''), '') AS amino FROM reads_ambig"
    )
)
def q_translate_aa(spark: SparkSession, sf: str) -> DataFrame:
    return X.reads(spark, sf, X.AMBIGUOUS).select("ord", S.translate_codons(F.col("seq"), 5).alias("amino"))


@query(V("SELECT ord, regexp_replace(seq, '.*(AC[AT].+G[CT]A).*', '\\1') AS seq FROM reads"))
def q_regex_amplicon(spark: SparkSession, sf: str) -> DataFrame:
    return U.exact_region(X.reads(spark, sf), "ACW", "GYA", rcdown=False).select("ord", "seq")


@query(V("SELECT ord, regexp_replace(replace(seq, 'N', '-'), '[-?]', '', 'g') AS seq FROM reads_ambig"))
def q_gapstrip(spark: SparkSession, sf: str) -> DataFrame:
    return X.reads(spark, sf, X.AMBIGUOUS).select("ord", S.strip_gaps(F.replace("seq", F.lit("N"), F.lit("-"))).alias("seq"))


@query(V(r"SELECT ord, regexp_matches(seq, '^[ACGTMRWSYKVHDBNI?-]*$') AS dna, regexp_matches(qual, '^[ACGTMRWSYKVHDBNI?-]*$') AS qual_dna, regexp_matches(seq, '^[ABCDEFGHIKLMNPQRSTVWXYZ*?-]*$') AS amino FROM reads"))
def q_is_dna(spark: SparkSession, sf: str) -> DataFrame:
    return X.reads(spark, sf).select("ord", S.is_dna(F.col("seq")).alias("dna"), S.is_dna(F.col("qual")).alias("qual_dna"), S.is_amino(F.col("seq")).alias("amino"))


@query(V("SELECT ord, '>' || name || chr(10) || array_to_string(regexp_extract_all(seq, '.{1,50}'), chr(10)) AS value FROM reads"))
def q_wrap(spark: SparkSession, sf: str) -> DataFrame:
    r = X.reads(spark, sf)
    return r.select("ord", F.concat(F.lit(">"), "name", F.lit("\n"), S.wrap(F.col("seq"), 50)).alias("value"))


@query(V("SELECT ord, translate(upper(seq), 'I', 'N') AS dna, encode(seq) = encode(upper(seq)) AS same FROM reads_ambig"))
def q_char_codes(spark: SparkSession, sf: str) -> DataFrame:
    return X.reads(spark, sf, X.AMBIGUOUS).select("ord", S.to_dna(F.col("seq")).alias("dna"), (F.col("seq").cast("binary") == F.upper("seq").cast("binary")).alias("same"))


# --- filters, dereplication, tabulation ------------------------------------------------

_QFILTER = """
q0 AS (SELECT *, list_avg(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS mq, length(regexp_replace(seq, '[ACGT]', '', 'g')) AS na FROM reads_ambig),
q1 AS (SELECT * FROM q0 WHERE length(seq) >= {lo} AND length(seq) <= {hi} AND mq >= {q} AND na <= {a}),
q2 AS (SELECT *, count(*) OVER (PARTITION BY seq) AS times FROM q1)"""


@query(V(" SELECT ord, name, seq FROM q2 WHERE times >= 2", _QFILTER.format(lo=50, hi=500, q=30, a=0)))
def q_qfilter_default(spark: SparkSession, sf: str) -> DataFrame:
    return R.quality_filter(X.reads(spark, sf, X.AMBIGUOUS)).select("ord", "name", "seq")


@query(V(" SELECT ord, name, seq FROM q2 WHERE times >= 3", _QFILTER.format(lo=100, hi=120, q=32, a=1)))
def q_qfilter_strict(spark: SparkSession, sf: str) -> DataFrame:
    return R.quality_filter(X.reads(spark, sf, X.AMBIGUOUS), 32, 1, 3, 100, 120).select("ord", "name", "seq")


@query(V(" SELECT ord, name, seq FROM q1", _QFILTER.format(lo=0, hi=1000, q=31, a=1000)))
def q_qfilter_nullsteps(spark: SparkSession, sf: str) -> DataFrame:
    return R.quality_filter(X.reads(spark, sf, X.AMBIGUOUS), 31, None, None, None, None).select("ord", "name", "seq")


@query(V("SELECT ord, name FROM reads WHERE regexp_matches(seq, 'ACGT') AND length(seq) > 60"))
def q_subset(spark: SparkSession, sf: str) -> DataFrame:
    return R.subset(X.reads(spark, sf), F.col("seq").rlike("ACGT") & (F.length("seq") > 60)).select("ord", "name")


@query(V("SELECT md5(seq) AS uid, min(ord) AS ord, CAST(count(*) AS DOUBLE) AS weight, count(*) AS n FROM reads GROUP BY seq"))
def q_dereplicate(spark: SparkSession, sf: str) -> DataFrame:
    return R.dereplicate(X.reads(spark, sf))[0].select("uid", "ord", "weight", "n")


@query(V("SELECT ord, name, seq, 1.0::DOUBLE AS weight FROM reads"))
def q_rereplicate_weights(spark: SparkSession, sf: str) -> DataFrame:
    return R.rereplicate(*R.dereplicate(X.reads(spark, sf)))


@query(V("SELECT ord, name, seq FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ord) AS k FROM reads) WHERE k = 1"))
def q_unique_first(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_occurrences(X.reads(spark, sf)).select("ord", "name", "seq")


@query(V("SELECT ord, dense_rank() OVER (ORDER BY f) AS pointer, ord <> f AS duplicated FROM (SELECT ord, min(ord) OVER (PARTITION BY seq) AS f FROM reads)"))
def q_duplicated_pointers(spark: SparkSession, sf: str) -> DataFrame:
    return R.pointers(X.reads(spark, sf)).select("ord", "pointer", "duplicated")


@query(V("SELECT md5(seq) AS uid, sample, count(*) AS n FROM reads GROUP BY seq, sample"))
def q_tabulize(spark: SparkSession, sf: str) -> DataFrame:
    return R.tabulate(X.reads(spark, sf)).select("uid", "sample", "n")


@query(V("SELECT md5(seq) AS uid, count(*) FILTER (WHERE sample = 'src0') AS src0, count(*) FILTER (WHERE sample = 'src1') AS src1 FROM reads GROUP BY seq"))
def q_tabulize_wide(spark: SparkSession, sf: str) -> DataFrame:
    return R.pivot_samples(R.tabulate(X.reads(spark, sf)), ["src0", "src1"]).select("uid", "src0", "src1")


@query(V("SELECT ord, seq FROM reads UNION ALL SELECT ord, seq FROM refseqs"))
def q_join_union(spark: SparkSession, sf: str) -> DataFrame:
    return R.join_sets(X.reads(spark, sf).drop("name"), X.refseqs(spark, sf).drop("name"))


@query("SELECT l_returnflag AS sample, CAST(l_partkey % 16 AS BIGINT) AS asv, count(*) AS n FROM lineitem GROUP BY ALL")
def q_abundance_long(spark: SparkSession, sf: str) -> DataFrame:
    li = X.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), (F.col("l_partkey") % 16).alias("asv"))
    wide = li.groupBy("sample").pivot("asv", list(range(16))).count().na.fill(0)
    return R.from_abundance(wide).where("n > 0").select("sample", F.col("seq").cast("bigint").alias("asv"), "n")


@query(V("SELECT ord, 'S' || row_number() OVER (ORDER BY ord) AS name, seq FROM reads"))
def q_named(spark: SparkSession, sf: str) -> DataFrame:
    return R.named(X.reads(spark, sf).select("ord", "seq")).select("ord", "name", "seq")


@query(V("SELECT ord, name, seq AS r1, qual AS q1, reverse(seq) AS r2, qual AS q2, ord % 3 <> 2 AS names_agree FROM reads"))
def q_pair_mates(spark: SparkSession, sf: str) -> DataFrame:
    r = X.reads(spark, sf).select("ord", "name", "seq", "qual")
    tail = F.when(F.col("ord") % 3 == 0, F.substring("name", -1, 1)).when(F.col("ord") % 3 == 1, F.lit("x")).otherwise(F.lit("xyz"))
    return R.pair_mates(r, r.select("ord", F.concat(F.expr("substring(name, 1, length(name) - 1)"), tail).alias("name"), F.reverse("seq").alias("seq"), "qual"))


# --- taxonomy --------------------------------------------------------------------------

_LINEAGE = """
up AS (
    SELECT taxID, taxID AS node, 0 AS d FROM taxonomy
    UNION ALL SELECT u.taxID, t.parent_taxID, d + 1 FROM up u JOIN taxonomy t ON u.node = t.taxID WHERE t.parent_taxID <> 0),
lineages AS (
    SELECT u.taxID, string_agg(t.name, '; ' ORDER BY d DESC) AS lineage, string_agg(CAST(t.taxID AS VARCHAR), '; ' ORDER BY d DESC) AS numbers
    FROM up u JOIN taxonomy t ON u.node = t.taxID GROUP BY u.taxID)"""


@query(V(" SELECT taxID, d AS distance, node AS anc_taxID FROM up", _LINEAGE))
def q_taxonomy_closure(spark: SparkSession, sf: str) -> DataFrame:
    return T.closure(X.taxonomy(spark, sf)).select("taxID", "distance", "anc_taxID")


@query(V(" SELECT taxID, lineage FROM lineages UNION ALL SELECT -5, NULL", _LINEAGE))
def q_lineage(spark: SparkSession, sf: str) -> DataFrame:
    tax = X.taxonomy(spark, sf)
    unknown = spark.createDataFrame([(-5,)], "taxID int")
    return T.lineage(tax.select("taxID").unionByName(unknown), tax)


@query(V(" SELECT taxID, numbers AS lineage FROM lineages", _LINEAGE))
def q_lineage_numbers(spark: SparkSession, sf: str) -> DataFrame:
    tax = X.taxonomy(spark, sf)
    return T.lineage(tax.select("taxID"), tax, numbers=True)


@query(
    V(
        " SELECT u.taxID, " + ", ".join(f"coalesce(max(t.name) FILTER (WHERE t.rank = '{r}'), '') AS \"{r}\"" for r in ("kingdom", "phylum", "order", "genus", "species")) + " FROM up u JOIN taxonomy t ON u.node = t.taxID GROUP BY u.taxID",
        _LINEAGE,
    )
)
def q_rank_columns(spark: SparkSession, sf: str) -> DataFrame:
    tax = X.taxonomy(spark, sf)
    return T.rank_columns(tax.select("taxID"), tax, ["kingdom", "phylum", "order", "genus", "species"])


@query(V(" SELECT lineage, taxID FROM lineages WHERE lineage LIKE '% sp%'", _LINEAGE))
def q_taxid_unique(spark: SparkSession, sf: str) -> DataFrame:
    tax = X.taxonomy(spark, sf)
    asked = T.lineage(tax.where("rank = 'species'").select("taxID"), tax).select("lineage")
    return T.tax_ids(asked, tax)


@query(V(" SELECT lineage, taxID FROM lineages JOIN taxonomy USING (taxID) WHERE rank = 'genus' UNION ALL SELECT 'root; building', -1", _LINEAGE))
def q_taxid_homonym(spark: SparkSession, sf: str) -> DataFrame:
    tax = X.taxonomy(spark, sf)
    asked = T.lineage(tax.where("rank = 'genus'").select("taxID"), tax).select("lineage")
    return T.tax_ids(asked.unionByName(spark.createDataFrame([("root; building",)], "lineage string")), tax, multimatch=-1)


@query(V(" SELECT * FROM taxonomy WHERE taxID IN (SELECT node FROM up WHERE taxID IN (SELECT taxID FROM taxonomy WHERE rank = 'species' AND name LIKE 'machinery%'))", _LINEAGE))
def q_prune_keep(spark: SparkSession, sf: str) -> DataFrame:
    tax = X.taxonomy(spark, sf)
    return T.prune(tax, tax.where("rank = 'species' AND name LIKE 'machinery%'").select("taxID"))


@query(V(" SELECT * FROM taxonomy WHERE taxID NOT IN (SELECT taxID FROM up WHERE node IN (11, 101))", _LINEAGE))
def q_prune_drop(spark: SparkSession, sf: str) -> DataFrame:
    return T.prune(X.taxonomy(spark, sf), spark.createDataFrame([(11,), (101,)], "taxID int"), keep=False)


_NAMES = "name_rows AS (SELECT taxID, name, 'scientific name' AS kind FROM taxonomy UNION ALL SELECT taxID, upper(name) || ' syn', 'synonym' FROM taxonomy WHERE rank = 'genus')"


def _dumps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    tax = X.taxonomy(spark, sf)
    names = tax.select("taxID", "name", F.lit("scientific name").alias("kind")).unionByName(tax.where("rank = 'genus'").select("taxID", F.concat(F.upper("name"), F.lit(" syn")).alias("name"), F.lit("synonym").alias("kind")))
    return tax.select("taxID", F.when(F.col("taxID") == 1, 1).otherwise(F.col("parent_taxID")).alias("parent_taxID"), "rank"), names


@query(V(" SELECT taxID, parent_taxID, rank, n.name FROM taxonomy t JOIN name_rows n USING (taxID) WHERE kind = 'scientific name'", _NAMES))
def q_taxdump_merge(spark: SparkSession, sf: str) -> DataFrame:
    return T.from_dumps(*_dumps(spark, sf))


@query(V(" SELECT taxID, parent_taxID, rank, n.name FROM taxonomy t JOIN name_rows n USING (taxID)", _NAMES))
def q_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    return T.from_dumps(*_dumps(spark, sf), synonyms=True)


_RDP = """
rdp AS (SELECT c_custkey AS ord, 'Root;' || r_name || ';' || n_name || ';' || c_mktsegment AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
parts AS (SELECT ord, string_split(path, ';') AS p FROM rdp),
levels AS (SELECT ord, d, array_to_string(p[1:d], ';') AS path, array_to_string(p[1:d - 1], ';') AS up, p[d] AS name FROM parts, range(1, 5) r(d)),
taxa AS (SELECT d, path, up, name, min(ord) AS first FROM levels GROUP BY ALL),
numbered AS (SELECT *, CAST(row_number() OVER (ORDER BY d, first, path) AS INTEGER) AS taxID FROM taxa)"""


@query(V(" SELECT n.taxID, coalesce(u.taxID, 0) AS parent_taxID, 'rank' || n.d AS rank, n.name FROM numbered n LEFT JOIN numbered u ON n.up = u.path", _RDP))
def q_rdp_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (X.table(spark, sf, t) for t in ("customer", "nation", "region"))
    full = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    names = full.select(F.col("c_custkey").alias("ord"), F.concat("c_name", F.lit("\tRoot;"), "r_name", F.lit("; "), "n_name", F.lit(";"), "c_mktsegment", F.lit(";")).alias("name"))
    return T.rdp_taxonomy(names, 4)


_LCA = (
    _LINEAGE
    + """,
by_hash AS (SELECT DISTINCT md5(seq) AS md5, numbers FROM refseqs JOIN lineages ON tax_id = taxID),
guides AS (SELECT md5, string_split(numbers, '; ') AS g FROM by_hash QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY len(string_split(numbers, '; ')), string_split(numbers, '; ')) = 1),
sizes AS (SELECT md5, count(*) AS n FROM by_hash GROUP BY md5),
elements AS (SELECT DISTINCT md5, numbers, unnest(string_split(numbers, '; ')) AS v FROM by_hash),
shared AS (SELECT md5, v FROM elements JOIN sizes USING (md5) GROUP BY md5, v, n HAVING count(*) = n),
depth AS (SELECT md5, count(*) AS a FROM (SELECT md5, unnest(g) AS v FROM guides) JOIN shared USING (md5, v) GROUP BY md5),
hash_key AS (SELECT md5, array_to_string(g[1:a], '; ') AS ancestor FROM guides JOIN depth USING (md5))"""
)


@query(V(" SELECT md5, ancestor FROM hash_key", _LCA))
def q_lca_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    tax = X.taxonomy(spark, sf)
    lin = T.lineage(tax.select("taxID"), tax, numbers=True)
    rows = X.refseqs(spark, sf).join(lin, F.col("tax_id") == lin["taxID"]).select(S.seq_hash(F.col("seq")).alias("md5"), "lineage")
    return T.ancestor_by(rows, "md5")


_PURGE = (
    _LINEAGE
    + """,
order_of AS (SELECT u.taxID, max(t.name) FILTER (WHERE t.rank = 'order') AS taxon FROM up u JOIN taxonomy t ON u.node = t.taxID GROUP BY u.taxID),
named AS (SELECT name, otu, coalesce(taxon, '') AS taxon FROM refseqs LEFT JOIN order_of ON tax_id = taxID),
votes AS (SELECT DISTINCT otu, substr(name, 1, 4) || taxon AS vote, taxon FROM named),
tally AS (SELECT otu, taxon, count(*) AS n FROM votes GROUP BY ALL),
per_otu AS (SELECT otu, sum(n) AS nstudies, count(*) AS taxa, max(n) AS most FROM tally GROUP BY otu),
members AS (SELECT otu, count(*) AS members FROM named GROUP BY otu),
leaders AS (SELECT otu, count(*) AS leaders, max(taxon) AS suggested FROM tally JOIN per_otu USING (otu) WHERE n = most GROUP BY otu),
flagged AS (
    SELECT name, taxon AS listed, suggested, round(CAST(most AS DOUBLE) / nstudies, 6) AS confidence, CAST(nstudies AS BIGINT) AS nstudies
    FROM named JOIN per_otu USING (otu) JOIN members USING (otu) JOIN leaders USING (otu)
    WHERE members > 2 AND taxa > 1 AND leaders = 1 AND CAST(most AS DOUBLE) / nstudies >= 0.5 AND taxon <> suggested)"""
)


@query(V(" SELECT * FROM flagged", _PURGE))
def q_purge_flags(spark: SparkSession, sf: str) -> DataFrame:
    return U.flag_mislabelled(X.refseqs(spark, sf), X.taxonomy(spark, sf), "order", 0.5).withColumn("confidence", F.round("confidence", 6))


@query(V(" SELECT ord, name FROM refseqs WHERE name NOT IN (SELECT name FROM flagged)", _PURGE))
def q_purge_kept(spark: SparkSession, sf: str) -> DataFrame:
    return U.purge(X.refseqs(spark, sf), X.taxonomy(spark, sf), "order", 0.5).select("ord", "name")


@query(V(" SELECT taxID AS was, CASE WHEN rank = 'species' AND taxID % 2 = 0 THEN parent_taxID ELSE taxID END AS taxID FROM taxonomy"))
def q_species_mask(spark: SparkSession, sf: str) -> DataFrame:
    tax = X.taxonomy(spark, sf)
    rows = tax.select("taxID", F.col("taxID").alias("was"), F.lit(0.9).alias("score"), (F.col("taxID") % 2 == 1).alias("exact"))
    return C.mask_species(rows, tax).select("was", "taxID")


# --- trimming, demultiplexing, stitching -------------------------------------------------

_UP, _DOWN_RC = S.disambiguate(X.UP), S.disambiguate(S.rc(X.DOWN))
_TRIM = f"""
there AS (SELECT ord, regexp_matches(trim_seq, '{_UP}.+{_DOWN_RC}') AS ok, trim_seq, trim_qual FROM amplicons),
turned AS (SELECT ord, NOT ok AS reversed, CASE WHEN ok THEN trim_seq ELSE {X.rc_sql('trim_seq')} END AS s, CASE WHEN ok THEN trim_qual ELSE reverse(trim_qual) END AS q FROM there),
hit AS (SELECT *, regexp_extract(s, '{_UP}.+{_DOWN_RC}') AS m FROM turned WHERE regexp_matches(s, '{_UP}.+{_DOWN_RC}')),
cut AS (SELECT ord, reversed, substr(s, instr(s, m) + {len(X.UP)}, length(m) - {len(X.UP) + len(X.DOWN)}) AS seq, substr(q, instr(s, m) + {len(X.UP)}, length(m) - {len(X.UP) + len(X.DOWN)}) AS qual FROM hit)"""


@query(V(" SELECT ord, reversed, seq, qual FROM cut WHERE length(seq) >= 51", X.AMPLICONS_SQL, _TRIM))
def q_trim_both_orient(spark: SparkSession, sf: str) -> DataFrame:
    a = X.amplicons(spark, sf).select("ord", F.col("trim_seq").alias("seq"), F.col("trim_qual").alias("qual"))
    return R.trim(a, X.UP, X.DOWN).select("ord", "reversed", "seq", "qual")


@query(
    V(
        f" SELECT ord, substr(seq, instr(seq, m) + {len(X.UP)}) AS seq FROM (SELECT ord, seq, regexp_extract(seq, '{_UP}.+') AS m FROM amplicons WHERE regexp_matches(seq, '{_UP}.+')) WHERE length(m) - {len(X.UP)} >= 51",
        X.AMPLICONS_SQL,
    )
)
def q_trim_fwd(spark: SparkSession, sf: str) -> DataFrame:
    return R.trim(X.amplicons(spark, sf), X.UP).where("NOT reversed").select("ord", "seq")


_DEMUX = f"""
with_f AS (
    SELECT ord, seq, (SELECT min_by(ftag, k) FROM tags WHERE regexp_matches(seq, ftag || '{_UP}')) AS f FROM amplicons WHERE regexp_matches(seq, '.+{_UP}.+{_DOWN_RC}.+')),
cut AS (SELECT ord, f, substr(seq, length(f) + {len(X.UP)} + 1) AS seq FROM with_f WHERE f IS NOT NULL),
with_r AS (
    SELECT c.ord, t.k, t.sample AS sample_id, substr(c.seq, 1, instr(c.seq, regexp_extract(c.seq, '{_DOWN_RC}' || {X.rc_sql('t.rtag')})) - 1) AS seq
    FROM cut c JOIN tags t ON t.ftag = c.f AND regexp_matches(c.seq, '{_DOWN_RC}' || {X.rc_sql('t.rtag')}))"""


@query(V(" SELECT ord, min_by(sample_id, k) AS sample_id, min_by(seq, k) AS seq FROM with_r GROUP BY ord", X.AMPLICONS_SQL, _DEMUX))
def q_demux_single(spark: SparkSession, sf: str) -> DataFrame:
    return R.demultiplex(X.amplicons(spark, sf), X.TAGS, X.UP, X.DOWN).select("ord", "sample_id", "seq")


_DEMUX2 = f"""
pair_reads AS (SELECT ord, seq AS r1, rtag || '{X.DOWN_READ}' || seq AS r2 FROM amplicons JOIN tags ON k = ord % {len(X.TAGS)}),
with_f AS (SELECT *, (SELECT min_by(ftag, k) FROM tags WHERE regexp_matches(r1, ftag || '{_UP}')) AS f FROM pair_reads WHERE regexp_matches(r1, '.+{_UP}.+') AND regexp_matches(r2, '.+{S.disambiguate(X.DOWN)}.+')),
hits AS (SELECT ord, k, sample AS sample_id, substr(r1, length(f) + {len(X.UP)} + 1) AS r1, substr(r2, length(rtag) + {len(X.DOWN)} + 1) AS r2 FROM with_f JOIN tags ON ftag = f AND regexp_matches(r2, '^' || rtag || '{S.disambiguate(X.DOWN)}'))"""


@query(V(" SELECT ord, min_by(sample_id, k) AS sample_id, min_by(r1, k) AS r1, min_by(r2, k) AS r2 FROM hits GROUP BY ord", X.AMPLICONS_SQL, _DEMUX2))
def q_demux_paired(spark: SparkSession, sf: str) -> DataFrame:
    a = X.amplicons(spark, sf)
    r = F.element_at(F.array(*(F.lit(t.split(":")[1]) for t in X.TAGS.values())), (F.col("ord") % len(X.TAGS)).cast("int") + 1)
    pairs = a.select("ord", F.col("seq").alias("r1"), F.col("seq").alias("q1"), F.concat(r, F.lit(X.DOWN_READ), "seq").alias("r2"), F.concat(r, F.lit(X.DOWN_READ), "seq").alias("q2"))
    return R.demultiplex_pairs(pairs, X.TAGS, X.UP, X.DOWN).select("ord", "sample_id", "r1", "r2")


_STITCH = f"""
mates AS (SELECT ord, r1, q1, {X.rc_sql('r2')} AS y, reverse(q2) AS qy FROM pairs),
seeds AS (SELECT ord, i, instr(r1, substr(y, i, 16)) AS pos, (length(r1) - length(replace(r1, substr(y, i, 16), ''))) AS gone FROM mates, range(1, 66) r(i)),
offsets AS (SELECT ord, min_by(pos - i + 1, i) AS pos FROM seeds WHERE gone = 16 GROUP BY ord),
placed AS (SELECT *, length(r1) - pos + 1 AS n FROM mates JOIN offsets USING (ord) WHERE pos > 0 AND length(r1) - pos + 1 <= length(y)),
bases AS (
    SELECT ord, i, substr(r1, pos + i, 1) AS a, substr(y, i + 1, 1) AS b, ascii(substr(q1, pos + i, 1)) AS p, ascii(substr(qy, i + 1, 1)) AS q
    FROM placed, LATERAL (SELECT unnest(range(n)) AS i)),
middle AS (
    SELECT ord, string_agg(CASE WHEN a = b THEN a WHEN abs(p - q) < 6 THEN 'N' WHEN p < q THEN b ELSE a END, '' ORDER BY i) AS s,
           string_agg(chr(CAST(greatest(p, q) AS INTEGER)), '' ORDER BY i) AS z FROM bases GROUP BY ord)"""


@query(V(" SELECT ord, pos AS place FROM placed", X.PAIRS_SQL, _STITCH))
def q_stitch_offset(spark: SparkSession, sf: str) -> DataFrame:
    p = X.pairs(spark, sf)
    return R.located(p.select("ord", "r1", "r2")).where("at IS NOT NULL AND length(r1) - at + 1 <= length(r2)").select("ord", F.col("at").cast("bigint").alias("place"))


@query(V(" SELECT ord, substr(r1, 1, pos - 1) || s || substr(y, n + 1) AS seq, substr(q1, 1, pos - 1) || z || substr(qy, n + 1) AS qual FROM placed JOIN middle USING (ord)", X.PAIRS_SQL, _STITCH))
def q_stitch_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return R.stitch(X.pairs(spark, sf))


# --- k-mers, neighbours, classification ----------------------------------------------------


@query(V("SELECT ord, kmer, count(*) AS n FROM (SELECT ord, unnest(list_transform(range(1, length(seq) - 2), lambda i: substr(seq, CAST(i AS BIGINT), 4))) AS kmer FROM reads_ambig WHERE length(seq) >= 4) WHERE NOT contains(kmer, 'N') GROUP BY ALL"))
def q_kmer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return K.counts(X.reads(spark, sf, X.AMBIGUOUS))


_KNN = """
train_reads AS (SELECT ord, seq, length(seq) AS l FROM reads WHERE length(seq) = 120),
km AS (SELECT ord, kmer, count(*) AS n FROM (SELECT ord, unnest(list_transform(range(1, l - 2), lambda i: substr(seq, CAST(i AS BIGINT), 4))) AS kmer FROM train_reads) GROUP BY ALL),
t AS (SELECT ord, kmer, least(n, 15) / 117.0::DOUBLE AS f FROM km),
q AS (SELECT ord, kmer, n / 117.0::DOUBLE AS f FROM km WHERE ord % 100 = 0),
tn AS (SELECT ord, sum(f * f) AS s FROM t GROUP BY ord),
qn AS (SELECT ord, sum(f * f) AS s FROM q GROUP BY ord),
dots AS (SELECT q.ord AS query, t.ord AS train, sum(q.f * t.f) AS d FROM q JOIN t USING (kmer) GROUP BY ALL),
dist AS (SELECT query, train, round(120.0::DOUBLE / 8 * greatest(qn.s + tn.s - 2 * d, 0), 9) AS distance FROM dots JOIN qn ON qn.ord = query JOIN tn ON tn.ord = train),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, train) AS place FROM dist)"""


@query(V(" SELECT query, place, round(distance, 6) AS distance FROM ranked WHERE place <= 10", _KNN))
def q_knn_kmer(spark: SparkSession, sf: str) -> DataFrame:
    full = X.reads(spark, sf).where(F.length("seq") == X.LENGTH)
    queries = full.where("ord % 100 = 0").select(F.col("ord").alias("query"), "seq")
    near = K.nearest(queries, full.select(F.col("ord").alias("train"), "seq"), 10)
    return near.select("query", F.col("place").cast("bigint").alias("place"), F.round("distance", 6).alias("distance"))


@query()
def q_knn_kmer_all(spark: SparkSession, sf: str) -> DataFrame:
    """As q_knn_kmer, but over all reads, each with its own length."""
    every = X.reads(spark, sf)
    near = K.nearest(every.where("ord % 100 = 0").select(F.col("ord").alias("query"), "seq"), every.select(F.col("ord").alias("train"), "seq"), 10)
    return near.select("query", F.col("place").cast("bigint").alias("place"), F.round("distance", 6).alias("distance"))


@query(
    """WITH q AS (SELECT vec_id AS query, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
    d AS (SELECT query, vec_id AS train, sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (CAST(a[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE)) ** 2))) AS distance FROM q, embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, train) AS place FROM d)
    SELECT query, train, round(distance, 6) AS distance, place FROM r WHERE place <= 10"""
)
def q_knn_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "embeddings")
    near = K.nearest_vectors(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("train"), F.col("embedding").alias("v")), 10)
    return near.select("query", "train", F.round("distance", 6).alias("distance"), F.col("place").cast("bigint").alias("place"))


@query(V(" SELECT r.ord, CAST(list_last(string_split(ancestor, '; ')) AS INTEGER) AS taxID, ancestor IS NOT NULL AS exact FROM reads r LEFT JOIN (SELECT * FROM hash_key h WHERE h.md5 IN (SELECT md5(seq) FROM refseqs WHERE tax_id % 2 = 0)) h ON md5(r.seq) = h.md5", _LCA.replace("FROM refseqs JOIN lineages ON tax_id = taxID", "FROM refseqs JOIN lineages ON tax_id = taxID WHERE tax_id % 2 = 0")))
def q_ping_exact(spark: SparkSession, sf: str) -> DataFrame:
    tax = X.taxonomy(spark, sf)
    train = X.refseqs(spark, sf).where("tax_id % 2 = 0").select(F.col("ord").alias("train"), "seq", F.col("tax_id").alias("taxID"))
    key = C.build_key(train, tax)
    hashed = X.reads(spark, sf).select("ord", S.seq_hash(F.col("seq")).alias("md5"))
    return hashed.join(key, "md5", "left").select("ord", "taxID", F.col("taxID").isNotNull().alias("exact"))


def _trained(spark: SparkSession, sf: str, every_length: bool = False) -> C.Classifier:
    """A classifier whose training sequences are the reads of even species, of full or of every length."""
    tax = X.taxonomy(spark, sf)
    train = X.refseqs(spark, sf).where("tax_id % 2 = 0" if every_length else f"tax_id % 2 = 0 AND length(seq) = {X.LENGTH}").select(F.col("ord").alias("train"), "seq", F.col("tax_id").alias("taxID"))
    return C.Classifier(tax, C.build_key(train, tax), train)


_HASH_ONLY = _LCA.replace("FROM refseqs JOIN lineages ON tax_id = taxID", f"FROM refseqs JOIN lineages ON tax_id = taxID WHERE tax_id % 2 = 0 AND length(seq) = {X.LENGTH}")


@query(
    V(
        """ SELECT r.ord, r.name AS representative, f.taxID, t.name AS taxon, t.rank, CASE WHEN h.ancestor IS NULL THEN 1.0::DOUBLE END AS score,
        coalesce((SELECT max(a.name) FROM up u JOIN taxonomy a ON u.node = a.taxID WHERE u.taxID = f.taxID AND a.rank = 'order'), '') AS "order",
        coalesce((SELECT max(a.name) FROM up u JOIN taxonomy a ON u.node = a.taxID WHERE u.taxID = f.taxID AND a.rank = 'species'), '') AS species
        FROM reads r LEFT JOIN hash_key h ON md5(r.seq) = h.md5
        JOIN found f ON f.ord = r.ord JOIN taxonomy t ON t.taxID = f.taxID""",
        _HASH_ONLY + ", found AS (SELECT ord, coalesce(CAST(list_last(string_split(ancestor, '; ')) AS INTEGER), 1) AS taxID FROM reads LEFT JOIN hash_key ON md5(seq) = md5)",
    )
)
def q_classify_ping_only(spark: SparkSession, sf: str) -> DataFrame:
    """Exact hits, lineage columns and masking; reads without a hit stay at the root."""
    return C.classify(X.reads(spark, sf), _trained(spark, sf), ping_at=1.0, ranks=["order", "species"])


@query()
def q_ping_lca(spark: SparkSession, sf: str) -> DataFrame:
    """Exact hits, then neighbours within 2 % of a set of queries (ids divisible by 100) against all reads of even species, whatever their length.

    Odd species are held out: with them in training every query would be an exact hit.
    """
    model = _trained(spark, sf, every_length=True)
    unique = X.reads(spark, sf).where(F.col("ord") % 100 == 0).groupBy(S.seq_hash(F.col("seq")).alias("uid")).agg(F.min("seq").alias("seq"), F.min("ord").alias("ord"))
    return C.ping(unique, model, 0.98, 2).select("uid", "taxID", "exact")


_SCORES = """
s AS (SELECT l_orderkey AS q, l_linenumber AS child, -(l_quantity / 10 + l_discount * 20) AS sc FROM lineitem),
top AS (SELECT q, max(sc) AS m FROM s GROUP BY q),
w AS (SELECT s.q, child, exp(sc - m) / sum(exp(sc - m)) OVER (PARTITION BY s.q) AS w FROM s JOIN top USING (q))"""


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    li = X.table(spark, sf, "lineitem")
    scores = li.select(F.col("l_orderkey").alias("q"), F.struct(F.col("l_linenumber").alias("child"), (-(F.col("l_quantity") / 10 + F.col("l_discount") * 20)).alias("sc")).alias("s"))
    lists = scores.groupBy("q").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lists.select("q", F.explode(F.arrays_zip(F.transform("s", lambda x: x["child"]).alias("child"), S.akaike_weights(F.transform("s", lambda x: x["sc"])).alias("w"))).alias("z")).select("q", "z.child", "z.w")


@query("WITH " + _SCORES + " SELECT q, child, round(w, 6) AS w FROM w")
def q_akaike_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf).withColumn("w", F.round("w", 6))


@query("WITH " + _SCORES + " SELECT q, round(exp(sum(ln(w))), 9) AS product FROM w GROUP BY q")
def q_akaike_decay(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf).groupBy("q").agg(F.round(F.exp(F.sum(F.ln("w"))), 9).alias("product"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS q05, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50 FROM lineitem GROUP BY l_returnflag")
def q_quantile7(spark: SparkSession, sf: str) -> DataFrame:
    found = L.quantiles(X.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", [0.05, 0.5])
    return found.select("l_returnflag", F.round("q0", 6).alias("q05"), F.round("q1", 6).alias("q50"))


@query(V("SELECT otu AS clade, -max(ord)::DOUBLE AS minscore, min(length(seq)) AS minlength, max(length(seq)) AS maxlength, count(DISTINCT seq) AS nunique, count(*) AS ntotal FROM refseqs JOIN lineages ON tax_id = taxID GROUP BY otu", _LINEAGE))
def q_node_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The learner's node table, over groups of reference sequences in place of grown clades."""
    tax = X.taxonomy(spark, sf)
    lin = T.lineage(tax.select("taxID"), tax, numbers=True)
    rows = X.refseqs(spark, sf).join(lin, F.col("tax_id") == lin["taxID"])
    members = rows.groupBy(F.col("otu").alias("clade"), "seq").agg(F.count(F.lit(1)).alias("n"), (-F.max("ord")).cast("double").alias("score"), F.min("lineage").alias("lineage"))
    nodes = L.nodes_of(members.withColumn("model", F.lit(None).cast("binary")))
    whole = [F.col(c).cast("bigint").alias(c) for c in ("minlength", "maxlength", "nunique", "ntotal")]
    return nodes.select("clade", "minscore", *whole)


@query("SELECT l_orderkey AS q, string_agg(chr(CAST(33 + (l_linenumber * 17 + l_orderkey) % 90 AS INTEGER)), '' ORDER BY l_linenumber) AS scores FROM lineitem GROUP BY l_orderkey")
def q_score_text(spark: SparkSession, sf: str) -> DataFrame:
    code = (33 + (F.col("l_linenumber") * 17 + F.col("l_orderkey")) % 90).cast("int").alias("w")
    lists = X.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", code))).alias("s"))
    return lists.withColumn("weights", F.transform("s", lambda x: x["w"])).select("q", C.score_text("weights").alias("scores"))


_INFO = """
k AS (SELECT ord, unnest(list_transform(range(1, length(seq) - 4), lambda i: substr(seq, CAST(i AS BIGINT), 6))) AS kmer FROM reads WHERE length(seq) >= 6),
c AS (SELECT ord, kmer, count(*) AS n FROM k GROUP BY ALL)"""


@query(V(" SELECT kmer, count(DISTINCT n) AS kinds, count(*) AS holders FROM c GROUP BY kmer HAVING count(DISTINCT n) = 2", _INFO))
def q_infocols(spark: SparkSession, sf: str) -> DataFrame:
    return K.counts(X.reads(spark, sf), 6).groupBy("kmer").agg(F.countDistinct("n").alias("kinds"), F.count(F.lit(1)).alias("holders")).where("kinds = 2")


@query(V("SELECT tax_id, min_by(name, ord) AS name, count(*) AS n, CAST(sum(ord % 3) AS BIGINT) AS m FROM refseqs GROUP BY tax_id"))
def q_rollup_taxon(spark: SparkSession, sf: str) -> DataFrame:
    return C.rollup(X.refseqs(spark, sf).select("ord", "tax_id", "name", F.lit(1).alias("n"), (F.col("ord") % 3).cast("int").alias("m")), "tax_id")


@query(V(" SELECT name, confidence FROM flagged ORDER BY confidence DESC, name LIMIT 20", _PURGE))
def q_topk_confidence(spark: SparkSession, sf: str) -> DataFrame:
    flags = U.flag_mislabelled(X.refseqs(spark, sf), X.taxonomy(spark, sf), "order", 0.5)
    return flags.select("name", F.round("confidence", 6).alias("confidence")).orderBy(F.desc("confidence"), "name").limit(20)


@query(
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
    c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL),
    d AS (SELECT vec_id, label, sum((x - m) ** 2) AS d FROM e JOIN c USING (label, i) GROUP BY ALL)
    SELECT label, min_by(vec_id, round(d, 6)) AS medoid, round(min(d), 6) AS distance FROM d GROUP BY label"""
)
def q_centroid_medoid(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = e.groupBy("label", "i").agg(F.avg("x").alias("m"))
    d = e.join(c, ["label", "i"]).groupBy("vec_id", "label").agg(F.sum((F.col("x") - F.col("m")) ** 2).alias("d"))
    return d.groupBy("label").agg(F.min_by("vec_id", F.round("d", 6)).alias("medoid"), F.round(F.min("d"), 6).alias("distance"))


# --- files ---------------------------------------------------------------------------------


@query(V("SELECT ord, name, seq, qual FROM reads"))
def q_fastq_records(spark: SparkSession, sf: str) -> DataFrame:
    r = X.reads(spark, sf)
    parts = F.array(F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual")
    lines = r.select("ord", F.posexplode(parts).alias("pos", "line")).select((F.col("ord") * 4 + F.col("pos")).alias("line_no"), "line")
    return fastx.fastq_records(lines)


_FASTA_ORDER = "rank_of AS (SELECT ord, row_number() OVER (ORDER BY ord) AS g FROM reads)"


@query(V(" SELECT g AS ord, name, seq FROM reads JOIN rank_of USING (ord)", _FASTA_ORDER))
def q_fasta_records(spark: SparkSession, sf: str) -> DataFrame:
    r = X.reads(spark, sf)
    parts = F.array(F.concat(F.lit(">"), "name"), F.lower(F.substring("seq", 1, 60)), F.substring("seq", 61, 60))
    lines = r.select("ord", F.posexplode(parts).alias("pos", "line")).select((F.col("ord") * 4 + F.col("pos")).alias("line_no"), "line")
    return fastx.fasta_records(lines)


@query(V("SELECT concat_ws(chr(10), '@' || name, seq, '+', qual) AS value FROM reads"))
def q_fastq_text(spark: SparkSession, sf: str) -> DataFrame:
    return fastx.fastq_text(X.reads(spark, sf))


@query(V("SELECT 'A' || ord AS accession, tax_id, 'org ' || tax_id AS organism, 'root; x' AS lineage, seq FROM refseqs WHERE ord % 5 <> 0"))
def q_xml_extract(spark: SparkSession, sf: str) -> DataFrame:
    r = X.refseqs(spark, sf)
    organism = F.when(F.col("ord") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("<GBSeq_organism>org "), "tax_id", F.lit("</GBSeq_organism>")))
    doc = F.concat(F.lit("<GBSet><GBSeq><GBSeq_locus>A"), "ord", F.lit("</GBSeq_locus>"), organism, F.lit("<GBSeq_taxonomy>root; x</GBSeq_taxonomy><GBQualifier><GBQualifier_value>taxon:"), "tax_id", F.lit("</GBQualifier_value></GBQualifier><GBSeq_sequence>"), F.lower("seq"), F.lit("</GBSeq_sequence></GBSeq></GBSet>"))
    return ncbi.xml_records(r.select(doc.alias("doc")))


# --- alignment, models, clustering: tested against brute force --------------------------------


@query()
def q_shave(spark: SparkSession, sf: str) -> DataFrame:
    return U.shave(X.amplicons(spark, sf).select("ord", "seq", "qual"), X.UP_READ, "reverse")


@query()
def q_vpcr(spark: SparkSession, sf: str) -> DataFrame:
    return U.virtual_pcr(X.amplicons(spark, sf).select("ord", "name", "seq"), X.UP, X.DOWN, trim_primers=True)


@query()
def q_vfish(spark: SparkSession, sf: str) -> DataFrame:
    return U.virtual_fish(X.amplicons(spark, sf).select("ord", "name", "seq"), X.UP_READ, min_score=90, min_length=20)


@query()
def q_phmm_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Forward scores of all reads, whole, under one model."""
    model = codec.encode_phmm(phmm.derive([X.UP_READ, X.UP_READ[:-2] + "AA"]))

    def run(batches):
        import pyarrow as pa

        m = codec.decode_phmm(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):  # bounds the states held at once
                b = batch.slice(i, 4096)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(phmm.forward(m, b.column(1).to_pylist()))], names=["ord", "score"])

    return X.reads(spark, sf).select("ord", "seq").mapInArrow(run, "ord bigint, score double")


def _items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training sequences of the learner: the letters of all benchmark items, whole, as bases; items belong to nations by their number."""
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    rows = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("train"), F.translate(letters, X.LETTERS, X.BASES).alias("seq"), (F.pmod("item_id", F.lit(25)) + 100).cast("int").alias("taxID"))
    return rows.where("seq <> ''"), X.taxonomy(spark, sf)


@query()
def q_learn_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return L.learn(*_items(spark, sf)).nodes.select("clade", "taxID", "minscore", "minlength", "maxlength", "nunique", "ntotal")


@query()
def q_classify_tree(spark: SparkSession, sf: str) -> DataFrame:
    """All items, without their first letter and so never exact hits, descend the tree learned from all items."""
    rows, tax = _items(spark, sf)
    reads = rows.select(F.col("train").alias("ord"), F.lit("r_1").alias("name"), F.lit("r").alias("sample"), F.expr("substring(seq, 2)").alias("seq"))
    return C.classify(reads, L.learn(rows, tax), ping_at=0.0)


@query()
def q_cvi(spark: SparkSession, sf: str) -> DataFrame:
    """Query and training sets of all reference sequences at the default threshold."""
    return U.allocate_cvi(X.refseqs(spark, sf).select("ord", "seq"))


@query()
def q_otu(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of all reference sequences at the default threshold."""
    return K.clusters(X.refseqs(spark, sf).select("ord", "seq"))


@query()
def q_codec_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    model = phmm.derive([X.UP_READ, X.DOWN_READ])
    back = codec.decode_phmm(codec.encode_phmm(model))
    return spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(model.e[:3].ravel(), back.e[:3].ravel()))], "i int, was double, now double")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: classification of all reads by exact hash, with lineage columns."""
    return q_classify_ping_only(spark, sf)
