"""Deterministic stand-in views over the driver tables, over whole tables and whole texts.

Each function gives a DataFrame; the constant ``SQL`` holds the same views for DuckDB.
Reads are the letters of every document, mapped to bases and cut into pieces of 120.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
AMBIGUOUS = "ACGTACGTANGTACGTNCGTACGNAN"
QUALITIES = "56789:;<=>?@ABCDEFGHIJKLMN"
LENGTH = 120
# Example primers and adapters.
UP, DOWN = "GGWACWGGWTGAACWGTWTAYCCYCC", "TAIACYTCIGGRTGICCRAARAAYCA"
UP_READ, DOWN_READ = "GGAACAGGATGAACAGTATACCCCCC", "TAAACCTCAGGATGACCAAAAAACCA"
RC_DOWN_READ = "TGGTTTTTTGGTCATCCTGAGGTTTA"
TAGS = {"s1": "ACACAC:GTGTGT", "s2": "ACACAC:CATCAT", "s3": "TGTGTG:GTGTGT", "s4": "TGTGTG:CATCAT"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over all cores, if its files give fewer tasks than there are (never so at scale)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > cores else df.repartition(cores)


def reads(spark: SparkSession, sf_dir: str, bases: str = BASES) -> DataFrame:
    """ord, name, sample, seq, qual."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    letters = docs.select("doc_id", "source", F.lower(F.regexp_replace("text", "[^A-Za-z]", "")).alias("l"))
    pieces = letters.select("doc_id", "source", F.posexplode(F.regexp_extract_all("l", F.lit(f".{{1,{LENGTH}}}"), F.lit(0))).alias("piece", "p"))
    return pieces.select(
        (F.col("doc_id") * 1000000 + F.col("piece")).alias("ord"),
        F.concat("source", F.lit("_"), "doc_id", F.lit("."), "piece").alias("name"),
        F.col("source").alias("sample"),
        F.translate("p", LETTERS, bases).alias("seq"),
        F.translate("p", LETTERS, QUALITIES).alias("qual"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, r1, q1, r2, q2: both ends of the full-length reads; every seventh has a base altered in the overlap."""
    from ..functions.sequences import reverse_complement

    full = reads(spark, sf_dir).where(F.length("seq") == LENGTH)
    tail = F.when(F.col("ord") % 7 == 0, F.concat(F.substring("seq", 41, 30), F.translate(F.substring("seq", 71, 1), "ACGT", "CGTA"), F.substring("seq", 72, 49))).otherwise(F.substring("seq", 41, 80))
    return full.select("ord", F.substring("seq", 1, 80).alias("r1"), F.substring("qual", 1, 80).alias("q1"), reverse_complement(tail).alias("r2"), F.reverse(F.substring("qual", 41, 80)).alias("q2"))


def amplicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, name, seq, qual: tagged reads between primers; the tag pair goes by ord, odd ones are reversed in ``trim_seq``."""
    from ..functions.sequences import rc, reverse_complement

    k = (F.col("ord") % len(TAGS)).cast("int")
    f = F.element_at(F.array(*(F.lit(t.split(":")[0]) for t in TAGS.values())), k + 1)
    r = F.element_at(F.array(*(F.lit(rc(t.split(":")[1])) for t in TAGS.values())), k + 1)
    seq = F.concat(f, F.lit(UP_READ), "seq", F.lit(RC_DOWN_READ), r)
    base = reads(spark, sf_dir).select("ord", "name", seq.alias("seq"), F.rpad(F.concat(F.lit("I" * 32), "qual", F.lit("I" * 32)), 1 << 10, "I").alias("q"))
    base = base.select("ord", "name", "seq", F.substring("q", F.lit(1), F.length("seq")).alias("qual"))
    odd = F.col("ord") % 2 == 1
    return base.withColumn("trim_seq", F.when(odd, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).withColumn("trim_qual", F.when(odd, F.reverse("qual")).otherwise(F.col("qual")))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxID, parent_taxID, rank, name: root, regions, nations, genera (market segment of a nation), customers."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    genus = (F.lit(1000) + F.col("c_nationkey") * 10 + F.ascii("c_mktsegment") % 10).cast("int")
    rows = [
        spark.createDataFrame([(1, 0, "no rank", "root")], "taxID int, parent_taxID int, rank string, name string"),
        region.select((F.col("r_regionkey") + 10).cast("int").alias("taxID"), F.lit(1).alias("parent_taxID"), F.lit("kingdom").alias("rank"), F.col("r_name").alias("name")),
        nation.select((F.col("n_nationkey") + 100).cast("int").alias("taxID"), (F.col("n_regionkey") + 10).cast("int").alias("parent_taxID"), F.lit("order").alias("rank"), F.col("n_name").alias("name")),
        customer.select(genus.alias("taxID"), (F.col("c_nationkey") + 100).cast("int").alias("parent_taxID"), F.lit("genus").alias("rank"), F.lower(F.regexp_replace("c_mktsegment", "[^A-Za-z]", "")).alias("name")).distinct(),
        customer.select((F.col("c_custkey") + 10000).cast("int").alias("taxID"), genus.alias("parent_taxID"), F.lit("species").alias("rank"), F.concat(F.lower(F.regexp_replace("c_mktsegment", "[^A-Za-z]", "")), F.lit(" sp"), "c_custkey").alias("name")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def refseqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, name (ACCESSION|taxID), seq, tax_id, otu: reads laid on species by their document.

    OTUs follow nations, but every seventh document is in its neighbour's.
    """
    customer = table(spark, sf_dir, "customer")
    bounds = customer.agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("lo"))
    doc = F.floor(F.col("ord") / 1000000).cast("bigint")
    r = reads(spark, sf_dir).crossJoin(F.broadcast(bounds)).withColumn("c_custkey", F.col("lo") + doc % F.col("n"))  # one row
    r = r.join(customer.select("c_custkey", "c_nationkey"), "c_custkey").withColumn("tax", (F.col("c_custkey") + 10000).cast("int"))
    otu = (F.col("c_nationkey") + F.when(doc % 7 == 0, 1).otherwise(0)) % 25
    return r.select("ord", F.concat(F.lpad((doc % 40).cast("string"), 4, "S"), F.lit("A"), "ord", F.lit("|"), "tax").alias("name"), "seq", F.col("tax").alias("tax_id"), otu.cast("bigint").alias("otu"))


#: The same views for DuckDB, as the head of a query.
SQL = f"""
letters AS (SELECT doc_id, source, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents),
piece AS (
    SELECT doc_id, source, unnest(range((length(l) + {LENGTH - 1}) // {LENGTH})) AS piece,
           unnest(regexp_extract_all(l, '.{{1,{LENGTH}}}')) AS p FROM letters),
reads AS (
    SELECT doc_id * 1000000 + piece AS ord, source || '_' || doc_id || '.' || piece AS name, source AS sample,
           translate(p, '{LETTERS}', '{BASES}') AS seq, translate(p, '{LETTERS}', '{QUALITIES}') AS qual FROM piece),
reads_ambig AS (
    SELECT doc_id * 1000000 + piece AS ord, source || '_' || doc_id || '.' || piece AS name, source AS sample,
           translate(p, '{LETTERS}', '{AMBIGUOUS}') AS seq, translate(p, '{LETTERS}', '{QUALITIES}') AS qual FROM piece),
taxonomy AS (
    SELECT 1 AS taxID, 0 AS parent_taxID, 'no rank' AS rank, 'root' AS name
    UNION ALL SELECT r_regionkey + 10, 1, 'kingdom', r_name FROM region
    UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, 'order', n_name FROM nation
    UNION ALL SELECT DISTINCT 1000 + c_nationkey * 10 + ascii(c_mktsegment) % 10, c_nationkey + 100, 'genus', lower(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g')) FROM customer
    UNION ALL SELECT c_custkey + 10000, 1000 + c_nationkey * 10 + ascii(c_mktsegment) % 10, 'species', lower(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g')) || ' sp' || c_custkey FROM customer),
species_of AS (SELECT count(*) AS n, min(c_custkey) AS lo FROM customer),
refseqs AS (
    SELECT ord, lpad(CAST((ord // 1000000) % 40 AS VARCHAR), 4, 'S') || 'A' || ord || '|' || CAST(10000 + c_custkey AS INTEGER) AS name, seq,
           CAST(10000 + c_custkey AS INTEGER) AS tax_id, CAST((c_nationkey + CASE WHEN (ord // 1000000) % 7 = 0 THEN 1 ELSE 0 END) % 25 AS BIGINT) AS otu
    FROM reads, species_of, customer WHERE c_custkey = lo + (ord // 1000000) % n)
"""


def with_views(query: str, *more: str) -> str:
    """A DuckDB query over the views (and further common table expressions)."""
    return "WITH RECURSIVE " + ",".join([SQL, *more]) + query


#: reverse complement in DuckDB
def rc_sql(x: str) -> str:
    return f"reverse(translate(regexp_replace(upper({x}), '[^ACGTMRWSYKVHDBNI]', '', 'g'), 'ACGTMRWSYKVHDBNI', 'TGCAKYWSRMBDHVNI'))"


TAG_ROWS = ", ".join(f"({i}, '{s}', '{t.split(':')[0]}', '{t.split(':')[1]}')" for i, (s, t) in enumerate(TAGS.items()))

AMPLICONS_SQL = f"""
tags(k, sample, ftag, rtag) AS (VALUES {TAG_ROWS}),
amplicon0 AS (
    SELECT ord, name, ftag || '{UP_READ}' || seq || '{RC_DOWN_READ}' || {rc_sql('rtag')} AS seq, rpad(repeat('I', 32) || qual || repeat('I', 32), 1024, 'I') AS q
    FROM reads JOIN tags ON k = ord % {len(TAGS)}),
amplicon1 AS (SELECT ord, name, seq, substr(q, 1, length(seq)) AS qual FROM amplicon0),
amplicons AS (
    SELECT *, CASE WHEN ord % 2 = 1 THEN {rc_sql('seq')} ELSE seq END AS trim_seq, CASE WHEN ord % 2 = 1 THEN reverse(qual) ELSE qual END AS trim_qual FROM amplicon1)"""

PAIRS_SQL = f"""
full_reads AS (SELECT * FROM reads WHERE length(seq) = {LENGTH}),
pairs AS (
    SELECT ord, substr(seq, 1, 80) AS r1, substr(qual, 1, 80) AS q1, reverse(substr(qual, 41, 80)) AS q2,
           {rc_sql("CASE WHEN ord % 7 = 0 THEN substr(seq, 41, 30) || translate(substr(seq, 71, 1), 'ACGT', 'CGTA') || substr(seq, 72, 49) ELSE substr(seq, 41, 80) END")} AS r2
    FROM full_reads)"""
