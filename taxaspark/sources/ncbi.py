"""Taxonomy dumps and Entrez XML: readers, and a paged remote source."""

from __future__ import annotations

import re
import time
import urllib.parse
import urllib.request
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.taxonomy import from_dumps

# The public service's address, records of a page, identifiers of a list.
ENTREZ = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/"
PAGE, MAX_ACCESSIONS, TRIES = 500, 200, 10


def dump_rows(spark: SparkSession, path: str, fields: dict[str, int]) -> DataFrame:
    """Columns of a dump file whose fields stand between ``\\t|\\t``."""
    parts = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return spark.read.text(path).select(*[F.trim(F.get(parts, F.lit(i))).alias(c) for c, i in fields.items()])


def read_taxonomy(spark: SparkSession, nodes_path: str, names_path: str, synonyms: bool = False) -> DataFrame:
    """taxID, parent_taxID, rank, name of ``nodes.dmp`` and ``names.dmp``."""
    nodes = dump_rows(spark, nodes_path, {"taxID": 0, "parent_taxID": 1, "rank": 2}).select(F.col("taxID").cast("int"), F.col("parent_taxID").cast("int"), "rank")
    names = dump_rows(spark, names_path, {"taxID": 0, "name": 1, "kind": 3}).select(F.col("taxID").cast("int"), "name", "kind")
    return from_dumps(nodes, names, synonyms)


TAXON = re.compile(r"taxon:[0-9]+\Z")


def xml_records(docs: DataFrame) -> DataFrame:
    """accession, tax_id, organism, lineage, seq of GenBank XML documents (doc), one row per complete record; a document is parsed once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [r for doc in batch.column(0).to_pylist() if doc is not None for r in _complete(doc)]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
                names = ["accession", "tax_id", "organism", "lineage", "seq"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    out = docs.select("doc").mapInArrow(run, "accession string, tax_id int, organism string, lineage string, seq string")
    return out.select("accession", "tax_id", "organism", "lineage", F.upper("seq").alias("seq"))


def _complete(doc: str):
    for rec in ElementTree.fromstring(doc).iter("GBSeq"):
        taxon = next((q.text[6:] for q in rec.iter("GBQualifier_value") if TAXON.match(q.text or "")), None)
        texts = [rec.findtext(t) for t in ("GBSeq_locus", "GBSeq_organism", "GBSeq_taxonomy", "GBSeq_sequence")]
        if taxon and all(texts):
            yield texts[0], int(taxon), *texts[1:]


class EntrezSource(DataSource):
    """Sequences of a query or of accessions, one partition per page of 500 records.

    Options: query or accession (comma-separated, at most 200), db (nucleotide or protein),
    contact, base (the service's address; tests give a local one).
    """

    @classmethod
    def name(cls) -> str:
        return "entrez"

    def schema(self) -> str:
        return "accession string, tax_id int, organism string, lineage string, seq string"

    def reader(self, schema) -> EntrezReader:
        return EntrezReader(dict(self.options))


class EntrezPage(InputPartition):
    def __init__(self, url: str):
        self.url = url


class EntrezReader(DataSourceReader):
    def __init__(self, options: dict):
        if bool(options.get("query")) == bool(options.get("accession")):
            raise ValueError("give either a query or accessions")
        self.o = options

    def _get(self, page: str, **params) -> bytes:
        return fetch(self.o.get("base", ENTREZ) + page + "?" + urllib.parse.urlencode({k: v for k, v in params.items() if v}))

    def partitions(self) -> list[EntrezPage]:
        db, common = self.o.get("db", "nucleotide"), {"tool": "taxaspark", "email": self.o.get("contact")}
        if self.o.get("query"):
            found = ElementTree.fromstring(self._get("esearch.fcgi", db=db, term=self.o["query"], usehistory="y", **common))
        else:
            ids = self.o["accession"].split(",")
            if len(ids) > MAX_ACCESSIONS:
                raise ValueError(f"at most {MAX_ACCESSIONS} accessions")
            found = ElementTree.fromstring(self._get("epost.fcgi", db=db, id=",".join(ids), **common))
        n = int(found.findtext("Count") or len(self.o.get("accession", "").split(",")))
        where = {"db": db, "WebEnv": found.findtext("WebEnv"), "query_key": found.findtext("QueryKey"), "rettype": "gb", "retmode": "xml", **common}
        base = self.o.get("base", ENTREZ) + "efetch.fcgi?"
        return [EntrezPage(base + urllib.parse.urlencode({k: v for k, v in where.items() if v} | {"retstart": a, "retmax": PAGE})) for a in range(0, n, PAGE)]

    def read(self, page: EntrezPage):
        for rec in ElementTree.fromstring(fetch(page.url)).iter("GBSeq"):
            taxon = next((q.text[6:] for q in rec.iter("GBQualifier_value") if (q.text or "").startswith("taxon:")), None)
            row = (rec.findtext("GBSeq_locus"), int(taxon) if taxon else None, rec.findtext("GBSeq_organism"), rec.findtext("GBSeq_taxonomy"), (rec.findtext("GBSeq_sequence") or "").upper())
            if all(row):
                yield row


def fetch(url: str, tries: int = TRIES, wait: float = 1.0) -> bytes:
    """A document, tried again after a pause; a stray byte that is no XML text is blanked."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310
                return r.read().replace(b"\xae", b" ")
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(wait)
    raise ValueError("no tries")


def search(spark: SparkSession, **options: str) -> DataFrame:
    """Rows of the remote service, named ``ACC|taxID``."""
    spark.dataSource.register(EntrezSource)
    rows = spark.read.format("entrez").options(**options).load()
    acc = F.regexp_replace("accession", r"\.[0-9]+$", "")
    return rows.withColumn("accession", acc).withColumn("name", F.concat(acc, F.lit("|"), F.col("tax_id").cast("string")))
