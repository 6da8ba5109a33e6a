"""Exact dedup against a persistent digest index (DataFrame functions only).

``DigestIndex`` keeps one row per distinct text in a table bucketed and sorted by
digest.  A batch is reduced to its distinct digests (partial aggregation, so a text
that fills a third of the batch is one row per task), those are anti-joined with the
index by sort-merge join - the index side needs no shuffle - and the new ones are
appended.

Texts are equal when identical after each run of white space became one space; null
counts as the empty text.  Of equal texts in the batch that brings the digest the
smallest ``doc_id`` stays (a null id sorts after all others); a digest that an earlier
batch appended keeps its earlier document.  Rows that agree in id and text are one
document: they are kept or dropped together, and each counts in group_size.  Extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
SALTS = 64


def digest(text) -> F.Column:
    """Lowercase hex SHA-256 of the text with white space normalised."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


class DigestIndex:
    """A persistent set of digests: ``text_sha256``, ``keep_id``, in a table bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _write(self, rows: DataFrame, table: str) -> None:
        rows.write.mode("append").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").format("parquet").saveAsTable(table)

    def compact(self) -> None:
        """Rewrite the table as one sorted file a bucket (each batch appends one); no shuffle, since it is read by buckets."""
        fresh = f"{self.table}_{uuid.uuid4().hex[:8]}"
        self._write(self.read().groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id")), fresh)
        self.drop()
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.table}")

    def add(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """Append the batch's new digests; one row per document with the row that stays.

        Returns doc_id, keep_id, group_size (rows of the batch with this text), kept, text_sha256,
        written to the shared folder: the index may be changed or dropped afterwards.
        """
        scratch = Scratch(self.spark, "digests")
        rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), digest(F.col(f"`{text}`")).alias("text_sha256"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        rows = scratch.write(rows, "rows")  # texts are read and hashed once
        part = rows.groupBy("text_sha256", "salt").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
        groups = part.groupBy("text_sha256").agg(F.min("low").alias("first_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
        batch = groups.select("text_sha256", F.col("first_id").alias("keep_id"))
        if not self.exists():
            self._write(batch.limit(0), self.table)
        # The index is dealt and sorted by digest on disk; the merge moves the batch's digests only.
        self._write(batch.join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti"), self.table)
        # Each (digest, salt) is one row here and the documents' side is dealt by both, so no group lands in one task.
        held = groups.hint("merge").join(self.read(), "text_sha256").select("text_sha256", "keep_id", "group_size", F.explode("salts").alias("salt"))
        out = rows.hint("merge").join(held, ["text_sha256", "salt"])
        out = scratch.write(out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"), "found")
        scratch.drop("rows")
        return out


def keep_first(docs: DataFrame, index: DigestIndex, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text is new, all columns as they were."""
    gone = index.add(docs, text, doc_id).where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__gone")).distinct()
    # Dropped rows are few beside kept ones; both id and digest tell them, so ids may repeat or be null.
    marked = docs.withColumn("__digest", digest(F.col(f"`{text}`")))
    return marked.join(gone, (marked["__digest"] == gone["__gone"]) & marked[doc_id].eqNullSafe(gone["__id"]), "left_anti").drop("__digest")
