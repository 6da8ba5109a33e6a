"""FASTQ and FASTA as DataFrames: readers, record builders over line tables, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window as W

from ..functions.sequences import wrap


SPAN = 1 << 20


def running_count(lines: DataFrame, flag, name: str) -> DataFrame:
    """Adds how many lines up to and with this one have ``flag``, by ``line_no``.

    Counted within spans of lines, plus the totals of the spans before (a table of one row
    per span), so no task sorts the whole file.
    """
    rows = lines.withColumn("__on", flag.cast("int")).withColumn("__span", F.floor(F.col("line_no") / SPAN))
    totals = rows.groupBy("__span").agg(F.sum("__on").alias("__n"))
    before = totals.select("__span", (F.sum("__n").over(W.orderBy("__span")) - F.col("__n")).alias("__before"))
    inside = F.sum("__on").over(W.partitionBy("__span").orderBy("line_no"))
    return rows.withColumn("__inside", inside).join(before, "__span").withColumn(name, F.col("__inside") + F.col("__before")).drop("__on", "__span", "__inside", "__before")


def fastq_records(lines: DataFrame, legacy: bool = False) -> DataFrame:
    """ord, name, seq, qual of (line_no, line) rows of one file, line_no from 0.

    Strict: every four lines are a record, so no window over the file is needed.  ``legacy``
    starts a record at each line that begins with ``@`` and drops those without four lines
    (as where a quality begins with ``@``).
    """
    if legacy:
        rows = running_count(lines.where("line <> ''"), F.col("line").startswith("@"), "g")
        rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("g").orderBy("line_no")) - 1)
    else:
        rows = lines.select(F.floor(F.col("line_no") / 4).alias("g"), (F.col("line_no") % 4).alias("pos"), "line", "line_no")
    pick = lambda k: F.max(F.when(F.col("pos") == k, F.col("line")))
    out = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), pick(0).alias("name"), pick(1).alias("seq"), pick(3).alias("qual"))
    return out.where((F.col("n") == 4) & F.col("name").startswith("@")).select(F.col("g").cast("bigint").alias("ord"), F.substring("name", 2, 1 << 30).alias("name"), "seq", "qual")


def fasta_records(lines: DataFrame) -> DataFrame:
    """ord, name, seq of (line_no, line) rows: lines after a header are joined, upper-cased, ``.`` read as ``-``."""
    rows = running_count(lines, F.col("line").startswith(">"), "g").where("g > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("line").startswith(">"), F.struct("line_no", "line")))), lambda x: x["line"]), "")
    out = rows.groupBy("g").agg(F.max(F.when(F.col("line").startswith(">"), F.substring("line", 2, 1 << 30))).alias("name"), body.alias("seq"))
    return out.select(F.col("g").cast("bigint").alias("ord"), "name", F.replace(F.upper("seq"), F.lit("."), F.lit("-")).alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of FASTA files, split by ``\\n>`` so that files are read in parallel without a global order."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    text = F.regexp_replace("value", "^>", "")
    name = F.substring_index(text, "\n", 1)
    seq = F.regexp_replace(F.substring(text, F.length(name) + 2, F.length(text)), r"\s+", "")
    return rows.select(F.regexp_replace(name, r"\r$", "").alias("name"), F.replace(F.upper(seq), F.lit("."), F.lit("-")).alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, seq, qual of four-line FASTQ files, plain or gzipped, of any store that Spark reads.

    Mounted paths go through the splitting source below.  Files of other stores are read by Spark, one row a
    file (up to 2 GB each).  ``ord`` is the file's place in order of names times 2^40 plus the record's offset.
    """
    scheme = path.split("://", 1)[0] if "://" in path else ""
    if scheme in ("", "file"):
        spark.dataSource.register(FastqSource)
        return spark.read.format("fastq").option("path", path.removeprefix("file://")).load()
    files = spark.read.format("binaryFile").load(path)
    names = sorted(r["path"] for r in files.select("path").collect())
    place = spark.sparkContext.broadcast({name: i for i, name in enumerate(names)})  # names only

    def run(batches):
        import gzip
        import io

        import pyarrow as pa

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = io.BytesIO(gzip.decompress(body) if name.endswith(".gz") else body)
                rows = list(_records(f, len(f.getbuffer()), place.value[name]))
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["ord", "name", "seq", "qual"])

    return files.select("path", "content").mapInArrow(run, "ord bigint, name string, seq string, qual string")


FILE_BITS = 40


def _records(f, end: int, file: int):
    """Records that begin before ``end``, from where the file stands."""
    while f.tell() < end:
        at = f.tell()
        head, seq, _, qual = (f.readline().rstrip(b"\r\n").decode() for _ in range(4))
        if not head:
            return
        yield (file << FILE_BITS) + at, head[1:], seq, qual


class FastqSource(DataSource):
    """Four-line FASTQ records of a local or mounted path, cut at record starts about every 64 MB; gzipped files are not cut."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "ord bigint, name string, seq string, qual string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


class FastqSplit(InputPartition):
    def __init__(self, path: str, start: int, end: int, file: int):
        self.path, self.start, self.end, self.file = path, start, end, file


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> list[FastqSplit]:
        import glob
        import os

        files = sorted(glob.glob(self.path)) if not os.path.isdir(self.path) else sorted(glob.glob(os.path.join(self.path, "*")))
        out = []
        for k, f in enumerate(files):
            n = os.path.getsize(f)
            out += [FastqSplit(f, 0, 1 << 62, k)] if f.endswith(".gz") else [FastqSplit(f, a, min(a + self.size, n), k) for a in range(0, n, self.size)]
        return out or [FastqSplit("", 0, 0, 0)]

    def read(self, part: FastqSplit):
        import gzip

        if not part.path:
            return
        with gzip.open(part.path, "rb") if part.path.endswith(".gz") else open(part.path, "rb") as f:
            f.seek(max(part.start - 1, 0))
            if part.start:
                f.readline()
                _to_record(f)
            yield from _records(f, part.end, part.file)


def _to_record(f) -> None:
    """Move to the next record: a line that begins with ``@`` whose next but one begins with ``+``."""
    while True:
        at = f.tell()
        a = f.readline()
        if not a:
            return
        f.readline()
        plus = f.readline()
        if a.startswith(b"@") and plus.startswith(b"+"):
            f.seek(at)
            return
        f.seek(at)
        f.readline()


def fastq_text(reads: DataFrame) -> DataFrame:
    """One value per record, four lines."""
    head = F.when(F.col("name").startswith("@"), F.col("name")).otherwise(F.concat(F.lit("@"), "name"))
    return reads.select(F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("value"))


def fasta_text(seqs: DataFrame, width: int | None = None) -> DataFrame:
    """One value per record, the sequence broken every ``width`` residues."""
    seq = wrap(F.col("seq"), width) if width else F.col("seq")
    return seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), seq).alias("value"))


def write_fastq(reads: DataFrame, path: str, compress: bool = False, append: bool = False) -> None:
    fastq_text(reads).write.mode("append" if append else "error").option("compression", "gzip" if compress else "none").text(path)


def write_fasta(seqs: DataFrame, path: str, width: int | None = None, compress: bool = False, append: bool = False) -> None:
    fasta_text(seqs, width).write.mode("append" if append else "error").option("compression", "gzip" if compress else "none").text(path)


def write_samples(reads: DataFrame, path: str) -> None:
    """One folder of FASTQ files per ``sample_id`` (the demultiplexer's sink)."""
    text = reads.select("sample_id", F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value"))
    text.write.mode("append").partitionBy("sample_id").text(path)


def write_pair_samples(pairs: DataFrame, path: str) -> None:
    """One folder of FASTQ files per ``sample_id`` and mate (R1, R2)."""
    record = lambda seq, qual: F.concat_ws("\n", F.concat(F.lit("@"), "name"), seq, F.lit("+"), qual)
    mates = F.array(F.struct(F.lit("R1").alias("mate"), record("r1", "q1").alias("value")), F.struct(F.lit("R2").alias("mate"), record("r2", "q2").alias("value")))
    pairs.select("sample_id", F.explode(mates).alias("m")).select("sample_id", "m.mate", "m.value").write.mode("append").partitionBy("sample_id", "mate").text(path)
