"""Read processing: filtering, dereplication, trimming, stitching, demultiplexing.

Reads are rows (ord, name, seq, qual, ...); ``ord`` is the order of the input, which
decides first occurrences and ties.  Everything is built from column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.sequences import ambiguous_count, disambiguate, letters, mean_phred, rc, reverse_complement, seq_hash


def quality_filter(
    reads: DataFrame,
    min_qual: float | None = 30,
    max_ambigs: int | None = 0,
    min_count: int | None = 2,
    min_length: int | None = 50,
    max_length: int | None = 500,
) -> DataFrame:
    """Reads that pass length, quality and ambiguity limits and then occur ``min_count`` times among the survivors.

    A limit of None is not applied.  Counts come back by :func:`by_group`, so a sequence that
    makes up much of the input is neither sorted in one window nor joined in one task.
    """
    limits = []
    if min_length is not None:
        limits.append(F.length("seq") >= min_length)
    if max_length is not None:
        limits.append(F.length("seq") <= max_length)
    if max_ambigs is not None:
        limits.append(ambiguous_count(F.col("seq")) <= max_ambigs)
    if min_qual is not None:  # the dearest comes last
        limits.append(mean_phred(F.col("qual")) >= min_qual)
    out = once(reads, __ok=reduce(lambda a, b: a & b, limits)).where("__ok").drop("__ok") if limits else reads
    if min_count is None or min_count <= 1:
        return out
    return by_group(out, lambda groups: groups.where(F.col("__n") >= min_count)).select(*reads.columns)


def by_group(rows: DataFrame, change: Callable[[DataFrame], DataFrame] = lambda groups: groups, salts: int = 32) -> DataFrame:
    """The rows with ``__n`` and ``__first``, the size and first ord of their sequence's group.

    ``change`` may filter or extend the groups (one row per sequence, known by its MD5, so that
    sequences are not shuffled with each count).  Rows are dealt by sequence and salt, and a group only comes to the salts it has, so no group meets in one task.
    """
    salted = rows.withColumn("__key", F.unhex(seq_hash(F.col("seq")))).withColumn("__salt", F.pmod(F.xxhash64("ord"), F.lit(salts)).cast("int"))
    part = salted.groupBy("__key", "__salt").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("low"))
    groups = part.groupBy("__key").agg(F.sum("n").alias("__n"), F.min("low").alias("__first"), F.collect_set("__salt").alias("__salts"))
    held = change(groups).withColumn("__salt", F.explode("__salts")).drop("__salts")
    return salted.join(held, ["__key", "__salt"]).drop("__key", "__salt")


def once(rows: DataFrame, **computed: Column) -> DataFrame:
    """The rows with more columns, each computed once a row.

    Conditions on a plain column are pushed to the scan with its whole expression, and chains of such
    columns multiply; those of a generator are not.
    """
    return rows.select(*rows.columns, F.inline(F.array(F.struct(*(c.alias(name) for name, c in computed.items())))))


def subset(rows: DataFrame, keep: Column) -> DataFrame:
    """The rows for which ``keep`` is true (null counts as false); all columns follow."""
    return rows.where(keep)


def first_occurrences(reads: DataFrame) -> DataFrame:
    """The first row of each distinct sequence."""
    cols = [c for c in reads.columns if c != "ord"]
    best = reads.groupBy("seq").agg(F.min(F.struct("ord", *[c for c in cols if c != "seq"])).alias("m"))
    return best.select("m.ord", *[F.col("seq") if c == "seq" else F.col(f"m.{c}") for c in cols])


def pointers(reads: DataFrame) -> DataFrame:
    """The rows with ``pointer``, the rank of their sequence by first occurrence, and ``duplicated``."""
    out = by_group(reads, lambda groups: rank_by(groups, "__first", "pointer"))
    return out.withColumn("duplicated", F.col("ord") != F.col("__first")).drop("__n", "__first")


def rank_by(rows: DataFrame, key: str, name: str, buckets: int = 64) -> DataFrame:
    """1-based global rank by a distinct numeric key, without sorting all rows in one task.

    Rows are cut into ranges of the key at its quantiles; ranks are positions within a
    range plus the sizes of the ranges before (a table of at most ``buckets`` rows).
    """
    cuts = rows.stat.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.01)
    part = reduce(lambda a, b: a + b, [(F.col(key) > c).cast("int") for c in sorted(set(cuts))], F.lit(0))
    rows = rows.withColumn("__part", part)
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(W.orderBy("__part")) - F.col("__size")).alias("__before"))
    place = F.row_number().over(W.partitionBy("__part").orderBy(key))
    return rows.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__place")).cast("bigint")).drop("__part", "__place", "__before")


def dereplicate(reads: DataFrame, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Unique sequences (uid, seq, ord, weight, n) and membership (ord, name, uid); uid is the MD5."""
    w = F.col(weight) if weight else F.lit(1.0)
    uniques = reads.groupBy(seq_hash(F.col("seq")).alias("uid")).agg(
        F.min_by("seq", "ord").alias("seq"), F.min("ord").alias("ord"), F.sum(w).alias("weight"), F.count(F.lit(1)).alias("n")
    )
    return uniques, reads.select("ord", "name", seq_hash(F.col("seq")).alias("uid"))


def rereplicate(uniques: DataFrame, membership: DataFrame) -> DataFrame:
    """The inverse of :func:`dereplicate`: one row per member, weights split evenly."""
    u = uniques.select("uid", "seq", (F.col("weight") / F.col("n")).alias("weight"))
    return membership.join(u, "uid").select("ord", "name", "seq", "weight")


def join_sets(*sets: DataFrame) -> DataFrame | None:
    """All rows of several sets, with the columns that all of them have."""
    if not sets:
        return None
    cols = [c for c in sets[0].columns if all(c in s.columns for s in sets)]
    return reduce(DataFrame.unionByName, [s.select(*cols) for s in sets])


def named(seqs: DataFrame) -> DataFrame:
    """Sequences (seq, and perhaps ord) with ``ord`` and names ``S1``, ``S2`` ... where they have none."""
    rows = seqs if "ord" in seqs.columns else seqs.withColumn("ord", F.monotonically_increasing_id())
    return rows if "name" in rows.columns else rank_by(rows, "ord", "__n").withColumn("name", F.concat(F.lit("S"), "__n")).drop("__n")


def from_abundance(wide: DataFrame, sample: str = "sample") -> DataFrame:
    """Counts (sample, asv, seq, n) of a table with one column per sequence, named ``ASV1`` ... in column order."""
    seqs = [c for c in wide.columns if c != sample]
    cells = F.array(*(F.struct(F.lit(f"ASV{i}").alias("asv"), F.lit(c).alias("seq"), F.col(f"`{c}`").cast("bigint").alias("n")) for i, c in enumerate(seqs, 1)))
    return wide.select(F.col(sample).alias("sample"), F.explode(cells).alias("x")).select("sample", "x.*")


def tabulate(reads: DataFrame) -> DataFrame:
    """Counts per unique sequence and sample, in long form: uid, seq, sample, n (no zeros)."""
    return reads.groupBy(seq_hash(F.col("seq")).alias("uid"), "seq", "sample").agg(F.count(F.lit(1)).alias("n"))


def pivot_samples(counts: DataFrame, samples: list[str]) -> DataFrame:
    """The wide form of :func:`tabulate`, one column per sample, zeros filled in."""
    return counts.groupBy("uid", "seq").pivot("sample", samples).agg(F.sum("n")).na.fill(0, samples)


def trim(reads: DataFrame, up: str, down: str | None = None, min_kept: int = 51) -> DataFrame:
    """What stands between primers, in either orientation; reads without them are dropped.

    Adds nothing but replaces seq and qual; ``reversed`` tells which reads were turned round.
    """
    pattern = disambiguate(up) + ".+" + (disambiguate(rc(down)) if down else "")
    n_up, n_down = len(up), len(down or "")
    found = lambda c: F.regexp_extract(c, f"({pattern})", 1)  # noqa: E731, empty if there is none
    there = F.col("__there") != ""
    rows = once(reads, __there=found("seq")).withColumn("reversed", ~there)
    rows = once(rows, __seq=F.when(there, F.col("seq")).otherwise(reverse_complement(F.col("seq"))))
    rows = once(rows, __hit=F.when(there, F.col("__there")).otherwise(found("__seq"))).where("__hit <> ''")
    start, size = F.instr("__seq", F.col("__hit")) + n_up, F.length("__hit") - n_up - n_down
    cut = lambda c: F.substring(c, start, size)
    qual = F.when(there, F.col("qual")).otherwise(F.reverse("qual"))
    return rows.where(size >= min_kept).withColumn("seq", cut(F.col("__seq"))).withColumn("qual", cut(qual)).drop("__there", "__seq", "__hit")


def pair_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates (ord, name, r1, q1, r2, q2, names_agree) of two read sets in the same order.

    Names agree if they are as long as each other and differ in two characters at most.
    """
    other = second.select("ord", F.col("name").alias("__name"), F.col("seq").alias("r2"), F.col("qual").alias("q2"))
    unlike = F.size(F.filter(F.zip_with(F.split("name", ""), F.split("__name", ""), lambda a, b: a != b), lambda x: x))
    both = first.select("ord", "name", F.col("seq").alias("r1"), F.col("qual").alias("q1")).join(other, "ord")
    return both.withColumn("names_agree", (F.length("name") == F.length("__name")) & (unlike <= 2)).drop("__name")


def locate_primers(pairs: DataFrame, up: str, down: str) -> DataFrame:
    """Pairs with each primer once, R1 beginning after ``up`` and R2 after ``down``; swapped pairs are put right."""
    u, d = disambiguate(up), disambiguate(down)
    once = lambda c, p: F.regexp_count(c, F.lit(p)) == 1
    long = pairs.where((F.length("r1") > 50) & (F.length("r2") > 50))
    forward = once("r1", u) & once("r2", d)
    swapped = ~forward & once("r1", d) & once("r2", u)
    both = long.withColumn("__swap", swapped).where(forward | swapped)
    pick = lambda a, b: F.when(F.col("__swap"), F.col(b)).otherwise(F.col(a))
    right = both.select("ord", pick("r1", "r2").alias("r1"), pick("q1", "q2").alias("q1"), pick("r2", "r1").alias("r2"), pick("q2", "q1").alias("q2"))
    after = lambda c, s, p: F.substring(c, F.regexp_instr(s, F.lit(p)) + F.length(F.regexp_extract(s, f"({p})", 1)), F.lit(1 << 30))
    return right.select("ord", after(F.col("r1"), "r1", u).alias("r1"), after(F.col("q1"), "r1", u).alias("q1"), after(F.col("r2"), "r2", d).alias("r2"), after(F.col("q2"), "r2", d).alias("q2"))


def overlap_start(r1: Column, r2: Column, seed: int = 16) -> Column:
    """Where the first base of ``r2`` (already reverse-complemented) lies in ``r1``.

    The first run of ``seed`` bases of r2 that stands exactly once in r1 decides; null if it
    would start before r1, or if there is none.
    """
    n = F.length(r2) - seed + 1
    times = lambda k: (F.length(r1) - F.length(F.replace(r1, k, F.lit("")))) / seed
    first = F.substring(r2, 1, seed)  # decides nearly always, so the search below is rarely run
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("i"), F.substring(r2, i, F.lit(seed)).alias("k")))
    once = F.filter(runs, lambda s: (F.length(s["k"]) == seed) & (times(s["k"]) == 1))
    hit = F.get(once, F.lit(0))
    start = F.instr(r1, hit["k"]) - hit["i"] + 1
    return F.when((n > 0) & (times(first) == 1), F.instr(r1, first)).when((n > 0) & (start > 0), start)


def located(pairs: DataFrame, seed: int = 16) -> DataFrame:
    """The pairs with ``y``, the reverse complement of r2, and ``at``, where it starts in r1."""
    return once(once(pairs, y=reverse_complement(F.col("r2"))), at=overlap_start(F.col("r1"), F.col("y"), seed))


def stitch(pairs: DataFrame, up: str | None = None, down: str | None = None, min_diff: int = 6, seed: int = 16) -> DataFrame:
    """Consensus of overlapping mates: ord, seq, qual.

    In the overlap equal bases stay, of unequal ones the better (a tie keeps R1), N if their
    qualities differ by less than ``min_diff``; the quality is the larger one.
    """
    rows = locate_primers(pairs, up, down) if up else pairs
    rows = located(rows, seed).select("ord", "r1", "q1", "y", F.reverse("q2").alias("qy"), "at").where("at IS NOT NULL")
    rows = rows.withColumn("n", F.length("r1") - F.col("at") + 1).where(F.col("n") <= F.length("y"))
    over1, over2 = F.substring("r1", F.col("at"), F.col("n")), F.substring("y", F.lit(1), F.col("n"))
    q1, q2 = letters(F.substring("q1", F.col("at"), F.col("n"))), letters(F.substring("qy", F.lit(1), F.col("n")))

    def base(z: Column) -> Column:
        return F.when(z["a"] == z["b"], z["a"]).when(F.abs(F.ascii(z["p"]) - F.ascii(z["q"])) < min_diff, F.lit("N")).when(z["p"] < z["q"], z["b"]).otherwise(z["a"])

    zipped = F.arrays_zip(letters(over1).alias("a"), letters(over2).alias("b"), q1.alias("p"), q2.alias("q"))
    middle = F.when(over1 == over2, over1).otherwise(F.array_join(F.transform(zipped, base), ""))
    better = F.array_join(F.zip_with(q1, q2, lambda p, q: F.greatest(p, q)), "")  # codes order as scores do
    ends = lambda x, mid, y: F.concat(F.substring(x, F.lit(1), F.col("at") - 1), mid, F.substring(y, F.col("n") + 1, F.lit(1 << 30)))
    return rows.select("ord", ends(F.col("r1"), middle, F.col("y")).alias("seq"), ends(F.col("q1"), better, F.col("qy")).alias("qual"))


def _tag_columns(tags: dict[str, str]) -> tuple[list[str], list[str], dict[tuple[str, str], str]]:
    forward, reverse, sample = [], [], {}
    for name, pair in tags.items():
        f, _, r = pair.partition(":")
        r = r if ":" in pair else pair
        forward += [f] * (f not in forward)
        reverse += [r] * (r not in reverse)
        sample.setdefault((f, r), name)
    return forward, reverse, sample


def demultiplex(reads: DataFrame, tags: dict[str, str] | list[str], up: str, down: str, adapter2: str | None = None) -> DataFrame:
    """Single-end reads cut out between tags and primers: the input's columns and ``sample_id``.

    The first forward tag that matches decides, then the first reverse tag paired with it; a
    read whose forward tag has no matching reverse tag is dropped.
    """
    tags = tags if isinstance(tags, dict) else {f"sample_{i}": t for i, t in enumerate(tags, 1)}
    forward, reverse, sample = _tag_columns(tags)
    u, d = disambiguate(up), disambiguate(rc(down))
    rows = reads if adapter2 is None else reads.where(F.col("seq").rlike(rc(adapter2)))
    first = F.coalesce(*(F.when(F.col("seq").rlike(f + u), F.lit(f)) for f in forward))
    rows = once(rows, __f=F.when(F.col("seq").rlike(f".+{u}.+{d}.+"), first)).where("__f IS NOT NULL")
    start = F.length("__f") + len(up) + 1
    cut = lambda c: F.substring(c, start, F.lit(1 << 30))
    rows = rows.withColumn("seq", cut(F.col("seq"))).withColumn("qual", cut(F.col("qual")))
    found = [F.when((F.col("__f") == f) & F.col("seq").rlike(d + rc(r)), F.struct(F.lit(sample[f, r]).alias("sample_id"), F.regexp_instr("seq", F.lit(d + rc(r))).alias("end"))) for f in forward for r in reverse if (f, r) in sample]
    rows = once(rows, __hit=F.coalesce(*found)).where("__hit IS NOT NULL")
    keep = lambda c: F.substring(c, F.lit(1), F.col("__hit.end") - 1)
    return rows.withColumn("seq", keep(F.col("seq"))).withColumn("qual", keep(F.col("qual"))).withColumn("sample_id", F.col("__hit.sample_id")).drop("__f", "__hit")


def demultiplex_pairs(pairs: DataFrame, tags: dict[str, str] | list[str], up: str, down: str, adapter1: str | None = None, adapter2: str | None = None) -> DataFrame:
    """Paired reads (r1, q1, r2, q2) without tags and primers, and ``sample_id``."""
    tags = tags if isinstance(tags, dict) else {f"sample_{i}": t for i, t in enumerate(tags, 1)}
    forward, reverse, sample = _tag_columns(tags)
    u, d = disambiguate(up), disambiguate(down)
    rows = pairs
    if adapter2 is not None:
        rows = rows.where(F.col("r1").rlike(rc(adapter2)))
    if adapter1 is not None:
        rows = rows.where(F.col("r2").rlike(rc(adapter1)))
    tag = F.coalesce(*(F.when(F.col("r1").rlike(f + u), F.lit(f)) for f in forward))
    rows = once(rows, __f=F.when(F.col("r1").rlike(f".+{u}.+") & F.col("r2").rlike(f".+{d}.+"), tag)).where("__f IS NOT NULL")
    found = [F.when((F.col("__f") == f) & F.col("r2").rlike(f"^{r}{d}"), F.struct(F.lit(sample[f, r]).alias("sample_id"), F.lit(len(r) + len(down) + 1).alias("start"))) for f in forward for r in reverse if (f, r) in sample]
    rows = once(rows, __hit=F.coalesce(*found)).where("__hit IS NOT NULL")
    first = F.length("__f") + len(up) + 1
    return (
        rows.withColumn("r1", F.substring("r1", first, F.lit(1 << 30)))
        .withColumn("q1", F.substring("q1", first, F.lit(1 << 30)))
        .withColumn("r2", F.substring("r2", F.col("__hit.start"), F.lit(1 << 30)))
        .withColumn("q2", F.substring("q2", F.col("__hit.start"), F.lit(1 << 30)))
        .withColumn("sample_id", F.col("__hit.sample_id"))
        .drop("__f", "__hit")
    )
