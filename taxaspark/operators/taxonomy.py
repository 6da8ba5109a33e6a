"""Taxonomy operators over the table (taxID, parent_taxID, rank, name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.sequences import lowest_ancestor
from .reads import rank_by

MAX_DEPTH = 100


def closure(taxonomy: DataFrame) -> DataFrame:
    """(taxID, distance, anc_taxID, anc_rank, anc_name): every taxon with itself and its ancestors.

    Read off the lineages of :func:`levels`, so that neither rows nor depth of a recursion are limited.
    A cycle raises an error.
    """
    above = levels(taxonomy).select("taxID", F.posexplode(F.reverse("lineage")).alias("distance", "anc"))
    return above.select("taxID", "distance", F.col("anc.taxID").alias("anc_taxID"), F.col("anc.rank").alias("anc_rank"), F.col("anc.name").alias("anc_name"))


_LEVELS: dict[tuple[str, int], DataFrame] = {}


def levels(taxonomy: DataFrame) -> DataFrame:
    """taxID and ``lineage``, an array of (rank, taxID, name) root first, by joins of doubling reach.

    After k rounds a taxon knows 2**k ancestors, so a taxonomy of any size takes log2(depth)
    joins and no recursion limit applies.  Each round is materialised (else plans would
    double too), and the result is kept for the session: every lineage operator reads it.
    """
    spark = taxonomy.sparkSession
    key = (spark.sparkContext.applicationId, taxonomy.semanticHash())
    if key in _LEVELS:
        return _LEVELS[key]
    known = taxonomy.select("taxID", F.col("parent_taxID").alias("next"), F.array(F.struct("rank", "taxID", "name")).alias("lineage"))
    for _ in range(8):  # 2 ** 7 > MAX_DEPTH
        known = kept(known)
        if not known.where("next IS NOT NULL").limit(1).count():
            break
        up = known.select(F.col("taxID").alias("next"), F.col("next").alias("further"), F.col("lineage").alias("above"))
        known = known.join(up, "next", "left").select("taxID", F.col("further").alias("next"), F.concat(F.coalesce("above", F.array().cast(known.schema["lineage"].dataType)), "lineage").alias("lineage"))
    else:
        raise ValueError("cycle in the taxonomy")
    while len(_LEVELS) >= 8:
        _LEVELS.pop(next(iter(_LEVELS)))
    _LEVELS[key] = known.select("taxID", "lineage")
    return _LEVELS[key]


def kept(df: DataFrame) -> DataFrame:
    """The rows materialised: in the cluster's checkpoint folder, or cached where there is none."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.cache()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to as many tasks as the session's shuffles have: groups of few bytes but much work must not be put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def lineage(ids: DataFrame, taxonomy: DataFrame, numbers: bool = False) -> DataFrame:
    """Each (taxID) with its lineage joined by ``; ``, names or numbers; null for an unknown or null taxID."""
    lin = levels(taxonomy).select("taxID", F.array_join(F.transform("lineage", lambda x: x["taxID"].cast("string") if numbers else x["name"]), "; ").alias("lineage"))
    return ids.join(lin, "taxID", "left")


def rank_of(lin: Column, rank: str) -> Column:
    """The name at a rank of a lineage array, ``''`` where it has none."""
    return F.coalesce(F.get(F.filter(lin, lambda x: x["rank"] == rank), F.lit(0))["name"], F.lit(""))


def rank_columns(ids: DataFrame, taxonomy: DataFrame, ranks: list[str]) -> DataFrame:
    """Each (taxID) with one column per rank."""
    lin = levels(taxonomy)
    return ids.join(lin, "taxID", "left").select("taxID", *[rank_of(F.col("lineage"), r).alias(r) for r in ranks])


def first_by_name(taxonomy: DataFrame) -> DataFrame:
    """name, the smallest taxID of that name, and how many taxa have it."""
    return taxonomy.groupBy("name").agg(F.min("taxID").alias("taxID"), F.count(F.lit(1)).alias("n"))


def tax_ids(lineages: DataFrame, taxonomy: DataFrame, multimatch: int | None = None) -> DataFrame:
    """The taxID of each lineage string (names joined by ``; ``, root first).

    A name that one taxon has gives that taxon; of homonyms the one whose own lineage holds
    all given names is taken, ``multimatch`` if that is not exactly one.
    """
    asked = lineages.select("lineage").distinct().withColumn("parts", F.split("lineage", "; ")).withColumn("name", F.element_at("parts", -1))
    by_name = first_by_name(taxonomy)
    single = asked.join(by_name.where("n = 1"), "name").select("lineage", "taxID")
    double = asked.join(by_name.where("n > 1").select("name"), "name", "left_semi")
    known = levels(taxonomy).select("taxID", F.transform("lineage", lambda x: x["name"]).alias("names"))
    among = taxonomy.select("taxID", "name").join(double.select("name").distinct(), "name", "left_semi").join(known, "taxID")
    fits = double.join(among, "name").where(F.size(F.array_except("parts", "names")) == 0)
    chosen = fits.groupBy("lineage").agg(F.count(F.lit(1)).alias("n"), F.min("taxID").alias("taxID"))
    resolved = double.select("lineage").join(chosen, "lineage", "left").select("lineage", F.when(F.col("n") == 1, F.col("taxID")).otherwise(F.lit(multimatch).cast("int")).alias("taxID"))
    return lineages.join(single.unionByName(resolved), "lineage", "left")


def prune(taxonomy: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The listed taxa (taxID) and all their ancestors, or everything but them and their descendants."""
    lin = levels(taxonomy)
    if keep:
        wanted = lin.join(ids, "taxID", "left_semi").select(F.explode("lineage.taxID").alias("taxID")).distinct()
        return taxonomy.join(wanted, "taxID", "left_semi")
    under = lin.select("taxID", F.explode("lineage.taxID").alias("anc")).join(ids.select(F.col("taxID").alias("anc")).distinct(), "anc", "left_semi").select("taxID").distinct()
    return taxonomy.join(under, "taxID", "left_anti")


def from_dumps(nodes: DataFrame, names: DataFrame, synonyms: bool = False) -> DataFrame:
    """A taxonomy of node rows (taxID, parent_taxID, rank) and name rows (taxID, name, kind)."""
    scientific = names.where("kind = 'scientific name'").select("taxID", "name")
    out = nodes.join(scientific, "taxID").select("taxID", F.when(F.col("taxID") == 1, 0).otherwise(F.col("parent_taxID")).alias("parent_taxID"), "rank", "name")
    if synonyms:
        other = names.where("kind = 'synonym'").select("taxID", F.col("name").alias("synonym"))
        out = out.unionByName(other.join(out, "taxID").select("taxID", "parent_taxID", "rank", F.col("synonym").alias("name")))
    return out


def rdp_lineages(names: DataFrame) -> DataFrame:
    """ord, parts: lineages of names ``id<TAB>Root;a;b``; those shorter than the longest are dropped."""
    text = F.regexp_replace(F.regexp_replace("name", r"^.*\t", ""), "; ", ";")
    text = F.regexp_replace(F.when(text.startswith("Root"), text).otherwise(F.concat(F.lit("Root;"), text)), ";$", "")
    rows = names.select("ord", F.split(text, ";").alias("parts"))
    longest = rows.agg(F.max(F.size("parts")).alias("most"))
    return rows.join(F.broadcast(longest), F.size("parts") == F.col("most")).select("ord", "parts")  # one row


def rdp_taxonomy(names: DataFrame, depth: int) -> DataFrame:
    """A taxonomy numbered level by level in order of first appearance.

    Ranks of one level are ``rank<level>``; a taxon is told by its parent and name.
    """
    parts = rdp_lineages(names)
    exploded = parts.select("ord", F.posexplode("parts").alias("pos", "name"), "parts").where(F.col("pos") < depth)
    path = F.array_join(F.slice("parts", 1, F.col("pos") + 1), ";")
    up = F.array_join(F.slice("parts", 1, F.col("pos")), ";")
    taxa = exploded.select("ord", "pos", "name", path.alias("path"), up.alias("up")).groupBy("pos", "path", "up", "name").agg(F.min("ord").alias("first"))
    # One number orders the taxa: level, then first name, then place among the taxa that begin with that name (one a level).
    numbered = rank_by(taxa.withColumn("__at", F.col("pos").cast("bigint") * (1 << 56) + F.col("first")), "__at", "__n").withColumn("taxID", F.col("__n").cast("int")).drop("__at", "__n")
    parent = numbered.select(F.col("path").alias("up"), F.col("taxID").alias("parent_taxID"))
    return numbered.join(parent, "up", "left").select("taxID", F.coalesce("parent_taxID", F.lit(0)).alias("parent_taxID"), F.concat(F.lit("rank"), (F.col("pos") + 1).cast("string")).alias("rank"), "name")


def ancestor_by(rows: DataFrame, group: str, lin: str = "lineage") -> DataFrame:
    """The lowest common ancestor of each group of lineage strings, as a lineage string.

    Equal lineages are combined first, so a group holds its distinct lineages only.
    """
    distinct = rows.select(group, F.split(lin, "; ").alias("parts")).distinct()
    return distinct.groupBy(group).agg(F.array_join(lowest_ancestor(F.collect_list("parts")), "; ").alias("ancestor"))
