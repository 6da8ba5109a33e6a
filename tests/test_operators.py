"""Golden values, round trips and properties of the sequence operators."""

import gzip
import glob
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaspark.functions import sequences as S
from taxaspark.operators import classify as C
from taxaspark.operators import curate as U
from taxaspark.operators import kmers as K
from taxaspark.operators import learn as L
from taxaspark.operators import reads as R
from taxaspark.operators import taxonomy as T
from taxaspark.sources import fastx, ncbi
from taxaspark.streaming import reads as stream


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_golden_values(spark):
    assert S.rc("TATTG") == one(spark, S.reverse_complement, "TATTG") == "CAATA"
    assert S.disambiguate("GGWACWGG") == one(spark, S.disambiguated, "GGWACWGG") == "GG[AT]AC[AT]GG"
    assert S.disambiguate("I") == "[ACGT]"
    with pytest.raises(ValueError):
        S.disambiguate("QQ")
    assert one(spark, S.phred, "!I~") == [0, 40, 93] and one(spark, S.from_phred, [0, 40, 93], "array<int>") == "!I~"
    assert one(spark, lambda c: S.translate_codons(c, 1), "ATGTAAAAN") == "M*X"
    assert one(spark, S.tax_id_of, "a|b|12") == 12 and one(spark, S.tax_id_of, "none") is None
    assert one(spark, lambda c: S.wrap(c, 3), "ACGTACG") == "ACG\nTAC\nG"
    assert one(spark, S.lowest_ancestor, [["a", "b", "c"], ["a", "b"], ["a", "b", "d"]], "array<array<string>>") == ["a", "b"]
    assert one(spark, S.lowest_ancestor, [["a"], ["b"]], "array<array<string>>") == []
    # lineages that part and meet again: three elements of the shortest are shared, so its first three count
    assert one(spark, S.lowest_ancestor, [["a", "x", "c", "d", "e"], ["a", "b", "c", "d"]], "array<array<string>>") == ["a", "b", "c"]
    assert one(spark, S.lowest_ancestor, [["b", "c"], ["a", "c"]], "array<array<string>>") == ["a"]


def reads(spark, rows):
    return spark.createDataFrame(rows, "ord bigint, name string, seq string, qual string, sample string")


def test_reverse_complement_twice_is_identity(spark):
    rng = np.random.default_rng(1)
    seqs = ["".join(rng.choice(list(S.IUPAC), 30)) for _ in range(50)]
    df = spark.createDataFrame([(s,) for s in seqs], "x string").select("x", S.reverse_complement(S.reverse_complement(F.col("x"))).alias("y"))
    assert all(r.x == r.y for r in df.collect())


def test_dereplication_round_trip(spark):
    rows = reads(spark, [(i, f"n{i}", "ACGT" * (1 + i % 3), "I" * 4, "s") for i in range(10)])
    unique, members = R.dereplicate(rows)
    assert unique.count() == 3
    back = R.rereplicate(unique, members).collect()
    assert sorted((r.ord, r.seq) for r in back) == sorted((r.ord, r.seq) for r in rows.collect()) and all(r.weight == 1 for r in back)


def test_quality_filter_counts_only_survivors(spark):
    good, bad = "I" * 60, "#" * 60
    rows = reads(spark, [(1, "a", "A" * 60, good, "s"), (2, "b", "A" * 60, bad, "s"), (3, "c", "C" * 60, good, "s"), (4, "d", "C" * 60, good, "s"), (5, "e", "N" * 60, good, "s")])
    assert sorted(r.ord for r in R.quality_filter(rows).collect()) == [3, 4]
    assert sorted(r.ord for r in R.quality_filter(rows, None, None, None, None, None).collect()) == [1, 2, 3, 4, 5]


def test_stitch_resolves_mismatches(spark):
    rng = np.random.default_rng(2)
    s = "".join(rng.choice(list("ACGT"), 100))
    r1, r2 = s[:70], s[30:]
    worse = r2[:20] + ("A" if r2[20] != "A" else "C") + r2[21:]
    close = r2[:25] + ("A" if r2[25] != "A" else "C") + r2[26:]
    rows = [(1, r1, "I" * 70, S.rc(worse), "5" * 70), (2, r1, "I" * 70, S.rc(close), "H" * 70), (3, r1, "I" * 70, S.rc("".join(rng.choice(list("ACGT"), 70))), "I" * 70)]
    got = {r.ord: r for r in R.stitch(spark.createDataFrame(rows, "ord bigint, r1 string, q1 string, r2 string, q2 string")).collect()}
    assert got[1].seq == s and len(got[1].qual) == 100 and got[2].seq == s[:55] + "N" + s[56:] and 3 not in got


def test_demultiplex_takes_the_first_forward_tag(spark):
    tags = {"a": "AAAC:GGGT", "b": "AAAC:CCCA", "c": "TTTG:GGGT"}
    inner = "ACGTAC" * 5
    seq = lambda f, r: f + "GGAACAGG" + inner + S.rc("CCTTCCTT") + S.rc(r)
    rows = reads(spark, [(1, "x", seq("AAAC", "CCCA"), "I" * 58, "s"), (2, "y", seq("TTTG", "CCCA"), "I" * 58, "s"), (3, "z", seq("TTTG", "GGGT"), "I" * 58, "s")])
    got = {r.ord: (r.sample_id, r.seq) for r in R.demultiplex(rows, tags, "GGWACWGG", "CCTTCCTT").collect()}
    assert got == {1: ("b", inner), 3: ("c", inner)}


TAXA = [(1, 0, "no rank", "root"), (2, 1, "kingdom", "k"), (3, 2, "genus", "Aus"), (4, 3, "species", "Aus aus"), (5, 3, "species", "Aus bus"), (6, 2, "genus", "Bus"), (7, 6, "species", "Bus cus"), (8, 1, "genus", "Bus")]


@pytest.fixture()
def taxa(spark):
    return spark.createDataFrame(TAXA, "taxID int, parent_taxID int, rank string, name string")


def test_taxonomy_lookups(spark, taxa):
    ask = spark.createDataFrame([(4,), (99,), (None,)], "taxID int")
    assert {r.taxID: r.lineage for r in T.lineage(ask, taxa).collect()} == {4: "root; k; Aus; Aus aus", 99: None, None: None}
    names = spark.createDataFrame([("Aus aus",), ("k; Bus",), ("Bus",)], "lineage string")
    assert {r.lineage: r.taxID for r in T.tax_ids(names, taxa).collect()} == {"Aus aus": 4, "k; Bus": 6, "Bus": None}
    assert sorted(r.taxID for r in T.prune(taxa, spark.createDataFrame([(4,)], "taxID int")).collect()) == [1, 2, 3, 4]
    assert sorted(r.taxID for r in T.prune(taxa, spark.createDataFrame([(3,)], "taxID int"), keep=False).collect()) == [1, 2, 6, 7, 8]
    cycle = spark.createDataFrame([(1, 2, "a", "a"), (2, 1, "b", "b")], taxa.schema)
    with pytest.raises(ValueError):
        T.levels(cycle)


def test_purge_needs_a_clear_majority(spark, taxa):
    rows = [(f"S{i:03d}x|4", 4, 1) for i in range(5)] + [("Z999x|7", 7, 1), ("S001y|4", 4, 2), ("S002y|7", 7, 2), ("S003y|7", 7, 3)]
    seqs = spark.createDataFrame(rows, "name string, tax_id int, otu bigint")
    flagged = U.flag_mislabelled(seqs, taxa, "genus").collect()
    assert [(r.name, r.listed, r.suggested, r.nstudies) for r in flagged] == [("Z999x|7", "Bus", "Aus", 6)]
    assert U.purge(seqs, taxa, "genus").count() == 8


def test_pcr_cuts_between_primers(spark):
    rng = np.random.default_rng(3)
    inner = "".join(rng.choice(list("ACGT"), 80))
    up, down = "CGGTTGGGGTGACCTCGGAGTA", "GCTGTTATCCCTAGGGTAACTT"
    rows = reads(spark, [(1, "a", "TTTT" + up + inner + S.rc(down) + "GG", "", "s"), (2, "b", inner, "", "s")])
    got = U.virtual_pcr(rows, up, down, trim_primers=True).collect()
    assert [(r.ord, r.seq) for r in got] == [(1, inner)] and got[0].forscore == 5 * len(up)
    shaved = U.shave(reads(spark, [(1, "a", "TTTT" + up + "GGGG", "I" * 30, "s")]), up).first()
    assert shaved.seq == up and len(shaved.qual) == len(up)
    fish = U.virtual_fish(rows, inner, up=up, down=down).collect()
    assert {(r.ord, r.seq) for r in fish} == {(1, inner), (2, inner)}


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("ACGT"), int(n))) for n in rng.integers(30, 60, 80)]
    df = spark.createDataFrame(list(enumerate(seqs)), "train bigint, seq string").repartition(5)
    got = K.nearest(df.where("train < 10").select(F.col("train").alias("query"), "seq"), df, 5).collect()
    size = np.array([len(s) - 3 for s in seqs])[:, None]
    freq, capped = K.count_matrix(seqs) / size, np.minimum(K.count_matrix(seqs), K.CAP) / size
    for q in range(10):
        d = ((freq[q] - capped) ** 2).sum(axis=1) * len(seqs[q]) / 8
        want = sorted(zip(np.round(d, 9), range(80)))[:5]
        mine = sorted((r.place, r.distance, r.train) for r in got if r.query == q)
        assert [m[1] for m in mine] == pytest.approx([w[0] for w in want], abs=1e-9) and mine[0][2] == q


def clade_reads(rng, n=6):
    rows, k = [], 0
    for tax in (4, 5, 7):
        base = "".join(rng.choice(list("ACGT"), 60))
        for _ in range(n):
            s = list(base)
            s[int(rng.integers(60))] = "ACGT"[int(rng.integers(4))]
            rows.append((k, "".join(s), tax))
            k += 1
    return rows


def test_learned_tree_classifies_left_out_sequences(spark, taxa):
    rows = clade_reads(np.random.default_rng(5))
    training = spark.createDataFrame(rows[1:], "train bigint, seq string, taxID int")
    model = L.learn(training, taxa, max_waves=4)
    nodes = {r.clade: r for r in model.nodes.collect()}
    assert nodes[""].ntotal == len(rows) - 1 and len(nodes) >= 3
    left = reads(spark, [(0, "q_1", rows[0][1], "", "s"), (1, "q_2", rows[0][1], "", "s")])
    got = C.classify(left, model, ping_at=0.0, mincount=1, offset=-20, species="all").collect()
    assert len(got) == 2 and len({(r.taxID, r.score) for r in got}) == 1 and got[0].taxID in (1, 2, 3, 4) and got[0].genus in ("", "Aus")
    exact = C.classify(reads(spark, [(0, "q_1", rows[1][1], "", "s")]), model, species="ping100").first()
    assert exact.taxID == 4 and exact.score is None and exact.taxon == "Aus aus"
    with pytest.raises(ValueError):
        L.expand(model, ["99"])
    short = L.learn(training, taxa, recursive=False)
    grown = L.expand(short, [""], max_waves=4)
    assert {r.clade for r in short.nodes.collect()} <= {r.clade for r in grown.nodes.collect()} and grown.members.count() == short.members.count()


def test_species_are_masked_without_an_exact_hit(spark, taxa):
    rows = spark.createDataFrame([(4, 0.9, False), (5, None, True), (3, 0.9, False)], "taxID int, score double, exact boolean")
    assert sorted(r.taxID for r in C.mask_species(rows, taxa, "ping100").collect()) == [3, 3, 5]
    assert sorted(r.taxID for r in C.mask_species(rows, taxa, "none").collect()) == [3, 3, 3]
    assert sorted(r.taxID for r in C.mask_species(rows, taxa, "all").collect()) == [3, 4, 5]


def test_cross_validation_marks_one_of_two_sibling_leaves(spark):
    rows = [(r[0], r[1]) for r in clade_reads(np.random.default_rng(6), 4)[:8]]
    got = {r.ord: r.query for r in U.allocate_cvi(spark.createDataFrame(rows, "ord bigint, seq string"), 0.9).collect()}
    assert len(got) == 8 and 0 < sum(got.values()) < 8
    assert len({got[i] for i in range(4)}) == 1 or len({got[i] for i in range(4, 8)}) == 1


def test_large_clusters_are_split_in_all_tasks(spark):
    rng = np.random.default_rng(8)
    ends = ["".join("ACGT"[i] for i in rng.choice(4, 150, p=p)) for p in ([0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1])]
    made = [e[:j] + "ACGT"[int(rng.integers(4))] + e[j + 1 :] for e in ends for j in range(0, 60, 2)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(made + made[:5])], "ord bigint, seq string")
    whole = {r.ord: r.query for r in U.allocate_cvi(rows, 0.9).collect()}
    dealt = {r.ord: r.query for r in U.allocate_cvi(rows, 0.9, most=10).collect()}
    assert whole == dealt and len(whole) == 95 and 0 < sum(whole.values()) < 95
    assert all(whole[i] == whole[90 + i] for i in range(5))
    drawn = {r.ord: r.query for r in U.allocate_cvi(rows, 0.9, "sample").collect()}
    assert len(drawn) == 95 and 0 < sum(drawn.values()) < 95
    alike = spark.createDataFrame([(i, "ACGT" * 20) for i in range(4)], "ord bigint, seq string")
    assert not any(r.query for r in U.allocate_cvi(alike, 0.9, most=0).collect())
    with pytest.raises(ValueError):
        U.allocate_cvi(rows, 0.9, "first")


def test_large_leaves_are_scored_whole_under_sampled_models(spark, taxa):
    rng = np.random.default_rng(9)
    ends = ["".join(rng.choice(list("ACGT"), 60)) for _ in range(2)]
    rows = [(100 * t + j, e[:j] + "N" + e[j + 1 :], 4 + t) for t, e in enumerate(ends) for j in range(30)]
    members = L.members_of(spark.createDataFrame(rows, "train bigint, seq string, taxID int"), taxa)
    split = lambda df: {r.uid: r.clade for r in L.leaves_of(df).collect()}
    whole, sampled = (split(L.grow(members, "ACGT", 1, sample=n)) for n in (1000, 12))
    assert set(whole) == set(sampled) and set(whole.values()) == set(sampled.values()) == {"1", "2"}
    same = sum(whole[u] == sampled[u] for u in whole) / len(whole)
    assert same in (0.0, 1.0)  # the same halves, under either number
    assert set(split(L.grow(members, "ACGT", 1, sample=12, min_score=1.0)).values()) == {""}


def test_retried_splits_need_enough_informative_columns():
    x = np.array([[0, 1] * 30, [0, 1] * 30, [1, 0] * 30])
    assert L.informative_split(x).tolist() == [0, 0, 1] and L.informative_split(x[:, :50]) is None


def test_files_round_trip(spark, tmp_path):
    rows = reads(spark, [(i, f"r{i} x", "ACGT" * 10, "@" + "I" * 39, "s") for i in range(50)])
    fastx.write_fastq(rows.coalesce(1), f"{tmp_path}/fq")
    file = glob.glob(f"{tmp_path}/fq/part-*")[0]
    spark.dataSource.register(fastx.FastqSource)
    back = spark.read.format("fastq").option("path", file).option("splitBytes", "700").load()
    assert sorted((r.name, r.seq, r.qual) for r in back.collect()) == sorted((r.name, r.seq, r.qual) for r in rows.collect())
    fastx.write_fasta(rows.coalesce(1), f"{tmp_path}/fa", width=7, compress=True)
    packed = glob.glob(f"{tmp_path}/fa/part-*.gz")[0]
    assert gzip.open(packed, "rt").read().startswith(">r0 x\nACGTACG\n")
    assert {(r.name, r.seq) for r in fastx.read_fasta(spark, f"{tmp_path}/fa").collect()} == {(r.name, r.seq) for r in rows.collect()}
    lines = spark.createDataFrame([(0, "@a"), (1, "AC"), (2, "+"), (3, "@I"), (4, "@b"), (5, "GT"), (6, "+"), (7, "II")], "line_no bigint, line string")
    assert sorted(r.name for r in fastx.fastq_records(lines).collect()) == ["a", "b"]
    assert [r.name for r in fastx.fastq_records(lines, legacy=True).collect()] == ["b"]


def test_demultiplexed_files(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "n1", "AC", "II", "GT", "JJ"), ("b", "n2", "CC", "II", "GG", "JJ")], "sample_id string, name string, r1 string, q1 string, r2 string, q2 string")
    fastx.write_pair_samples(pairs, f"{tmp_path}/out")
    assert open(glob.glob(f"{tmp_path}/out/sample_id=a/mate=R2/part-*")[0]).read() == "@n1\nGT\n+\nJJ\n"


def test_dumps_and_xml(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n")
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tAus\t|\t\t|\tscientific name\t|\n2\t|\tOld\t|\t\t|\tsynonym\t|\n")
    got = ncbi.read_taxonomy(spark, f"{tmp_path}/nodes.dmp", f"{tmp_path}/names.dmp", synonyms=True)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "no rank", "root"), (2, 1, "genus", "Aus"), (2, 1, "genus", "Old")]
    rec = lambda a, org: f"<GBSeq><GBSeq_locus>{a}</GBSeq_locus>{org}<GBSeq_taxonomy>t</GBSeq_taxonomy><GBQualifier_value>taxon:9</GBQualifier_value><GBSeq_sequence>acgt</GBSeq_sequence></GBSeq>"
    org = "<GBSeq_organism>o</GBSeq_organism>"
    docs = spark.createDataFrame([(f"<s>{rec('A', org)}{rec('B', org)}</s>",), (f"<s>{rec('C', '')}{rec('D', org)}</s>",)], "doc string")
    assert sorted((r.accession, r.tax_id, r.seq) for r in ncbi.xml_records(docs).collect()) == [("A", 9, "ACGT"), ("B", 9, "ACGT"), ("D", 9, "ACGT")]


def test_entrez_pages(monkeypatch):
    asked = []

    def answer(url, *_, **__):
        asked.append(url)
        if "esearch" in url:
            return b"<r><Count>1200</Count><WebEnv>w</WebEnv><QueryKey>1</QueryKey></r>"
        return b"<s><GBSeq><GBSeq_locus>A</GBSeq_locus><GBSeq_organism>o</GBSeq_organism><GBSeq_taxonomy>t</GBSeq_taxonomy><GBQualifier_value>taxon:9</GBQualifier_value><GBSeq_sequence>acgt</GBSeq_sequence></GBSeq></s>"

    monkeypatch.setattr(ncbi, "fetch", answer)
    reader = ncbi.EntrezReader({"query": "COI", "base": "http://x/"})
    pages = reader.partitions()
    assert len(pages) == 3 and list(reader.read(pages[1])) == [("A", 9, "o", "t", "ACGT")] and "retstart=500" in asked[-1]
    with pytest.raises(ValueError):
        ncbi.EntrezReader({})


def test_streams(spark, tmp_path):
    up = "GGAACAGG"
    rows = [(i, f"n{i}", "TT" + up + "ACGT" * 20, "I" * 90) for i in range(3)]
    spark.createDataFrame(rows, "ord bigint, name string, seq string, qual string").withColumn("at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = stream.first_seen(stream.clean(source, up, None), "at").writeStream.format("memory").queryName("clean_reads").start()
    q.processAllAvailable()
    q.stop()
    assert [r.seq for r in spark.table("clean_reads").collect()] == ["ACGT" * 20]


def test_rollup_matches_the_published_table(spark):
    # taxID, score and counts of a published 16-row table's repeated taxa.
    rows = [(1, 2806, 0.9981, 156, 5600), (2, 2806, 0.99, 28, 3267), (3, 2806, 0.99, 20, 2409), (4, 2806, 0.99, 0, 2149), (5, 2806, 0.99, 0, 1725), (6, 39820, 0.9, 2379, 0), (7, 39820, 0.9, 1481, 0), (8, 131567, 0.9, 3024, 0), (9, 131567, 0.9, 1729, 9)]
    got = {r.taxID: (r.score, r.a, r.b) for r in C.rollup(spark.createDataFrame(rows, "ord bigint, taxID int, score double, a int, b int")).collect()}
    assert got == {2806: (0.9981, 204, 15150), 39820: (0.9, 3860, 0), 131567: (0.9, 4753, 9)}


def test_names_and_abundance(spark):
    got = R.named(spark.createDataFrame([(5, "A"), (2, "C")], "ord bigint, seq string")).collect()
    assert {r.seq: r.name for r in got} == {"C": "S1", "A": "S2"}
    wide = spark.createDataFrame([("x", 1, 0), ("y", 2, 3)], "sample string, ACGT int, GGTT int")
    assert sorted(tuple(r) for r in R.from_abundance(wide).collect()) == [("x", "ASV1", "ACGT", 1), ("x", "ASV2", "GGTT", 0), ("y", "ASV1", "ACGT", 2), ("y", "ASV2", "GGTT", 3)]


def test_translated_tree_and_metadata(spark, taxa, tmp_path):
    rng = np.random.default_rng(8)
    codons = [c for c in (a + b + d for a in "ACGT" for b in "ACGT" for d in "ACGT") if c not in ("TAA", "TAG", "TGA")]
    rows = []
    for tax in (4, 5, 7):
        base = list(rng.choice(codons, 25))
        for k in range(6):
            s = list(base)
            s[k] = str(rng.choice(codons))
            rows.append((len(rows), "".join(s), tax))
    training = spark.createDataFrame(rows, "train bigint, seq string, taxID int")
    L.learn(training, taxa, max_waves=3, numcode=1).save(f"{tmp_path}/model")
    model = C.Classifier.load(spark, f"{tmp_path}/model")
    assert model.numcode == 1 and model.nodes.where("aaleaf").count() >= 2
    asked = reads(spark, [(0, "q_1", rows[0][1], "", "s"), (1, "q_2", rows[0][1][:-1], "", "s"), (2, "q_3", "TAA" + rows[0][1][3:], "", "s")])
    got = {r.ord: r for r in C.classify(asked, model, ping_at=0.0, mincount=1, offset=-20, species="all", metadata=True).collect()}
    assert (got[1].reason, got[1].score, got[2].reason) == (8, None, 9)
    assert got[0].reason in (0, 1, 2, 3, 4) and got[0].genus in ("", "Aus") and got[0].NNtaxID == 4 and got[0].NNdistance == 0 and len(got[0].scores) == len(got[0].path)


def test_sql_functions(spark):
    from taxaspark.functions.register import register
    from taxaspark.kernels import codec, phmm

    names = register(spark)
    assert {"dna_rc", "kmers", "align_motif"} <= set(names)
    r = spark.sql("SELECT dna_rc('TATTG') a, dna_regex('GGW') b, phred_mean('!I') c, n_share('ANNA') d, kmers('ACGNT', 2) e, ambiguous('ACGN') f, last_taxon('a; b') g, align_motif('ACGT', 'TTACGTTT') h").first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("CAATA", "GG[AT]", 20.0, 0.5, ["AC", "CG"], 1, "b") and (r.h.first, r.h.last, r.h.score) == (3, 6, 20.0)
    m = phmm.derive(["ACGTAC", "ACGTAC"])
    packed = bytearray(codec.encode_phmm(m))
    got = spark.createDataFrame([(packed, "ACGTAC")], "m binary, s string").selectExpr("phmm_forward(m, s) AS x").first().x
    assert got == pytest.approx(phmm.forward(codec.decode_phmm(bytes(packed)), ["ACGTAC"])[0])


def test_mates_and_the_asv_chain(spark):
    from taxaspark.plans.pipelines import classify_samples, paired_reads_to_asvs, reference_classifier

    rng = np.random.default_rng(9)
    inner = "".join(rng.choice(list("ACGT"), 70))
    up, down = "GGAACAGGAACCTTGG", "CCTTCCTTGGAACCAA"
    whole = "CGGTTGGGGTGA" + inner + S.rc("TTGACCTTAACC")
    rows = [(i, f"m{i}/1", "ACAC" + up + whole, "I" * 114) for i in range(4)]
    mates = [(i, f"m{i}/2", "GTGT" + down + S.rc(whole), "I" * 114) for i in range(4)]
    fix = lambda rs: spark.createDataFrame([(o, n, s, q[: len(s)]) for o, n, s, q in rs], "ord bigint, name string, seq string, qual string")
    pairs = R.pair_mates(fix(rows), fix(mates))
    assert all(r.names_agree for r in pairs.collect())
    counts = paired_reads_to_asvs(pairs, {"one": "ACAC:GTGT"}, up, down, "CGGTTGGGGTGA", "TTGACCTTAACC")
    assert [(r.seq, r["sample"], r.n) for r in counts.collect()] == [(inner, "one", 4)]
    taxa = spark.createDataFrame(TAXA, "taxID int, parent_taxID int, rank string, name string")
    refs = spark.createDataFrame([(k, f"A{k}|4", "TT" + up + inner[: 60 + k] + S.rc(down) + "AA", 4, 1) for k in (9, 10)], "ord bigint, name string, seq string, tax_id int, otu bigint")
    model = reference_classifier(refs, taxa, up, down, "genus")
    got = classify_samples(counts, model).collect()
    assert [(r["sample"], r.n, r.taxon) for r in got] == [("one", 4, "Aus aus")]


def brute_clusters(rows, threshold, k=4):
    """Centre of each ord, over all pairs of distinct sequences."""
    rep = {}
    for o, s in sorted(rows):
        rep.setdefault(s, o)
    seqs = sorted(rep, key=rep.get)
    f = [K.count_matrix([s], k)[0] / max(len(s) - k + 1, 1) for s in seqs]
    near = [[j for j in range(len(seqs)) if round(float(((f[i] - f[j]) ** 2).sum()) * len(s) / (2 * k), 12) <= 1 - threshold] for i, s in enumerate(seqs)]
    up = {i: max(near[i], key=lambda j: (len(near[j]), -rep[seqs[j]])) for i in range(len(seqs))}

    def top(i):
        while up[i] != i:
            i = up[i]
        return rep[seqs[i]]

    centre = {s: top(i) for i, s in enumerate(seqs)}
    return {o: centre[s] for o, s in rows}


def test_clusters_lose_no_neighbour(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("ACGT"), 120))

    def variant(times):
        s = list(base)
        for at in rng.choice(120, times, replace=False):
            s[at] = rng.choice(list("ACGT"))
        return "".join(s)

    # Two close sequences of 60 copies each: lists of 50 would hold copies only.
    other = variant(1)
    copies = [(i, base) for i in range(60)] + [(100 + i, other) for i in range(60)]
    # More than 50 distinct neighbours, and sequences of other lengths and of one base.
    dense = [(i, variant(int(rng.integers(1, 12)))) for i in range(150)] + [(900, "A" * 120), (901, "ACG"), (902, "CCGGTTAA" * 9)]
    for rows, threshold in ((copies, 0.97), (dense, 0.96)):
        monkeypatch.setattr(K, "BLOCK_ROWS", 40, raising=False)
        got = {r.ord: r.otu for r in K.clusters(spark.createDataFrame(rows, "ord bigint, seq string"), threshold).collect()}
        want = brute_clusters(rows, threshold)
        assert got == want
    assert len({v for k, v in got.items() if k < 900}) < 150
    assert {r.otu for r in K.clusters(spark.createDataFrame(copies, "ord bigint, seq string")).collect()} == {0}


@pytest.mark.skipif(not glob.glob("/root/testdata/sf0.001"), reason="no test tables")
def test_otus_are_of_all_reference_sequences(spark):
    from taxaspark import queries as Q
    from taxaspark.plans import fixtures as X

    got = Q.q_otu(spark, "/root/testdata/sf0.001")
    assert got.select("ord").exceptAll(X.refseqs(spark, "/root/testdata/sf0.001").select("ord")).count() == 0
    assert X.refseqs(spark, "/root/testdata/sf0.001").select("ord").exceptAll(got.select("ord")).count() == 0


@pytest.mark.skipif(not glob.glob("/root/testdata/sf0.001"), reason="no test tables")
def test_searches_and_scores_cover_reads_of_every_length(spark):
    from taxaspark.kernels import codec, phmm
    from taxaspark import queries as Q
    from taxaspark.plans import fixtures as X

    sf = "/root/testdata/sf0.001"
    reads = {r.ord: r.seq for r in X.reads(spark, sf).select("ord", "seq").collect()}
    asked = {o for o in reads if o % 100 == 0}
    assert any(len(reads[o]) < X.LENGTH for o in asked)
    # Models score whole reads.
    scores = {r.ord: r.score for r in Q.q_phmm_forward(spark, sf).collect()}
    some = sorted(reads)[::97]
    model = codec.decode_phmm(codec.encode_phmm(phmm.derive([X.UP_READ, X.UP_READ[:-2] + "AA"])))
    assert scores.keys() == reads.keys() and [scores[o] for o in some] == pytest.approx(phmm.forward(model, [reads[o] for o in some]).tolist())
    # Every query has a row, and short training reads are exact hits.
    pinged = {r.uid: r for r in Q.q_ping_lca(spark, sf).collect()}
    uid = {o: hashlib.md5(reads[o].encode()).hexdigest() for o in asked}
    assert pinged.keys() == set(uid.values())
    even = {r.ord for r in X.refseqs(spark, sf).where("tax_id % 2 = 0").select("ord").collect()}
    assert all(pinged[uid[o]].exact for o in asked & even)
    # Neighbours of every query are those of brute force.
    near = {}
    for r in Q.q_knn_kmer_all(spark, sf).collect():
        near.setdefault(r.query, {})[r.place] = r.distance
    assert near.keys() == asked
    order = sorted(reads)
    t = np.minimum(K.count_matrix([reads[o] for o in order]), K.CAP) / np.array([max(len(reads[o]) - 3, 1) for o in order])[:, None]
    for o in sorted(asked)[::9] + [o for o in asked if len(reads[o]) < X.LENGTH][:10]:
        q = K.count_matrix([reads[o]])[0] / max(len(reads[o]) - 3, 1)
        best = np.sort(((q - t) ** 2).sum(axis=1) * len(reads[o]) / 8)[:10]
        assert [near[o][p] for p in range(1, 11)] == pytest.approx(best.tolist(), abs=2e-6)


def test_fastq_files_plain_or_gzipped_have_one_order(spark, tmp_path):
    import gzip

    from taxaspark.sources import fastx

    text = {k: "".join(f"@{k}{i}\nACGT\n+\n@III\n" for i in range(40)) for k in "abc"}
    (tmp_path / "a.fastq").write_text(text["a"])
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(text["b"].encode()))
    (tmp_path / "c.fastq").write_text(text["c"])
    expect = [f"{k}{i}" for k in "abc" for i in range(40)]
    whole = sorted((r.ord, r.name, r.seq, r.qual) for r in fastx.read_fastq(spark, str(tmp_path)).collect())
    assert [n for _, n, _, _ in whole] == expect and len({o for o, *_ in whole}) == 120 and {x[2:] for x in whole} == {("ACGT", "@III")}
    spark.conf.set("spark.hadoop.fs.viewfs.mounttable.fq.link./in", f"file://{tmp_path}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.fq.link./in", f"file://{tmp_path}")
    far = sorted((r.ord, r.name, r.seq, r.qual) for r in fastx.read_fastq(spark, "viewfs://fq/in").collect())
    assert far == whole


def test_ping_counts_distinct_training_sequences(spark):
    import random

    from taxaspark.operators import classify as C

    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    near = [base[:k] + ("A" if base[k] != "A" else "C") + base[k + 1 :] for k in (20, 90, 150, 210, 260)]
    tax = spark.createDataFrame([(1, 0, "no rank", "root"), (2, 1, "genus", "g"), (3, 2, "species", "s one"), (4, 2, "species", "s two")], "taxID int, parent_taxID int, rank string, name string")
    query = spark.createDataFrame([("q", base, 0)], "uid string, seq string, ord bigint")

    def found(seqs):
        train = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(seqs)], "train bigint, seq string, taxID int")
        return C.ping(query, C.Classifier(tax, C.build_key(train, tax), train), 0.9, 3).first().taxID

    assert found([(near[0], 3)] * 60) is None  # one sequence, however often it stands there
    assert found([(near[0], 3)] * 60 + [(near[1], 3), (near[2], 4)]) == 2
    assert found([(s, 3) for s in near[:3]]) == 3
    assert found([(near[0], 3), (near[0], 4), (near[1], 3), (near[2], 3)]) == 2  # its hash stands for both species


def test_lists_of_nearest_match_a_full_sort():
    import numpy as np

    from taxaspark.operators.kmers import keep_best

    rng = np.random.default_rng(3)
    d = rng.integers(0, 12, (7, 90)).astype(float)  # many ties
    ids = rng.permutation(90)
    for most in (1, 5, 50, 200):
        best = np.zeros((7, 0)), np.zeros((7, 0), np.int64)
        for a, b in ((0, 3), (3, 40), (40, 41), (41, 90)):
            best = keep_best(*best, d[:, a:b], ids[a:b], most)
        for q in range(7):
            assert list(zip(best[0][q], best[1][q])) == sorted(zip(d[q], ids))[:most]
