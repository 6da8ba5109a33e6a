"""Steps whose work may not grow faster than the input: each against the plain way."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from taxaspark.kernels import align, phmm
from taxaspark.operators import curate as U


def made(seed, n, letters="ACGT", lengths=(0, 140)):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), int(m))) for m in rng.integers(*lengths, n)]


def test_members_find_the_nearer_centre_without_their_profiles():
    seqs = ["", "A", "ACG", "NNNN", ""] + made(1, 200) + made(2, 50, "ACGTN") + ["ACGT", ""]
    freq = U.profiles(seqs)
    c = freq[[40, 90]]
    assert np.allclose(U._means_along(pa.array(seqs), c[1]), freq @ c[1], atol=1e-15)
    want = np.column_stack([((freq - x) ** 2).sum(axis=1) for x in c]).argmin(axis=1)
    assert (U._nearer(pa.array(seqs), c) == want).all()
    assert (U._nearer(pa.array(seqs).slice(7, 90), c) == want[7:97]).all()
    assert not U._nearer(pa.array(seqs), c[[0, 0]]).any()


def test_forward_sums_equal_those_of_logs():
    seqs = ["", "A", "N" * 9] + made(3, 300, "ACGTN", (0, 300)) + ["GGAACAGG" * 40]
    model = phmm.derive(["GGAACAGGATGAACAGTATACCCCCC", "GGAACAGGATGAACAGTATACCCCAA"])
    logs = np.concatenate([phmm._run(model, [s], np.logaddexp)[0] for s in seqs])
    assert phmm.scaled(model, 320) and np.abs(phmm._sums(model, seqs) - logs).max() < 1e-8
    assert np.abs(phmm.forward(model, seqs) - logs).max() < 1e-8 and len(phmm.forward(model, [])) == 0
    long = phmm.derive(["ACGT" * 100])
    assert not phmm.scaled(long, 120)
    assert np.allclose(phmm.forward(long, seqs[:9]), phmm._run(long, seqs[:9], np.logaddexp)[0])


def test_motifs_that_stand_in_full_are_not_aligned(monkeypatch):
    rng = np.random.default_rng(4)
    for motif in ("GGWACWGG", "GGAACAGG", "ACGGIGICC", "TGRTTYTTYGGICAYCC", "NACG", "ACGI", "ACIIIACG"):
        one = lambda: "".join(rng.choice(list({"W": "AT", "R": "AG", "Y": "CT", "I": "ACGT", "N": "ACGT"}.get(c, c))) for c in motif)
        seqs = made(5, 60) + [a + one() + b + one() + c for a, b, c in zip(made(6, 60, "ACGTNW", (0, 9)), made(7, 60), made(8, 60, lengths=(0, 4)))]
        seqs += ["", motif, one()[1:], one()[:-1], one() * 2, "é" + one(), one().lower()]
        got, want = align.semiglobal(motif, seqs), align._aligned(motif, seqs)
        assert all((got[c] == want[c]).all() for c in want)
    monkeypatch.setattr(align, "_aligned", None)
    assert align.semiglobal("GGWACWGG", ["TTGGAACTGGT"])["first"].tolist() == [3]


def work(df):
    """How often the whole plan searches a pattern or maps letters."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(plan.count(x) for x in ("RLIKE", "regexp_", "translate("))


def test_reads_are_searched_once_each(spark):
    from taxaspark import queries as Q

    most = {"q_trim_both_orient": 12, "q_trim_fwd": 12, "q_demux_single": 16, "q_demux_paired": 16, "q_stitch_offset": 18, "q_stitch_consensus": 14, "q_qfilter_strict": 12}
    got = {name: work(Q.QUERIES[name](spark, "/root/testdata/sf0.001")) for name in most}
    assert all(got[name] <= most[name] for name in most), got


def test_kmers_are_counted_without_shuffling_them(spark):
    from pyspark.sql import functions as F

    from taxaspark.functions.sequences import kmers
    from taxaspark.operators import kmers as K

    seqs = made(9, 400, "ACGTN") + [None, "", "ACG", "acgtACGTT"]
    rows = spark.createDataFrame([(i % 37 if i % 50 else None, s) for i, s in enumerate(seqs)], "ord bigint, seq string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # keys go on over batches
    try:
        for k in (1, 4, 6):
            want = rows.select("ord", F.explode(kmers(F.col("seq"), k)).alias("kmer")).groupBy("ord", "kmer").count()
            got = K.counts(rows, k)
            assert sorted(map(str, got.collect())) == sorted(str(r).replace("count=", "n=") for r in want.collect())
            assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_codons_are_looked_up(spark):
    from taxaspark.functions import sequences as S

    rows = spark.createDataFrame([("ATAACGNNNTGAAGG",), ("",), ("AC",), ("acgA-GTTT",)], "seq string")
    out = rows.select(S.translate_codons(rows["seq"], 5).alias("a"))
    assert [r.a for r in out.collect()] == ["MTXWS", "", "", "XXF"]
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_groups_are_told_by_hashes(spark):
    from taxaspark.operators import reads as R

    rows = spark.createDataFrame([(i, f"r{i}", "ACGT" * (i % 3 + 1)) for i in range(30)], "ord bigint, name string, seq string")
    out = R.pointers(rows).select("ord", "pointer", "duplicated")
    assert sorted(map(tuple, out.collect())) == [(i, i % 3 + 1, i >= 3) for i in range(30)]
    R.by_group(rows, lambda groups: groups.select("__key", "__n", "__first", "__salts"))  # groups do not carry the sequence


def test_quantiles_never_collect_a_group(spark, monkeypatch):
    from taxaspark import queries as Q
    from taxaspark.operators import learn as L

    monkeypatch.setattr(L, "BINS", 8)
    rng = np.random.default_rng(10)
    values = {"a": [*rng.normal(0, 1e4, 400), *[5.0] * 50], "b": [3.0], None: [*(10.0 ** rng.integers(-9, 9, 90)), 0.0, -0.0], "c": [None], "d": [1.0, 2.0, None], "e": [float("-inf"), 1.0, 2.0, 2.0, float("nan")]}
    rows = spark.createDataFrame([(g, None if v is None else float(v)) for g, some in values.items() for v in some], "g string, v double")
    want = {r.g: (r.q0, r.q1, r.q2) for r in rows.groupBy("g").agg(*[F.expr(f"percentile(v, {p})").alias(f"q{i}") for i, p in enumerate((0.05, 0.5, 1.0))]).collect()}
    got = {r.g: (r.q0, r.q1, r.q2) for r in L.quantiles(rows, "g", "v", [0.05, 0.5, 1.0]).collect()}
    assert str(sorted(got.items(), key=str)) == str(sorted(want.items(), key=str))
    assert "percentile" not in Q.QUERIES["q_quantile7"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_reads_are_made_few_times_for_a_classification_by_hash(spark):
    from taxaspark import queries as Q

    df = Q.QUERIES["q_classify_ping_only"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4, plan.count("regexp_extract_all")


def test_hashes_of_one_taxon_need_no_lineage(spark):
    from taxaspark.operators import classify as C

    tax = spark.createDataFrame([(1, 0, "no rank", "root"), (2, 1, "genus", "g"), (3, 2, "species", "a"), (4, 2, "species", "b")], "taxID int, parent_taxID int, rank string, name string")
    train = [(0, "A", 3), (1, "A", 3), (2, "C", 3), (3, "C", 4), (4, "G", 9), (5, "T", 9), (6, "T", 4), (7, None, 3), (8, "AC", None)]
    key = C.build_key(spark.createDataFrame(train, "train int, seq string, taxID int"), tax)
    names = {r.md5: r.seq for r in spark.createDataFrame([(s,) for s in "ACGT"], "seq string").select("seq", C.seq_hash(F.col("seq")).alias("md5")).collect()}
    assert sorted((names[r.md5], r.taxID) for r in key.where("md5 IS NOT NULL").collect()) == [("A", 3), ("C", 2), ("T", 4)]


def test_forward_of_long_models_adds_probabilities_where_none_counts_that_vanishes(monkeypatch):
    rng = np.random.default_rng(11)
    base = "".join(rng.choice(list("ACGT"), 250))
    seqs = [base[a:b] for a, b in ((0, 250), (3, 240), (10, 120), (100, 250))] + made(12, 20, lengths=(0, 300)) + made(13, 3, "ACGTN", (600, 700)) + [""]
    model = phmm.derive([base, base[2:]])
    assert not phmm.scaled(model, 300)
    run, logs = phmm._run, []
    monkeypatch.setattr(phmm, "_run", lambda m, s, *more, **k: logs.extend(s) or run(m, s, *more, **k))
    got = phmm.forward(model, seqs)
    want = np.concatenate([run(model, [s], np.logaddexp)[0] for s in seqs])
    assert np.abs(got - want).max() < 1e-8
    assert logs == [s for s, w in zip(seqs, want) if w <= phmm.FLOOR] and 0 < len(logs) < len(seqs) / 2
