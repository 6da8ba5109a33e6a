"""Steps that must not measure every pair, nor meet the limits of a recursive query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaspark.operators import kmers as K
from taxaspark.operators import taxonomy as T


def made(seed, n, lengths=(1, 140)):
    rng = np.random.default_rng(seed)
    seqs = ["".join(rng.choice(list("ACGT"), int(m))) for m in rng.integers(*lengths, n)]
    near = [s[:k] + "A" + s[k + 1 :] for s, k in zip(seqs, rng.integers(0, 140, n))]
    return sorted(set(seqs + [s for s in near if s]) | {"A" * 90, "ACG", "ACGN" * 20})


def brute(query, train):
    size = lambda x: np.maximum(np.array([len(s) for s in x]) - 3, 1)[:, None]
    q, t = K.count_matrix(query) / size(query), np.minimum(K.count_matrix(train), K.CAP) / size(train)
    square = ((q[:, None] - t[None]) ** 2).sum(axis=2)
    return square, np.round(square * np.array([len(s) for s in query])[:, None] / 8, 12)


@pytest.mark.parametrize("within", [None, 0.02, 0.3])
def test_nearest_lists_are_whole_in_parts_and_blocks(spark, monkeypatch, within):
    seqs = made(2, 300)
    query = seqs[::3]
    monkeypatch.setattr(K, "BLOCK_BYTES", 40 * 2048)  # several blocks of queries
    frame = lambda x, name: spark.createDataFrame(list(enumerate(x)), f"{name} bigint, seq string")
    got = {}
    for r in K.nearest(frame(query, "query"), frame(seqs, "train").repartition(3), 7, within=within).collect():
        got.setdefault(r["query"], []).append((r.place, r.distance))
    _, d = brute(query, seqs)
    for q in range(len(query)):
        want = [x for x in np.sort(d[q])[:7] if within is None or x <= within]
        assert [x for _, x in sorted(got.get(q, []))] == pytest.approx(want, abs=1e-9)


def test_bounds_lose_no_pair_and_leave_few():
    seqs = made(5, 400, (110, 140))
    square, _ = brute(seqs, seqs)
    for basis in (None, K.basis_of(seqs[:200], 4)):
        x, y = K.Profiles(seqs, 4, basis), K.Profiles(seqs, 4, basis, K.CAP)
        for limit in (0.0, 0.01, 0.001):
            found = {(a, b) for i, j in x.candidates(y, np.full(len(seqs), limit)) for a, b in zip(i.tolist(), j.tolist())}
            assert set(zip(*(c.tolist() for c in np.nonzero(square <= limit)))) <= found
        assert len(found) < 0.05 * len(seqs) ** 2


def test_packed_blocks_find_both_ways():
    seqs = made(7, 200)
    basis = K.basis_of(seqs[:100], 4)
    a, b = seqs[::2], seqs[1::2]
    packed = [K._bands(K.Profiles.unpack(x, K.Profiles(x, 4, basis).pack(), 4)) for x in (a, b)]
    there, back = set(), set()
    for i, j, t, u in K._close(*packed, 0.9):
        there |= set(zip(i[t].tolist(), j[t].tolist()))
        back |= set(zip(j[u].tolist(), i[u].tolist()))
    f = [K.count_matrix(x) / np.maximum(np.array([len(s) for s in x]) - 3, 1)[:, None] for x in (a, b)]
    square = ((f[0][:, None] - f[1][None]) ** 2).sum(axis=2)
    near = lambda s, x: set(zip(*(c.tolist() for c in np.nonzero(np.round(s * np.array([len(v) for v in x])[:, None] / 8, 12) <= 1 - 0.9))))
    assert there == near(square, a) and back == near(square.T, b) and there


def test_closure_has_no_row_limit(spark):
    rows = [(1, 0, "no rank", "root")] + [(i, i // 3 + (i < 3), "species", f"t{i}") for i in range(2, 120)]
    tax = spark.createDataFrame(rows, "taxID int, parent_taxID int, rank string, name string")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 20)
    try:
        got = {(r.taxID, r.distance, r.anc_taxID) for r in T.closure(tax).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    up, want = {t: p for t, p, _, _ in rows}, set()
    for t in up:
        d, node = 0, t
        while node:
            want.add((t, d, node))
            d, node = d + 1, up[node]
    assert got == want
    loop = spark.createDataFrame([(1, 2, "a", "a"), (2, 1, "a", "b")], "taxID int, parent_taxID int, rank string, name string")
    with pytest.raises(ValueError):
        T.closure(loop).collect()


def test_each_document_is_parsed_once(spark):
    from taxaspark.sources import ncbi

    one = "<GBSeq><GBSeq_locus>{0}</GBSeq_locus><GBSeq_organism>o &amp; {0}</GBSeq_organism><GBSeq_taxonomy>r; x</GBSeq_taxonomy>{1}<GBSeq_sequence>acgt</GBSeq_sequence></GBSeq>"
    taxon = "<GBQualifier><GBQualifier_value>note</GBQualifier_value></GBQualifier><GBQualifier><GBQualifier_value>taxon:{}</GBQualifier_value></GBQualifier>"
    docs = ["<GBSet>" + one.format("A", taxon.format(1)) + one.format("B", "") + one.format("C", taxon.format(3)) + "</GBSet>", None, "<GBSet/>", "<GBSet>" + one.format("D", taxon.format("x")) + "</GBSet>"]
    out = ncbi.xml_records(spark.createDataFrame([(d,) for d in docs], "doc string"))
    assert sorted(map(tuple, out.collect())) == [("A", 1, "o & A", "r; x", "ACGT"), ("C", 3, "o & C", "r; x", "ACGT")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "xpath" not in plan and plan.count("LogicalRDD") <= 1
