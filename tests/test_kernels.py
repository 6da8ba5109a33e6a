"""Kernels against brute force on tiny inputs."""

import itertools

import numpy as np
import pytest

from taxaspark.kernels import align as A
from taxaspark.kernels import codec
from taxaspark.kernels import phmm as P


def brute_semiglobal(motif, seq):
    """Best score over all alignments with free end gaps, by recursion over the moves."""
    best = 0.0

    def score(a, b):
        return A.SCORE[A._MASK[ord(a)], A._MASK[ord(b)]]

    from functools import lru_cache

    @lru_cache(None)
    def run(i, j, state):
        if i == len(motif) or j == len(seq):
            return 0.0
        out = score(motif[i], seq[j]) + run(i + 1, j + 1, "m")
        up = A.GAP_EXTEND if state == "u" else A.GAP_OPEN
        left = A.GAP_EXTEND if state == "l" else A.GAP_OPEN
        return max(out, run(i + 1, j, "u") - up, run(i, j + 1, "l") - left)

    for i in range(len(motif) + 1):
        best = max(best, run(i, 0, ""))
    for j in range(len(seq) + 1):
        best = max(best, run(0, j, ""))
    return best


def test_semiglobal_scores_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        motif = "".join(rng.choice(list("ACGTN"), rng.integers(2, 9)))
        seqs = ["".join(rng.choice(list("ACGT"), rng.integers(1, 12))) for _ in range(5)] + [motif.replace("N", "A") + "AC"]
        got = A.semiglobal(motif, seqs)
        assert got["score"] == pytest.approx([brute_semiglobal(motif, s) for s in seqs])


def test_semiglobal_spans():
    hit = A.semiglobal("ACGTACGT", ["TTTACGTACGTGG", "GTACGTAA", "ACGTAC"])
    assert hit["first"].tolist()[0] == 4 and hit["last"].tolist()[0] == 11
    assert hit["head"].tolist()[1] == 2 and hit["tail"].tolist()[2] == 2


def brute_forward(m, seq):
    codes = [P.DNA.index(c) for c in seq]
    total = -np.inf

    def go(state, k, j, score):
        nonlocal total
        a = m.a
        into = {"M": (P.MM, P.MI, P.MD), "I": (P.IM, P.II, P.ID), "D": (P.DM, P.DI, P.DD)}[state]
        if k == m.size:
            if j == len(codes):
                total = np.logaddexp(total, score + a[into[0], k])
        else:
            if j < len(codes):
                go("M", k + 1, j + 1, score + a[into[0], k] + m.e[codes[j], k])
            go("D", k + 1, j, score + a[into[2], k])
        if j < len(codes):
            go("I", k, j + 1, score + a[into[1], k] + m.qe[codes[j]])

    go("M", 0, 0, 0.0)
    return total


def test_forward_sums_all_paths_and_viterbi_takes_the_best():
    rng = np.random.default_rng(2)
    m = P.from_counts(rng.random((4, 3)) * 5, rng.random((9, 4)) * 5, np.full(4, 0.25))
    for n in range(5):
        for seq in list(itertools.product("ACGT", repeat=n))[:: max(1, 4**n // 8)]:
            seq = "".join(seq)
            f = P.forward(m, [seq])[0]
            assert f == pytest.approx(brute_forward(m, seq), abs=1e-6)
            assert P.viterbi(m, [seq])[0][0] <= f + 1e-9


def test_probabilities_sum_to_one_over_sequences():
    m = P.from_counts(np.ones((4, 1)), np.zeros((9, 2)), np.full(4, 0.25))
    total = sum(np.exp(P.forward(m, ["".join(s)])[0]) for n in range(6) for s in itertools.product("ACGT", repeat=n))
    assert 0.9 < total <= 1 + 1e-9


def test_training_raises_the_score_and_weights_average_one():
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("ACGT"), 40))
    seqs = [base[:k] + "ACGT"[k % 4] + base[k + 1 :] for k in range(10)]
    m = P.derive(seqs)
    other = "".join(rng.choice(list("ACGT"), 40))
    assert P.forward(m, [seqs[0]])[0] > P.forward(m, [other])[0] + 10
    w = P.henikoff([*seqs, other])
    assert w.mean() == pytest.approx(1) and w[-1] == w.max()


def test_codec_keeps_values_to_three_digits():
    x = np.geomspace(1e-6, 99, 500)
    assert codec.unpack_values(codec.pack_values(x)) == pytest.approx(x, rel=1.2e-3)
    for bad in (np.inf, 1e-7, 100.0):
        with pytest.raises(ValueError):
            codec.pack_values(np.array([bad]))
    m = P.derive(["ACGTACGTAC", "ACGTACGAAC"])
    back = codec.decode_phmm(codec.encode_phmm(m))
    assert back.size == m.size and np.exp(back.e) == pytest.approx(np.exp(m.e), abs=5e-3)
    assert P.forward(back, ["ACGTACGTAC"])[0] == pytest.approx(P.forward(m, ["ACGTACGTAC"])[0], abs=0.5)


def test_akaike_weights_sum_to_one():
    w = P.akaike(np.array([[-1000.0, -1001.0, -1e6]]))
    assert w.sum() == pytest.approx(1) and w[0, 0] > w[0, 1] > w[0, 2]


def test_expected_counts_are_averages_over_all_paths():
    rng = np.random.default_rng(4)
    m = P.from_counts(rng.random((4, 2)) * 5, rng.random((9, 3)) * 5, np.full(4, 0.25))
    seq = "ACG"
    codes = [P.DNA.index(c) for c in seq]
    emit, moves, total = np.zeros_like(m.e), np.zeros_like(m.a), 0.0

    def go(state, k, j, score, used, said):
        nonlocal total
        into = {"M": (P.MM, P.MI, P.MD), "I": (P.IM, P.II, P.ID), "D": (P.DM, P.DI, P.DD)}[state]
        if k == m.size and j == len(codes):
            p = np.exp(score + m.a[into[0], k])
            total += p
            for move, at in [*used, (into[0], k)]:
                moves[move, at] += p
            for c, at in said:
                emit[c, at] += p
        if k < m.size:
            if j < len(codes):
                go("M", k + 1, j + 1, score + m.a[into[0], k] + m.e[codes[j], k], [*used, (into[0], k)], [*said, (codes[j], k)])
            go("D", k + 1, j, score + m.a[into[2], k], [*used, (into[2], k)], said)
        if j < len(codes):
            go("I", k, j + 1, score + m.a[into[1], k] + m.qe[codes[j]], [*used, (into[1], k)], said)

    go("M", 0, 0, 0.0, [], [])
    got_emit, got_moves = P.expected_counts(m, [seq], np.ones(1))
    assert got_emit == pytest.approx(emit / total, abs=1e-6) and got_moves == pytest.approx(moves / total, abs=1e-6)
    seqs = ["ACGTAC", "ACGTTC", "ACTTAC"]
    before = P.derive(seqs, rounds=1)
    # Pseudo-counts pull the maximum away a little.
    assert P.forward(P.train(before, seqs, method="BaumWelch", rounds=5), seqs).sum() >= P.forward(before, seqs).sum() - 0.1
