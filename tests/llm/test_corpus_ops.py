"""Near dedup, Katz scores and substring dedup against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from taxaspark.llm import chunks as C
from taxaspark.llm import katz as K
from taxaspark.llm import near_dedup as N
from taxaspark.llm import substring_dedup as S
from taxaspark.llm.components import components
from taxaspark.llm.scratch import Scratch

VOCABULARY = [f"word{k}" for k in range(3000)]


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY, n))


def edited(rng, t, n):
    w = t.split()
    for k in rng.choice(len(w), n, replace=False):
        w[k] = f"new{rng.integers(10**9)}"
    return " ".join(w)


def weighted(texts, n):
    sets = []
    for t in texts:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        sets.append(collections.Counter(runs))
    df = collections.Counter(k for s in sets for k in s)
    return [{k: v * (1 + math.log((1 + n) / (1 + df[k]))) for k, v in s.items()} for s in sets]


def jaccard(a, b):
    least = sum(min(v, b[k]) for k, v in a.items() if k in b)
    return least / (sum(a.values()) + sum(b.values()) - least) if a and b else 0.0


def corpus():
    rng = np.random.default_rng(1)
    texts = [text(rng, int(n)) for n in rng.integers(5, 200, 60)]
    base = text(rng, 150)
    texts += [edited(rng, base, int(k)) for k in rng.integers(0, 5, 40)]  # one large group
    for t in texts[:10]:
        texts += [t, edited(rng, t, max(1, len(t.split()) // 60)), t + " tail"]
    return texts + [None, "", "one two", "One, two!", "one two three four", text(rng, 4000)]


def test_near_duplicates_match_brute_force(spark, docs):
    texts = corpus()
    got = {r.doc_id: r for r in N.near_duplicates(docs([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    sets = weighted(texts, len(texts))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= N.SIMILARITY:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i in range(len(texts))}
    size = collections.Counter(root(i) for i in range(len(texts)))
    assert all(r.group_size == size[root(i)] and r.kept == (root(i) == i) for i, r in got.items())


def test_copies_with_changed_words_stay_in_their_large_group(spark, docs):
    rng = np.random.default_rng(21)
    base = text(rng, 150)
    copies = [base] * 20 + [edited(rng, base, int(k)) for k in rng.integers(3, 6, 60)]
    others = [text(rng, 12) for _ in range(4000)]
    got = {r.doc_id: r for r in N.near_duplicates(docs([(i, t, "s") for i, t in enumerate(copies + others)])).collect()}
    assert [r.class_id for i, r in sorted(got.items())] == [0] * len(copies) + list(range(len(copies), len(got)))
    assert all(got[i].group_size == len(copies) and got[i].kept == (i == 0) for i in range(len(copies)))


def test_near_duplicates_of_odd_tables(spark, docs):
    t = text(np.random.default_rng(2), 60)
    rows = [(None, t, "s"), (4, t, "s"), (4, t, "s"), (2, t, "s"), (7, None, "s"), (8, None, "s")]
    got = sorted(((r.doc_id, r.class_id) for r in N.near_duplicates(docs(rows)).collect()), key=str)
    assert got == sorted([(None, None), (4, 2), (4, 2), (2, 2), (7, 7), (8, 8)], key=str)
    assert N.near_duplicates(docs([])).count() == 0
    kept = N.keep_one_per_class(docs(rows))
    assert kept.columns == docs(rows).columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [2, 7, 8]


def test_stragglers_meet_every_block_of_their_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = np.random.default_rng(13)
    keys = rng.integers(0, 2**63, 40).astype(np.uint64)
    reps, rest = [], []
    for i in range(60):
        w = np.ones(40)
        w[rng.choice(40, int(rng.integers(0, 5)), replace=False)] = 0.5
        reps.append((i, float(w.sum()), bytearray(N.partial_weights(keys, w).tobytes())))
        rest.append((i % 2, i, 0 if i % 5 else i))
    size = collections.Counter(b for b, _, _ in rest)
    out = collections.Counter(b for b, _, label in rest if label)
    df = spark.createDataFrame([(b, i, label, 0, size[b], out[b]) for b, i, label in rest], "bucket bigint, rep bigint, label bigint, main bigint, n bigint, out bigint")
    got = sorted(map(tuple, N.bounded_pairs(df, spark.createDataFrame(reps, "rep bigint, total double, bins binary")).collect()))
    bins = {i: np.frombuffer(b, np.float32) for i, _, b in reps}
    total = {i: t for i, t, _ in reps}
    expect = [(i, j) for b, i, x in rest for c, j, y in rest if i < j and b == c and x != y and N.reaches(np.minimum(bins[i], bins[j]).sum(), total[i], total[j])]
    assert got == sorted(expect) and 0 < len(got)


def spread_group(rng, n):
    """Copies of one text, from nearly equal ones to such as resemble only some of the others, among other texts."""
    base = text(rng, 100)
    return [edited(rng, base, int(k)) for k in rng.integers(2, 14, n)] + [text(rng, 10) for _ in range(300)]


def test_classes_are_the_same_however_few_pairs_of_stragglers_become_rows(spark, docs, monkeypatch):
    df = docs([(i, t, "s") for i, t in enumerate(spread_group(np.random.default_rng(32), 200))]).cache()
    classes = []
    for most, block, inner in ((1 << 30, 512, 128), (1, 64, 16)):
        for k, v in (("MOST", most), ("BLOCK", block), ("INNER", inner)):
            monkeypatch.setattr(N, k, v)
        classes.append({r.doc_id: r.class_id for r in N.near_duplicates(df).collect()})
    assert classes[0] == classes[1] and 1 < len({classes[0][i] for i in range(200)}) < 200


def test_pairs_of_stragglers_grow_with_their_number_not_with_the_bucket(spark):
    rng = np.random.default_rng(31)
    keys = rng.integers(0, 2**63, 40).astype(np.uint64)
    bins = bytearray(N.partial_weights(keys, np.ones(40)).tobytes())  # all bounds are 1
    for n in (100, 400):
        rest = [(1, i, i if i < n // 4 else n, n, n, n // 4) for i in range(n)]
        df = spark.createDataFrame(rest, "bucket bigint, rep bigint, label bigint, main bigint, n bigint, out bigint")
        got = N.best_pairs(df, spark.createDataFrame([(i, 40.0, bins) for i in range(n)], "rep bigint, total double, bins binary"), N.MOST).collect()
        assert len(got) == N.MOST * (n // 4) and all(r.more and r.rep in (r.a, r.b) and r.a < r.b for r in got)


def test_joining_links_are_enough_and_right(spark, monkeypatch):
    monkeypatch.setattr(N, "INNER", 8)
    rng = np.random.default_rng(33)
    keys = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = {}
    for i in range(50):
        mine = np.sort(rng.choice(60, int(rng.integers(20, 45)), replace=False))
        sets[i] = (keys[mine], np.ones(len(mine)))
    reps = [(i, float(w.sum()), bytearray(N.partial_weights(k, w).tobytes()), bytearray(N.pack_set(k, w))) for i, (k, w) in sets.items()]
    label = {i: 0 if i < 20 else i for i in sets}
    open_ = {i for i in sets if i >= 20 and i % 3}
    rest = [(7, i, label[i], 0, len(sets), len(open_), i in open_) for i in sets]
    df = spark.createDataFrame(rest, "bucket bigint, rep bigint, label bigint, main bigint, n bigint, out bigint, open boolean")
    got = N.joining_links(df, spark.createDataFrame(reps, "rep bigint, total double, bins binary, shared binary")).collect()

    def alike(i, j):
        return len(np.intersect1d(sets[i][0], sets[j][0])) / len(np.union1d(sets[i][0], sets[j][0]))

    def joined(pairs):
        names = dict(label)
        for a, b in pairs:
            names = {k: min(names[a], names[b]) if v in (names[a], names[b]) else v for k, v in names.items()}
        return names

    expect = [(i, j) for i in sets for j in sets if i != j and i in open_ and label[i] != label[j] and alike(i, j) >= N.SIMILARITY]
    assert all(r.a < r.b and abs(r.similarity - alike(r.a, r.b)) < 1e-9 and r.similarity >= N.SIMILARITY for r in got)
    assert joined([(r.a, r.b) for r in got]) == joined(expect) and 0 < len(got) < len(expect)


def test_one_row_of_a_class_stays_although_ids_repeat(spark, docs):
    rng = np.random.default_rng(14)
    base, other = text(rng, 90), text(rng, 90)
    rows = [(5, base, "s"), (5, other, "s"), (3, base + " tail", "s"), (9, other + " tail", "s"), (5, base, "s"), (None, base, "s")]
    kept = N.keep_one_per_class(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("3", base + " tail"), ("5", other), ("None", base)])


def test_bounds_hold_for_all_pairs():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, (20, 80)).astype(np.uint64)
    keys[1:, :60] = keys[0, :60]
    w = rng.gamma(2, 1, (20, 80))
    w[:, :60] = w[0, :60]
    bins = np.array([N.partial_weights(k, x) for k, x in zip(keys, w)])
    total = w.sum(axis=1)
    may = N.reaches(np.minimum(bins[:, None, :], bins[None]).sum(axis=2), total[:, None], total[None])
    for i in range(20):
        for j in range(20):
            s = N.similarity(N.pack_set(keys[i], w[i]), N.pack_set(keys[j], w[j]), total[i], total[j])
            assert may[i, j] or s < N.SIMILARITY


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 30)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "t"), "c").collect()}
    assert got == {**{k: 1 for k in range(1, 31)}, **{k: 100 for k in range(100, 140)}, 200: 200}


def test_components_grow_by_further_links(spark):
    scratch = Scratch(spark, "t")
    make = lambda links: spark.createDataFrame(links, "a bigint, b bigint")
    first = components(make([(2, 3), (5, 4), (8, 9)]), scratch, "c", None)
    got = {r.node: r.label for r in components(make([(3, 9), (1, 4), (30, 20), (9, 8), (7, 7)]), scratch, "d", first).collect()}
    assert got == {2: 2, 3: 2, 8: 2, 9: 2, 1: 1, 4: 1, 5: 1, 20: 20, 30: 20, 7: 7}
    same = components(make([]), scratch, "e", first)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, first.collect()))


def test_links_are_joined_to_labels_few_times(spark, monkeypatch):
    write, rows = Scratch.write, collections.Counter()

    def counted(self, df, name, **more):
        out = write(self, df, name, **more)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    links = [(hub, k) for k in range(100, 300) for hub in range(5) if (hub + k) % 3]  # members with several hubs
    components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "t"), "c")
    assert len(links) <= sum(v for k, v in rows.items() if "links" in k) <= 1.2 * len(links)


def test_components_of_random_links(spark):
    rng = np.random.default_rng(34)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000, k) for k in range(900, 960)]
    names = {x: x for pair in links for x in pair}
    for a, b in links:
        low, high = sorted((names[a], names[b]))
        names = {k: low if v == high else v for k, v in names.items()}
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "t"), "c")
    assert {r.node: r.label for r in got.collect()} == names


def test_keys_pack_exactly():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        for top in (2**20, 2**63):
            keys = np.sort(rng.integers(0, top, n).astype(np.uint64))
            assert (C.unpack_keys(C.pack_keys(keys)) == keys).all()


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [1]


def slow_katz(rows, order):
    """P(w | history) by the definition, over dictionaries of word tuples; and the word counts."""
    grams, texts = [collections.Counter() for _ in range(order)], 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            w = [0, *tokens(t)]
            texts += 1
            for n in range(1, order + 1):
                grams[n - 1].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n > 1 or k)
    totals = sum(grams[0].values())
    fit = [K.discounts([sum(v == r for v in c.values()) for r in range(1, K.FITTED + 1)]) for c in grams]

    def kept(c, n):
        d, slope = fit[n - 1]
        return c * (d[c] if c <= K.K else (1 + 1 / c) ** (slope + 1))

    unseen = (1 - sum(kept(c, 1) for c in grams[0].values()) / totals) / K.UNSEEN
    followers = collections.defaultdict(list)
    for c in grams[1:]:
        for g in c:
            followers[g[:-1]].append(g[-1])
    size = lambda h: texts if h == (0,) else grams[len(h) - 1][h]

    def p(h, w):
        if not h:
            return kept(grams[0][w,], 1) / totals if grams[0][w,] else unseen
        if grams[len(h)][(*h, w)]:
            return kept(grams[len(h)][(*h, w)], len(h) + 1) / size(h)
        return alpha(h) * p(h[1:], w)

    known = {}

    def alpha(h):
        if h not in known:
            known[h] = (1 - sum(p(h, x) for x in followers[h])) / (1 - sum(p(h[1:], x) for x in followers[h])) if h in followers else 1.0
        return known[h]

    return p, grams


@pytest.mark.parametrize("order", [2, 3])
def test_katz_scores_match_brute_force(spark, docs, order, monkeypatch):
    monkeypatch.setattr(K, "CHUNK_BYTES", 20_000)
    rng = np.random.default_rng(5)
    small = [f"t{k}" for k in range(60)]
    rows = [(i, " ".join(small[int(k)] for k in np.minimum(rng.geometric(0.08, int(n)), 59))) for i, n in enumerate(rng.integers(0, 60, 400))]
    rows += [(1000, None), (1001, "Unseen WORDS only"), (1002, "t1 " * 5000), (1003, "always the same " * 40), (1004, "always the other"), (1018, "always the other"), (1009, "x"), (None, "t1 t2 t3")]
    rows += [rows[7], rows[7]]  # repeated rows count again
    table = docs([(i, t, "s") for i, t in rows]).repartition(5)
    got = collections.defaultdict(list)
    for r in K.score_texts(table, order).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[7]) == 3
    p, grams = slow_katz(rows, order)
    words = grams[0]
    for i, t in rows:
        w = tokens(t)
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(words[x,] > 0 for x in w), sum(words.values()))
            assert r.base_score == pytest.approx(sum(math.log10((words[x,] + 0.1) / (r.train_tokens + 0.1 * (len(words) + 1))) for x in w))
            said = [0, *w]
            assert r.score == pytest.approx(sum(math.log10(p(tuple(said[max(0, k - order + 1) : k]), said[k])) for k in range(1, len(said))), abs=1e-6)
    histories = [(0,), ("t1",), ("never",), ("always",)] + [("t1", "t5"), (0, "t1"), ("always", "the"), ("t1", "never")] * (order > 2)
    for h in histories:  # exactly normalised
        assert sum(p(h, w) for (w,) in words) + p(h, "no such word") * K.UNSEEN == pytest.approx(1, abs=1e-9)
    assert K.score_texts(docs([]), order).count() == 0


def test_larger_counts_lose_less_and_every_history_leaves_something():
    d, slope = K.discounts([1000, 300, 150, 90, 60, 45, 30, 25, 20])
    model = K.Model(np.array([[1000, 300, 150, 90, 60, 45, 30, 25, 20]] * 2), 1, 1, 1)
    kept = model.kept(np.arange(1, 2000), 2) / np.arange(1, 2000)
    assert (kept < 1).all() and (np.diff(kept[K.K :]) > 0).all() and kept[-1] > 0.999 and slope < -1
    assert K.discounts(np.zeros(9))[1] == -2.0


def test_groups_of_keys_pack_exactly():
    rng = np.random.default_rng(15)
    for n, top in ((1, 2**44), (500, 2**20), (500, 2**44)):
        number = np.sort(rng.integers(0, top, n).astype(np.uint64))
        length, own = rng.integers(0, 5, n), rng.integers(0, 3, n)
        tail, counts = rng.integers(0, 2**32, length.sum()).astype(np.uint32), rng.integers(0, 9, length.sum())
        got = K.unpack_groups(K.pack_groups(number, length, own, tail, counts))
        assert all((x == y).all() for x, y in zip(got, (number, length, own, tail, counts)))


def test_chains_are_collinear_and_best():
    assert S.chain([(0, 100, 8), (9, 109, 8), (20, 120, 8)]) == [[0, 1, 2]]
    found = S.chain([(0, 0, 8), (9, 9, 8), (20, 20, 8), (10, 500, 8)])
    assert found[0] == [0, 1, 2] and [3] in found
    rng = np.random.default_rng(6)
    for _ in range(200):
        some = sorted({(int(x), int(y), int(n)) for x, y, n in zip(rng.integers(0, 120, 10), rng.integers(0, 120, 10), rng.integers(S.SEED, 20, 10))})
        best = [float(n) for *_, n in some]
        for i, (x, y, n) in enumerate(some):
            for j, (a, b, m) in enumerate(some[:i]):
                if a + m <= x and b + m <= y:
                    best[i] = max(best[i], best[j] + n - S.GAP * (x - a - m + y - b - m))
        got = S.chain(some)
        assert sorted(k for path in got for k in path) == list(range(len(some)))
        for path in got:
            for j, i in zip(path, path[1:]):
                assert some[j][0] < some[i][0] and some[j][1] < some[i][1] and some[j][0] + some[j][2] <= some[i][0] + S.SEED - 1

        def worth(path):
            total = some[path[0]][2]
            for j, i in zip(path, path[1:]):
                (a, b, m), (x, y, n) = some[j], some[i]
                total += n - S.GAP * (x - a - m + y - b - m) - max(0, a + m - x, b + m - y)
            return total

        assert worth(got[0]) >= max(best) - S.SEED


def test_blocks_are_runs_on_a_diagonal():
    x = np.array([0, 3, 9, 60, 9, 61])
    y = np.array([5, 8, 14, 65, 90, 66])
    assert S.blocks(x, y).tolist() == [[0, 5, 9 + S.SEED], [9, 90, S.SEED], [60, 65, 1 + S.SEED]]


def test_extension_passes_changed_words_and_ends_in_noise():
    a, b = np.arange(30), np.arange(30)
    b[[3, 4, 9, 15]] = -1
    b[20:] = -2
    assert S.extend(a, b) == 20 and S.extend(a[20:], b[20:]) == 0 and S.extend(a[:0], b) == 0


def test_good_runs_cover_what_is_worth_it():
    assert S.good_runs([3, -1, 2]) == [(0, 3)] and S.good_runs([]) == [] and S.good_runs([-1, -2]) == []
    assert sorted(S.good_runs([5, 5, -50, 4, -1, 4, -30])) == [(0, 2), (3, 6)]


def test_equal_words_is_the_longest_common_subsequence():
    assert S.equal_words([1, 2, 3, 4], [1, 9, 3, 4]) == 3 and S.equal_words([1, 2, 3, 4, 5], [2, 3, 9, 5]) == 3 and S.equal_words([], [1]) == 0


def test_planted_passages_are_found(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(S, "TASK_BYTES", 5_000)
    rng = np.random.default_rng(7)
    clean = [text(rng, int(n)) for n in rng.integers(0, 400, 60)]
    passage = text(rng, 55)
    rows = list(enumerate(clean)) + [(100 + k, f"{text(rng, 30)} {passage} {text(rng, int(20 + k))}") for k in range(12)]
    fuzzy = text(rng, 80)
    rows += [(200 + k, f"{text(rng, 10)} {edited(rng, fuzzy, 3)} {text(rng, 25)}") for k in range(4)]
    line = "the very same line again and again. "
    rows += [(300, line * 30), (301, line * 40), (302, "short shared"), (303, "short shared"), (304, None), (None, passage), (100, rows[60][1])]
    long = text(rng, 30_000)
    rows += [(400, long), (401, text(rng, 50) + " " + long)]
    got = S.shared_passages(docs([(i, t, "s") for i, t in rows]).repartition(3)).collect()
    assert {r.doc_id for r in got} == {*range(100, 112), *range(200, 204), 300, 301, 400, 401}
    by = {i: re.findall(r"[0-9a-z]+", (t or "").lower()) for i, t in rows if i is not None}
    for r in got:
        a, b = by[r.doc_id][r.start_word : r.end_word], by[r.other_id][r.other_start : r.other_end]
        assert r.doc_id != r.other_id and len(a) >= S.MIN_WORDS and r.identity >= S.IDENTITY
        if r.doc_id < 200:
            assert set(passage.split()) >= set(a[2:-2])
        if r.doc_id < 400:
            assert r.equal_words <= S.equal_words(a, b)
    assert max(r.equal_words for r in got if r.doc_id == 400) >= 30_000 - 10
    assert S.shared_passages(docs([])).count() == 0


def test_fuzzy_passages_are_found_and_covered(spark, docs):
    rng = np.random.default_rng(8)
    rows, planted = [], {}
    for identity in (0.80, 0.85, 0.90, 0.95):
        for n in (60, 200):
            for _ in range(40):
                base = text(rng, n)
                for said in (base, edited(rng, base, round(n * (1 - identity)))):
                    planted[len(rows)] = (identity, n)
                    rows.append((len(rows), f"{text(rng, 30)} {said} {text(rng, 30)}", "s"))
    noise = range(len(rows), len(rows) + 100)
    rows += [(i, text(rng, 200), "s") for i in noise]
    cover = collections.defaultdict(set)
    for r in S.shared_passages(docs(rows)).collect():
        assert r.other_id == r.doc_id ^ 1  # pairs stand side by side
        cover[r.doc_id].update(range(r.start_word, r.end_word))
    assert not set(cover) & set(noise)
    for kind in set(planted.values()):
        mine = [i for i, k in planted.items() if k == kind]
        inside = [len(cover[i] & set(range(30, 30 + kind[1]))) / kind[1] for i in mine]
        assert np.mean([x > 0.5 for x in inside]) >= 0.9 and np.mean(inside) >= 0.85, (kind, np.mean([x > 0 for x in inside]), np.mean(inside))


def test_links_of_texts_that_share_exact_runs_match_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 6_000)
    rng = np.random.default_rng(9)
    parts = [text(rng, int(n)) for n in rng.integers(26, 80, 30)]
    rows = [(i, " ".join([text(rng, 12), *(parts[int(k)] for k in rng.integers(0, 30, int(rng.integers(1, 5)))), text(rng, 12)]), "s") for i in range(60)]
    runs = [{tuple(w[k : k + 51]) for k in range(len(w) - 50)} for w in (t.split() for _, t, _ in rows)]
    pairs = {(a, b) for a in range(60) for b in range(60) if a != b and runs[a] & runs[b]}
    links = {(r.doc_id, r.other_id) for r in S.shared_passages(docs(rows)).collect()}
    links |= {(b, a) for a, b in links}
    reach = {i: {i} for i in range(60)}
    for a, b in links:
        both = reach[a] | reach[b]
        for k in both:
            reach[k] = both
    assert {a for a, _ in pairs} <= {a for a, _ in links} and all(b in reach[a] for a, b in pairs)


def test_texts_with_a_long_run_are_linked_although_each_seed_of_it_is_crowded(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 30_000)
    rng = np.random.default_rng(22)
    rows, pairs = [], []
    for _ in range(4):
        passage = text(rng, 60)
        pairs.append((len(rows), len(rows) + 1))
        rows += [f"{text(rng, 20)} {passage} {text(rng, 20)}" for _ in range(2)]
        for k in range(0, 42, 6):  # hubs of each seed that hold 24 words of the passage
            rows += [f"{text(rng, 10)} {' '.join(passage.split()[k : k + 24])} {text(rng, 10)}" for _ in range(60)]
    got = {(r.doc_id, r.other_id): r for r in S.shared_passages(docs([(i, t, "s") for i, t in enumerate(rows)])).collect()}
    for a, b in pairs:
        found = got.get((a, b)) or got[(b, a)]
        assert found.start_word <= 21 and found.end_word >= 79


def test_equal_runs_hold_the_same_winnowed_run():
    rng = np.random.default_rng(23)
    for _ in range(200):
        run = rng.integers(0, 2**63, S.RUN + S.WINNOW - 1).astype(np.uint64)
        keys = []
        for _ in range(2):
            h = np.concatenate((rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64), run, rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64)))
            at, key = S.seeds_of(h)
            keys.append(set(S.long_runs(h, np.array([0, len(h)]), np.zeros(len(at), np.int64), at, key, np.ones(len(at), bool))[2].tolist()))
        assert keys[0] & keys[1]
    assert len(S.winnowed(np.zeros(0, np.uint64))) == 0


def test_seeds_and_runs_of_a_chunk_are_found_together_and_are_those_of_each_text(monkeypatch):
    rng, calls = np.random.default_rng(24), []
    mix = S.T.mix
    monkeypatch.setattr(S.T, "mix", lambda x: calls.append(len(x)) or mix(x))
    for many in (3, 60, 2**60):
        ends = np.concatenate(([0], np.cumsum(rng.integers(0, 90, 200))))
        h = mix(rng.integers(0, many, int(ends[-1])).astype(np.uint64))
        calls.clear()
        text_, at, key = S._seeds(h, ends)
        runs = S.long_runs(h, ends, text_, at, key, np.ones(len(key), bool))
        assert len(calls) <= 6  # not once or more for each text
        for t, (a, b) in enumerate(zip(ends, ends[1:])):
            one = S.seeds_of(h[a:b])
            assert (one[0] == at[text_ == t]).all() and (one[1] == key[text_ == t]).all()
            alone = S.long_runs(h[a:b], np.array([0, b - a]), np.zeros(len(one[0]), np.int64), *one, np.ones(len(one[0]), bool))
            assert all((x == y[runs[0] == t]).all() for x, y in zip(alone[1:], runs[1:]))


def test_texts_meet_although_no_hub_of_their_crowded_seeds_shares_a_passage(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 30_000)
    rng = np.random.default_rng(25)
    rows, pairs = [], []
    for k in range(6):
        words = text(rng, 64).split()
        other = [*words[:22], "x%d" % k, *words[23:43], "y%d" % k, *words[44:]]  # no 51 equal successive words
        pairs.append((len(rows), len(rows) + 1))
        rows += [f"{text(rng, 20)} {' '.join(w)} {text(rng, 20)}" for w in (words, other)]
        width = (14, 26)[k % 2]  # hubs of each seed hold a line of the passage; the longer ones hold its spans as well
        for a in range(0, 64 - width + 1, 5):
            rows += [f"{text(rng, 10)} {' '.join(words[a : a + width])} {text(rng, 10)}" for _ in range(40)]
    for holders in (32, 4):
        monkeypatch.setattr(S, "HOLDERS", holders)
        got = {(r.doc_id, r.other_id) for r in S.shared_passages(docs([(i, t, "s") for i, t in enumerate(rows)])).collect()}
        assert all((a, b) in got or (b, a) in got for a, b in pairs)


def test_chains_of_one_block_are_found_and_aligned_together_as_they_are_one_by_one(monkeypatch):
    rng, met = np.random.default_rng(26), []
    words = [rng.integers(0, 60, 160).astype(np.uint64) for _ in range(40)]
    for k in range(1, 40):  # a stretch of the first text, some of it changed
        n, a, b = (int(v) for v in rng.integers((12, 0, 0), (90, 70, 70)))
        words[k][b : b + n] = np.where(rng.random(n) < 0.1, 99, words[0][a : a + n])
        met.append((k, a, b, n))
    data = [" ".join(f"w{v}" for v in w) for w in words]
    raw, offsets = S.T.utf8(S.pa.array(data))
    small, ends = S._small_words(raw, offsets, np.arange(40))
    text_, other, x, y = (np.array(c) for c in zip(*((0, k, a + i, b + i) for k, a, b, n in met for i in range(0, n - S.SEED, 3))))
    monkeypatch.setattr(S, "chain", None)  # nothing goes pair by pair
    found = S.all_chains(text_, other, x, y)
    monkeypatch.undo()
    single = [(0, k, *p.reshape(-1).tolist()) for k in range(1, 40) for p in S.chains(x[other == k], y[other == k])]
    assert sorted(zip(found[0].tolist(), found[1].tolist(), *found[3].T.tolist())) == single and set(found[2].tolist()) == {1}
    asks = S.pa.Table.from_batches(list(S._chain_rows([7], np.zeros(1, np.int64), small[:160], ends[:2], *found))).combine_chunks().to_batches()[0]
    expected = set()
    for r in asks.to_pylist():
        path, mine = np.frombuffer(r["blocks"], np.int32).reshape(-1, 3).astype(np.int64), np.frombuffer(r["words"], np.uint16)
        start, their = max(0, int(path[0, 1]) - S.REACH), small[ends[r["other"]] : ends[r["other"] + 1]]
        for s, e, hs, he, same in S.align(mine, their[start : int(path[-1, 1] + path[-1, 2]) + S.REACH], path - [r["first"], start, 0]):
            if e - s >= S.MIN_WORDS and same / (e - s) >= S.IDENTITY:
                expected.add((7, s + r["first"], e + r["first"], r["other"] + 100, hs + start, he + start, same, same / (e - s), 0, r["other"]))
    monkeypatch.setattr(S, "align", None)
    assert S._passages_of(asks, np.arange(40) + 100, raw, offsets) == sorted(expected) and len(expected) > 10


def test_texts_of_passages_are_packed_tighter_and_come_back_whole(spark, docs):
    rng, size = np.random.default_rng(27), {}
    rows = docs([(i, text(rng, 300), "s") for i in range(100)]).coalesce(1)
    for level in (4, S.LEVEL):
        bodies = [r["body"] for r in C.make_chunks(rows, Scratch(spark, "level"), level=level).collect()]
        size[level] = sum(len(b) for b in bodies)
        assert b"".join(C.unpack(bytes(b))[0].tobytes() for b in bodies).decode().split() == " ".join(r["text"] for r in rows.collect()).split()
    assert size[S.LEVEL] < 0.99 * size[4]
