"""License scan, toxicity, HTML extraction, mixing and decontamination on small tables."""

import re

import numpy as np
import pyarrow as pa
import pytest

from taxaspark.llm import decontaminate as D
from taxaspark.llm import mixing as M
from taxaspark.llm import text as T
from taxaspark.llm import toxicity as X
from taxaspark.llm.license_scan import BASE, Found, Scanner, resolve, rules, scan_licenses

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_word_hashes_do_not_depend_on_batches():
    texts = ["Alpha beta", None, "", "x" * 3_000_000 + " beta", "beta alpha BETA", "é-É"]
    found = []
    for a, _, h, rows in T.text_words(pa.array(texts), T.ALNUM, 1000):
        found += [(a + int(r), int(x)) for r, x in zip(rows, h)]
    expect = [(i, T.word_hash(w)) for i, t in enumerate(texts) for w in words(t)]
    assert found == expect


def test_there_are_hundreds_of_rules_and_base_places_match_brute_force(spark, docs):
    assert len(rules()) > 300
    rng = np.random.default_rng(1)
    phrases = [p for p, _ in BASE]
    texts = [None, "", "Under the MIT license", "cc by nc cc-by NC", "apache license, version 2.0 under the mit license"]
    texts += [" ".join(rng.choice(WORDS + phrases + ["license", "under", "Public Domain"], 60)) for _ in range(30)]
    got = {r.doc_id: r for r in scan_licenses(docs([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        hits = [(k, label) for p, label in BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(k for k, _ in hits), max(k for k, _ in hits)) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_longer_and_better_detections_suppress_contained_ones():
    found = Scanner().detections("This is licensed under the Apache License, Version 2.0. Also the GNU General Public License version 3 applies.")
    assert [label for *_, label in found] == ["apache-2", "gpl-3"]
    rng = np.random.default_rng(2)
    for _ in range(50):
        spans = [Found(int(a), int(a + n), int(r)) for a, n, r in zip(rng.integers(0, 30, 20), rng.integers(1, 8, 20), rng.integers(0, 4, 20))]
        kept = []
        for f in sorted(spans, key=lambda f: (f.rule, f.start - f.end, f.start, f.rule)):
            if not any(k.start <= f.start and k.end >= f.end for k in kept):
                kept.append(f)
        assert resolve(spans, [0, 1, 2, 3]) == sorted(kept)


def test_toxicity_learns_held_out_rows(spark, docs):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 3 == 0
        w = list(rng.choice(WORDS, 40)) + (["nasty"] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 0, int(bad)))
    rows += [(5000, None, "s"), (5001, "", "s"), (None, "nasty", "s")]
    table = spark.createDataFrame([*labels, (0, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = X.score_toxicity(docs(rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert len(held) > 200 and np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.98
    kept = X.drop_toxic(docs(rows), table)
    assert kept.columns == docs(rows).columns and {5000, 5001} <= {r.doc_id for r in kept.collect()}
    none = spark.createDataFrame([], table.schema)
    assert {r.score for r in X.score_toxicity(docs(rows[:3]), none).collect()} == {0.0}
    assert X.score_toxicity(docs([]), table).count() == 0


def slow_model(texts):
    """FTRL over all features, one dictionary entry each, in the documented order."""
    z, n, bias = {}, {}, ("b",)

    def weight(f):
        l1 = 0.0 if f == bias else X.L1
        v = z.get(f, 0.0)
        return 0.0 if abs(v) <= l1 else (np.sign(v) * l1 - v) / ((X.BETA + np.sqrt(n.get(f, 0.0))) / X.ALPHA + X.L2)

    def of(t):
        h = T.words(np.frombuffer((t or "").encode(), np.uint8), T.ALNUM)[0]
        return sorted(set(X.features(h, np.zeros(len(h), np.int64))[1].tolist()))

    turn = lambda i: int(T.mix(np.array([i + 7], np.uint64))[0])
    for _ in range(X.EPOCHS):
        for i, t, y in sorted(texts, key=lambda r: turn(r[0])):
            at = [*of(t), bias]
            w = [weight(f) for f in at]
            g = 1 / (1 + np.exp(-sum(w))) - y
            for f, x in zip(at, w):
                m = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (np.sqrt(m + g * g) - np.sqrt(m)) / X.ALPHA * x
                n[f] = m + g * g
    return lambda t: 1 / (1 + np.exp(-sum(weight(f) for f in [*of(t), bias])))


def test_toxicity_matches_brute_force_in_one_part_or_many(spark, docs, monkeypatch):
    import zlib

    rng = np.random.default_rng(8)
    rows = [(i, " ".join([*rng.choice(WORDS, 12), *(["nasty", "you"] if i % 4 == 0 else [])]), "s") for i in range(160)]
    rows += [(400, " ".join(f"long{k}" for k in range(30_000)) + " nasty you", "s"), (401, None, "s"), (0, rows[0][1], "s"), (0, "zzz last", "s")]
    said = {}
    for i, t, _ in rows:
        said[i] = min(said[i], t) if i in said else t
    labels = [(i, 0, int(i % 4 == 0)) for i in said] + [(8, 0, 0), (12, 1, 0)]  # conflicting labels: toxic
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    slow = slow_model([(i, t, int(i % 4 == 0)) for i, t in said.items() if zlib.crc32(str(i).encode()) % 5])
    for size in (X.PART_BYTES, 4000):
        monkeypatch.setattr(X, "PART_BYTES", size)
        if size < 10_000:  # parts are ranges of the same order, so the result is the same
            got = {(r.doc_id, r.score) for r in X.score_toxicity(docs(rows), table).collect()}
            assert got == first
        else:
            first = {(r.doc_id, r.score) for r in X.score_toxicity(docs(rows), table).collect()}
            got = dict(first)
            for i in (0, 1, 4, 400, 401):
                assert any(abs(p - slow(t)) < 1e-9 for j, t, _ in rows if j == i for k, p in first if k == i)


def test_targets_are_capped_and_use_all_words():
    sizes, weights = [100, 1, 50, 0], [5, 2, 1, 5]
    t = M.targets(sizes, weights)
    assert sum(t) == pytest.approx(151) and all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes)) and t[1] == 3


def test_targets_match_repeated_sharing():
    rng = np.random.default_rng(9)
    for _ in range(200):
        sizes = rng.integers(0, 1000, int(rng.integers(1, 12))).tolist()
        weights = [M.WEIGHTS[i % 3] for i in range(len(sizes))]
        out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
        while True:  # share by weight, stop at the cap, share the excess again
            total = sum(weights[i] for i in open_)
            over = {i for i in open_ if left * weights[i] / total > 3 * sizes[i] + 1e-9}
            for i in over or open_:
                out[i] = 3.0 * sizes[i] if over else left * weights[i] / total
            if not over:
                break
            left -= sum(out[i] for i in over)
            open_ -= over
            if not open_:
                break
        assert M.targets(sizes, weights) == pytest.approx(out, abs=1e-6)


def test_a_hot_source_is_many_tasks_also_without_broadcast(spark, docs, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(i, "w " * int(n), "hot" if i % 3 else None) for i, n in enumerate(rng.integers(0, 60, 4000))] + [(None, "a b", "hot"), (4001, "w " * 100_000, "hot")]
    monkeypatch.setattr(M, "BLOCK", 256)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plain = sorted((str(r.doc_id), r.taken) for r in M.mix_sources(docs(rows)).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = M.mix_sources(docs(rows))
        assert sorted((str(r.doc_id), r.taken) for r in out.collect()) == plain
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(source_no#" not in plan or "block" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cube_flight_is_balanced_and_unbiased():
    rng = np.random.default_rng(4)
    size = np.sort(rng.integers(1, 400, 200))[::-1]
    total = np.zeros(200)
    for k in range(400):
        out = np.array(M.flight([0.3] * 200, size.tolist(), np.random.default_rng(k), True))
        # Landing decides one unit by chance; all else is balanced.
        assert set(out) <= {0.0, 1.0} and abs(out.sum() - 60) <= 2 and abs((out * size).sum() - 0.3 * size.sum()) <= size.max()
        total += out
    assert abs(total / 400 - 0.3).max() < 0.12


def test_mixing_meets_targets(spark, docs):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 3}" if i % 3 else "s0") for i, n in enumerate(rng.integers(1, 80, 6000))]
    rows += [(9000, None, "s1"), (9001, "", None), (9002, "a b", None), (1, "w w", "s1")]
    got = M.mix_sources(docs(rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= max(80, 0.01 * target)
    again = M.mix_sources(docs(rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert M.mix_sources(docs([])).count() == 0


def index_of(items):
    found, stats = D.pieces(items), D.Statistics()
    stats.add(found)
    return D.Index(found, stats)


def sums_of(index, some):
    out = {}
    for w in some:
        for k in range(index.starts[w], index.starts[w + 1]):
            out[int(index.items[k])] = out.get(int(index.items[k]), 0) + float(index.impacts[k])
    return out


def test_wand_finds_all_items_above_threshold(monkeypatch):
    monkeypatch.setattr(D, "FAN", 3)
    rng = np.random.default_rng(6)
    index = index_of([(i, " ".join(rng.choice(WORDS, 12))) for i in range(130)])
    assert len(index.levels) > 2
    passages = [np.unique(rng.integers(0, len(index.vocabulary), int(n))) for n in rng.integers(1, 16, 200)]
    who, block = index.live_blocks(np.concatenate(passages), np.cumsum([0, *(len(p) for p in passages)]))
    live = {(int(p), int(b)) for p, b in zip(who, block)}
    assert len(live) < len(passages) * 33  # some are skipped
    for k, some in enumerate(passages):
        sums = sums_of(index, some.tolist())
        mine = sorted(b for p, b in live if p == k)
        assert {i // D.BLOCK for i, x in sums.items() if x >= 1} <= set(mine)
        got = dict(index.retrieve(some.tolist(), mine)) if mine else {}
        assert got == pytest.approx({i: x for i, x in sums.items() if x >= 1 - 1e-9})
        for least in (0.2, 0.6):
            got = dict(index.retrieve(some.tolist(), list(range(33)), least))
            assert got == pytest.approx({i: x for i, x in sums.items() if x >= least})


def test_the_index_grows_with_its_postings():
    rng = np.random.default_rng(11)
    item = lambda: " ".join(f"v{k}" for k in rng.zipf(1.3, 40) % 50_000)
    small, large = ([(i, item()) for i in range(n)] for n in (200, 3200))
    assert index_of(large).nbytes() < 20 * index_of(small).nbytes()


def slow_contaminated(docs, items):
    """Every passage against every piece, by dictionaries of words."""
    import math

    stats = [(w, part) for w, part in D.pieces(sorted({(i, t) for i, t in items if t is not None and i is not None}))]
    df, n = {}, len(stats)
    for w, _ in stats:
        for x in set(w.tolist()):
            df[x] = df.get(x, 0) + 1
    mean = sum(len(w) for w, _ in stats) / n
    impact = []
    for w, _ in stats:
        w = w.tolist()
        impact.append({x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * (D.K1 + 1) / (w.count(x) + D.K1 * (1 - D.B + D.B * len(w) / mean)) for x in set(w)})
    window, out = 2 * max(32, *(len(w) for w, _ in stats)), []
    share = lambda part, have: np.mean([g in have for g in part]) if len(part) else 1.0
    runs = lambda w, m: {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
    for doc, t in docs:
        w, best = [T.word_hash(x) for x in words(t)], {}
        for a in range(0, max(1, len(w) - window // 2), window // 2):
            inside = w[a : a + window]
            for (_, part), worth in zip(stats, impact):
                score = sum(v for x, v in worth.items() if x in set(inside))
                q, r = ((x.tolist(), min(3, len(x))) for x in (part.question, part.answer))
                q, r = share(runs(*q), runs(inside, q[1])), share(runs(*r), runs(inside, r[1]))
                if score >= D.TAU * sum(worth.values()) and q >= D.QUESTION and r >= D.ANSWER and score > best.get(part.item_id, (0,))[0]:
                    best[part.item_id] = (score, a, q, r)
        out += [(doc, i, a, score, q, r) for i, (score, a, q, r) in best.items()]
    return out


def test_contaminated_matches_brute_force_for_any_shards(spark, docs, monkeypatch):
    rng = np.random.default_rng(12)
    vocabulary = [f"w{k}" for k in range(150)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, f"{say(int(rng.integers(4, 30)))}? {say(3)}") for i in range(40)]
    items += [(40, say(300)), (41, None), (42, ""), (43, "One"), (5, items[5][1]), (6, say(20)), (None, say(9))]
    rows = [(i, " ".join([say(int(rng.integers(0, 80))), *(items[int(k)][1] for k in rng.integers(0, 41, int(rng.integers(0, 3)))), say(20)]), "s") for i in range(60)]
    rows += [(None, items[3][1], "s"), (3, rows[3][1], "s"), (200, None, "s"), (201, say(3000) + items[40][1] + say(500), "s")]
    expect = sorted(slow_contaminated([(i, t) for i, t, _ in rows], items), key=str)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    for size in (D.SHARD_BYTES, 700):
        monkeypatch.setattr(D, "SHARD_BYTES", size)
        got = sorted(map(tuple, D.contaminated(docs(rows), bench).collect()), key=str)
        assert [x[:3] for x in got] == [x[:3] for x in expect] and len(got) > 30
        assert np.allclose([x[3:] for x in got], [x[3:] for x in expect])
        clean = D.drop_contaminated(docs(rows), bench)
        hit = {str(x[0]) for x in expect}
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _, _ in rows if str(i) not in hit)


def test_leaks_are_found_and_clean_texts_kept(spark, docs):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(4000)]
    item = lambda n: " ".join(rng.choice(vocabulary, n)) + "? The answer " + " ".join(rng.choice(vocabulary, 4))
    items = [(i, item(25)) for i in range(20)] + [(20, item(300)), (21, None), (22, "")]
    clean = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(0, 3000, 40)]
    rows = [(i, t, "s") for i, t in enumerate(clean)] + [(90, None, "s")]
    rows += [(100 + i, clean[3] + " " + t.upper() + " " + clean[5], "s") for i, t in items[:21]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.contaminated(docs(rows), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(100 + i, i) for i in range(21)}
    kept = D.drop_contaminated(docs(rows), bench)
    assert kept.columns == docs(rows).columns and {r.doc_id for r in kept.collect()} == {*range(40), 90}
    assert D.contaminated(docs(rows), bench.limit(0)).count() == 0 and D.contaminated(docs([]), bench).count() == 0


def spelled(pattern):
    """Every text a pattern without loops matches, one letter of each set."""
    import itertools
    from re import _parser

    def of(items):
        parts = []
        for op, arg in items:
            kind = str(op)
            if kind == "LITERAL":
                parts.append([chr(arg)])
            elif kind == "IN":
                parts.append([chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])])
            elif kind == "SUBPATTERN":
                parts.append(of(arg[3]))
            elif kind == "BRANCH":
                parts.append([t for branch in arg[1] for t in of(branch)])
            else:
                assert kind == "MAX_REPEAT" and arg[:2] == (0, 1), (op, arg)
                parts.append(["", *of(arg[2])])
        return ["".join(t) for t in itertools.product(*parts)]

    return of(_parser.parse(pattern))


def test_every_alternative_of_a_rule_has_its_keyword_and_is_found():
    lost, scanner = [], Scanner()
    for rule in rules():
        for t in spelled(rule.pattern.pattern[6:-5]):
            if rule.keyword not in t.split():
                lost.append((rule.keyword, t))
        found = {label for _, _, label in scanner.detections(spelled(rule.pattern.pattern[6:-5])[-1])}
        if not found:
            lost.append(rule)
    assert not lost
    assert len({r.pattern.pattern for r in rules()}) == len(rules()) > 300


SAID = {
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2-or-later",
    "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception": "apache-2-llvm",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.": "apache-2",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3-or-later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "available under CC BY-NC-SA 4.0": "cc-by-nc-sa",
    "see https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
    "licensed under the FreeBSD license": "bsd-2-clause",
    "released under the PSF license": "psf",
    "distributed under the terms of the GNU Lesser General Public License v2.1": "lgpl-2.1",
    "GPL version 2 with the Classpath exception": "gpl-classpath",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Mozilla Public License, v. 2.0": "mpl-2",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
}
NOT_SAID = [
    "show your license curl up and sleep", "the ruby license plate", "an artistic license was taken", "a license to drive", "we apache helicopters", "my isc cream", "the general public was invited to the library",
    "general purpose public license office", "python and ruby are languages", "by sa and by nd", "the mit campus", "open source software is nice", "commons of the village", "boost your software skills", "domain names are public",
]


@pytest.mark.parametrize("said", SAID)
def test_license_texts_get_their_label(said):
    row = Scanner().scan(said)
    assert SAID[said] in row[5].split(",") and row[6] >= 0.8
    found = [label for *_, label in Scanner().detections(said)]
    assert SAID[said] in found


@pytest.mark.parametrize("said", NOT_SAID)
def test_prose_gets_no_label(said):
    assert Scanner().scan(said)[5] == "" and Scanner().detections(said) == []


def test_labels_match_all_rules_tried_one_by_one(spark, docs):
    rng = np.random.default_rng(16)
    parts = [*SAID, *NOT_SAID, "Copyright (c) 2020 all rights reserved", "under the MIT license", "cc by nc"]
    texts = [" ".join(rng.choice(parts, int(rng.integers(1, 6)))) for _ in range(60)] + ["mit license " * 20_000, None]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[0], "s"), (0, texts[0], "s")]
    got = {}
    for r in scan_licenses(docs(rows)).collect():
        assert got.setdefault(r.doc_id, r) == r
    for i, t, _ in rows[:60]:
        line, kept = " " + " ".join(words(t)) + " ", []
        spans = [(r.priority, m.start(), m.end(), n) for n, r in enumerate(rules()) for m in r.pattern.finditer(line)]
        for p, s, e, n in sorted(spans, key=lambda x: (x[0], x[1] - x[2], x[1], x[3])):
            if not any(a <= s and e <= b for _, a, b, _ in kept):
                kept.append((p, s, e, n))
        base = {label for phrase, label in BASE if f" {phrase} " in line}
        assert got[i].labels == ",".join(sorted(base | {rules()[n].label for *_, n in kept})), t
    assert got[60].labels == "mit" and got[61].labels == "" and got[None].labels == got[0].labels
    assert scan_licenses(docs([])).count() == 0
