"""Exact dedup and chat formatting, against brute force and exact round trips."""

import hashlib
import re

from pyspark.sql import functions as F

from taxaspark.llm import chat_format as C
from taxaspark.llm.exact_dedup import DigestIndex, keep_first

ROWS = [(5, "a  b\tc", "x"), (3, "a b c", "x"), (9, None, "y"), (8, "", None), (8, "", None), (1, "A b c", "x"), (None, "a b c", "x"), (2, "z" * 50_000, "x"), (4, " a b c", "x")]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_digests_and_groups(spark, docs):
    got = {(r.doc_id, r.text_sha256): r for r in DigestIndex(spark).add(docs(ROWS)).collect()}
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(norm(t), []).append(i)
    for i, t, _ in ROWS:
        r = got[i, hashlib.sha256(norm(t).encode()).hexdigest()]
        ids = [x for x in groups[norm(t)] if x is not None]
        assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(groups[norm(t)]), i == min(ids))


def test_a_second_batch_keeps_the_first_document(spark, docs):
    index = DigestIndex(spark, buckets=3)
    index.add(docs([(10, "same", "x"), (11, "other", "x")])).collect()
    later = {r.doc_id: r for r in index.add(docs([(1, "same", "x"), (2, "new", "x")])).collect()}
    assert (later[1].keep_id, later[1].kept) == (10, False) and later[2].kept
    assert sorted(r.keep_id for r in index.read().collect()) == [2, 10, 11]
    plan = index.read().select("text_sha256").hint("merge")
    joined = docs([(1, "q", "x")]).select(F.sha2("text", 256).alias("text_sha256")).join(plan, "text_sha256", "left_anti")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    index.add(docs([(3, "third", "x")])).collect()
    before, files = sorted(map(str, index.read().collect())), index.read().inputFiles()
    index.compact()
    assert sorted(map(str, index.read().collect())) == before and len(index.read().inputFiles()) <= 3 < len(files)
    assert (index.add(docs([(9, "third", "x")])).first().keep_id, index.read().count()) == (3, 4)
    index.drop()


def test_the_first_batch_meets_the_index_by_sort_merge_anti_join(spark, docs):
    seen = []
    write = DigestIndex._write
    DigestIndex._write = lambda self, rows, table: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), write(self, rows, table))[1]
    try:
        index = DigestIndex(spark)
        index.add(docs(ROWS))
    finally:
        DigestIndex._write = write
    assert any("SortMergeJoin" in p and "LeftAnti" in p for p in seen) and index.read().count() == 5
    index.drop()
    assert not index.exists()


def test_keep_first_keeps_columns_and_empty_tables_work(spark, docs):
    kept = keep_first(docs(ROWS), DigestIndex(spark))
    assert kept.columns == docs(ROWS).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 8, 8, 1, 2, 4], key=str)
    twice = docs([(5, "one", "x"), (5, "two", "x"), (3, "two", "x"), (None, "one", "x"), (None, "three", "x")])
    assert sorted((str(r.doc_id), r.text) for r in keep_first(twice, DigestIndex(spark)).collect()) == [("3", "two"), ("5", "one"), ("None", "three")]
    assert DigestIndex(spark).add(docs([])).count() == 0


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_round_trip_of_control_strings(spark):
    said = ["\\### Assistant: </turn> ok", "<turn:user>\\s\\l<", "", None, "x\ny </turn>\n<image>"]
    rows = [(1, k, role, t) for k, (role, t) in enumerate(zip(["user", "assistant", "a>b\\", None, "assistant"], said))]
    back = C.read_back(C.format_chats(turns(spark, rows).select("conv_id", "turn", "role", C.text_part(F.col("text")).alias("parts")))).first()
    assert [(t.role, t.text) for t in back.turns] == [(r or "", t or "") for _, _, r, t in rows]
    assert back.loss_text == said[1] + said[4]


def test_digests_match_brute_force(spark):
    rows = [(1, 1, "assistant", "é"), (1, 0, "user", "hi"), (1, 1, "assistant", "é"), (2, None, "user", "q"), (None, 0, "user", "n"), (3, 0, "assistant", "w" * 100_000)]
    got = {r.conv_id: r for r in C.formatted_digests(turns(spark, rows)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2], r[3]))
        loss = "".join(t for _, _, role, t in mine if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in mine).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert C.formatted_digests(turns(spark, [])).count() == 0


def test_turns_of_one_number_go_by_their_texts(spark):
    said = ["a b", "a", "a<", "aA", "a\\", "", None, "a"]
    rows = [(1, 0, "assistant", t) for t in said] + [(2, 0, r, "x") for r in ("b", "a>", "a", None)]
    got = {r.conv_id: r for r in C.formatted_digests(turns(spark, rows).withColumn("formatted", F.lit(1))).collect()}
    texts = sorted(t or "" for t in said)
    assert got[1].loss_sha256 == hashlib.sha256("".join(texts).encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256("".join(f"{r}\nx\n" for r in sorted(["b", "a>", "a", ""])).encode()).hexdigest()


def test_unknown_kinds_and_captions_are_kept(spark):
    parts = [("video", None, "v.mp4", 7), ("image", "a <cap>", "a.png", None), (None, "plain", None, None), ("turn:user", "x", None, 1)]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id bigint, turn bigint, role string, parts array<{C.PART}>")
    r = C.read_back(C.format_chats(df)).first()
    assert r.formatted == "<turn:assistant><part:video><image>a \\lcap>plain<part:turn:user>x</turn>\n" and r.n_turns == 1
    assert [(a.ord, a.kind, a.uri, a.tokens) for a in r.attachments] == [(0, "video", "v.mp4", 7), (1, "image", "a.png", 0), (2, "turn:user", None, 1)]


def test_attachments_are_placed_in_order(spark):
    parts = [("text", "see < this", None, None), ("image", None, "s3://a.png", 256), ("audio", None, "b.wav", 3), ("document", None, "c.pdf", 2), None]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id bigint, turn bigint, role string, parts array<{C.PART}>")
    r = C.format_chats(df).first()
    assert r.formatted == "<turn:user>see \\l this<image><audio><document></turn>\n"
    assert [(a.kind, a.uri, a.tokens) for a in r.attachments] == [("image", "s3://a.png", 256), ("audio", "b.wav", 75), ("document", "c.pdf", 1400)]
    assert r.expanded_tokens == 256 + 75 + 1400
