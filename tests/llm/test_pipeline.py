"""The pipeline's stages, one after the other, on documents with one planted case each."""

import numpy as np

import corpus_pipeline
from taxaspark.llm.queries import ORACLES, QUERIES


def test_stages_drop_what_they_should(spark, tmp_path):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(2000)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(i, say(60), "en", f"s{i % 3}", 0) for i in range(300)]
    labels = [(i, 1, 0) for i in range(300)]
    rows += [(1000 + i, say(30) + " nasty " + say(30), "en", "s0", 0) for i in range(120)]
    labels += [(1000 + i, 0, 1) for i in range(120)]
    item = say(30)
    near = rows[1][1].split()
    near[30] = "edit"
    rows += [(2000, rows[0][1].replace(" ", "  "), "en", "s1", 0), (2001, " ".join(near), "en", "s1", 0), (2002, say(20) + " " + item + " " + say(20), "en", "s2", 0)]
    rows += [(2003, None, None, None, None), (2004, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, {r[0] for r in rows}
    gone = [set(range(1000, 1120)), {2000, 2004}, {2001}, {2002}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == columns
            left -= gone[k]
            assert {r.doc_id for r in docs.collect()} == left, name
    assert {r.doc_id for r in docs.collect()} == left and {"taken", "target"} <= set(docs.columns)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left


def test_every_operator_has_its_query():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")}) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_queries_equal_their_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    for name, sql in ORACLES.items():
        got, found = QUERIES[name](spark, folder), con.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(got.columns) and sorted(map(tuple, got.select(*columns).collect())) == sorted(found.fetchall()), name
