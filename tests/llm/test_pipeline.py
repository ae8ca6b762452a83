from __future__ import annotations

import duckdb

import corpus_pipeline
from epistola.llm import quality
from epistola.llm.oracles import ORACLES
from epistola.llm.queries import QUERIES
from tests.llm.test_copies import brute_components, brute_exact, brute_passages, near_copies


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in ORACLES.items():
        frame = QUERIES[name](spark, sf)
        columns = sorted(frame.columns)
        want = con.sql(sql).df()[columns]
        got = frame.toPandas()[columns]
        assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, want.itertuples(index=False))), name


def test_pipeline_equals_brute_force(spark, sf):
    """The near stage takes five words and 80 percent, as stages without a contract of their own do."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1")
    rows = [(r.doc_id, r.text) for r in scored.collect()]
    kept = {keep for _, keep, _, _ in brute_exact(rows)}
    rows = [(i, t) for i, t in rows if i in kept]
    kept = {c for _, _, c in brute_components(rows, 5, 80)}
    rows = [(i, t) for i, t in rows if i in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r[0] for r in brute_passages(rows, items) if not r[5]}
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept)


def test_stages_take_odd_and_empty_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, uid string"
    docs = spark.createDataFrame([(1, None, None, None, None, "a", "b"), (2, "", "en", "s", 0, None, None), (2, "", "en", "s", 0, None, None), (None, "x y z", "en", "s", 5, "a", "b")], schema)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf)
            assert set(docs.columns) <= set(out.columns) and out.count() <= table.count()


def test_near_stage_joins_five_words_at_eighty_percent(spark, sf):
    def edited(base, places):
        return " ".join("new" + w if i in places else w for i, w in enumerate(base))

    short, long = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(200)]
    rows = near_copies(7, 6, 12)
    key = max(k for k, _ in rows) + 1
    pairs = [(edited(short, ()), edited(short, (30, 60))), (edited(long, ()), edited(long, (30, 70, 110, 150)))]  # Jaccard 0.811 and 0.815, on three words 0.885 and 0.886
    rows += [(key + i, t) for i, t in enumerate(t for pair in pairs for t in pair)]
    got = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect())
    assert got == sorted({c for _, _, c in brute_components(rows, 5, 80)})
    assert key in got and key + 1 not in got and key + 2 in got and key + 3 not in got
