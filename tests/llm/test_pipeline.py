"""The pipeline against brute force, stage by stage."""

import pytest

import corpus_pipeline
from rulemill.llm import decontam, neardup, quality, spiece, toxicity

SF = "/root/testdata/sf0.01"


def test_run(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    good = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).collect() if r.score >= 0.3}
    one = docs.where(docs.doc_id.isin(list(good)))
    clean = {r.doc_id for r in toxicity.score(one, toxicity.fit(one, labels)).collect() if r.score < 0.7}
    texts = [(d, t) for d, t in docs.select("doc_id", "text").collect() if d in clean]
    comps = neardup.brute_force(texts, 5, 80)
    texts = [(d, t) for d, t in texts if comps[d][1] == d]
    found = {r[0]: r[3] for r in decontam.brute_force(texts, bench)}
    texts = [(d, t) for d, t in texts if not found[d]]
    table = spiece.table(spiece.default_model())
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: table.encode(t) for d, t in texts}
    assert len(good) < docs.count() and len(clean) < len(good) and len(texts) < len(clean)


def test_stages_keep_columns_and_survive_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 3), (4, "a b c d e f g", "en", "s", 1), (4, "a b c d e f g", "en", "s", 1), (5, "a b c d e f g", None, "s", 1), (6, "word " * 20000, "en", "s", 1)]
    for rows in (data, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == docs.columns, name
        kept = corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()
        assert sorted(str(r.doc_id) for r in kept) == (["1", "2", "4", "6", "None"] if rows else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_clashing_columns_null_and_repeated_ids(spark):
    """Decisions are made row by row, whatever further columns are called."""
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("length(text) > 100").first().text
    base = " ".join(f"word{i}" for i in range(60))
    data = [(1, base), (1, base + " more"), (1, "quite another text of some words"), (2, base), (None, base), (None, item), (3, item), (3, "clean text"), (4, None), (4, None), (5, "ABC")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'p' AS predicted", "1 AS score", "true AS held_out", "2 AS _gone", "3 AS _key", "4 AS _id", "5 AS _text", "6 AS _again", "7 AS kept", "8 AS component_id", "9 AS contaminated", "10 AS `a.b`")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "toxicity", "near_duplicates", "decontamination"):
        out = stages[name](spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() <= len(data), name
    near = sorted((str(r.doc_id), str(r.text)[:5], r._gone) for r in stages["near_duplicates"](spark, docs, SF).collect())
    assert [x[:2] for x in near] == sorted([("1", "word0"), ("1", "quite"), ("3", item[:5]), ("3", "clean"), ("4", "None"), ("5", "ABC")]) and {x[2] for x in near} == {2}
    clean = [(r.doc_id, r.text) for r in stages["decontamination"](spark, docs, "/root/testdata/sf0.001").collect()]
    assert sorted(map(str, clean)) == sorted(str(x) for x in data if x[1] != item)
    assert stages["tokens"](spark, docs, SF).count() == len(data)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "tokens"]


@pytest.mark.parametrize("name", ["__spark_entry__"])
def test_registered(name):
    import importlib

    e = importlib.import_module(name)
    assert {f"op{i}_" for i in range(1, 11)} <= {n.split("_")[0] + "_" for n in e.queries()} and "pipeline" in e.queries()
