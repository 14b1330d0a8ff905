from __future__ import annotations

import corpus_pipeline
from tidewatch.llm import language_id, packing, secret_scan, simhash, token_counts
from tidewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    secret = [(10**6, "the words of it and token=abcdefgh and the end", "en", "s", 46)]
    docs = docs.unionByName(spark.createDataFrame(secret, docs.schema))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"{k}"))
        if name != "packing":
            assert docs.columns == columns
        ids = {r["doc_id"] for r in before.select("doc_id").collect()}
        rows = docs.collect()
        if name == "language_id":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            gone = ids - {r["doc_id"] for r in rows}
            assert len(gone) < 0.05 * len(ids)
            assert all(len(language_id.words_of(texts[i])) < 5 for i in gone)
        elif name == "near_duplicates":
            component = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert sorted(r["doc_id"] for r in rows) == sorted(set(component.values()))
        elif name == "secrets":
            assert {r["doc_id"] for r in rows} == ids
            assert all(not secret_scan.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in rows)
            assert any("[secret]" in r["text"] for r in rows)
        elif name == "mixing":
            assert {r["doc_id"] for r in rows} <= ids and len(rows) != len(ids)
        else:
            encoding, _ = token_counts.Vocabulary().encoder()
            tokens = sum(len(encoding.encode_ordinary(r["text"])) for r in before.collect())
            assert sum(r["n_tokens"] for r in rows) == tokens
            assert all(r["bin_length"] in packing.LENGTHS for r in rows if r["bin_id"] is not None)


def test_mixing_keeps_clean_documents_whatever_their_share(spark, tmp_path):
    words = {"good": "alpha beta gamma", "poor": "lorem ipsum dolor", "toxic": "vile foul nasty"}
    kinds = ["poor"] * 6 + ["good"] * 2 + ["toxic"] * 2
    rows = [(i, f"{words[kinds[i % 10]]} " * 10, "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, int(kinds[i % 10] == "good"), int(kinds[i % 10] == "toxic")) for i in range(400)]
    labelled = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    labelled.write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect()}
    assert kept >= {i for i in range(400) if kinds[i % 10] != "toxic"}


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "piece", "first", "n_tokens", "bin_id", "bin_length", "bin_offset"]
    assert found.count() > 0


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_nulls_and_other_columns(spark):
    rows = [
        (1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, "x", 1), (3, "the words of it", "en", "s", 15, "x", 1),
        (3, "the words of it", "en", "s", 15, "x", 1), (None, "the words of it", "en", "s", 15, "x", 1),
        (4, "token=abcdefgh in the text", None, "s", 26, "x", 1), (5, "the words " * 30_000, "en", "s", 0, "x", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, found string, whole long"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0
        assert name == "packing" or out.columns == docs.columns


def test_every_numbered_query_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and len(corpus_pipeline.STAGES) == 5
