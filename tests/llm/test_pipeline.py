"""The corpus pipeline on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, "\n".join(sentence(30) for _ in range(4)), "en") for i in range(40)]
    leak = sentence(14)
    rows += [(100, rows[3][1], "en"), (101, None, "en"), (102, "... 12", "en"), (103, sentence(20) + " " + leak.upper() + " " + sentence(9), "en")]
    one = sentence(200).split()
    rows += [(110, " ".join(one), "en"), (111, " ".join([*one[:60], "changed", *one[61:140], "again", *one[141:]]), "en")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
        docs = out
        if name != "packing":
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert seen["language_id"] == {*range(40), 100, 103, 110, 111}
    assert 100 not in seen["line_dedup"] and seen["line_dedup"] >= {*range(40), 103, 110}
    assert not {110, 111} <= seen["ngram_jaccard"] and seen["ngram_jaccard"] >= {*range(40), 103, 110}
    assert seen["decontamination"] == seen["ngram_jaccard"] - {103} == seen["packing"]


def test_run_and_empty(spark, corpus, tmp_path):
    rows = corpus_pipeline.run(spark, corpus)
    assert rows.agg(F.sum("length")).first()[0] == rows.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0
