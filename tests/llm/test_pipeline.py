"""The stages of the pipeline one after the other, on a planted and on an odd table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigilgrid.llm.common import stage

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _toxicity string"
WORDS = {
    "en": "the and of station reading water house morning between letters world nothing".split(),
    "de": "der und nicht schule wasser zwischen morgen straße über lesen häuser welt".split(),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, near copies and junk, and their labels."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        words = [rng.choice(WORDS[lang]) + rng.choice("abcdefgh") for _ in range(rng.randint(40, 80))]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = "moron"
        rows.append((i, " ".join(words), lang, "hot" if i % 3 else "rare", 1, "x"))
        labels.append((i, int(toxic)))
    near = [(1000 + i, rows[i][1].replace(" ", "\t ").capitalize(), *rows[i][2:]) for i in range(1, 6)]  # the same words
    copies = [(2000 + i, *rows[1][1:]) for i in range(30)]
    junk = [(3000, None, "en", "hot", 0, "x"), (3001, "", None, None, None, None), (3002, "12 34 !!", "en", "hot", 0, "x")]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows + near + copies + junk, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_do_their_work_and_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, folder), name)
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert name == "byte_bpe" or docs.columns == columns
    clean = {i for i in range(240) if i % 6}
    assert kept["toxicity"] == clean | {i for i in range(1000, 1006) if i != 1000} | set(range(2000, 2030)) | {3000, 3001, 3002}
    assert kept["language_id"] == kept["toxicity"] - {3000, 3001, 3002}
    assert kept["simhash_near_dedup"] == clean
    assert kept["mixing"] <= clean and len(kept["mixing"]) > 80
    assert kept["byte_bpe"] == kept["mixing"]
    assert docs.filter(~F.col("round_trip") | (F.col("n_tokens") == 0)).count() == 0


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, folder).count() == 0


def test_models_are_fitted_without_more_python_workers(spark, folder, monkeypatch):
    """Lists of the driver become tables in the JVM, not in Python workers that then linger beside those of the stages."""

    def refuse(*_, **__):
        raise AssertionError("a table from Python rows")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert 200 < corpus_pipeline.drop_toxic(spark, docs, folder).count() < 279
    assert corpus_pipeline.drop_unknown_language(spark, docs, folder).count() > 200


def test_run_gives_tokens(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids", "round_trip"]
