"""Stage helpers keep every column as it came, and plain words have the ids of the whole tokenizer."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowsieve.llm import catalog, langid, packing, quality, simhash

CLASHING = ["_row", "_ROW_", "_language", "_text", "_noise", "_quality", "weight", "selected", "log_ratio", "n_grams", "mean_ratio", "gumbel_key", "id", "fp", "component_id", "row", "text.x"]


@pytest.fixture(scope="module")
def clashing(spark, small):
    docs = catalog.documents(spark, small).where("doc_id < 200")
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string")))
    return docs


def check_columns(kept, docs):
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    rows = kept.collect()
    for r in rows:
        for name in CLASHING:
            assert r[docs.columns.index(name)] == f"{name}:{r.doc_id}"
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all(texts[r.doc_id] == r.text for r in rows)
    return {r.doc_id for r in rows}


def test_language_stage_keeps_columns(clashing):
    plain = clashing.select("doc_id", "text", "lang")
    assert check_columns(langid.keep_identified(clashing), clashing) == {r.doc_id for r in langid.keep_identified(plain).collect()} != set()


def test_quality_stage_keeps_columns(spark, small, clashing):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    plain = clashing.select("doc_id", "text")
    chosen = {r.doc_id for r in quality.resample(plain, labels).where("selected").collect()}
    assert check_columns(quality.keep_good(clashing, labels), clashing) == chosen != set()


def test_copies_stage_keeps_columns(clashing):
    groups = simhash.simhash_groups(clashing.select("doc_id", "text"), 4, 4)
    assert check_columns(simhash.keep_one(clashing), clashing) == {r.component_id for r in groups.collect()}


def test_stages_of_empty_tables(clashing, spark, small):
    none, labels = clashing.limit(0), spark.read.parquet(f"{small}/labels.parquet")
    for kept in (langid.keep_identified(none), quality.keep_good(none, labels), simhash.keep_one(none)):
        assert kept.columns == clashing.columns and kept.collect() == []


def test_word_ids_are_those_of_the_whole_tokenizer(spark, small, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3000)  # words are forgotten and found again
    path = catalog.tokenizer_file("word_bpe_49k.json")
    texts = [r.text for r in catalog.documents(spark, small).select("text").collect()]
    draw = random.Random(1)
    signs = "abzAZéÉßÿÀ×÷'sStTrRe0129.,!<|>_-~`́ªµº\x7f\x01…文ΣŒİ\u0085  \n\t"
    texts += ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(5000)]
    texts += ["<|startoftext|>x", "a<|endoftext|>b", "it's they're I'LL 'start can't.'s ''s", "é É", "\u0085a b\u0085", "ßẞ", None, ""]
    own, whole = packing.WordTokenizer(path), Tokenizer.from_file(path)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for ids, e in zip(own.encode(part), whole.encode_batch([t or "" for t in part], add_special_tokens=False)):
            assert ids.tolist() == [*e.ids, packing.END_ID]
