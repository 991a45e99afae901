"""Nulls, empty and long texts, repeats, empty tables and clashing columns: every operator over documents."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from queuelens.llm import exact_dedup, licenses, ngram_join, packing, pii, quality, sentencepieces, toxicity
from queuelens.llm.queries import vocabulary

LONG = "word " * 60_000
TEXT = "The quick brown fox jumps over the lazy dog near 10.0.0.1 today.\nReleased under the MIT License."
ODD = [
    (1, TEXT), (2, None), (3, ""), (4, " \n\t "), (5, TEXT), (5, TEXT), (None, "mail a.b@c.example.org now"),
    (7, LONG), (8, "9" * 50_000), (9, "Grüße 世界 🌍"), (10, TEXT + " "),
]
SCHEMA = "doc_id bigint, text string"
#: Columns that operators make themselves, here with other contents.
CLASHING = ["score", "kept", "keep_id", "fp", "norm", "ids", "decoded", "class_id", "pii", "quality", "masked", "ed_fp", "toxicity_score", "task"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("theirs") for c in CLASHING}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 0, 0), (9, 1, None), (None, 1, 1), (77, 1, 1)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "exact_dedup": lambda d, _: exact_dedup.exact_duplicates(d),
    "ngram_join": lambda d, _: ngram_join.near_duplicates(d),
    "toxicity": lambda d, labels: toxicity.with_score(d, toxicity.train(d, labels)),
    "pii": lambda d, _: pii.with_spans(d, pii.train(d)),
    "quality": lambda d, _: quality.with_quality(d, quality.train(d)),
    "encode": lambda d, _: sentencepieces.decode(
        sentencepieces.encode(d, vocabulary("piece_bpe_32k.model")), vocabulary("piece_bpe_32k.model")
    ),
    "masked": lambda d, _: pii.masked(d, pii.train(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(odd, labels, name):
    got = OPERATORS[name](odd, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, labels, name):
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_exact_dedup(odd):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(odd).collect()}
    assert got == {
        (1, 10, 4, False), (5, 10, 4, False), (10, 10, 4, True), (2, 4, 3, False), (3, 4, 3, False), (4, 4, 3, True),
        (None, None, 1, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True),
    }
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {10, 4, None, 7, 8, 9}
    assert kept.filter("fp <> 'theirs'").count() == 0


def test_near_duplicates(odd):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(odd).collect()}
    assert got[1] == got[5] == got[10] == (1, 3)
    assert got[2] == (2, 0) and got[3] == (3, 0) and got[4] == (4, 0) and got[None] == (None, 0)
    assert got[7] == (7, 0) and got[9] == (9, 0)
    assert {r["doc_id"] for r in ngram_join.drop_near_duplicates(odd).collect()} == {1, 2, 3, 4, None, 7, 8, 9}


def test_packing(odd):
    got = packing.pack(odd, vocabulary("byte_bpe_50k.json")).collect()
    assert sorted({str(r["doc_id"]) for r in got}) == sorted({str(i) for i, _ in ODD})
    assert sum(r["length"] == 1 for r in got if r["doc_id"] in (2, 3)) == 2
    assert packing.pack(odd.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_masked_keeps_null_and_other_columns(odd):
    got = {r["doc_id"]: r for r in pii.masked(odd, pii.train(odd)).collect()}
    assert got[2]["text"] is None and got[3]["text"] == "" and got[1]["masked"] == "theirs"
    assert "<IP>" in got[1]["text"] and "10.0.0.1" not in got[1]["text"] and got[None]["text"] == "mail <EMAIL> now"


def test_licenses(odd):
    got = [(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(odd, licenses.train(odd)).collect()]
    assert sorted(got) == [(1, 1, "mit"), (5, 1, "mit"), (5, 1, "mit"), (10, 1, "mit")]
    assert licenses.scan(odd.limit(0), licenses.train(odd.limit(0))).count() == 0


def test_every_stage_takes_the_odd_table(spark, odd, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    assert docs.count() > 0
