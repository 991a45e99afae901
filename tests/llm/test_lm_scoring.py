"""The backoff automaton against the plain formula."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from queuelens.llm import lm_scoring
from queuelens.llm.queries import op11_lm_scoring

SCHEMA = "doc_id long, text string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def plain(rows, training, order, prior=lm_scoring.PRIOR):
    """id -> n_tokens, n_known, N, base, score, of rows whose ids are distinct."""
    counts, n = Counter(), 0
    for key, text in rows:
        if training(key):
            sequence = ["<s>", *words(text)]
            n += len(sequence) - 1
            for k in range(1, order + 1):
                counts.update(tuple(sequence[i : i + k]) for i in range(len(sequence) - k + 1))
    v = len({g for g in counts if len(g) == 1} - {("<s>",)})
    found = {}
    for key, text in rows:
        sequence, base, total = ["<s>", *words(text)], 0.0, 0.0
        for i in range(1, len(sequence)):
            p = (counts[(sequence[i],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, min(order, i + 1) + 1):
                history = tuple(sequence[i - k + 1 : i])
                p = (counts[(*history, sequence[i])] + prior * p) / (counts[history] + prior)
            total += math.log10(p)
        found[key] = (len(sequence) - 1, sum(counts[(w,)] > 0 for w in sequence[1:]), n, base, total)
    return found


def held(df, rows, training, order):
    got, want = df.collect(), plain(rows, training, order)
    assert len(got) == len(rows)
    for row in got:
        n_tokens, n_known, n, base, total = want[row.doc_id]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (n_tokens, n_known, n)
        assert row.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert row.score == pytest.approx(total, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", 40)  # many blocks
    monkeypatch.setattr(lm_scoring, "KEYS_PER_BUCKET", 4)  # and buckets
    texts = ["A b c a B c", "a b", "c d A\x0bb\x1cc", "", None, "Ä ä b c", "x y z", "a " * 50 + "b", "a b c a b c"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    held(lm_scoring.score(docs, F.col("doc_id") % 3 != 0, order=order), rows, lambda key: key % 3 != 0, order)


def test_query_is_the_plain_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = op11_lm_scoring(spark, sf_dir)
    held(out, rows, lambda key: zlib.crc32(str(key).encode()) % 7 != 2, lm_scoring.ORDER)
    for row in out.collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 7 == 2)


def test_held_out_texts_gain_over_single_words(spark, sf_dir):
    """Per token, over all held-out texts of the larger table."""
    out = op11_lm_scoring(spark, sf_dir.replace("sf0.001", "sf0.01")).filter("held_out")
    base, score = out.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > 0.95 * base


def test_edges(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a c"), (2, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    out = lm_scoring.score(docs, F.col("doc_id") < 2)
    assert out.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == 4 and {r[3] for r in got} == {6}
    assert got[0] == got[1] and got[0][:3] == (1, 3, 3)
    assert {r[0]: r[1:3] for r in got} == {1: (3, 3), None: (3, 2), 2: (1, 1)}
    assert lm_scoring.score(docs.limit(0), F.lit(True)).count() == 0
    nothing = lm_scoring.score(docs, F.lit(None).cast("boolean")).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in nothing} == {(0, 0, 0.0, 0.0)}


def test_probabilities_sum_to_one(spark):
    """Over all words of the vocabulary, the end and one unknown word, after a known and an unknown history."""
    learnt = ["a b a c", "b b a", "c"]
    for history in ("a", "b", "q"):
        asked = [f"{history} {w}" for w in ("a", "b", "c", "unknown")] + [history]
        rows = list(enumerate(learnt + asked + ["q" + history]))
        out = lm_scoring.score(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") < 3)
        scores = {r.doc_id: r.score for r in out.collect()}
        whole = plain(rows, lambda key: key < 3, lm_scoring.ORDER)
        assert all(scores[k] == pytest.approx(whole[k][4]) for k in scores)
        # p(history, w) = p(history w, end) / p(end | w); the plain model gives the last factor.
        single = 0.0
        for k, word in enumerate(("a", "b", "c", "unknown", None)):
            pair = plain([*enumerate(learnt), (9, history), (10, f"{history} {word}")], lambda key: key < 3, lm_scoring.ORDER)
            single += 10 ** (pair[9][4] if word is None else pair[10][4] - end_after(learnt, word))
        assert single == pytest.approx(10 ** start(learnt, history))


def end_after(learnt, word):
    texts = [words(t) for t in learnt]
    flat = [w for t in texts for w in t]
    p = (flat.count(None) + 1) / (len(flat) + len(set(flat)) + 1)
    pairs = sum(t[i] == word and t[i + 1] is None for t in texts for i in range(len(t) - 1))
    return math.log10((pairs + lm_scoring.PRIOR * p) / (flat.count(word) + lm_scoring.PRIOR))


def start(learnt, word):
    texts = [words(t) for t in learnt]
    flat = [w for t in texts for w in t]
    p = (flat.count(word) + 1) / (len(flat) + len(set(flat)) + 1)
    return math.log10((sum(t[0] == word for t in texts) + lm_scoring.PRIOR * p) / (len(texts) + lm_scoring.PRIOR))
