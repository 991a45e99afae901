"""Collocations against a plain count of every phrase."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from queuelens.llm import collocations
from queuelens.llm.queries import OP13_SQL, op13_collocations

SCHEMA = "doc_id long, lang string, text string"


def plain(rows, least=10, longest=3, top=2000, covered=50):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {g: a for g, a in counts.items() if a >= least}
    found = []
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        around = [
            b for (other, longer), b in frequent.items()
            if other == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
        ]
        if any(100 * b >= covered * a for b in around):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.append((lang, " ".join(words), a, left, right, n[lang], score))
    out = []
    for lang in {f[0] for f in found}:
        mine = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))
        out += [(lang, i + 1, *f[1:]) for i, f in enumerate(mine[:top])]
    return sorted(out)


TEXTS = [
    ("en", "New York is big. New York City! new york city, NEW YORK CITY"),
    ("en", "the the the the\tthe the; the\x0bthe"),
    (None, "new york city new york"),
    ("und", "New York\nCity"),
    ("", "a b a b a b"),
    ("en", None),
    (None, ""),
    ("de", "Äpfel und äpfel und Birnen x und"),
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, *t) for i, t in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("least, longest, top, covered", [(2, 3, 2000, 50), (3, 4, 5, 90), (1, 2, 3, 50), (10, 3, 2000, 50), (4, 5, 100, 101)])
def test_against_plain_counts(spark, texts, monkeypatch, least, longest, top, covered):
    monkeypatch.setattr(collocations, "HELD_BYTES", 60)
    got = collocations.collocations(texts, least=least, longest=longest, top=top, covered=covered)
    assert sorted(map(tuple, got.collect())) == plain(TEXTS * 3, least, longest, top, covered)


@pytest.mark.parametrize("sample_of, proposed, most_bits", [(10**9, 2, 27), (1, 10, 27), (2, 3, 27), (4, 2, 10)])
def test_no_sample_changes_the_result(spark, sf_dir, monkeypatch, sample_of, proposed, most_bits):
    """Nothing proposed, all proposed, much missed by the sample, and tables of bits that are nearly full."""
    monkeypatch.setattr(collocations, "SAMPLE_OF", sample_of)
    monkeypatch.setattr(collocations, "PROPOSED", proposed)
    monkeypatch.setattr(collocations, "MOST_BITS", most_bits)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = collocations.collocations(docs, least=5)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got.collect())) == plain(rows, least=5)


def test_query_and_its_sql(spark, sf_dir):
    got = sorted(map(tuple, op13_collocations(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rows = con.sql(OP13_SQL)
    order = [rows.columns.index(c) for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    assert got == sorted(tuple(r[k] for k in order) for r in rows.fetchall())
    assert got == plain([(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_edges(spark, texts):
    clashing = texts.withColumns({c: F.lit(1) for c in ("phrase", "n", "size", "score", "rank")})
    got = collocations.collocations(clashing, least=2)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(TEXTS * 3, least=2)
    assert collocations.collocations(texts.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "en", "left right " * 100_000)], SCHEMA)
    assert sorted(map(tuple, collocations.collocations(long).collect())) == plain([("en", "left right " * 100_000)])


def test_counts_beyond_64_bits(spark, monkeypatch):
    """The products are exact where they pass 64 bits."""
    rows = [("en", f"p{i}", 1, a) for i, a in enumerate((3_000_000_001, 2_999_999_999))]
    rows += [("en", "p0 p1", 2, 2_999_999_998), ("en", None, 0, 6_000_000_000)]
    found = spark.createDataFrame(rows, collocations._COUNTS)
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: found)
    row = collocations.collocations(found).first()
    assert row.score == 1000000 * 2_999_999_998**2 // (3_000_000_001 * 2_999_999_999)
