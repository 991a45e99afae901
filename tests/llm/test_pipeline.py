"""The pipeline against plain versions of its stages, and the registered SQL."""

import glob
import os
import re
from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from __spark_entry__ import queries
from queuelens.llm import exact_dedup, ngram_join, packing, pii, toxicity
from queuelens.llm.queries import ORACLES, QUERIES, vocabulary


def test_queries_are_registered():
    assert [f"op{n}" for n in range(1, 14)] == [name.split("_")[0] for name in QUERIES]
    assert set(QUERIES) | {"pipeline"} <= set(queries())


def test_exact_dedup_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/documents.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    got = QUERIES["op8_exact_dedup"](spark, sf_dir)
    answer = duck.sql(ORACLES["op8_exact_dedup"])
    assert Counter(map(tuple, got.select(*answer.columns).collect())) == Counter(answer.fetchall())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = {i: t for i, t in rows.items() if model.scores([t])[0] < 0.5}
    best: dict[str, tuple[int, int]] = {}
    for i, t in left.items():
        key = re.sub("[\x20\x09-\x0d]", "", t)
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(t), i))
    left = {i: left[i] for _, i in best.values()}
    sets = {i: set(ngram_join.shingles(t).tolist()) for i, t in left.items()}
    label = {i: i for i in left}
    for i in left:
        for j in left:
            if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    left = {i: t for i, t in left.items() if label[i] == i}
    kept = spark.createDataFrame(list(left.items()), "doc_id bigint, text string")
    tagger = pii.train(kept)
    tokens = packing.Tokens(vocabulary("byte_bpe_50k.json"))
    want = {}
    for i, t in left.items():
        (_, spans), = pii.all_spans(tagger, [t])
        want[i] = [*tokens.encode(pii._masked(t, spans)).tolist(), 2]
    got: dict[int, list[int]] = {}
    for r in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == want
    assert exact_dedup.drop_exact_duplicates(kept).count() == len(left)
