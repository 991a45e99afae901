"""Exact operators against brute force: de-duplication, similarity join, packing, piece encoding."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from queuelens.llm import exact_dedup, ngram_join, packing, sentencepieces
from queuelens.llm.components import components
from queuelens.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string"


def test_counting_quotient_filters_merge_without_loss():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 500, np.uint64) * np.uint64(2)
    filters, want = [], defaultdict(int)
    for _ in range(5):
        values, counts = np.unique(r.choice(pool, 3_000), return_counts=True)
        values, counts = values[values < 2**62], counts[values < 2**62]  # one range of two bits
        for v, c in zip(values.tolist(), counts.tolist()):
            want[v] += c
        filters.append(exact_dedup.CountingQuotientFilter.from_bytes(2, exact_dedup.CountingQuotientFilter.of(2, values, counts).to_bytes()))
    inside, counts = exact_dedup.CountingQuotientFilter.merged(filters)
    assert dict(zip(inside.tolist(), counts.tolist())) == want


@pytest.mark.parametrize("small", [True, False])
def test_exact_dedup_against_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "PER_RANGE", 20)
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab \n\t") for _ in range(r.randint(0, 6)))) for i in range(400)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), i))
    want = set()
    for t, members in groups.items():
        keep = min(members)[1]
        want |= {(i, keep, len(members), i == keep, hashlib.sha256(t.encode()).hexdigest()) for _, i in members}
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert {tuple(x) for x in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()} == want
    stays = {x["doc_id"] for x in exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert stays == {w[1] for w in want}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7), (50, 60), (60, 50)]
    got = {r["node"]: r["least"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def families(seed: int = 5) -> list[tuple[int, str]]:
    """Copies with ever more words changed, short texts, and a passage that all share."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3_000)]
    shared = " ".join(r.choices(words, k=30))
    rows = []
    for _ in range(60):
        base = r.choices(words, k=r.choice([3, 5, 12, 80, 200]))
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), (shared + " " if r.random() < 0.3 else "") + " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [512, 4])
def test_similarity_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SMALL", 6)
    rows = families()

    def grams(text):
        w = text.lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = {i: grams(t) for i, t in rows}
    links, label = defaultdict(int), {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in got} == {(i, label[i], links[i]) for i in sets}
    assert sum(links.values()) > 100


def at_least(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's lower bound on the number of sequences: long pieces cannot share one."""
    best = 0
    for alpha in range(capacity // 2 + 1):
        long = sum(n for k, n in counts.items() if k > capacity - alpha)
        half = {k: n for k, n in counts.items() if capacity / 2 < k <= capacity - alpha}
        free = sum((capacity - k) * n for k, n in half.items())
        rest = sum(k * n for k, n in counts.items() if alpha <= k <= capacity / 2)
        best = max(best, long + sum(half.values()) + max(0, -(-(rest - free) // capacity)))
    return best


def test_plan_fills_gaps_exactly_and_loses_nothing():
    r = np.random.default_rng(2)
    for capacity in (10, 64, 1024):
        counts = {int(k): int(r.integers(1, 60)) for k in r.choice(np.arange(1, capacity + 1), min(capacity, 200), replace=False)}
        plan = packing.best_plan(counts, capacity)
        used = defaultdict(int)
        for items, n in plan.patterns:
            assert sum(items) <= capacity
            for length in items:
                used[length] += n
        assert used == counts
        least = at_least(counts, capacity)
        assert plan.sequences <= 1.01 * least + 1
        for length, n in counts.items():
            sequence, offset = plan.place(np.full(n, length), np.arange(n))
            assert len(set(zip(sequence.tolist(), offset.tolist()))) == n
    assert packing.best_plan({}, 8).sequences == 0


def test_packing_against_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["", "Hello world", "naïve café\n\n  x", "<|endoftext|> it's 123", "hello <|endoftext|> world<|endoftext|><|endoftext", "<|endoftext|>", "é" * 3_000, "a " * 5_000, " " * 40_000]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(4), path).collect()
    whole = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == len(whole[r["doc_id"]]) and r["length"] == len(ids) <= 1024
        whole[r["doc_id"]] += ids
    for i, t in rows:
        assert whole[i] == [*library.encode(t, add_special_tokens=False).ids, 2]
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for filled in places.values():
        end = 0
        for offset, length in sorted(filled):
            assert offset == end
            end += length
        assert end <= 1024
    assert zlib.crc32(bytes(got[0]["ids"])) >= 0


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


def test_pieces_equal_the_library(library):
    merger = sentencepieces.Merger(vocabulary("piece_bpe_32k.model"))
    r = random.Random(4)
    signs = "  abethinor▁\n\t.,é🌍ﬁ世　<s>unk01⁇\x00\x01"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(3_000)]
    texts += ["a" * 30_000, " " * 30_000, "the" * 9_000, "The end. A new, one.\nNext: _x. ²."]
    for text, ids in zip(texts, map(unpacked, merger.encode(texts))):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), repr(text)
        assert merger.decode(ids) == library.decode(ids.tolist())
    for _ in range(2_000):  # ids that no text gives
        ids = [r.choice([r.randint(0, 260), r.randint(0, 31_999), 28_705]) for _ in range(r.randint(0, 8))]
        assert merger.decode(np.array(ids, np.uint32)) == library.decode(ids), ids


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 5)
    merger = sentencepieces.Merger(vocabulary("piece_bpe_32k.model"))
    texts = ["one two three", "four five six seven eight nine ten eleven", "one two", ""]
    for _ in range(2):
        assert [unpacked(x).tolist() for x in merger.encode(texts)] == library.encode(texts, add_bos=True, add_eos=True)


def test_near_copies_with_repeated_ids(spark):
    """Ids that stand for different texts: every row counts, and each text keeps its own links."""
    a, b = "one two three four five six seven eight nine ten " * 4, "red green blue black white grey pink brown gold lilac " * 4
    a, b = a + "alpha beta", b + "gamma delta"
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "nothing like it at all here"), (1, a)]
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = sorted(map(tuple, out.collect()))
    sets = [ngram_join.shingles(t, 5) for _, t in rows]
    near = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8
    links = [sum(near(i, j) for j in range(len(rows)) if i != j) for i in range(len(rows))]
    assert links == [2, 1, 2, 1, 0, 2]
    assert got == sorted((r[0], 4 if r[0] == 4 else 1, n) for r, n in zip(rows, links))


@pytest.mark.parametrize("block", [8, 512])
def test_crowded_buckets_lose_no_pair(spark, monkeypatch, block):
    """Sets that share a full path, in pairs that agree elsewhere too: no pivot and no common part tells of them."""
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows, runs = [], 2
    for i in range(120):
        pair = i // 2 if i < 80 else 1_000  # and one class of forty
        rows.append((i, [1, 2, 3, 4] + [10_000 + i] + [pair * 10 + k for k in range(3)]))
    reps = spark.createDataFrame(rows, "rep bigint, sketch array<int>")
    links = ngram_join._candidates(reps, runs, 0.6)
    got = {r["node"]: r["least"] for r in components(links).collect()}
    assert got == {i: i // 2 * 2 if i < 80 else 80 for i in range(120)}


def test_sizes_of_pieces_are_bits():
    merger = sentencepieces.Merger(vocabulary("piece_bpe_32k.model"))
    text = f"{sentencepieces.BLANK}the Übergang of straße\n12,000 \0 的是"
    got = merger._choices(text)
    for at in range(len(text)):
        sizes = {k for k in range(2, len(text) - at + 1) if text[at : at + k] in merger.rank} | {1}
        assert got[at] == sum(1 << k for k in sizes)
