"""Prefix tries against a plain walk over all beginnings."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from queuelens.llm import prefix_trie
from queuelens.llm.queries import OP12_SQL, op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        stem = c - int(c / 20) * 20
        sequence = tuple(own.get(c - stem, [])[:h] + turns[h:])
        for d in range(len(sequence) + 1):
            members.setdefault(sequence[:d], []).append((c, d == len(sequence)))
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    saved, leaves = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in sorted(members, key=len, reverse=True):
        if node:
            saved[node] += (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1]))
        leaves[node] += node not in children
        if node:
            saved[node[:-1]] += saved[node]
            leaves[node[:-1]] += leaves[node]
    least = {node: min(m)[0] for node, m in members.items()}
    out = []
    for node, inside in members.items():
        ends = ",".join(str(c) for c, last in sorted(inside) if last)
        parent = least[node[:-1]] if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((least[node], len(node), parent, len(inside), len(children.get(node, [])), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def trie(df):
    conv = F.col("conv_id")
    return prefix_trie.conversation_trie(df, conv - conv % 20, F.crc32(conv.cast("string")) % 4, 3)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def made(seed):
    """Conversations with common first turns, copies, one very long one, ties, nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-25, 130), 5000, 10**12]:
        for turn in range(rng.choice([1, 1, 2, 3, 5])):
            text = "hello there" if turn == 0 and rng.random() < 0.6 else f"word {rng.randint(0, 3)} \x0b x y"
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", None, "assistant"]), rng.choice([text, text, None, ""])))
        if rng.random() < 0.2:
            rows.append(rows[-1])
    rows += [(200 + k, 0, "user", "copy") for k in range(300)]
    rows += [(7, k, "user", f"turn {k % 11}") for k in range(2000)]
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns, bits", [(200_000, 12), (20, 3), (1, 12)])
def test_against_plain_walk(spark, monkeypatch, turns, bits):
    """One shard; shards cut at several depths; a shard for every sequence, digests over several stretches of ids."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "RANGE_BITS", bits)
    rows = made(turns)
    if turns == 1:
        rows = [r for r in rows if r[0] != 7]  # its beginnings would all be cut
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(trie(df)) == plain(rows)


def test_upper_nodes_too_many_to_send(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 20)
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 1)
    rows = made(3)
    assert rows_of(trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_query_and_its_sql(spark, sf_dir):
    got = rows_of(op12_prefix_trie(spark, sf_dir))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = con.sql(OP12_SQL)
    order = [found.columns.index(c) for c in COLUMNS]
    assert got == sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=str)
    assert got == plain([tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_edges(spark):
    df = spark.createDataFrame([(40, 0, "user", "a b")], SCHEMA)
    assert rows_of(trie(df.withColumns({c: F.lit(1) for c in ("seq", "number", "n", "key", "a")}))) == plain([(40, 0, "user", "a b")])
    assert rows_of(trie(df.limit(0))) == []
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0]  # their stem does not exist
    rows = [(c, 0, "user", "gone") for c in turnless]
    got = rows_of(trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) and [r[:6] for r in got] == [(turnless[0], 0, None, len(turnless), 0, 1)]
    long = [(20, k, "user", "word " * 30_000) for k in range(2)]
    assert rows_of(trie(spark.createDataFrame(long, SCHEMA))) == plain(long)


def test_double_array_holds_its_sequences():
    rng = random.Random(1)
    sequences = sorted({tuple(rng.randint(0, 40) for _ in range(rng.randint(0, 6))) for _ in range(3000)})
    packed = prefix_trie.DoubleArray(sequences)
    beginnings = {s[:d] for s in sequences for d in range(len(s) + 1)}
    slots = {}
    for beginning in beginnings:
        slot = 0
        for turn in beginning:
            slot = packed.step(slot, turn)
            assert slot > 0
        assert slots.setdefault(slot, beginning) == beginning  # one slot each
    assert len(packed.order) == len(beginnings) and sorted(packed.order) == sorted(slots)
    assert packed.step(0, 41) == -1
    assert len(packed.check) < 2 * len(beginnings)
