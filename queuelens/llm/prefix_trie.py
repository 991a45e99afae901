"""Prefix trie over conversations, in double arrays packed shard by shard.

A conversation is its sequence of turns. Sequences that begin alike go to one shard; where very many
begin alike, they are told apart by longer beginnings. A shard numbers its
turns densely, packs its trie into BASE and CHECK arrays and walks all sequences through
them. Nodes from the cut of a shard downwards belong to it alone and are done there. The
few above the cut are shared by several shards; their aggregates are merged globally.

Only hashes of turns (128 bits), their words and conversation ids travel; texts stay behind once turns are in order. A
conversation is one value in its task, as a text is.
"""

import hashlib
from collections import deque
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import fits_broadcast, stored
from queuelens.operators.ordered import Ordered
from queuelens.operators.skew import ROWS_PER_TASK, join_unique

#: Distinct turns of distinct sequences in a shard, about; sequences that begin alike are split above it.
SHARD_TURNS = 200_000
#: Beginnings that are split, and nodes above the cuts, up to which they go to every task.
BROADCAST_ROWS = 200_000
#: Conversation ids in a row on the way to a digest of the ids that end at a node: 2 to this power.
RANGE_BITS = 12

_FREE, _ROOT = -1, -2
_NODE = (
    "shared boolean, key binary, parent_key binary, ancestors array<binary>, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"
)
NOTHING = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie over distinct sequences of small numbers.

    ``base[s] + t`` is the slot of the child of slot ``s`` by turn ``t`` if ``check`` of it is ``s``. A
    slot without a node has a negative ``check``. ``order`` lists the slots of nodes level by level.
    """

    def __init__(self, sequences: list[tuple[int, ...]]):
        self.base, self.check, self.order = [0], [_ROOT], [0]
        self._free: list[int] = []
        waiting = deque([(0, 0, len(sequences), 0)])
        while waiting:
            slot, lo, hi, depth = waiting.popleft()
            i = lo
            if i < hi and len(sequences[i]) == depth:
                i += 1  # it ends here; sequences are distinct and sorted
            children = []
            while i < hi:
                turn, j = sequences[i][depth], i + 1
                while j < hi and sequences[j][depth] == turn:
                    j += 1
                children.append((turn, i, j))
                i = j
            if children:
                base = self.base[slot] = self._place([c[0] for c in children])
                for turn, i, j in children:
                    self.check[base + turn] = slot
                    self.order.append(base + turn)
                    waiting.append((base + turn, i, j, depth + 1))

    def _place(self, turns: list[int]) -> int:
        """A base at which all children fall on free slots."""
        low = turns[0]
        tried = []
        while self._free and len(tried) < 8:
            slot = self._free.pop()
            if self.check[slot] != _FREE:
                continue
            tried.append(slot)
            base = slot - low
            if all(base + t < len(self.check) and self.check[base + t] == _FREE for t in turns):
                self._free += tried[:-1]
                return base
        self._free += tried
        start = len(self.check)
        span = turns[-1] - low + 1
        self.base += [0] * span
        self.check += [_FREE] * span
        if span > len(turns):
            taken = {t - low for t in turns}
            self._free += [start + k for k in range(span) if k not in taken]
        return start - low

    def step(self, slot: int, turn: int) -> int:
        """The child of a node by a turn, or -1."""
        child = self.base[slot] + turn
        return child if 0 < child < len(self.check) and self.check[child] == slot else -1


def _numbered(a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> list[tuple[int, ...]]:
    """Sequences of dense numbers, level by level in order of sight, so that siblings lie close together."""
    by_value = np.lexsort((b, a))
    new = np.concatenate(([True], (np.diff(a[by_value]) != 0) | (np.diff(b[by_value]) != 0)))[: len(a)]
    rank = np.empty(len(a), np.int64)
    rank[by_value] = np.cumsum(new) - 1
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    raw = [tuple(rank[lo:hi].tolist()) for lo, hi in zip(starts, ends)]
    place = np.empty(len(raw), np.int64)
    place[sorted(range(len(raw)), key=raw.__getitem__)] = np.arange(len(raw))
    lengths = ends - starts
    depth = np.arange(len(a)) - np.repeat(starts, lengths)
    seen = rank[np.lexsort((np.repeat(place, lengths), depth))]
    _, first = np.unique(seen, return_index=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    return [tuple(number[rank[lo:hi]].tolist()) for lo, hi in zip(starts, ends)]


def _nodes(table: pa.Table) -> pa.Table:
    """All nodes of a shard; those above a cut with what this shard knows of them."""
    table = table.combine_chunks()

    def flat(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *[c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks]]).astype(kind)

    a, b, w = flat("a", np.int64), flat("b", np.int64), flat("w", np.int64)
    ends = np.cumsum(table.column("size").to_numpy()).astype(np.int64)
    sequences = _numbered(a, b, ends)
    conv, count, cut, digest = (table.column(c).to_pylist() for c in ("conv_id", "n", "cut", "ends"))
    by_number = sorted(range(len(sequences)), key=sequences.__getitem__)
    trie = DoubleArray([sequences[i] for i in by_number])

    size = len(trie.check)
    least: list = [None] * size
    n, words, shared, at = [0] * size, [0] * size, [False] * size, [0] * size
    ended: list = [None] * size
    for i, sequence in enumerate(sequences):
        slot, start = 0, int(ends[i]) - len(sequence)
        for depth in range(len(sequence) + 1):
            if depth:
                slot = trie.step(slot, sequence[depth - 1])
                at[slot] = start + depth - 1
            n[slot] += count[i]
            least[slot] = conv[i] if least[slot] is None else min(least[slot], conv[i])
            shared[slot] |= depth < cut[i]
        ended[slot] = digest[i]

    depth, children, leaves, saved = [0] * size, [0] * size, [0] * size, [0] * size
    path: list[tuple | None] = [None] * size  # keys of a shared node and those above it
    for slot in trie.order:
        if slot:
            parent = trie.check[slot]
            depth[slot] = depth[parent] + 1
            words[slot] = int(w[at[slot]])
        if shared[slot]:
            above = path[trie.check[slot]] if slot else ()
            own = a[at[slot]].tobytes() + b[at[slot]].tobytes() if slot else b""
            path[slot] = (*above, hashlib.blake2b((above[-1] if above else b"") + own, digest_size=16).digest())
    for slot in reversed(trie.order):
        if shared[slot]:
            continue
        parent = trie.check[slot]
        leaves[slot] += not children[slot]
        saved[slot] += (n[slot] - 1) * words[slot]
        children[parent] += 1
        leaves[parent] += leaves[slot]
        saved[parent] += saved[slot]

    order = trie.order
    parents = [trie.check[s] if s else None for s in order]

    def key(slot):
        return path[slot][-1] if slot is not None and shared[slot] else None

    return pa.table(
        {
            "shared": [shared[s] for s in order],
            "key": pa.array([key(s) for s in order], pa.binary()),
            "parent_key": pa.array([key(p) for p in parents], pa.binary()),
            "ancestors": pa.array([list(path[s][:-1]) if shared[s] else None for s in order], pa.list_(pa.binary())),
            "conv_id": pa.array([least[s] for s in order], pa.int64()),
            "depth": pa.array([depth[s] for s in order], pa.int64()),
            "parent_conv_id": pa.array([least[p] if p is not None and not shared[p] else None for p in parents], pa.int64()),
            "n_convs": pa.array([n[s] for s in order], pa.int64()),
            "n_children": pa.array([children[s] for s in order], pa.int64()),
            "n_leaves": pa.array([leaves[s] for s in order], pa.int64()),
            "saved_tokens": pa.array([saved[s] for s in order], pa.int64()),
            "words": pa.array([words[s] for s in order], pa.int64()),
            "ends": pa.array([ended[s] for s in order], pa.string()),
        }
    )


def in_turn(conversations: DataFrame, rows_per_task: int | None = ROWS_PER_TASK) -> DataFrame:
    """conv_id, seq: the turns of every conversation in order, each as two hashes (a, b) and its words w."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    numbered = Ordered(rows, ["conv_id"], ["turn", "role", "text"], rows_per_task).row_number("number").frame()
    turn = F.struct(
        "number",
        F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit(1), "role", "text").alias("b"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"),
    )
    turns = numbered.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select("conv_id", F.expr("transform(turns, t -> struct(t.a as a, t.b as b, t.w as w))").alias("seq"))


def with_heads(own: DataFrame, stem: Column, taken: Column, most: int) -> DataFrame:
    """Every conversation with its first ``taken`` turns (``most`` at most) replaced by those of the conversation ``stem``.

    All of its turns if that has fewer, none if there is no such conversation. ``own`` as
    ``in_turn`` gives it, a stored table: it is read twice.
    """
    heads = own.select(F.col("conv_id").alias("_stem"), F.slice("seq", 1, most).alias("_head"))
    joined = own.withColumn("_taken", taken.cast("int")).withColumn("_of", stem).join(heads, F.col("_of") == F.col("_stem"), "left")
    head = F.expr("coalesce(slice(_head, 1, _taken), slice(seq, 1, 0))")
    rest = F.expr("slice(seq, _taken + 1, greatest(size(seq) - _taken, 0))")
    return joined.select("conv_id", F.concat(head, rest).alias("seq"))


def _digests(rows: DataFrame) -> DataFrame:
    """k1, k2, ends: SHA-256 over the ids of each sequence, ascending. Ids come as stretches of text in order and are hashed as they come."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"k1": pa.array([now[0]], pa.int64()), "k2": pa.array([now[1]], pa.int64()), "ends": [state.hexdigest()]})

        for batch in batches:
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if now == (k1, k2):
                    state.update(b",")
                else:
                    if now is not None:
                        yield row()
                    now, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
        if now is not None:
            yield row()

    stretches = rows.groupBy("k1", "k2", F.shiftright("conv_id", RANGE_BITS).alias("stretch")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    in_order = stretches.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "stretch").select("k1", "k2", "ids")
    return in_order.mapInArrow(digest, "k1 long, k2 long, ends string")


def _cut(sequences: DataFrame) -> DataFrame:
    """Adds ``cut``: how long a beginning tells the shard of a sequence; the same for all that begin alike so far."""
    out, level = sequences.withColumn("cut", F.lit(1)), 1
    while True:
        begin = F.xxhash64(F.slice("seq", 1, level))
        sizes = out.filter((F.col("cut") == level) & (F.size("seq") > level)).groupBy(begin.alias("_begin")).agg(F.sum(F.size("seq")).alias("turns"))
        large = stored(sizes.filter(F.col("turns") > SHARD_TURNS).select("_begin"), "beginnings")
        if large.isEmpty():
            return out
        few = F.broadcast(large) if fits_broadcast(large, BROADCAST_ROWS) else large
        marked = out.join(few, (F.col("cut") == level) & (begin == F.col("_begin")), "left")
        level *= 2
        out = marked.withColumn("cut", F.when(F.col("_begin").isNotNull(), level).otherwise(F.col("cut"))).drop("_begin")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The trie over ``sequences`` (conv_id, seq): one row per distinct beginning, the empty one included.

    conv_id (least member), depth, parent_conv_id (least member of the parent; null for the root), n_convs (members),
    n_children, n_leaves (childless nodes below and itself), saved_tokens (summed below and itself: members but one,
    times words of the last turn), ends_sha256 (of the ids of members that end here, ascending, comma between).

    Conversation ids are distinct. No conversations, no rows: not even a root.
    """
    keyed = stored(
        sequences.select("conv_id", "seq", F.xxhash64("seq").alias("k1"), F.xxhash64(F.lit(2), "seq").alias("k2")), "conversations"
    )
    distinct = keyed.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("seq").alias("seq"))
    whole = stored(distinct.join(_digests(keyed.select("k1", "k2", "conv_id")), ["k1", "k2"]), "sequences")
    turns = whole.agg(F.coalesce(F.sum(F.size("seq") + 1), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64(F.expr("slice(seq, 1, cut)")), F.lit(max(1, ceil(turns / SHARD_TURNS))))
    dealt = _cut(whole).select(
        shard.alias("shard"), "conv_id", "n", "cut", "ends", F.size("seq").alias("size"), "seq.a", "seq.b", "seq.w"
    )
    rows = stored(dealt.groupBy("shard").applyInArrow(_nodes, _NODE), "nodes")

    upper = stored(
        rows.filter("shared")
        .groupBy("key")
        .agg(
            *[F.first(c).alias(c) for c in ("depth", "parent_key", "ancestors")],
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            *[F.max(c).alias(c) for c in ("words", "ends")],
        ),
        "upper-nodes",
    )
    inner = upper.filter(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("inner"))
    settled = upper.join(inner, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0))).withColumns(
        {
            "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("int"),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"),
        }
    )
    below = (
        settled.select(F.explode(F.concat(F.array("key"), "ancestors")).alias("key"), "n_leaves", "saved_tokens")
        .groupBy("key")
        .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    )
    merged = settled.drop("n_leaves", "saved_tokens").join(below, "key")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    known = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    hanging = rows.filter("not shared and parent_key is not null").drop("parent_conv_id").unionByName(
        merged.withColumn("shared", F.lit(True)).drop("inner")
    )
    if fits_broadcast(known, BROADCAST_ROWS):
        hung = hanging.join(F.broadcast(known), "parent_key", "left")
    else:
        hung = join_unique(hanging, known, ["parent_key"], "left")
    inside = rows.filter("not shared and parent_key is null")
    nodes = inside.select(columns).unionByName(hung.select(columns))
    return nodes.withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))).drop("ends")


def conversation_trie(conversations: DataFrame, stem: Column, taken: Column, most: int) -> DataFrame:
    """``prefix_trie`` of rebuilt conversations; ``stem``, ``taken`` and ``most`` as in ``with_heads``.

    Turns are in order of ``turn`` (null first), then role, then text; null role and text are empty, and repeated
    rows are turns of their own. Rows without a conversation id take no part. Texts of any length
    count whole; other columns are not looked at.
    """
    return prefix_trie(with_heads(stored(in_turn(conversations), "turns"), stem, taken, most))
