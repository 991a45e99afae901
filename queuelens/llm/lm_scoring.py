"""Log-probabilities of whole texts under a word n-gram model held as a weighted backoff automaton.

The model: p(w) = (c(w) + 1) / (N + V + 1) for single words, and for longer n-grams the
interpolation p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), where h' is h without its first
word and m is ``PRIOR``. It sums to one over the vocabulary and one unknown word. Every
n-gram seen in training is a state; an arc reads a word, a failure arc leads from h to h'
and weighs m / (c(h) + m).

The counts grow with the corpus, so no task ever holds the whole automaton. Texts are dealt into
blocks of a bounded size. A block asks for the counts of the n-grams it holds, in which
all counts of training texts are summed on the way, and traverses the part of the automaton
that its texts can reach. n-grams travel as hashes: 64 bits for words, and for longer ones
48 bits beyond those that name their bucket, of which there are more for a larger corpus.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.llm.common import stored, whole_text

#: Longest n-grams counted.
ORDER = 2
#: Weight of the shorter history, as a number of tokens.
PRIOR = 400.0
#: Characters of texts in a block; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: n-grams merged in one group, about.
KEYS_PER_BUCKET = 1_000_000

#: Local numbers of the end of a text and of its beginning, which is a history only.
END, BEGIN = 0, 1
_EDGES = {END: 0x8C6A5D1B3F27E94D, BEGIN: 0x41D9B3E57A0F6C28}
_WORDS, _LONGER = 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all of their places."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _to_planes(numbers: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of whole numbers, byte by byte, so that leading zeros compress."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<u8").ravel()


class Grams(NamedTuple):
    """n-grams of a block, position by position.

    ``words`` and ``longer`` hold the keys asked for, ascending. ``word`` is the place of each
    local word among ``words``; ``at[n]`` that of the n-gram which ends at each position among
    ``longer``, or -1 where a text has not begun so long ago.
    """

    words: np.ndarray
    word: np.ndarray
    longer: np.ndarray
    at: dict[int, np.ndarray]


def _grams(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, order: int, bits: int) -> Grams:
    words, word = np.unique(hashes, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    place = np.arange(len(tokens)) - np.repeat(starts, lengths)
    read = hashes[tokens]
    before = np.concatenate((hashes[BEGIN : BEGIN + 1], read[:-1]))
    before[starts] = hashes[BEGIN]
    spare = np.uint64(max(0, 16 - bits))
    keys, valid = {}, {}
    for n in range(2, order + 1):
        key = _mixed(before * np.uint64(0x9E3779B97F4A7C15) + read)
        keys[n], valid[n] = key >> spare, place >= n - 2
        before = np.concatenate((key[:1], key[:-1]))
    found = [keys[n][valid[n]] for n in keys]
    longer, where = np.unique(np.concatenate(found), return_inverse=True) if found else (np.zeros(0, np.uint64), None)
    at, used = {}, 0
    for n in keys:
        at[n] = np.full(len(tokens), -1, np.int64)
        at[n][valid[n]] = where[used : used + int(valid[n].sum())]
        used += int(valid[n].sum())
    return Grams(words, word, longer, at)


def _asked(keys: np.ndarray, width: int, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets of ascending keys of ``width`` bits: number, and the places of its keys."""
    bucket = keys >> np.uint64(width - bits) if bits else np.zeros(len(keys), np.uint64)
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
        if hi > lo:
            yield int(bucket[lo]), slice(lo, hi)


def _widths(bits: int) -> dict[int, int]:
    """Bits of a key by kind."""
    return {_WORDS: 64, _LONGER: min(64, 48 + bits)}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    tokens = np.frombuffer(zstandard.decompress(row["tokens"]), np.int32)
    lengths = np.array(row["lengths"], np.int64)
    return tokens, lengths, np.frombuffer(row["words"], np.uint64), np.array(row["training"], bool)


def _blocks(docs: DataFrame, id_column: str, text: str, training: Column) -> DataFrame:
    """One row a block: ids, and the numbered words of its texts, an end behind each."""
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(docs.schema[id_column].dataType)),
            T.StructField("training", T.ArrayType(T.BooleanType())),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("tokens", T.BinaryType()),
            T.StructField("words", T.BinaryType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, flags, runs, size = [], [], [], 0
        local: defaultdict = defaultdict()
        kind = None

        def fresh() -> None:
            nonlocal local
            local = defaultdict(None, {b"": END, b" ": BEGIN})  # no word is empty or blank
            local.default_factory = local.__len__

        def done() -> pa.RecordBatch:
            nonlocal number, ids, flags, runs, size
            lengths = [len(r) for r in runs]
            tokens = np.concatenate(runs)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, local), np.uint64, len(local))
            for edge, value in _EDGES.items():
                hashes[edge] = value
            row = {
                "block": pa.array([number], pa.int64()),
                "ids": pa.array([ids], pa.list_(kind)),
                "training": pa.array([flags], pa.list_(pa.bool_())),
                "lengths": pa.array([lengths], pa.list_(pa.int32())),
                "tokens": pa.array([zstandard.compress(tokens.tobytes(), 1)], pa.binary()),
                "words": pa.array([hashes.tobytes()], pa.binary()),
                "n_tokens": pa.array([len(tokens)], pa.int64()),
                "train_tokens": pa.array([sum(n for n, t in zip(lengths, flags) if t)], pa.int64()),
            }
            number += 1
            ids, flags, runs, size = [], [], [], 0
            fresh()
            return pa.RecordBatch.from_pydict(row)

        fresh()
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, flag, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = body.as_py().lower().split()  # of bytes: ASCII letters and ASCII white space only
                if runs and size + len(body.as_py()) > BLOCK_CHARS:
                    yield done()
                run = np.zeros(len(words) + 1, np.int32)
                run[:-1] = np.fromiter(map(local.__getitem__, words), np.int32, len(words))
                ids.append(key)
                flags.append(flag)
                runs.append(run)
                size += len(body.as_py())
        if runs:
            yield done()

    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.coalesce(training, F.lit(False)).alias("training"),
        whole_text(f"`{text}`").cast("binary").alias("text"),
    )
    return stored(rows.mapInArrow(pack, schema), "lm-blocks")


def _questions(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """Keys each block asks for with its own counts over training texts; a row a block and bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, lengths, hashes, training = _unpacked(row)
                grams = _grams(tokens, lengths, hashes, order, bits)
                counted = np.repeat(training, lengths)
                of_words = np.bincount(grams.word[tokens[counted]], minlength=len(grams.words))
                of_words[grams.word[BEGIN]] = training.sum()
                of_longer = np.zeros(len(grams.longer), np.int64)
                for at in grams.at.values():
                    of_longer += np.bincount(at[counted & (at >= 0)], minlength=len(grams.longer))
                out: dict[str, list] = {name: [] for name in ("kind", "bucket", "block", "keys", "counts")}
                for kind, keys, counts in ((_WORDS, grams.words, of_words), (_LONGER, grams.longer, of_longer)):
                    width = _widths(bits)[kind]
                    for bucket, span in _asked(keys, width, bits):
                        rest = keys[span] & np.uint64((1 << (width - bits)) - 1)
                        out["kind"].append(kind)
                        out["bucket"].append(bucket)
                        out["block"].append(row["block"])
                        out["keys"].append(_to_planes(np.diff(rest, prepend=np.uint64(0)), 8))
                        out["counts"].append(_to_planes(counts[span], 6))
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    arrow = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    return blocks.select("block", "training", "lengths", "tokens", "words").mapInArrow(
        ask, "kind int, bucket long, block long, keys binary, counts binary"
    )


def _answers(questions: DataFrame) -> DataFrame:
    """Counts over all training texts, in the order in which each block asked; ``n_seen`` keys have one."""

    def add_up(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(_from_planes(k.as_py(), 8), dtype=np.uint64) for k in table.column("keys")]
        own = np.concatenate([_from_planes(c.as_py(), 6) for c in table.column("counts")]).astype(np.int64)
        keys, where = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.zeros(len(keys), np.int64)
        np.add.at(totals, where, own)
        ends = np.cumsum([len(p) for p in parts])
        replies = [_to_planes(totals[where[e - len(p) : e]], 6) for p, e in zip(parts, ends)]
        seen = [int((totals > 0).sum())] + [0] * (len(parts) - 1)
        return pa.table({name: table.column(name) for name in ("kind", "bucket", "block")} | {"counts": pa.array(replies, pa.binary()), "n_seen": pa.array(seen, pa.int64())})

    return questions.groupBy("kind", "bucket").applyInArrow(add_up, "kind int, bucket long, block long, counts binary, n_seen long")


class Automaton:
    """The part of the model that the texts of one block can reach.

    State 0 has no history; words and then longer n-grams follow in the order of ``Grams``.
    An n-gram of the highest order is an arc only and leads to the state of its last words.
    """

    def __init__(self, tokens, lengths, grams: Grams, of_words, of_longer, order: int, prior: float, n: int, v: int):
        self.width = len(grams.word)
        count = of_words[grams.word]  # by local word
        first = (count + 1) / (n + v + 1)
        first_state = np.where((count > 0) & (order > 1), 1 + np.arange(self.width), 0)
        n_states = 1 + self.width + len(grams.longer)
        self.start = int(first_state[BEGIN])
        fail, fail_weight = np.zeros(n_states, np.int64), np.zeros(n_states)
        fail_weight[1 : 1 + self.width] = np.log10(prior / (count + prior))
        weight, target = np.zeros(len(grams.longer)), np.zeros(len(grams.longer), np.int64)
        sources, reads, arcs = [], [], []
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        before = np.concatenate(([BEGIN], tokens[:-1])).astype(np.int64)
        before[starts] = BEGIN
        history_state, history_count = 1 + before, count[before]
        lower, state = first[tokens], first_state[tokens]
        for k in range(2, order + 1):
            at = grams.at[k]
            held = at >= 0
            mine = np.where(held, of_longer[at], 0)
            p = np.where(held, (mine + prior * lower) / (history_count + prior), lower)
            known = np.flatnonzero(mine > 0)
            arc, where = np.unique(at[known], return_index=True)
            where = known[where]
            own_state = 1 + self.width + at
            weight[arc] = np.log10(p[where])
            target[arc] = own_state[where] if k < order else state[where]
            fail[1 + self.width + arc] = state[where]
            fail_weight[1 + self.width + arc] = np.log10(prior / (mine[where] + prior))
            sources.append(history_state[where])
            reads.append(tokens[where])
            arcs.append(arc)
            state = np.where(mine > 0, own_state, state)
            lower = p
            history_state = np.concatenate(([0], own_state[:-1]))
            history_count = np.concatenate(([0], mine[:-1]))
        self.first, self.first_state = np.log10(first).tolist(), first_state.tolist()
        self.fail, self.fail_weight = fail.tolist(), fail_weight.tolist()
        self.weight, self.target = weight.tolist(), target.tolist()
        self.arcs: dict[int, int] = {}
        for source, word, arc in zip(sources, reads, arcs):
            self.arcs.update(zip((source * self.width + word).tolist(), arc.tolist()))

    def score(self, words: list[int]) -> float:
        """log10 of the probability of a text, read once from left to right."""
        arcs, width, weight, target = self.arcs.get, self.width, self.weight, self.target
        total, state = 0.0, self.start
        for word in words:
            while state:
                arc = arcs(state * width + word)
                if arc is not None:
                    total += weight[arc]
                    state = target[arc]
                    break
                total += self.fail_weight[state]
                state = self.fail[state]
            else:
                total += self.first[word]
                state = self.first_state[word]
        return total


def score(
    docs: DataFrame,
    training: Column,
    id_column: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    prior: float = PRIOR,
) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    ``training`` marks the rows that are learnt from (null: no). ``base_score`` is the score under single
    words alone, ``n_known`` counts tokens that training texts hold, ``train_tokens`` is N.

    Null text is empty, an empty text is its end alone. Repeated rows are scored, and learnt from,
    each by itself; a text of any length is read whole. An empty table, or one
    without training rows, is no error: then N is 0 and an unknown word certain. Other columns are not looked at.
    """
    blocks = _blocks(docs, id_column, text, training)
    n_tokens, n = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, n_tokens * order / KEYS_PER_BUCKET)))))
    answers = stored(_answers(_questions(blocks, order, bits)), "lm-counts")
    seen = answers.filter(F.col("kind") == _WORDS).agg(F.coalesce(F.sum("n_seen"), F.lit(0))).first()[0]
    v = max(0, seen - 1)  # without the beginning
    id_type = docs.schema[id_column].dataType

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            tokens, lengths, hashes, _ = _unpacked(row)
            grams = _grams(tokens, lengths, hashes, order, bits)
            replies = sorted(right.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
            counts = {
                kind: np.concatenate([np.zeros(0, np.uint64), *[_from_planes(r["counts"], 6) for r in replies if r["kind"] == kind]]).astype(np.int64)
                for kind in (_WORDS, _LONGER)
            }
            model = Automaton(tokens, lengths, grams, counts[_WORDS], counts[_LONGER], order, prior, n, v)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            known = np.add.reduceat(counts[_WORDS][grams.word][tokens] > 0, starts, dtype=np.int64)
            base = np.add.reduceat(np.array(model.first)[tokens], starts)
            scores = [model.score(tokens[lo:hi].tolist()) for lo, hi in zip(starts, ends)]
            out.append(
                pa.table(
                    {
                        id_column: pa.array(row["ids"], left.schema.field("ids").type.value_type),
                        "n_tokens": pa.array(lengths),
                        "n_known": pa.array(known),
                        "train_tokens": pa.array(list(repeat(n, len(lengths))), pa.int64()),
                        "base_score": pa.array(base),
                        "score": pa.array(scores, pa.float64()),
                    }
                )
            )
        return pa.concat_tables(out)

    schema = T.StructType(
        [
            T.StructField(id_column, id_type),
            *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
            *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")],
        ]
    )
    asked = blocks.select("block", "ids", "training", "lengths", "tokens", "words")
    return asked.groupBy("block").cogroup(answers.drop("n_seen").groupBy("block")).applyInArrow(read, schema)
