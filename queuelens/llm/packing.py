"""Best-fit packing of documents into sequences of a fixed number of tokens, by exact complements.

Documents are tokenised once into a stored table of pieces. Only lengths matter
for a plan, so the plan is made from the number of pieces of each length (at
most ``capacity`` numbers, whatever the input). Pieces then find their place from
their running number among the pieces of their length.
"""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.llm.common import chunks, fits_broadcast, lean, per_process, stored

#: Rows of (task, length, first number) up to which they go to every task.
BROADCAST_ROWS = 500_000
#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Ids of a byte-level BPE file of the tokenizers library, without special tokens.

    The vocabulary is read from that file and run by tiktoken's merger, which gives the
    same ids several times faster. A text that its pattern engine refuses (such as a
    huge run of blanks) goes through the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        byte = byte_symbols()
        ranks = {bytes(byte[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in added}
        self.path, self.slow = path, None
        self.fast = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")  # added tokens stand for themselves
        except BaseException as error:  # the engine's panics are no Exceptions
            if isinstance(error, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` tokens start: whole pieces at the end, the shorter one first."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def _pieces(path: str, end_id: int, capacity: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("task", pa.int64()), ("number", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = per_process(("tokens", path), lambda: Tokens(path))
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for texts in chunks(x.as_py() for x in batch.column(1)):
                rows = []
                for text in texts:
                    ids = np.concatenate((tokens.encode(text).astype("<u4"), end))
                    starts = cuts(len(ids), capacity)
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                        rows.append((doc_ids[at], piece, a, b - a, ids[a:b].tobytes(), task, int(seen[b - a])))
                        seen[b - a] += 1
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return lean(run)


class Plan:
    """Which lengths share a sequence, and how often.

    From the longest length down, gaps are filled exactly: first by one length wherever
    that is available, then by two, then by three; an index of single lengths and of pair
    sums finds them, a triple is a single and a pair. What has no exact complement is
    placed best-fit, longest first. ``parts`` limits how many lengths fill a gap.
    """

    def __init__(self, counts: dict[int, int], capacity: int, parts: int = 3):
        self.capacity, self.parts = capacity, parts
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._exact()
        self._best_fit()
        self._spans()

    def _take(self, items: tuple[int, ...]) -> None:
        kinds, times = np.unique(items, return_counts=True)
        n = int((self.left[kinds] // times).min())
        self.left[kinds] -= n * times
        self.patterns.append((items, n))

    def _pair(self, total: int, held: np.ndarray) -> tuple[int, int] | None:
        """The available pair with this sum whose longer part is longest."""
        if total < 2:
            return None
        longer = np.arange(min(total - 1, self.capacity), (total - 1) // 2, -1)
        shorter = total - longer
        ok = (held[longer] > 0) & (held[shorter] > 0) & ((longer != shorter) | (held[longer] > 1))
        hit = ok.argmax() if len(ok) else 0
        return (int(longer[hit]), int(shorter[hit])) if len(ok) and ok[hit] else None

    def _complement(self, gap: int, held: np.ndarray, parts: int) -> tuple[int, ...] | None:
        """Exactly ``parts`` available lengths that fill the gap."""
        if parts == 0:
            return () if gap == 0 else None
        if parts == 1:
            return (gap,) if gap > 0 and held[gap] > 0 else None
        if parts == 2:
            return self._pair(gap, held)
        for longest in np.flatnonzero(held[: max(0, gap - 1)])[::-1]:
            if 3 * longest < gap:
                break
            held[longest] -= 1
            pair = self._pair(gap - int(longest), held)
            held[longest] += 1
            if pair:
                return (int(longest), *pair)
        return None

    def _exact(self) -> None:
        for parts in range(self.parts + 1):
            for length in range(self.capacity, 0, -1):
                while self.left[length]:
                    held = self.left.copy()
                    held[length] -= 1
                    rest = self._complement(self.capacity - length, held, parts)
                    if rest is None:
                        break
                    self._take((length, *rest))

    def _best_fit(self) -> None:
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap
        for length in range(self.capacity, 0, -1):
            n = int(self.left[length])
            while n:
                gap = min((g for g in open_ if g >= length), default=None)
                if gap is None:
                    each = self.capacity // length
                    if n >= each:
                        open_.setdefault(self.capacity - each * length, []).append(((length,) * each, n // each))
                        n %= each
                    else:
                        open_.setdefault(self.capacity - n * length, []).append(((length,) * n, 1))
                        n = 0
                    continue
                items, times = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                used = min(times, n)
                if times > used:
                    open_.setdefault(gap, []).append((items, times - used))
                open_.setdefault(gap - length, []).append(((*items, length), used))
                n -= used
            self.left[length] = 0
        self.patterns += [x for group in open_.values() for x in group]

    def _spans(self) -> None:
        """For each length, stretches of running numbers with the sequences they go to."""
        used = np.zeros(self.capacity + 1, np.int64)
        rows, sequence = [], 0
        for items, n in self.patterns:
            offset = 0
            for length, times in zip(*(x.tolist() for x in np.unique(items, return_counts=True))):
                rows.append(((length << 48) + int(used[length]), sequence, times, offset))
                used[length] += n * times
                offset += length * times
            sequence += n
        rows.sort()
        self.spans = np.array(rows, np.int64).reshape(-1, 4)
        self.sequences = sequence

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 48) + number
        start, sequence, times, offset = self.spans[np.searchsorted(self.spans[:, 0], key, "right") - 1].T
        at = key - start
        return sequence + at // times, offset + at % times * length


def best_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Of the plans whose gaps are filled by up to three, two or one lengths, or best-fit only, the one with fewest sequences."""
    return min((Plan(counts, capacity, parts) for parts in (3, 2, 1, 0)), key=lambda plan: plan.sequences)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: every piece and its place.

    ``ids`` holds the tokens as little-endian unsigned 32-bit numbers. Null text is
    empty; an empty document is its end token. Rows with equal or null ids are packed
    as they come, one document each. An empty table gives no rows. Other columns are
    not read.
    """
    # Stored, as plan and places must speak of the same pieces even when tasks run again.
    pieces = stored(
        docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(
            _pieces(tokenizer, end_id, capacity),
            "doc_id bigint, piece int, start bigint, length bigint, ids binary, task bigint, number bigint",
        ),
        "packing-pieces",
    )
    tally = stored(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "packing-tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    plan = best_plan(counts, capacity)
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    first = tally.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if fits_broadcast(tally, BROADCAST_ROWS):
        first = F.broadcast(first)

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        sequence, offset = plan.place(length.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    placed = pieces.join(first, ["task", "length"]).withColumn("place", place("length", F.col("first") + F.col("number")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "place.sequence_id", "place.offset")
