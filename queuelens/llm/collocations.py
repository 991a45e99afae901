"""Collocations by Toivonen's method: a sample proposes phrases, whole passes count them exactly.

Phrases of the sample that reach a lowered count are proposed, so that nearly all
frequent phrases are among them or on their negative border: phrases not proposed whose
parts all are. One pass over all texts counts both. A phrase of the border that is
frequent after all has longer phrases that nothing has counted yet: it is added, and
another pass counts what became countable, until nothing is added. As every part of a
frequent phrase is frequent, no frequent phrase is missed; the sample decides only how many
passes there are.

What is proposed goes to the tasks as bits at the places of hashes, of a bounded size. Two phrases
at one place, and a corpus with more phrases than bits, let more be counted than needed,
and never change a count.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.llm.common import stored, whole_text

#: Least count of a phrase, its most words, and the share of a phrase that makes its parts superfluous, in hundredths.
LEAST = 10
LONGEST = 3
COVERED = 50
#: Phrases reported for a language.
TOP = 2000
#: The sample: one text in so many, by hash; what occurs so often in it is proposed.
SAMPLE_OF = 4
PROPOSED = 2
#: Text a task keeps before it counts the language it has most of, in bytes.
HELD_BYTES = 6_000_000
#: Text whose phrases are added up in one group, in bytes, about.
BUCKET_BYTES = 8_000_000
#: Bits of the largest table of proposals: 2 to this power.
MOST_BITS = 27
#: Groups in which the phrases of a language are ranked first.
RANKED_APART = 64

UNKNOWN = "und"
_BREAK = 0  # local number of the end of a piece
_END = b"\xff"  # stands for it in bytes; no UTF-8 has it
_TO_PIECES = bytes(
    0xFF if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 0x09 else c + 0x20 if 0x41 <= c <= 0x5A else c for c in range(256)
)
_COUNTS = "lang string, phrase string, size int, n long"
_ALL = 2**64 - 1


class Proposals(NamedTuple):
    """Packed bits of proposed phrases of each size below the longest."""

    power: int
    bits: tuple[bytes, ...]

    def holds(self, size: int, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.power)
        table = np.frombuffer(self.bits[size - 1], np.uint8)
        return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _joined(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word, and that of its last word."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _phrase_hash(phrase: bytes, seed: int) -> int:
    """The same for one phrase, on plain numbers."""
    words = phrase.split(b" ")
    key = xxhash.xxh64_intdigest(words[0], seed)
    for word in words[1:]:
        x = (key * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(word, seed)) & _ALL
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
        key = x ^ (x >> 31)
    return key


def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def pieces(text: bytes) -> list[bytes]:
    """Words of a text in small letters, with ``_END`` between pieces."""
    return text.translate(_TO_PIECES).replace(_END, b" \xff ").split()  # blanks are the only white space left


class _Run:
    """Texts of one language that are counted together."""

    def __init__(self):
        self.numbers: defaultdict = defaultdict(None, {_END: _BREAK})
        self.numbers.default_factory = self.numbers.__len__
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words = pieces(text)
        run = np.zeros(len(words) + 1, np.int64)  # a break behind the text
        run[:-1] = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self.texts.append(run)
        self.size += len(text)

    def counts(self, lang: str, longest: int, power: int, new: Proposals | None, old: Proposals | None) -> Iterator[tuple]:
        """(bucket, size, phrases and counts) of what ``new`` lets count and ``old`` did not; without ``new`` of all phrases.

        Words, and under size 0 their number, are counted unless there is an ``old``. There are 2**``power`` buckets.
        """
        sequence = np.concatenate(self.texts)
        seed = _seed(lang)
        words = pa.array(list(self.numbers), pa.binary())
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.numbers), np.uint64, len(words))
        at = np.flatnonzero(sequence != _BREAK)  # starts of phrases of the size before
        hashed = hashes[sequence[at]]
        if old is None:
            yield 0, 0, _packed(pa.array([""]), np.array([len(at)]))
            yield from self._tallied(words, hashes, sequence, at, 1, power)
        reached = np.full(len(at), old is not None)  # by the passes before
        for size in range(2, longest + 1):
            if not len(at):
                return
            # The phrase at i goes on where the one at i + 1 is a phrase, too.
            follows = np.flatnonzero(np.diff(at) == 1)
            if new is not None:
                # Both parts are proposed; counted before if both had been.
                now = new.holds(size - 1, hashed)
                now = now[follows] & now[follows + 1]
                then = reached & old.holds(size - 1, hashed) if old is not None else reached
                then = then[follows] & then[follows + 1]
                follows, then = follows[now], then[now]
            else:
                then = np.zeros(len(follows), bool)
            longer = _joined(hashed[follows], hashes[sequence[at[follows] + size - 1]])
            starts = at[follows]
            yield from self._tallied(words, hashes, sequence, starts[~then], size, power)
            # A longer phrase has proposed parts, and those have proposed parts themselves.
            at, hashed, reached = starts, longer, then

    @staticmethod
    def _tallied(words: pa.Array, hashes: np.ndarray, sequence: np.ndarray, starts: np.ndarray, size: int, power: int) -> Iterator[tuple]:
        if not len(starts):
            return
        n = len(words)
        if size == 1:
            counts = np.bincount(sequence[starts], minlength=n)
            columns = [np.flatnonzero(counts)]
            counts = counts[columns[0]]
        elif size == 2:
            code, counts = np.unique(sequence[starts] * n + sequence[starts + 1], return_counts=True)
            columns = list(np.divmod(code, n))
        else:
            code = sequence[starts]
            for k in range(1, size):  # exact: numbers of the distinct beginnings times words
                if k > 1:
                    _, code = np.unique(code, return_inverse=True)
                code = code * n + sequence[starts + k]
            _, where, counts = np.unique(code, return_index=True, return_counts=True)
            columns = [sequence[starts[where] + k] for k in range(size)]
        key = hashes[columns[0]]
        for column in columns[1:]:
            key = _joined(key, hashes[column])
        bucket = (key >> np.uint64(64 - power)).astype(np.int64) if power else np.zeros(len(key), np.int64)
        order = np.argsort(bucket, kind="stable")
        columns, counts, bucket = [c[order] for c in columns], counts[order], bucket[order]
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for lo, hi in zip(edges, edges[1:]):
            parts = [words.take(pa.array(c[lo:hi])).cast(pa.string()) for c in columns]
            phrases = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " ")
            yield int(bucket[lo]), size, _packed(phrases, counts[lo:hi])


def _packed(phrases: pa.Array, counts: np.ndarray) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.record_batch({"phrase": phrases, "n": pa.array(counts, pa.int64())})
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _counted(docs: DataFrame, longest: int, least: int, power: int, new=None, old=None) -> DataFrame:
    """lang, phrase, size, n of what occurs ``least`` times in all texts; the number of words under size 0.

    Each task adds up its runs of texts; what they found meets in buckets by hash, packed.
    ``new`` and ``old`` are broadcasts of ``Proposals``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, then = (Proposals(*b.value) if b is not None else None for b in (new, old))
        runs: dict[str, _Run] = {}
        held = 0

        def counted(lang: str) -> Iterator[pa.RecordBatch]:
            rows = runs.pop(lang).counts(lang, longest, power, now, then)
            while part := list(islice(rows, 64)):
                buckets, sizes, packed = zip(*part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets, pa.int64()), pa.array([lang] * len(part)), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())],
                    ["bucket", "lang", "size", "packed"],
                )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = text.as_py()
                while held and held + len(body) > HELD_BYTES:
                    most = max(runs, key=lambda k: runs[k].size)
                    held -= runs[most].size
                    yield from counted(most)
                runs.setdefault(lang, _Run()).add(body)
                held += len(body)
        for lang in list(runs):
            yield from counted(lang)

    def add_up(table: pa.Table) -> pa.Table:
        of: dict[tuple[str, int], list[pa.Table]] = {}
        for lang, size, packed in zip(*(table.column(c).to_pylist() for c in ("lang", "size", "packed"))):
            of.setdefault((lang, size), []).append(pa.ipc.open_stream(packed).read_all())
        found = [pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "size": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})]
        for (lang, size), parts in of.items():
            sums = pa.concat_tables(parts).group_by("phrase").aggregate([("n", "sum")])
            if size:
                sums = sums.filter(pc.greater_equal(sums.column("n_sum"), least))
            k = len(sums)
            found.append(
                pa.table({"lang": pa.array([lang] * k, pa.string()), "phrase": sums.column("phrase"), "size": pa.array([size] * k, pa.int32()), "n": sums.column("n_sum")})
            )
        return pa.concat_tables(found)

    shape = "bucket long, lang string, size int, packed binary"
    return docs.mapInArrow(count, shape).groupBy("bucket").applyInArrow(add_up, _COUNTS)


def _with_bits(phrases: DataFrame, longest: int, power: int, before: Proposals | None = None) -> Proposals:
    """Bits of the phrases, joined with those there were before. Packed in the tasks; 2**power bits a size reach the driver."""
    part = min(power, 17)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            seeds = {lang: _seed(lang) for lang in batch.column(0).unique().to_pylist()}
            named = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            place = [_phrase_hash(phrase.encode(), seeds[lang]) >> (64 - power) for lang, phrase in named]
            place = np.array(place, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int32()), pa.array(place >> part), pa.array((place & ((1 << part) - 1)).astype(np.int32))], ["size", "slice", "place"]
            )

    def pack(table: pa.Table) -> pa.Table:
        marked = np.zeros(1 << part, np.uint8)
        marked[table.column("place").to_numpy()] = 1
        packed = np.packbits(marked, bitorder="little").tobytes()
        return pa.table({"size": table.column("size")[:1], "slice": table.column("slice")[:1], "packed": pa.array([packed], pa.binary())})

    found = (
        phrases.filter(F.col("size").between(1, longest - 1))
        .select("lang", "phrase", "size")
        .mapInArrow(places, "size int, slice long, place int")
        .distinct()
        .groupBy("size", "slice")
        .applyInArrow(pack, "size int, slice long, packed binary")
    )
    tables = [np.frombuffer(before.bits[k], np.uint8).copy() if before else np.zeros((1 << power) // 8, np.uint8) for k in range(longest - 1)]
    for size, number, packed in found.toLocalIterator():
        at = number * (1 << part) // 8
        tables[size - 1][at : at + len(packed)] |= np.frombuffer(packed, np.uint8)
    return Proposals(power, tuple(t.tobytes() for t in tables))


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, size, n: all phrases of up to ``longest`` words that occur ``least`` times, words too; a stored table.

    A row of size 0 with an empty phrase holds the number of all words of the language.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"), whole_text(f"`{text}`").cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, ceil(size / BUCKET_BYTES)).bit_length()
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_OF)) == 0)
    proposed = stored(_counted(sample, longest - 1, PROPOSED, buckets), "proposed")
    power = min(MOST_BITS, max(10, int(16 * proposed.count()).bit_length()))
    old, new = None, _with_bits(proposed, longest, power)
    found = []
    while True:
        sent = [None if p is None else context.broadcast(tuple(p)) for p in (new, old)]
        found.append(stored(_counted(rows, longest, least, buckets, *sent), "phrases"))
        for b in sent:
            if b is not None:
                b.destroy()
        old, new = new, _with_bits(found[-1], longest, power, new)
        if new == old:
            break
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    covered: int = COVERED,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two to ``longest`` words of every language.

    ``a`` is the count of the phrase, ``l`` and ``r`` those of its two parts at the cut that scores
    least, ``score`` the whole part of 1000000 a² / (l r), ``n`` the number of words of the language. A phrase
    within a longer one that has ``covered`` hundredths of its count is left out. Ties go to the greater
    count, then to the phrase that comes first in bytes.

    Null text is empty and null language is ``und``; a text of any length is read whole; every row
    counts, repeated ones too; an empty table has no phrases. Other columns are not looked at.
    """
    found = frequent_phrases(docs, lang, text, least, longest)
    parts = found.filter("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    words = found.filter("size = 0").select("lang", F.col("n").alias("words"))
    phrases = found.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    # Longer phrases around a phrase; sizes are few, so this is a small number of rows each.
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    )
    around = (
        phrases.filter("size > 2")
        .select("lang", F.explode(inner).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = phrases.join(around, ["lang", "phrase"], "left").filter(F.coalesce(F.expr(f"100 * longer < {covered} * a"), F.lit(True)))

    cuts = kept.select("lang", "phrase", "a", "size", "w", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.expr("array_join(slice(w, 1, k), ' ')").alias("left_part"),
        F.expr("array_join(slice(w, k + 1, size - k), ' ')").alias("right_part"),
    )
    left = parts.select("lang", F.col("part").alias("left_part"), F.col("times").alias("l"))
    right = parts.select("lang", F.col("part").alias("right_part"), F.col("times").alias("r"))
    score = F.expr("cast((cast(1000000 as decimal(38, 0)) * a * a) div (cast(l as decimal(38, 0)) * r) as bigint)")
    scored = (
        cuts.join(left, ["lang", "left_part"])
        .join(right, ["lang", "right_part"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language is ranked in parts first, so that no task sorts all of its phrases.
    apart = W.partitionBy("lang", "_part").orderBy(*best)
    few = (
        scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)))
        .withColumn("_rank", F.row_number().over(apart))
        .filter(F.col("_rank") <= top)
    )
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")
    ranked = few.withColumn("rank", rank).filter(F.col("rank") <= top).join(words, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
