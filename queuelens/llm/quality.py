"""Text quality from weak labels.

Heuristic labellers vote on every document: good, bad, or nothing. Only the number of
documents with each combination of votes is needed to estimate how far each labeller
can be trusted: expectation-maximisation over at most ``3 ** len(LABELLERS)`` counts,
which stand for all documents. The posterior labels of a bounded sample then train a
linear scorer over hashed words and character shapes, which scores every text.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import chunks, least_places, per_process, whole_text
from queuelens.llm.ngram_join import _mixed

#: Documents the scorer is trained on at most.
FIT_DOCS = 4_000
#: Entries of hashed words and of hashed character shapes.
WORDS, SHAPES = 1 << 14, 1 << 12
#: Share of a text's weight that a single entry can have is below one; this brings scores to the scale of log-odds.
GAIN = 20.0

# Frequent words of the corpus' languages.
COMMON = frozenset(
    "the of and to in is that it for was on with as are be at by this from or an not have "
    "der die das und ist von zu mit den ein eine nicht auf im des sich auch "
    "le la les de des et un une est que qui en dans pour par sur pas au "
    "el los las y del se por con para una su no al lo".split()
)
GOOD, BAD, NOTHING = 2, 1, 0


def _between(value: float, bad: float, good: float) -> int:
    """Good beyond ``good``, bad beyond ``bad``; either may be the larger."""
    up = good > bad
    if (value >= good) if up else (value <= good):
        return GOOD
    return BAD if ((value <= bad) if up else (value >= bad)) else NOTHING


@dataclass
class Facts:
    text: str
    words: list[str]
    lines: list[str]


def _length(x: Facts) -> int:
    return _between(len(x.words), 8, 60)


def _word_length(x: Facts) -> int:
    mean = sum(map(len, x.words)) / max(1, len(x.words))
    return GOOD if 2.5 <= mean <= 9 else BAD if mean < 1.5 or mean > 12 else NOTHING


def _signs(x: Facts) -> int:
    odd = sum(map(x.text.count, "#%&*$|{}<>~^=\\"))
    return _between(odd / max(1, len(x.text)), 0.02, 0.002)


def _repeats(x: Facts) -> int:
    lines = [y for y in x.lines if y.strip()]
    return _between(len(set(lines)) / len(lines), 0.6, 0.95) if len(lines) > 2 else NOTHING


def _endings(x: Facts) -> int:
    lines = [y.rstrip() for y in x.lines if y.strip()]
    return _between(sum(y[-1] in ".!?:\"" for y in lines) / len(lines), 0.2, 0.6) if lines else BAD


def _common(x: Facts) -> int:
    return _between(sum(w.lower() in COMMON for w in x.words) / max(1, len(x.words)), 0.03, 0.1)


def _variety(x: Facts) -> int:
    return _between(len(set(x.words)) / max(1, len(x.words)), 0.12, 0.3) if len(x.words) > 20 else NOTHING


def _letters(x: Facts) -> int:
    return _between(sum(map(str.isalpha, x.text)) / max(1, len(x.text)), 0.6, 0.75)


LABELLERS = (_length, _word_length, _signs, _repeats, _endings, _common, _variety, _letters)
PATTERNS = 3 ** len(LABELLERS)


def votes(text: str) -> int:
    """The votes of all labellers on a text as one number with a digit of base 3 each."""
    facts = Facts(text, text.split(), text.split("\n"))
    number = 0
    for labeller in LABELLERS:
        number = 3 * number + labeller(facts)
    return number


def _digits(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, digit = divmod(pattern, 3)
        out.append(digit)
    return out[::-1]


@dataclass
class Trust:
    """Share of good documents, and per labeller and class (bad, good) how it votes."""

    good: float
    table: np.ndarray  # labeller, class, vote

    def posterior(self, digits: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes; abstentions say nothing."""
        odds = np.full(len(digits), np.log(self.good / (1 - self.good)))
        for k in range(digits.shape[1]):
            ratio = np.log(self.table[k, 1]) - np.log(self.table[k, 0])
            odds += np.where(digits[:, k] == NOTHING, 0.0, ratio[digits[:, k]])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def estimate(counts: dict[int, int], rounds: int = 100) -> Trust:
    """Expectation-maximisation from the counts of vote patterns, started from the majority of votes."""
    digits = np.array([_digits(p) for p in counts], int).reshape(-1, len(LABELLERS))
    n = np.array(list(counts.values()), float)
    share = (0.5 + (digits == GOOD).sum(1)) / (1 + (digits != NOTHING).sum(1))
    trust = Trust(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack((n * (1 - share), n * share))
        good = (weight[1].sum() + 1) / (n.sum() + 2)
        table = np.ones((len(LABELLERS), 2, 3))  # one document of each kind is assumed
        for k in range(len(LABELLERS)):
            for vote in (BAD, GOOD):
                table[k, :, vote] += weight[:, digits[:, k] == vote].sum(1)
        table[:, :, NOTHING] = 0
        table /= table.sum(2, keepdims=True)
        table[:, :, NOTHING] = 1
        trust = Trust(float(np.clip(good, 0.01, 0.99)), table)
        new = trust.posterior(digits)
        if len(new) == 0 or np.abs(new - share).max() < 1e-9:
            break
        share = new
    return trust


def _shape_table() -> np.ndarray:
    table = np.full(256, 15, np.uint8)
    for code in range(256):
        c = chr(code)
        table[code] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == "\n" else 5 if c.isspace() else 15
    for k, c in enumerate(".,|%#&*$", 6):
        table[ord(c)] = k
    return table


def entries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, and hashed runs of five character shapes (equal shapes in a row count once)."""
    codes = np.frombuffer(f"{text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    shape = per_process("quality-shapes", _shape_table)
    plain = np.frombuffer(f"{text} ".encode("utf-32-le", "replace"), np.uint32)
    shapes = np.where(plain < 256, shape[np.minimum(plain, 255)], 1).astype(np.int64)
    shapes = shapes[np.concatenate(([True], shapes[1:] != shapes[:-1]))]
    n = max(0, len(shapes) - 4)
    runs = np.zeros(n, np.int64)
    for k in range(5):
        runs = runs * 16 + shapes[k : k + n]
    runs = ((runs * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - 12)
    gaps = np.flatnonzero((codes == 32) | (codes == 10))
    starts = np.concatenate(([0], gaps[:-1] + 1))
    if len(codes) <= 1:
        return np.zeros(0, np.int64), runs
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    words = _mixed(np.add.reduceat(_mixed(codes + (place.astype(np.uint64) << np.uint64(32))), starts))
    return (words >> np.uint64(64 - 14)).astype(np.int64), runs


@dataclass
class Scorer:
    words: np.ndarray
    shapes: np.ndarray
    bias: float

    def odds(self, found: tuple[np.ndarray, np.ndarray]) -> float:
        words, shapes = found
        mean = (self.words[words].mean() if len(words) else 0.0) + (self.shapes[shapes].mean() if len(shapes) else 0.0)
        return self.bias + GAIN * float(mean)

    def score(self, text: str) -> float:
        return 1 / (1 + np.exp(-np.clip(self.odds(entries(text)), -30, 30)))


def fit_scorer(rows: list[tuple[tuple[np.ndarray, np.ndarray], float]], rounds: int = 6, rate: float = 0.1, seed: int = 8) -> Scorer:
    """Logistic regression on posterior labels, with a step per entry that shrinks as it is used."""
    scorer = Scorer(np.zeros(WORDS), np.zeros(SHAPES), 0.0)
    square = (np.full(WORDS, 1e-4), np.full(SHAPES, 1e-4))
    r = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in r.permutation(len(rows)):
            found, label = rows[i]
            g = label - 1 / (1 + np.exp(-np.clip(scorer.odds(found), -30, 30)))
            for table, total, hit in zip((scorer.words, scorer.shapes), square, found):
                if len(hit):
                    at, times = np.unique(hit, return_counts=True)
                    step = g * GAIN * times / len(hit)
                    total[at] += step**2
                    table[at] += rate * step / np.sqrt(total[at])
            scorer.bias += 0.02 * g
    return scorer


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(votes(t), *entries(t)) for t in (x.as_py() for x in batch.column(0))]
        # Entries as counts, so a row is no larger than the tables whatever the text.
        packed = [[b"".join(x.astype("<i4").tobytes() for x in np.unique(e, return_counts=True)) for e in f[1:]] for f in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), *(pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1))],
            ["pattern", "words", "shapes"],
        )


def _unpacked(data: bytes) -> np.ndarray:
    both = np.frombuffer(data, "<i4")
    return np.repeat(both[: len(both) // 2], both[len(both) // 2 :])


@dataclass
class Model:
    trust: Trust
    scorer: Scorer


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trust in the labellers from all documents, and a scorer from ``FIT_DOCS`` of them at most.

    The sampled documents are those with the least hash of id and text, the same in every run.
    """

    @F.arrow_udf("int")
    def pattern(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([votes(t.as_py()) for t in batch], pa.int32())

    texts = docs.select(F.col(id_col).alias("d_id"), whole_text(text_col).alias("d_text"))
    counted = texts.select(pattern("d_text").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    trust = estimate({row["pattern"]: row["n"] for row in sorted(counted)})  # at most PATTERNS rows
    sample = least_places(texts.select("d_text", F.xxhash64("d_id", "d_text").alias("place")), "place", FIT_DOCS, "d_text")
    rows = sample.select("d_text").mapInArrow(_sampled, "pattern int, words binary, shapes binary").collect()
    rows.sort(key=lambda row: (row["pattern"], bytes(row["words"]), bytes(row["shapes"])))
    labels = trust.posterior(np.array([_digits(row["pattern"]) for row in rows], int).reshape(-1, len(LABELLERS)))
    return Model(trust, fit_scorer([((_unpacked(r["words"]), _unpacked(r["shapes"])), float(y)) for r, y in zip(rows, labels)]))


def with_quality(docs: DataFrame, model: Model, text_col: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with column ``into``: struct of ``weak_label`` (posterior of the votes) and ``score``, both 0 to 1.

    Null text is empty; it has the votes and the score of an empty text. Repeated rows are
    scored alike. Other columns are kept; one already named ``into`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<weak_label:double,score:double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [(votes(t), shared.value.scorer.score(t)) for run in chunks(x.as_py() for x in batch) for t in run]
            digits = np.array([_digits(v) for v, _ in found], int).reshape(-1, len(LABELLERS))
            yield pa.StructArray.from_arrays(
                [pa.array(shared.value.trust.posterior(digits)), pa.array([float(s) for _, s in found], pa.float64())], ["weak_label", "score"]
            )

    return docs.withColumn(into, score(whole_text(text_col)))
