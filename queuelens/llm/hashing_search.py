"""Nearest neighbours by inner product with multi-index hashing.

Vectors get 64-bit codes by a rotation learned on a bounded sample (principal axes,
then iterative quantisation). A code is split into eight substrings, each indexed by
its value. If two codes differ in at most r bits, some substring differs in at most
r / 8, so probing the values that close in each index finds every code within r; the
float vectors of those rank them.

Each query has its own radius: the least that takes in its best vectors of the sample.
All of those are indexed, so no query finds fewer than it asks for, and what is nearer than
they are is rarely further away in bits. A table no larger than the sample is searched exactly.

Every vector is indexed, in blocks of like codes. A block is known by the values each substring takes in it; a
query goes only to the blocks that can hold a code within its radius. Equal vectors are indexed
once, with as many of their ids as a result can hold.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.llm.common import least_places, stored

BITS, PARTS = 64, 8
#: Vectors the rotation is learned from, and that set the radius of each query, at most.
FIT_VECTORS = 20_000
#: Distinct vectors in one block of the index about, distinct queries put to it at once, blocks looked through at once.
INDEX_ROWS, QUERY_ROWS, BLOCKS = 16_384, 4_096, 4_096
#: Ranges of codes the blocks are cut by at most; beyond, each range is dealt into several blocks.
RANGES = 512
#: Queries compared with the sample at once.
_AIMED = 128

_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


@dataclass
class Codes:
    """Codes of items and queries; a further axis turns the largest inner product into the nearest point."""

    norm: float
    center: np.ndarray
    rotation: np.ndarray

    def of_items(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))
        return self._packed(np.column_stack((x, rest)))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        scaled = x * (self.norm / np.linalg.norm(x, axis=1, keepdims=True))
        return self._packed(np.column_stack((scaled, np.zeros(len(x)))))

    def _packed(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.center) @ self.rotation > 0, axis=1)


def learn(sample: np.ndarray, norm: float) -> Codes:
    """Rotation from sampled vectors."""
    items = np.column_stack((sample, np.sqrt(np.maximum(norm**2 - (sample**2).sum(1), 0))))
    center = items.mean(0)
    axes = np.linalg.eigh(np.cov((items - center).T, bias=True) if len(items) > 1 else np.eye(items.shape[1]))[1][:, ::-1]
    r, columns = np.random.default_rng(1), []
    while sum(c.shape[1] for c in columns) < BITS:
        turned = (items - center) @ axes
        turn = np.linalg.qr(r.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(30):
            left, _, right = np.linalg.svd(np.sign(turned @ turn).T @ turned)
            turn = (left @ right).T
        columns.append(axes @ turn)
    return Codes(norm, center, np.column_stack(columns)[:, :BITS])


def radii(asked: np.ndarray, own: np.ndarray, sample: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """For each query the bits by which the ``most`` best vectors of the sample differ from it at most."""
    most = min(most, len(sample))
    best = np.argpartition(-(asked @ sample.T), most - 1, axis=1)[:, :most]
    return np.bitwise_count(words[best] ^ own[:, None, :]).sum(2).max(1)


def _probe(radius: int, part: int) -> int:
    """How far substring ``part`` is probed. Were every substring further away, the codes were beyond the radius."""
    return radius // PARTS - (part > radius % PARTS)


class MultiIndex:
    """For each substring of the codes, the rows by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = [np.argsort(codes[:, p], kind="stable") for p in range(PARTS)]
        self.starts = [np.searchsorted(codes[rows, p], np.arange(257)) for p, rows in enumerate(self.rows)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is at most ``radius`` bits away."""
        hit = np.zeros(len(self.codes), bool)
        for p in range(PARTS):
            values = np.flatnonzero(_NEAR[code[p]] <= _probe(radius, p))
            if not len(values):
                continue
            first, size = self.starts[p][values], self.starts[p][values + 1] - self.starts[p][values]
            ends = np.cumsum(size)
            hit[self.rows[p][np.repeat(first - ends + size, size) + np.arange(ends[-1])]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


def may_hold(present: list[list[np.ndarray]], codes: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of query and block such that the block can hold a code within the radius.

    ``present`` has for each substring and block the values it takes there. The distance to the nearest of
    them spreads over the 256 values bit by bit; summed over the substrings it is a bound from below.
    """
    bound = np.zeros((len(codes), len(present[0])), np.int64)
    for p, blocks in enumerate(present):
        away = np.full((len(blocks), 256), BITS, np.int64)
        for row, values in enumerate(blocks):
            away[row, values] = 0
        for bit in range(8):
            away = np.minimum(away, away[:, np.arange(256) ^ (1 << bit)] + 1)
        bound += away[:, codes[:, p]].T
    return np.nonzero(bound <= radii[:, None])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """Codes kept as longs, as rows of eight bytes, the lowest first."""
    return column.to_numpy().astype("<i8").view(np.uint8).reshape(-1, PARTS)


def _longs(codes: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(codes).view("<i8").ravel(), pa.int64())


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, its own row left out.

    ``queries`` has the columns of ``vectors`` and holds some of its rows. Score is the inner
    product in double precision, ties go to the smaller id. Vectors that are null, zero,
    of another length than most, or hold a null, NaN or infinite component take no part, nor do
    rows with a null id; so an empty or unusable table gives no rows. Rows with a
    repeated id count as often as they occur. Other columns are not read. A query gets ``k`` rows
    wherever there are as many candidates.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        vector = F.transform(vector_col, lambda x: x.cast("double"))
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).filter("vec_id is not null")
        return df.filter(
            F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        )

    every = usable(vectors)
    lengths = every.groupBy(F.size("vector").alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("square")
    )
    most = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    if most is None:
        return spark.createDataFrame([], shape)
    every = every.filter(F.size("vector") == most["length"])
    asked = usable(queries).filter(F.size("vector") == most["length"])
    place = W.partitionBy("vector").orderBy("vec_id")
    distinct = stored(
        every.withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.element_at("ids", 1).alias("class"), "vector", "ids"),
        "search-vectors",
    )
    asked = stored(
        asked.join(distinct.select("vector", "class"), "vector").select(F.col("vec_id").alias("query_id"), "class"), "search-queries"
    )
    wanted = distinct.join(asked.select("class").distinct(), "class", "left_semi")
    wanted = wanted.select(F.col("class").alias("asking"), F.col("vector").alias("question"))
    places = distinct.select("class", "vector", F.xxhash64("class").alias("place"))
    sample = least_places(places, "place", FIT_VECTORS, "class").select("vector").collect()
    sample = np.array([row["vector"] for row in sample])
    learned = learn(sample, float(np.sqrt(most["square"])))
    shared = spark.sparkContext.broadcast((learned.norm, learned.center, learned.rotation))
    # Single precision: it only chooses a radius.
    aims = spark.sparkContext.broadcast((sample.astype(np.float32), learned.of_items(sample)))

    # Ends of equal shares of the sample's codes. A code that is several ends falls into the blocks between them.
    indexes = ceil(distinct.count() / INDEX_ROWS)
    ranges = min(indexes, RANGES)
    deals = ceil(indexes / ranges)
    ordered = np.sort(aims.value[1].view("<i8").ravel())
    ends = ordered[len(ordered) * np.arange(1, ranges) // ranges]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*shared.value)
        for batch in batches:
            words = codes.of_items(_matrix(batch["vector"])) if batch.num_rows else np.zeros((0, PARTS), np.uint8)
            longs, deal = np.ascontiguousarray(words).view("<i8").ravel(), batch["deal"].to_numpy()
            first, last = np.searchsorted(ends, longs, "left"), np.searchsorted(ends, longs, "right")
            block = (first + deal % (last - first + 1)) * deals + deal // 65_536 % deals
            columns = [batch["class"], batch["vector"], pa.array(longs, pa.int64()), pa.array(block, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["class", "vector", "code", "block"])

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, _AIMED):
                batch = whole.slice(start, _AIMED)
                asked = _matrix(batch["question"])
                own = codes.of_queries(asked)
                far = radii(asked.astype(np.float32), own, *aims.value, k + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch["asking"], batch["question"], _longs(own), pa.array(far, pa.int32())], ["asking", "question", "code", "radius"]
                )

    deal = F.pmod(F.xxhash64("class", F.lit(2)), F.lit(2**40)).alias("deal")
    shape = "class bigint, vector array<double>, code bigint, block bigint"
    items = stored(distinct.select("class", "vector", deal).mapInArrow(coded, shape), "search-index")
    wanted = stored(
        wanted.mapInArrow(aimed, "asking bigint, question array<double>, code bigint, radius int"), "search-questions"
    )
    values = [F.collect_set(F.shiftrightunsigned("code", 8 * p).bitwiseAND(255)).alias(f"part{p}") for p in range(PARTS)]
    rounds, groups = max(1, ceil(wanted.count() / QUERY_ROWS)), ceil(ranges * deals / BLOCKS)

    def meet(summaries: pa.Table, questions: pa.Table) -> pa.Table:
        asking, blocks = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if summaries.num_rows and questions.num_rows:
            present = [[np.array(v, np.int64) for v in summaries[f"part{p}"].to_pylist()] for p in range(PARTS)]
            rows, places = may_hold(present, _bytes(questions["code"]), questions["radius"].to_numpy())
            asking, blocks = questions["asking"].to_numpy()[rows], summaries["block"].to_numpy()[places]
        return pa.table([pa.array(asking, pa.int64()), pa.array(blocks, pa.int64())], ["asking", "block"])

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    summaries = items.groupBy("block").agg(*values).withColumn("many", F.floor(F.col("block") / BLOCKS)).select("*", each(rounds).alias("round"))
    turn = F.pmod(F.xxhash64("asking"), F.lit(rounds)).alias("to_round")
    met = stored(
        summaries.groupBy("many", "round")
        .cogroup(wanted.select("asking", "code", "radius", turn, each(groups).alias("to_many")).groupBy("to_many", "to_round"))
        .applyInArrow(meet, "asking bigint, block bigint"),
        "search-meetings",
    )

    def search(index: pa.Table, questions: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if index.num_rows and questions.num_rows:
            vectors, own = _matrix(index["vector"]), _matrix(questions["question"])
            table = MultiIndex(_bytes(index["code"]))
            names = index["class"].to_numpy()
            radius = questions["radius"].to_pylist()
            for name, vector, code, far in zip(questions["asking"].to_pylist(), own, _bytes(questions["code"]), radius):
                rows = table.within(code, far)
                scores = vectors[rows] @ vector
                best = np.lexsort((names[rows], -scores))[: k + 1]
                found += zip([name] * len(best), names[rows[best]].tolist(), scores[best].tolist())
        asking, classes, scores = zip(*found) if found else ((), (), ())
        return pa.table([pa.array(asking, pa.int64()), pa.array(classes, pa.int64()), pa.array(scores, pa.float64())], ["asking", "class", "score"])

    # A block meets its queries in as many rounds as they fill; only the k + 1 best of each leave the task.
    turns = met.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("rounds"))
    index = items.join(turns, "block").select("class", "vector", "code", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)).alias("round"))
    blocks = met.join(turns, "block").join(wanted, "asking")
    blocks = blocks.select("asking", "question", "code", "radius", F.col("block").alias("to_block"), F.pmod(F.xxhash64("asking", F.lit(1)), F.col("rounds")).alias("to_round"))
    found = (
        index.groupBy("block", "round")
        .cogroup(blocks.groupBy("to_block", "to_round"))
        .applyInArrow(search, "asking bigint, class bigint, score double")
    )
    best = W.partitionBy("asking").orderBy(F.desc("score"), "vec_id")
    per_class = (
        found.join(distinct.select("class", "ids"), "class")
        .select("asking", "score", F.explode("ids").alias("vec_id"))
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k + 1)
    )
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(per_class, asked["class"] == per_class["asking"])
        .filter("query_id != vec_id")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
