"""Exact de-duplication: counting quotient filters route repeated fingerprints to byte verification.

Each partition builds counting quotient filters over the 64-bit fingerprints of
its texts, one per range of the fingerprint space. The filters of a range are
merged without loss by their sorted remainders. Fingerprints with a count of
one are settled; only texts whose fingerprint has a higher count are compared
byte by byte.
"""

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import fits_broadcast, fresh, stored, whole_text

#: White space that does not count: blank, tab, line feed, vertical tab, form feed, carriage return.
IGNORED = " \t\n\x0b\x0c\r"
#: Distinct fingerprints that one merged range holds on average.
PER_RANGE = 1 << 17
#: Fingerprints a task gathers before it writes its filters out.
PER_FILTER = 1 << 20
#: Repeated fingerprints (8 bytes each, or about 100 as classes) up to which they go to every task.
BROADCAST_ROWS = 200_000


class CountingQuotientFilter:
    """A lossless counting quotient filter over fingerprints that share their top ``range_bits``.

    The next ``q`` bits are the quotient, the rest the remainder. Kept are one bit per
    quotient (is there a run?), one bit per entry (does its run end here?), the
    remainders in order, one bit per entry (is the count above one?) and those counts.
    """

    def __init__(self, range_bits: int, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray, q: int):
        self.range_bits, self.q = range_bits, q
        self.quotients, self.remainders, self.counts = quotients, remainders, counts

    @classmethod
    def of(cls, range_bits: int, fingerprints: np.ndarray, counts: np.ndarray) -> "CountingQuotientFilter":
        """From distinct sorted fingerprints (unsigned) of one range and their counts."""
        q = max(3, ceil(log2(max(2, len(fingerprints)))))
        below = 64 - range_bits
        inside = fingerprints & np.uint64((1 << below) - 1)
        return cls(
            range_bits,
            (inside >> np.uint64(below - q)).astype(np.int64),
            inside & np.uint64((1 << (below - q)) - 1),
            counts.astype(np.uint32),
            q,
        )

    def to_bytes(self) -> bytes:
        n = len(self.remainders)
        occupied = np.zeros(1 << self.q, np.uint8)
        occupied[self.quotients] = 1
        run_ends = np.ones(n, np.uint8)
        run_ends[:-1] = self.quotients[1:] != self.quotients[:-1]
        many = self.counts > 1
        return b"".join(
            (
                np.array([self.q, n], np.uint32).tobytes(),
                np.packbits(occupied).tobytes(),
                np.packbits(run_ends).tobytes(),
                np.packbits(many).tobytes(),
                self.remainders.astype("<u8").tobytes(),
                self.counts[many].astype("<u4").tobytes(),
            )
        )

    @classmethod
    def from_bytes(cls, range_bits: int, data: bytes) -> "CountingQuotientFilter":
        q, n = (int(x) for x in np.frombuffer(data, np.uint32, 2))
        at = 8

        def bits(count: int) -> np.ndarray:
            nonlocal at
            size = (count + 7) // 8
            out = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count)
            at += size
            return out

        occupied, run_ends, many = bits(1 << q), bits(n), bits(n).astype(bool)
        run = np.concatenate(([0], np.cumsum(run_ends[:-1]))).astype(np.int64)
        remainders = np.frombuffer(data, "<u8", n, at)
        counts = np.ones(n, np.uint32)
        counts[many] = np.frombuffer(data, "<u4", int(many.sum()), at + 8 * n)
        return cls(range_bits, np.flatnonzero(occupied)[run], remainders, counts, q)

    def inside(self) -> np.ndarray:
        """Quotient and remainder of every entry as one number, ascending."""
        return (self.quotients.astype(np.uint64) << np.uint64(64 - self.range_bits - self.q)) | self.remainders

    @staticmethod
    def merged(filters: list["CountingQuotientFilter"]) -> tuple[np.ndarray, np.ndarray]:
        """Entries of all filters, equal remainders of a quotient joined and their counts added."""
        inside = np.concatenate([f.inside() for f in filters])
        counts = np.concatenate([f.counts for f in filters]).astype(np.int64)
        order = np.argsort(inside, kind="stable")  # merges the sorted runs
        inside, counts = inside[order], counts[order]
        first = np.concatenate(([True], inside[1:] != inside[:-1])).nonzero()[0]
        return inside[first], np.add.reduceat(counts, first)


def _filters(range_bits: int):
    schema = pa.schema([("range", pa.int64()), ("filter", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            ranges = (values >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(values), np.int64)
            starts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
            ends = np.append(starts[1:], len(values))
            packed = [CountingQuotientFilter.of(range_bits, values[a:b], counts[a:b]).to_bytes() for a, b in zip(starts, ends)]
            return pa.RecordBatch.from_arrays([pa.array(ranges[starts]), pa.array(packed, pa.binary())], schema=schema)

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size >= PER_FILTER:
                yield flushed()
                held, size = [], 0
        if size:
            yield flushed()

    return build


def _repeated(range_bits: int):
    schema = pa.schema([("fp", pa.int64()), ("fp_count", pa.int64())])

    def merge(group: pa.Table) -> pa.Table:
        number = np.uint64(group.column("range")[0].as_py())
        filters = [CountingQuotientFilter.from_bytes(range_bits, x) for x in group.column("filter").to_pylist()]
        inside, counts = CountingQuotientFilter.merged(filters)
        inside, counts = inside[counts > 1], counts[counts > 1]
        if range_bits:
            inside = inside | (number << np.uint64(64 - range_bits))
        return pa.table([pa.array(inside.view(np.int64)), pa.array(counts)], schema=schema)

    return merge


def repeated_fingerprints(fingerprints: DataFrame, column: str = "fp") -> DataFrame:
    """fp, fp_count: fingerprints that occur more than once.

    The number of ranges follows the number of rows, so a merge task stays small. A
    fingerprint that holds a third of all rows is one entry of each partition's filter.
    """
    rows = fingerprints.count()
    range_bits = max(0, ceil(log2(max(1, rows / PER_RANGE))))
    filters = fingerprints.select(column).mapInArrow(_filters(range_bits), "range bigint, filter binary")
    return filters.groupBy("range").applyInArrow(_repeated(range_bits), "fp bigint, fp_count bigint")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = F.translate(whole_text(text_col), IGNORED, "")
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.length(whole_text(text_col)).cast("long").alias("n_chars"), norm.alias("norm"))
        .withColumns({"fp": F.xxhash64("norm"), "text_sha256": F.sha2("norm", 256)})
    )


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """Every row without its text; per class of equal texts with more than one row its keeper and size."""
    keyed = _keyed(docs, id_col, text_col)
    slim = stored(keyed.drop("norm"), "exact-dedup-keys")
    repeated = stored(repeated_fingerprints(slim), "exact-dedup-repeated").select("fp")
    small = fits_broadcast(repeated, BROADCAST_ROWS)
    if small:
        repeated = F.broadcast(repeated)
    # Texts of these fingerprints only are compared, as bytes; one per task and text is shuffled.
    verified = (
        keyed.select("fp", "norm")
        .join(repeated, "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("fp", F.sha2("norm", 256).alias("text_sha256"))
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("group_size"))
        .withColumn(
            "group_size",
            F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
                F.raise_error(F.lit("different texts with equal SHA-256")).cast("long")
            ),
        )
        .filter("group_size > 1")
    )
    first = F.struct((-F.col("n_chars")).alias("longest"), F.isnull("doc_id").alias("nameless"), "doc_id")
    keepers = slim.join(repeated, "fp", "left_semi").groupBy("fp", "text_sha256").agg(F.min(first)["doc_id"].alias("keep_id"))
    classes = keepers.join(verified, ["fp", "text_sha256"]).select("fp", "text_sha256", "keep_id", "group_size")
    return slim, stored(classes, "exact-dedup-classes"), small


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are once blanks, tabs and line ends are deleted. The
    longest original (in code points) stays, then the smallest id. Null text counts
    as empty, and empty texts are equal to each other. A null id is the last choice
    among equally long texts. Rows repeated with their id count in the group and
    share the fate of that id. Other columns are not read.
    """
    slim, classes, small = _classes(docs, id_col, text_col)
    found = slim.join(F.broadcast(classes) if small else classes, ["fp", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. See ``exact_duplicates``."""
    _, classes, small = _classes(docs, id_col, text_col)
    fp, sha, norm = (fresh(docs, x) for x in ("ed_fp", "ed_sha", "ed_norm"))
    keep, size = fresh(docs, "ed_keep"), fresh(docs, "ed_size")
    classes = classes.toDF(fp, sha, keep, size)
    keyed = docs.withColumn(norm, F.translate(whole_text(text_col), IGNORED, "")).withColumns(
        {fp: F.xxhash64(norm), sha: F.sha2(norm, 256)}
    )
    found = keyed.drop(norm).join(F.broadcast(classes) if small else classes, [fp, sha], "left")
    return found.filter(F.col(size).isNull() | F.col(id_col).eqNullSafe(F.col(keep))).select(docs.columns)
