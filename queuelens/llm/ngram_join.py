"""Similarity join on word n-grams by chosen paths.

Every text is a set of hashed n-grams. In each run, sets are split again and again
by a token they share: the least of them under a hash function of the run and the
depth, so two sets of Jaccard similarity s stay together with probability s at each
split. Buckets that have become small are compared by brute force on sketches, and
so are the buckets left at full depth. Runs are repeated until a pair at the
threshold meets with the target probability. What the runs tie together is then
compared exactly, on whole texts.
"""

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import chunks, fits_broadcast, fresh, lean, stored, whole_text
from queuelens.llm.components import components
from queuelens.operators.skew import join_unique

#: Splits after which a bucket is compared whatever its size.
DEPTH = 4
#: Sets in a bucket that is not split further; larger ones at full depth are compared in parts of this size first.
SMALL = 64
#: A pair goes on to exact comparison if this share of its sketch agrees; 0.8 is 4 deviations away.
SLACK = 0.2
#: Texts, or sketches of a crowded bucket, compared with as many others in one task.
BLOCK = 512
#: Columns of the comparison held at once.
WIDTH = 4096
#: Narrow rows up to which a table goes to every task.
BROADCAST_ROWS = 500_000

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Distinct hashes of the text's word n-grams, sorted; a shorter text is one n-gram of all its words.

    Words are what white space separates, in lower case.
    """
    words = " ".join(text.lower().split())
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(f"{words} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(codes == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(codes)))).astype(np.uint64)
    word = _mixed(np.add.reduceat(_mixed(codes + (place << np.uint64(32))), starts))
    n = min(n, len(word))
    total = np.zeros(len(word) - n + 1, np.uint64)
    for k, factor in enumerate(_factors(n, 5)):
        total += word[k : len(word) - n + 1 + k] * factor
    return np.unique(_mixed(total))


def _sketches(n: int, width: int):
    factors = _factors(width, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in chunks(x.as_py() for x in batch.column(1)):
                sets = [shingles(t, n) for t in texts]
                sizes = np.array([len(s) for s in sets])
                least = np.zeros((len(sets), width), np.int32)
                if filled := [s for s in sets if len(s)]:
                    every = np.concatenate(filled)
                    full = np.flatnonzero(sizes)
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    for k, factor in enumerate(factors):
                        least[full, k] = np.minimum.reduceat((every * factor) >> np.uint64(32), starts).astype(np.uint32).view(np.int32)
                keys = list(map(set_key, sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(texts)),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, least.size + 1, width, dtype=np.int32), pa.array(least.ravel())),
                    ],
                    ["doc_id", "set_key", "sketch"],
                )
                at += len(texts)

    return lean(run)


def set_key(shingled: np.ndarray) -> bytes | None:
    """Digest of a set of n-grams; none for the empty set."""
    return blake2b(shingled.tobytes(), digest_size=16).digest() if len(shingled) else None


def _least_labels(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation the least row it is connected to."""
    n = len(linked)
    label = np.arange(n)
    while True:
        reach = np.where(linked, label, n).min(1, initial=n)
        new = np.minimum(label, reach)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _tied(least: float):
    """Spanning links of each bucket; rows come sorted by bucket."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, ids, sketches = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            reps = batch.column(2).to_numpy(zero_copy_only=False)
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(reps), -1)
            starts = np.flatnonzero(np.concatenate(([True], (buckets[1:] != buckets[:-1]).any(1))))
            for a, b in zip(starts, np.append(starts[1:], len(reps))):
                if key is not None and tuple(buckets[a]) != key:
                    yield np.concatenate(ids), np.concatenate(sketches)
                    ids, sketches = [], []
                key = tuple(buckets[a])
                ids.append(reps[a:b])
                sketches.append(flat[a:b])
        if ids:
            yield np.concatenate(ids), np.concatenate(sketches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for ids, sketches in groups(batches):
            if len(ids) < 2:
                continue
            order = np.argsort(ids, kind="stable")
            ids, sketches = ids[order], sketches[order]
            linked = np.stack([(sketches == s).mean(1) >= least for s in sketches])
            label = _least_labels(linked)
            tied = np.flatnonzero(label != np.arange(len(ids)))
            us += ids[tied].tolist()
            vs += ids[label[tied]].tolist()
            if len(us) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return lean(run)


def _candidates(reps: DataFrame, runs: int, least: float) -> DataFrame:
    """u, v: links that tie together, per bucket, whatever its sketches bring together."""
    rows = reps.select("rep", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "sketch").select(
        "rep", "run", F.slice("sketch", F.col("run") * DEPTH + 1, DEPTH).alias("tokens")
    )
    leaves = None
    for depth in range(1, DEPTH + 1):
        rows = rows.withColumn("path", F.xxhash64("run", F.slice("tokens", 1, depth)))
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high"))
        rows = stored(rows.join(sizes.filter("n > 1"), "path"), f"paths-{depth}")
        leaf = rows if depth == DEPTH else rows.filter(F.col("n") <= SMALL)
        leaf = leaf.select("path", "rep", "n", "low", "high")
        leaves = leaf if leaves is None else leaves.union(leaf)
        rows = rows.filter(F.col("n") > SMALL).select("rep", "run", "tokens", "path")
    # A bucket too large at full depth is dealt out; its two pivots go to every part.
    parts = F.ceil(F.col("n") / SMALL).cast("int")
    own = F.array(F.pmod(F.xxhash64("rep", "path"), parts).cast("int"))
    part = F.when(F.col("rep").isin(F.col("low"), F.col("high")), F.sequence(F.lit(0), parts - 1)).otherwise(own)
    sketches = reps.select("rep", "sketch")
    found = _links(leaves.select("path", "rep", F.explode(part).alias("part")), sketches, least)
    crowded = rows.select("path", "rep")
    if crowded.isEmpty():
        return found
    known = stored(components(found).select(F.col("node").alias("u"), F.col("least").alias("v")), "join-known")
    return known.union(_links(_untied(crowded, known), sketches, least))


def _links(members: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """u, v: spanning links within each part of each bucket (path, rep, part), all of its sketches compared."""
    return (
        members.join(sketches, "rep")
        .select("path", "part", "rep", "sketch")
        .repartition("path", "part")
        .sortWithinPartitions("path", "part", "rep")
        .mapInArrow(_tied(least), "u bigint, v bigint")
        .distinct()
    )


def _untied(crowded: DataFrame, known: DataFrame) -> DataFrame:
    """path, rep, part: every two sets of a bucket that ``known`` (u, v: a set and its class) does not tie meet in a part.

    What most of a bucket is tied to needs no comparison within. Those sets are dealt into blocks, the others
    into further blocks, and each of the latter meets all. So a bucket of near copies costs its size
    times the few that stand apart; only one whose sets are all apart costs the square of its size, over many tasks.
    """
    label = F.coalesce("v", "rep").alias("label")
    labelled = stored(crowded.join(known, crowded["rep"] == known["u"], "left").select("path", "rep", label), "crowded")
    sizes = labelled.groupBy("path", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = F.max(F.struct("size", "label")).alias("largest")
    buckets = sizes.groupBy("path").agg(F.sum("size").alias("n"), largest).filter("n > largest.size")
    buckets = stored(buckets.select("path", F.col("largest.label").alias("most"), "n", "largest.size"), "crowded-sizes")
    side = F.broadcast(buckets) if fits_broadcast(buckets, BROADCAST_ROWS) else buckets
    blocks = {"together": F.ceil(F.col("size") / BLOCK), "apart": F.ceil((F.col("n") - F.col("size")) / BLOCK)}
    tied, place = F.col("label") == F.col("most"), F.xxhash64("rep", "path")
    block = F.when(tied, F.pmod(place, "together")).otherwise(F.col("together") + F.pmod(place, "apart"))
    others = F.sequence(F.when(tied, F.col("together")).otherwise(F.lit(0).cast("long")), F.col("together") + F.col("apart") - 1)
    return (
        labelled.join(side, "path")
        .withColumns(blocks)
        .select("path", "rep", block.alias("block"), F.explode(others).alias("other"))
        .select("path", "rep", (F.shiftleft(F.least("block", "other"), 32) + F.greatest("block", "other")).alias("part"))
    )


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarity of all pairs, by products of blocks of shared columns."""
    sizes = np.array([len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(shared.sum()), WIDTH):
        a, b = np.searchsorted(column, (first, first + WIDTH))
        block = np.zeros((len(sets), WIDTH), np.float32)
        block[row[a:b], column[a:b] - first] = 1
        common += block @ block.T
    return common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1)


def _verified(n: int, threshold: float):
    schema = pa.schema([("rep", pa.int64()), ("label", pa.int64()), ("links", pa.int64()), ("parts", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        reps, copies, block, parts = (group.column(c).to_numpy() for c in ("rep", "copies", "block", "parts"))
        first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
        linked = jaccard([shingles(t.as_py() or "", n) for t in group.column("text")]) >= threshold - 1e-6
        np.fill_diagonal(linked, False)
        if first != second:  # only pairs across; each block meets itself elsewhere
            linked &= block[:, None] != block[None, :]
        label = reps[_least_labels(linked)]
        return pa.table([reps, label, linked @ copies, parts], schema=schema)

    return run


def near_duplicates(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, class_id, n_links: every row with its class and the number of rows it is similar to.

    Similar are two rows whose sets of word n-grams have a Jaccard similarity of at least
    ``threshold``; copies are. A class is what links connect, named by its least id. Texts
    without a word (also null texts) are alone. Rows with a null id take no part and come
    back with a null class. Each row of repeated ids counts. Other columns are not read.
    """
    runs = ceil(log(1 - recall) / log(1 - threshold**DEPTH))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = stored(
        named.mapInArrow(_sketches(n, runs * DEPTH), "doc_id bigint, set_key binary, sketch array<int>"), "join-sketches"
    )
    sets = (
        sketches.filter("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    )
    # A set is known by the least id that has it; where ids repeat, two sets may share that, and each gets a number of its own.
    repeats = _repeats(sketches)
    reps = stored(sets.withColumn("rep", F.monotonically_increasing_id() if repeats else F.col("low")), "join-sets")
    ties = components(_candidates(reps.select("rep", "sketch"), runs, threshold - SLACK)).select(
        F.col("node").alias("rep"), F.col("least").alias("tie")
    )
    ties = stored(ties, "join-ties")
    sizes = ties.groupBy("tie").agg(F.count(F.lit(1)).alias("size"))
    tied = stored(ties.join(sizes, "tie").join(reps.select("rep", "low", "set_key", "copies"), "rep"), "join-tied")
    side = F.broadcast(tied) if fits_broadcast(tied, BROADCAST_ROWS) else tied
    if repeats:
        # One text of each set; which set the text of a repeated id has must be asked again.
        own = named.join(side.select(F.col("low").alias("doc_id")).distinct(), "doc_id", "left_semi")
        texts = own.mapInArrow(_with_key(n), "key binary, text string").dropDuplicates(["key"])
        same = F.col("key") == F.col("set_key")
    else:
        texts, same = named, F.col("doc_id") == F.col("rep")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    blocks = (
        texts.join(side, same)
        .select("tie", "rep", "copies", "text", parts.cast("long").alias("parts"))
        .withColumn("block", F.pmod(F.xxhash64("rep"), "parts"))
        .select("*", other.alias("other"))
        .select("*", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
        .drop("other")
    )
    verified = stored(
        blocks.groupBy("tie", "first", "second").applyInArrow(
            _verified(n, threshold), "rep bigint, label bigint, links bigint, parts bigint"
        ),
        "join-verified",
    )
    found = verified.groupBy("rep").agg(F.min("label").alias("label"), F.sum("links").alias("links"))
    wide = verified.filter("parts > 1 and rep != label").select(F.col("rep").alias("u"), F.col("label").alias("v"))
    joined = components(wide).withColumnRenamed("node", "rep")  # only classes larger than a block need this
    found = found.join(joined, "rep", "left").select("rep", F.coalesce("least", "label").alias("label"), "links")
    if repeats:  # a class is named by the least id in it
        lows = found.join(reps.select("rep", "low"), "rep")
        least = lows.groupBy("label").agg(F.min("low").alias("least"))
        found = join_unique(lows, least, ["label"], "left").select("rep", F.col("least").alias("label"), "links")
    classes = reps.select("set_key", "rep", "low", "copies").join(found, "rep", "left")
    classes = classes.select(
        "set_key", F.coalesce("label", "low").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    return (
        sketches.select("doc_id", "set_key")
        .join(classes, "set_key", "left")
        .select(
            "doc_id",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("class_id"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        )
    )


def _with_key(n: int):
    """set_key and text of every row with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks(t.as_py() for t in batch.column(1)):
                keys = [set_key(shingles(t, n)) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["key", "text"])

    return lean(run)


def _repeats(sketches: DataFrame) -> bool:
    """Whether an id occurs more than once."""
    ids = sketches.select("doc_id").dropna()
    return ids.count() > ids.distinct().count()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each class the one with the least id."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings)
    name = fresh(docs, "nd_id")
    dropped = stored(found.filter(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct(), "join-dropped")
    side = F.broadcast(dropped) if fits_broadcast(dropped, BROADCAST_ROWS) else dropped
    return docs.join(side, docs[id_col] == side[name], "left_anti")
