"""IPv4 ranges: validity, and overlaps with a table of ranges, by a binned interval join.

A range is two whole numbers. Its size class is the least power of two it fits into, and at that class it touches at
most two bins. Of two ranges that overlap, the smaller one touches a bin of the larger one's class as
well; so it is enough to look each range up in its own and all larger classes, at two bins each. Nothing is compared
that shares no bin, and a huge range is two rows, not all of its addresses.

Who wants numbers only need not make the pairs, whose count grows with both tables at once. "Begins at or before
this address and ends at or after that one" is asked of whole bins: the addresses up to one are at most 33
bins of different sizes, and within a bin a running count in the order of the ends answers.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.operators.ordered import Ordered
from queuelens.operators.rules import Rule
from queuelens.operators.skew import ROWS_PER_TASK
from queuelens.session import is_small, stored

#: Ranges of the table (a few numbers each) up to which they go to every task.
BROADCAST_ROWS = 100_000

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_BLOCK = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?:/(3[0-2]|[12]?[0-9]))?$"
RANGE = "low bigint, high bigint"


def address_range(text: Column) -> Column:
    """RANGE of an address (``a.b.c.d``) or block (``a.b.c.d/n``); NULL for any other text.

    Bits of a block beyond its prefix do not matter: ``10.1.2.3/8`` is all of ``10.0.0.0/8``.
    """
    parts = F.split(text, "[./]")
    number = F.aggregate(F.slice(parts, 1, 4), F.lit(0).cast("bigint"), lambda total, octet: total * 256 + octet.try_cast("bigint"))
    prefix = F.coalesce(F.get(parts, F.lit(4)).try_cast("int"), F.lit(32))
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - prefix)
    found = F.transform(F.array(F.struct(number.alias("number"), size.alias("size"))), lambda x: _block(x["number"], x["size"]))  # each worked out once
    return F.when(text.rlike(_BLOCK), F.get(found, F.lit(0)))


def _block(number: Column, size: Column) -> Column:
    low = number - F.pmod(number, size)
    return F.struct(low.alias("low"), (low + size - 1).alias("high"))


def valid_block(column: str) -> Rule:
    """Rule: the column is an address block in prefix notation."""
    return Rule(f"{column}_block", F.contains(F.col(column), F.lit("/")) & address_range(F.col(column)).isNotNull())


def _size_class(low: Column, high: Column) -> Column:
    """Least number of bits for so many addresses, 0 to 32."""
    return F.when(high > low, F.length(F.bin(high - low))).otherwise(0)


def _whole(df: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    return df.filter(F.col(low).between(0, 2**32 - 1) & F.col(high).between(F.col(low), F.lit(2**32 - 1)))


def overlaps(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row with every range it overlaps: columns of ``rows`` and ``ranges``, and ``contained`` (the row lies within).

    Both have ``low`` and ``high`` (inclusive, 0 to 2**32 - 1); those of ``ranges`` and its other columns come back with
    ``range_`` before their names. Rows without both numbers, or with low above high, overlap nothing. One
    result per pair, whatever bins it shares.
    """
    renamed = ranges.select(*[F.col(c).alias(f"range_{c}") for c in ranges.columns])

    def classed(df: DataFrame, low: str, high: str) -> DataFrame:
        return _whole(df, low, high).withColumn("_class", _size_class(F.col(low), F.col(high)))

    def bins(df: DataFrame, low: str, high: str, classes: Column) -> DataFrame:
        each = df.withColumn("_at", F.explode(classes))
        first, last = (F.expr(f"shiftright({c}, _at)") for c in (low, high))
        return each.withColumn("_bin", F.explode(F.array_distinct(F.array(first, last))))

    left, right = classed(rows, "low", "high"), classed(renamed, "range_low", "range_high")
    own, upwards, above = F.array("_class"), F.expr("sequence(_class, 32)"), F.expr("if(_class < 32, sequence(_class + 1, 32), array())")
    small = is_small(right, BROADCAST_ROWS)

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.drop("_class")
        return a.drop("_class").join(F.broadcast(b) if small else b, ["_at", "_bin"])

    # Ranges at least as large as the row, then smaller ones.
    pairs = met(bins(left, "low", "high", upwards), bins(right, "range_low", "range_high", own)).unionByName(
        met(bins(left, "low", "high", own), bins(right, "range_low", "range_high", above))
    )
    # A pair may share two bins; it counts at the first of them.
    low = F.greatest("low", "range_low")
    once = (F.col("_bin") == F.expr("shiftright(greatest(low, range_low), _at)")) & (low <= F.least("high", "range_high"))
    contained = (F.col("range_low") <= F.col("low")) & (F.col("high") <= F.col("range_high"))
    return pairs.filter(once).drop("_at", "_bin").withColumn("contained", contained)


def overlap_counts(rows: DataFrame, ranges: DataFrame, first: str, rows_per_task: int | None = ROWS_PER_TASK) -> DataFrame:
    """low, high, overlapping, containing, first: each distinct range of ``rows`` that overlaps any of ``ranges``.

    Told are how many it overlaps and how many it lies within, and the least value of column ``first`` of those
    it overlaps. Other columns are not read; which ranges count is as in ``overlaps``. No pairs are made: a range of
    either table is at most 33 rows, two times that for one of ``rows``.
    """
    asked = stored(_whole(rows).select("low", "high").distinct(), "asked-ranges")
    # A range overlaps those that begin up to its end and end from its beginning on, and lies within those the other way round.
    up_to, from_ = F.col("ask.up_to"), F.col("ask.from")
    asks = F.explode(
        F.array(
            F.struct(F.lit(False).alias("within"), F.col("high").alias("up_to"), F.col("low").alias("from")),
            F.struct(F.lit(True).alias("within"), F.col("low").alias("up_to"), F.col("high").alias("from")),
        )
    )
    # Addresses 0 to n - 1 are one bin per bit of n that is set, the last one before n there; its number is even.
    levels = F.sequence(F.lit(0), F.lit(32))
    question = (
        asked.withColumn("ask", asks)
        .select("low", "high", "ask", F.explode(F.filter(levels, lambda k: _shifted(up_to + 1, k) % 2 == 1)).alias("level"))
        .select(
            "level",
            (_shifted(up_to + 1, F.col("level")) - 1).alias("bin"),
            (-from_).alias("ends"),
            F.lit(1).alias("kind"),
            "low",
            "high",
            F.col("ask.within").alias("within"),
            F.lit(None).cast(ranges.schema[first].dataType).alias("first"),
        )
    )
    known = (
        _whole(ranges)
        .select("low", "high", F.col(first).alias("first"))
        .withColumn("level", F.explode(F.filter(levels, lambda k: _shifted(F.col("low"), k) % 2 == 0)))
        .select(
            "level",
            _shifted(F.col("low"), F.col("level")).alias("bin"),
            (-F.col("high")).alias("ends"),
            F.lit(0).alias("kind"),
            "low",
            "high",
            F.lit(False).alias("within"),
            "first",
        )
    )
    # From the last end down, ranges before questions of the same address.
    order = ["ends", "kind", "low", "high", "within"]
    told = (
        Ordered(stored(known.unionByName(question), "address-bins"), ["level", "bin"], order, rows_per_task)
        .running_sum("found", 1 - F.col("kind"))
        .running_min("least", F.col("first"))
        .frame()
        .filter("kind = 1 and found > 0")
    )
    return (
        told.groupBy("low", "high")
        .agg(
            F.sum(F.when(F.col("within"), 0).otherwise(F.col("found"))).alias("overlapping"),
            F.sum(F.when(F.col("within"), F.col("found")).otherwise(0)).alias("containing"),
            F.min(F.when(~F.col("within"), F.col("least"))).alias("first"),
        )
    )


def _shifted(number: Column, bits: Column) -> Column:
    return F.call_function("shiftright", number, bits)
