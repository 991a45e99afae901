"""Log records kept so that a query reads only what it asks for.

Folders are ``day=.../levelname=...``, so a query for a level and a stretch of time lists and opens only those;
inside, files are ordered by time, so row groups outside the stretch are skipped by their statistics.
"""

from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from queuelens.schemas import LOG_RECORD

#: Records in a file, about.
ROWS_PER_FILE = 2_000_000

FOLDERS = ["day", "levelname"]
STORED = StructType([*[f for f in LOG_RECORD if f.name != "levelname"], StructField("day", DateType()), LOG_RECORD["levelname"]])


def append_log(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Adds log records to the store at ``path``; columns that are no fields of a record are left out.

    Rows go to files by folder and time, so a busy day and level is written by many tasks and a quiet one by one. Records
    without a time lie in the folder of no day, those without a level in that of no level.
    """
    names = [f.name for f in LOG_RECORD]
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in LOG_RECORD if f.name not in df.columns]
    whole = df.select(*[c for c in df.columns if c in names], *missing).withColumn("day", F.to_date("asctime"))
    _written(whole.select(*STORED.names), path, "append", rows_per_file)


def _written(rows: DataFrame, path: str, mode: str, rows_per_file: int) -> None:
    files = max(1, ceil(rows.count() / rows_per_file))
    dealt = rows.repartitionByRange(files, *FOLDERS, "asctime").sortWithinPartitions(*FOLDERS, "asctime")
    dealt.write.mode(mode).partitionBy(*FOLDERS).parquet(path)


def read_log_store(
    spark: SparkSession, path: str, levels: list[str] | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Records of the ``levels`` (all) from ``start`` up to before ``end``, with the fields of LOG_RECORD.

    The bounds are turned into conditions on folders, too. An empty or missing store has no records.
    """
    try:
        rows = spark.read.schema(STORED).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STORED)
    if levels is not None:
        rows = rows.filter(F.col("levelname").isin(levels))
    if start is not None:
        rows = rows.filter((F.col("asctime") >= F.lit(start).cast("timestamp_ntz")) & (F.col("day") >= F.to_date(F.lit(start))))
    if end is not None:
        rows = rows.filter((F.col("asctime") < F.lit(end).cast("timestamp_ntz")) & (F.col("day") <= F.to_date(F.lit(end))))
    return rows.select(*LOG_RECORD.names)


def compacted_log(spark: SparkSession, path: str, into: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """The store at ``path`` with its many small files put together, as a new store at ``into``; the old one is not touched."""
    _written(spark.read.schema(STORED).parquet(path).select(*STORED.names), into, "errorifexists", rows_per_file)
