"""A stream of polls: every micro-batch holds a bounded number of messages and replays exactly.

Offsets are (file, row), so the bound is on messages, however many a file holds. Only
footers are read to plan; the rows of a poll are read by the task it goes to.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from queuelens.schemas import ENVELOPE

# Messages per poll by default, and the most a poll may ask for.
MESSAGES_PER_POLL = 1
MOST_PER_POLL = 10

FORMAT = "message_polls"
POLLED = StructType([*ENVELOPE.fields, StructField("poll", StringType()), StructField("place", LongType())])


class Polls(InputPartition):
    """Neighbouring polls of a file: the row at which the first begins, and the one behind the last. All but the last are full."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class PollReader(DataSourceStreamReader):
    """Plans polls over the files of a folder, oldest first, and reads them.

    A file that appears later must be newer than those already read; where an offset stands is the time and name of the
    file and its next row. ``consumers`` polls make a round, and up to ``rounds`` rounds a micro-batch, dealt to
    ``tasks`` tasks for each file. Planning takes no longer for more polls, only for more files.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.n = int(options.get("messagesperpoll", MESSAGES_PER_POLL))
        self.consumers = int(options.get("consumers", 1))
        self.tasks = int(options.get("tasks", self.consumers))
        self.rounds = int(options.get("rounds", 1))
        if not 1 <= self.n <= MOST_PER_POLL or min(self.consumers, self.tasks, self.rounds) < 1:
            raise ValueError(f"a poll takes 1 to {MOST_PER_POLL} messages, and there is at least one consumer and round")
        self.at: dict | None = None
        self._files: list[tuple[int, str]] = []
        self._rows: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"time": 0, "file": "", "row": 0}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.initialOffset()
        for *_, self.at in self._walk(self.at):
            pass
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Polls]:
        if self.at is None:  # after a restart the last micro-batch is planned first
            self.at = end
        rows = -(-self.consumers * self.rounds // self.tasks) * self.n
        return [
            Polls(path, at, min(at + rows, last)) for path, first, last, _ in self._walk(start, end) for at in range(first, last, rows)
        ]

    def _walk(self, start: dict, end: dict | None = None) -> Iterator[tuple[str, int, int, dict]]:
        """Neighbouring polls of each file behind ``start``: up to ``end``, or as many as a micro-batch takes."""
        left, row = self.consumers * self.rounds, start["row"]
        for time, path in self._behind(start):
            if (time, path) != (start["time"], start["file"]):
                row = 0
            last = self._length(path)
            if end is not None:
                if (time, path) > (end["time"], end["file"]):
                    return
                if (time, path) == (end["time"], end["file"]):
                    last = min(last, end["row"])
            else:
                last = min(last, row + left * self.n)
            if row < last:
                left -= -(-(last - row) // self.n)
                yield path, row, last, {"time": time, "file": path, "row": last}
            if end is None and not left:
                return

    def _behind(self, start: dict) -> list[tuple[int, str]]:
        """Files from that of the offset on; the folder is listed again only when the known ones are used up."""
        place = (start["time"], start["file"])

        def left() -> list[tuple[int, str]]:
            return [f for f in self._files if f >= place]

        found = left()
        if not any(f > place or start["row"] < self._length(f[1]) for f in found):
            system, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path or ":/" in self.path else (fs.LocalFileSystem(), self.path)
            infos = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
            hidden = ("_", ".")
            self._files = sorted(
                (i.mtime_ns, i.path) for i in infos if i.is_file and i.path.endswith(".parquet") and not i.base_name.startswith(hidden)
            )
            found = left()
        return found

    def _open(self, path: str) -> pq.ParquetFile:
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or ":/" in self.path else fs.LocalFileSystem()
        return pq.ParquetFile(system.open_input_file(path))

    def _length(self, path: str) -> int:
        if path not in self._rows:
            with self._open(path) as file:
                self._rows[path] = file.metadata.num_rows
        return self._rows[path]

    def read(self, polls: Polls) -> Iterator[pa.RecordBatch]:
        """Only the row groups that hold the rows, and of them only batches around them."""
        names, short = ENVELOPE.names, polls.path.rsplit("/", 1)[-1]
        with self._open(polls.path) as file:
            groups, at, first = [], 0, None
            for g in range(file.metadata.num_row_groups):
                rows = file.metadata.row_group(g).num_rows
                if at < polls.last and at + rows > polls.first:
                    groups.append(g)
                    first = at if first is None else first
                at += rows
            at = first or 0
            for batch in file.iter_batches(batch_size=4096, row_groups=groups, columns=names):
                lo, hi = max(polls.first - at, 0), min(polls.last - at, len(batch))
                if lo < hi:
                    numbers = np.arange(at + lo, at + hi)
                    place = (numbers - polls.first) % self.n
                    poll = pc.binary_join_element_wise(short, pa.array(numbers - place).cast(pa.string()), ":")
                    part = batch.slice(lo, hi - lo)
                    columns = [part.column(c) for c in names]
                    yield pa.RecordBatch.from_arrays([*columns, poll, pa.array(place)], POLLED.names)
                at += len(batch)
                if at >= polls.last:
                    return


class MessagePolls(DataSource):
    """Stored envelopes (parquet) as a stream of polls; options ``path``, ``messagesPerPoll``, ``consumers``, ``rounds``, ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return POLLED

    def streamReader(self, schema: StructType) -> PollReader:
        return PollReader({k.lower(): v for k, v in self.options.items()})


def stream_polls(spark: SparkSession, path: str, messages_per_poll: int = MESSAGES_PER_POLL, consumers: int = 1, rounds: int = 1) -> DataFrame:
    """Stored envelopes as a stream; a micro-batch is up to ``rounds`` polls of each consumer, each of at most so many messages.

    With a backlog more rounds make fewer micro-batches; what a task holds at once does not grow with them.

    Adds ``poll`` (file and first row) and ``place`` in it, so that a poll can be told and counted. Polls that find
    nothing are normal. ``path`` is a folder that pyarrow's file systems reach from the driver and the executors. Files
    are read in the order they were written; the stream goes on until it is stopped, ``processAllAvailable`` waits for its end.
    """
    spark.dataSource.register(MessagePolls)
    reader = spark.readStream.format(FORMAT).option("path", path)
    tasks = min(consumers, spark.sparkContext.defaultParallelism)
    reader = reader.option("messagesPerPoll", messages_per_poll).option("consumers", consumers)
    return reader.option("rounds", rounds).option("tasks", tasks).load()
