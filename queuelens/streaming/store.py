"""What micro-batches write, kept in few files for ever.

Each micro-batch has a folder of its own, so a replayed one replaces just that. Folders of committed
micro-batches are put together in tiers, as many at once as the fan: a store of n micro-batches is at most
about fan * log(n) folders. A manifest names the folders that count. It is replaced as a whole
by renaming, so a reader sees the old or the new state, and a crash before that leaves only a folder
nobody names. What a merge has replaced stays for a day for readers that have begun.
"""

import json
import time
import uuid
from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders put together at once.
FAN = 10
#: How long replaced folders stay for readers that have begun.
KEPT_S = 86_400
#: Rows in a merged file, about.
ROWS_PER_FILE = 2_000_000


class BatchStore:
    """Rows by micro-batch below ``path``; ``schema`` as DDL, without ``batch_id``.

    ``reduce`` may thin out the rows of a merge (columns of ``schema`` and ``batch_id`` in and out): rows that readers
    would pass over anyway, such as all but the latest of a key.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        reduce: Callable[[DataFrame], DataFrame] | None = None,
        fan: int = FAN,
        keep_s: float = KEPT_S,
    ):
        if fan < 2:
            raise ValueError("at least two folders are put together")
        self.spark, self.path, self.reduce, self.fan, self.keep_s = spark, path.rstrip("/"), reduce, fan, keep_s
        self.schema = f"{schema}, batch_id bigint"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batches/batch_id={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of micro-batches ``before`` one, with their ``batch_id``. A store nothing was written to is empty."""
        parts, batches = self._state()
        frames = []
        if parts:
            frames.append(self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p['folder']}" for p in parts]))
        if before is not None:
            batches = [b for b in batches if b < before]
        if batches:
            reader = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/batches")
            frames.append(reader.parquet(*[f"{self.path}/batches/batch_id={b}" for b in batches]))
        if not frames:
            return self.spark.createDataFrame([], self.schema)
        rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def folders(self) -> list[str]:
        """The folders that count at this moment."""
        parts, batches = self._state()
        return [p["folder"] for p in parts] + [f"batches/batch_id={b}" for b in batches]

    def compact(self, before: int) -> None:
        """Puts folders of micro-batches ``before`` one together where ``fan`` of a tier are there. Only committed ones may be meant.

        What has been replaced for ``keep_s`` is removed on that occasion.
        """
        parts, batches = self._state()
        ready = sorted(b for b in batches if b < before)
        covered, merged = self._covered(), False
        while True:
            full = next((t for t in sorted({p["tier"] for p in parts}) if sum(p["tier"] == t for p in parts) >= self.fan), None)
            if full is not None:
                taken = [p for p in parts if p["tier"] == full][: self.fan]
                folders, tier = [p["folder"] for p in taken], full + 1
            elif len(ready) >= self.fan:
                taken, tier = [], 1
                folders = [f"batches/batch_id={b}" for b in ready[: self.fan]]
                covered, ready = ready[self.fan - 1], ready[self.fan :]
            else:
                break
            parts = [*[p for p in parts if p not in taken], {"folder": self._merge(folders, tier), "tier": tier}]
            self._publish({"covered": covered, "parts": parts})
            merged = True
        if merged:
            self.vacuum(self.keep_s)

    def _merge(self, folders: list[str], tier: int) -> str:
        reader = self.spark.read.schema(self.schema)
        if tier == 1:
            reader = reader.option("basePath", f"{self.path}/batches")
        rows = reader.parquet(*[f"{self.path}/{f}" for f in folders])
        rows = self.reduce(rows) if self.reduce else rows
        into = f"merged/tier={tier}/{uuid.uuid4().hex}"
        rows.coalesce(max(1, ceil(rows.count() / ROWS_PER_FILE))).write.parquet(f"{self.path}/{into}")
        return into

    def vacuum(self, older_than_s: float) -> None:
        """Removes folders that have been replaced, and manifests before the current one, if they are older than that.

        It must be longer than any reader takes, and than a merge.
        """
        named, limit = set(self.folders()), (time.time() - older_than_s) * 1000
        covered, current = self._covered(), max(self._versions(), default=0)
        old = [f"batches/batch_id={b}" for b in self._written() if b <= covered]
        for tier in self._names("merged"):
            old += [f"merged/{tier}/{name}" for name in self._names(f"merged/{tier}")]
        old += [f"manifests/{v:012}" for v in self._versions() if v < current]
        for name in old:
            place = self._path(f"{self.path}/{name}")
            if name not in named and self._fs.getFileStatus(place).getModificationTime() < limit:
                self._fs.delete(place, True)

    def _names(self, folder: str) -> list[str]:
        place = self._path(f"{self.path}/{folder}")
        if not self._fs.exists(place):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(place)]

    def _written(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._names("batches") if n.startswith("batch_id="))

    def _versions(self) -> list[int]:
        return [int(n) for n in self._names("manifests") if n.isdigit()]

    def _manifest(self) -> dict:
        version = max(self._versions(), default=None)
        if version is None:
            return {"covered": -1, "parts": []}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version:012}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _covered(self) -> int:
        return self._manifest()["covered"]

    def _state(self) -> tuple[list[dict], list[int]]:
        manifest = self._manifest()
        return manifest["parts"], [b for b in self._written() if b > manifest["covered"]]

    def _publish(self, manifest: dict) -> None:
        """The next manifest, complete or not at all; whoever else has published meanwhile wins."""
        version = max(self._versions(), default=0) + 1
        draft = self._path(f"{self.path}/manifests/_draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        target = self._path(f"{self.path}/manifests/{version:012}")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer has published manifest {version} of {self.path}")
