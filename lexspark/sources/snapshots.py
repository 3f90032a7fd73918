"""Keyed tables that are changed by whole commits: what a reader sees is the state after some commit, never half of one.

A table's rows lie in BUCKETS by a hash of the key. A commit reads and writes the buckets that the keys of its batch fall
into, and no others, into a folder of its own; then a manifest, which names the folder of every bucket, takes the next
version's name, by a rename that fails if another writer has taken that name. A commit that is interrupted leaves a folder
that no manifest names. Manifests remember the batches of the last REMEMBERED commits, so that a batch that is committed
again changes nothing. Old states can be read until vacuum() removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.sources import sinks

BUCKETS, REMEMBERED = 64, 1000
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has committed since this commit read the table."""


class Table:
    """A table at a path, with a key column. Nulls are a key like others."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path, key
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._fs_path(path).getFileSystem(self._conf)
        self.buckets = self._manifest(self.version())["buckets"] if self.version() else buckets

    # ---- manifests

    def _place(self, version: int):
        return self._fs_path(f"{self.path}/_manifests/{version:010d}.json")

    def versions(self) -> list[int]:
        folder = self._fs_path(f"{self.path}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The last commit's number; 0 before the first."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._place(version))
        try:
            return json.loads(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode())
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        fresh = self._fs_path(f"{self.path}/_manifests/_{uuid.uuid4().hex}")
        stream = self._fs.create(fresh)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(fresh, self._place(version), options)
        except Exception as e:
            self._fs.delete(fresh, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} has been committed by another writer") from None
            raise

    # ---- reading and writing

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, each from the folder that the manifest names."""
        schema = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(manifest["schema"]).toDDL()
        wanted = [str(b) for b in (range(self.buckets) if buckets is None else buckets)]
        places = [f"{self.path}/{manifest['folders'][b]}/{_BUCKET}={b}" for b in wanted if b in manifest["folders"]]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table after a commit, the last one if none is named."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError(f"{self.path} has no commit")
        return self._rows(self._manifest(version))

    def _bucket_of(self, df: DataFrame):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def commit(self, batch: str, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replaces the rows of the touched buckets by combine(their rows, new), whose keys must be theirs; gives the version.

        A batch that is remembered changes nothing. The first commit takes the new rows' columns for the table's.
        """
        last = self.version()
        manifest = self._manifest(last) if last else {"folders": {}, "batches": [], "buckets": self.buckets, "schema": new.schema.json()}
        if batch in manifest["batches"]:
            return last
        touched = sorted(r[0] for r in new.select(self._bucket_of(new)).distinct().collect())  # as many as there are buckets, at most
        folder = f"data/{uuid.uuid4().hex}"
        rows = combine(self._rows(manifest, touched), new)
        rows.withColumn(_BUCKET, self._bucket_of(rows)).repartition(F.col(_BUCKET), F.xxhash64(self.key) % 8).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        written = {f.getPath().getName().removeprefix(f"{_BUCKET}=") for f in self._fs.listStatus(self._fs_path(f"{self.path}/{folder}")) if f.isDirectory()}
        if not written <= {str(b) for b in touched}:
            raise ValueError("combined rows have keys that the batch has not")
        folders = {b: f for b, f in manifest["folders"].items() if int(b) not in touched} | dict.fromkeys(sorted(written), folder)
        self._publish(last + 1, manifest | {"folders": folders, "batches": [*manifest["batches"], batch][-REMEMBERED:]})
        return last + 1

    def upsert(self, batch: str, new: DataFrame, changing: list[str]) -> int:
        """New values of the changing columns for known keys, and rows of new keys."""
        return self.commit(batch, new, lambda old, rows: sinks.upserted(old, rows, self.key, changing))

    def replace(self, batch: str, new: DataFrame) -> int:
        """All rows of the batch's keys go before its rows are added."""
        return self.commit(batch, new, lambda old, rows: sinks.replaced(old, rows.select(old.columns), self.key))

    def vacuum(self, keep: int = 1) -> int:
        """Removes manifests but for the last `keep`, and folders that none of these names; gives the number of folders.

        Not to be run beside a commit, whose folder is not yet named.
        """
        versions = self.versions()
        for version in versions[:-keep]:
            self._fs.delete(self._place(version), False)
        named = {f for v in versions[-keep:] for f in self._manifest(v)["folders"].values()}
        data = self._fs_path(f"{self.path}/data")
        gone = [f.getPath() for f in self._fs.listStatus(data) if f"data/{f.getPath().getName()}" not in named] if self._fs.exists(data) else []
        for place in gone:
            self._fs.delete(place, True)
        return len(gone)
