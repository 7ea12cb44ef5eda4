"""A table kept by key in versions: an upsert rewrites only the buckets that hold its keys.

Rows lie in the buckets of a hash of their key, as Parquet files that are never changed.  A version
is a small manifest: which folder holds which bucket.  A change reads the buckets it touches, writes
new folders for them and then publishes the next manifest by one rename that fails if the
version exists.  So readers see a whole version or the one before; what a failed job has
written is not part of any version; of two writers of the same version the later one
fails and may try again.  Buckets that a change doesn't touch keep their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ledgerloom.session import materialize, release, shuffles_cleaned

_BUCKET = "_bucket"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class VersionExists(RuntimeError):
    """Another writer has published the version first."""


def replace(keys: list[str]) -> Merge:
    """Rows of a batch take the place of old rows with their key."""
    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        return old.join(rows.select(*keys), keys, "left_anti").unionByName(rows)
    return merge


class SnapshotTable:
    """A table below ``path`` with the columns of ``schema``; ``keys`` say in which bucket a row lies and are never null.

    ``buckets`` is fixed when the table is made; choose it so that a bucket is a few hundred MB.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        found = self._manifest(self.version())
        if found:
            if found["keys"] != self.keys or StructType.fromJson(found["schema"]).simpleString() != schema.simpleString():
                raise ValueError(f"{path} holds a table with other keys or columns")
            self.buckets = found["n_buckets"]

    # --- files ---------------------------------------------------------------

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The last published version; 0 before the first."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict | None:
        if not version:
            return None
        stream = self._fs().open(self._path(f"manifests/{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, folders: dict[str, str], applied: dict[str, int]) -> int:
        """Write the manifest under a name of its own and give it the version's name in one step."""
        text = json.dumps({"version": version, "keys": self.keys, "n_buckets": self.buckets, "schema": json.loads(self.schema.json()), "folders": folders, "applied": applied})
        draft, final = self._path(f"manifests/{uuid.uuid4().hex}.draft"), self._path(f"manifests/{version:010d}.json")
        out = self._fs().create(draft)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(draft, final, options)
        except Exception as e:
            self._fs().delete(draft, False)
            if self._fs().exists(final):
                raise VersionExists(f"version {version} of {self.path} was published by another writer") from e
            raise
        return version

    # --- rows ----------------------------------------------------------------

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """Rows of a version (the last one), of all buckets or of some."""
        found = self._manifest(self.version() if version is None else version)
        folders = [f for b, f in (found["folders"] if found else {}).items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(set(folders))])

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Where each bucket of a version lies; empty buckets are left out."""
        found = self._manifest(self.version() if version is None else version)
        return {int(b): f for b, f in found["folders"].items()} if found else {}

    def applied(self, source: str) -> int:
        """The last batch of a source that is part of the table; -1 before the first."""
        found = self._manifest(self.version())
        return found["applied"].get(source, -1) if found else -1

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def upsert(self, rows: DataFrame, merge: Merge | None = None, source: str | None = None, batch: int = 0) -> int:
        """Publish the version after a change and give its number.

        ``merge(old, rows)`` gives the new rows of the touched buckets from their old ones; it must keep
        a row's key and old rows that the batch says nothing about.  Without it the batch has one row a key, which
        replaces the old one.  A ``batch`` of a ``source`` that is already part of the table changes nothing,
        so a stream that runs a batch again after a failure leaves the same table.
        """
        base = self.version()
        found = self._manifest(base) or {"folders": {}, "applied": {}}
        if source is not None and found["applied"].get(source, -1) >= batch:
            return base
        stored = materialize(self._bucketed(rows), "upsert")
        # At most one number for each bucket.
        touched = sorted(r[0] for r in stored.select(_BUCKET).distinct().collect())
        folders = dict(found["folders"])
        if touched:
            merged = (merge or replace(self.keys))(self.read(base, touched), stored.drop(_BUCKET))
            folders = {b: f for b, f in folders.items() if int(b) not in touched} | self._write(merged)
        release(stored)
        return self._publish(base + 1, folders, found["applied"] | ({source: batch} if source is not None else {}))

    def delete(self, keys: DataFrame) -> int:
        """Publish a version without the rows that have one of the keys."""
        return self.upsert(keys.select(*self.keys).distinct(), lambda old, gone: old.join(gone, self.keys, "left_anti"))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Folders of the buckets that have rows; a large bucket is dealt to several tasks, small ones share a task."""
        at = f"data/{uuid.uuid4().hex}"
        with shuffles_cleaned(self.spark):
            dealt = self._bucketed(rows.select(*self.schema.names)).hint("rebalance", _BUCKET)
            dealt.write.partitionBy(_BUCKET).parquet(f"{self.path}/{at}")
        names = (s.getPath().getName() for s in self._fs().listStatus(self._path(at)))
        return {n.split("=")[1]: f"{at}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}

    def expire(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` manifests, and the folders that none of these names; gives the deleted folders.

        What a writer that is still at work has written counts as unnamed, so let no change run meanwhile.
        """
        versions = self.versions()
        named = {f for v in versions[-keep:] for f in self._manifest(v)["folders"].values()}
        fs, gone = self._fs(), []
        for v in versions[:-keep]:
            fs.delete(self._path(f"manifests/{v:010d}.json"), False)
        if fs.exists(self._path("data")):
            for run in fs.listStatus(self._path("data")):
                for bucket in fs.listStatus(run.getPath()):
                    name = f"data/{run.getPath().getName()}/{bucket.getPath().getName()}"
                    if bucket.isDirectory() and name not in named:
                        fs.delete(bucket.getPath(), True)
                        gone.append(name)
        return sorted(gone)
