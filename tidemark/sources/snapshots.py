"""A Parquet table in versions: hash buckets, a manifest per version, an atomic switch.

``<path>/data/<id>/_bucket=<n>/`` holds immutable files, ``<path>/versions/<number>.json``
names the folders of every bucket in that version.  A write adds a data folder, then a
manifest under the next number by one rename; a write that dies before the rename leaves the
old version as it was, and one that is replayed after it is known by its batch number and
skipped.  Readers hold the version they began with.  A write reads and rewrites only the
buckets that its keys fall into.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.sinks import upsert_latest

BUCKET = "_bucket"

#: Folders that a bucket may gather by appends before the next one rewrites it as one.
MOST_FOLDERS = 16


class SnapshotTable:
    """``keys`` identify a row; ``buckets`` is fixed by the first write."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self._buckets = buckets

    # ------------------------------------------------------------ files of the shared folder

    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[str]:
        fs, where = self._file(folder)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The newest (or a given) version's manifest; None if there is none yet."""
        known = self.versions()
        if not known:
            return None
        fs, where = self._file(f"versions/{known[-1] if version is None else version:020d}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        name = f"versions/{manifest['version']:020d}.json"
        fs, there = self._file(name)
        _, here = self._file(f"versions/.{uuid.uuid4().hex}.tmp")
        stream = fs.create(here, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if fs.exists(there) or not fs.rename(here, there):
            raise RuntimeError(f"another writer made {name} of {self.path}")

    # ------------------------------------------------------------ reading

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self._buckets)).cast("int")

    def read(self, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or those of its buckets, as of the newest or a given version."""
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self._rows(manifest, buckets)

    def _rows(self, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        wanted = manifest["folders"] if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}"
                 for b, folders in manifest["folders"].items() if b in wanted for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths).select(*[F.col(f"`{n}`") for n in schema.names])

    # ------------------------------------------------------------ writing

    def _begin(self, batch: DataFrame, writer: str, batch_id: int | None) -> dict | None:
        """The manifest to build on; None if this writer's batch is already in it."""
        now = self.manifest()
        if now is None:
            now = {"version": -1, "schema": batch.schema.jsonValue(), "buckets": self._buckets,
                   "folders": {}, "batches": {}}
        self._buckets = now["buckets"]
        if batch_id is not None and now["batches"].get(writer, -1) >= batch_id:
            return None
        return now

    def _touched(self, batch: DataFrame) -> list[int]:
        """Buckets of the batch's keys: as many numbers as there are buckets, at most."""
        return [r[0] for r in batch.select(self.bucket_of().alias(BUCKET)).distinct().collect()]

    def _add(self, now: dict, rows: DataFrame | None, replaced: Iterable[int], writer: str,
             batch_id: int | None) -> None:
        """Write ``rows`` as a new folder and commit the version in which it replaces the folders
        of the buckets ``replaced`` and joins those of the others."""
        folders = dict(now["folders"])
        if rows is not None:
            made = uuid.uuid4().hex
            (rows.withColumn(BUCKET, self.bucket_of()).repartition(self._buckets, BUCKET)
             .write.partitionBy(BUCKET).parquet(f"{self.path}/data/{made}"))
            for b in replaced:
                folders.pop(str(b), None)
            for name in self._names(f"data/{made}"):
                if name.startswith(f"{BUCKET}="):
                    b = name.split("=")[1]
                    folders[b] = folders.get(b, []) + [made]
        batches = dict(now["batches"])
        if batch_id is not None:
            batches[writer] = batch_id
        self._commit({**now, "version": now["version"] + 1, "folders": folders, "batches": batches})

    def append_first(self, batch: DataFrame, order: list[str], writer: str = "", batch_id: int | None = None) -> None:
        """Add the batch's first row (by ``order``) of every key that is not stored.  A batch
        without rows makes a version without new folders, the first one with the schema."""
        now = self._begin(batch, writer, batch_id)
        if now is None:
            return
        touched = self._touched(batch)
        if not touched:
            return self._add(now, None, (), writer, batch_id)
        names = [F.col(f"`{c}`") for c in batch.columns]
        first = batch.groupBy(*self.keys).agg(F.min_by(
            F.struct(*names), F.struct(*[F.col(c) for c in order], F.xxhash64(*names))).alias("_r")).select("_r.*")
        stored = self._rows(now, touched).select(*[F.col(f"`{k}`").alias(f"_{k}") for k in self.keys])
        same = F.lit(True)
        for k in self.keys:
            same &= F.col(f"`{k}`").eqNullSafe(F.col(f"`_{k}`"))
        fresh = first.join(stored, same, "left_anti")
        full = [b for b in touched if len(now["folders"].get(str(b), ())) >= MOST_FOLDERS]
        if full:
            fresh = fresh.unionByName(self._rows(now, full))
        self._add(now, fresh, full, writer, batch_id)

    def upsert(self, batch: DataFrame, order: list[str], writer: str = "", batch_id: int | None = None) -> None:
        """Per key the row with the greatest ``order`` of table and batch (ties: the batch's)."""
        now = self._begin(batch, writer, batch_id)
        if now is None:
            return
        touched = self._touched(batch)
        if not touched:
            return self._add(now, None, (), writer, batch_id)
        latest = upsert_latest(batch.limit(0), batch, self.keys, order)
        merged = upsert_latest(self._rows(now, touched), latest, self.keys, order)
        self._add(now, merged.select(*[F.col(f"`{c}`") for c in batch.columns]), touched, writer, batch_id)

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the last ``keep`` and the data folders that none of these names;
        returns the number of folders.  Not while a write is under way."""
        known = self.versions()
        kept = known[-max(keep, 1):]
        used = {f for v in kept for folders in self.manifest(v)["folders"].values() for f in folders}
        for v in known[:-len(kept)] if kept else []:
            fs, where = self._file(f"versions/{v:020d}.json")
            fs.delete(where, False)
        gone = [f for f in self._names("data") if f not in used] if kept else []
        for f in gone:
            fs, where = self._file(f"data/{f}")
            fs.delete(where, True)
        return len(gone)
