"""Stored tables that are written in place of Parquet's missing row updates: copy-on-write parts and swapped manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.sources.shared import hadoop_path, staged
from tradewind.sources.sinks import insert_ignore, upsert


class StoredTable:
    """A table of one row a key, in a fixed number of parts by the hash of the key.

    A change reads and writes only the parts that its keys fall into, as new folders; then a manifest that names the
    folder of every part is put beside the earlier ones, whole or not at all, and is the next version. Readers follow
    the last manifest, or the one of a version that they ask for, so they never see half a change, and what was
    written by a run that was lost is in no manifest. A writer whose version exists already has lost a race and fails.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, parts: int = 64):
        self.spark, self.path, self.key, self.schema, self.parts = spark, path, key, schema, parts

    # --- manifests ---

    def versions(self) -> list[int]:
        jpath, files = hadoop_path(self.spark, f"{self.path}/versions")
        names = [s.getPath().getName() for s in files.listStatus(jpath)] if files.exists(jpath) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Part to folder; parts that hold no row are not named."""
        known = self.versions()
        version = version if version is not None else known[-1] if known else None
        if version is None:
            return {}
        if version not in known:
            raise ValueError(f"there is no version {version}")
        jpath, files = hadoop_path(self.spark, f"{self.path}/versions/{version}.json")
        stream = files.open(jpath)
        try:
            return {int(k): v for k, v in json.loads(bytes(stream.readAllBytes())).items()}
        finally:
            stream.close()

    def _commit(self, manifest: dict[int, str], version: int) -> int:
        """The manifest is written under another name and renamed; a rename onto what exists fails."""
        text, files = hadoop_path(self.spark, f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = files.create(text)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target, _ = hadoop_path(self.spark, f"{self.path}/versions/{version}.json")
        if files.exists(target) or not files.rename(text, target):
            files.delete(text, False)
            raise RuntimeError(f"version {version} was written by somebody else")
        return version

    # --- reading ---

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def _rows(self, manifest: dict[int, str], parts: list[int] | None = None) -> DataFrame:
        folders = [f for p, f in manifest.items() if parts is None or p in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    # --- writing ---

    def _changed(self, delta: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Writes what change(rows, delta) makes of the parts that the delta's keys fall into; returns those parts."""
        known = self.versions()
        version = known[-1] + 1 if known else 0
        delta = staged(delta, "delta")
        touched = sorted(r.part for r in delta.select(self._part().alias("part")).distinct().collect())  # a row a part
        if not touched and known:
            return []
        before = self.manifest()
        base = f"{self.path}/parts/{version}-{uuid.uuid4().hex}"
        rows = change(self._rows(before, touched), delta).select(*(f.name for f in delta.sparkSession.createDataFrame([], self.schema).schema.fields))
        rows.withColumn("_part", self._part()).repartition(max(1, len(touched)), "_part").write.partitionBy("_part").parquet(base)
        jpath, files = hadoop_path(self.spark, base)
        written = {int(s.getPath().getName().removeprefix("_part=")): f"{base}/{s.getPath().getName()}" for s in files.listStatus(jpath) if s.getPath().getName().startswith("_part=")}
        self._commit({p: f for p, f in before.items() if p not in touched} | written, version)
        return touched

    def upsert(self, delta: DataFrame) -> list[int]:
        """Rows of delta (one a key) in place of those with the same key."""
        return self._changed(delta, lambda rows, new: upsert(rows, new.select(*rows.columns), self.key))

    def insert_ignore(self, delta: DataFrame) -> list[int]:
        """Rows of delta (one a key) whose key is not there."""
        return self._changed(delta, lambda rows, new: insert_ignore(rows, new.select(*rows.columns), self.key))

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows of these keys are gone."""
        return self._changed(keys.select(*self.key), lambda rows, gone: rows.join(gone.distinct(), self.key, "left_anti"))

    def replace(self, keys: DataFrame, rows: DataFrame) -> list[int]:
        """All rows of the given keys are replaced by these rows, of which a key may have several (a document's chunks)."""
        new = rows.select(*self.key, F.struct(*rows.columns).alias("_new"))
        both = keys.select(*self.key).distinct().join(new, self.key, "left")

        def change(old: DataFrame, delta: DataFrame) -> DataFrame:
            kept = old.join(delta.select(*self.key).distinct(), self.key, "left_anti")
            return kept.unionByName(delta.where("_new IS NOT NULL").select("_new.*"))

        return self._changed(both, change)

    def forget(self, keep: int = 2) -> None:
        """Gives up all versions but the last `keep`, and the folders that only they name or that no version names."""
        known = self.versions()
        kept = known[-keep:]
        named = {f.rsplit("/", 1)[0] for v in kept for f in self.manifest(v).values()}
        for v in known[:-keep]:
            jpath, files = hadoop_path(self.spark, f"{self.path}/versions/{v}.json")
            files.delete(jpath, False)
        jpath, files = hadoop_path(self.spark, f"{self.path}/parts")
        for status in files.listStatus(jpath) if files.exists(jpath) else ():
            if f"{self.path}/parts/{status.getPath().getName()}" not in named:
                files.delete(status.getPath(), True)
