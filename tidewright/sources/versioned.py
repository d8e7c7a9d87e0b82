"""A keyed table with versions: an upsert rewrites the buckets that it touches, and a manifest names what is valid.

Rows stand in buckets by a hash of their keys. An upsert reads the touched buckets of the last version, replaces or adds
rows, writes them to a new folder, and then puts a manifest in place by a rename: readers see the old version or the new
one. Files of a version are never changed, so any version can be read again. Epochs are numbers that ascend; one that has
been taken in is not taken in again, so a batch may be repeated after a failure. One writer at a time; of two that made the
same version, the one whose rename comes second fails.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class State:
    version: int = 0
    epoch: int = -1
    parts: dict[str, str] = field(default_factory=dict)


class KeyedTable:
    """schema: DDL; keys: columns whose values (null is a value too) name a row."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = 16):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder.rstrip("/"), schema, keys, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("manifests").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self, version: int | None = None) -> State:
        """What a manifest says, the last one if no version is given."""
        files = self._files().globStatus(self._path("manifests/*.json")) or []
        found = sorted(x.getPath().getName() for x in files)
        if version is not None:
            found = [x for x in found if int(x.split(".")[0]) == version]
        if not found:
            return State()
        return State(**json.loads(self.spark.read.text(f"{self.folder}/manifests/{found[-1]}", wholetext=True).first()[0]))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(list(self.state(version).parts.values()))

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, epoch: int) -> int:
        """Rows replace those with their keys; of several with one key the greatest stays. Returns the version."""
        last = self.state()
        if epoch <= last.epoch:
            return last.version
        own = self._rows([]).columns
        new = rows.select(*own).groupBy(*self.keys).agg(F.max(F.struct(*[c for c in own if c not in self.keys])).alias("_row")).select(*self.keys, "_row.*")
        home = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).alias("bucket")
        version = last.version + 1
        incoming = f"{self.folder}/incoming/{version}-{uuid4().hex}"
        new.select("*", home).write.parquet(incoming)
        new = self.spark.read.parquet(incoming)
        touched = sorted(str(r[0]) for r in new.select("bucket").distinct().collect())
        old = self._rows([last.parts[b] for b in touched if b in last.parts])
        same = [old[k].eqNullSafe(new[k]) for k in self.keys]
        merged = old.join(new, same, "left_anti").select(*own).select("*", home).unionByName(new)
        data = f"{self.folder}/data/{version}-{uuid4().hex}"
        merged.repartition("bucket").write.partitionBy("bucket").parquet(data)
        self._publish(State(version, epoch, last.parts | {b: f"{data}/bucket={b}" for b in touched}))
        return version

    def _publish(self, state: State) -> None:
        files, to = self._files(), self._path(f"manifests/{state.version:08d}.json")
        draft = self._path(f"drafts/{uuid4().hex}.json")
        out = files.create(draft)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()
        files.mkdirs(to.getParent())
        if files.exists(to) or not files.rename(draft, to):
            raise RuntimeError(f"another writer made version {state.version}")
