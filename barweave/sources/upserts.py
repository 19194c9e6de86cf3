"""A table with upserts by key, as immutable files and a manifest.

A commit writes the partitions that it touches into a folder of its own and then a manifest that names the folder of every partition. The
manifest with the highest number is the table; it appears by one rename, so a reader sees all of a commit or nothing, and what a lost
driver left behind is never read. Of two writers that start from the same manifest, the second fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UpsertTable:
    """Rows with a unique key ``keys``, partitioned by one of the keys."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], partition: str):
        if partition not in keys:
            raise ValueError("a row's partition must be part of its key")
        self.spark, self.path, self.keys, self.partition = spark, path.rstrip("/"), keys, partition
        self.schema = T._parse_datatype_string(schema)
        jvm = spark.sparkContext._jvm
        self._place = jvm.org.apache.hadoop.fs.Path
        self._store = self._place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._place(f"{self.path}/manifests")
        names = [x.getPath().getName() for x in self._store.listStatus(folder)] if self._store.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self) -> int:
        """The number of the last commit, 0 if there is none."""
        return max(self._versions(), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the last."""
        folders = self._manifest(self.version() if version is None else version)
        return self._of(list(folders.values()))

    def _of(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame) -> int:
        """Replaces the rows whose key is in ``rows`` and adds the others; gives the new version. A key may come once; a null is a value of
        its own. Only partitions that are touched are read and written again."""
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
        if rows.groupBy(*self.keys).count().where("count > 1").limit(1).count():
            raise ValueError("a key comes twice")
        base = self.version()
        old = self._manifest(base)
        touched = [r[0] for r in rows.select(F.col(self.partition).cast("string")).distinct().collect()]  # names of partitions
        name = lambda value: "null" if value is None else f"={value}"
        before = self._of([old[name(v)] for v in touched if name(v) in old])
        mine = rows.alias("new")
        same = [before[k].eqNullSafe(F.col(f"new.{k}")) for k in self.keys]
        merged = before.join(mine, same, "left_anti").unionByName(rows)
        commit, place = uuid.uuid4().hex, {name(v): i for i, v in enumerate(touched)}
        number = F.create_map(*(x for n, i in place.items() for x in (F.lit(n), F.lit(i)))) if place else F.create_map()
        value = F.col(self.partition).cast("string")
        merged = merged.withColumn("_part", F.element_at(number, F.when(value.isNull(), "null").otherwise(F.concat(F.lit("="), value)))) if place else merged.withColumn("_part", F.lit(0))
        merged.write.partitionBy("_part").parquet(f"{self.path}/data/{commit}")
        self._switch(base + 1, old | {n: f"{self.path}/data/{commit}/_part={i}" for n, i in place.items()})
        return base + 1

    def _switch(self, version: int, manifest: dict[str, str]) -> None:
        staged, final = self._place(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._place(f"{self.path}/manifests/{version:08d}.json")
        out = self._store.create(staged, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._store.exists(final) or not self._store.rename(staged, final):
            self._store.delete(staged, False)
            raise RuntimeError(f"version {version} is there already: another writer was first")
