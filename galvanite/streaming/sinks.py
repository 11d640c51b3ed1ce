"""A keyed table that takes each batch of a stream once.

The table lies in ``buckets`` parts by a hash of the key. A batch rewrites the
parts it touches into new folders and is then committed by one new manifest,
which names the folder of every part. Readers follow the newest manifest, so
they see a batch whole or not at all; a batch that is delivered again after
its commit changes nothing, one that failed before it leaves folders that no
manifest names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedTable:
    """A table of one row for each key: the one with the largest ``order``.

    ``path`` may be in any store that Hadoop's file systems reach and that can
    rename a file; one writer at a time. A manifest has one entry for each
    part, so its size is bounded by ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), list(keys), order, buckets
        self.schema = T.StructType(spark.createDataFrame([], schema).schema.fields)
        jvm = spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
        self._at = lambda *parts: jvm.Path("/".join((self.path, *parts)))
        self.fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def committed(self) -> dict:
        """The newest manifest: batch, and the folder of each part."""
        if not self.fs.exists(self._at("_batches")):
            return {"batch": -1, "parts": {}}
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at("_batches"))]
        batches = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not batches:
            return {"batch": -1, "parts": {}}
        stream = self.fs.open(self._at("_batches", f"{max(batches)}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self) -> DataFrame:
        return self._parts(self.committed()["parts"])

    def _parts(self, parts: dict[str, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{folder}" for folder in parts.values()))

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Merges a batch, for ``foreachBatch``; false if it was committed
        before. Even then its rows are computed, as the state of the stream's
        operators is written while they are."""
        now = self.committed()
        if batch <= now["batch"]:
            rows.write.format("noop").mode("overwrite").save()
            return False
        folder = f"data/{batch}-{uuid.uuid4().hex}"
        new = rows.select(self.schema.names).withColumn("_part", self._part()).persist()
        try:
            touched = [str(r[0]) for r in new.select("_part").distinct().collect()]  # at most ``buckets``
            old = self._parts({p: f for p, f in now["parts"].items() if p in touched}).withColumn("_part", self._part())
            best = F.max_by(F.struct(*self.schema.names), self.order).alias("row")
            merged = new.unionByName(old).groupBy("_part", *(F.col(k).alias(f"_k_{k}") for k in self.keys)).agg(best).select("_part", "row.*")
            merged.repartition(max(1, len(touched)), "_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        finally:
            new.unpersist()
        self._commit(batch, now["parts"] | {p: f"{folder}/_part={p}" for p in touched})
        return True

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.keys)), F.lit(self.buckets)).cast("int")

    def _commit(self, batch: int, parts: dict[str, str]) -> None:
        held = self._at("_batches", f".{batch}-{uuid.uuid4().hex}")
        stream = self.fs.create(held, False)
        stream.write(json.dumps({"batch": batch, "parts": parts}).encode())
        stream.close()
        final = self._at("_batches", f"{batch}.json")
        if self.fs.exists(final) or not self.fs.rename(held, final):
            raise RuntimeError(f"batch {batch} was committed by another writer")

    def vacuum(self) -> int:
        """Deletes folders that the newest manifest doesn't name, and older
        manifests. For when nothing reads an earlier state."""
        now = self.committed()
        named = {f.split("/")[1] for f in now["parts"].values()}
        gone = [s.getPath() for s in self.fs.listStatus(self._at("data"))] if self.fs.exists(self._at("data")) else []
        gone = [p for p in gone if p.getName() not in named]
        if now["batch"] >= 0:
            gone += [s.getPath() for s in self.fs.listStatus(self._at("_batches")) if s.getPath().getName() != f"{now['batch']}.json"]
        for p in gone:
            self.fs.delete(p, True)
        return len(gone)
