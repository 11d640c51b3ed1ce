"""Shared helpers of the training-text operators.

Row keys. Operators that read a table twice give each row a key with
``keyed``; the key is Spark's ``monotonically_increasing_id`` over a plain
scan. It is the same for both scans of one table if both are split alike,
which would follow the cores that are registered when a scan is planned;
``keyed`` fixes that number for the session, so executors lost or gained
between two scans change nothing. Pass a written table (not an unordered
shuffle result) to such operators.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master may run without that setting; it then gets a
    temporary folder of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="galvanite-")
    sc.setCheckpointDir(found)
    return sc.getCheckpointDir() or found


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the
    lineage, survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing will read again: what
    was made of them must be written itself by then."""
    for table in tables:
        spark, path = table.sparkSession, table.written_to
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keyed(df: DataFrame, **cols: Column) -> DataFrame:
    """The named columns and a key for each row, _row.

    Sets spark.sql.files.minPartitionNum, where it is unset, to the cores
    there are now: later scans are split as this one is."""
    spark, split = df.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(split, None) is None:
        spark.conf.set(split, str(spark.sparkContext.defaultParallelism))
    return df.select(F.monotonically_increasing_id().alias("_row"), *(c.alias(k) for k, c in cols.items()))


def joined_back(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, most: int = 100_000) -> DataFrame:
    """``rows`` left-joined to ``groups``, a written table with one row for
    each key and its number of rows, ``size``. The ``most`` largest groups
    are broadcast, so that their rows stay where they are; the others, of
    which none has more than a ``most``-th of all rows, are joined by key."""
    if groups.count() <= most:
        return rows.join(F.broadcast(groups), keys, "left")
    large = F.broadcast(groups.orderBy(F.desc(size), *keys).limit(most).withColumn("_large", F.lit(True)))
    marked = rows.join(large, keys, "left")
    others = marked.where("_large is null").select(rows.columns).join(groups, keys, "left")
    return marked.where("_large").drop("_large").unionByName(others)


class Possible:
    """A Bloom filter of the one column of ``wanted``, of 2^``bits`` bits: a
    fixed size (4 MB), so it can go to every executor however many keys there
    are. It loses no row; with very many keys it merely keeps more, so join
    what it keeps to ``wanted`` as well. Used before such a join, large rows
    that can't match aren't shuffled."""

    PLACES = ("_p0", "_p1")

    def __init__(self, wanted: DataFrame, bits: int = 25):
        self.bits = bits
        key = F.col(wanted.columns[0])
        set_ = wanted.select(F.explode(F.array(*self._places(key))).alias("p"))
        word = set_.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
        filled = np.zeros(1 << (bits - 6), np.uint64)
        filled[word["w"].to_numpy()] = word["b"].to_numpy().view(np.uint64)
        self.shared = wanted.sparkSession.sparkContext.broadcast(filled)

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key.cast("long"), F.lit(j)), F.lit(1 << self.bits)) for j in range(2)]

    def marked(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows with the columns that ``kept`` needs."""
        return rows.select("*", *(c.alias(name) for c, name in zip(self._places(F.col(key)), self.PLACES, strict=True)))

    @staticmethod
    def kept(batch: pa.RecordBatch, filled: np.ndarray, wanted: bool = True) -> pa.RecordBatch:
        """The rows of a marked batch whose key may be wanted, or the others,
        whose key surely isn't; in a task."""
        found = np.ones(batch.num_rows, bool)
        for name in Possible.PLACES:
            at = batch[name].to_numpy().astype(np.uint64)
            found &= (filled[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return batch.filter(pa.array(found if wanted else ~found))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def batch_of(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and each row's count."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
