"""Exact duplicates by deterministic block naming.

Every text is cut into fixed-size blocks of UTF-8 bytes. Equal blocks get one
integer name, found by sorting: the smallest occurrence number among the equal
blocks. Then adjacent pairs of names are named the same way, again and again,
until each document has one name. Names come from comparing whole blocks and
whole pairs, never from a hash, so equal names mean equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galvanite.llm.common import as_bytes, joined_back, keyed, removed, written

_LOCAL = "part long, local int, first_row long, first_at int, block binary, uses array<struct<row:long,at:int,blocks:int>>, docs array<struct<row:long,blocks:int,doc_id:long,sha:binary>>"


def _structs(counts: np.ndarray, **fields: pa.Array) -> pa.ListArray:
    edges = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def _local_blocks(block: int, held: int):
    """Cuts texts into blocks. Each distinct block of up to ``held`` bytes of
    text, a part, is one row: with the places that use it, and what the rest
    of the work needs of the documents that begin with it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        seen: dict[bytes, int] = {}
        local, row, at, blocks, ids, shas = [], [], [], [], [], []
        size = 0

        def flush():
            kinds = list(seen)
            own = np.array(local, np.int64)
            order = np.argsort(own, kind="stable")
            own, rows, places, many = own[order], np.array(row, np.int64)[order], np.array(at, np.int32)[order], np.array(blocks, np.int32)[order]
            begins = np.searchsorted(own, np.arange(len(kinds) + 1))
            heads = order[places == 0]  # documents, in the order of their first blocks
            number = np.cumsum(np.array(at) == 0) - 1
            edges = np.searchsorted(own[places == 0], np.arange(len(kinds) + 1))
            for low in range(0, len(kinds), 2000):
                high = min(low + 2000, len(kinds))
                use, doc = slice(begins[low], begins[high]), heads[edges[low] : edges[high]]
                uses = _structs(np.diff(begins[low : high + 1]), row=pa.array(rows[use]), at=pa.array(places[use]), blocks=pa.array(many[use]))
                docs = _structs(
                    np.diff(edges[low : high + 1]), row=pa.array([row[i] for i in doc], pa.int64()), blocks=pa.array([blocks[i] for i in doc], pa.int32()),
                    doc_id=pa.array([ids[number[i]] for i in doc], pa.int64()), sha=pa.array([shas[number[i]] for i in doc], pa.binary()),
                )
                n = high - low
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(low, high, dtype=np.int32)), pa.array(rows[begins[low:high]]), pa.array(places[begins[low:high]]), pa.array(kinds[low:high], pa.binary()), uses, docs], names=["part", "local", "first_row", "first_at", "block", "uses", "docs"])
            seen.clear()
            for x in (local, row, at, blocks, ids, shas):
                x.clear()

        for batch in batches:
            for own, doc_id, text in zip(batch["_row"].to_pylist(), batch["doc_id"].to_pylist(), as_bytes(batch["text"]), strict=True):
                n = max(1, -(-len(text) // block))
                for k in range(n):
                    local.append(seen.setdefault(text[k * block : (k + 1) * block], len(seen)))
                row += [own] * n
                at += range(n)
                blocks += [n] * n
                ids.append(doc_id)
                shas.append(hashlib.sha256(text).digest())
                size += len(text) + 64 * n
                if size >= held:
                    yield from flush()
                    size, part = 0, part + 1
        if seen:
            yield from flush()

    return cut


def exact_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", block: int = 2048, held: int = 32 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as
    empty; a null id is smaller than any other; of rows that repeat both text
    and id, the first by row key stays. Other columns, whatever their names,
    are not read. An empty table gives an empty result.

    Spread: the table is read once. Each distinct block of a part of ``held``
    bytes is sorted once, without the places that use it, so a block that
    every document has comes once for each part; the places take its name
    from their own part's row. All later rounds move integers: a document
    leaves when it has one name, and the number of rounds is the logarithm of
    the longest document's blocks. Names of pairs and of whole texts are given
    back by ``joined_back``, which splits the hot ones."""
    source = keyed(docs, doc_id=F.col(key).cast("long"), text=F.col(text))
    local = written(source.mapInArrow(_local_blocks(block, held), _LOCAL), "blocks")
    own = local.select("block", "part", "local", F.struct("first_row", "first_at").alias("own"))
    other = own.withColumn("name", F.min("own").over(Window.partitionBy("block"))).where("name <> own").select("part", "local", "name")
    named = local.select("part", "local", "first_row", "first_at", "uses", "docs").join(other, ["part", "local"], "left")
    named = named.select(F.coalesce("name.first_row", "first_row").alias("name_row"), F.coalesce("name.first_at", "first_at").alias("name_at"), "uses", "docs")
    named = written(named, "named")
    removed(local)

    heads = named.select(F.explode("docs").alias("d"), "name_row", "name_at").select("d.*", "name_row", "name_at")
    names = named.select(F.explode(F.filter("uses", lambda u: u["blocks"] > 1)).alias("u"), "name_row", "name_at").select("u.row", "u.at", F.col("u.blocks").alias("width"), "name_row", "name_at")
    width = names.agg(F.max("width")).first()[0] or 1
    whole = None
    while width > 1:
        width = (width + 1) // 2
        side = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.struct("name_row", "name_at")))
        none = F.struct(F.lit(-1).cast("long").alias("name_row"), F.lit(-1).alias("name_at"))
        pairs = names.groupBy("row", (F.col("at") / 2).cast("int").alias("at")).agg(((F.first("width") + 1) / 2).cast("int").alias("width"), side(0).alias("left"), F.coalesce(side(1), none).alias("right"))
        pairs = written(pairs, "pairs")
        equal = written(pairs.groupBy("left", "right").agg(F.min(F.struct("row", "at")).alias("name"), F.count("*").alias("n")).where("n > 1"), "equal")
        done = joined_back(pairs, equal, ["left", "right"], "n")
        done = written(done.select("row", "at", "width", F.coalesce("name.row", "row").alias("name_row"), F.coalesce("name.at", "at").alias("name_at")), "names")
        removed(pairs, equal)
        ended = done.where("width = 1").select("row", "name_row", "name_at")
        whole = ended if whole is None else whole.unionByName(ended)
        names = done.where("width > 1")
    if whole is not None:
        longer = heads.where("blocks > 1").drop("name_row", "name_at").join(whole, "row")
        heads = heads.where("blocks = 1").unionByName(longer)
    heads = written(heads, "heads")
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("o"), (-F.col("row")).alias("r"), "doc_id"))
    groups = written(heads.groupBy("blocks", "name_row", "name_at").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1"), "groups")
    out = joined_back(heads, groups, ["blocks", "name_row", "name_at"], "n")
    alone = F.col("n").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), (alone | (F.col("row") == -F.col("best.r"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
