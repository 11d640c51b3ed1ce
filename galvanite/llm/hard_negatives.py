"""Hard negatives by blocked matrix products.

Anchors go out in blocks of bounded bytes; every task multiplies a block with
the rows of its partition, a tile at a time, and keeps only each anchor's best
few. What tasks keep is merged by key. A first pass finds each anchor's
positives, a second one the best negatives inside the window that each
positive opens.

Components are integers, so products in double precision are exact below 2^53;
a tile that could exceed that is multiplied with integers of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galvanite.llm.common import written

NONE = np.iinfo(np.int64).max  #: the id of an empty place
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
TILE, COLUMNS, FIRST = 1024, 2048, 256  #: anchors and rows of a product; rows of a partition's first one


class Best:
    """The k best (score, id) of each of n queries: higher scores first,
    smaller ids among equal ones."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), LOWEST), np.full((n, k), NONE)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """``scores`` of the queries ``rows`` against ``ids``, where ``allowed``."""
        worst, last = self.score[rows, -1:], self.id[rows, -1:]
        r, c = np.nonzero(allowed & ((scores > worst) | ((scores == worst) & (ids < last))))
        if not len(r):
            return
        touched, own = np.unique(r, return_inverse=True)
        k = self.score.shape[1]
        query = np.concatenate([own, np.repeat(np.arange(len(touched)), k)])
        score = np.concatenate([scores[r, c], self.score[rows[touched]].ravel()])
        id_ = np.concatenate([ids[c], self.id[rows[touched]].ravel()])
        order = np.lexsort((id_, ~score, query))  # ~ turns the order of integers round and can't overflow
        query = query[order]
        kept = order[np.arange(len(order)) - np.searchsorted(query, query) < k]
        self.score[rows[touched]], self.id[rows[touched]] = score[kept].reshape(-1, k), id_[kept].reshape(-1, k)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integral matrices, as 64-bit
    integers; beyond their range they are its ends."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b]
    exact = [[sum(x * y for x, y in zip(map(int, row), other, strict=True)) for other in whole] for row in a]
    return np.array([[min(max(x, LOWEST), HIGHEST) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


def matrices(ids: np.ndarray, vectors: pa.ListArray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each length, and their integral matrix; rows
    come in the order of their ids."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        at = at[np.argsort(ids[at], kind="stable")]
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield at, np.floor(scale * flat).reshape(len(at), d)


def _pass(block: Block, queries: int, k: int, scale: int, look: Callable) -> Callable:
    """A mapInArrow function: the best of each query in each partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = Best(queries, k), 0
        for batch in batches:
            ids, labels = batch["id"].to_numpy(), batch["label"].to_numpy()
            for at, values in matrices(ids, batch["vector"], scale):
                own = block.by_length.get(values.shape[1])
                start = 0
                while own is not None and start < len(at):  # a small product first: its scores keep most later ones out
                    end = start + (COLUMNS if seen else FIRST)
                    some = at[start:end]
                    look(best, *own, ids[some], labels[some], values[start:end])
                    seen, start = seen + len(some), end
        query, place = np.nonzero(best.id != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(best.score[query, place]), pa.array(best.id[query, place])], ["query", "score", "id"])

    return work


class Block:
    """Anchors of one block: ids and labels, and for each vector length the
    places of its anchors and their matrix."""

    def __init__(self, table: pa.Table, scale: int):
        table = table.combine_chunks()
        self.ids, self.labels = table["id"].to_numpy(), table["label"].to_numpy()
        vectors = pa.concat_arrays(table["vector"].chunks) if table.num_rows else pa.array([], pa.list_(pa.float64()))
        self.by_length = {values.shape[1]: (at, values) for at, values in matrices(self.ids, vectors, scale)}

    def positives(self, best: Best, places: np.ndarray, matrix: np.ndarray, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        """Other rows with the anchor's label."""
        for label in np.unique(labels):
            same, mine = np.flatnonzero(self.labels[places] == label), np.flatnonzero(labels == label)
            for i in range(0, len(same), TILE):
                tile = same[i : i + TILE]
                best.offer(places[tile], products(matrix[tile], values[mine]), ids[mine], self.ids[places[tile]][:, None] != ids[mine])

    def negatives(self, lows: np.ndarray, highs: np.ndarray) -> Callable:
        """Rows with another label inside the windows; the query of an anchor's
        j-th positive is j times the number of anchors after the anchor's place."""

        def look(best: Best, places: np.ndarray, matrix: np.ndarray, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
            for i in range(0, len(places), TILE):
                tile = places[i : i + TILE]
                scores = products(matrix[i : i + TILE], values)
                other = self.labels[tile][:, None] != labels
                for j, (low, high) in enumerate(zip(lows, highs, strict=True)):
                    best.offer(j * len(self.ids) + tile, scores, ids, other & (scores >= low[tile][:, None]) & (scores <= high[tile][:, None]))

        return look


PARTIAL = "query int, score long, id long"


def _merged(partial: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all partitions, ranked from 1."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, block_bytes: int = 16 << 20) -> DataFrame:
    """One row for each anchor, positive and negative: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose key is divisible by ``every``. A component x
    counts as floor(``scale`` * x); a score is the integer inner product with
    the anchor, higher first, ties by smaller key. Positives are an anchor's
    first ``positives`` other rows of its label; for each of them the first
    ``negatives`` rows of other labels follow whose score is at least ``low``
    and at most ``high`` percent of the positive's.

    Rows with a null key, label or vector, or with a component that is null or
    not finite (once scaled), take no part. Labels are whole numbers. Rows
    with equal keys are one row; where they differ, the smallest (label,
    vector) counts. Vectors of different lengths don't meet. Scores outside
    64 bits count as the nearest 64-bit integer. No anchors, or an empty
    table, give an empty result; other columns are not read.

    Anchors are dealt to blocks by a hash of their key; a block's matrix takes
    about ``block_bytes`` (twice that at most, larger ones are halved) in the
    driver and in each worker, however many anchors there are. Every block
    reads the rows twice. A task keeps ``positives`` (then ``positives`` times
    ``negatives``) entries an anchor, so the merge doesn't depend on how many
    rows a task has."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float("inf"))))
    fit = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)))
    own = F.struct(F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    unique = fit.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(own).alias("own")).select("id", "own.label", "own.vector")
    unique = written(unique.sortWithinPartitions("id"), "vectors")
    anchors = unique.where(F.col("id") % every == 0)
    size = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
    most = max(1, block_bytes // (8 * max(1, size[1] or 1)))
    blocks = -(-size[0] // most)
    results = []
    for b in range(blocks):
        held = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        for start in range(0, held.num_rows, 2 * most):
            results.append(_mined(unique, Block(held.slice(start, 2 * most), scale), positives, negatives, low, high, scale))
    if not results:
        return rows.sparkSession.createDataFrame([], RESULT)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mined(unique: DataFrame, block: Block, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame:
    """The result for one block of anchors."""
    spark, n = unique.sparkSession, len(block.ids)
    sent = spark.sparkContext.broadcast(block)
    first = lambda batches: _pass(sent.value, n, positives, scale, sent.value.positives)(batches)
    found = _merged(unique.mapInArrow(first, PARTIAL), positives).toArrow()  # at most ``positives`` rows an anchor of the block
    at, place = found["query"].to_numpy(), found["rank"].to_numpy() - 1
    lows, highs = np.full((positives, n), HIGHEST), np.full((positives, n), LOWEST)
    for a, j, score in zip(at.tolist(), place.tolist(), found["score"].to_pylist(), strict=True):
        lows[j, a], highs[j, a] = (min(max(x, LOWEST), HIGHEST) for x in (-(-low * score // 100), high * score // 100))
    windows = spark.sparkContext.broadcast((lows, highs))
    second = lambda batches: _pass(sent.value, positives * n, negatives, scale, sent.value.negatives(*windows.value))(batches)
    mined = _merged(unique.mapInArrow(second, PARTIAL), negatives)
    opened = pa.table({"query": pa.array((place * n + at).astype(np.int32)), "anchor_id": block.ids[at], "positive_id": found["id"], "positive_score": found["score"]})
    known = spark.createDataFrame(opened)
    return written(mined.join(F.broadcast(known), "query").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
