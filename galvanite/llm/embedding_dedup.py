"""Near-duplicate vectors by spherical-cap filters.

A filter direction is a concatenation of one short random code word for each
block of coordinates (a product code), so there are words ** blocks
directions. A vector's list is every direction whose inner product with it
exceeds a bound; the product structure lets the list be decoded block by
block without looking at all directions. Vectors meet in the filters on their
lists and are compared there exactly.

A seeded random rotation before each code makes the lists independent of where
a vector's energy lies, and the bound is each vector's own: what its best few
directions reach, so no list is empty or long. In few dimensions directions
are no filters; there the filters are the cells of a grid that a ball around
the vector touches, and every link is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galvanite.llm.common import joined_back, lists, mix64, written
from galvanite.llm.components import components
from galvanite.llm.near_dedup import spanning


def code_words(dimensions: int, blocks: int, words: int, seed: int) -> list[np.ndarray]:
    """Random unit code words for each block of coordinates."""
    rng = np.random.default_rng(seed)
    out = []
    for part in np.array_split(np.arange(dimensions), blocks):
        c = rng.standard_normal((words, len(part)))
        out.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return out


def units(v: np.ndarray) -> np.ndarray:
    """Rows at norm 1; scaled by powers of two first, so no norm overflows."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rotation(dimensions: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng([seed, dimensions]).standard_normal((dimensions, dimensions)))[0]


def reached(unit: np.ndarray, codes: list[np.ndarray], fewest: int) -> np.ndarray:
    """Each vector's inner product with its ``fewest``-th best direction."""
    edges = np.cumsum([0, *(c.shape[1] for c in codes)])
    best = np.zeros((len(unit), 1))
    for i, c in enumerate(codes):
        own = -np.partition(-(unit[:, edges[i] : edges[i + 1]] @ c.T), min(fewest, len(c)) - 1, axis=1)[:, :fewest]
        best = (best[:, :, None] + own[:, None, :]).reshape(len(unit), -1)
        best = -np.partition(-best, min(fewest, best.shape[1]) - 1, axis=1)[:, :fewest]
    return best.min(axis=1) - 1e-12


def cells(unit: np.ndarray, least: float, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, cell) for every grid cell that the ball around a vector touches
    in its first rotated coordinates (at most 8). The radius is half the
    distance of two unit vectors at cosine ``least``, so two linked vectors
    both list the cell of their midpoint. Cells are named by a hash; equal
    names only add comparisons."""
    radius = np.sqrt(max(0.0, 2 - 2 * least)) / 2 + 1e-6
    width = max(4 * radius, 0.05)
    at, name = np.arange(len(unit)), np.zeros(len(unit), np.uint64)
    for x in (unit @ turn)[:, :8].T:
        low, high = (np.floor((x[at] + by) / width + 0.5).astype(np.int64) for by in (-radius, radius))
        two = np.flatnonzero(low != high)
        cell = np.concatenate([low, high[two]])
        at, name = np.concatenate([at, at[two]]), mix64(np.concatenate([name, name[two]]) * np.uint64(0x9E3779B97F4A7C15) + cell.astype(np.uint64))
    at, name = np.unique(np.stack([at, (name >> np.uint64(33)).astype(np.int64)]), axis=1)
    return at, name


def list_decode(unit: np.ndarray, codes: list[np.ndarray], bound: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, direction) for every direction whose inner product with a
    vector is at least ``bound``, one for all or one for each. Prefixes of directions are kept only while
    the best remaining code words can still lift them over the bound."""
    edges = np.cumsum([0, *(c.shape[1] for c in codes)])
    scores = [unit[:, edges[i] : edges[i + 1]] @ c.T for i, c in enumerate(codes)]
    best = [s.max(axis=1) for s in scores]
    rest = np.cumsum(best[::-1], axis=0)[::-1]
    vector, total, name = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64)
    for i, s in enumerate(scores):
        sums = total[:, None] + s[vector]
        need = np.broadcast_to(bound, len(unit))[vector] - (rest[i + 1][vector] if i + 1 < len(scores) else 0)
        at, word = np.nonzero(sums >= need[:, None])
        vector, total, name = vector[at], sums[at, word], name[at] * s.shape[1] + word
    return vector, name


def filters(unit: np.ndarray, made: dict[int, list], *, least: float, blocks: int, words: int, seeds: int, directions: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) for unit vectors of one length; ``made`` holds the
    rotations and codes of each length."""
    d = unit.shape[1]
    if d not in made:
        made[d] = [(rotation(d, seed), code_words(d, min(blocks, d), words, seed)) for seed in range(seeds if d > low else 1)]
    if d <= low:
        return cells(unit, least, made[d][0][0])
    out_at, out_name = [], []
    for k, (turn, codes) in enumerate(made[d]):
        turned = unit @ turn
        at, name = list_decode(turned, codes, reached(turned, codes, directions))
        out_at.append(at)
        out_name.append(name * seeds + k)
    return np.concatenate(out_at), np.concatenate(out_name)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vector = batch["vector"]
        flat, ends = vector.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(vector).to_numpy(zero_copy_only=False))
        parts = np.split(flat, ends[:-1]) if len(ends) else []
        named = [hashlib.blake2b(label.encode() + b"\0" + x.tobytes(), digest_size=16).digest() for label, x in zip(batch["label"].to_pylist(), parts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(named, pa.binary()), vector], names=["id", "label", "digest", "vector"])


def _listed(**more):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                size = pa.compute.list_value_length(part["vector"]).to_numpy(zero_copy_only=False)
                out_at, out_name = [], []
                for d in np.unique(size).tolist():
                    rows = np.flatnonzero(size == d)
                    v = part["vector"].take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d).astype(np.float64)
                    at, name = filters(units(v), made, **more)
                    out_at.append(rows[at])
                    out_name.append(name)
                at, name = np.concatenate(out_at), np.concatenate(out_name)
                order = np.lexsort((name, at))
                counts = np.bincount(at, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, lists(name[order].astype(np.int32), counts, pa.int32())], names=[*part.schema.names, "filters"])

    return listed


def _compare(least: float):
    """Links inside each place of a table. A pair that shares several filters
    counts only in the least of them."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("first", "ascending"), ("second", "ascending"), ("no", "ascending")])
        no, copies, f, side = (table[c].to_numpy() for c in ("no", "copies", "f", "side"))
        label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        size = pa.compute.list_value_length(table["vector"].combine_chunks()).to_numpy()
        unit = np.zeros((len(no), size.max()))
        flat, starts = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size) - size
        for d in np.unique(size).tolist():
            rows = np.flatnonzero(size == d)
            unit[rows, :d] = units(flat[starts[rows][:, None] + np.arange(d)])
        many = pa.compute.list_value_length(table["filters"].combine_chunks()).to_numpy()
        listed, begins = table["filters"].combine_chunks().flatten().to_numpy(), np.cumsum(many) - many
        key = np.stack([table[c].to_numpy() for c in ("place", "first", "second")])
        edges = np.flatnonzero(np.append(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)), True))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            here = slice(low, high)
            close = np.triu(unit[here] @ unit[here].T >= least, 1)
            close &= (label[here, None] == label[None, here]) & (f[here, None] == f[None, here])
            if key[1, low] != key[2, low]:
                close &= side[here, None] != side[None, here]
            if not close.any():
                continue
            n = high - low
            earlier = listed[begins[low] : begins[high - 1] + many[high - 1]]
            owner = np.repeat(np.arange(n), many[here])
            keep = earlier < f[low:high][owner]
            earlier, owner = earlier[keep], owner[keep]
            _, column, count = np.unique(earlier, return_inverse=True, return_counts=True)
            shared = count[column] > 1
            kept, column = np.unique(column[shared], return_inverse=True)
            grid = np.zeros((n, len(kept)), np.float32)
            grid[owner[shared], column] = 1
            close &= (grid @ grid.T) == 0
            # a forest of all close pairs of this place, and each vector's count of links
            links = close @ copies[here] + close.T @ copies[here]
            forest = np.array(spanning(n, map(tuple, np.argwhere(close).tolist())), np.int64).reshape(-1, 2)
            some = np.flatnonzero(links)
            out.append((no[low + some], links[some], np.full(len(some), -1)))
            out.append((no[low + forest[:, 0]], np.zeros(len(forest), np.int64), no[low + forest[:, 1]]))
        a, n, b = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in out)]).astype(np.int64) for i in range(3))
        return pa.table({"no": a, "n": n, "b": b})

    return compare


def embedding_dedup(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, blocks: int = 2, words: int = 1024, seeds: int = 3, directions: int = 8, low: int = 8, block: int = 512, together: int = 1024) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of one label are linked if their cosine, in double precision, is
    at least ``least``. n_links counts the other rows linked directly;
    component_id is the smallest id that links reach. Vectors that are null,
    zero or hold a null or non-finite component, and rows with a null label
    or id, link with nothing; vectors of different lengths neither. Rows with
    equal ids, vectors and labels count one by one as links of each other;
    an empty table gives an empty result; other columns are not read.

    A vector's filters are the ``directions`` best of ``words`` ** ``blocks``
    in each of ``seeds`` codes: all that reach its own bound. At cosine 0.98
    two vectors share one of them with probability 0.99 or more, from 9 to
    384 components (a lower ``least`` takes more of them). Vectors of
    at most ``low`` components use grid cells, which miss no link. The tests
    measure recall with the defaults against brute force, on low-dimensional,
    sparse and concentrated vectors too.

    Spread: equal vectors of a label are one class before any pairing, and
    are known by a digest afterwards. Ids and filters are counted first; a
    vector moves only to filters that another one has. A filter with more
    than ``block`` classes is cut into blocks and each pair of blocks is a
    task's group; smaller filters are dealt about ``together`` rows to a
    group. No pair becomes a row. As n_links counts every link, the work
    inside one filter of n different vectors is n squared, spread over
    groups."""
    source = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    kind = dict(source.dtypes)["vector"]
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    fit = source.where(usable).withColumn("label", F.concat_ws(":", F.size("vector").cast("string"), "label"))  # vectors of other lengths don't meet
    named = fit.mapInArrow(_digested, f"id long, label string, digest binary, vector {kind}")
    classes = named.groupBy("digest").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = classes.withColumn("no", F.monotonically_increasing_id())
    made = f"digest binary, least_id long, copies long, label string, vector {kind}, no long, filters array<int>"
    listed = written(classes.mapInArrow(_listed(least=least, blocks=blocks, words=words, seeds=seeds, directions=directions, low=low), made), "listed")
    places = listed.select("no", "label", F.explode("filters").alias("f")).select("no", "f", F.xxhash64("label", "f").alias("place"))
    shared = places.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    met = written(places.join(shared, "place"), "met")
    small = max(1, -(-met.where(F.col("n") <= block).count() // together))
    cut = F.ceil(F.col("n") / block).cast("int")
    side = F.pmod(F.xxhash64("no"), cut).cast("int")
    pair = lambda x: F.struct(F.least("side", x).alias("first"), F.greatest("side", x).alias("second"))
    deal = lambda p: F.when(F.col("cut") > 1, F.xxhash64("place", p["first"], p["second"])).otherwise(F.pmod("place", F.lit(small)))
    wanted = met.withColumn("cut", cut).withColumn("side", side).withColumn("pairs", F.transform(F.sequence(F.lit(0), F.col("cut") - 1), pair))
    wanted = wanted.select("no", F.transform("pairs", lambda p: F.struct(deal(p).alias("deal"), "place", "f", "side", p["first"].alias("first"), p["second"].alias("second"))).alias("g"))
    wanted = wanted.groupBy("no").agg(F.flatten(F.collect_list("g")).alias("g"))
    sent = listed.select("no", "label", "copies", "vector", "filters").join(wanted, "no").select("no", "label", "copies", "vector", "filters", F.explode("g").alias("g")).select("no", "label", "copies", "vector", "filters", "g.*")
    found = written(sent.groupBy("deal").applyInArrow(_compare(least), "no long, n long, b long"), "links")
    component = components(found.where("b >= 0").select(F.col("no").alias("a"), "b"))
    least_of = component.join(listed.select(F.col("no").alias("v"), "least_id"), "v").groupBy("component").agg(F.min("least_id").alias("component_id"))
    component = component.join(least_of, "component").select(F.col("v").alias("no"), "component_id")
    counts = found.where("b < 0").groupBy("no").agg(F.sum("n").alias("n"))
    per_class = listed.select("no", "digest", "least_id", "copies").join(counts, "no", "left").join(component, "no", "left")
    per_class = written(per_class.select("digest", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")), "classes")
    out = joined_back(named.select("id", "digest"), per_class, ["digest"], "copies").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    unfit = source.where(~usable).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(unfit).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
