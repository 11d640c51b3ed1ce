"""Near duplicates by circulant MinHash.

Two permutations make every signature coordinate: the first scatters the
shingles, the second ranks them, and coordinate k ranks after a circular shift
by k. Equal bands of coordinates propose documents, which meet at the first
one that has the band; there full shingle sets are intersected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galvanite.llm.common import Possible, as_bytes, joined_back, lists, mix64, removed, written
from galvanite.llm.components import components


class _Hashes(dict):
    """Hashes of words, up to a bound, so that common words are hashed once."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = value
        return value


def shingles(text: bytes, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text: ``words`` lower-cased
    words in a row, or all of a shorter text; none if it has no word."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, np.uint64(len(h) if len(h) < words else 0), np.uint64)
    for j in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
    return np.unique(out)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: a row of ``coordinates`` for each.

    The first permutation scatters a shingle's hash (its upper half is kept, a
    32-bit number; two shingles of a set share one with probability 2^-32).
    Coordinate k is the least second permutation of the scattered numbers,
    circularly shifted by k."""
    flat = (mix64(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((coordinates, len(sets)), np.uint32)
    x, high = np.empty_like(flat), np.empty_like(flat)
    for k in range(coordinates):
        np.add(flat, np.uint32(k), out=x)
        x *= np.uint32(0x9E3779B1)
        np.right_shift(x, np.uint32(15), out=high)
        x ^= high
        x *= np.uint32(0x85EBCA77)
        np.right_shift(x, np.uint32(13), out=high)
        x ^= high
        np.minimum.reduceat(x, begin, out=out[k])
    return out.T


def bands_for(percent: int, rows: int, miss: float) -> int:
    """How many bands of ``rows`` coordinates leave a pair at ``percent``
    similarity without a common one with probability ``miss`` at most."""
    return 1 if percent >= 100 else ceil(log(miss) / log(1 - (percent / 100) ** rows))


def _parts(batch: pa.RecordBatch, size: int = 2 << 20, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of at most ``rows`` rows and about ``size`` bytes of text."""
    for begin in range(0, batch.num_rows, rows):
        some = batch.slice(begin, rows)
        texts = as_bytes(some["text"])
        low, total = 0, 0
        for i, text in enumerate(texts):
            total += len(text)
            if total >= size or i == len(texts) - 1:
                yield some.slice(low, i + 1 - low), texts[low : i + 1]
                low, total = i + 1, 0


def _signed(words: int, bands: int, rows: int, carry: Sequence[str]):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part, texts in _parts(batch):
                sets = [shingles(t, words, hashes) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), bands), np.uint64)
                if full:
                    low = signatures([sets[i] for i in full], bands * rows).reshape(len(full), bands, rows).astype(np.uint64)
                    mixed = np.zeros((len(full), bands), np.uint64)
                    for r in range(rows):
                        mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + low[:, :, r])
                    keys[full] = mixed + np.arange(bands, dtype=np.uint64)
                counts = np.array([bands * (len(s) > 0) for s in sets])
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists(keys[counts > 0].ravel().view(np.int64), counts, pa.int64()), *(part[c] for c in carry)], names=["doc_id", "n_shingles", "digest", "bands", *carry])

    return sign


def _full_sets(words: int, wanted):
    """The full set of each row that may be wanted, named by id and digest;
    a task gives a set once for an id, however often the row repeats."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, given = _Hashes(), set()
        for batch in batches:
            for part, texts in _parts(Possible.kept(batch, wanted.value)):
                ids, digests, sets = [], [], []
                for own, text in zip(part["doc_id"].to_pylist(), texts, strict=True):
                    found = shingles(text, words, hashes).tobytes()
                    digest = hashlib.blake2b(found, digest_size=16).digest()
                    if found and (own, digest) not in given:
                        given.add((own, digest))
                        ids.append(own), digests.append(digest), sets.append(found)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "digest", "shingles"])

    return build


def linked(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (i < j) with 100 * intersection >= percent * union, exactly.

    Shingles of few sets add to the counts of their pairs one by one; those of
    many sets are counted together as a product of 0/1 matrices."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    if n < 2:
        return
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    count = np.diff(np.append(first, len(flat)))
    common = np.zeros((n, n), np.float32)
    many = 16
    for c in range(2, many + 1):
        at = first[count == c]
        if len(at):
            own = owner[at[:, None] + np.arange(c)]
            for i in range(c):
                for j in range(i + 1, c):
                    np.add.at(common, (own[:, i], own[:, j]), 1)
    wide = np.flatnonzero(count > many)
    for low in range(0, len(wide), 4096):
        part = wide[low : low + 4096]
        grid = np.zeros((n, len(part)), np.float32)
        for column, k in enumerate(part.tolist()):
            grid[owner[first[k] : first[k] + count[k]], column] = 1
        common += grid @ grid.T
    common = np.rint(np.triu(common, 1)).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    for i, j in np.argwhere(np.triu(100 * common >= percent * union, 1)).tolist():
        yield i, j


def spanning(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """A forest with the components of the pairs."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _verify(percent: int):
    def verify(table: pa.Table) -> pa.Table:
        ids, at = np.unique(table["id"].to_numpy(), return_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].take(pa.array(at)).to_pylist()]
        forest = spanning(len(sets), linked(sets, percent))
        return pa.table({"a": pa.array([ids[i] for i, _ in forest], pa.int64()), "b": pa.array([ids[j] for _, j in forest], pa.int64())})

    return verify


def _confirmed(source: DataFrame, classes: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): a forest of the links inside each group of ``groups`` (id, groups)."""
    plan = written(groups.join(classes.select("id", "digest", "least_id"), "id").select("id", "digest", F.col("least_id").alias("doc_id"), "groups"), "plan")
    wanted = Possible(plan.select("doc_id"))
    sets = wanted.marked(source.select("doc_id", "text"), "doc_id").mapInArrow(_full_sets(words, wanted.shared), "doc_id long, digest binary, shingles binary")
    sets = sets.join(plan, ["doc_id", "digest"]).select(F.explode("groups").alias("g"), "id", "shingles")
    links = written(sets.groupBy("g").applyInArrow(_verify(percent), "a long, b long"), "links")
    removed(plan)
    return links


def near_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, rows: int = 6, miss: float = 1e-5, block: int = 256, most: int = 1 << 20, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept and
    the columns ``carry`` (of other names than these and ``text``).

    Two documents are linked if 100 * intersection >= percent * union of
    their sets of distinct ``words``-word shingles, counted on the shingles'
    64-bit hashes. component_id is the smallest id that links reach. A null or
    empty text, or one without words, has no shingle and no link. Different
    texts under one id are linked each on its own; a row with a null id links
    with nothing. An empty table gives an empty result; other columns are not
    read.

    Recall: there are as many bands of ``rows`` coordinates as leave a pair
    just at ``percent`` without a common band with probability ``miss`` at
    most (and then it only counts as unlinked if no other path joins the two).

    Spread: documents with equal sets become one class before any pairing.
    Classes that share a band meet at the first class that has it, their hub.
    A hub's classes are dealt to chunks of about ``block`` classes, or fewer with ``most``
    shingles together, the hub itself to all of
    them, and each chunk's full sets are compared in one task. Classes of one
    hub that no confirmed link has joined by then, which takes texts that share bands and
    are not similar, are compared across chunks: what is not in the hub's
    largest component, in blocks, with all of the hub, in blocks, where sizes
    allow a link at all. So no group exceeds two blocks of bounded count and size (or two documents), every pair with a
    common band is compared or joined already, and no pair is a row, only a
    forest of confirmed links. ``docs`` is read two or three times."""
    bands = bands_for(percent, rows, miss)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry)
    signed = written(source.mapInArrow(_signed(words, bands, rows, carry), ", ".join(["doc_id long, n_shingles long, digest binary, bands array<long>", *(f"{c} {source.schema[c].dataType.simpleString()}" for c in carry)])), "signed")
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # an id of its own: one doc_id may be the least of several classes
    keys = classes.select("id", "size", F.explode("bands").alias("band"))
    hubs = written(keys.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("k")).where("k > 1"), "hubs")
    met = written(joined_back(keys, hubs, ["band"], "k").where("hub is not null").select("hub", "id", "size").distinct(), "met")
    load = lambda size: F.lit(1.0) / block + size / F.lit(most)
    counts = written(met.groupBy("hub").agg(F.count("*").alias("n"), F.sum(load(F.col("size"))).alias("load")), "counts")
    met = joined_back(met, counts, ["hub"], "n")
    chunks = F.ceil("load").cast("int")
    own = F.when(F.col("hub") == F.col("id"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), chunks).cast("int")))
    first = met.select("id", F.transform(own, lambda x: F.concat_ws(":", "hub", x)).alias("own")).groupBy("id").agg(F.flatten(F.collect_list("own")).alias("groups"))
    found = components(_confirmed(source, classes, first, words, percent))
    large = met.where(chunks > 1).select("hub", "id", "size")
    second = written(_across(large, found, percent, load), "across")
    if not second.isEmpty():
        more = _confirmed(source, classes, second, words, percent)
        for x in "ab":  # links between components
            more = more.join(found.withColumnRenamed("v", x), x, "left").select(F.coalesce("component", x).alias(x), "b" if x == "a" else "a")
        joined = components(more)
        found = found.join(joined.select(F.col("v").alias("component"), F.col("component").alias("later")), "component", "left").select("v", F.coalesce("later", "component").alias("component"))
        alone = joined.join(found.select("v"), "v", "left_anti")  # vertices without an earlier link
        found = written(found.unionByName(alone), "found")
    least_of = found.join(classes.select(F.col("id").alias("v"), "least_id"), "v").groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = found.join(least_of, "component").select(F.col("v").alias("id"), "component_id")
    of_class = classes.select("digest", "id", "least_id").join(named, "id", "left").select("digest", F.coalesce("component_id", "least_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest", *carry).join(of_class, "digest", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), *carry)


def _numbered(members: DataFrame, load: Callable[[Column], Column]) -> DataFrame:
    """Adds ``at``, the block of each class of (hub, id, size): blocks follow
    size, and each takes classes of a load of 1 together. Windows run over the
    sizes of a hub, not over its classes."""
    bins = members.groupBy("hub", "size").agg(F.count("*").alias("k"))
    own = F.col("k") * load(F.col("size"))
    before = F.sum(own).over(Window.partitionBy("hub").orderBy("size")) - own
    place = F.col("before") + F.pmod(F.xxhash64("id"), F.col("k")) * load(F.col("size"))
    return joined_back(members, written(bins.withColumn("before", before), "bins"), ["hub", "size"], "k").withColumn("at", F.floor(place)).drop("k", "before")


def _across(met: DataFrame, found: DataFrame, percent: int, load: Callable[[Column], Column]) -> DataFrame:
    """(id, groups): pairs of blocks that compare the classes of a hub which
    links have not joined. None for a hub that is one component."""
    named = written(met.join(found.withColumnRenamed("v", "id"), "id", "left").select("hub", "id", "size", F.coalesce("component", "id").alias("c")), "large")
    parts = named.groupBy("hub", "c").agg(F.count("*").alias("k")).groupBy("hub").agg(F.max(F.struct("k", "c"))["c"].alias("most"), F.count("*").alias("m"), F.sum("k").alias("n")).where("m > 1")
    open_ = joined_back(named, written(parts, "parts"), ["hub"], "n").where("most is not null").select("hub", "id", "size", "c", "most")
    every, stray = _numbered(open_, load), _numbered(open_.where("c <> most"), load)
    edges = lambda side, name: side.groupBy("hub", F.col("at").alias(name)).agg(F.min("size").alias(f"low_{name}"), F.max("size").alias(f"high_{name}"))
    near = lambda low, high: F.col(low) * percent <= F.col(high) * 100
    pairs = edges(stray, "x").join(edges(every, "y"), "hub").where(near("low_x", "high_y") & near("low_y", "high_x"))
    pairs = pairs.select("hub", "x", "y", F.concat_ws(":", "hub", "x", "y").alias("g"))
    groups = lambda side, name: side.join(pairs, (side["hub"] == pairs["hub"]) & (side["at"] == pairs[name])).select("id", "g")
    return groups(stray, "x").unionByName(groups(every, "y")).groupBy("id").agg(F.collect_set("g").alias("groups"))
