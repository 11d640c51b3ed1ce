"""Repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the least hash
among the word groups of ``group`` words in it, where groups that are common
in the table rank after all others. Consecutive windows with the same
minimiser travel as one packed string of words, a super-k-mer, to the
minimiser's bucket, so equal windows meet in one bucket. There all windows are
sorted, and equal neighbours, compared word by word, are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galvanite.llm.common import Possible, as_bytes, keyed, mix64, partitions, written

#: A null id sorts before all others.
NULL_ID = -(2**63)


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated start, start + 1, ... of each range."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit polynomial hash of every ``width`` neighbours."""
    base, have, span = 0x9FB21C651E98DF25, None, 1
    x, powers = mix64(codes.astype(np.uint64) + np.uint64(1)), {}  # only the spans that add up to the width are kept
    while span <= width:
        if width & span:
            powers[span] = x
        if 2 * span <= width:
            x = x[:-span] * np.uint64(pow(base, span, 1 << 64)) + x[span:] if len(x) > span else x[:0]
        span *= 2
    del x
    at = 0
    for span in sorted(powers, reverse=True):
        part, n = powers.pop(span)[at:], len(codes) - width + 1
        have = part[:n] if have is None else have[:n] * np.uint64(pow(base, span, 1 << 64)) + part[:n]
        at += span
    return have


def read(batches: Iterator[pa.RecordBatch], *names: str, rows: int = 256) -> Iterator[tuple]:
    """Rows of batches, a few at a time as Python values: the named columns
    and the text's UTF-8."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            some = batch.slice(begin, rows)
            yield from zip(*(some[c].to_pylist() for c in names), as_bytes(some["text"]), strict=True)


def pack_arrays(words: list[bytes], *arrays: np.ndarray) -> bytes:
    """Words and integer arrays as one compressed block; integers are stored
    plane by plane of their bytes."""
    head, body = [], []
    for x in arrays:
        head.append(f"{x.dtype.str},{len(x)}")
        body.append(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
    text = b" ".join(words)
    head.append(str(len(text)))
    return zstandard.compress(";".join(head).encode() + b"\n" + b"".join(body) + text, 3)


def unpack_arrays(block: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    raw = zstandard.decompress(block)
    at = raw.index(b"\n")
    *heads, size = raw[:at].decode().split(";")
    out, at = [], at + 1
    for h in heads:
        kind, n = h.split(",")
        kind, n = np.dtype(kind), int(n)
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    text = raw[at : at + int(size)]
    return text.split(b" ") if text else [], out


#: Word groups are counted in this many slots; a slot is common in a task from such a share of its groups on.
SLOTS, SHARE = 1 << 22, 1e-6
#: So many words are counted together; the counts don't depend on it.
COUNTED = 500_000


def group_hashes(flat: np.ndarray, words: list[bytes], group: int) -> np.ndarray:
    """A hash of every ``group`` neighbours of numbered words."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[flat]
    n = len(flat)
    grams = np.zeros(n - group + 1, np.uint64)
    for j in range(group):
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams += hashes[j : n - group + 1 + j]
    return mix64(grams)


def slots(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(SLOTS - 1)).astype(np.int64)


def _common_slots(window: int, group: int, common: int):
    """The slots of word groups that are common in a task: ``common`` of them
    at least. A group with a
    share of the whole table has that share in some task at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        numbers, codes, size, total = _Numbers(), [], 0, 0

        def add() -> None:
            ends = np.cumsum([len(c) for c in codes])
            inside = np.ones(ends[-1] - group + 1, bool)
            inside[(ends[:-1, None] - np.arange(1, group)).ravel()] = False
            np.add(counts, np.bincount(slots(group_hashes(np.concatenate(codes), list(numbers), group)[inside]), minlength=SLOTS), out=counts)
            numbers.clear(), codes.clear()

        for (text,) in read(batches):
            words = text.split()
            if len(words) < window:
                continue
            codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            size, total = size + len(words), total + len(words)
            if size >= COUNTED:
                add()
                size = 0
        if codes:
            add()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts >= max(common, SHARE * total)), pa.int64())], names=["slot"])

    return count


def _super_kmers(window: int, group: int, buckets: int, held: int, common):
    """Sends super-k-mers, one block for each bucket and ``held`` words.

    Equal super-k-mers of one such part are sent once: all but the earliest
    are repeats already, so their places pass their bucket by and are dealt
    evenly, under numbers from ``buckets`` up."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, codes, rows, ids = _Numbers(), [], [], []
        size = 0

        def flush():
            if not codes:
                return
            lengths = np.array([len(c) for c in codes])
            words = sorted(numbers)  # blocks list their words in order, which packs better
            place = np.empty(len(words), np.int32)
            place[np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))] = np.arange(len(words), dtype=np.int32)
            flat = place[np.concatenate(codes)]
            codes.clear()
            firsts = np.cumsum(lengths) - lengths
            value = group_hashes(flat, words, group)
            late = common.value[slots(value)]
            value >>= np.uint64(1)
            value[late] |= np.uint64(1 << 63)
            least = sliding_min(value, window - group + 1)
            del value, late
            begins = ranges(firsts, lengths - window + 1)
            doc = np.repeat(np.arange(len(lengths)), lengths - window + 1)
            value = least[begins]
            new = np.ones(len(begins), bool)
            new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(begins)))
            begin, owner, bucket = begins[at], doc[at], (value[at] % np.uint64(buckets)).astype(np.int64)
            start = begin - firsts[owner]
            row, key = np.array(rows, np.int64)[owner], np.array(ids, np.int64)[owner]
            # equal super-k-mers of this part: keep the earliest
            whole = rolling(flat, window)
            mark = mix64(value[at] + count.astype(np.uint64)) ^ whole[begin] ^ mix64(whole[begin + count - 1])
            del value, new, least, begins, doc, whole
            order = np.lexsort((start, row, key))
            order = order[np.argsort(mark[order], kind="stable")]
            a, b = order[:-1], order[1:]
            same = np.zeros(len(order), bool)
            places = np.flatnonzero((mark[a] == mark[b]) & (count[a] == count[b]))
            if len(places):
                span = count[a[places]] + window - 1
                equal = flat[ranges(begin[a[places]], span)] == flat[ranges(begin[b[places]], span)]
                same[places + 1] = np.minimum.reduceat(equal, np.cumsum(span) - span)
            repeat = np.zeros(len(at), bool)
            repeat[order[same]] = True
            again, first = np.flatnonzero(repeat), np.flatnonzero(~repeat)
            for low in range(0, len(again), 100_000):
                mine = again[low : low + 100_000]
                block = pack_arrays([], row[mine], start[mine].astype(np.uint32), count[mine].astype(np.uint32))
                k = buckets + int(mix64(row[mine[:1]] + low)[0] % np.uint64(buckets))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([block], pa.binary())], names=["bucket", "block"])
            order = first[np.argsort(bucket[first], kind="stable")]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                mine = order[edges[k] : edges[k + 1]]
                text = flat[ranges(begin[mine], count[mine] + window - 1)]
                used, local = np.unique(text, return_inverse=True)
                small = np.uint16 if len(used) <= 65536 else np.uint32
                docs, doc_at = np.unique(owner[mine], return_inverse=True)
                block = pack_arrays([words[i] for i in used], np.array(rows, np.int64)[docs], np.array(ids, np.int64)[docs], doc_at.astype(np.uint32), start[mine].astype(np.uint32), count[mine].astype(np.uint32), local.astype(small))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([block], pa.binary())], names=["bucket", "block"])

        for row, doc_id, text in read(batches, "_row", "doc_id"):
            words = text.split()
            if len(words) < window:
                continue
            codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            rows.append(row)
            ids.append(NULL_ID if doc_id is None else doc_id)
            size += len(words)
            if size >= held:
                yield from flush()
                numbers.clear(), codes.clear(), rows.clear(), ids.clear()
                size = 0
        yield from flush()

    return send


def equal_to_previous(codes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts windows that begin at ``at`` and tells which equal the one before
    them; equal windows keep the order given. The sort is by hash and every
    equality is checked word by word; should two different windows share a
    hash, the sort is by the words themselves."""
    key = rolling(codes, window)[at]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    exact = np.ones(len(a), bool)
    for j in range(window):
        exact &= codes[a + j] == codes[b + j]
    if not exact.all():
        order = np.lexsort([codes[at + j] for j in reversed(range(window))])
        same = np.ones(len(at) - 1, bool)
        for j in range(window):
            same &= codes[at[order[1:]] + j] == codes[at[order[:-1]] + j]
    return order, same


def _repeats(window: int, buckets: int):
    def find(bucket: tuple, table: pa.Table) -> pa.Table:
        if bucket[0].as_py() >= buckets:  # places that are repeats already
            known = [unpack_arrays(block)[1] for block in table["block"].to_pylist()]
            return pa.table({name: np.concatenate([x[i] for x in known]).astype(np.int64) for i, name in enumerate(("_row", "start", "windows"))})
        numbers = _Numbers()
        parts = []
        for block in table["block"].to_pylist():
            words, (rows, ids, doc, start, count, local) = unpack_arrays(block)
            code = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)).astype(np.int32)
            parts.append((rows[doc], ids[doc], start.astype(np.int64), count.astype(np.int64), code[local]))
        row, key, start, count = (np.concatenate([p[i] for p in parts]) for i in range(4))
        codes = np.concatenate([p[4] for p in parts])
        span = count + window - 1
        begin = np.cumsum(span) - span
        order = np.lexsort((start, row, key))
        begin, row, start, count = begin[order], row[order], start[order], count[order]
        at = ranges(begin, count)
        owner = np.repeat(np.arange(len(row)), count)
        place, same = equal_to_previous(codes, at, window)
        found = np.zeros(len(at), bool)
        found[place[1:][same]] = True
        # neighbouring repeats of one super-k-mer become one range
        edge = np.ones(len(at), bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
        first = np.flatnonzero(edge)
        length = np.diff(np.append(first, len(at)))
        first, length = first[found[first]], length[found[first]]
        own = owner[first]
        return pa.table({"_row": row[own], "start": start[own] + at[first] - begin[own], "windows": length})

    return find


_CUT = T.StructType().add("_row", "long").add("doc_id", "long").add("text", "string").add("n_words", "long").add("n_removed", "long")


def _cut(window: int, more: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone = [], [], []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                words = (text or "").encode().split()
                totals.append(len(words))
                if not spans:
                    texts.append(text)
                    gone.append(0)
                    continue
                drop = np.zeros(len(words) + 1, np.int64)
                np.add.at(drop, [s["start"] for s in spans], 1)
                np.add.at(drop, [s["start"] + s["windows"] + window - 1 for s in spans], -1)
                keep = np.cumsum(drop[:-1]) == 0
                texts.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode())
                gone.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays([batch["_row"], batch["doc_id"], pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), *(batch[c] for c in more)], names=[*_CUT.names, *more])

    return cut


def _parted(filled, wanted: bool, more: list[str]):
    """Rows that may lose words, as they are, or those that surely don't, as ``_cut`` gives them."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = Possible.kept(batch, filled.value, wanted)
            own = [some["_row"], some["doc_id"], some["text"]]
            names = ["_row", "doc_id", "text"]
            if not wanted:
                totals = [len(text.split()) for (text,) in read([some])]
                own += [pa.array(totals, pa.int64()), pa.array([0] * len(totals), pa.int64())]
                names = _CUT.names
            yield pa.RecordBatch.from_arrays([*own, *(some[c] for c in more)], names=[*names, *more])

    return part


def repeated_windows(source: DataFrame, window: int, group: int, buckets: int, held: int, common: int) -> DataFrame:
    """(_row, start, windows): runs of windows that also start earlier.

    Common word groups are found first, over the whole table: 4 million flags
    at most, which go to every executor. They only decide to which bucket a
    window goes, so that windows at the edges of a common passage go where
    their rarer words send them."""
    found = source.select("text").mapInArrow(_common_slots(window, group, common), "slot long").distinct().toArrow()["slot"].to_numpy()
    flags = np.zeros(SLOTS, bool)
    flags[found] = True
    sent = source.mapInArrow(_super_kmers(window, group, buckets, held, source.sparkSession.sparkContext.broadcast(flags)), "bucket long, block binary")
    tasks = max(partitions(source.sparkSession), buckets // 2)  # the tasks grow with the buckets, and so with the table
    return sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_repeats(window, buckets), "_row long, start long, windows long")


def substring_dedup(docs: DataFrame, *, text: str | Column = "text", key: str = "doc_id", window: int = 20, group: int = 4, held: int = 2_000_000, bucket_bytes: int = 12 << 20, common: int = 64, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, text, n_words, n_removed,
    and the columns ``carry``.

    Removes each word covered by a window whose words also start earlier: in
    a smaller id, or earlier in the same document. Windows are judged on the
    input. A text that loses nothing is returned as it is (null stays null);
    otherwise the kept words are joined by one space. Words are runs of other
    than ASCII white space. A null id is smaller than any other; rows with
    equal ids are ordered by row key. Texts of fewer words than a window lose
    nothing; an empty table gives an empty result; other columns are not read.

    Spread: buckets follow the table's size, ``bucket_bytes`` of text each;
    a passage that recurs in one part of ``held`` words is sent once from it,
    and the places of its repeats pass its bucket by, so a passage shared by
    a third of all documents reaches its bucket once for each part. Only texts
    that may lose words are shuffled, told by a Bloom filter of their keys. ``docs``
    is read four times and must be a table scan."""
    source = keyed(docs, doc_id=F.col(key).cast("long"), text=F.col(text) if isinstance(text, str) else text)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * partitions(docs.sparkSession), -(-size // bucket_bytes))
    found = repeated_windows(source, window, group, buckets, held, common)
    spans = written(found.groupBy("_row").agg(F.collect_list(F.struct("start", "windows")).alias("spans")), "spans")
    whole = keyed(docs, doc_id=F.col(key).cast("long"), text=F.col(text) if isinstance(text, str) else text, **{f"_of_{c}": F.col(c) for c in carry})
    wanted = Possible(spans.select("_row"))
    marked, more = wanted.marked(whole, "_row"), [whole.schema[f"_of_{c}"] for c in carry]
    names, schema = [f.name for f in more], T.StructType([*_CUT.fields, *more])
    losing = marked.mapInArrow(_parted(wanted.shared, True, names), T.StructType([*_CUT.fields[:3], *more])).join(spans, "_row", "left")
    out = losing.mapInArrow(_cut(window, names), schema).unionByName(marked.mapInArrow(_parted(wanted.shared, False, names), schema))
    return out.select(*_CUT.names, *(F.col(f"_of_{c}").alias(c) for c in carry))
