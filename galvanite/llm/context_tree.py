"""Language-model scores by context-tree weighting.

Each byte is eight binary decisions; a node is the bits decided so far. Its
contexts are the bytes before it, up to a depth. A Krichevsky-Trofimov
estimate stands at every node of every depth, and the weighted probability
mixes all depths: at each node, half for its own estimate and half for its
deeper contexts. Trained counts fix the mixing weights, so a byte's
probability depends on the bytes before it alone, and each distinct gram
(context and byte) is scored once.

A document is spelled as its words, one space between, and a line feed for the
end; contexts before its start are spaces. Words hold no white space, so the
spelling gives the tokens back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.llm.common import as_bytes, keyed, mix64, partitions, written
from galvanite.llm.substring_dedup import pack_arrays, unpack_arrays

#: A gram has one byte more than the depth, and one byte of a 64-bit number is kept free for a row's place or a flag.
DEPTH = 6
_U8 = np.uint64(8)
#: Contexts whose last three bytes are equal share a bucket, so all of a tree below its third level is in one bucket.
_SPLIT = 3


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram at every byte of the spelled texts, and each text's length."""
    raw = np.frombuffer(b"".join(b" " * depth + t for t in texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    out = raw.astype(np.uint64)
    for d in range(1, depth + 1):
        out[d:] |= raw[:-d].astype(np.uint64) << np.uint64(8 * d)
    inside = np.ones(len(raw), bool)
    starts = np.cumsum(lengths + depth) - lengths - depth
    inside[(starts[:, None] + np.arange(depth)).ravel()] = False
    return out[inside], lengths


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


def spelled(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def buckets_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64((gram >> _U8) & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(gram: np.ndarray, buckets: int, *more: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The parts of a sorted array of grams, and what belongs to them, by bucket."""
    bucket = buckets_of(gram, buckets)
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 65536 else np.int64), kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        mine = order[edges[k] : edges[k + 1]]
        yield k, (gram[mine], *(x[mine] for x in more))


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _summed(gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(gram, kind="stable")
    key, n = runs(gram[order])
    return key, np.add.reduceat(count[order], np.cumsum(n) - n) if len(key) else count[:0]


def _parts(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of about ``size`` bytes and at most 256 texts."""
    low, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size or i - low == 255 or i == len(texts) - 1:
            yield low, i + 1
            low, total = i + 1, 0


def _gram_counts(depth: int, buckets: int, held: int):
    """Each task's grams with their counts in training rows (0 if only in
    others), sorted and packed for their buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def flush():
            key = np.concatenate(parts)
            parts.clear()
            key.sort()
            key, n = runs(key)
            g, learnt = key >> _U8, (key & np.uint64(1)).astype(np.int64)
            del key
            g, twice = runs(g)
            c = np.add.reduceat(n * learnt, np.cumsum(twice) - twice)
            for k, (mine, own) in _by_bucket(g, buckets, c):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pack_arrays([], _steps(mine), own)], pa.binary())], names=["bucket", "block"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                learn = rows["learn"].to_numpy(zero_copy_only=False)
                texts = [spelled(t) for t in as_bytes(rows["text"])]
                for low, high in _parts(texts):
                    g, lengths = grams(texts[low:high], depth)
                    parts.append((g << _U8) | np.repeat(learn[low:high], lengths))
                    size += len(g)
                    if size >= held:
                        yield from flush()
                        size = 0
        if size:
            yield from flush()

    return count


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    parts = [unpack_arrays(b)[1] for b in table["block"].to_pylist()]
    g, c = _summed(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts]))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([pack_arrays([], _steps(g), c)], pa.binary())})


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0, by Stirling's series after seven steps up."""
    up = x.copy()
    for i in range(1, 7):
        up = up * (x + i)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(up)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - log(pi)


def shorter(key: np.ndarray, depth: int) -> np.ndarray:
    """The same node in the context without its farthest byte."""
    return (((key >> _U8) & np.uint64((1 << (8 * (depth - 1))) - 1)) << _U8) | (key & np.uint64(255))


def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of a node's own estimate, and ln of its weighted probability:
    half for its own estimate, half for its deeper contexts."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.logaddexp(own, below) - log(2)


class Level:
    """Nodes of one depth: counts, the share of their own estimate and the
    sums that the next shorter depth needs."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.key = key
        own = log_kt(n0, n1)
        self.stop, self.mixed = (np.ones(len(key)), own) if below is None else weigh(own, below)
        self.n0, self.n1 = n0, n1
        self.one = (n1 + 0.5) / (n0 + n1 + 1)

    def up(self, depth: int) -> Level:
        key, at = np.unique(shorter(self.key, depth), return_inverse=True)
        return Level(key, *(np.bincount(at, weights=x, minlength=len(key)) for x in (self.n0, self.n1, self.mixed)))


def leaves(gram: np.ndarray, count: np.ndarray, depth: int) -> tuple[Level, np.ndarray, np.ndarray]:
    """The level of full contexts; the place in it of each gram's eight
    decisions, and the decisions."""
    byte = gram & np.uint64(255)
    bits = np.arange(8, dtype=np.uint64)[:, None]
    node = (np.uint64(1) << bits) + (byte >> (_U8 - bits))
    one = ((byte >> (np.uint64(7) - bits)) & np.uint64(1)) == 1
    key, at = np.unique(((gram >> _U8) << _U8) | node, return_inverse=True)
    at = at.reshape(one.shape)
    weights = np.broadcast_to(count, one.shape).ravel().astype(float)
    n1 = np.bincount(at.ravel(), weights=weights * one.ravel(), minlength=len(key))
    return Level(key, np.bincount(at.ravel(), weights=weights, minlength=len(key)) - n1, n1, None), at, one


def _tops(depth: int):
    """Sums of each bucket for the nodes of the depth above its own."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["block"].to_pylist():
                steps, count = unpack_arrays(block)[1]
                level, _, _ = leaves(np.cumsum(steps, dtype=np.uint64), count, depth)
                for d in range(depth, _SPLIT, -1):
                    level = level.up(d)
                key, at = np.unique(shorter(level.key, _SPLIT), return_inverse=True)
                sums = (np.bincount(at, weights=x, minlength=len(key)) for x in (level.n0, level.n1, level.mixed))
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *map(pa.array, sums)], names=["key", "n0", "n1", "below"])

    return tops


def _down(levels: dict[int, Level], start: int, key: np.ndarray, p1: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Carries the mixture from depth ``start`` down: at each node the
    probability of a one so far, and the weight left for deeper contexts."""
    for d in range(start + 1, max(levels) + 1):
        level = levels[d]
        over = np.searchsorted(key, shorter(level.key, d))
        key, p1, rest = level.key, p1[over] + rest[over] * level.stop * level.one, rest[over] * (1 - level.stop)
    return key, p1, rest


def _gram_scores(depth: int, first):
    """Log probabilities of each bucket's grams, from what lies above."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, block in zip(batch["bucket"].to_pylist(), batch["block"].to_pylist(), strict=True):
                steps, count = unpack_arrays(block)[1]
                low, at, one = leaves(np.cumsum(steps, dtype=np.uint64), count, depth)
                levels = {depth: low}
                for d in range(depth, _SPLIT, -1):
                    levels[d - 1] = levels[d].up(d)
                _, p1, _ = _down(levels, _SPLIT - 1, *first.value)
                logp = np.log(np.where(one, p1[at], 1 - p1[at])).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([pack_arrays([], steps, count, logp)], pa.binary())], names=["bucket", "block"])

    return score


def gram_model(docs: DataFrame, depth: int, buckets: int, held: int = 10_000_000) -> DataFrame:
    """(bucket, block): every gram of ``docs`` (text, learn) in its bucket,
    with its count in learnt rows and the natural log probability of its byte.

    Grams are counted in each task and travel as sorted, packed blocks. A
    bucket holds whole subtrees below three-byte contexts; what lies above,
    255 nodes for at most 65,536 contexts of two bytes, is summed over
    buckets, mixed on the driver and handed back."""
    sent = docs.mapInArrow(_gram_counts(depth, buckets, held), "bucket long, block binary")
    merged = written(sent.groupBy("bucket").applyInArrow(_merge, "bucket long, block binary"), "grams")
    sums = merged.mapInArrow(_tops(depth), "key long, n0 double, n1 double, below double").groupBy("key").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).toArrow().sort_by("key")
    top = _SPLIT - 1
    levels = {top: Level(sums["key"].to_numpy().astype(np.uint64), *(sums[i].to_numpy() for i in (1, 2, 3)))}
    for d in range(top, 0, -1):
        levels[d - 1] = levels[d].up(d)
    root = levels[0]
    first = _down(levels, 0, root.key, root.stop * root.one, 1 - root.stop)
    shared = docs.sparkSession.sparkContext.broadcast(first)
    return written(merged.mapInArrow(_gram_scores(depth, shared), "bucket long, block binary"), "model")


def common_grams(model: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest grams, up to ``most`` and all those of a count or none,
    and their log probabilities: the part of the model that every executor
    holds. Sorted."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["block"].to_pylist():
                c, n = np.unique(np.minimum(unpack_arrays(block)[1][1], 1 << 20), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["c", "n"])

    total, least = 0, 1 << 62
    for c, n in sorted(((r["c"], r["n"]) for r in model.mapInArrow(tally, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()), reverse=True):
        total += n
        if total > most:
            break
        least = c

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["block"].to_pylist():
                steps, c, logp = unpack_arrays(block)[1]
                keep = c >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(steps, dtype=np.uint64)[keep].view(np.int64)), pa.array(logp[keep])], names=["gram", "logp"])

    found = model.mapInArrow(pick, "gram long, logp double").toArrow()
    gram, logp = found["gram"].to_numpy().view(np.uint64), found["logp"].to_numpy()
    order = np.argsort(gram)
    return gram[order], logp[order]


def _row_sums(depth: int, buckets: int, common, held: int):
    """Looks up each row's grams among the common ones; the others go to
    their buckets, packed with the rows that need them."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = common.value
        missing, owners, counts, rows, sums, size = [], [], [], [], [], 0

        def flush():
            row, done = np.concatenate(rows), np.concatenate(sums)
            g, o, n = (np.concatenate(x) for x in (missing, owners, counts))
            order = np.argsort(g, kind="stable")
            g, o, n = g[order], o[order], n[order]
            parts = [(k, mine) for k, mine in _by_bucket(g, buckets, o, n)] or [(0, (g, o, n))]
            for k, (mine, own, many) in parts:
                owner, at = np.unique(own, return_inverse=True)
                block = pack_arrays([], _steps(mine), owner, at.astype(np.uint32), many.astype(np.uint32), row, done)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([block], pa.binary())], names=["bucket", "block"])
                row, done = row[:0], done[:0]  # what is done already travels once
            for x in (missing, owners, counts, rows, sums):
                x.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = [spelled(t) for t in as_bytes(part["text"])]
                row = part["_row"].to_numpy()
                for low, high in _parts(texts):
                    g, lengths = grams(texts[low:high], depth)
                    key = (g << _U8) | np.repeat(np.arange(high - low, dtype=np.uint64), lengths)
                    key.sort()
                    key, n = runs(key)
                    g, doc = key >> _U8, (key & np.uint64(255)).astype(np.int64)
                    at = np.minimum(np.searchsorted(known, g), max(0, len(known) - 1))
                    hit = known[at] == g if len(known) else np.zeros(len(g), bool)
                    own = value[at[hit]] * n[hit] if len(known) else np.zeros(0)
                    sums.append(np.bincount(doc[hit], weights=own, minlength=high - low).astype(float))
                    rows.append(row[low:high])
                    missing.append(g[~hit]), owners.append(row[low:high][doc[~hit]]), counts.append(n[~hit])
                    size += len(missing[-1]) + high - low
                    if size >= held:
                        yield from flush()
                        size = 0
        if rows:
            yield from flush()

    return look


def _fill(key: tuple, asked: pa.Table, model: pa.Table) -> pa.Table:
    blocks = model["block"].to_pylist()
    gram, logp = np.zeros(0, np.uint64), np.zeros(0)
    if blocks:
        steps, _, logp = unpack_arrays(blocks[0])[1]
        gram = np.cumsum(steps, dtype=np.uint64)
    rows, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
    for block in asked["block"].to_pylist():
        steps, own, at, many, row, done = unpack_arrays(block)[1]
        found = logp[np.searchsorted(gram, np.cumsum(steps, dtype=np.uint64))] * many
        rows += [own, row]
        sums += [np.bincount(at, weights=found, minlength=len(own)), done]
    row, at = np.unique(np.concatenate(rows), return_inverse=True)
    return pa.table({"_row": row, "logp": np.bincount(at, weights=np.concatenate(sums), minlength=len(row)).astype(float)})


def _word_counts(held: int):
    """Distinct tokens of a task's part, with their counts in training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush():
            words = list(seen)
            for low in range(0, len(words), 50_000):
                part = words[low : low + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], names=["word", "c"])
            seen.clear()

        for batch in batches:
            for text in as_bytes(batch["text"]):
                seen.update(text.lower().split())
                seen[b""] += 1  # the end token
                if len(seen) > held:
                    yield from flush()
        yield from flush()

    return count


def _token_sums(common: dict[bytes, int], total: int, distinct: int):
    """Base scores of the common tokens of each row; the rest are listed."""
    base = {w: np.log10((c + 1) / (total + distinct + 1)) for w, c in common.items()}

    def part_scores(part: pa.RecordBatch) -> pa.RecordBatch:
        n_tokens, known, low, sizes, edges, rare, times = [], [], [], [], [0], [], []
        for text in as_bytes(part["text"]):
            words = text.lower().split()
            words.append(b"")
            k, b = 0, 0.0
            for w, n in Counter(words).items():
                if w in base:
                    k += n
                    b += n * base[w]
                else:
                    rare.append(w)
                    times.append(n)
            n_tokens.append(len(words)), known.append(k), low.append(b), sizes.append(len(text)), edges.append(len(rare))
        rest = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
        rest = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rest)
        return pa.RecordBatch.from_arrays([part["_row"], part["doc_id"], pa.array(sizes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(low, pa.float64()), rest], names=["_row", "doc_id", "n_bytes", "n_tokens", "known", "base", "rest"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                yield part_scores(batch.slice(low, 500))

    return score


def score_documents(docs: DataFrame, learn: Column, *, text: str = "text", key: str = "doc_id", depth: int = DEPTH, words: int = 100_000, common: int = 3_000_000, bucket_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte per row.

    Tokens are runs of other than ASCII white space with A-Z lower-cased, and
    one end. score is the model's log10 probability of the tokens, base_score
    that of single-token counts with one added: log10((c + 1) / (N + V + 1))
    for a token with count c, N tokens and V distinct ones in training.
    bits_per_byte is the code length of the text as spelled here, with its
    end, over the bytes of the text as given (null if none).
    A null text is empty and has the end token only; rows with a null id are
    scored and, if ``learn`` is null for them, not learnt from. Repeated rows
    count each. An empty table gives an empty result.

    Spread: tokens and grams are counted in each task before the shuffle. The
    ``words`` commonest tokens and ``common`` commonest grams go to all
    executors (bounds of a few and of some 50 MB); only the others, rare by
    choice, are joined by key, so no key is hot. Every token and gram has its
    own count either way. Buckets of grams follow the table's size,
    ``bucket_bytes`` of text each. ``docs`` is read several times and must be a
    table scan."""
    spark = docs.sparkSession
    source = keyed(docs, doc_id=F.col(key).cast("long"), text=F.col(text), learn=F.coalesce(learn, F.lit(False)))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * partitions(spark), -(-size // bucket_bytes))
    model = gram_model(source.select("text", "learn"), depth, buckets)
    shared = spark.sparkContext.broadcast(common_grams(model, common))
    asked = source.select("_row", "text").mapInArrow(_row_sums(depth, buckets, shared, 2_000_000), "bucket long, block binary")
    scores = asked.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(_fill, "_row long, logp double").groupBy("_row").agg(F.sum("logp").alias("logp"))

    counts = written(source.where("learn").select("text").mapInArrow(_word_counts(400_000), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"]
    top = {bytes(r["word"]): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(words).collect()}
    tokens = spark.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _token_sums(tokens.value, total, distinct)(batches)

    part = source.select("_row", "doc_id", "text").mapInArrow(run, "_row long, doc_id long, n_bytes long, n_tokens long, known long, base double, rest array<struct<word:binary,n:long>>")
    part = part.select("_row", "doc_id", "n_bytes", "n_tokens", "known", "base", F.explode_outer("rest").alias("r"))
    none = F.concat(F.lit(" "), F.col("_row").cast("string")).cast("binary")  # no token holds a blank: rows without a rare one match nothing, each by a key of its own
    part = part.select("*", F.coalesce("r.word", none).alias("word"), F.col("r.n").alias("n")).drop("r").join(counts, "word", "left")
    own = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total + distinct + 1)))
    bases = part.groupBy("_row").agg(
        *(F.first(x).alias(x) for x in ("doc_id", "n_bytes", "n_tokens", "known", "base")),
        F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0)).alias("more"),
        F.coalesce(F.sum(F.col("n") * own), F.lit(0.0)).alias("more_base"),
    )
    score = F.col("logp") / log(10)
    bits = F.when(F.col("n_bytes") > 0, -F.col("logp") / log(2) / F.col("n_bytes"))
    return bases.join(scores, "_row").select("doc_id", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.col("more_base")).alias("base_score"), score.alias("score"), bits.alias("bits_per_byte"))
