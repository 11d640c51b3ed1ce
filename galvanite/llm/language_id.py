"""Language identification by rank-order profiles.

A profile is a list of the most frequent n-grams, most frequent first. A
document's distance to a language is the sum, over its own profile, of how far
out of place each n-gram stands in the language's profile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galvanite.llm.common import as_bytes

#: Bytes as symbols: 0 for all that is no letter, A-Z as a-z, bytes of non-ASCII characters as they are.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 155)
_BASE = 155
#: Bytes of text that are taken at a time: into one look for n-grams, and out of one batch of rows.
SLICE, PART = 1 << 18, 1 << 20
#: n-grams of 1 to 3 symbols as one number.
GRAMS = _BASE + _BASE**2 + _BASE**3


def _codes(symbols: np.ndarray) -> list[np.ndarray]:
    """n-grams that begin at each symbol, -1 where there is none: single
    letters; pairs and triples with at least one letter and no gap inside."""
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    one = np.where(a > 0, a, -1)
    two = np.where((a > 0) | (b > 0), _BASE + a * _BASE + b, -1)
    three = np.where((b > 0) & ((a > 0) | (c > 0)), _BASE + _BASE**2 + (a * _BASE + b) * _BASE + c, -1)
    return [one, two, three]


def grams(texts: list[bytes], owner: np.ndarray, size: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count), summed over the texts of each owner. Works
    through ``size`` bytes at a time, so a very long text needs no more room
    than its distinct n-grams."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(parts: list[bytes], owners: list[int]) -> None:
        lengths = np.array([len(p) for p in parts])
        symbols = _SYMBOL[np.frombuffer(b"".join(parts), np.uint8)]
        own = np.repeat(np.array(owners, np.int64), lengths)[:-2]
        found = [(own[code >= 0] * GRAMS + code[code >= 0]) for code in _codes(symbols)]
        k, n = np.unique(np.concatenate(found), return_counts=True)
        keys.append(k)
        counts.append(n)

    held, held_owner, total = [], [], 0
    for text, own in zip(texts, owner.tolist(), strict=True):
        for low in range(0, max(1, len(text)), size):
            # two gaps end a text, a slice of a longer one overlaps the next by two bytes
            last = low + size >= len(text)
            piece = b" " * (low == 0) + text[low : low + size + 2 * (not last)] + b"  " * last
            held.append(piece)
            held_owner.append(own)
            total += len(piece)
            if not last:
                add(held, held_owner)
                held, held_owner, total = [], [], 0
        if total >= size:
            add(held, held_owner)
            held, held_owner, total = [], [], 0
    if held:
        add(held, held_owner)
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)
    return k // GRAMS, k % GRAMS, n


def _batches(lengths: Sequence[int], size: int) -> Iterator[tuple[int, int]]:
    low, total = 0, 0
    for i, length in enumerate(lengths):
        total += length
        if total >= size or i == len(lengths) - 1:
            yield low, i + 1
            low, total = i + 1, 0


def _parts(batch: pa.RecordBatch, text: str = "text", size: int = PART) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in runs of rows with about ``size`` bytes of text, and their
    texts, so that a task holds a second copy of such a run only."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch[text]), 0).to_numpy()
    for low, high in _batches(lengths.tolist(), size):
        part = batch.slice(low, high - low)
        yield part, as_bytes(part[text])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch["lang"].dictionary_encode()
        owner, low = coded.indices.to_numpy(), 0
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part, texts in _parts(batch):
            o, g, c = grams(texts, owner[low : low + part.num_rows])
            low += part.num_rows
            key, at = np.unique(np.append(key, o * GRAMS + g), return_inverse=True)
            count = np.bincount(at, weights=np.append(count, c)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key // GRAMS)), pa.array(key % GRAMS, pa.int64()), pa.array(count, pa.int64())], names=["lang", "gram", "n"])


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", top: int = 400) -> DataFrame:
    """(lang, gram, place): each language's ``top`` n-grams from all rows with
    a language, ties by the n-gram's number. Null texts count as empty."""
    from pyspark.sql.window import Window

    counted = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(_counted, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return total.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < top).select("lang", "gram", "place")


def rank(owner: np.ndarray, gram: np.ndarray, n: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's ``top`` n-grams and their places; owners ascend."""
    order = np.lexsort((gram, -n, owner))
    owner, gram = owner[order], gram[order]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    keep = place < top
    return owner[keep], gram[keep], place[keep]


def _predicted(languages: list[str], profiles: list[tuple[np.ndarray, np.ndarray]], top: int, carry: list[str], text: str = "text"):
    """profiles: each language's n-grams and their places."""
    known = np.unique(np.concatenate([gram for gram, _ in profiles]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = unseen(1, len(known))[0]
        column[known] = np.arange(len(known))
        places = np.full((len(languages), len(known) + 1), top, np.min_scalar_type(-top - 1))
        for k, (gram, place) in enumerate(profiles):
            places[k, column[gram]] = place
        for batch in batches:
            for part, texts in _parts(batch, text):
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                for low, high in _batches([len(x) for x in texts], SLICE):
                    owner, gram, place = rank(*grams(texts[low:high], np.arange(high - low)), top)
                    at = column[gram]
                    far = np.zeros((len(languages), high - low))
                    for k in range(len(languages)):
                        there = places[k][at]
                        far[k] = np.bincount(owner, weights=np.where(there < top, np.abs(there - place), top), minlength=high - low)
                    far = far / np.maximum(1, np.bincount(owner, minlength=high - low) * top)
                    best[low:high] = far.argmin(axis=0)
                    score[low:high] = 1 - far.min(axis=0)
                named = pa.array(languages, pa.string()).take(pa.array(best))
                letters = part["letters"]
                named = pa.compute.if_else(letters, named, "und")
                own = pa.array(np.where(letters.to_numpy(zero_copy_only=False), np.clip(score, 0, 1), 0.0))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in carry), named, own], names=[*carry, "lang_pred", "score"])

    return predict


def unseen(languages: int, top: int) -> np.ndarray:
    """A row of numbers for all n-grams, ``top`` in each: two bytes each while
    they suffice, as every Python worker holds them. A task needs one row, the
    columns of a smaller table, however many languages there are."""
    return np.full((languages, GRAMS), top, np.min_scalar_type(-top - 1))


def predict(docs: DataFrame, model: DataFrame, *, text: str | Column = "text", key: str = "doc_id", top: int = 400, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score for each row, or the columns ``carry`` in
    place of doc_id. score is one less the mean
    distance of an n-gram as a share of the largest one. A text that is null
    or has no letter (or a model without languages) gives ``und`` and 0.
    Ties go to the first language by name. The model, ``top`` rows for each
    language, goes to the executors."""
    rows = model.collect()
    languages = sorted({r["lang"] for r in rows})
    held = [F.col(c).alias(f"_{c}") for c in carry] or [F.col(key).cast("long").alias("_doc_id")]
    sent = f"_{text}" if text in list(carry) else "text"  # a text that is carried goes to Python once
    own = docs.select(*held) if sent != "text" else docs.select(*held, (F.col(text) if isinstance(text, str) else text).alias("text"))
    names = own.columns[: len(held)]
    plain = [F.col(c).alias(c[1:]) for c in names]
    if not languages:
        return own.select(*plain, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    source = own.withColumn("letters", F.coalesce(F.col(sent).rlike(r"\p{L}"), F.lit(False)))
    profiles = []
    for name in languages:
        learnt = np.array([(r["gram"], r["place"]) for r in rows if r["lang"] == name], np.int64)
        profiles.append((learnt[:, 0], learnt[:, 1]))
    schema = T.StructType([*(own.schema[c] for c in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(_predicted(languages, profiles, top, names, sent), schema).select(*plain, "lang_pred", "score")
