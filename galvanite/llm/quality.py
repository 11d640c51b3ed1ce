"""Quality scores by regularised quadratic discriminant analysis.

Each class has a normal density over transformed document statistics. Its
covariance is shrunk to the pooled one and then to a multiple of the identity;
a score is the difference of the classes' log densities, from Mahalanobis
distances with Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.llm.common import as_bytes, lists, written

NAMES = ("words", "word_length", "distinct", "letters", "capitals", "digits", "stops", "symbols", "spaces", "lines", "repeated_lines", "top_word", "short", "long", "no_letter", "capital_words", "pairs")
_LOWER, _UPPER, _DIGIT, _STOP, _SYMBOL, _SPACE = (np.zeros(256, bool) for _ in range(6))
_LOWER[97:123] = _LOWER[128:] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_STOP[[ord(c) for c in ".,;:'\"()-"]] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LOWER | _UPPER | _DIGIT | _STOP)


def _share(part: float, whole: float) -> float:
    """Log odds of a share, finite at 0 and 1."""
    p = (part + 0.01) / (whole + 0.02)
    return float(np.log(p / (1 - p))) if 0 < p < 1 else 0.0


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text, finite for any text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    size, words = len(text), text.split()
    n = len(words)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = [len(w) for w in words]
    top = max(seen.values(), default=0)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)),
        float(np.log1p(sum(lengths) / n)) if n else 0.0,
        _share(len(seen), n),
        _share(int(counts[_LOWER].sum()), size),
        _share(int(counts[_UPPER].sum()), size),
        _share(int(counts[_DIGIT].sum()), size),
        _share(int(counts[_STOP].sum()), size),
        _share(int(counts[_SYMBOL].sum()), size),
        _share(int(counts[_SPACE].sum()), size),
        float(np.log1p(len(lines))),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(top, n),
        _share(sum(x <= 2 for x in lengths), n),
        _share(sum(x >= 14 for x in lengths), n),
        _share(sum(w.isdigit() or not w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in seen), len(seen)),
        _share(sum(w.isupper() for w in seen), len(seen)),
        _share(pairs, max(0, n - 1)),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([statistics(t) for t in as_bytes(batch["text"])]).reshape(batch.num_rows, len(NAMES))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], lists(values.ravel(), np.full(batch.num_rows, len(NAMES)), pa.float64())], names=["doc_id", "x"])


def measured(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the vector x of statistics of each row; null is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_measured, "doc_id long, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES)
    total = {k: np.zeros((d + 1, d + 1)) for k in (0, 1)}
    for batch in batches:
        x = np.ones((batch.num_rows, d + 1))
        x[:, :d] = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        y = batch["y"].to_numpy(zero_copy_only=False)
        for k in total:
            total[k] += x[y == k].T @ x[y == k]
    size = (d + 1) ** 2
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size), pa.int64()), pa.array(np.tile(np.arange(size), 2), pa.int64()), pa.array(np.concatenate([total[0].ravel(), total[1].ravel()]))], names=["y", "at", "v"])


class Discriminant:
    """Two classes' means and Cholesky factors. A class without rows is like
    the pooled one; with no rows at all every score is 0.5."""

    def __init__(self, moments: dict[int, np.ndarray], to_pooled: float, to_identity: float):
        d = len(NAMES)
        n = {k: m[d, d] for k, m in moments.items()}
        all_n = max(1.0, sum(n.values()))
        pooled_mean = sum(m[d, :d] for m in moments.values()) / all_n
        mean = {k: m[d, :d] / n[k] if n[k] else pooled_mean for k, m in moments.items()}
        scatter = {k: m[:d, :d] - n[k] * np.outer(mean[k], mean[k]) for k, m in moments.items()}
        pooled = sum(scatter.values()) / all_n
        self.scale = 1 / np.sqrt(np.diag(pooled) + 1e-6)
        self.prior = np.log((n[1] + 1) / (n[0] + 1))
        self.mean, self.factor, self.log_det = {}, {}, {}
        grid = np.outer(self.scale, self.scale)
        for k in moments:
            own = scatter[k] / n[k] if n[k] else pooled
            s = ((1 - to_pooled) * own + to_pooled * pooled) * grid
            s = (1 - to_identity) * s + to_identity * (np.trace(s) / d + 1e-6) * np.eye(d)
            self.factor[k] = np.linalg.inv(np.linalg.cholesky(s))
            self.log_det[k] = -2 * np.log(np.diag(self.factor[k])).sum()
            self.mean[k] = mean[k]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        part = {}
        for k in self.mean:
            z = ((x - self.mean[k]) * self.scale) @ self.factor[k].T
            part[k] = -0.5 * ((z**2).sum(axis=1) + self.log_det[k])
        return 1 / (1 + np.exp(np.clip(-(part[1] - part[0] + self.prior), -700, 700)))


def train(labelled: DataFrame, *, to_pooled: float = 0.1, to_identity: float = 0.02) -> Discriminant:
    """Fits on all rows of ``labelled`` (x, y), y 0 or 1; other y are left
    out. Only sums of products, one small matrix for each task, are moved."""
    sums = labelled.where("y in (0, 1)").select("x", F.col("y").cast("long").alias("y")).mapInArrow(_moments, "y long, at long, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    size = len(NAMES) + 1
    moments = {k: np.zeros(size * size) for k in (0, 1)}
    for r in sums:
        moments[r["y"]][r["at"]] = r["v"]
    return Discriminant({k: m.reshape(size, size) for k, m in moments.items()}, to_pooled, to_identity)


def scored(features: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(x))], names=["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, learn: Column, *, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``.

    Learns from the rows of ``labels`` (``key``, ``label``) whose ids are in
    ``docs`` and meet ``learn``, a condition on doc_id. Null texts are empty;
    null ids and labels other than 0 and 1 are not learnt from; an id with
    several labels or rows counts with each. Statistics are computed once and
    written to the shared folder; the join moves them, never texts. An empty
    table gives an empty result."""
    features = written(measured(docs, text=text, key=key), "features")
    wanted = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("long").alias("y")).where(F.col("doc_id").isNotNull() & F.coalesce(learn, F.lit(False)))
    model = train(features.join(wanted, "doc_id"))
    return scored(features, model).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
