import math

import numpy as np
import pytest

from galvanite.llm.hard_negatives import Best, hard_negatives, products

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, low=80, scale=256, k=5):
    fit = {}
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fit[i] = min(fit.get(i, (y, v)), (y, v))
    whole = {i: (y, [math.floor(scale * x) for x in v]) for i, (y, v) in fit.items()}
    out = []
    for a in (i for i in whole if i % 100 == 0):
        score = {i: sum(x * z for x, z in zip(v, whole[a][1], strict=True)) for i, (_, v) in whole.items() if i != a and len(v) == len(whole[a][1])}
        first = sorted((i for i in score if whole[i][0] == whole[a][0]), key=lambda i: (-score[i], i))[:k]
        for p in first:
            found = sorted((i for i in score if whole[i][0] != whole[a][0] and low * score[p] <= 100 * score[i] <= 100 * score[p]), key=lambda i: (-score[i], i))[:k]
            out += [(a, p, rank, n, score[p], score[n]) for rank, n in enumerate(found, 1)]
    return sorted(out)


def mined(frame, **how):
    return sorted(tuple(r) for r in hard_negatives(frame, **how).collect())


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_against_all_scores(spark, block_bytes):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (4, 6))
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.4, 6)).tolist(), int(rng.integers(0, 3))) for i in range(900)]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(60)]  # ties
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    wanted = brute(rows)
    assert len(wanted) > 100
    assert mined(frame, block_bytes=block_bytes) == wanted  # several blocks give what one does


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [0.5, 0.25, -1.0] if i % 3 == 0 else rng.normal(0, 1, 3).tolist(), i % 2) for i in range(1500)]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (100, [1.0, 2.0], None), (200, None, 1), (300, [1.0, None], 1), (400, [nan, 1.0], 1), (500, [inf, 1.0], 1), (None, [1.0, 2.0], 1)]
    rows += [(600, [], 1), (601, [], 1), (602, [], 2), (7, [1.0, 2.0, 3.0], 1), (8, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (9, [1.0, 1.9], 2), (9, [1.0, 1.9], 2), (10, [1.0, 1.8], 3), (11, [-1.0, -2.0], 3), (0, [1.0, 2.0], 1)]
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", rank int, score string")
    found = mined(frame)
    assert found == brute(rows)
    assert [(r[0], r[1], r[3]) for r in found] == [(0, 8, 9), (0, 8, 10), (600, 601, 602)]  # a repeated row is one row, lengths don't meet
    assert mined(frame.limit(0)) == [] and hard_negatives(frame.limit(0)).columns == hard_negatives(frame).columns
    assert mined(frame.where("vec_id = 7")) == []


def test_products_are_exact_beyond_doubles(spark):
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**60, 0.0], [-(2.0**60), 0.0]])
    assert products(a, b).tolist() == [[2**60 + 3, 2**63 - 1, -(2**63)]]
    rows = [(0, [2.0**30, 1.0], 1), (1, [2.0**15, 3.0], 1), (2, [2.0**15, 2.0], 2), (3, [2.0**15, 3.0], 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_best_keeps_ties_by_id():
    best = Best(2, 2)
    allowed = np.array([[True, True, False], [True, True, True]])
    best.offer(np.array([0, 1]), np.array([[5, 5, 9], [1, 2, 2]]), np.array([8, 3, 1]), allowed)
    best.offer(np.array([1]), np.array([[2]]), np.array([0]), np.array([[True]]))
    assert best.id.tolist() == [[3, 8], [0, 1]] and best.score.tolist() == [[5, 5], [2, 2]]
