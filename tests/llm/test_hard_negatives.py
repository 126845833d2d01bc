import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from remembra.llm import hard_negatives as module
from remembra.llm.hard_negatives import hard_negatives, scores


def brute(rows):
    ok = [(i, c, [math.floor(256 * x) for x in v]) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, c, v in ok:
        if i % 10 == 0:
            asks[i] = min(asks.get(i, (c, v)), (c, v))
    out = []
    for a, (c, v) in asks.items():
        others = sorted((-sum(x * y for x, y in zip(v, w)), i, d) for i, d, w in ok if i != a and len(w) == len(v))
        for p, pid, _ in [o for o in others if o[2] == c][:5]:
            found = [o for o in others if o[2] != c and -80 * p <= -100 * o[0] <= -100 * p][:5]
            out += [(a, pid, r + 1, o[1], -p, -o[0]) for r, o in enumerate(found)]
    return sorted(out)


def cases():
    r = random.Random(4)
    f32 = lambda: float(np.float32(r.gauss(0, 0.3)))
    rows = [(i, [f32() for _ in range(8)], i % 3) for i in range(200)]
    rows += [(i, list(rows[i % 40][1]), i % 4) for i in range(200, 260)]  # equal scores across labels
    nan, inf = float("nan"), float("inf")
    rows += [(7, rows[8][1], 1), (20, rows[21][1], 0), (20, rows[21][1], 2), (None, rows[3][1], 1), (300, None, 1), (310, rows[1][1], None), (320, [nan] * 8, 1), (330, [None] * 8, 1), (340, [inf] * 8, 1)]
    rows += [(350, [0.0] * 8, 0), (360, [], 1), (361, [], 1), (362, [], 2), (370, [1.0, 2.0], 0), (371, [1.0, 2.0], 0), (372, [1.0, 1.9], 1), (380, [5.0], 1)]
    return rows


@pytest.mark.parametrize("block, kind", [(8192, "float"), (40, "double")])
def test_against_brute_force(spark, monkeypatch, block, kind):
    monkeypatch.setattr(module, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(module, "ANCHOR_BLOCK", block)
    rows = cases()
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("dim", F.lit("x")).withColumn("rank", F.lit(3))
    got = sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).collect()))
    assert got == brute(rows) and len(got) > 50
    assert hard_negatives(df.filter("false"), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_scores_of_any_size():
    q, c = np.array([[2**40, -3]]), np.array([[2**20, 5], [-(2**20), 7]])
    assert scores(q, c).tolist() == [[2**60 - 15, -(2**60) - 21]]
    with pytest.raises(OverflowError):
        scores(np.array([[2**40]]), np.array([[2**40]]))
    assert scores(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0, 0, 0]] * 2


def test_large_components(spark):
    rows = [(0, [1e9, 1.0], 1), (1, [0.9e9, 1.0], 1), (2, [0.85e9, 1.0], 2), (3, [-4.0, 2.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="OverflowError"):
        hard_negatives(df, F.col("vec_id") == 0, F.col("label")).collect()
    rows = [(i, [x / 1e3 for x in v], c) for i, v, c in rows]
    got = hard_negatives(spark.createDataFrame(rows, df.schema), F.col("vec_id") == 0, F.col("label")).collect()
    assert sorted(map(tuple, got)) == brute(rows)
