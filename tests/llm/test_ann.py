import math
import random

import numpy as np
from pyspark.sql import functions as F

from remembra.llm.ann import nearest, nearest_neighbours


def brute(rows, k=10):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    asks = {}
    for i, v in ok:
        if i % 10 == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for i, q in asks.items():
        found = []
        for j, c in ok:
            if j != i and len(c) == len(q):
                t = 0.0
                for a, b in zip(q, c):
                    t += (a - b) * (a - b)
                found.append((math.sqrt(t), j))
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(1)
    f32 = lambda: float(np.float32(r.gauss(0, 1)))
    rows = [(i, [f32() for _ in range(16)]) for i in range(300)]
    rows += [(i, list(rows[i % 40][1])) for i in range(300, 360)]  # copies and ties
    rows += [(7, rows[7][1]), (20, rows[21][1]), (None, rows[3][1]), (400, None), (410, []), (420, [0.0] * 16), (430, [float("nan")] + [1.0] * 15), (440, [None] + [1.0] * 15), (450, [float("inf")] * 16), (460, [1.0, 2.0]), (461, [1.0, 3.0]), (470, [5.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("dim", F.lit(3)).withColumn("score", F.lit("x"))
        got = sorted(map(tuple, nearest_neighbours(df, F.col("vec_id") % 10 == 0).collect()))
        assert got == brute(rows)
    assert nearest_neighbours(df.filter("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_keep_all_neighbours():
    r = np.random.default_rng(3)
    for scale in (1.0, 1e-30, 1e6):
        q, c = r.normal(size=(70, 40)) * scale, r.normal(size=(3000, 40)) * scale
        c[:1500] = c[0] + r.normal(size=(1500, 40)) * scale * 1e-3
        found = dict(nearest(np.arange(70), q, np.arange(100, 3100), c, 10, np.full(70, np.inf)))
        for i in range(70):
            d = np.sqrt(((q[i] - c) ** 2).sum(1))
            assert {j - 100 for _, j in found[i]} == set(np.argsort(d, kind="stable")[:10].tolist())
