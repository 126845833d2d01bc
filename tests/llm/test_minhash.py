import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from remembra.llm import minhash as module
from remembra.llm._graph import likely
from remembra.llm.minhash import BATCH, SIGNATURE, least_matches, minhash_components, shared, shingle_sets, signature, spanning, survivors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(SMALL))
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def near(r, base, edits, words=3000):
    out = list(base)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"w{r.randrange(words)}"
    return " ".join(out)


def corpus():
    r = random.Random(2)
    texts = ["", " ", None, "one", "One", "two words", "É five wörds are here", "É FIVE wörds are here"]
    for size in (60, 150, 500):
        for _ in range(6):
            base = [f"w{r.randrange(3000)}" for _ in range(size)]
            texts += [near(r, base, e) for e in (0, 0, 1, 1, 2, size // 60, size // 30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(5, texts[20]), (5, texts[20]), (None, texts[30]), (None, "only " * 3 + "without id"), (None, None)]


def test_against_brute_force(spark, monkeypatch):
    for name, value in (("CHUNK", 7), ("BLOCK", 2000), ("BLOCK_TEXTS", 20), ("ROWS_AT_ONCE", 200), ("SHINGLES_AT_ONCE", 8000)):
        monkeypatch.setattr(module, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("hash", F.lit(1))
    assert sorted(map(tuple, minhash_components(df).collect()), key=str) == brute(rows)
    assert sorted(map(tuple, minhash_components(df.filter("text is null")).collect()), key=str) == [(2, 0, 2, True), (None, 0, None, True)]
    assert minhash_components(df.filter("false")).count() == 0


def test_large_bucket_of_unlinked_texts(spark):
    """Texts of one template, mostly below the similarity, with a few linked pairs and chains: none is lost, whatever the bucket's size."""
    r = random.Random(5)
    base = [f"w{r.randrange(3000)}" for _ in range(150)]
    texts = [near(r, base, r.choice((3, 4, 5, 6))) for _ in range(1200)]
    rows = list(enumerate(texts))
    got = minhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and 100 < len({x[2] for x in want}) < 1200


def test_texts_that_nothing_needs_are_not_shuffled(spark):
    rows = spark.range(20_000).select((F.xxhash64("id")).alias("key"), "id")
    keys = rows.filter("id % 20 = 3")
    got = likely(rows, keys, "key")
    assert got.columns == ["key", "id"] and got.join(keys, "id", "left_semi").count() == 1000 and got.count() < 1100
    assert likely(rows, keys.limit(0), "key").count() == 0
    assert "BroadcastHashJoin" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Exchange hashpartitioning(key" not in plan


def test_posterior_bounds():
    for percent in (80, 85):
        t = percent / 100
        for k, least in enumerate(least_matches(percent)):
            n = BATCH * (k + 1)
            grid = (np.arange(20000) + 0.5) / 20000
            tail = lambda m: (lambda d: d[grid >= t].sum() / d.sum())(np.exp(m * np.log(grid) + (n - m) * np.log1p(-grid)))
            assert tail(least) >= 0.9e-6 and (least == 0 or tail(least - 1) < 1.1e-6)
        # pairs at the threshold are given up with a small probability
        n, least = SIGNATURE, least_matches(percent)[-1]
        assert sum(math.comb(n, m) * t**m * (1 - t) ** (n - m) for m in range(least)) < 1e-5


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    h = r.integers(0, 1 << 63, 4000, np.uint64)
    x, y = np.unique(h[:3000]), np.unique(h[1000:])
    s = signature([x, y, np.zeros(0, np.uint64)])
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.15 and not s[2].any()
    assert survivors(s, s, np.array([0, 0]), np.array([0, 1]), 85).tolist() == [0]
    assert len(shingle_sets(pa.array(["a b c d e f", "A B", "", None, "x " * 100]))[4]) == 1


def test_shared_either_way():
    r = np.random.default_rng(3)
    x = [np.unique(r.integers(0, 4000, k).astype(np.uint64)) for k in (1, 500, 2500, 30, 0)]
    y = [np.unique(r.integers(0, 4000, k).astype(np.uint64)) for k in (900, 40, 3000)]
    a, b = np.repeat(np.arange(5), 3), np.tile(np.arange(3), 5)
    want = [len(set(x[i].tolist()) & set(y[j].tolist())) for i, j in zip(a, b)]
    assert shared(x, y, a, b).tolist() == want
    a, b = np.tile(a, 9), np.tile(b, 9)
    assert shared(x, y, a, b).tolist() == want * 9
    assert spanning(np.array([1, 2, 1, 5, 1]), np.array([2, 3, 3, 6, 1])).tolist() == [0, 1, 3]
