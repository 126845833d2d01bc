import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from remembra.llm import treaps as module
from remembra.llm._store import workspace
from remembra.llm.treaps import _cuts, build_index, greater, impacts, occurrences, search, treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k=20):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(1 for *_, m in bags if m), sum(m for *_, m in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        weigh = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms(text)]
        found = []
        for i, b, m in bags:
            if m:
                score = sum(w * (10**9 * b[t] // (1000 * b[t] + 12 * (75 + 25 * m * n // total))) for t, w in zip(terms(text), weigh))
                if score > 0:
                    found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus():
    r = random.Random(7)
    word = lambda: f"W{int(r.paretovariate(0.7)) % 400}"
    docs = [(i, " ".join(word() for _ in range(r.choice((3, 20, 90))))) for i in range(250)]
    docs += [(i, docs[i % 30][1]) for i in range(250, 300)]  # copies: equal scores
    docs += [(3, docs[4][1]), (3, docs[4][1]), (None, docs[5][1]), (None, docs[5][1]), (400, None), (401, ""), (402, "--- !"), (403, "é ß日本 Éa_b"), (404, "W1 " * 5000), (405, "solo")]
    items = [(i, " ".join(word() for _ in range(r.choice((1, 4, 15))))) for i in range(30)]
    items += [(5, "w1 W1 w1 w399"), (5, "w1 W1 w1 w399"), (31, None), (32, ""), (33, "nowhere"), (34, "É ß日本 a solo"), (None, "w7 w8"), (35, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("block", [4096, 8])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_DOCS", block)
    monkeypatch.setattr(module, "ITEM_TERMS", 8192 if block == 4096 else 40)
    monkeypatch.setattr(module, "BROADCAST_TERMS", module.BROADCAST_TERMS if block == 4096 else 0)
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("block", F.lit("x"))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("term", F.lit("x"))
    index = build_index(d, workspace(spark, "test"))
    got = sorted((tuple(r) for r in search(index, q).collect()), key=str)
    assert got == brute(docs, items)
    assert search(index, q.filter("false")).count() == 0
    assert search(build_index(d.filter("doc_id in (400, 401)"), workspace(spark, "test")), q).count() == 0
    assert search(build_index(d.filter("false"), workspace(spark, "test")), q).count() == 0
    few = build_index(d.filter("doc_id < 150"), workspace(spark, "test")).unionByName(build_index(d.filter("doc_id >= 150 or doc_id is null"), workspace(spark, "test")))
    assert sorted((tuple(r) for r in search(few, q, k=3).collect()), key=str) == brute(docs, items, 3)


def test_treaps_are_search_trees_and_heaps():
    r = np.random.default_rng(1)
    for shape in ("random", "ties", "up", "down"):
        sizes = np.array([1, 2, 700, 1, 300])
        n = sizes.sum()
        impact = {"random": r.integers(0, 10**6, n), "ties": r.integers(0, 3, n), "up": np.arange(n), "down": np.arange(n)[::-1].copy()}[shape].astype(np.int64)
        left, right, roots = treaps(impact, sizes)
        begin = 0
        for size, root in zip(sizes, roots):
            seen, stack = 0, [(root, begin, begin + size)]
            while stack:
                i, a, b = stack.pop()
                assert a <= i < b and impact[i] == impact[a:b].max()
                seen += 1
                for child, x, y in ((left[i], a, i), (right[i], i + 1, b)):
                    assert (child >= 0) == (x < y)
                    if x < y:
                        stack.append((child, x, y))
            assert seen == size
            begin += size
    assert greater(np.array([3, 1, 2, 2, 5]), np.zeros(5, int), False).tolist() == [-1, 0, 0, 2, -1]


def test_pruning_opens_few_documents():
    r = np.random.default_rng(2)
    n, lists = 4000, 6
    impact = r.integers(1, 10**5, (lists, n))
    impact[:, 1000:1020] = 500_000
    i, d, s = module.search_block(np.tile(np.arange(n), lists), impact.ravel(), np.full(lists, n), n, np.zeros(lists, int), np.arange(lists), np.arange(1, lists + 1), np.full((1, 20), -1), 20)
    assert set(range(1000, 1020)) <= set(d.tolist()) and len(d) < n // 10 and len(set(d.tolist())) == len(d)
    assert all(x == (impact[:, j] * np.arange(1, lists + 1)).sum() for j, x in zip(d, s))


def test_long_texts_and_large_numbers():
    text = "ab é9-" * 700_000 + "x" * 3_000_000 + " ab"
    h, p = occurrences(pa.array(["ab", text, None, "é9"]))
    count = Counter(h[p == 1].tolist())
    assert count[int(h[0])] == 700_001 and count[int(h[-1])] == 700_000 and len(count) == 3 and not (p == 2).any()
    data = np.frombuffer(b"a b" * 10 + b"c" * 3_000_000, np.uint8)
    assert list(_cuts(data, 0, len(data))) == [(0, len(data))]
    assert impacts(np.array([3]), np.array([10**9]), 10**12, 10**13).tolist() == [3 * 10**9 // (3000 + 12 * (75 + 25 * 10**8))]
