import hashlib
import random
import re

import numpy as np
import pytest

from remembra.llm._store import workspace
from remembra.llm.substring import WindowIndex, _among, dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    first = {}
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in docs:
        if i is not None:
            for k in range(len(w) - size + 1):
                g = tuple(w[k : k + size])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in docs:
        gone = set()
        if i is not None:
            for k in range(len(w) - size + 1):
                if first[tuple(w[k : k + size])] < i:
                    gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(n=120):
    r = random.Random(6)
    words = [f"w{i}é" for i in range(60)]
    passages = [" ".join(r.choice(words) for _ in range(r.choice([12, 13, 14, 60]))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(words) for _ in range(r.randint(1, 30))))
        rows.append((i * 3, "\n ".join(parts)))
    long = " ".join(r.choice(words) for _ in range(20000))
    rows += [(500, None), (501, ""), (502, long), (503, long + " end"), (504, passages[3] * 2 + " " + passages[3]), (9, rows[3][1]), (9, passages[0]), (None, passages[0]), (None, passages[0]), (-5, passages[1]), (505, " " + passages[2] + "  ")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, block string, n_words int")
    want = brute(rows)
    assert sum(x[2] for x in want) > 1000
    for arrivals in (1, 3, 5):
        assert sorted(map(tuple, dedup_substrings(df, arrivals=arrivals).collect()), key=str) == want
    assert dedup_substrings(df.filter("false")).count() == 0


def test_many_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr("remembra.llm.substring.BLOCK_BYTES", 3000)
    monkeypatch.setattr("remembra.llm.substring.SHARD_WINDOWS", 500)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, dedup_substrings(df).collect()), key=str) == brute(rows)


def test_runs_are_compacted(spark):
    index = WindowIndex(spark, workspace(spark, "index"), 2, 3)
    sizes = []
    for b in range(4):
        df = spark.createDataFrame([(b, " ".join(f"x{b}y{k}" for k in range(50)) + " same old words")], "doc_id long, text string")
        got = index.dedup(df, 400).first()
        assert got.n_removed == (3 if b else 0)
        sizes.append(len(index.runs))
    assert sizes == [1, 1, 2, 1]


def test_ids_are_integers(spark):
    with pytest.raises(TypeError, match="doc_id"):
        dedup_substrings(spark.createDataFrame([("a", "x y")], "doc_id string, text string"))


def test_windows_that_share_a_key(spark):
    """Windows are told by the key and the check: with keys of few bits, many share one."""
    rows = corpus(60)
    folder = workspace(spark, "few")
    index = WindowIndex(spark, folder, 3)
    index.bits = 32
    df = spark.createDataFrame([(i, t) for i, t in rows if i is not None], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in index.dedup(df, 10_000).collect())
    assert got == sorted(brute([(i, t) for i, t in rows if i is not None]))
    key, check = np.array([5, 5, 7, 9], np.uint64), np.array([1, 2, 3, 4], np.uint32)
    old, old_check = np.array([5, 5, 5, 9], np.uint64), np.array([3, 2, 9, 5], np.uint32)
    assert _among(key, check, old, old_check).tolist() == [False, True, False, False]


def test_digests(spark):
    rows = [(1, "a b c"), (2, None), (None, " x  y ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in dedup_substrings(df).collect()}
    assert {r.doc_id: r.kept_sha256 for r in dedup_substrings(df, digest=True).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()} and texts == {1: "a b c", 2: "", None: "x y"}
