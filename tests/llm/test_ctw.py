import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from remembra.llm.ctw import Forest, Top, Upper, ctw_scores, log_gamma_half, top_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, depth):
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    data = [(i, (" ".join(tokens(t)) + "\n").encode(), tokens(t)) for i, t in rows]
    seen = defaultdict(lambda: [0, 0])

    def steps(s):
        padded = b"\n" * depth + s
        for k, x in enumerate(s):
            past = padded[k : k + depth][::-1]
            for bit in range(8):
                yield past, (bit, x >> (8 - bit)), x >> (7 - bit) & 1

    for i, s, _ in data:
        if train(i):
            for past, node, b in steps(s):
                for d in range(depth + 1):
                    seen[past[:d], node][b] += 1
    children = defaultdict(list)
    for past, node in seen:
        if past:
            children[past[:-1], node].append((past, node))

    def kt(k):
        a, b = seen[k]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    weighted = {}
    for k in sorted(seen, key=lambda k: -len(k[0])):
        weighted[k] = kt(k) if len(k[0]) == depth else np.logaddexp(kt(k), sum(weighted[c] for c in children[k])) - math.log(2)

    def prob(past, node, b):
        p = None
        for d in range(depth, -1, -1):
            k = (past[:d], node)
            if k in seen:
                own = (seen[k][b] + 0.5) / (sum(seen[k]) + 1)
                share = 1 if p is None else math.exp(kt(k) - math.log(2) - weighted[k])
                p = share * own + (1 - share) * (p or 0)
        return 0.5 if p is None else p

    c = Counter(w for i, _, ws in data if train(i) for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, s, ws in data:
        ws = [*ws, None]
        out.append((i, not train(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), sum(math.log10(prob(*x)) for x in steps(s))))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    syllables = ["ba", "lo", "ké", "ti", "ra", "no"]
    rows = [(i, " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 40))).capitalize()) for i in range(60)]
    return rows + [(60, None), (61, " \n"), (62, "ZZZ zzz"), (5, rows[5][1]), (None, "no id"), (None, "none")]


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip(g[5:], w[5:])), (g, w)


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, block int, held_out string")
    for depth in (2, 6):
        close(sorted(map(tuple, ctw_scores(df.drop("held_out"), "crc32(cast(doc_id as string)) % 7 = 2", depth).collect()), key=str), brute(rows, depth))
    monkeypatch.setattr("remembra.llm.ctw.BLOCK_BYTES", 900)
    monkeypatch.setattr("remembra.llm.ctw.PIECE_BYTES", 300)
    monkeypatch.setattr("remembra.llm.ctw.SHARD_KEYS", 200)
    monkeypatch.setattr("remembra.llm.ctw.SLICE", 50)
    monkeypatch.setattr("remembra.llm.ctw.ROW_KEYS", 100)
    close(sorted(map(tuple, ctw_scores(df, "crc32(cast(doc_id as string)) % 7 = 2", 4).collect()), key=str), brute(rows, 4))
    # contexts of several depths are heavy and split over the shards
    monkeypatch.setattr("remembra.llm.ctw.HEAVY_KEYS", 20)
    monkeypatch.setattr("remembra.llm.ctw.HEAVY_SHARE", 100)
    for depth in (3, 6):
        close(sorted(map(tuple, ctw_scores(df, "crc32(cast(doc_id as string)) % 7 = 2", depth).collect()), key=str), brute(rows, depth))


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ctw_scores(df, "true").collect()}
    assert got[1].train_tokens == 0 and got[1].base_score == 0 and math.isclose(got[1].score, 4 * 8 * math.log10(0.5), rel_tol=1e-6)
    assert got[2].n_tokens == 1 and got[2].n_known == 0
    assert ctw_scores(df.filter("false"), "doc_id = 1").count() == 0


def test_probabilities_of_a_context_add_up_to_one():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 3, (500, 4)).astype(np.uint64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint64))
    counts = r.integers(1, 50, len(keys))
    for heavy in ({}, {2: np.array([0x0001, 0x0102], np.uint64)}):
        upper = Upper(3, heavy)
        trees = {d: Forest(keys[upper.roots(keys) == d], counts[upper.roots(keys) == d], 3, d) for d in (2, 3)}
        s = np.zeros(upper.size)
        for forest in trees.values():
            places, values = top_statistics(forest, upper)
            s[places] += values
        for context in (0, 0x010203, 0x010203 >> 8, 0x00FF00, 0xFFFFFF):
            every = np.uint64(context << 8) | np.arange(256, dtype=np.uint64)
            assert math.isclose((10 ** Top(upper, s).log10(trees[upper.roots(every)[0]], every)).sum(), 1, rel_tol=1e-9)


def test_log_gamma():
    n = np.array([0, 1, 2, 5, 6.5, 100, 1e6])
    assert np.allclose(log_gamma_half(n), [math.lgamma(x + 0.5) for x in n], rtol=1e-11, atol=1e-11)
