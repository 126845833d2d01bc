import random
import re

import pyarrow as pa
import xxhash

from remembra.llm import _graph
from remembra.llm._graph import components
from remembra.llm._store import stored
from remembra.llm.simhash import fingerprints, simhash_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def corpus():
    r = random.Random(1)
    words = [f"w{i}É" for i in range(500)]
    out = [None, "", " \n", "One", "one", "two words", "a b c"]
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([5, 300, 1200]))]
        out.append(" ".join(base))
        for _ in range(6):
            x = list(base)
            x[r.randrange(len(x))] = "changed"
            out.append("\n ".join(x).upper() if r.random() < 0.2 else " ".join(x))
    return out


def expected(texts):
    f = [brute(x) for x in texts]
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return f, [find(i) for i in range(len(f))]


def test_fingerprints_whole():
    texts = corpus() + [" ".join(map(str, range(2000)))]
    assert fingerprints(pa.array(texts, pa.string())).tolist() == [brute(x) for x in texts]


def test_components_against_brute_force(spark):
    texts = corpus()
    f, root = expected(texts)
    df = spark.createDataFrame([(i, x, 5, "c") for i, x in enumerate(texts)] + [(3, "One", 6, "d")], "doc_id long, text string, fp int, component_id string")
    got = simhash_components(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.fp % (1 << 64) == f[r.doc_id] and r.component_id == root[r.doc_id]


def test_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "other words here"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert {r.component_id for r in simhash_components(df).collect()} == {1, None}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(df).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 230)] + [(300, 300)]
    found, done = components(spark.createDataFrame(edges, "a long, b long"))
    found = {r.node: r.root for r in found.collect()}
    done()
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 230)]}


def test_components_of_hubs_and_chains(spark):
    r = random.Random(1)
    edges = [(r.randrange(500), r.randrange(500)) for _ in range(300)] + [(7, k) for k in range(200)] + [(k, k + 1) for k in range(300, 420)] + [(499, 499)] * 2
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    for some, want in ((edges, {x: top(x) for x in list(up)}), ([], {})):
        found, done = components(spark.createDataFrame(some, "a long, b long"))
        rows = found.collect()
        done()
        assert {x.node: x.root for x in rows} == want and len(rows) == len(want)


def test_components_of_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(_graph, "stored", lambda df, path: (written.append(path), stored(df, path))[1])
    stars = [(7, 200 + i) for i in range(20)] + [(100 + i, 1) for i in range(20)] + [(2, 3), (3, 2), (5, 5)]
    found, done = components(spark.createDataFrame(stars, "a long, b long"))
    found = {r.node: r.root for r in found.collect()}
    done()
    assert found == {7: 7, 1: 1, 2: 2, 3: 2} | {200 + i: 7 for i in range(20)} | {100 + i: 1 for i in range(20)}
    assert len(written) == 1
    components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))[1]()
    assert len(written) == 6  # one round of four tables, and none to see that nothing changes
