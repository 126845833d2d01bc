import re
from collections import Counter

from test_bpe import oracle  # noqa: F401
from test_repetition import brute as measured
from test_simhash import expected

import corpus_pipeline
from remembra.llm._store import workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    text = lambda i: " ".join(f"w{i}x{k}é" for k in range(80 + i))
    rows = [(i, text(i), "en", f"s{i % 3}", len(text(i))) for i in range(40)]
    rows += [(100 + i, text(i), "en", "s0", len(text(i))) for i in range(5)]
    rows += [(200, None, "en", "s1", None), (201, "", None, None, 0), (202, "too short", "en", "s1", 9), (203, "a b c " * 100, "en", "s2", 600)]
    secret = text(50) + " token = '04dbebab91ab85687d33eeaaf9ac699e1188f962' end"
    rows += [(204, secret, "en", None, len(secret)), (204, secret, "en", None, len(secret))]
    return rows


def test_stages_against_brute_force(spark, oracle):  # noqa: F811
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "secret scans", "mixing", "tokens"]
    done = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        place = workspace(spark, "test")
        stage(spark, done[-1] if done else df, "").write.parquet(place)
        done.append(spark.read.parquet(place))
        if k < 4:
            assert done[-1].columns == df.columns
    kept = lambda k: sorted(r.doc_id for r in done[k].collect())

    def good(t):
        n, chars, _, dup, repeat, five, _ = measured(t)
        return n >= 50 and 2 * repeat <= n and five <= 0.15 * chars and not dup

    alive = [r for r in rows if good(r[1])]
    assert kept(0) == sorted(r[0] for r in alive)
    alive = list({r[0]: r for r in alive}.values())
    _, root = expected([r[1] for r in alive])
    alive = [r for i, r in enumerate(alive) if alive[root[i]][0] == r[0]]
    assert kept(1) == kept(2) == sorted(r[0] for r in alive)
    clean = {r.doc_id: r for r in done[2].collect()}
    assert "[SECRET]" in clean[204].text and "04dbebab" not in clean[204].text and clean[204].n_chars == len(clean[204].text)
    assert all(clean[r[0]].text == r[1] for r in alive if r[0] != 204)
    times = Counter(kept(3))
    assert set(times) <= set(clean) and max(times.values()) <= 3
    for r in done[4].collect():
        assert r.text == clean[r.doc_id].text and r.tokens == oracle.encode_ordinary(r.text) and r.n_tokens == len(r.tokens)
    assert done[4].count() == done[3].count()


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(90)), "s", 1, 2, 3, [4], b"x", 5, 6, "n")], "doc_id long, text string, source string, n_words int, kept int, base int, tokens array<int>, bytes binary, `a.b` int, row int, node string")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == df.columns
    last = corpus_pipeline.STAGES[4][1](spark, docs, "")
    assert last.columns == [c for c in df.columns if c != "tokens"] + ["tokens", "n_tokens"]
    got, want = last.first(), df.first()
    assert all(got[c] == want[c] for c in df.columns if c != "tokens")
    nulls = spark.createDataFrame([(1, None, "s"), (2, "", None), (None, None, None), (1, None, "s")], "doc_id long, text string, source string")
    rows = [sorted(map(tuple, stage(spark, nulls, "").collect()), key=str) for _, stage in corpus_pipeline.STAGES]
    assert rows[0] == rows[3] == [] and rows[1] == [(1, None, "s")] and rows[2] == sorted(map(tuple, nulls.collect()), key=str)
    assert [r[:3] for r in rows[4]] == [(1, None, "s")] * 2 + [(2, "", None), (None, None, None)] and all(r[3:] == ([], 0) for r in rows[4])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
