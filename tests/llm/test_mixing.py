import re
from collections import Counter

import numpy as np

from remembra.llm.mixing import CHUNK, Draw, Mix, mix_documents, mix_report, permuted, several_without_replacement, targets, without_replacement

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(sizes, weights, repeats=3):
    """Shares by the rule as it is told: those above their most are set to it, the rest is shared again."""
    out = [None] * len(sizes)
    while True:
        open_ = [i for i, x in enumerate(out) if x is None]
        left = sum(sizes) - sum(x for x in out if x is not None)
        over = [i for i in open_ if weights[i] * left / sum(weights[j] for j in open_) > repeats * sizes[i]]
        for i in over:
            out[i] = float(repeats * sizes[i])
        if not over:
            for i in open_:
                out[i] = weights[i] * left / sum(weights[j] for j in open_)
            return out


def test_targets_are_capped_and_reshared():
    assert targets([10, 0, 30], [1, 2, 3]) == [10.0, 0.0, 30.0]
    got = targets([1000, 10, 1], [1, 2, 3])
    assert got[1:] == [30.0, 3.0] and abs(sum(got) - 1011) < 1e-9
    r = np.random.default_rng(3)
    for _ in range(100):
        n = int(r.integers(1, 12))
        sizes, weights = [int(x) for x in r.integers(0, 4, n) ** r.integers(1, 9, n)], [float(1 + i % 3) for i in range(n)]
        assert np.allclose(targets(sizes, weights), shared(sizes, weights), rtol=1e-9)


def test_permutations():
    for n in (1, 2, 3, 7, 100, 1025):
        p = permuted(np.arange(n), np.full(n, n), np.full(n, 5))
        assert sorted(p.tolist()) == list(range(n))
    several = permuted(np.concatenate([np.arange(9), np.arange(1000)]), np.repeat([9, 1000], [9, 1000]), np.repeat([1, 2], [9, 1000]))
    assert sorted(several[:9].tolist()) == list(range(9)) and sorted(several[9:].tolist()) == list(range(1000))
    assert permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 3)).tolist() != several[9:].tolist()


def test_draw():
    blocks, slots = np.array([100, 7, 0, 1, 5000, 40]), np.array([250, 21, 0, 1, 1234, 40])
    for shards in (1, 2, 7, 50):
        draw = Draw(blocks, slots, shards, 3)
        counts = list(draw.counts(0, shards))
        assert [c[0] for c in counts] == list(range(shards))
        assert (sum(c[2] + c[4] for c in counts) == slots).all() and all((c[2] >= 0).all() and (c[4] >= 0).all() for c in counts)
        # whatever range of shards a task draws, it draws the same
        again = [c for a in range(0, shards, 3) for c in draw.counts(a, min(shards, a + 3))]
        assert all((x == y).all() for c, d in zip(counts, again, strict=True) for x, y in zip(c[1:], d[1:], strict=True))
        times = Counter((int(s), int(b)) for _, source, block in draw.slots(0, shards, 7) for s, b in zip(source, block, strict=True))
        for s in range(len(blocks)):
            every = [times[s, b] for b in range(blocks[s])]
            assert sum(every) == slots[s]
            if blocks[s]:
                assert slots[s] // blocks[s] <= min(every) <= max(every) <= -(-slots[s] // blocks[s])
    # the counts of a shard are spread as a multinomial draw's are
    n = np.array([c[2][0] for seed in range(300) for c in Draw(np.array([1000, 9000]), np.array([1000, 9000]), 10, seed).counts(4, 5)])
    assert abs(n.mean() - 100) < 3 and 60 < n.var() < 105


def test_shards_are_equal_and_mixed():
    r = np.random.default_rng(8)
    for _ in range(60):
        blocks = r.integers(1, 10 ** r.integers(1, 5), r.integers(1, 9))
        slots = np.minimum((blocks * r.random(len(blocks)) * 3).astype(np.int64) + r.integers(0, 2), 3 * blocks)
        shards = int(r.integers(1, 20))
        counts = [int((c[2] + c[4]).sum()) for c in Draw(blocks, slots, shards, 5).counts(0, shards)]
        assert sum(counts) == slots.sum() and max(counts) - min(counts) <= 2 + 2 * len(blocks)
        if (slots >= 2 * blocks).all():
            assert max(counts) - min(counts) <= 1 + shards.bit_length()
    (_, source, _), = Draw(np.array([500, 500]), np.array([500, 500]), 1, 5).slots(0, 1, 7)
    assert 400 < (np.diff(source) != 0).sum() < 600


def test_last_epoch_is_drawn_without_replacement():
    """Against the draw done slot by slot: indices drawn one after another, counted by the half that owns them; a second source makes sizes up."""
    for blocks, slots in ((1000, 990), (1000, 950), (40, 13), (7, 6)):
        drawn = [c[4][0] for seed in range(1500) for c in Draw(np.array([blocks, 4000]), np.array([slots, 4000]), 2, seed).counts(0, 1)]
        r = np.random.default_rng(1)
        brute = [(r.permutation(blocks)[:slots] < blocks // 2).sum() for _ in range(1500)]
        assert abs(np.mean(drawn) - np.mean(brute)) < 0.25 and abs(np.std(drawn) - np.std(brute)) < 0.12 * np.std(brute) + 0.02
        assert abs(np.mean(np.array(drawn) == min(slots, blocks // 2)) - np.mean(np.array(brute) == min(slots, blocks // 2))) < 0.05


def test_draws_of_large_populations(monkeypatch):
    """The draws that stand in for numpy's have its moments, at sizes where both can be done."""
    r = np.random.default_rng(2)
    for good, bad, n in ((5000, 5000, 6000), (9000, 1000, 300), (1000, 9000, 9700), (3, 9997, 5000), (9990, 10, 40), (0, 10000, 7), (10000, 0, 7), (5000, 5000, 10000), (5000, 5000, 0)):
        want = r.hypergeometric(good, bad, n, 3000)
        with monkeypatch.context() as m:
            m.setattr("remembra.llm.mixing.EXACT", 10)
            got = np.array([without_replacement(r, good, bad, n) for _ in range(3000)])
            several = several_without_replacement(r, np.array([good, bad, 50]), n)
        assert abs(got.mean() - want.mean()) < 0.1 * want.std() + 0.01 and abs(got.std() - want.std()) < 0.06 * want.std() + 0.02, (good, bad, n)
        assert got.min() >= max(0, n - bad) and got.max() <= min(good, n) and several.sum() == n and (several <= [good, bad, 50]).all()


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr("remembra.llm.mixing.CHUNK", 50)
    rows = [(None, "", "s0")] * 700 + [(None, "a b c", "s0")] * 333 + [(7, "a b c", None)] * 120 + [(k, f"w{k} x", "s1") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = Mix(df, block=16)
    placed = mix.rows.collect()
    assert Counter((r.doc_id, r.source, r.size) for r in placed) == Counter((i, s, len(t.split())) for i, t, s in rows)
    for s in (0, 1, 2):
        at = sorted((r.start, r.size) for r in placed if r.s == s and r["size"])
        assert [a for a, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]
    assert mix.taken().count() == len(rows)


def table(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(37 * (i % 11) + 20)), f"s{i % 5}" if i % 7 else None, i) for i in range(400)]
    rows += [(400, None, "s0", 0), (401, "", "s1", 0), (402, " \n", "empty", 1), (3, "again here", "s3", 9), (3, "again here", "s3", 9), (None, "no id at all", "s2", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int"), rows


def test_report(spark):
    df, rows = table(spark)
    got = mix_report(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_report(df.repartition(7)).collect()), key=str)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len(WORD.findall(t or ""))) for i, t, s, _ in rows)
    sizes, taken, goal = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    names = sorted(sizes, key=lambda s: (s is None, s))
    assert np.allclose([goal[s] for s in names], shared([sizes[s] for s in names], [1, 2, 3] * 3))
    for s in names:
        assert abs(taken[s] - goal[s]) <= 3 * 128 and all(r.source_size == sizes[s] for r in got if r.source == s)
    assert mix_report(df.filter("false")).count() == 0


def taken(mix):
    return sorted(((r.doc_id, r.source, r.size, r.taken) for r in mix.taken().collect()), key=str)


def test_taken_follows_the_draw(spark, monkeypatch):
    df, _ = table(spark)
    monkeypatch.setattr("remembra.llm.mixing.SHARD", 64)
    one = taken(Mix(df, block=16))
    assert one == taken(Mix(df, block=16))
    assert one != taken(Mix(df, block=16, draw_seed=8)) and one != taken(Mix(df, block=16, seed=8))
    monkeypatch.setattr("remembra.llm.mixing.SHARD", 200)
    assert one != taken(Mix(df, block=16))


def test_packed_blocks_are_whole(spark, monkeypatch):
    monkeypatch.setattr("remembra.llm.mixing.SHARD", 64)
    df, rows = table(spark)
    df = df.filter("doc_id < 400 and text not like 'again%'")
    mix = Mix(df, block=16)
    packed = mix.packed(df).collect()
    words = Counter(w for r in packed for w in r.text.split(" "))
    want = {r.doc_id: r.taken for r in mix.taken().collect()}
    found = Counter()
    for w, n in words.items():
        found[int(w[1 : w.index("w")])] += n
    assert {k: v for k, v in want.items() if v} == dict(found)
    assert all(len(r.text.split(" ")) <= 16 for r in packed)
    # each shard holds what it has drawn
    about = sorted(mix.sources.collect(), key=lambda r: r.s)
    shards = -(-sum(r.slots for r in about) // 64)
    draw = Draw(np.array([r.blocks for r in about]), np.array([r.slots for r in about]), shards, 7)
    drawn = {(k, about[s].source): int(n) for k, _, a, _, b in draw.counts(0, shards) for s, n in enumerate(a + b) if n}
    assert Counter((r.shard, r.source) for r in packed) == drawn and shards > 10


def test_documents(spark):
    df, rows = table(spark)
    got = mix_documents(df)
    assert got.columns == df.columns
    got = got.collect()
    assert max(Counter(r.doc_id for r in got if r.doc_id != 3).values()) <= 3
    assert set(map(tuple, got)) <= set(rows)
    count = lambda t: len(WORD.findall(t or ""))
    words, sizes, longest = Counter(), Counter(), Counter()
    for r in got:
        words[r.source] += count(r.text)
    for _, t, s, _ in rows:
        sizes[s] += count(t)
        longest[s] = max(longest[s], count(t))
    names = sorted(sizes, key=lambda s: (s is None, s))
    assert len(rows) < CHUNK
    for s, goal in zip(names, shared([sizes[s] for s in names], [1, 2, 3] * 3), strict=True):
        assert abs(words[s] - goal) <= longest[s] + 128
    assert mix_documents(df.filter("false")).count() == 0


def test_any_column_names(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 5, 6, 7, 8)], "doc_id long, text string, source string, `a.b` int, s int, size int, row int")
    assert mix_documents(df).columns == df.columns and mix_documents(df).count() == 1


def test_texts_are_shuffled_whatever_the_size(spark):
    df = spark.createDataFrame([(k, f"w{k} x", "s") for k in range(50)], "doc_id long, text string, source string")
    plan = mix_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
