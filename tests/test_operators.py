"""Small hand-made cases of the store's operators."""

import json
import math
import random
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from remembra.functions import scoring, text, tiers
from remembra.operators import beliefs, clusters, contradictions, graph, ingest, maintenance
from remembra.operators.blocks import knn, similar_pairs
from remembra.operators.bm25 import normalised
from remembra.operators.search import Options, filters, gate, in_namespace
from remembra.sources import files
from remembra.sources.store import Store, workspace
from remembra.streaming import sessions

def as_of():
    return F.lit(datetime(2024, 6, 1)).cast("timestamp")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_smart_markdown_reads_lines_once(spark):
    texts = ["## Decision log", "Key: one", "some prose", "prefer: no", "* Lesson:  two \u2003", "and more", "", "- always this", "Fix: three", "#### deep", "\u00a0", "# ", "Bug: four"]
    lines = spark.createDataFrame([(1, n, x) for n, x in enumerate(texts)] + [(2, 0, "alone")], "file int, n int, line string")
    got = sorted((r.file, r.type, r.importance, r.tags, r.content) for r in ingest.smart_markdown(lines).collect())
    log = (["decision-log"], "episodic")
    assert got == sorted(
        [(1, t, i, ["high-signal"], c) for t, i, c in (("fact", 0.8, "one"), ("lesson", 0.85, "two"), ("lesson", 0.75, "three"), ("lesson", 0.75, "four"), ("preference", 0.7, "no"))]
        + [(1, log[1], 0.3, log[0], c) for c in ("some prose\nand more", "always this\n#### deep", "#")]
        + [(2, "semantic", 0.3, [], "alone")]
    )
    assert executed(ingest.smart_markdown(lines)).count("ExistingRDD") == 1 and "regexp_replace" not in executed(lines.select(text.trim(F.col("line"))))


def test_recency(spark):
    ages = spark.createDataFrame([(d,) for d in (0, 1, 14, 30, 365)], "d int").select(scoring.recency(F.timestamp_micros(F.unix_micros(as_of()) - F.col("d").cast("long") * 86_400_000_000), as_of()).alias("r"))
    now, day, half, month, year = [r.r for r in ages.collect()]
    assert now == 1 and now > day > half > month > year and abs(half - 0.5) < 0.01 and year < 0.01


def test_access_and_boost(spark):
    got = spark.createDataFrame([(0,), (1,), (10,), (1000,)], "n int").select(scoring.access_frequency(F.col("n")).alias("a")).collect()
    assert got[0].a == 0 and got[0].a < got[1].a < got[2].a and got[3].a == 1
    kinds = spark.createDataFrame([(k,) for k in ("decision", "fact", "semantic", "unknown")], "t string").select(scoring.type_boost(F.col("t")).alias("b")).collect()
    assert [r.b for r in kinds] == [1.0, 0.8, 0.5, 0.5]


def test_hybrid(spark):
    def score(v, b, r, i, n, t):
        return one(spark, scoring.hybrid(*(F.lit(x) for x in (v, b, r, i, n, t))).alias("s")).s

    assert 0 < score(0.8, 0.5, 0.9, 0.7, 5, "semantic") <= 1
    assert score(0.9, 0.5, 0.9, 0.7, 5, "semantic") > score(0.2, 0.5, 0.9, 0.7, 5, "semantic")
    assert score(0.0, 0.0, 0.0, 0.0, 0, "semantic") < 0.05


def test_bm25_normalised(spark):
    for scores, want in (([10.0, 5.0, 2.0], [1, 0.5, 0.2]), ([0.0, 0.0], [0, 0]), ([42.0], [1])):
        df = spark.createDataFrame([(0, i, s) for i, s in enumerate(scores)], "q int, id int, bm25 double")
        assert [r.bm25 for r in normalised(df).orderBy("id").collect()] == want


def test_tiers(spark):
    texts = ["A" * 1000 + ". next", "First one. Second", "para one\n\n" + "B" * 3000, "\nstarts late", "Uses MongoDB here! It has Redis and userAPI too"]
    got = spark.createDataFrame([(t,) for t in texts], "c string").select(tiers.l0(F.col("c")).alias("l0"), tiers.l1(F.col("c")).alias("l1")).collect()
    assert all(len(r.l0) <= 400 and len(r.l1) <= 2000 for r in got)
    assert got[1].l0 == "First one. [Second]" and got[2].l1 == "para one" and got[3].l0 == "starts late" and got[4].l0 == "Uses MongoDB here! [Redis, userAPI]"
    long, short, gone = "x" * 3000, "s", None
    r = one(spark, *(tiers.at_depth(F.lit(long), F.lit(a).cast("string"), F.lit(a).cast("string"), d).alias(f"d{d}{i}") for i, a in enumerate((short, gone, "")) for d in (0, 1, 2)))
    assert (r.d00, r.d10, r.d20) == ("s", "s", long) and all(len(r[f"d0{i}"]) == 400 and len(r[f"d1{i}"]) == 2000 for i in (1, 2))


def test_hash_trims(spark):
    r = one(spark, *(text.content_hash(F.lit(x)).alias(n) for n, x in (("a", "hello"), ("b", " \n hello\t "), ("c", "b"))))
    assert r.a == r.b != r.c


def test_ascii_boundaries(spark):
    r = one(spark, text.matches(F.lit("éis"), r"\bis\b").alias("a"), text.matches(F.lit("this"), r"\bis\b").alias("b"), text.matches(F.lit("x\n"), "x$").alias("c"))
    assert r.a and not r.b and not r.c


def test_namespaces_and_gates(spark):
    df = spark.createDataFrame([("projects/a",), ("projects",), ("projectsx",), ("personal",)], "namespace string")
    assert {r[0] for r in df.filter(in_namespace("projects", True)).collect()} == {"projects/a", "projects"}
    assert {r[0] for r in df.filter(in_namespace("projects/", True)).collect()} == {"projects/a"}
    assert {r[0] for r in df.filter(in_namespace("projects")).collect()} == {"projects"}
    c = spark.createDataFrame([(1, 0.1, 0.0, True, False), (2, 0.5, 0.0, True, False), (3, 0.0, 0.5, False, True), (4, 0.0, 0.1, False, True), (5, 0.0, 0.0, True, True)], "id int, vector_score double, bm25 double, has_vector boolean, has_text boolean")
    assert {r.id for r in c.filter(gate(Options())).collect()} == {2, 3, 5}
    m = spark.createDataFrame([('{"project": "p"}', "x"), (None, "y"), ('{"project": ""}', "z"), ('{"project": "q"}', "w"), ("{}", "v"), ("no json", "u")], "metadata string, id string")
    assert {r.id for r in m.filter(filters(Options(project="p"))).collect()} == {"x", "y", "z", "v", "u"}


def test_decay(spark):
    day = 86_400_000_000
    m = spark.createDataFrame([(1, 0.8, 1), (2, 0.8, 40), (3, 0.06, 4000)], "id int, importance double, d int").withColumn("accessed_at", F.timestamp_micros(F.unix_micros(as_of()) - F.col("d").cast("long") * day))
    got = {r.id: r.decayed for r in maintenance.decay(m, as_of()).collect()}
    assert set(got) == {2} and got[2] < 0.8
    assert one(spark, scoring.decayed(F.lit(0.8), F.lit(10000.0)).alias("x")).x == 0.05


def leaders(n, edges):
    near, seeds, out = {}, [], {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i in range(n):
        s = next((x for x in seeds if x in near.get(i, ())), None)
        if s is None:
            seeds.append(i)
        else:
            out[i] = s
    return out


def test_leaders_and_components_on_random_graphs(spark):
    r = random.Random(8)
    edges, groups, n = [], {}, 25
    for g in range(6):
        for _ in range(r.choice([5, 20, 60])):
            a, b = r.sample(range(n), 2)
            edges.append((g, min(a, b), max(a, b)))
    wanted = {}
    for g in range(6):
        mine = [(a, b) for x, a, b in edges if x == g]
        wanted |= {g * 100 + m: g * 100 + s for m, s in leaders(n, mine).items()}
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in mine:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        groups |= {g * 100 + i: g * 100 + find(i) for e in mine for i in e}
    df = spark.createDataFrame([(g * 100 + a, g * 100 + b) for g, a, b in set(edges)], "a long, b long")
    keys = spark.createDataFrame([(g * 100 + i, g * 100 + i) for g in range(6) for i in range(n)], "id long, key long")
    assert {x.member: x.seed for x in clusters.leader_clusters(df, keys).collect()} == wanted
    assert {x.id: x.component for x in clusters.components(df).collect()} == groups


def test_block_pairs(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    assert {(x.a, x.b) for x in similar_pairs(df, 0.8).collect()} == {(i, j) for i in range(60) for j in range(i + 1, 60) if cos(rows[i][1], rows[j][1]) >= 0.8}
    named = df.withColumn("id", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")))
    assert {(x.a, x.b) for x in similar_pairs(named, 0.8).collect()} == {(f"n{x.a:03d}", f"n{x.b:03d}") for x in similar_pairs(df, 0.8).collect()}
    assert {(x.q, x.rank, x.id) for x in knn(named, named, 3).collect()} == {(f"n{x.q:03d}", x.rank, f"n{x.id:03d}") for x in knn(df, df, 3).collect()}
    near = {}
    for x in knn(df, df, 3).collect():
        near.setdefault(x.q, {})[x.rank] = x.id
    assert near[0] == {k + 1: j for k, (_, j) in enumerate(sorted((sum((a - b) ** 2 for a, b in zip(rows[0][1], rows[j][1])), j) for j in range(1, 61))[:3])}


def test_copies_follow_their_first(spark):
    r = random.Random(3)
    some = [[r.gauss(0, 1) for _ in range(3)] for _ in range(15)] + [[0.0] * 3]
    rows = [(i, r.choice(some)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    keys = spark.createDataFrame([(i, (i * 37) % 80) for i in range(80)], "id long, key long")
    pairs = similar_pairs(df, 0.9)
    plain = lambda d: sorted(map(tuple, d.collect()))
    assert plain(clusters.leaders(df, keys, 0.9)) == plain(clusters.leader_clusters(pairs, keys))
    found, links = clusters.groups(df, 0.9)
    assert plain(found) == plain(clusters.components(pairs))
    m = spark.createDataFrame([(i, 0.5 + i % 2 / 4, datetime(2024, 1, 1 + i % 9)) for i in range(80)], "id long, importance double, created_at timestamp")
    gone = clusters.dedup_groups(found, links, m)
    assert gone.count() == found.count() - found.select("component").distinct().count() and gone.filter("similarity < 0.9").count() == 0


def test_strips_of_a_cell(monkeypatch):
    """A block is multiplied in strips, and no more pairs than PAIRS are computed exactly at once."""
    from remembra.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 7)
    monkeypatch.setattr(blocks, "PAIRS", 5)
    g = np.random.default_rng(4)
    a, b = (np.vstack([g.normal(size=(20, 4)), np.zeros((1, 4)), g.integers(0, 2, (n, 4))]).astype(np.float32) for n in (9, 14))
    size = lambda v: np.sqrt((v.astype(float) ** 2).sum(1))
    for other, met in ((b, False), (a, True)):
        with np.errstate(invalid="ignore", divide="ignore"):
            near = (a.astype(float) @ other.T) / np.outer(size(a), size(other)) >= 0.8
        got = [(x, y) for part in blocks._strips(met, a, other, 0.8, False) for x, y in zip(part[0], part[1])]
        assert sorted(got) == [(x, y) for x, y in np.argwhere(near).tolist() if not met or x < y]
    ids, others = np.arange(len(a)), np.arange(len(b)) * 2
    x, y, d = blocks._near(a, b, ids, others, np.arange(len(b)), 3)
    exact = ((a[:, None].astype(float) - b) ** 2).sum(2)
    wanted = [(i, j) for i in range(len(a)) for _, j in sorted((exact[i, j], j) for j in range(len(b)) if others[j] != i)[:3]]
    assert list(zip(x, y)) == wanted and np.allclose(d, [exact[i, j] for i, j in wanted])


def test_blocks_do_not_grow_in_number(spark):
    from remembra.operators import blocks

    few = spark.range(blocks.BLOCK * 100).select("id", F.array(F.lit(1.0).cast("float")).alias("vector"))
    assert blocks._blocks(few) == blocks.MOST_BLOCKS and blocks._blocks(few.limit(5)) == 1
    whole = spark.createDataFrame([(1, [1, 2]), (2, [2, 4]), (3, [-1, 0])], "id long, vector array<bigint>")
    for kind in ("bigint", "int", "float", "double", "decimal(9,2)"):
        assert [(x.a, x.b) for x in similar_pairs(whole.withColumn("vector", F.col("vector").cast(f"array<{kind}>")), 0.9).collect()] == [(1, 2)]


def test_spanning_pairs(spark):
    from remembra.operators import blocks

    g = np.random.default_rng(5)
    x, y, c = g.integers(0, 30, 80), g.integers(30, 60, 80), g.random(80)
    keep = blocks._forest(x, y, c, 60)

    def parts(some):
        root = list(range(60))
        for k in some:
            p, q = root[x[k]], root[y[k]]
            root = [p if r == q else r for r in root]
        return {frozenset(i for i in range(60) if root[i] == r) for r in set(root)}

    assert parts(keep) == parts(range(80)) and len(keep) == 60 - len(parts(keep))
    best = lambda some: {p: max(c[k] for k in some if x[k] in p) for p in parts(range(80)) if len(p) > 1}
    assert best(keep) == best(range(80))
    # a hundred rows that are all alike: a pair for each, not one for each two
    df = spark.createDataFrame([(i, [100.0, float(i % 7), float(i)]) for i in range(100)], "id long, vector array<double>")
    assert similar_pairs(df, 0.5).count() == 4950 and clusters.groups(df, 0.5)[1].count() == 99


def test_leaders_in_batches(spark, monkeypatch):
    """Batches give what one pass gives, and rows near an earlier seed are paired no more."""
    r = random.Random(6)
    df = spark.createDataFrame([(i, [float(r.randrange(5)) for _ in range(3)]) for i in range(150)], "id long, vector array<double>")
    keys = spark.createDataFrame([(i, (i * 37) % 151) for i in range(150)], "id long, key long")
    paired = []
    pairs = clusters.similar_pairs
    monkeypatch.setattr(clusters, "FIRST_BATCH", 15)
    monkeypatch.setattr(clusters, "similar_pairs", lambda *a: paired.append(pairs(*a)) or paired[-1])
    for strict in (False, True):
        wanted = sorted(map(tuple, clusters.leader_clusters(pairs(df, 0.9, strict), keys).collect()))
        assert sorted(map(tuple, clusters.leaders(df, keys, 0.9, strict).collect())) == wanted
    assert len(paired) > 4 and sum(p.count() for p in paired) < pairs(df, 0.9).count() / 2


def test_postings_are_counted_where_documents_are_read(spark):
    from remembra.operators import bm25

    docs = spark.createDataFrame([(1, "A a B-c É c1"), (2, None), (3, ""), (4, "b")], "id int, content string")
    found = bm25.postings(docs)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 2, 5), ("b", 1, 1, 5), ("b", 4, 1, 1), ("c", 1, 1, 5), ("c1", 1, 1, 5)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_common_terms_are_not_one_task(spark):
    """Postings of many queries' terms meet these by broadcast, however small the threshold, not in a shuffle by the term."""
    from remembra.operators import bm25

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(30).select("id", F.concat(F.lit("the n"), F.col("id").cast("string")).alias("content"))
        queries = spark.createDataFrame([(q, t) for q in range(3) for t in ("the", f"n{q}")], "q int, term string")
        scored = bm25.bm25(docs, queries)
        assert scored.count() == 90 and {(r.q, r.id) for r in scored.filter("bm25 > 1").collect()} == {(q, q) for q in range(3)}
        assert "SortMergeJoin" not in scored._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_related_behaviour_meets_in_cells(spark, monkeypatch):
    """Only sums leave the cells of a holder, whatever parts the sides are cut into."""
    r = random.Random(9)
    vocabulary = ["committed", "skipped", "consistent", "garden", "market", "engine", "window", "letter"]
    say = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randrange(5)))
    held = [(i, i % 2, say(), datetime(2024, 1, 1)) for i in range(30)]
    done = [(i, i % 2, say(), datetime(2024, 1, 1 + i % 9), [i % 40] if i % 4 == 0 else []) for i in range(40)]
    beliefs_, did = spark.createDataFrame(held, "id long, holder long, content string, created_at timestamp"), spark.createDataFrame(done, "id long, holder long, content string, created_at timestamp, related array<long>")
    wanted = {}
    for i, h, text_, _ in held:
        near = [d for d in done if d[1] == h and (i in d[4] or sum(w in d[2].split() for w in text_.split()) >= 2)]
        some = lambda d, terms: any(t in d[2] for t in terms)
        if near:
            latest = sorted(near, key=lambda d: (d[3], d[0]), reverse=True)[:3]
            wanted[i] = (len(near), sum(some(d, beliefs.SUPPORTS) for d in near), sum(some(d, beliefs.CONTRADICTS) and not some(d, beliefs.SUPPORTS) for d in near), sum(some(d, beliefs.ALIGNED) for d in near), [d[0] for d in latest])
    for at_once in (512, 2):
        monkeypatch.setattr(beliefs, "AT_ONCE", at_once)
        found = beliefs.related_signals(beliefs_, did)
        assert {x.belief: (x.signals, x.supporting, x.contradicting, x.aligned, [y.behaviour for y in x.latest]) for x in found.collect()} == wanted
    for _, near in beliefs._met(pd.DataFrame({"id": [1, 2], "words": [["aaaa", "aaaa"], ["bbbb"]]}), pd.DataFrame({"words": [["aaaa"], ["bbbb"]], "related": [None, [1]]}), 2):
        assert near.tolist() == [[True, True], [False, False]]


def test_contradictions(spark):
    cases = [
        ("The payment service is working fine today", "The payment service is not working fine today", 0, "negation"),
        ("The deploy pipeline server is active now", "The deploy pipeline server is inactive now", 0, "status"),
        ("Plan pricing costs $49 per seat monthly", "Plan pricing costs $99 per seat monthly", 0, "numerical"),
        ("Nightly job had 0 errors yesterday evening", "Nightly job had 3 errors yesterday evening", 0, "numerical"),
        ("Plan pricing costs $49 per seat monthly", "Plan pricing costs $49 per seat monthly", 0, None),
        ("Completely different words here", "Nothing shared between sentences", 0, None),
        ("The payment service is working fine today", "The payment service is not working fine today", 2, "temporal"),
    ]
    at = datetime(2024, 1, 1)
    a = spark.createDataFrame([(i, x, at) for i, (x, _, _, _) in enumerate(cases)], "id long, content string, created_at timestamp")
    b = spark.createDataFrame([(i, y, datetime(2024, 1, 1 + d)) for i, (_, y, d, _) in enumerate(cases)], "id long, content string, created_at timestamp")
    pairs = contradictions.features(a, "a").join(contradictions.features(b, "b"), F.col("a_id") == F.col("b_id"))
    got = {r.a_id: r.kind for r in contradictions.temporal(contradictions.scored(pairs)).collect()}
    assert got == {i: k for i, (_, _, _, k) in enumerate(cases) if k}
    amounts = one(spark, contradictions.numbers(F.lit("$1,000 and $1.5k, 50% of 10 users")).alias("n")).n
    assert amounts == [1000.0, 1500.0, 50.0, 10.0]


def test_contradictions_are_scored_once(spark):
    said = ["It isn't  here now. The cannot word, no-one said; ok?! Never mind that", "Fails twice a day... not\nshe can't do'nt, \u00c9t\u00e9 isn't x", "", "nothing knot cannots isn'ts"]
    rows = spark.createDataFrame([(k, t, datetime(2024, 1, 1)) for k, t in enumerate(said)], "id int, content string, created_at timestamp")
    f = {r.id: r for r in contradictions.features(rows, "x").select(F.col("x_id").alias("id"), "x_words", "x_said").collect()}
    assert f[0].x_words == ["isn't", "cannot", "word", "no-one", "said", "never", "mind"] and [s.n for s in f[0].x_said] == [True, True, True]
    assert f[1].x_words == ["fails", "twice", "day", "not", "can't", "do'nt", "isn't"] and [s.n for s in f[1].x_said] == [True, True]
    assert f[2].x_words == [] and [s.n for s in f[3].x_said] == [False]
    pairs = contradictions.features(rows, "a").crossJoin(contradictions.features(rows, "b"))
    filters = [x for x in executed(contradictions.scored(pairs)).splitlines() if "Filter " in x or "Join " in x]
    assert not any("array_union" in x or "array_intersect" in x for x in filters)


def test_transcript_classes_are_found_once(spark):
    told = ["We decided: no, she'll go on", "learned it the hard way", "The undecided one was here all day long", "x decisions are not facts", "They have it, and it works"]
    rows = spark.createDataFrame([(1, n, x) for n, x in enumerate(told)], "file int, n int, line string")
    got = ingest.transcript_memories(rows)
    assert {r.n: r.tags[0] for r in got.collect() if r.j == ingest.SEGMENT} == {0: "decision", 1: "lesson", 2: "fact"}
    assert executed(ingest.transcript_memories(rows)).count("we decided") == 1


def test_graph(spark):
    m = spark.createDataFrame([(1, "Today Acme Labs uses Big Data Systems. Then Ada Lovelace met Bob Stone on 2024-01-05."), (2, "see https://x.y/z, ok")], "id long, content string")
    found = graph.entities(m, [(r"acme\w*", "Acme", "project")])
    names = {(r.id, r.name, r.type) for r in found.collect()}
    assert {(1, "Acme", "project"), (1, "Ada Lovelace", "person"), (1, "Bob Stone", "person"), (1, "2024-01-05", "date"), (2, "https://x.y/z", "url")} <= names
    rel = {(r.source, r.target, r.relation) for r in graph.relationships(m, found).collect()}
    assert any(x[2] == "uses" for x in rel) and ("ada lovelace", "bob stone", "co-occurs-with") in {(*sorted(x[:2]), x[2]) for x in rel}
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r"), ("a", "a", "self")], "source string, target string, relation string")
    got = {(r.id, r.depth, r.parent) for r in graph.traverse(edges, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {("a", 0, None), ("b", 1, "a"), ("c", 2, "b")}


def test_beliefs_and_metadata(spark):
    meta = json.dumps({"confidence": 0.7, "domain": "d", "holder": "user", "status": "active", "history": []})
    m = spark.createDataFrame([(1, "belief", meta), (2, "fact", None)], "id long, type string, metadata string")
    b = beliefs.typed(m, "belief").withColumn("importance", F.lit(0.8))
    new = beliefs.reweighed(b, spark.createDataFrame([(1, 0.9, "again")], "id long, new_confidence double, reason string"), as_of()).first()
    assert new.confidence == 0.9 and new.times_confirmed == 1 and new.times_refuted == 0 and len(new.history) == 1 and new.importance == 0.9
    near = spark.createDataFrame([(7, 1, 0.95), (7, 2, 0.5), (8, 1, 0.9)], "q long, id long, vector_score double")
    got = {r.id: r.merged_into for r in beliefs.stated_again(spark.createDataFrame([(7,), (8,)], "id long"), near).collect()}
    assert got == {7: 1, 8: None}
    r = one(spark, beliefs.evidence_suggestion(F.array(F.lit(0.9)), F.lit(0.2), F.array(F.lit(0.1))).alias("a"), beliefs.evidence_suggestion(F.array(F.lit(0.1)), F.lit(0.95), F.array(F.lit(0.5))).alias("b"))
    assert r.a == 0.1 and r.b == 1.0


def test_store(spark):
    store = Store(spark, workspace(spark, "store"))
    rows = spark.createDataFrame([(f"abc{i}", f"text {i}", datetime(2024, 1, 1), 0) for i in range(5)] + [("zzz", "last", datetime(2024, 1, 1), 2)], "id string, content string, accessed_at timestamp, access_count long")
    store.append(rows)
    store.append(spark.createDataFrame([("new", "added", "extra")], "id string, content string, note string"))
    assert store.read().count() == 7 and "note" in store.read().columns
    assert store.get("abc").first().id == "abc0" and store.get("q").count() == 0
    store.update(spark.createDataFrame([("zzz", "changed")], "id string, content string"))
    assert store.get("zzz").first().content == "changed" and store.get("zzz").first().access_count == 2
    assert not store.delete_prefix("abc") and not store.delete_prefix("none") and store.delete_prefix("zz")
    store.delete(spark.createDataFrame([("abc0",), ("abc1",)], "id string"))
    store.fold(spark.createDataFrame([("abc2", datetime(2024, 5, 1), 1), ("abc2", datetime(2024, 4, 1), 2)], "id string, accessed_at timestamp, accesses long"))
    got = store.get("abc2").first()
    assert got.access_count == 3 and got.accessed_at == datetime(2024, 5, 1) and store.read().count() == 4


SESSION = [
    {"type": "session", "id": "s-1", "timestamp": "t"},
    {"type": "message", "message": {"role": "assistant", "content": "before any question"}},
    {"type": "message", "message": {"role": "user", "content": "How do I deploy the api?"}},
    {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "Run git push and wait for it."}, {"type": "tool_use", "name": "bash"}]}},
    {"type": "message", "message": {"role": "toolResult", "content": "huge"}},
    {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "It is deployed."}]}},
    {"type": "message", "message": {"role": "user", "content": "two users"}},
    {"type": "message", "message": {"role": "user", "content": "in a row, really"}},
    {"type": "message", "message": {"role": "assistant", "content": "HEARTBEAT_OK, nothing more"}},
]


def test_sessions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/log.jsonl").write_text("\n".join(["not json", *map(json.dumps, SESSION)]))
    rows = ingest.exchanges(files.session_logs(spark, str(tmp_path / "in"))).orderBy("exchange").collect()
    assert [(r.session, r.user, r.tools) for r in rows] == [("s-1", "How do I deploy the api?", ["bash"]), ("s-1", "in a row, really", [])]
    assert rows[0].assistant == "Run git push and wait for it.\nIt is deployed."
    taken = []
    for _ in range(2):
        query = sessions.ingest_sessions(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda df, n: taken.extend(df.collect()))
        query.awaitTermination()
    assert [r.user for r in taken] == ["How do I deploy the api?"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, h), ["x", "y"], 2.0 if h else 0.0, f"t {h % 2}") for h in range(3)], "created_at timestamp, topics array<string>, duration double, content string")
    rows.write.parquet(str(tmp_path / "rows"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))

    def ran(df, mode, name):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name).collect()

    got = ran(sessions.attention_windows(stream()), "complete", "windows")
    assert sorted((r.topic, r.minutes) for r in got) == [("x", 1.0), ("x", 2.0), ("x", 2.0), ("y", 1.0), ("y", 2.0), ("y", 2.0)]
    assert len(ran(sessions.first_seen(stream()), "append", "firsts")) == 2


def test_export(spark):
    node = lambda role, parts, parent, children: {"message": {"author": {"role": role}, "content": {"content_type": "text", "parts": parts}}, "parent": parent, "children": children} if role else {"message": None, "parent": parent, "children": children}
    long = "w" * 1500
    mapping = {"root": node(None, [], None, ["a"]), "a": node("user", ["a question that is long enough"], "root", ["b", "c"]), "b": node("assistant", [long], "a", []), "c": node("assistant", [long], "a", ["d"]), "d": node("user", ["short"], "c", [])}
    df = spark.createDataFrame([(json.dumps({"id": "x", "title": "t", "create_time": 1.0, "mapping": mapping}),)], "json string")
    m = files.export_messages(df)
    assert [r.role for r in m.orderBy("place").collect()] == [None, "user", "assistant", "assistant", "user"]
    assert [len(r.text) for r in files.chunks(m).orderBy("chunk").collect()] == [30 + 6 + 2 + 11 + 1500, 1511]


def test_blocks_travel_in_parts(spark, monkeypatch):
    """No row of a cell holds more than PART_BYTES of vectors, however large its blocks are, and parts give what whole blocks give."""
    from remembra.operators import blocks

    r = random.Random(11)
    top = lambda i: r.choice([1, 9]) * {0: 1, 1: 200, 2: 70_000, 3: -3}[i % 4]
    rows = [(i, [top(i) if r.random() < 0.6 else 0 for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, vector array<int>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    near = {(i, j) for i, a in rows for j, b in rows if i != j and any(a) and any(b) and dot(a, b) / math.sqrt(dot(a, a)) / math.sqrt(dot(b, b)) >= 0.9}
    monkeypatch.setattr(blocks, "BLOCK", 40)
    monkeypatch.setattr(blocks, "PART_BYTES", 64)
    cells = blocks._cells(df, None)
    assert cells.filter(F.length("vectors") > 64).count() == 0
    # each of three blocks meets the two others and itself, as one side
    assert cells.select(F.explode("ids")).count() == 3 * 120 and {x.kind for x in cells.select("kind").distinct().collect()} == {"u1", "u2", "i4"}
    assert {(x.a, x.b) for x in similar_pairs(df, 0.9).collect()} == {(i, j) for i, j in near if i < j}
    low, high = df.filter("id < 60"), df.filter("id >= 60")
    assert {x.id: x.first for x in blocks.first_similar(low, high, 0.9).collect()} == {j: min(i for i, k in near if k == j and i < 60) for j in range(60, 120) if any(k == j and i < 60 for i, k in near)}


def test_sure_pairs_are_not_computed_exactly(monkeypatch):
    """Where the cosines aren't told, only those that single precision leaves open are computed exactly; the pairs are the same."""
    from remembra.operators import blocks

    g = np.random.default_rng(12)
    a, b = g.integers(0, 3, (60, 5)).astype(np.uint8), g.integers(0, 3, (50, 5)).astype(np.uint8)
    b[:5] = [3, 4, 0, 0, 0]
    a[:5] = [1, 0, 0, 0, 0]  # a cosine of 0.6, the threshold
    exact, by_parts = [], blocks._by_parts
    monkeypatch.setattr(blocks, "_by_parts", lambda x, y, f: exact.append(len(x)) or by_parts(x, y, f))
    for strict in (False, True):
        found = [sorted((x, y) for part in blocks._strips(False, a, b, 0.6, strict, told) for x, y in zip(part[0].tolist(), part[1].tolist())) for told in (True, False)]
        assert found[0] == found[1] and ((0, 0) in found[0]) != strict
    assert 25 <= exact[1] < exact[0] / 3
