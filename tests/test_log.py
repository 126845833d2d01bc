"""One log over several parts, touches, and the metric index."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from remembra.operators import metric
from remembra.operators.bm25 import TextIndex, bm25
from remembra.operators.metric import VectorIndex
from remembra.sources.log import Conflict, Log
from remembra.sources.store import Store, stored, workspace

ROWS = "id long, content string, accessed_at timestamp, access_count long"


def at(day):
    return datetime(2024, 6, day)


def rows(spark, *ids, content="text"):
    return spark.createDataFrame([(i, f"{content} {i}", at(1), 0) for i in ids], ROWS)


def ids(spark, *some):
    return spark.createDataFrame([(i,) for i in some], "id long")


def parts(spark, folder):
    log = Log(spark, folder)
    return log, Store(spark, folder, log=log, part="rows"), TextIndex(spark, folder, "long", 2, log), Store(spark, folder, log=log, part="names", unique=True)


def take(log, store, index, names, new, batch=None):
    with log.transaction(batch) as now:
        if not now.done:
            store.append(new)
            index.add(new)
            names.append(new.select("id"))


def look(store, index, names, spark):
    found = index.bm25(spark.createDataFrame([(0, "text")], "q int, term string"))
    return sorted(r.id for r in store.read().collect()), sorted(r.id for r in found.collect()), sorted(r.id for r in names.read().collect())


def test_all_parts_or_none(spark, monkeypatch):
    folder = workspace(spark, "log")
    log, store, index, names = parts(spark, folder)
    take(log, store, index, names, rows(spark, 1, 2), "first")
    before = look(store, index, names, spark)
    assert before == ([1, 2],) * 3
    whole = Log.segment
    for step in range(5):  # four segments and the version
        left = [step]

        def fails(self, *a, **k):
            if not left[0]:
                raise OSError("lost")
            left[0] -= 1
            return whole(self, *a, **k)

        monkeypatch.setattr(Log, "segment", fails)
        if step == 4:
            monkeypatch.setattr(Log, "segment", whole)
            monkeypatch.setattr(Log, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            take(log, store, index, names, rows(spark, 3))
        monkeypatch.undo()
        assert log.version()[0] == 0
    assert look(*parts(spark, folder)[1:], spark) == before
    # tried again, then replayed
    for _ in range(2):
        take(log, store, index, names, rows(spark, 3), "second")
    assert look(store, index, names, spark) == ([1, 2, 3],) * 3 and index._totals() == (3, 6) and log.version()[0] == 1
    queries = spark.createDataFrame([(0, "text"), (0, "3")], "q int, term string")
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(index.bm25(queries)) == told(bm25(store.read(), queries))
    index.remove(ids(spark, 1))
    assert index._totals() == (2, 4) and [r.id for r in index.bm25(queries).orderBy("id").collect()] == [2, 3]


def test_two_writers(spark):
    folder = workspace(spark, "log")
    a, b = parts(spark, folder), parts(spark, folder)
    take(*a, rows(spark, 1, 2, 3, 4))
    # rows that don't meet: both count, what both add once
    with a[0].transaction():
        a[1].delete(ids(spark, 1))
        a[1].append(rows(spark, 5))
        a[3].append(ids(spark, 7, 8))
        with b[0].transaction():
            b[1].replace(rows(spark, 2, content="changed"))
            b[3].append(ids(spark, 8, 9))
        b[1].compact()
        assert sorted(r.id for r in a[1].read().collect()) == [2, 3, 4, 5]  # not yet the other's
    got = {r.id: r.content for r in b[1].read().collect()}
    assert got == {2: "changed 2", 3: "text 3", 4: "text 4", 5: "text 5"}
    assert sorted(r.id for r in b[3].read().collect()) == [1, 2, 3, 4, 7, 8, 9]
    # the same row: the second fails, and none of it counts
    with pytest.raises(Conflict), a[0].transaction():
        a[1].append(rows(spark, 6))
        a[1].delete(ids(spark, 3, 4))
        b[1].delete(ids(spark, 4))
    assert sorted(r.id for r in a[1].read().collect()) == [2, 3, 5]
    with pytest.raises(Conflict), a[0].transaction():
        a[1].write(rows(spark, 100))
        b[1].append(rows(spark, 6))
    with pytest.raises(Conflict), a[0].transaction():
        a[1].compact()
        b[1].compact()
    assert sorted(r.id for r in a[1].read().collect()) == [2, 3, 5, 6]


def test_touches(spark):
    folder = workspace(spark, "log")
    a, b = Store(spark, folder), Store(spark, folder)
    a.append(rows(spark, 1, 2, 3))
    touch = lambda day, *some: spark.createDataFrame([(i, at(day), 1) for i in some], "id long, accessed_at timestamp, accesses long")
    written = [s["name"] for s in a._version()[1] if s["kind"] == "rows"]
    with a.log.transaction():
        a.fold(touch(3, 1, 1, 2))
        b.fold(touch(2, 1), "search 1")
    b.fold(touch(2, 1), "search 1")
    told = lambda s: {r.id: (r.accessed_at.day, r.access_count) for r in s.read().collect()}
    want = {1: (3, 3), 2: (3, 1), 3: (1, 0)}
    assert told(a) == want and [s["name"] for s in a._version()[1] if s["kind"] == "rows"] == written
    # a touch between the read of an update and its commit isn't lost, nor counted twice
    with a.log.transaction():
        a.update(spark.createDataFrame([(1, "new")], "id long, content string"))
        b.fold(touch(5, 1, 2))
    want = {1: (5, 4), 2: (5, 2), 3: (1, 0)}
    assert told(a) == want
    with a.log.transaction():
        a.compact()
        b.fold(touch(6, 3))
    assert told(a) == want | {3: (6, 1)} and {s["kind"] for s in a._version()[1]} == {"rows", "touch"}
    a.compact()
    assert told(b) == want | {3: (6, 1)} and len(a._version()[1]) == 1


def test_metric_index(spark):
    r = random.Random(3)
    spots = [[r.uniform(-9, 9) for _ in range(6)] for _ in range(12)]
    points = {i: [x + r.gauss(0, 0.3) for x in spots[i % 12]] for i in range(500)}
    points |= {i: points[i - 500] for i in range(500, 540)}  # ties
    frame = lambda some: spark.createDataFrame([(i, points[i]) for i in some], "id long, vector array<double>")
    index = VectorIndex(spark, workspace(spark, "metric"))
    index.build(frame(range(300)).union(spark.createDataFrame([(None, points[0]), (900, None)], "id long, vector array<double>")))
    index.add(frame(range(300, 540)))
    index.remove(ids(spark, *range(0, 540, 9)))
    left = [i for i in points if i % 9]
    asked = {0: points[9], 1: points[100], 2: [0.0] * 6, 3: [100.0] * 6, 100: points[100]}
    queries = spark.createDataFrame(list(asked.items()), "q long, vector array<double>")

    def brute(k, own):
        out = []
        for q, v in asked.items():
            near = sorted((sum((x - y) ** 2 for x, y in zip(points[i], v)), i) for i in left if own or i != q)
            out += [(q, n + 1, i) for n, (_, i) in enumerate(near[:k])]
        return sorted(out)

    for k, own in ((10, True), (3, False), (600, True)):
        got = index.nearest(queries, k, own, report=True).collect()
        assert sorted((x.q, x["rank"], x.id) for x in got) == brute(k, own)
        if k == 10:  # few of the vectors are compared near the spots
            assert all(x.read < 250 for x in got if x.q in (0, 1))
    first = index.candidates(points[100], 1).first()
    assert first.id == 100 and math.isclose(first.vector_score, 1.0)
    empty = VectorIndex(spark, workspace(spark, "metric")).build(frame(range(300)).filter("false"))
    assert empty.nearest(queries, 3).count() == 0
    assert empty.add(frame([1, 2])).nearest(queries, 3).count() == 10


def test_metric_index_keeps_only_the_nearest(spark, monkeypatch):
    """What a search writes is k rows a query and task at most, not all that was compared; tasks take ROWS and QUERIES, and equal distances go by id."""
    r = random.Random(5)
    points = {i: [r.gauss(0, 1) for _ in range(8)] for i in range(300)}
    points |= {i: points[3] for i in range(300, 400)}  # a cell of copies
    rows = spark.createDataFrame([(f"n{i}", v) for i, v in points.items()], "id string, vector array<float>")
    points = {x.id: x.vector for x in rows.collect()}
    index = VectorIndex(spark, workspace(spark, "metric")).build(rows)
    asked = ["n3", "n399", "n7", "n8", "n250"]
    queries = rows.filter(rows.id.isin(asked)).withColumnRenamed("id", "q")
    want = sorted((q, n + 1, i) for q in asked for n, (_, i) in enumerate(sorted((sum((x - y) ** 2 for x, y in zip(points[i], points[q])), i) for i in points if i != q)[:4]))
    written = []
    monkeypatch.setattr(metric, "stored", lambda df, path: (written.append((path, out := stored(df, path))), out)[1])
    for size, many, pairs in ((1 << 13, 1 << 12, 1 << 18), (64, 2, 100)):
        monkeypatch.setattr(metric, "ROWS", size, raising=False)
        monkeypatch.setattr(metric, "QUERIES", many, raising=False)
        monkeypatch.setattr(metric, "PAIRS", pairs, raising=False)
        written.clear()
        assert sorted((x.q, x["rank"], x.id) for x in index.nearest(queries, 4, own=False).collect()) == want
        found = sum(df.count() for path, df in written if path.endswith(("/first", "/second")))
        assert found <= 2 * 4 * len(asked) * -(-len(points) // size)
