"""Exact nearest neighbours through a partitioned metric index: rows by cells with radii, cells passed over by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remembra.functions import vectors
from remembra.sources.log import Log
from remembra.sources.store import Store, stored, workspace

#: Most cells, rows that their centers are fitted on, and rounds of the fit.
MOST_CELLS, SAMPLE, ROUNDS = 1024, 16_384, 8
#: Queries up to which the cells that they need are gathered, so that other cells' files aren't opened.
FEW_QUERIES = 64
#: Rows and queries that a task compares at once, pairs of a step, and found rows of a task that ranks them.
ROWS, QUERIES, PAIRS, FOUND = 1 << 13, 1 << 12, 1 << 18, 1 << 19
#: Share by which bounds are widened for the rounding of distances.
SLACK = 1e-9


def centers_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centers of a sample's cells by rounds of assignment and mean, from evenly spread rows; a cell that nothing falls to keeps its center."""
    centers = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = np.argmin((centers * centers).sum(1) - 2 * sample @ centers.T, axis=1)
        for c in np.unique(near):
            centers[c] = sample[near == c].mean(0)
    return centers


def _distances(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """From each vector to each center, without the loss of digits that products of close vectors bring."""
    out = np.empty((len(v), len(centers)))
    for k in range(0, len(v), 256):
        out[k : k + 256] = np.sqrt(((v[k : k + 256, None] - centers) ** 2).sum(2)) if v.shape[1] * len(centers) < 1 << 16 else np.stack([np.sqrt(((x - centers) ** 2).sum(1)) for x in v[k : k + 256]])
    return out


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _squared(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """From each of a to each of v, summed from left to right as vectors.squared_l2 does."""
    out = np.zeros((len(a), len(v)))
    for x, y in zip(a.T, v.T):
        step = x[:, None] - y
        out += step * step
    return out


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k least of each row of d, the first ones of equal ones."""
    if d.shape[1] <= k:
        return np.ones(d.shape, bool)
    last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    less, equal = d < last, d == last
    return less | (equal & (np.cumsum(equal, axis=1) <= k - less.sum(1, keepdims=True)))


def _matched(k: int, own: bool, report: bool):
    """Of a task's rows, each query's k nearest among its cells and within its reach; report: also a row of its own, without an id, of how many were compared."""

    def run(key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        asked, rows = asked.combine_chunks(), rows.take(pc.sort_indices(rows, [("cell", "ascending"), ("id", "ascending")])).combine_chunks()
        ids = rows.column("id")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        read = np.zeros(asked.num_rows, np.int64)
        if asked.num_rows and rows.num_rows:
            a, v = _matrix(asked.column("asked").chunk(0), asked.num_rows), _matrix(rows.column("vector").chunk(0), rows.num_rows)
            cell, radius, reach = (x.to_numpy() for x in (rows.column("cell"), rows.column("radius"), asked.column("reach")))
            wanted = asked.column("cells").chunk(0)
            who, which, middle = np.repeat(np.arange(len(a)), pc.list_value_length(wanted).to_numpy()), wanted.flatten().to_numpy(), asked.column("middles").chunk(0).flatten().to_numpy()
            order = np.argsort(which, kind="stable")
            who, which, middle = who[order], which[order], middle[order]
            if not own:  # equal ids by number
                kinds = ids.unique()
                number, mine = (pc.fill_null(pc.index_in(x, kinds), -1).to_numpy() for x in (ids, asked.column("me")))
            for c in np.unique(cell):
                lo, hi = np.searchsorted(cell, [c, c + 1])
                p, q = np.searchsorted(which, [c, c + 1])
                step = max(1, PAIRS // (hi - lo))
                for at in range(p, q, step):
                    some, mid = who[at : min(at + step, q)], middle[at : min(at + step, q)]
                    bound = reach[some][:, None]
                    ok = ~(np.abs(mid[:, None] - radius[lo:hi]) * (1 - SLACK) > bound)
                    if not own:
                        ok &= number[lo:hi] != mine[some][:, None]
                    read[some] += ok.sum(1)
                    d = _squared(a[some], v[lo:hi])
                    order_by = np.where(ok, d, np.inf)
                    x, y = np.nonzero(_least(np.where(np.isnan(order_by), np.inf, order_by), k) & ok & ~(np.sqrt(d) > bound))
                    found.append((some[x], y + lo, d[x, y]))
        who, row, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        rank = pc.rank(ids, tiebreaker="first").to_numpy() if rows.num_rows else np.zeros(0)
        order = np.lexsort((rank[row], d, who))
        who, row, d = who[order], row[order], d[order]
        if len(who):
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            keep = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who)))) < k
            who, row, d = who[keep], row[keep], d[keep]
        out = pa.table({"q": asked.column("q").take(pa.array(who)), "id": ids.take(pa.array(row)), "distance": pa.array(d), "read": pa.array(np.zeros(len(d), np.int64))})
        if report:
            told = {"q": asked.column("q"), "id": pa.nulls(len(read), ids.type), "distance": pa.nulls(len(read), pa.float64()), "read": pa.array(read)}
            out = pa.concat_tables([out, pa.table(told)])
        return out

    return run


class VectorIndex:
    """Vectors by id in cells around fixed centers, in two parts of a log of versions: rows (id, vector, cell, radius), a folder for each cell and sorted by their distance from
    its center (radius), and of each cell how many rows it has been given and their largest radius.

    build() fits centers on at most SAMPLE rows, the first by a hash of their ids, and gives every row to its nearest center; add() gives more rows to the same centers; remove() takes ids out, which
    leaves radii as upper bounds. A row of a cell is no nearer to a query than |distance to the center - radius|, so a search reads the cells nearest first until it has
    k rows, and of the rest what can lie within the k-th distance; the result is that of a scan. Rows with a null id or vector are left out.
    """

    def __init__(self, spark: SparkSession, folder: str, log: Log | None = None, part: str = "vectors"):
        self.spark, self.log = spark, log or Log(spark, folder)
        self.rows = Store(spark, folder, log=self.log, part=part, partition="cell")
        self.cells = Store(spark, folder, log=self.log, part=f"{part}-cells", partition=None)

    def exists(self) -> bool:
        return self.rows.exists()

    def _centers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the cells, MOST_CELLS at most: number, center, largest radius and count of rows."""
        told = self.cells.read().groupBy("cell").agg(F.max("center").alias("center"), F.max("radius").alias("radius"), F.sum("n").alias("n")).orderBy("cell").collect()
        return np.array([r.cell for r in told]), np.array([r.center for r in told], np.float64), np.array([r.radius for r in told]), np.array([r.n for r in told])

    def _assigned(self, rows: DataFrame, numbers: np.ndarray, centers: np.ndarray) -> DataFrame:
        kind = dict(rows.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = _distances(_matrix(batch.column(1), batch.num_rows), centers)
                    near = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers[near].astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["id", "vector", "cell", "radius"])

        return rows.mapInArrow(run, f"id {kind['id']}, vector {kind['vector']}, cell int, radius double")

    def _put(self, rows: DataFrame, numbers: np.ndarray, centers: np.ndarray, fresh: bool) -> None:
        made = stored(self._assigned(rows, numbers, centers), f"{workspace(self.spark, 'metric')}/rows")
        told = made.groupBy("cell").agg(F.max("radius").alias("radius"), F.count("*").alias("n"))
        known = self.spark.createDataFrame([(int(c), [float(x) for x in v]) for c, v in zip(numbers, centers)], "cell int, center array<double>")
        cells = known.join(told, "cell", "left" if fresh else "inner").select("cell", "center", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("n", F.lit(0).cast("long")).alias("n")).coalesce(1)
        dealt = made.repartition("cell").sortWithinPartitions("cell", "radius", "id")
        with self.log.transaction():
            (self.rows.write if fresh else self.rows.append)(dealt)
            (self.cells.write if fresh else self.cells.append)(cells)

    @staticmethod
    def _usable(rows: DataFrame) -> DataFrame:
        return rows.select("id", "vector").filter("id is not null and vector is not null")

    def build(self, rows: DataFrame) -> VectorIndex:
        """rows (id, vector) are all that is indexed from now on. Vectors must have one length."""
        with self.log.transaction():
            rows = self._usable(rows)
            some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(F.col("vector").cast("array<double>").alias("v")).toArrow().column("v")
            n = rows.count()
            sample = _matrix(some.combine_chunks(), len(some)) if len(some) else np.zeros((1, 1))
            centers = centers_of(sample, max(1, min(MOST_CELLS, int(n**0.5))))
            self._put(rows, np.arange(len(centers)), centers, True)
        return self

    def add(self, rows: DataFrame) -> VectorIndex:
        """More rows; into an index without rows they are built."""
        with self.log.transaction():
            if not self.exists() or not self.cells.read().filter("n > 0").limit(1).count():
                return self.build(rows)
            numbers, centers, _, _ = self._centers()
            self._put(self._usable(rows), numbers, centers, False)
        return self

    def remove(self, ids: DataFrame) -> VectorIndex:
        if self.exists():
            self.rows.delete(ids)
        return self

    def nearest(self, queries: DataFrame, k: int, own: bool = True, report: bool = False) -> DataFrame:
        """(q, rank, id, distance): the exact k nearest rows by squared distance to each of queries (q, vector), ties to the smaller id; all if there are fewer.

        own: a row whose id is the query's counts too. report: also `read`, the vectors that were compared for the query. Rows are read in two steps: of the
        nearest cells that have been given k rows between them (with removed rows that may be fewer that are left, then all cells follow), and of all cells that the k-th distance reaches.
        """
        numbers, centers, radius, n = self._centers()
        kind, id_kind = dict(queries.dtypes)["q"], dict(self.rows.read().dtypes)["id"]
        more = 0 if own else 1
        # the rows of a cell are those of so many before and n more, whose tasks take ROWS each
        before = np.cumsum(n) - n
        place = workspace(self.spark, "metric")
        me = F.col("q").cast(id_kind)
        asked = queries.select("q", F.col("vector").cast("array<double>").alias("asked"), me.alias("me")).filter("q is not null and asked is not null" + ("" if own else " and me is not null"))
        asked = stored(asked, f"{place}/asked")
        count, reached = asked.count(), f"q {kind}, asked array<double>, me {id_kind}, reach double"
        parts = max(1, -(-count // QUERIES))
        groups = max(1, -(-int(n.sum()) // ROWS)) * parts

        def dealt(first: bool, gathers: bool = False):
            """For each task that holds rows of a query's cells, the query with these cells: those that it starts with, or those of the others that its reach touches. gathers: the cells only."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        d = _distances(_matrix(batch.column(1).slice(i, 1), 1), centers)[0]
                        order = np.argsort(d, kind="stable")
                        order = order[n[order] > 0]
                        start = np.cumsum(n[order]) - n[order] < k + more
                        if not first:
                            low = np.maximum(0, d[order] - radius[order]) * (1 - SLACK)
                            start = ~start & (low <= batch.column(3)[i].as_py())
                        cells = order[start]
                        if gathers:
                            yield pa.RecordBatch.from_arrays([pa.array(numbers[cells].astype(np.int32))], ["cell"])
                            continue
                        low, high = before[cells] // ROWS, (before[cells] + n[cells] - 1) // ROWS
                        spread = high - low + 1
                        cells = np.repeat(cells, spread)
                        task = np.repeat(low, spread) + np.arange(len(cells)) - np.repeat(np.cumsum(spread) - spread, spread)
                        by = np.lexsort((numbers[cells], task))
                        cells, task = cells[by], task[by]
                        at = np.flatnonzero(np.append(True, task[1:] != task[:-1])) if len(task) else np.zeros(0, np.int64)
                        ends = pa.array(np.append(at, len(task)).astype(np.int32))
                        same = [c.take(pa.array(np.full(len(at), i))) for c in batch.columns]
                        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(numbers[cells].astype(np.int32)), pa.array(d[cells]))]
                        yield pa.RecordBatch.from_arrays([pa.array(task[at]), *same, *lists], ["task", "q", "asked", "me", "reach", "cells", "middles"])

            return run

        spans = F.broadcast(self.spark.createDataFrame([(int(c), int(b), int(m)) for c, b, m in zip(numbers, before, n)], "cell int, before long, given long").filter("given > 0"))

        def compared(some: DataFrame, first: bool) -> DataFrame:
            table = self.rows.read()
            if count <= FEW_QUERIES:  # constants, so that other cells' folders aren't listed
                table = table.filter(F.col("cell").isin([r.cell for r in some.mapInArrow(dealt(first, True), "cell int").distinct().collect()]))
            table = table.join(spans, "cell").withColumn("task", F.floor((F.col("before") + F.pmod(F.xxhash64("id"), "given")) / F.lit(ROWS)))
            table = table.select("task", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "cell", "radius", "vector")
            some = some.mapInArrow(dealt(first), f"task long, {reached}, cells array<int>, middles array<double>").withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int"))
            by = ["task", "part"]
            both = some.repartition(groups, *by).groupBy(*by).cogroup(table.repartition(groups, *by).groupBy(*by))
            return stored(both.applyInArrow(_matched(k, own, report), f"q {kind}, id {id_kind}, distance double, read long"), f"{place}/{'first' if first else 'second'}")

        def rank(df: DataFrame) -> DataFrame:
            some = df.filter("id is not null")
            return some.repartition(max(1, -(-df.count() // FOUND)), "q").withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))).filter(F.col("rank") <= k)

        near = compared(asked.withColumn("reach", F.lit(float("inf"))), True)
        limit = rank(near).filter(F.col("rank") == k).select("q", (F.sqrt("distance") * (1 + SLACK)).alias("reach"))
        rest = stored(asked.join(limit, "q", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))), f"{place}/rest")
        all_ = near.union(compared(rest, False))
        out = rank(all_).select("q", "rank", "id", "distance")
        return out.join(all_.groupBy("q").agg(F.sum("read").alias("read")), "q") if report else out

    def candidates(self, query: list[float], k: int) -> DataFrame:
        """(id, vector_score): as search.vector_candidates, from the index."""
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "q int, vector array<double>")
        return self.nearest(asked, k).select("id", vectors.similarity(F.col("distance")).alias("vector_score"))
