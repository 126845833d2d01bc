"""Exact nearest neighbours by a block matrix join over int8 product tiles (operator 9)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remembra.llm._store import stored, workspace

#: Rows of a query block, rows of a candidate block, and queries whose tile is multiplied at once.
QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 8192, 8192, 256
#: Dimensions of one product: 127 * 127 * 1024 is below 2 ** 24, so float32 holds sums of int8 products exactly.
DEPTH = 1024
#: Queries whose heaps a task holds.
HEAPS = 1 << 15

PACKED = "block int, dim int, ids binary, vectors binary"


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, not zero, and without null or non-finite components."""
    v = v.cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _pack(table: pa.Table) -> pa.Table:
    ids = table.column("id").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return pa.table({"block": [table.column("block")[0].as_py()], "dim": [table.column("dim")[0].as_py()], "ids": [ids.tobytes()], "vectors": [flat.tobytes()]}, pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes as float32, the step of each row, the norm of each row's error, and the norm of what the codes stand for."""
    step = np.maximum(np.abs(v).max(1) / 127, np.finfo(np.float64).tiny)
    codes = np.rint(v / step[:, None])
    back = codes * step[:, None]
    return codes.astype(np.float32), step, np.linalg.norm(v - back, axis=1), np.linalg.norm(back, axis=1)


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, squares added in the order of the components."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        d = q[:, j] - c[:, j]
        total += d * d
    return np.sqrt(total)


def nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, limit: np.ndarray) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query of a cell its position and its k nearest, sorted, of those not beyond limit."""
    codes, step, error, norm = quantised(c)
    square, whole = (c * c).sum(1), np.linalg.norm(c, axis=1)
    for at in range(0, len(q), TILE):
        part = q[at : at + TILE]
        q_codes, q_step, q_error, q_norm = quantised(part)
        product = np.zeros((len(part), len(c)))
        for j in range(0, q.shape[1], DEPTH):
            product += q_codes[:, j : j + DEPTH] @ codes[:, j : j + DEPTH].T
        product *= q_step[:, None] * step
        middle = (part * part).sum(1)[:, None] + square - 2 * product
        # q.c = q'.c' + (q - q').c + q'.(c - c'); the last factor is for the rounding of all these sums
        bound = 2 * (q_error[:, None] * whole + q_norm[:, None] * error) + 1e-9 * (np.abs(middle) + 2 * np.abs(product))
        own = q_ids[at : at + TILE, None] == c_ids
        upper = np.where(own, np.inf, middle + bound)
        most = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(c) > k else np.full(len(part), np.inf)
        most = np.fmin(most, limit[at : at + TILE] ** 2 * (1 + 1e-9))
        rows, columns = np.nonzero(~own & ~(middle - bound > most[:, None]))
        exact = distances(part[rows], c[columns])
        order = np.lexsort((c_ids[columns], exact, rows))
        rows, ids, exact = rows[order], c_ids[columns][order], exact[order]
        first = np.searchsorted(rows, np.arange(len(part) + 1))
        for i in range(len(part)):
            a, b = first[i], min(first[i + 1], first[i] + k)
            if b > a:
                yield at + i, list(zip(exact[a:b].tolist(), ids[a:b].tolist(), strict=True))


def _cells(k: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(q, i, s) for q, found in best.items() for s, i in found]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for dim, q_ids, q, c_ids, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                q, c = (np.frombuffer(x, kind).reshape(-1, dim).astype(np.float64) for x in (q, c))
                limit = np.array([found[-1][0] if len(found := best.get(i, ())) == k else np.inf for i in q_ids.tolist()])
                with np.errstate(over="ignore", invalid="ignore"):
                    for i, found in nearest(q_ids, q, c_ids, c, k, limit):
                        best[int(q_ids[i])] = heapq.nsmallest(k, heapq.merge(best.get(int(q_ids[i]), ()), found))
                if len(best) > HEAPS:
                    yield out()
        yield out()

    return run


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each row for which `queries` holds, all if fewer; recall is 1.

    The queries are cut into blocks, the candidates (all rows) too; each cell of the two meets in one
    row of a join that is keyed by both blocks. In a cell, products of int8 codes give each distance
    within a bound made from the norms of the quantisation errors; pairs that may still be among the k
    nearest are computed again from the original vectors in double precision and merged by heaps.
    Ties go to the smaller vec_id; a query's own id is no candidate. Vectors null, zero or with null or
    non-finite components, rows with a null id, and vectors of another length than the query's take
    no part. A repeated row is a candidate each time; of rows that share a query's id the smallest vector asks.
    """
    wide = dict(vectors.dtypes)[embedding] != "array<float>"
    kind, scalar = ("<f8", "double") if wide else ("<f4", "float")
    v = F.col(embedding).cast(f"array<{scalar}>")
    good = vectors.filter(F.col(vec_id).isNotNull() & usable(F.col(embedding)))
    rows = good.select(F.col(vec_id).cast("long").alias("id"), F.size(embedding).alias("dim"), v.alias("v"))
    asked = good.filter(queries).groupBy(F.col(vec_id).cast("long").alias("id")).agg(F.min(v).alias("v")).withColumn("dim", F.size("v"))
    n, m = rows.count(), asked.count()
    by, of = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // QUERY_BLOCK))

    def packed(df: DataFrame, blocks: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
        return df.select(block.alias("block"), "dim", "id", "v").groupBy("block", "dim").applyInArrow(_pack, PACKED)

    q = packed(asked.select("id", "dim", "v"), of).select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(by - 1))).alias("c"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    c = packed(rows, by).select(F.col("block").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias("q"), "dim", F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))
    cells = q.join(c, ["q", "c", "dim"]).select("dim", "q_ids", "q_vectors", "c_ids", "c_vectors")
    found = stored(cells.mapInArrow(_cells(k, kind), "query_id long, vec_id long, score double"), f"{workspace(vectors.sparkSession, 'nearest')}/found", 1)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
