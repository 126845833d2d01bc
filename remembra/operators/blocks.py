"""Similarity of vectors in blocks: every pair of blocks meets once, as two matrices.

Rows are dealt to blocks, and the blocks to the cells of a grid, so work is spread evenly whatever the data, and only pairs that
pass leave a cell. There are MOST_BLOCKS blocks at most until they reach BLOCK_BYTES, so what is shuffled grows with the rows, not
with their square. A block travels in parts of PART_BYTES, sorted by cell and side: only the Python worker of a cell holds its
two blocks, whatever their size; it multiplies them in strips.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remembra.sources.store import stored, workspace

#: Rows of a strip, which are the least of a block; blocks of a side, and bytes of one beyond which there are more; pairs that are computed exactly at once.
BLOCK, MOST_BLOCKS, BLOCK_BYTES, PAIRS = 2048, 24, 64 << 20, 8192
#: Bytes of the vectors of a part, and how the parts are written: in groups of few rows, since a group is read as a whole.
PART_BYTES, FEW_ROWS = 256 << 10, {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}
#: How the vectors' numbers are kept; others as doubles. Whole ones take no more bytes than the largest of a part needs.
NUMBERS = {"array<float>": "f4", "array<int>": "i4", "array<double>": "f8"}


def _narrow(low: int | None, high: int | None) -> str:
    return "i4" if (low or 0) < 0 or (high or 0) > 0xFFFF else "u2" if (high or 0) > 0xFF else "u1"


def _blocks(df: DataFrame) -> int:
    kind = NUMBERS.get(dict(df.dtypes)["vector"], "f8")
    n, dim, *ends = df.agg(F.count("*"), F.max(F.size("vector")), *([F.min(F.array_min("vector")), F.max(F.array_max("vector"))] if kind == "i4" else [])).first()
    size = n * max(dim or 0, 1) * np.dtype(_narrow(*ends) if ends else kind).itemsize
    return max(1, min(-(-n // BLOCK), MOST_BLOCKS), -(-size // BLOCK_BYTES))


def _packed(df: DataFrame, blocks: int, path: str) -> DataFrame:
    """Parts (block, dim, kind, ids, vectors) of rows (id, vector), made where these are read and written once however often the grid names them; ids and numbers keep their type."""
    kinds = dict(df.dtypes)
    kind = NUMBERS.get(kinds["vector"], "f8")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, block, dim = batch.columns
            group = np.stack([block.to_numpy(), dim.to_numpy()], 1)
            for b, d in np.unique(group, axis=0).tolist():
                rows = np.flatnonzero((group == (b, d)).all(1))
                step = max(1, PART_BYTES // max(1, d * np.dtype(kind).itemsize))
                for at in range(0, len(rows), step):
                    some = pa.array(rows[at : at + step])
                    flat = vectors.take(some).flatten().to_numpy(zero_copy_only=False).astype(kind)
                    if kind == "i4" and len(flat):
                        flat = flat.astype(_narrow(flat.min(), flat.max()))
                    one = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids.take(some))
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([d], pa.int32()), pa.array([flat.dtype.str[1:]]), one, pa.array([flat.tobytes()], pa.binary())], ["block", "dim", "kind", "ids", "vectors"])

    rows = df.filter("id is not null and vector is not null").select("id", F.col("vector").cast(kinds["vector"] if kinds["vector"] in NUMBERS else "array<double>").alias("v"))
    rows = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("dim"))
    return stored(rows.mapInArrow(pack, f"block int, dim int, kind string, ids array<{kinds['id']}>, vectors binary"), path, **FEW_ROWS)


def _cells(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """Parts of the cells of the grid of left and right blocks, a cell's in one task, left ones first; without right, of the cells of left with itself on and above the diagonal."""
    place = workspace(left.sparkSession, "blocks")
    a = _blocks(left)
    l = _packed(left, a, f"{place}/left")
    r, b = (l, a) if right is None else (_packed(right, b := _blocks(right), f"{place}/right"), b)
    part = ["i", "j", "dim", "side", "met", "kind", "ids", "vectors"]
    l = l.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).withColumn("side", F.lit(0))
    r = r.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(a - 1)))).withColumn("side", F.lit(1))
    if right is None:
        l, r = l.filter("i <= j"), r.filter("i < j")
    both = l.withColumn("met", F.lit(right is None) & (F.col("i") == F.col("j"))).select(part).union(r.withColumn("met", F.lit(False)).select(part))
    # as many tasks as cells, since their work is large where their bytes are few
    return both.repartition(min(a * b, 1024), "i", "j", "dim").sortWithinPartitions("i", "j", "dim", "side")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each cell whether its two sides are one block, and of each side ids, and vectors as rows of a matrix. Ids compare as Python compares them, texts by code points."""
    rows = ((batch, k) for batch in batches for k in range(batch.num_rows))
    for (_, _, dim, met), parts in groupby(rows, lambda x: tuple(x[0].column(c)[x[1]].as_py() for c in ("i", "j", "dim", "met"))):
        sides: list[tuple[list, list]] = [([], []), ([], [])]
        for batch, k in parts:
            kind, ids, v = (batch.column(c)[k] for c in ("kind", "ids", "vectors"))
            names, matrices = sides[batch.column("side")[k].as_py()]
            names.append(ids.values.to_numpy(zero_copy_only=False))
            matrices.append(np.frombuffer(v.as_buffer(), kind.as_py()).reshape(len(ids), dim))
        if met:
            sides[1] = sides[0]
        if not (sides[0][0] and sides[1][0]):
            continue
        a_ids, b_ids = (np.concatenate(names) for names, _ in sides)
        a = np.concatenate(sides[0][1])
        sides[0][1].clear()
        b = a if met else np.concatenate(sides[1][1])
        sides.clear()
        yield met, a_ids, a, b_ids, b


def _folded(parts: np.ndarray) -> np.ndarray:
    """Sums over the last axis from left to right, as an SQL fold makes them."""
    total = np.zeros(parts.shape[:-1])
    for k in range(parts.shape[-1]):
        total = total + parts[..., k]
    return total


def _by_parts(x: np.ndarray, y: np.ndarray, exact) -> np.ndarray:
    """exact(x, y) of pairs of rows, of PAIRS at a time."""
    return np.concatenate([exact(x[k : k + PAIRS], y[k : k + PAIRS]) for k in range(0, len(x), PAIRS)] or [np.zeros(0)])


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.concatenate([_folded(v[k : k + PAIRS].astype(np.float64) ** 2) for k in range(0, len(v), PAIRS)] or [np.zeros(0)]))


def _rounding(dim: int) -> float:
    """Bound of a single-precision product's error, of vectors of length one."""
    return (dim + 8) * 1.2e-7


def _strips(met: bool, a: np.ndarray, b: np.ndarray, least: float, strict: bool, told: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, cosine) of the rows of a and b with a cosine of `least` or more (strict: above it), by strips of b within strips of a; of one block with itself each pair once.
    Unless the cosines are to be told, those that single precision decides are not computed exactly."""
    na, nb = _lengths(a), _lengths(b)
    unit = lambda v, n: (v / np.where(n > 0, n, np.inf)[:, None]).astype(np.float32)
    for s in range(0, len(a), BLOCK):
        ua = unit(a[s : s + BLOCK], na[s : s + BLOCK])
        for t in range(s if met else 0, len(b), BLOCK):
            near = ua @ unit(b[t : t + BLOCK], nb[t : t + BLOCK]).T
            x, y = np.nonzero(near >= least - _rounding(a.shape[1]))
            some = (na[s + x] > 0) & (nb[t + y] > 0) & ((s + x < t + y) | (not met))
            x, y = s + x[some], t + y[some]
            exact, open_ = near[x - s, y - t].astype(np.float64), np.arange(len(x))
            if not told:
                open_ = np.flatnonzero(exact <= least + _rounding(a.shape[1]))
            exact[open_] = _by_parts(x[open_], y[open_], lambda p, q: _folded(a[p].astype(np.float64) * b[q]) / (na[p] * nb[q]))
            keep = exact > least if strict else exact >= least
            yield x[keep], y[keep], exact[keep]


def _pairs(ids_a: np.ndarray, ids_b: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
    swap = ids_a > ids_b
    return pa.RecordBatch.from_arrays([pa.array(np.where(swap, ids_b, ids_a)), pa.array(np.where(swap, ids_a, ids_b)), pa.array(cosine)], ["a", "b", "cosine"])


def _unit_pairs(least: float, strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met, a_ids, a, b_ids, b in _open(batches):
            for x, y, cosine in _strips(met, a, b, least, strict):
                yield _pairs(a_ids[x], b_ids[y], cosine)

    return run


def _forest(x: np.ndarray, y: np.ndarray, cosine: np.ndarray, n: int) -> np.ndarray:
    """Places of the pairs (x, y) of nodes below n that span what all of them connect, those of the largest cosines."""
    order = np.argsort(-cosine, kind="stable")
    x, y, label, kept, left = x[order], y[order], np.arange(n), [], np.arange(len(x))
    while len(left := left[label[x[left]] != label[y[left]]]):
        best = np.full(n, len(x))  # of each tree the first pair that leaves it
        for side in (x, y):
            np.minimum.at(best, label[side[left]], left)
        kept.append(np.unique(best[best < len(x)]))
        p, q, to = label[x[kept[-1]]], label[y[kept[-1]]], np.arange(n)
        while (to[p] != to[q]).any():
            m = np.minimum(to[p], to[q])
            for old in (p, q, to[p], to[q]):
                np.minimum.at(to, old, m)
            to = to[to]
        label = to[label]
    return order[np.concatenate(kept)] if kept else order[:0]


def _spanning(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met, a_ids, a, b_ids, b in _open(batches):
            shift = 0 if met else len(a)
            x, y, cosine = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            for found in _strips(met, a, b, least, False):
                x, y, cosine = np.concatenate([x, found[0]]), np.concatenate([y, found[1]]), np.concatenate([cosine, found[2]])
                if len(found[0]):
                    keep = _forest(x, y + shift, cosine, shift + len(b))
                    x, y, cosine = x[keep], y[keep], cosine[keep]
            yield _pairs(a_ids[x], b_ids[y], cosine)

    return run


def similar_pairs(vectors: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """(a, b, cosine), a < b, for every pair of rows (id, vector) with a cosine of `least` or more (strict: above it). Zero vectors are similar to nothing."""
    return _found(vectors, _unit_pairs(least, strict))


def spanning_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """Those of similar_pairs that connect what all of them connect, the most similar of each component among them; of each cell of blocks at most one pair for a row."""
    return _found(vectors, _spanning(least))


def _found(vectors: DataFrame, run) -> DataFrame:
    kind = dict(vectors.dtypes)["id"]
    found = _cells(vectors, None).mapInArrow(_typed(run, kind), f"a {kind}, b {kind}, cosine double")
    return stored(found, f"{workspace(vectors.sparkSession, 'pairs')}/found", 1)


def _first(least: float, strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met, a_ids, a, b_ids, b in _open(batches):
            best = np.full(len(b), np.iinfo(np.int64).max)
            for x, y, _ in _strips(met, a, b, least, strict, told=False):
                np.minimum.at(best, y, a_ids[x])
            some = best < np.iinfo(np.int64).max
            yield pa.RecordBatch.from_arrays([pa.array(b_ids[some]), pa.array(best[some])], ["id", "first"])

    return run


def first_similar(table: DataFrame, rows: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """(id, first): for each of rows (id, vector) the smallest id of table's rows with a cosine of `least` or more (strict: above it); no row where there is none. Ids are numbers."""
    found = stored(_cells(table, rows).mapInArrow(_first(least, strict), "id long, first long"), f"{workspace(table.sparkSession, 'first')}/found", 1)
    return found.groupBy("id").agg(F.min("first").alias("first"))


def _typed(run, kind: str):
    """What run yields, its ids of one type, also where there are none to tell it."""
    type_ = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else None

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([c if type_ is None or pa.types.is_floating(c.type) else c.cast(type_) for c in batch.columns], batch.schema.names)

    return cast


def _near(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, distance) of the k rows of b that are nearest to each row of a, strip by strip of b: after the first, only what may be within the k-th distance so far is computed exactly."""
    kind = np.float32 if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 1e15 else np.float64
    sa, slack = (a.astype(np.float64) ** 2).sum(1), _rounding(a.shape[1])
    single, most = a.astype(kind), np.full(len(a), np.inf)
    x, y, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    for t in range(0, len(b), BLOCK):
        part = b[t : t + BLOCK]
        size = sa[:, None] + (part.astype(np.float64) ** 2).sum(1)
        # no less than this: a lower bound of the squared distance
        low = (size * (1 - slack) - 1e-30).astype(kind) - 2 * (single @ part.astype(kind).T)
        low[a_ids[:, None] == b_ids[None, t : t + BLOCK]] = np.inf
        bound = most.astype(kind)
        if not np.isfinite(bound).all() and len(part) > k:
            width = (2 * slack * size.max(1) + 2e-30).astype(kind)
            bound = np.minimum(bound, np.partition(low, k - 1, axis=1)[:, k - 1] + width)
        nx, ny = np.nonzero((low <= (bound + np.abs(bound) * kind(1e-6))[:, None]) & (low < np.inf))
        near = _by_parts(nx, ny + t, lambda p, q: _folded((a[p].astype(np.float64) - b[q]) ** 2))
        x, y, d = np.concatenate([x, nx]), np.concatenate([y, ny + t]), np.concatenate([d, near])
        order = np.lexsort((place[y], d, x))
        x, y, d = x[order], y[order], d[order]
        keep = np.arange(len(x)) - np.searchsorted(x, x) < k
        x, y, d = x[keep], y[keep], d[keep]
        full = np.flatnonzero(np.bincount(x, minlength=len(a)) >= k)
        most[full] = d[np.searchsorted(x, full, "right") - 1]
    return x, y, d


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a_ids, a, b_ids, b in _open(batches):
            place = np.argsort(np.argsort(b_ids, kind="stable"), kind="stable")  # ids in their order, as numbers
            for s in range(0, len(a), BLOCK):
                x, y, d = _near(a[s : s + BLOCK], b, a_ids[s : s + BLOCK], b_ids, place, k)
                yield pa.RecordBatch.from_arrays([pa.array(a_ids[s + x]), pa.array(b_ids[y]), pa.array(d)], ["q", "id", "distance"])

    return run


def knn(queries: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """(q, rank, id, distance): the exact k nearest rows of table to each of queries, by squared distance, ties to the smaller id; not the query's own id."""
    kind = dict(table.dtypes)["id"]
    found = _cells(queries, table).mapInArrow(_typed(_nearest(k), kind), f"q {kind}, id {kind}, distance double")
    found = stored(found, f"{workspace(table.sparkSession, 'nearest')}/found", 1)
    rank = F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "rank", "id", "distance")
