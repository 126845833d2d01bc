"""Hard negatives by sorted integer scores of an anchor against all rows (operator 12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remembra.llm import _memory  # noqa: F401
from remembra.llm._store import stored, workspace

#: Rows of an anchor block and of a candidate block, and anchors whose scores are made at once.
ANCHOR_BLOCK, CANDIDATE_BLOCK, TILE = 4096, 8192, 256
#: Anchors, or positives, whose best entries a task holds.
HELD = 1 << 15

_TOP = (1 << 63) - 1

_PACKED = pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("positives", pa.binary()), ("n_positives", pa.binary())])
_PACKED_SQL = "block int, dim int, kind string, ids binary, labels binary, vectors binary, positives binary, n_positives binary"


def finite(v: Column) -> Column:
    """Whether a vector is there, without null or non-finite components."""
    v = v.cast("array<double>")
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity


def _pack(table: pa.Table) -> pa.Table:
    """A block's rows as one, in the order of their ids; components in the smallest integers that hold them."""
    table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
    v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if len(v) and np.abs(v).max() >= 2.0**53:  # floor(256 x) as exact integers of any size
        kind, data = "object", ",".join(str(int(x)) for x in v).encode()
    else:
        kind = "<i2" if not len(v) or np.abs(v).max() < 2**15 else "<i8"
        data = v.astype(kind).tobytes()
    positives = table.column("positives").combine_chunks() if "positives" in table.schema.names else pa.array([[]] * len(table), pa.list_(pa.int64()))
    sizes = positives.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
    row = [table.column("block")[0].as_py(), table.column("dim")[0].as_py(), kind, table.column("id").to_numpy().astype(np.int64).tobytes(), table.column("label").to_numpy().astype(np.int64).tobytes(), data, positives.flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), sizes.tobytes()]
    return pa.table([[x] for x in row], schema=_PACKED)


def _vectors(data: bytes, kind: str, n: int) -> np.ndarray:
    if kind == "object":
        return np.array([int(x) for x in data.decode().split(",")], object).reshape(n, -1)
    return np.frombuffer(data, kind).reshape(n, -1) if data else np.zeros((n, 0), np.int64)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of q with all of c; OverflowError if one needs more than 64 bits."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    top = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    if top < 1 << 53:  # every sum of products is an integer that a double holds
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    out = q.astype(object) @ c.astype(object).T
    return np.array([[int(x) for x in row] for row in out], np.int64).reshape(len(q), len(c))


def _tiles(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of each cell and tile of its anchors: their ids, labels, positives, and the block's ids, labels and scores, ids ascending."""
    for q_kind, q_ids, q_labels, q, positives, n_positives, c_kind, c_ids, c_labels, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
        q_ids, q_labels, c_ids, c_labels, positives = (np.frombuffer(x, np.int64) for x in (q_ids, q_labels, c_ids, c_labels, positives))
        own = np.split(positives, np.cumsum(np.frombuffer(n_positives, np.int32))[:-1]) if len(q_ids) else []
        q, c = _vectors(q, q_kind, len(q_ids)), _vectors(c, c_kind, len(c_ids))
        for k in range(0, len(q_ids), TILE):
            yield q_ids[k : k + TILE], q_labels[k : k + TILE], own[k : k + TILE], c_ids, c_labels, scores(q[k : k + TILE], c)


def _merged(k: int, names: list[str], found: Callable[[tuple], Iterator[tuple[tuple, list[tuple[int, int]]]]]):
    """Runs `found` over cells; of each key it keeps the k best (score descending, id ascending) of all cells that the task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list[tuple[int, int]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(*key, i, -s) for key, entries in best.items() for s, i in entries]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], pa.int64()) for x in range(len(names))], names)

        for batch in batches:
            for tile in _tiles(batch):
                for key, entries in found(tile):
                    best[key] = sorted(best.get(key, []) + entries)[:k]
                if len(best) > HELD:
                    yield out()
        yield out()

    return run


def _sorted_rows(tile: tuple) -> Iterator[tuple]:
    """Each anchor's id, label and positives with the block's ids, labels and scores in order: score descending, then id."""
    q_ids, q_labels, own, c_ids, c_labels, s = tile
    for i, a in enumerate(q_ids.tolist()):
        order = np.lexsort((c_ids, -s[i]))
        yield a, q_labels[i], own[i], c_ids[order], c_labels[order], s[i][order]


def _positives(k: int):
    def found(tile: tuple) -> Iterator[tuple[tuple, list[tuple[int, int]]]]:
        for a, label, _, ids, labels, s in _sorted_rows(tile):
            at = np.flatnonzero((labels == label) & (ids != a))[:k]
            yield (a,), list(zip((-s[at]).tolist(), ids[at].tolist(), strict=True))

    return found


def _negatives(k: int, least: int, most: int):
    def found(tile: tuple) -> Iterator[tuple[tuple, list[tuple[int, int]]]]:
        for a, label, own, ids, labels, s in _sorted_rows(tile):
            other = np.flatnonzero((labels != label) & (ids != a))
            ids, s = ids[other], s[other]
            down = -s  # ascending
            for p in np.unique(own).tolist():
                # least p <= 100 s <= most p, in whole numbers of any size
                high, low = most * p // 100, -(-least * p // 100)
                first = int(np.searchsorted(down, np.int64(max(-_TOP, min(_TOP, -high))), "left"))
                last = int(np.searchsorted(down, np.int64(max(-_TOP, min(_TOP, -low))), "right"))
                if first < last:
                    take = slice(first, min(last, first + k))
                    yield (a, p), list(zip(down[take].tolist(), ids[take].tolist(), strict=True))

    return found


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, k: int = 5, least: int = 80, most: int = 100, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each row for which `anchors` holds.

    Components become floor(scale * x); a row's score is its exact integer inner product with the anchor. An anchor's positives are its `positives`
    best rows of the same label; for each, the k best rows of other labels with least * positive <= 100 * negative <= most * positive are returned.
    Higher scores come first, ties by smaller id.

    Anchors and rows are cut into blocks; a cell of the two is a row of a join keyed by both. In a cell each anchor's scores are sorted whole; each
    positive's upper limit is found by binary search and entries are read from there to the lower limit. Cells give k entries of each key at most,
    and these are merged: first the positives over all cells, then the negatives.

    Rows with a null id, label or vector, or with null or non-finite components take no part; all-zero and empty vectors do. Vectors of another length
    than the anchor's take no part for it. Rows that share the anchor's id are not others; of them the smallest (label, vector) asks. A repeated row
    counts each time. An anchor without positives, and a positive without negatives, give no rows. A score beyond 64 bits raises OverflowError.
    """
    spark = vectors.sparkSession
    place = workspace(spark, "negatives")
    v = F.transform(F.col(embedding).cast("array<double>"), lambda x: _floor(x * scale))
    good = vectors.filter(F.col(vec_id).isNotNull() & label.isNotNull() & finite(F.col(embedding)))
    rows = good.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.size(embedding).alias("dim"), v.alias("v"))
    asked = good.filter(anchors).select(F.col(vec_id).cast("long").alias("id"), F.struct(label.cast("long").alias("label"), v.alias("v")).alias("x"))
    asked = asked.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.label", F.size("x.v").alias("dim"), "x.v")
    n, m = rows.count(), asked.count()
    by, of = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // ANCHOR_BLOCK))

    def packed(df: DataFrame, blocks: int) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).groupBy("block", "dim").applyInArrow(_pack, _PACKED_SQL)

    names = ["kind", "ids", "labels", "vectors"]
    side = lambda df, x, mine, other, count: df.select(F.col("block").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(other), "dim", *[F.col(c).alias(f"{x}_{c}") for c in names], *(["positives", "n_positives"] if x == "q" else []))
    candidates = side(stored(packed(rows, by), f"{place}/rows"), "c", "c", "q", of)

    def cells(df: DataFrame, run, schema: str, name: str) -> DataFrame:
        both = side(packed(df, of), "q", "q", "c", by).join(candidates, ["q", "c", "dim"])
        both = both.select(*[f"q_{c}" for c in names], "positives", "n_positives", *[f"c_{c}" for c in names])
        return stored(both.mapInArrow(run, schema), f"{place}/{name}", 1)

    first = cells(asked, _merged(positives, ["anchor_id", "positive_id", "positive_score"], _positives(positives)), "anchor_id long, positive_id long, positive_score long", "positives")
    place_of = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = stored(first.withColumn("place", place_of).filter(F.col("place") <= positives), f"{place}/chosen")
    limits = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("positives"))
    second = cells(asked.join(limits, "id"), _merged(k, ["anchor_id", "positive_score", "negative_id", "negative_score"], _negatives(k, least, most)), "anchor_id long, positive_score long, negative_id long, negative_score long", "negatives")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    best = second.withColumn("rank", rank).filter(F.col("rank") <= k)
    return chosen.join(best, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _floor(x: Column) -> Column:
    """Floor of a double as a double, of any size: above 2 ** 52 every double is whole."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
