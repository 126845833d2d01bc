"""Near-duplicates by SimHash and ball hashing (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remembra.llm._bytes import SPACE, Texts, pieces
from remembra.llm._graph import components, join_hot
from remembra.llm._store import remove, stored, workspace

#: Words of a shingle, seed of its XXH64, and the most differing bits of linked fingerprints.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Variants that one task compares at once, on average.
SHARD = 1 << 21

_LANE = np.uint64(0x0101010101010101)


def _shingles(column: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles, text by text, and their number by text; A-Z lower-cased."""
    t = Texts.of(column)
    t.lower()
    starts, ends, n_words = t.words()
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(t.n, np.int64)
    # words with one space after each
    space = SPACE[t.data]
    keep = ~space
    keep[ends] = True
    place = np.cumsum(keep) - 1
    flat = np.where(space, np.uint8(32), t.data)[keep].tobytes()
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    first = np.cumsum(n_words) - n_words
    which = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(which + shingle, np.repeat(first + n_words, n)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], seed) for a, b in zip(place[starts[which]].tolist(), place[ends[last]].tolist(), strict=True)], np.uint64)
    return h, n


def fingerprints(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each text, A-Z lower-cased; zero without words."""
    return majority(*_shingles(column, shingle, seed))


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text, of the n hashes that are its own in h, the bits that over half of them have."""
    out = np.zeros(len(n), np.uint64)
    if not len(h):
        return out
    # ones of each bit: byte lanes hold the sums of up to 255 hashes, then runs are added up
    full = np.flatnonzero(n)
    runs = -(-n[full] // 255)
    base = np.cumsum(n)[full] - n[full]
    run_at = np.repeat(base, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    doc_at = np.cumsum(runs) - runs
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANE, run_at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), doc_at, axis=0)
        set_ = 2 * ones > n[full][:, None]
        for byte in range(8):
            out[full] |= set_[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "__text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fingerprints(piece.column(1)).view(np.int64))], ["doc_id", "fp"])


def ball(fp: np.ndarray, radius: int = RADIUS // 2) -> np.ndarray:
    """All variants of each fingerprint with at most `radius` bits changed: (len(fp), size of the ball)."""
    masks, ring = [np.zeros(1, np.uint64)], np.zeros(1, np.uint64)
    ones = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for r in range(radius):
        ring = np.unique((ring[:, None] | ones).ravel())
        ring = ring[np.bitwise_count(ring) == r + 1]
        masks.append(ring)
    return fp[:, None] ^ np.concatenate(masks)


def _emit(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fp), 8192):
                part = fp[k : k + 8192]
                variants = ball(part)
                pairs = np.stack([variants.ravel(), np.repeat(part, variants.shape[1])], 1)
                shard = ((pairs[:, 0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(shards)
                order = np.argsort(shard, kind="stable")
                cut = np.flatnonzero(np.diff(shard[order])) + 1
                groups = np.split(pairs[order], cut)
                yield pa.RecordBatch.from_arrays([pa.array(shard[order][np.append(0, cut)].astype(np.int64)), pa.array([g.tobytes() for g in groups], pa.binary())], ["shard", "pairs"])

    return run


def _collide(table: pa.Table) -> pa.Table:
    pairs = np.frombuffer(b"".join(table.column("pairs").to_pylist()), np.uint64).reshape(-1, 2)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    variant, fp = pairs[order, 0], pairs[order, 1]
    head = np.append(True, variant[1:] != variant[:-1])
    least = fp[np.flatnonzero(head)[np.cumsum(head) - 1]]
    # two fingerprints that share a variant differ in RADIUS bits at most, so each links to the least of its bucket
    edge = np.unique(np.stack([least, fp], 1)[(least != fp) & (np.bitwise_count(least ^ fp) <= RADIUS)], axis=0)
    return pa.table({"a": edge[:, 0].view(np.int64), "b": edge[:, 1].view(np.int64)})


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` at most RADIUS bits apart: any two such are joined
    directly or by way of the least fingerprint of a bucket, which holds no more than a ball (65)."""
    count = fps.count()
    shards = max(1, -(-count * 65 // SHARD))
    return fps.select("fp").mapInArrow(_emit(shards), "shard long, pairs binary").groupBy("shard").applyInArrow(_collide, "a long, b long")


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the smallest doc_id that links reach, the row's own included. Null and empty
    texts have fingerprint 0 and are linked like any other; repeated rows and repeated ids each
    give a row; a null doc_id counts as none (a component of only null ids has a null id). Other
    columns of docs are not read.
    """
    spark = docs.sparkSession
    place = workspace(spark, "simhash")
    kind = docs.select(doc_id).dtypes[0][1]
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).mapInArrow(_fingerprint_rows, f"doc_id {kind}, fp long"), f"{place}/rows")
    groups = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("__count")), f"{place}/groups")
    roots, done = components(links(groups))
    total = rows.count()
    member = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("__n"))
    member = stored(join_hot(member, least, "root", groups.count(), "__n").select("fp", "component_id", "__count"), f"{place}/member")
    done()
    out = stored(join_hot(rows, member, "fp", total).select("doc_id", "fp", "component_id"), workspace(spark, "simhash-components"))
    remove(spark, place)
    return out
