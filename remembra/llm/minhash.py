"""Near-duplicates by MinHash with sequential Bayesian verification (operator 11)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remembra.llm._bytes import SPACE, Texts, mix, ngrams, pieces
from remembra.llm._graph import components, join_hot, likely
from remembra.llm._store import quoted, remove, stored, workspace

#: Words of a shingle, and 100 times the least similarity of linked sets.
SHINGLE, PERCENT = 5, 85
#: Bands and minima of a band: of pairs at 0.85 all bands differ with a probability below 10^-6, at 0.8 below 10^-4.
BANDS, ROWS = 24, 5
#: Minima of a signature (16 bits each), how many are compared at once, and the posterior probability of a link below which a pair is given up.
SIGNATURE, BATCH, MISS = 128, 16, 1e-6
#: Texts of a chunk of a bucket, and rows of chunks that a task takes at once.
CHUNK, ROWS_AT_ONCE = 512, 1 << 14
#: Shingles and texts of a block, whose sets are compared with those of another block; shingles that a task takes at once.
BLOCK, BLOCK_TEXTS, SHINGLES_AT_ONCE = 1 << 17, 1024, 1 << 19

_U = np.uint64
_MASK = np.random.default_rng(11).integers(1, 1 << 63, (SIGNATURE, 2), np.uint64) | _U(1)
_GOLD = _U(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes: runs of `shingle` words, A-Z lower-cased; the whole sequence of fewer words; nothing without words."""
    t = Texts.of(column)
    t.lower()
    starts, ends, n_words = t.words(SPACE)
    doc = np.repeat(np.arange(t.n), n_words)
    hashes = t.hashes(starts, ends)
    out = [np.zeros(0, _U)] * t.n
    first = np.cumsum(n_words) - n_words
    for n, h, whole in ngrams(hashes, doc, shingle):
        if n < shingle:  # texts of so few words
            for i in np.flatnonzero(n_words == n).tolist():
                out[i] = h[first[i] : first[i] + 1]
        else:
            at = doc[: len(h)][whole]
            for i, x in zip(np.unique(at).tolist(), np.split(h[whole], np.flatnonzero(np.diff(at)) + 1), strict=True):
                out[i] = np.unique(x)
    return out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SIGNATURE) of 16 bits of each set's minima under SIGNATURE hash functions; zeros for an empty set."""
    out = np.zeros((len(sets), SIGNATURE), np.uint16)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if len(full):
        h = np.concatenate([sets[i] for i in full])
        sizes = np.array([len(sets[i]) for i in full])
        first = np.cumsum(sizes) - sizes
        for k in range(SIGNATURE):
            out[full, k] = mix(np.minimum.reduceat((h ^ _MASK[k, 0]) * _MASK[k, 1], first)) >> _U(48)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(texts, BANDS): a key of each band, equal if the band's minima are."""
    out = np.zeros((len(signatures), BANDS), _U)
    for b in range(BANDS):
        key = np.full(len(signatures), b + 1, _U)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key * _GOLD + signatures[:, k])
        out[:, b] = key
    return out


@cache
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """For each number of compared minima, a batch more each: the fewest matches with which the posterior probability that a pair's
    similarity is at least percent / 100 is no less than `miss`. The prior is uniform; a match of 16 bits counts as one of the minima."""
    t, out = percent / 100, []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        # P(s >= t | m of n) is the upper tail of Beta(m + 1, n - m + 1): at most m successes in n + 1 draws at t
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs x[a], y[b] of signatures are left once all batches are compared; a pair goes as soon as the posterior bound rules it out."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(percent)):
        at = slice(k * BATCH, (k + 1) * BATCH)
        matches += (x[a[left], at] == y[b[left], at]).sum(1)
        ok = matches >= least
        left, matches = left[ok], matches[ok]
    return left


def shared(x: list[np.ndarray], y: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs x[a], y[b] of sorted sets."""
    if len(a) <= 4 * (len(x) + len(y)):
        return np.array([len(np.intersect1d(x[i], y[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    # many pairs: the sets as rows of ones, their products summed over runs of shingles that two sets have at least
    flat = np.concatenate([*x, *y])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    keep = count[code] > 1
    row, code = row[keep], rank[code[keep]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    total = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
        p, q = np.searchsorted(code, [at, at + 2048])
        ones = np.zeros((len(x) + len(y), 2048), np.float32)
        ones[row[p:q], code[p:q] - at] = 1
        total += ones[: len(x)] @ ones[len(x) :].T
    return np.rint(total[a, b]).astype(np.int64)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links (a, b) that connect all that the links connect, none too many."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = i = root.get(up, up)
        return i

    keep = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
            keep.append(k)
    return np.array(keep, np.int64)


def sketch(shingle: int = SHINGLE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts n_shingles, node (a hash of the set; 0 without words) and signature in the place of each row's last column, its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text"):
                sets = shingle_sets(piece.column(piece.num_columns - 1), shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                # of two sums, so that equal nodes are equal sets but for chance
                node = mix(np.array([s.sum(dtype=_U) for s in sets], _U) + _GOLD) ^ np.array([mix(s).sum(dtype=_U) for s in sets], _U)
                node = np.where(sizes > 0, np.maximum(node, _U(1)), _U(0))
                columns = [pa.array(sizes), pa.array(node.view(np.int64)), pa.array([x.tobytes() for x in signature(sets)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *columns], [*piece.schema.names[:-1], "n_shingles", "node", "signature"])

    return run


def _set_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text"):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([s.tobytes() for s in shingle_sets(piece.column(1), shingle)], pa.binary())], ["node", "hashes"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SIGNATURE)
        keys = band_keys(s)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(keys.ravel().view(np.int64))], ["node", "bucket"])


def _grouped(pairs: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows (x, y, pairs) for pairs a, b of blocks x, y."""
    order = np.lexsort((pairs["y"], pairs["x"]))
    x, y, ab = pairs["x"][order], pairs["y"][order], np.stack([pairs["a"][order], pairs["b"][order]], 1).astype(np.int64)
    at = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[at], pa.int64()), pa.array(y[at], pa.int64()), pa.array([p.tobytes() for p in np.split(ab, at[1:])] if len(at) else [], pa.binary())], ["x", "y", "pairs"])


def _directed(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Pairs so turned that the smaller block, then the smaller text, comes first."""
    turn = (x > y) | ((x == y) & (a > b))
    return {"a": np.where(turn, b, a), "b": np.where(turn, a, b), "x": np.where(turn, y, x), "y": np.where(turn, x, y)}


def _with_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _grouped(_directed(*(batch.column(c).to_numpy() for c in ("node", "leader", "block", "leader_block"))))


def _within(percent: int):
    """Of the cells of a task's buckets, the pairs of different components that the signatures leave, each pair in the first band that it shares."""

    def run(table: pa.Table) -> pa.Table:
        bucket, i, j, chunk, node, root, block = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "chunk", "node", "root", "block"))
        s = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, SIGNATURE)
        order = np.lexsort((node, chunk, j, i, bucket))
        edge = np.flatnonzero(np.any([c[order][1:] != c[order][:-1] for c in (bucket, i, j)], axis=0)) + 1
        found = []
        for cell in np.split(order, edge):
            same = i[cell[0]] == j[cell[0]]
            one = chunk[cell] == i[cell]
            p, q = cell[one], cell if same else cell[~one]
            a, b = np.triu_indices(len(p), 1) if same else (np.repeat(np.arange(len(p)), len(q)), np.tile(np.arange(len(q)), len(p)))
            apart = root[p[a]] != root[q[b]]
            a, b = a[apart], b[apart]
            left = survivors(s[p], s[q], a, b, percent)
            a, b = p[a[left]], q[b[left]]
            if len(a):
                equal = (s[a][:, : BANDS * ROWS] == s[b][:, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(2)
                band = _band_of(s[cell[0]], bucket[cell[0]])
                own = equal.argmax(1) == band
                found.append(_directed(node[a[own]], node[b[own]], block[a[own]], block[b[own]]))
        some = {c: np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in ("a", "b", "x", "y")}
        return pa.Table.from_batches([_grouped(some)])

    return run


def _band_of(signature: np.ndarray, bucket: int) -> int:
    return int(np.flatnonzero(band_keys(signature[None])[0].view(np.int64) == bucket)[0])


def _verified(percent: int):
    """Links among the pairs of a task's cells: signatures first, then the whole sets; of links that connect the same texts, those needed."""

    def run(key, pairs: pa.Table, texts: pa.Table) -> pa.Table:
        order = np.argsort(texts.column("node").to_numpy())
        node = texts.column("node").to_numpy()[order]
        texts = texts.take(pa.array(order))
        s = np.frombuffer(b"".join(texts.column("signature").to_pylist()), np.uint16).reshape(-1, SIGNATURE)
        sets = [np.frombuffer(x.as_buffer(), _U) for x in texts.column("hashes")]
        cells: dict[tuple[int, int], list[bytes]] = {}
        for x, y, some in zip(*(pairs.column(c).to_pylist() for c in ("x", "y", "pairs")), strict=True):
            cells.setdefault((x, y), []).append(some)
        found = [np.zeros((0, 2), np.int64)]
        for some in cells.values():
            a, b = np.searchsorted(node, np.frombuffer(b"".join(some), np.int64).reshape(-1, 2).T)
            left = survivors(s, s, a, b, percent)
            ua, a = np.unique(a[left], return_inverse=True)
            ub, b = np.unique(b[left], return_inverse=True)
            x, y = [sets[k] for k in ua], [sets[k] for k in ub]
            both = shared(x, y, a, b)
            either = np.array([len(k) for k in x], np.int64)[a] + np.array([len(k) for k in y], np.int64)[b] - both
            ok = 100 * both >= percent * either
            a, b = node[ua[a[ok]]], node[ub[b[ok]]]
            keep = spanning(a, b)
            found.append(np.stack([a[keep], b[keep]], 1))
        ab = np.concatenate(found)
        return pa.table({"a": pa.array(ab[:, 0]), "b": pa.array(ab[:, 1])})

    return run


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each row's pairs."""
    for batch in batches:
        for x, y, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            nodes = np.unique(np.frombuffer(pairs, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(nodes), pa.int64()), pa.array([y] * len(nodes), pa.int64()), pa.array(nodes)], ["x", "y", "node"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, path: str) -> DataFrame:
    """Links (a, b) among pairs (x, y, pairs) of blocks x, y, given sets (node, n_shingles, signature, hashes); a task takes whole cells, and each text that they need once."""
    need = stored(pairs.mapInArrow(_needed, "x long, y long, node long").distinct(), f"{path}-need")
    weight = need.join(sets.select("node", "n_shingles"), "node").agg(F.sum(F.col("n_shingles") + 32)).first()[0] or 0
    task = F.pmod(F.xxhash64("x", "y"), F.lit(max(1, -(-weight // SHINGLES_AT_ONCE))))
    texts = need.select(task.alias("task"), "node").distinct().join(sets.select("node", "signature", "hashes"), "node")
    of_task = pairs.withColumn("task", task).groupBy("task").cogroup(texts.groupBy("task"))
    out = stored(of_task.applyInArrow(_verified(percent), "a long, b long"), path)
    remove(pairs.sparkSession, f"{path}-need")
    return out


def link_sets(texts: DataFrame, whole: Callable[[DataFrame], DataFrame], place: str, percent: int = PERCENT, shingle: int = SHINGLE, extra: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect what the similarity of shingle sets connects, of texts (node, n_shingles, signature), one row for each distinct set.

    Sets are linked if 100 * intersection >= percent * union. whole gives (node, __text) for a table of nodes, of each a text or more.
    extra: candidates (a, b) from elsewhere, nodes of texts, which are compared too.

    Texts that share a band of minima meet in a bucket. First each is compared with its bucket's leader, the smallest node; buckets whose texts are in one component
    then are done. In the others all pairs of different components are compared, in cells of two chunks of the bucket, however large it is. Signatures are
    compared in batches and a pair is given up when the posterior bound on its similarity rules it out; the rest is verified on the whole sets. No pair is a row:
    pairs go as arrays from a cell to the pair of blocks that holds their sets, and a cell gives no more links than it takes to connect its texts.
    """
    spark = texts.sparkSession
    full = texts.filter("n_shingles > 0").select("node", "n_shingles", "signature")
    n = full.count()
    at = full.select("node", "signature").mapInArrow(_keys, "node long, bucket long")
    buckets = stored(at.groupBy("bucket").agg(F.count("*").alias("__count"), F.min("node").alias("leader")).filter("__count > 1"), f"{place}/buckets")
    member = stored(join_hot(at, buckets, "bucket", n * BANDS), f"{place}/member")
    # blocks: texts that have their smallest leader in common, in parts if they are many, with others if they are few
    met = member.select("leader", "node")
    if extra is not None:
        extra = stored(extra.select(F.col("a").alias("leader"), F.col("b").alias("node")).filter("a <> b"), f"{place}/extra")
        met = met.union(extra).union(extra.select("leader", F.col("leader").alias("node")))
    near = stored(met.groupBy("node").agg(F.min("leader").alias("near")).join(full.select("node", "n_shingles"), "node"), f"{place}/near")
    size = near.groupBy("near").agg(F.ceil(F.greatest(F.sum("n_shingles") / F.lit(BLOCK), F.count("*") / F.lit(BLOCK_TEXTS))).alias("parts"), F.count("*").alias("__count"), F.sum("n_shingles").alias("__size"))
    some, shingles = near.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    groups = F.lit(max(1, -(-shingles // BLOCK), -(-some // BLOCK_TEXTS)))
    part = F.when(F.col("parts") > 1, F.xxhash64("near", F.pmod(F.xxhash64("node"), "parts"))).otherwise(F.pmod(F.xxhash64("near"), groups))
    blocks = stored(join_hot(near, size.select("near", "parts", "__count"), "near", some).select("node", part.alias("block")), f"{place}/blocks")
    sets = whole(blocks.select("node")).mapInArrow(_set_rows(shingle), "node long, hashes binary").dropDuplicates(["node"])
    sets = stored(sets.join(full, "node"), f"{place}/sets")
    # every text with its leaders
    led = stored(met.filter("leader <> node").distinct().join(blocks, "node"), f"{place}/led")
    leaders = led.groupBy("leader").agg(F.count("*").alias("__count")).join(blocks.select(F.col("node").alias("leader"), F.col("block").alias("leader_block")), "leader")
    both = join_hot(led, leaders, "leader", led.count()).select("node", "leader", "block", "leader_block")
    pairs = stored(both.mapInArrow(_with_leaders, "x long, y long, pairs binary"), f"{place}/pairs")
    first = _linked(pairs, sets, percent, f"{place}/first")
    roots, done = components(first)
    # buckets that hold several components still
    known = stored(member.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), f"{place}/known")
    done()
    several = known.groupBy("bucket").agg(F.count("*").alias("__count"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high and __count > 2").select("bucket", "__count")
    several = stored(several, f"{place}/several")
    opened = join_hot(known, several, "bucket", n * BANDS).join(blocks, "node").join(full.select("node", "signature"), "node")
    opened = opened.withColumn("chunks", F.ceil(F.col("__count") / F.lit(CHUNK))).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    opened = opened.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    opened = opened.select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "root", "block", "signature")
    rows = several.agg(F.sum(F.col("__count") * F.ceil(F.col("__count") / F.lit(CHUNK)))).first()[0] or 0
    cells = opened.withColumn("task", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(max(1, -(-rows // ROWS_AT_ONCE)))))
    cells = stored(cells.groupBy("task").applyInArrow(_within(percent), "x long, y long, pairs binary"), f"{place}/cells")
    second = _linked(cells, sets, percent, f"{place}/second")
    for name in ("buckets", "member", "near", "blocks", "sets", "led", "pairs", "known", "several", "cells", "extra"):
        remove(spark, f"{place}/{name}")
    return first.union(second)


def minhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; rows are linked if their sets of shingles are similar (see link_sets).

    component_id is the smallest doc_id that links reach, the row's own included; kept tells whether it is the row's own. Null and empty texts have no
    shingles and are linked with nothing; equal sets are linked, repeated rows too, and each row gives a row. A null doc_id counts as none: a component of null ids
    only has a null id and its rows are kept. Other columns of docs are not read. Shingles are told by 64-bit hashes.
    """
    spark = docs.sparkSession
    place = workspace(spark, "minhash")
    kind = docs.select(quoted(doc_id)).dtypes[0][1]
    read = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.xxhash64(quoted(text)).alias("hash"), F.col(quoted(text)).alias("__text"))
    rows = stored(read.mapInArrow(sketch(shingle), f"doc_id {kind}, hash long, n_shingles long, node long, signature binary"), f"{place}/rows")
    best = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "hash")).alias("best")
    texts = rows.filter("n_shingles > 0").groupBy("node").agg(best, F.count("*").alias("__count"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"))
    texts = stored(texts, f"{place}/texts")
    total = rows.count()

    def whole(nodes: DataFrame) -> DataFrame:
        """One row's text of each set, or several of rows equal in id and text."""
        those = texts.join(nodes, "node", "left_semi").select(F.col("best.hash").alias("hash"), F.col("best.doc_id").alias("own"), "node", "__count")
        those = stored(those, f"{place}/those")
        return join_hot(likely(read, those, "hash"), those, "hash", total).filter(F.col("doc_id").eqNullSafe(F.col("own"))).select("node", "__text")

    roots, done = components(link_sets(texts, whole, place, percent, shingle))
    member = texts.select("node", F.col("best.doc_id").alias("least"), "__count").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    top = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("__n"))
    member = stored(join_hot(member, top, "root", texts.count(), "__n").select("node", "component_id", "__count"), f"{place}/of")
    done()
    found = join_hot(rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "node"), member, "node", total).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = stored(found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), workspace(spark, "minhash-components"))
    remove(spark, place)
    return out
