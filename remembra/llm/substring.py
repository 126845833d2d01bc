"""Substring dedup by a log-structured index of window hashes (operator 7)."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remembra.llm._blobs import pack, pack_sorted, unpack, unpack_sorted
from remembra.llm._bytes import Texts, mix, pieces, raw
from remembra.llm._store import file_system, remove, tidy, workspace

#: Words of a window, bytes of text in a block (the unit in which documents are hashed), windows of the whole index in a shard, on average.
WINDOW, BLOCK_BYTES, SHARD_WINDOWS = 13, 2 << 20, 1 << 20
#: Batches in which a whole table arrives at the index.
ARRIVALS = 6

_U = np.uint64
_ROLL, _CHECK = _U(0xC2B2AE3D27D4EB4F), _U(0xA0761D6478BD642F)

#: Rows that the first step makes: windows of a block in a shard, `docs` telling which of `ids` has each first. Rows of the second: kind 0
#: tells a block of windows found elsewhere first, kind 1 names the file of a shard's piece of the new run.
FOUND = "shard int, block int, keys binary, checks binary, docs binary, ids binary"
MERGED = "kind int, place int, n long, keys binary, checks binary, firsts binary, name string"


def key_bits(expected: int) -> int:
    """Bits of the hash by which windows are sorted: as many as make equal hashes of different windows rare in an index of so many; 64 at most."""
    return min(64, max(32, 2 * max(1, expected).bit_length() - 2))


def check_type(expected: int) -> type:
    """The independent hash by which equal ones are verified: 32 bits, or 64 from 2 ** 33 windows on; with those of the key, the
    probability of any false match in the whole index is below 2 ** -30 up to 2 ** 49 windows."""
    return np.uint32 if expected < 1 << 33 else np.uint64


def windows(t: Texts, size: int, bits: int = 64, check: type = np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and counts of the words of t; the position, `bits`-bit hash and check hash of each window.

    Both hashes are polynomials of the words' hashes, of different bases.
    """
    starts, ends, n_words = t.words()
    doc = np.repeat(np.arange(t.n), n_words)
    words = t.hashes(starts, ends)
    if len(words) < size:
        return starts, ends, n_words, np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, check)
    n = len(words) - size + 1
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    out = []
    for base, width in ((_ROLL, bits), (_CHECK, 8 * np.dtype(check).itemsize)):
        rolled, power = np.zeros(n, _U), 1
        for k in range(size):
            rolled += words[k : k + n] * _U(power)
            power = power * int(base) % (1 << 64)
        out.append(mix(rolled[at]) >> _U(64 - width))
    return starts, ends, n_words, at, out[0], out[1].astype(check)


def _in_order(table: pa.Table) -> pa.Table:
    """Documents by id, so that of equal windows the first has the least; without an id last."""
    return table.sort_by([("doc_id", "ascending")])


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(2**63 - 1).to_numpy().astype(np.int64)


def _shards(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """The shard of each key: equal ranges of the hashes."""
    return ((keys >> _U(max(0, bits - 32))) * _U(shards)) >> _U(min(32, bits))


def _find(size: int, shards: int, bits: int, check: type):
    def run(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        t = Texts(*raw(table.column("text")))
        _, _, n_words, at, keys, checks = windows(t, size, bits, check)
        doc = np.repeat(np.arange(t.n, dtype=np.int32), n_words)[at]
        # the first of equal windows of the block; two that differ but share a key are both kept
        order = np.lexsort((doc, checks, keys))
        keys, checks, doc = keys[order], checks[order], doc[order]
        first = np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))[: len(keys)]
        keys, checks, doc, ids = keys[first], checks[first], doc[first], _ids(table)
        shard, rows = _shards(keys, bits, shards), []
        cut = np.append(0, np.flatnonzero(np.diff(shard)) + 1) if len(keys) else np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=False):
            those, which = np.unique(ids[doc[a:b]], return_inverse=True)
            rows.append((int(shard[a]), table.column("block")[0].as_py(), pack_sorted(keys[a:b]), pack(checks[a:b], check), pack(which, np.int32), pack_sorted(those.view(_U))))
        return _table(rows, FOUND)

    return run


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [(n, kinds[k]) for n, k in map(str.split, schema.split(", "))]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(fields)}, pa.schema(fields))


def _write_piece(folder: str, name: str, keys: np.ndarray, checks: np.ndarray, check: type) -> None:
    fs, at = file_system(folder)
    table = pa.table({"keys": pa.array([pack_sorted(keys)], pa.large_binary()), "checks": pa.array([pack(checks, check)], pa.large_binary())})
    with fs.open_output_stream(f"{at}/{name}", compression=None) as out, pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)


def _read_piece(folder: str, name: str, check: type) -> tuple[np.ndarray, np.ndarray]:
    fs, at = file_system(folder)
    with fs.open_input_stream(f"{at}/{name}", compression=None) as stream:
        table = pa.ipc.open_stream(stream).read_all()
    return unpack_sorted(table.column("keys")[0].as_py()), unpack(table.column("checks")[0].as_py(), check)


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _among(key: np.ndarray, check: np.ndarray, old: np.ndarray, old_check: np.ndarray) -> np.ndarray:
    """Which windows are among the old ones, sorted by key: the key is there, and so is the check."""
    out = np.zeros(len(key), bool)
    if not len(old):
        return out
    place = np.searchsorted(old, key)
    todo = np.arange(len(key))
    while len(todo):
        at = place[todo]
        todo, at = todo[at < len(old)], at[at < len(old)]
        same = old[at] == key[todo]
        todo, at = todo[same], at[same]
        hit = old_check[at] == check[todo]
        out[todo[hit]] = True
        todo = todo[~hit]
        place[todo] += 1
    return out


def _merge(folder: str, new: int, absorbed: set[int], check: type):
    """Merge-join a shard's new windows with its piece of every run; the new run's piece takes in those of the absorbed runs."""

    def run(table: pa.Table) -> pa.Table:
        keys, checks, blocks, firsts, names = [], [], [], [], []
        for run_, name, block, k, c, d, i in zip(*(table.column(n).to_pylist() for n in ("run", "name", "block", "keys", "checks", "docs", "ids")), strict=True):
            if run_ is not None:
                names.append((run_, name))
                continue
            keys.append(unpack_sorted(k))
            checks.append(unpack(c, check))
            blocks.append(np.full(len(keys[-1]), block, np.int32))
            firsts.append(unpack_sorted(i).view(np.int64)[unpack(d, np.int32)])
        shard = table.column("shard")[0].as_py()
        del table
        key, check_, block, first = _joined(keys, _U), _joined(checks, check), _joined(blocks, np.int32), _joined(firsts, np.int64)
        del keys, checks, blocks, firsts
        order = np.lexsort((first, key))
        if len(order) and ((key[order][1:] == key[order][:-1]) & (check_[order][1:] != check_[order][:-1])).any():
            order = np.lexsort((first, check_, key))
        key, check_, block, first = key[order], check_[order], block[order], first[order]
        head = np.append(True, (key[1:] != key[:-1]) | (check_[1:] != check_[:-1]))[: len(key)]
        lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(key) else np.zeros(0, np.int64)
        history, taken = np.zeros(len(key), bool), []
        for k, name in names:
            old = _read_piece(folder, name, check)
            history |= _among(key, check_, *old)
            if k in absorbed:
                taken.append(old)
            del old
        told = np.flatnonzero(history | (first[lead] < first))
        told = told[np.argsort(block[told], kind="stable")]
        cut = np.append(0, np.flatnonzero(np.diff(block[told])) + 1) if len(told) else []
        rows = []
        for part in np.split(told, cut[1:]) if len(told) else []:
            rows.append((0, int(block[part[0]]), len(part), pack_sorted(key[part]), pack(check_[part], check), pack(np.where(history[part], -(2**63), first[lead[part]]), np.int64), None))
        fresh = head & ~history
        merged, merged_check = _joined([key[fresh], *(k for k, _ in taken)], _U), _joined([check_[fresh], *(c for _, c in taken)], check)
        order = np.argsort(merged, kind="stable")
        if len(order):
            # a name of its own for each attempt of the task: only the one that its row tells is read
            name = f"run-{new}-{shard}-{uuid.uuid4().hex}"
            _write_piece(folder, name, merged[order], merged_check[order], check)
            rows.append((1, shard, len(order), None, None, None, name))
        return _table(rows, MERGED)

    return run


def _kept(docs: pa.Table | pa.RecordBatch, told: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int, bits: int, check: type, digest: bool) -> pa.Table:
    """The rows of docs, sorted by id, without the windows that are told or that start in a row with a smaller id."""
    t = Texts(*raw(docs.column(docs.schema.get_field_index("text"))))
    starts, ends, n_words, at, keys, checks = windows(t, size, bits, check)
    ids = docs.column(docs.schema.get_field_index("doc_id"))
    known, doc = np.asarray(ids.is_valid()), np.repeat(np.arange(t.n), n_words)
    own = np.asarray(ids.fill_null(2**63 - 1)).astype(np.int64)[doc[at]]
    first = own.copy()
    use = np.flatnonzero(known[doc[at]]) if len(at) else np.zeros(0, np.int64)
    order = use[np.lexsort((checks[use], keys[use]))]  # stable, so that of equal windows the least id comes first
    if len(order):
        k, c = keys[order], checks[order]
        head = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
        first[order] = own[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
    for k, c, f in told:
        place = np.searchsorted(k, keys)
        todo = np.arange(len(keys))
        while len(todo):
            todo = todo[place[todo] < len(k)]
            todo = todo[k[place[todo]] == keys[todo]]
            hit = c[place[todo]] == checks[todo]
            first[todo[hit]] = np.minimum(first[todo[hit]], f[place[todo[hit]]])
            todo = todo[~hit]
            place[todo] += 1
    gone = at[(first < own) & known[doc[at]]] if len(at) else at
    step = np.zeros(len(starts) + 1, np.int32)
    step[gone] += 1
    step[gone + size] -= 1
    stays = np.cumsum(step[:-1]) == 0
    # kept words with one space after each
    mask = np.zeros(len(t.data) + 1, np.int8)
    mask[starts[stays]] += 1
    mask[ends[stays]] -= 1
    inside = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    data = t.data.copy()
    data[ends[stays]] = 32
    inside[ends[stays]] = True
    flat = data[inside].tobytes()
    sums = np.append(0, np.cumsum(inside))
    # a document's last word may end at the newline between documents, which then belongs to it
    a, b = sums[t.begin].tolist(), sums[np.minimum(t.end + 1, len(t.data))].tolist()
    left = np.bincount(doc[stays], None, t.n)
    texts = [flat[x:y].strip(b" ") for x, y in zip(a, b, strict=True)]
    last = [hashlib.sha256(x).hexdigest() for x in texts] if digest else [x.decode() for x in texts]
    return pa.table({"doc_id": ids, "n_words": pa.array(n_words.astype(np.int64)), "n_removed": pa.array((n_words - left).astype(np.int64)), "kept_sha256" if digest else "text": pa.array(last, pa.string())})


def _cut(size: int, bits: int, check: type, digest: bool):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        there = [(unpack_sorted(k), unpack(c, check), unpack(f, np.int64)) for k, c, f in zip(*(told.column(n).to_pylist() for n in ("keys", "checks", "firsts")), strict=True)]
        if there:
            k, c, f = (np.concatenate(x) for x in zip(*there, strict=True))
            order = np.argsort(k, kind="stable")
            there = [(k[order], c[order], f[order])]
        return _kept(_in_order(docs), there, size, bits, check, digest)

    return run


def _whole(size: int, bits: int, check: type, digest: bool):
    """Rows without an id lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield from _kept(piece, [], size, bits, check, digest).to_batches()

    return run


def _checked(docs: DataFrame) -> None:
    kind = docs.select("doc_id").schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"doc_id decides what comes first and is an integer, not {kind.simpleString()}")


class WindowIndex:
    """The windows of all documents that have arrived, as sorted immutable runs in a folder of the shared store.

    Each run has a file per shard: the sorted hashes of its windows, of as many bits as the expected number
    of windows needs (key_bits), and an independent hash, by which a match is verified (check_type).
    A batch's windows are sorted into shards and merge-joined there with the shard's file of every run,
    which the task reads itself, so that history is never shuffled; what is new becomes a run that takes in
    the newer runs no larger than itself, so that n batches leave about log2(n) runs. A task's files
    count only once its row that names them is committed. The list of runs is a file that is written last.
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int = 1, window: int = WINDOW, expected: int = 1 << 40):
        self.spark, self.folder, self.shards, self.window = spark, folder, shards, window
        self.bits, self.check = key_bits(expected), check_type(expected)
        self.runs: list[tuple[int, int]] = []  # number and windows, oldest first
        self.batches = 0

    def _list(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/runs.json")
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(json.dumps({"window": self.window, "shards": self.shards, "bits": self.bits, "batches": self.batches, "runs": self.runs}).encode()))
        out.close()

    def _run(self, k: int) -> DataFrame:
        return self.spark.read.schema(MERGED).parquet(f"{self.folder}/batch-{k}").filter("kind = 1").select(F.lit(k).alias("run"), F.col("place").alias("shard"), "name")

    def dedup(self, docs: DataFrame, text_bytes: int, digest: bool = False) -> DataFrame:
        """(doc_id, n_words, n_removed, text) for each row of docs (doc_id, text), a batch; and takes the batch into the index.

        A word goes if a window that covers it occurred in an earlier batch, or starts in a document
        of this batch with a smaller doc_id, which is an integer. text is what is left, words joined by one space; with
        `digest`, its SHA-256 as kept_sha256 instead. A null text has no words; rows without a doc_id lose nothing and stay
        out of the index; rows that share a doc_id do not lose to each other. Place for the result is the caller's; nothing is gathered.
        """
        _checked(docs)
        blocks = max(1, -(-text_bytes // BLOCK_BYTES))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        named = rows.filter("doc_id is not null").withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
        found = named.groupBy("block").applyInArrow(_find(self.window, self.shards, self.bits, self.check), FOUND).withColumns({"run": F.lit(None).cast("int"), "name": F.lit(None).cast("string")})
        new = self.batches
        self.batches += 1
        absorbed: list[int] = []
        # a batch has about as many windows as words, and a word with its space about six bytes
        size = text_bytes // 6
        for k, n in reversed(self.runs):
            if n > size:
                break
            absorbed.append(k)
            size += n
        for k, _ in self.runs:
            found = found.unionByName(self._run(k), allowMissingColumns=True)
        folder = f"{self.folder}/runs"
        file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
        path = f"{self.folder}/batch-{new}"
        with tidy(self.spark):
            found.groupBy("shard").applyInArrow(_merge(folder, new, set(absorbed), self.check), MERGED).write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(MERGED).parquet(path)
        count = out.filter("kind = 1").agg(F.sum("n")).first()[0] or 0
        self.runs = [r for r in self.runs if r[0] not in absorbed] + [(new, count)]
        self._list()
        told = out.filter("kind = 0").select(F.col("place").alias("block"), "keys", "checks", "firsts")
        self._drop(absorbed)
        schema = f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string"
        how = (self.window, self.bits, self.check, digest)
        cut = named.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_cut(*how), schema)
        return cut.union(rows.filter("doc_id is null").mapInArrow(_whole(*how), schema))

    def _drop(self, runs: list[int]) -> None:
        """Remove the files of runs that a newer one has taken in."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for k in runs:
            some = hadoop.Path(f"{self.folder}/runs/run-{k}-*")
            fs = some.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for status in fs.globStatus(some):
                fs.delete(status.getPath(), False)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, arrivals: int = ARRIVALS, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, text) for each row of docs: without words covered by a window whose
    words also start in a document with a smaller doc_id. The table arrives at a new WindowIndex
    in batches of ascending doc_id; see there for nulls, repeated rows and `digest`. An empty table gives none."""
    _checked(docs)
    spark = docs.sparkSession
    place = workspace(spark, "substring")
    rows = docs.select("doc_id", "text")
    shares = [(k + 1) / arrivals for k in range(arrivals - 1)]
    about = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.percentile_approx("doc_id", F.array(*map(F.lit, shares))).alias("cuts")).first()
    cuts = [None, *(about.cuts or []), None] if shares else [None, None]
    size = -(-(about.n or 0) // (len(cuts) - 1))
    index = WindowIndex(spark, f"{place}/index", max(1, -(-(about.n or 0) // (6 * SHARD_WINDOWS))), window, (about.n or 0) // 6)
    parts = []
    for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = rows
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        if low is None:
            part = part if high is None else rows.filter((F.col("doc_id") <= high) | F.col("doc_id").isNull())
        with tidy(spark):
            index.dedup(part, size, digest).write.option("compression", "zstd").parquet(f"{place}/out-{k}")
        parts.append(f"{place}/out-{k}")
    remove(spark, f"{place}/index")
    return spark.read.schema(f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string").parquet(*parts)
