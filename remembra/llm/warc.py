"""Deterministic sharded WARC archives: writer and reader (operator 10)."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remembra.llm._graph import join_hot
from remembra.llm._store import file_system, remove, stored, workspace

#: Least payload bytes of one range of records, most ranges, compressed bytes after which a file is rolled, and least payload that is revisited.
RANGE_BYTES, RANGES, ROLL_BYTES, LEAST_REVISIT = 16 << 20, 1 << 16, 32 << 20, 1000
#: Steps of page_id that one pass of _ranges counts: at most, and for each range that is to be.
STEPS, STEPS_A_RANGE = 1 << 17, 16
#: Stands for a null page_id, which comes first.
NO_ID = -(1 << 63)

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records hold no clock time, so that the same rows make the same bytes.
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "temporary string, name string, records long, bytes long, sha1 string"


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(parts).encode()).digest()[:16], version=5)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, the same bytes for the same input."""
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in [*headers, ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, copy: int, refers_to: int | None) -> bytes:
    """A response, or a revisit of page `refers_to`, whose block has the HTTP headers alone. copy: counts rows with one page_id and payload."""
    digest = hashlib.sha1(payload).digest()
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id, digest, copy)), ("WARC-Date", DATE)]
    if url:
        headers.append(("WARC-Target-URI", "".join(url.split())))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to, digest, 0)), ("X-Refers-To-Page", str(refers_to))]
    headers += [("WARC-Payload-Digest", _b32(digest)), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(headers, http + (payload if refers_to is None else b""))


class _File:
    """A file under a temporary name that no other attempt of the task uses."""

    def __init__(self, folder: str, name: str):
        self.fs, at = file_system(folder)
        self.name, self.temporary = name, f"tmp/{uuid.uuid4().hex}"
        self.out, self.bytes, self.records, self.sha1 = self.fs.open_output_stream(f"{at}/{self.temporary}", compression=None), 0, 0, hashlib.sha1()
        self.put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        row = (self.temporary, self.name, self.records, self.bytes, self.sha1.hexdigest())
        return pa.RecordBatch.from_pydict({n.split()[0]: [v] for n, v in zip(MANIFEST.split(", "), row, strict=True)})


def _write(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rolled, file = None, 0, None
        decision = last = None
        copy = 0
        for batch in batches:
            for shard, page_id, digest, kind, top, url, html in zip(*(c for c in batch.columns), strict=True):
                if shard.as_py() != part:
                    if file:
                        yield file.close()
                    part, rolled, file = shard.as_py(), 0, None
                key = (page_id.as_py(), digest.as_py())
                if kind.as_py() == 0:
                    decision = (key, top.as_py())
                    continue
                copy, last = (copy + 1 if key == last else 0), key
                top_id = decision[1] if decision and decision[0] == key else None
                refers = top_id if top_id is not None and (key[0] != top_id or copy) else None
                if file is None:
                    file = _File(folder, f"pages-{part:06d}-{rolled:04d}.warc.gz")
                file.put(page_record(key[0], url.as_py(), (html.as_py() or "").encode(), copy, refers))
                if file.bytes >= roll:
                    yield file.close()
                    rolled, file = rolled + 1, None
        if file:
            yield file.close()

    return run


def _commit(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        for batch in batches:
            for temporary, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fs.get_file_info(f"{at}/{temporary}").type != pafs.FileType.NotFound:  # else an earlier attempt has moved it
                    fs.move(f"{at}/{temporary}", f"{at}/data/{name}")
            yield batch

    return run


def _counted(low: np.ndarray, high: np.ndarray, step: np.ndarray):
    """Bytes of each step of the intervals low..high, from rows (id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = (np.asarray(c) for c in batch.columns)
            at = np.searchsorted(low, ids, "right") - 1
            mine = (at >= 0) & (ids <= high[at])
            at, ids, n = at[mine], ids[mine], n[mine]
            part = (ids.view(np.uint64) - low[at].view(np.uint64)) // step[at]  # of any distance, modulo 2 ** 64
            keys, which = np.unique(np.stack([at.astype(np.uint64), part]), axis=1, return_inverse=True)
            sums = np.zeros(keys.shape[1], np.int64)
            np.add.at(sums, which.ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int64)), pa.array(keys[1].astype(np.int64)), pa.array(sums)], ["at", "part", "n"])

    return run


def _ranges(ids: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Cuts of rows (id, digest, n) in that order into ranges of about `size` bytes: where buckets of ids start, the range of each bucket, and
    for ids that are larger than that by themselves, the range of each piece of an even division of the digests.

    An interval of ids is counted in even steps, and each step that is too large again, until none is but single
    ids: an outlying id costs a pass, and no more. All follows from the rows. The driver gets STEPS rows a pass.
    """
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return np.array([NO_ID]), np.zeros(1, np.int64), {}
    steps = min(STEPS, max(64, STEPS_A_RANGE * -(-(ids.agg(F.sum("n")).first()[0] or 0) // size)))
    open_, done = [(low, high)], []
    while open_:
        lows, highs = (np.array(x, np.int64) for x in zip(*open_, strict=True))
        step = [max(1, -(-(b - a + 1) // max(2, steps // len(open_)))) for a, b in open_]
        found = ids.select("id", "n").mapInArrow(_counted(lows, highs, np.array(step, np.uint64)), "at long, part long, n long").groupBy("at", "part").agg(F.sum("n").alias("n")).collect()
        again = []
        for r in found:
            a = open_[r.at][0] + r.part * step[r.at]
            b = min(open_[r.at][1], a + step[r.at] - 1)
            (again if r.n > size and b > a else done).append((a, b) if r.n > size and b > a else (a, r.n))
        open_ = sorted(again)
    done.sort()
    large = [a for a, n in done if n > size]
    pieces: dict[int, list[tuple[int, int]]] = {a: [] for a in large}
    count = max(1, min(1 << 16, steps // max(1, len(large))))
    if large:
        # the digests' first four digits, in `count` even pieces
        piece = F.floor(F.conv(F.substring("digest", 1, 4), 16, 10).cast("long") * count / (1 << 16)).cast("int")
        some = ids.sparkSession.createDataFrame([(a,) for a in large], "id long")
        for r in ids.join(F.broadcast(some), "id", "left_semi").groupBy("id", piece.alias("piece")).agg(F.sum("n").alias("n")).collect():
            pieces[r.id].append((r.piece, r.n))
    before, ranges, split = 0, [], {}
    for a, n in done:
        ranges.append(before // size)
        if a in pieces:
            own = np.zeros(count, np.int64)
            for k, m in pieces[a]:
                own[k] = m
            split[a] = (before + np.cumsum(own) - own) // size
        before += n
    return np.array([a for a, _ in done], np.int64), np.array(ranges, np.int64), split


def _range_of(cuts: tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]):
    starts, ranges, split = cuts

    def run(ids: pd.Series, digests: pd.Series) -> pd.Series:
        i = ids.to_numpy(np.int64)
        out = ranges[np.maximum(np.searchsorted(starts, i, "right") - 1, 0)]
        for a, own in split.items():
            at = np.flatnonzero(i == a)
            if len(at):
                prefix = np.array([int(d[:4], 16) for d in digests.iloc[at]], np.int64)
                out[at] = own[prefix * len(own) >> 16]
        return pd.Series(out.astype(np.int32))

    return run


def write_warc(pages: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) under folder/data; returns the manifest.

    Rows are range-sorted by page_id, then payload digest and url; ranges are cut where about RANGE_BYTES of payload (or the
    RANGES-th part of all) are full, also within one page_id, each is a task's, and its files are rolled at
    `roll` compressed bytes. Of equal payloads of LEAST_REVISIT bytes or more, the one with the largest page_id is a
    response (the first of equal rows), the others are revisits that name it; if all their page_ids
    are null, all are responses. page_id is an integer. A null html is an empty payload, a null page_id or url has no
    header; an empty table makes no file. Tasks write under temporary names and report them; the reports of the attempts that
    succeeded are written as folder/manifest, and only its files are moved to their final names, so a lost
    task or a second attempt leaves nothing behind and the archive's bytes depend on the rows alone.
    Other columns are not written.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    key = [F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id"), F.sha1(F.col("html").cast("binary")).alias("digest")]
    ids = stored(rows.select(*key, "page_id", F.octet_length("html").cast("long").alias("n")), f"{folder}/ids")
    total, count = ids.agg(F.sum("n"), F.count("*")).first()
    cuts = _ranges(ids, max(RANGE_BYTES, -(-(total or 0) // RANGES)))
    ranges = int(max(cuts[1].max(), *(x.max() for x in cuts[2].values()))) + 1 if cuts[2] else int(cuts[1].max()) + 1
    equal = ids.filter(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("__count")).filter("__count > 1 and top is not null")
    equal = stored(equal, f"{folder}/equal")
    decisions = join_hot(ids.select("id", "page_id", "digest"), equal, "digest", count).select("id", "page_id", "digest", F.lit(0).alias("kind"), "top", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")).distinct()
    both = rows.select(*key, "page_id", F.lit(1).alias("kind"), F.lit(None).cast(ids.schema["page_id"].dataType).alias("top"), "url", "html").select(*decisions.columns).union(decisions)
    fs, at = file_system(folder)
    fs.create_dir(f"{at}/tmp", recursive=True)
    fs.create_dir(f"{at}/data", recursive=True)
    shard = F.pandas_udf(_range_of(cuts), "int")("id", "digest")
    ordered = both.withColumn("shard", shard).select("shard", "page_id", "digest", "kind", "top", "url", "html")
    ordered = ordered.repartitionById(ranges, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    manifest = stored(ordered.mapInArrow(_write(folder, roll), MANIFEST), f"{folder}/manifest")
    moved = manifest.repartition(max(1, ranges // 16)).mapInArrow(_commit(folder), MANIFEST).count()
    assert moved == manifest.count()
    for name in ("tmp", "ids", "equal"):
        remove(spark, f"{folder}/{name}")
    return manifest


def records(fs: pafs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive of one gzip member a record, one in memory at a time."""
    with fs.open_input_stream(path, compression=None) as stream:
        data, unpacker, out = b"", zlib.decompressobj(31), []
        while True:
            if not data and not (data := stream.read(1 << 20)):
                if out and any(out):
                    raise ValueError(f"{path}: cut within a record")
                return
            out.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                head, _, block = b"".join(out).partition(b"\r\n\r\n")
                version, *lines = head.split(b"\r\n")
                headers = dict(x.decode().split(": ", 1) for x in lines)
                if version != VERSION or block[int(headers["Content-Length"]) :] != b"\r\n\r\n":
                    raise ValueError(f"{path}: not a record: {head[:80]!r}")
                yield headers, block[:-4]
                unpacker, out = zlib.decompressobj(31), []


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _read(folder: str, payload: bool):
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * payload

    def parse(headers: dict[str, str], block: bytes) -> tuple:
        http, _, body = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
        if _b32(hashlib.sha1(block).digest()) != headers["WARC-Block-Digest"] or headers["WARC-Type"] == "response" and (len(body) != size or hashlib.sha1(body).digest() != digest):
            raise ValueError(f"{headers['WARC-Record-ID']}: the digest doesn't fit")
        number = lambda k: int(headers[k]) if k in headers else None
        return (number("X-Page-Id"), headers.get("WARC-Target-URI"), headers["WARC-Type"], number("X-Refers-To-Page"), size, digest.hex()) + (body,) * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in map(str.split, READ.split(", "))] + [("payload", pa.binary())] * payload)
        for batch in batches:
            for name, count in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                for headers, block in records(fs, f"{at}/data/{name}"):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    rows.append(parse(headers, block))
                    held, seen = held + len(block) * payload, seen + 1
                    if len(rows) == 5000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names)
                if seen != count:
                    raise ValueError(f"{name}: {seen} records, {count} in the manifest")

    return run


def read_warc(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """A row of READ for each record of the archives in folder's manifest, digests and counts checked; with `payload`, its bytes (none for a revisit)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(_read(folder, payload), READ + ", payload binary" * payload)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of pages; see write_warc."""
    folder = workspace(pages.sparkSession, "warc")
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
