"""Byte-level BPE encoding and decoding in padded numpy matrices (operator 5)."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remembra.llm._bytes import pieces
from remembra.llm._store import held, quoted, released

#: Longest piece, in bytes, that goes through a matrix; each longer one is merged by a heap of its own.
LONGEST = 256
#: Memory for the pieces that a task remembers, in bytes, and what a piece takes beside its text; beyond it only those of the text at hand stay.
REMEMBERED, PER_PIECE = 12 << 20, 220
#: Cells of a matrix at most.
CELLS = 1 << 19
#: Text encoded at once, in bytes; of a longer document so many pieces at once.
AT_ONCE, PIECES_AT_ONCE = 1 << 19, 1 << 16

_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of a tiktoken file, and a hash table of all pairs of tokens whose joined bytes are a token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum([len(x) for x in tokens])
        self.lengths = np.array([len(x) for x in tokens])
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError(f"{path}: not every byte is a token")
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several keys for one slot the last one stays
            put = self.keys[slot] == keys
            self.values[slot[put]] = values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's joined token, or _NONE (also for a negative id, which is padding)."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        out = np.full(keys.shape, _NONE, np.int32)
        flat = out.ravel()
        todo = np.flatnonzero((a >= 0).ravel() & (b >= 0).ravel())
        keys = keys.ravel()[todo]
        slot = self._slot(keys)
        while len(todo):
            found = self.keys[slot]
            hit = found == keys
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found >= 0)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _matrix(self, group: list[bytes], width: int) -> list[np.ndarray]:
        """Merge pieces of at most `width` bytes, one row each."""
        n = len(group)
        ids = np.full((n, width), -1, np.int32)
        lengths = np.array([len(x) for x in group])
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(group), np.uint8)]
        ranks = np.full((n, width), _NONE, np.int32)  # the last column never holds a pair
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(n), [None] * n
        columns = np.arange(width - 1)
        while True:
            at = ranks.argmin(1)  # the leftmost of equal ranks
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                for r, x, k in zip(rows[done].tolist(), ids[done], (ids[done] >= 0).sum(1).tolist(), strict=True):
                    out[r] = x[:k]
                rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
            if not len(rows):
                return out
            here = np.arange(len(rows))
            ids[here, at] = best
            take = columns + (columns > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, take, 1)
            ids[:, -1] = -1
            ranks[:, :-1] = np.take_along_axis(ranks, take, 1)
            right = np.where(at + 1 < width, ids[here, np.minimum(at + 1, width - 1)], -1)
            ranks[here, at] = self.rank(best, right)
            left = np.where(at > 0, ids[here, at - 1], -1)
            changed = np.flatnonzero(at > 0)
            ranks[changed, at[changed] - 1] = self.rank(left[changed], best[changed])

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, in n log n steps."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := pairs.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, k, a, b = heapq.heappop(queue)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = r, -1, after[j]
            if after[k] < n:
                before[after[k]] = k
                if (x := pairs.get(r << 32 | ids[after[k]])) is not None:
                    heapq.heappush(queue, (x, k, r, ids[after[k]]))
            if before[k] >= 0 and (x := pairs.get(ids[before[k]] << 32 | r)) is not None:
                heapq.heappush(queue, (x, before[k], ids[before[k]], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, found: list[bytes]) -> list[np.ndarray]:
        """Tokens of each piece; a piece that is a token is that token."""
        out: list[np.ndarray | None] = [None] * len(found)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(found):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > LONGEST:
                out[i] = self._heap(piece)
            else:
                n = len(piece)
                buckets.setdefault(n if n <= 16 else -(-n // 8) * 8 if n <= 64 else -(-n // 64) * 64, []).append(i)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._matrix([found[i] for i in part], width), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, and the number of bytes before each token and after the last."""
        n = self.lengths[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        return self.flat[np.repeat(self.ends[ids] - n - ends[:-1], n) + np.arange(ends[-1])], ends


class Encoder:
    """Encodes texts; remembers the tokens of pieces within REMEMBERED bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.counts, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _of(self, which: np.ndarray) -> np.ndarray:
        """The tokens of remembered pieces, one after the other."""
        n = self.counts[which]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[which] - ends + n, n) + np.arange(n.sum())]

    def _forget(self, but: set[str]) -> None:
        """Remember only those pieces: frequent ones are among them more often than not."""
        stay = [p for p in but if p in self.index]
        which = np.array([self.index[p] for p in stay], np.int64)
        flat, counts = self._of(which), self.counts[which]
        self.index = dict(zip(stay, range(len(stay)), strict=True))
        self.flat, self.counts, self.starts = flat, counts, np.cumsum(counts) - counts
        self.size = sum(PER_PIECE + 4 * len(p) for p in stay)

    def tokens(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, and the number of tokens of each."""
        distinct = set(found)
        if self.size > REMEMBERED:
            self._forget(distinct)
        known = self.index
        fresh = [p for p in distinct if p not in known]
        if fresh:
            made = self.v.encode_pieces([p.encode() for p in fresh])
            base = len(known)
            known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            counts = np.array([len(x) for x in made])
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(counts) - counts)
            self.counts = np.append(self.counts, counts)
            self.flat = np.concatenate([self.flat, *made])
            self.size += sum(PER_PIECE + 4 * len(p) for p in fresh)
        which = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        return self._of(which), self.counts[which]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts, and the number of tokens before each text and after the last."""
        if len(texts) == 1 and len(texts[0]) > AT_ONCE:
            matches, parts = self.v.pattern.finditer(texts[0]), []
            while some := [m.group() for m in islice(matches, PIECES_AT_ONCE)]:
                parts.append(self.tokens(some)[0])
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            return ids, np.array([0, len(ids)])
        found, bounds = [], [0]
        for x in texts:
            found += self.v.pattern.findall(x)
            bounds.append(len(found))
        ids, counts = self.tokens(found)
        return ids, np.append(0, np.cumsum(counts))[bounds]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _encoded(docs: DataFrame, path: str, pattern: str, text: str, new: list[T.StructField], columns: Callable[[Vocabulary, np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """docs with new columns, made of the tokens of its texts and each text's bounds among them, in place of `text`."""
    rest = [c for c in docs.columns if c not in (text, *(f.name for f in new))]
    rows = docs.select(held(rest), F.col(quoted(text)).alias("__text"))
    schema = rows.select("__row").schema
    for f in new:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        encoder = Encoder(v)
        for batch in batches:
            for piece in pieces(batch, "__text", AT_ONCE):
                ids, bounds = encoder.encode([x or "" for x in piece.column(piece.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns(v, ids, bounds)], ["__row", *(f.name for f in new)])

    return rows.mapInArrow(run, schema).select(*released(rest), *(quoted(f.name) for f in new))


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))


def _bytes(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The bytes of each text's tokens."""
    data, ends = v.decode(ids.astype(np.int64))
    cut, raw = ends[bounds].tolist(), data.tobytes()
    return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """docs with an array<int> column `tokens` in place of `text`: each match of pattern encoded by itself by the ranks in the file at path.

    No special tokens; a null or empty text has no tokens. One pass without a shuffle; every other
    column is kept, a column named like `tokens` is replaced, repeated rows stay. path is read where the tasks run.
    """
    return _encoded(docs, path, pattern, text, [T.StructField(tokens, T.ArrayType(T.IntegerType()))], lambda v, ids, bounds: [_lists(ids, bounds)])


def bpe_decode(encoded: DataFrame, path: str, pattern: str, tokens: str = "tokens", out: str = "bytes") -> DataFrame:
    """encoded with a binary column `out`: the bytes of its tokens (null or empty: no bytes). Other columns are kept, one named like `out` is replaced."""
    rest = [c for c in encoded.columns if c != out]
    rows = encoded.select(held(rest), F.col(quoted(tokens)).alias("__tokens"))
    schema = rows.select("__row").schema.add(out, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                column = part.column(1)
                counts = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
                found = _bytes(v, column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["__row", out])

    return rows.mapInArrow(run, schema).select(*released(rest), quoted(out))


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", tokens: str = "tokens", out: str = "bytes") -> DataFrame:
    """bpe_decode of bpe_encode in one pass of one worker: docs with `tokens` and `out`, the bytes decoded from them, in place of `text`."""
    new = [T.StructField(tokens, T.ArrayType(T.IntegerType())), T.StructField(out, T.BinaryType())]
    return _encoded(docs, path, pattern, text, new, lambda v, ids, bounds: [_lists(ids, bounds), pa.array(_bytes(v, ids, bounds), pa.binary())])


def tokenised(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with `tokens`, `n_tokens` (long) and, in place, the text decoded from the tokens.

    A null text stays null and has no tokens, an empty one stays empty; repeated rows stay. All other columns are
    kept, whatever their names, but for columns named tokens or n_tokens, which are replaced.
    """
    rest = [c for c in docs.columns if c not in ("text", "tokens", "n_tokens")]
    found = bpe_round_trip(docs.select(held(rest), F.isnull("text").alias("null"), "text"), path, pattern)
    text = F.when(~F.col("null"), F.decode("bytes", "UTF-8")).alias("text")
    order = [text if c == "text" else released([c])[0] for c in docs.columns if c not in ("tokens", "n_tokens")]
    return found.select(*order, "tokens", F.size("tokens").cast("long").alias("n_tokens"))


def bpe_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs: encoded, then decoded from the tokens.

    A null text is empty: no tokens, digests of no bytes. Repeated rows give a row each; other columns are not read.
    """
    both = bpe_round_trip(docs.select("doc_id", "text"), path, pattern)
    return both.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("tokens").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
