"""Language-model scoring by context-tree weighting over bytes (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remembra.llm._blobs import pack, pack_sorted, unpack, unpack_sorted
from remembra.llm._bytes import SPACE, Texts, pieces, raw
from remembra.llm._store import remove, stored, workspace

#: Bytes of the longest context.
DEPTH = 6
#: Bytes of text in a block (the unit in which documents are counted and scored) and of a piece of it; contexts of a shard of the model, on
#: average; contexts whose trees are in memory at once, and keys of a block that travel in one row.
BLOCK_BYTES, PIECE_BYTES, SHARD_KEYS, SLICE, ROW_KEYS = 8 << 20, 1 << 19, 1 << 19, 1 << 16, 1 << 17
#: A context is split over shards by its next byte if it has more than so many keys, counted by block, and more than one in so many of all.
HEAVY_KEYS, HEAVY_SHARE = 1 << 18, 4096
#: Rows that go to Python at once: of megabytes of keys, and of texts or the keys of a block in a shard.
AT_ONCE, SOME = 2, 64

_U = np.uint64
_END = 10
FOUND = "kind int, shard int, block int, part int, n long, keys binary, counts binary"
ANSWER = "kind int, shard int, block int, part int, n long, total long, data binary, more binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [(n, _KINDS[k]) for n, k in map(str.split, schema.split(", "))]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(fields)}, pa.schema(fields))


# ---- the model: all of it from counts of (context, byte) ----


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log(gamma(n + 1/2)), n >= 0."""
    x = np.asarray(n, np.float64) + 0.5
    low = np.zeros_like(x)
    for _ in range(7):
        small = x < 7
        low -= np.where(small, np.log(np.where(small, x, 1.0)), 0)
        x = np.where(small, x + 1, x)
    return low + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any string of a zeros and b ones."""
    return log_gamma_half(a) + log_gamma_half(b) - 1.1447298858494002 - log_gamma_half(np.asarray(a, np.float64) + b + 0.5)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(values, head) if len(head) else values


class Nodes:
    """The binary nodes of all contexts of one depth at one bit: id (context and the byte's bits before), counts, share of the node's own estimate."""

    __slots__ = ("ids", "zeros", "ones", "own", "log_weighted", "children")

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int, below: Nodes | None):
        ids = keys >> _U(8 - bit)
        one = (keys >> _U(7 - bit)) & _U(1)
        head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        self.ids = ids[head]
        self.ones = np.add.reduceat(np.where(one == 1, counts, 0), head)
        self.zeros = np.add.reduceat(counts, head) - self.ones
        kt, self.children = log_kt(self.zeros, self.ones), np.zeros(len(head))
        if below is None:
            self.log_weighted, self.own = kt, np.ones(len(kt))
        else:
            parent = ((below.ids >> _U(bit + 8)) << _U(bit)) | (below.ids & _U((1 << bit) - 1))
            np.add.at(self.children, np.searchsorted(self.ids, parent), below.log_weighted)
            self.weigh(kt, self.children)

    def weigh(self, kt: np.ndarray, children: np.ndarray) -> None:
        """P = KT / 2 + (product over the children) / 2."""
        self.log_weighted = np.logaddexp(kt, children) - np.log(2)
        self.own = np.exp(kt - np.log(2) - self.log_weighted)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.ids, ids)
        at[at == len(self.ids)] = 0
        return at, (self.ids[at] == ids if len(self.ids) else np.zeros(len(ids), bool))

    def mixed(self, ids: np.ndarray, bits: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """The probability of each bit at its node, mixed with what deeper nodes say (NaN: none has been seen); NaN if this has not."""
        at, there = self.find(ids)
        if not len(self.ids):
            return deeper
        n1, n0 = self.ones[at], self.zeros[at]
        kt = (np.where(bits == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
        share = np.where(np.isnan(deeper), 1.0, self.own[at])
        return np.where(there, share * kt + (1 - share) * np.where(np.isnan(deeper), 0, deeper), deeper)


class Forest:
    """The nodes of depth `least` and more of whole trees whose counts are given; keys are contexts, nearest byte first, then the byte."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, least: int = 2):
        self.depth, self.least, self.nodes = depth, least, {}
        for d in range(depth, least - 1, -1):
            if d < depth:
                keys, counts = _summed(((keys >> _U(16)) << _U(8)) | (keys & _U(255)), counts)
            for bit in range(8):
                self.nodes[d, bit] = Nodes(keys, counts, bit, self.nodes.get((d + 1, bit))) if len(keys) else None
        self.keys, self.counts = keys, counts  # of depth `least`

    def mixed(self, keys: np.ndarray, bit: int) -> np.ndarray:
        """The probability of each key's bit as depths `least` and more have it; NaN where none of its contexts has been seen."""
        bits, out = (keys >> _U(7 - bit)) & _U(1), np.full(len(keys), np.nan)
        top = (keys & _U(255)) >> _U(8 - bit)
        for d in range(self.depth, self.least - 1, -1):
            nodes = self.nodes[d, bit]
            if nodes is not None:
                context = keys >> _U(8 * (self.depth - d) + 8)
                out = nodes.mixed((context << _U(bit)) | top, bits, out)
        return out


#: Numbers of a context above the shards: the counts of its bytes and, behind, the log probabilities of all its nodes' children, by bit.
WIDTH = 256 + 255


class Upper:
    """The contexts that stand above the shards: those of depths 0 and 1, and heavy ones of depth 2 and more.

    With each one the shorter ones of the same bytes are there. The first context of a key that is not here is the
    root of a tree that is whole in one shard.
    """

    def __init__(self, depth: int, heavy: dict[int, np.ndarray] | None = None):
        self.depth, self.contexts = depth, [np.zeros(1, _U), np.arange(256, dtype=_U)]
        for d in range(2, depth):
            some = np.unique((heavy or {}).get(d, np.zeros(0, _U)))
            some = some[_within(some >> _U(8), self.contexts[-1])]
            if not len(some):
                break
            self.contexts.append(some)
        self.first = np.append(0, np.cumsum([len(c) for c in self.contexts]))
        self.size = int(self.first[-1]) * WIDTH

    def context(self, keys: np.ndarray, d: int) -> np.ndarray:
        return keys >> _U(8 * (self.depth - d) + 8)

    def roots(self, keys: np.ndarray) -> np.ndarray:
        """The depth of the root of each key's tree."""
        out = np.full(len(keys), 2)
        for d, some in enumerate(self.contexts[2:], 2):
            out[(out == d) & _within(self.context(keys, d), some)] = d + 1
        return out

    def trees(self, keys: np.ndarray) -> np.ndarray:
        """What tells each key's tree from others: its root, of whatever depth."""
        depth, out = self.roots(keys), np.zeros(len(keys), _U)
        for d in np.unique(depth).tolist():
            out[depth == d] = (self.context(keys[depth == d], d) << _U(3)) | _U(d)
        return out

    def slices(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Depth of the roots, and places of sorted keys: whole trees, as many as SLICE keys hold, or one."""
        roots = self.roots(keys)
        for d in np.unique(roots).tolist():
            at = np.flatnonzero(roots == d)
            root = self.context(keys[at], d)
            heads = np.append(np.flatnonzero(np.append(True, root[1:] != root[:-1])), len(at))
            k = 0
            while heads[k] < len(at):
                to = max(k + 1, int(np.searchsorted(heads, heads[k] + SLICE, "right")) - 1)
                yield d, at[heads[k] : heads[to]]
                k = to

    def place(self, d: int, contexts: np.ndarray) -> np.ndarray:
        return (self.first[d] + np.searchsorted(self.contexts[d], contexts)) * WIDTH


def _within(values: np.ndarray, those: np.ndarray) -> np.ndarray:
    at = np.searchsorted(those, values)
    at[at == len(those)] = 0
    return those[at] == values if len(those) else np.zeros(len(values), bool)


def top_statistics(forest: Forest, upper: Upper) -> tuple[np.ndarray, np.ndarray]:
    """What the contexts above a forest of whole trees need of it: places and values to add up."""
    if not len(forest.keys):
        return np.zeros(0, np.int64), np.zeros(0)
    d = forest.least - 1
    places, values = [upper.place(d, forest.keys >> _U(16)) + (forest.keys & _U(255)).astype(np.int64)], [forest.counts.astype(np.float64)]
    for bit in range(8):
        nodes = forest.nodes[forest.least, bit]
        places.append(upper.place(d, nodes.ids >> _U(bit + 8)) + 255 + (1 << bit) + (nodes.ids & _U((1 << bit) - 1)).astype(np.int64))
        values.append(nodes.log_weighted)
    return _summed(np.concatenate(places), np.concatenate(values))


class Top:
    """The nodes of the contexts above the shards, from the statistics of all forests added up."""

    def __init__(self, upper: Upper, statistics: np.ndarray):
        self.upper, self.nodes, counts = upper, {}, None
        table = statistics.reshape(-1, WIDTH)
        for d in range(len(upper.contexts) - 1, -1, -1):
            own, those = table[upper.first[d] : upper.first[d + 1]], upper.contexts[d]
            total = own[:, :256].round().astype(np.int64)
            if counts is not None:
                np.add.at(total, np.searchsorted(those, upper.contexts[d + 1] >> _U(8)), counts)
            counts = total
            row, byte = np.nonzero(total)
            for bit in range(8) if len(row) else ():
                self.nodes[d, bit] = nodes = Nodes((those[row] << _U(8)) | byte.astype(_U), total[row, byte], bit, self.nodes.get((d + 1, bit)))
                # children that are trees, beside those that are here
                sums = own[np.searchsorted(those, nodes.ids >> _U(bit)), 255 + (1 << bit) + (nodes.ids & _U((1 << bit) - 1)).astype(np.int64)]
                nodes.weigh(log_kt(nodes.zeros, nodes.ones), nodes.children + sums)

    def log10(self, forest: Forest, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's byte in its context: its eight bits, each mixed over all depths."""
        total, byte = np.zeros(len(keys)), keys & _U(255)
        for bit in range(8):
            p, bits, top = forest.mixed(keys, bit), (keys >> _U(7 - bit)) & _U(1), byte >> _U(8 - bit)
            for d in range(forest.least - 1, -1, -1):
                if (d, bit) in self.nodes:
                    p = self.nodes[d, bit].mixed((self.upper.context(keys, d) << _U(bit)) | top, bits, p)
            total += np.log10(np.where(np.isnan(p), 0.5, p))
        return total


# ---- documents as keys ----


def sequences(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' hashes and counts by document; all documents' bytes (words, one space between, then a newline), and where each starts and ends."""
    t.lower()
    starts, ends, n_words = t.words()
    hashes = t.hashes(starts, ends)
    keep = ~SPACE[t.data]
    keep[ends] = True
    data = t.data.copy()
    data[ends] = 32
    some = n_words > 0
    data[ends[(np.cumsum(n_words) - 1)[some]]] = _END
    data[t.end[~some]] = _END
    keep[t.end[~some]] = True
    sums = np.append(0, np.cumsum(keep))
    return hashes, n_words, data[keep], sums[t.begin], sums[t.end + 1]


def context_keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """For each byte its `depth` bytes before, nearest first, and the byte; before a document stand newlines."""
    place = np.arange(len(data)) - np.repeat(begin, end - begin)
    keys = np.zeros(len(data), _U)
    for k in range(1, depth + 1):
        before = np.full(len(data), _END, np.uint8)
        before[k:] = data[:-k]
        before[place < k] = _END
        keys |= before.astype(_U) << _U(8 * (depth + 1 - k))
    return keys | data


def _block(table: pa.Table, depth: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for piece in pieces(table, "text", PIECE_BYTES):
        hashes, n_words, data, begin, end = sequences(Texts(*raw(piece.column("text"))))
        yield piece, hashes, n_words, context_keys(data, begin, end, depth), begin, end


class _Sum:
    """Distinct keys and their summed counts, merged whenever what has come is a quarter of what is there."""

    def __init__(self):
        self.keys, self.counts, self.fresh, self.size = np.zeros(0, _U), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.fresh.append((keys, counts))
        self.size += len(keys)
        if self.size > max(len(self.keys) // 4, 1 << 18):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.fresh:
            parts = [(self.keys, self.counts), *self.fresh]
            self.fresh, self.size = [], 0
            self.keys, self.counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
        return self.keys, self.counts


def _counted(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is learned, which may be never."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if keys.max() >> _U(63):
        order = np.argsort(keys)
        keys, flag = keys[order], learned[order].astype(np.int64)
    else:
        s = np.sort((keys << _U(1)) | learned)
        keys, flag = s >> _U(1), (s & _U(1)).astype(np.int64)
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[head], np.add.reduceat(flag, head)


def _split(values: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that values fall to by their hash, and their places, in order."""
    shard = ((values * _U(0x9E3779B97F4A7C15)) >> _U(40)) % _U(shards)
    order = np.argsort(shard, kind="stable")
    cut = np.append(0, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ()
    for at in np.split(order, cut[1:]) if len(order) else ():
        yield int(shard[at[0]]), at


def _distinct(table: pa.Table, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Context keys and word hashes of a block, each with its training count."""
    grams, words = _Sum(), _Sum()
    for piece, hashes, n_words, keys, begin, end in _block(table, depth):
        train = ~piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        grams.add(*_counted(keys, np.repeat(train, end - begin)))
        words.add(*_counted(hashes, np.repeat(train, n_words)))
    return [grams.merge(), words.merge()]


def _count(shards: int, depth: int):
    """Kind 0: pieces of the block's sorted context keys. Kind 1: its words, by shard. Kind 4: its contexts of depth `shard` that may be heavy, and their keys."""

    def run(table: pa.Table) -> pa.Table:
        block, rows = table.column("block")[0].as_py(), []
        (keys, counts), (words, n) = _distinct(table, depth)
        for k, a in enumerate(range(0, len(keys), ROW_KEYS)):
            part = keys[a : a + ROW_KEYS]
            rows.append((0, None, block, k, len(part), pack_sorted(part), pack(counts[a : a + ROW_KEYS], np.int32)))
        for s, at in _split(words, shards):
            rows.append((1, s, block, 0, len(at), pack_sorted(words[at]), pack(n[at], np.int32)))
        for d in range(2, depth if len(keys) else 0):
            some = keys >> _U(8 * (depth - d) + 8)
            head = np.append(np.flatnonzero(np.append(True, some[1:] != some[:-1])), len(keys))
            often = np.flatnonzero(np.diff(head) * HEAVY_SHARE > len(keys))  # one that is so nowhere isn't heavy
            if len(often):
                rows.append((4, d, block, 0, len(often), pack_sorted(some[head[often]]), pack(np.diff(head)[often], np.int64)))
        return _table(rows, FOUND)

    return run


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = unpack(counts, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), d, np.int32)), pa.array(unpack_sorted(keys).view(np.int64)), pa.array(n)], ["d", "context", "n"])


def _dealt(shards: int, upper: Upper):
    """The blocks' context keys by shard; all keys of a tree are in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, keys, counts in zip(*(batch.column(c) for c in ("block", "part", "keys", "counts")), strict=True):
                k, n, rows = unpack_sorted(keys.as_py()), unpack(counts.as_py(), np.int32), []
                for s, at in _split(upper.trees(k), shards):
                    rows.append((0, s, block.as_py(), part.as_py(), len(at), pack_sorted(k[at]), pack(n[at], np.int32)))
                yield from _table(rows, FOUND).to_batches()

    return run


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The shard's distinct keys with their counts added up."""
    total = _Sum()
    for keys, counts in zip(table.column("keys"), table.column("counts"), strict=True):
        total.add(unpack_sorted(keys.as_py()), unpack(counts.as_py(), np.int32).astype(np.int64))
    return total.merge()


def _answers(table: pa.Table, kind: int, every: np.ndarray, values: np.ndarray, sort: type) -> Iterator[tuple]:
    """The values of each block's keys, in their order; the block knows them."""
    for shard, block, part, keys in zip(*(table.column(c) for c in ("shard", "block", "part", "keys")), strict=True):
        k = unpack_sorted(keys.as_py())
        yield kind, shard.as_py(), block.as_py(), part.as_py(), len(k), 0, pack(values[np.searchsorted(every, k)], sort), None


def _count_words(table: pa.Table) -> pa.Table:
    """The training count of each word goes back to the blocks, and the shard's sums to all."""
    every, counts = _gathered(table)
    rows = list(_answers(table, 1, every, counts, np.int64))
    rows.append((2, table.column("shard")[0].as_py(), None, None, int((counts > 0).sum()), int(counts.sum()), None, None))
    return _table(rows, ANSWER)


def _learn(upper: Upper):
    """What the contexts above the shards need of a shard's trees, which are in memory SLICE keys at a time."""

    def run(table: pa.Table) -> pa.Table:
        shard, parts = table.column("shard")[0].as_py(), []
        every, counts = _gathered(table)
        del table
        every, counts = every[counts > 0], counts[counts > 0]
        for d, at in upper.slices(every):
            parts.append(top_statistics(Forest(every[at], counts[at], upper.depth, d), upper))
        places, values = _summed(*map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64), np.zeros(0))
        return _table([(3, shard, None, None, len(places), 0, pack(places, np.int64), pack(values, np.float64))], ANSWER)

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unpack(data, np.int64)), pa.array(unpack(more, np.float64))], ["place", "value"])


def _predict(upper: Upper, statistics: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        every, counts = _gathered(table)
        top, value = Top(upper, statistics), np.zeros(len(every), np.float32)
        for d, at in upper.slices(every):
            keys, n = every[at], counts[at]
            value[at] = top.log10(Forest(keys[n > 0], n[n > 0], upper.depth, d), keys)
        return _table(list(_answers(table, 0, every, value, np.float32)), ANSWER)

    return run


SCORED = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _answered(answers: pa.Table, kind: int, by: np.ndarray, shards: int, sort: type) -> np.ndarray:
    """The values of the block's sorted keys, of which `by` decides the shards: each shard's come in order, part by part."""
    parts: dict[int, list[tuple[int, np.ndarray]]] = {}
    for what, shard, part, data in zip(*(answers.column(c) for c in ("kind", "shard", "part", "data")), strict=True):
        if what.as_py() == kind:
            parts.setdefault(shard.as_py(), []).append((part.as_py(), unpack(data.as_py(), sort)))
    out = np.empty(len(by), sort)
    for s, at in _split(by, shards):
        out[at] = np.concatenate([v for _, v in sorted(parts[s], key=lambda x: x[0])])
    return out


def _heads(s: np.ndarray) -> np.ndarray:
    """Distinct values of a sorted array."""
    return s[np.append(True, s[1:] != s[:-1])[: len(s)]]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the place of each key among them."""
    order = np.argsort(keys)
    s = keys[order]
    head = np.append(True, s[1:] != s[:-1])[: len(s)]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(head, dtype=np.int32) - 1
    return s[head], place


def _score(upper: Upper, shards: int, documents: int, tokens: int, distinct: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        for piece, hashes, n_words, keys, begin, _ in _block(docs, upper.depth):
            parts.append((piece.select(["doc_id", "held_out"]), n_words, begin, *_ranked(hashes), *_ranked(keys)))
        words, grams = (_heads(np.sort(np.concatenate([np.zeros(0, _U), *(p[i] for p in parts)]))) for i in (3, 5))
        count = _answered(answers, 1, words, shards, np.int64)
        value = _answered(answers, 0, upper.trees(grams), shards, np.float32)
        # base: log10((c + 1) / (N + (V + 1))); the end of a text is a token too
        known = np.log10(count + 1.0) - np.log10(tokens + distinct + 1.0)
        end = np.log10(documents + 1.0) - np.log10(tokens + distinct + 1.0)
        out = []
        for piece, n_words, begin, own_words, word, own_grams, gram in parts:
            n = piece.num_rows
            doc = np.repeat(np.arange(n), n_words)
            c = np.searchsorted(words, own_words)[word]
            base = np.bincount(doc, known[c], n) + end
            seen = np.bincount(doc, count[c] > 0, n).astype(np.int64) + (documents > 0)
            score = np.add.reduceat(value[np.searchsorted(grams, own_grams)].astype(np.float64)[gram], begin)
            out.append(pa.table({"doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "n_tokens": pa.array(n_words.astype(np.int64) + 1), "n_known": pa.array(seen), "train_tokens": pa.array(np.full(n, tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score)}))
        return pa.concat_tables(out)

    return run


def ctw_scores(docs: DataFrame, held_out: str, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    held_out: an SQL condition on doc_id; the model learns from all rows for which it does not hold (or is null). A text is the
    bytes of its A-Z lower-cased words, one space between, and an end; each byte's eight bits are
    predicted one by one in the contexts of the 0 to `depth` bytes before. Every context's node for the bits
    so far has a Krichevsky-Trofimov estimate from all training rows; the estimates of all depths that
    have been seen are mixed by the context-tree weights. score is the log10 probability of the text, so that
    -score / log10(2) / bytes is the code length per byte. base_score is that of single words with
    one added to each count. Word counts are exact but for collisions of 64-bit hashes; a byte's
    probability travels as float32. A null text is empty (one token, its end); repeated rows count
    and are scored each time, an empty table gives no rows. Counts are summed in blocks before they are dealt to shards by the two
    nearest bytes, or more where those are heavy (HEAVY_KEYS, HEAVY_SHARE); the driver gets the WIDTH numbers of each context
    above the shards: 257, and heavy ones, of which each depth has fewer than HEAVY_SHARE.
    """
    spark = docs.sparkSession
    place = workspace(spark, "ctw")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    about = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.count_if(~F.col("held_out")).alias("train")).first()
    blocks = max(1, -(-(about.n or 0) // BLOCK_BYTES))
    # a block has a distinct key for every ten bytes or so, and all blocks together for every forty
    shards = max(1, -(-(about.n or 0) // (16 * SHARD_KEYS)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    found = stored(rows.groupBy("block").applyInArrow(_count(shards, depth), FOUND), f"{place}/found", SOME)
    grams, heavy = found.filter("kind = 0"), {}
    total = grams.agg(F.sum("n")).first()[0] or 0
    sizes = found.filter("kind = 4").select("shard", "keys", "counts").mapInArrow(_heavy, "d int, context long, n long").groupBy("d", "context").agg(F.sum("n").alias("n"))
    sizes = stored(sizes, f"{place}/heavy", AT_ONCE)
    for r in sizes.filter(F.col("n") > max(HEAVY_KEYS, total // HEAVY_SHARE)).collect():  # fewer than HEAVY_SHARE of each depth
        heavy.setdefault(r.d, []).append(r.context)
    upper = Upper(depth, {d: np.array(c, np.int64).view(_U) for d, c in heavy.items()})
    dealt = stored(grams.select("block", "part", "keys", "counts").mapInArrow(_dealt(shards, upper), FOUND), f"{place}/dealt", AT_ONCE)
    counted = stored(found.filter("kind = 1").groupBy("shard").applyInArrow(_count_words, ANSWER), f"{place}/words", SOME)
    remove(spark, f"{place}/found")
    words = counted.filter("kind = 2").agg(F.sum("n").alias("distinct"), F.sum("total").alias("tokens")).first()
    documents = about.train or 0
    tokens, distinct = (words.tokens or 0) + documents, (words.distinct or 0) + (documents > 0)
    learned = stored(dealt.groupBy("shard").applyInArrow(_learn(upper), ANSWER), f"{place}/learned", SOME)
    statistics = np.zeros(upper.size)
    sums = learned.select("data", "more").mapInArrow(_spread, "place long, value double").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,6)")).cast("double").alias("value"))
    for r in stored(sums, f"{place}/sums", AT_ONCE).toLocalIterator():  # upper.size rows at most
        statistics[r.place] = r.value
    predicted = stored(dealt.groupBy("shard").applyInArrow(_predict(upper, statistics), ANSWER), f"{place}/predicted", SOME)
    for name in ("dealt", "learned", "sums", "heavy"):
        remove(spark, f"{place}/{name}")
    answers = counted.filter("kind = 1").union(predicted).select("kind", "block", "shard", "part", "data")
    kind = dict(docs.dtypes)["doc_id"]
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(upper, shards, documents, tokens, distinct), SCORED.format(kind))
    out = stored(scored, f"{place}/scored", SOME)
    for name in ("words", "predicted"):
        remove(spark, f"{place}/{name}")
    return out
