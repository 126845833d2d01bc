"""Ranked lexical search over inverted treaps (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remembra.llm._bytes import PIECE, Texts, pieces, raw
from remembra.llm._store import remove, stored, workspace

#: Bytes that part terms: all of ASCII but digits and letters.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False

#: Most documents of an index block, and bytes of text after which a block ends.
BLOCK_DOCS, BLOCK_BYTES = 4096, 4 << 20
#: Terms of the items that are searched at once.
ITEM_TERMS = 8192
#: Subtrees of an item that the first round opens; each round opens twice as many as the one before.
OPEN = 8
#: Terms of all items, 20 bytes each, up to which they are broadcast.
BROADCAST_TERMS = 1 << 18
#: Slots of document blocks that a block of items is sent to, at most.
SLOTS = 1 << 14

_GATHERED = "tid long, items binary, sizes binary, wanted binary, weights binary"


def _cuts(data: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """data[a:b] in runs of about PIECE bytes that end where terms are parted."""
    while b - a > PIECE:
        to = a + PIECE
        while to < b:
            apart = np.flatnonzero(APART[data[to : min(b, to + PIECE)]])
            if len(apart):
                to += int(apart[0])
                break
            to = min(b, to + PIECE)
        yield a, to
        a = to
    if a < b:
        yield a, b


def occurrences(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term of the texts, A-Z lower-cased, and the place of its text; null texts have none. A very long text is read in runs."""
    data, offsets = raw(column)
    hashes, places = [], []
    k, n = 0, len(offsets) - 1
    while k < n:
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE, "right")) - 1)
        runs = _cuts(data, int(offsets[k]), int(offsets[to])) if to == k + 1 else [(None, None)]
        for a, b in runs:
            t = Texts(data, offsets[k : to + 1]) if a is None else Texts(data, np.array([a, b]))
            t.lower()
            starts, ends, count = t.words(APART)
            hashes.append(t.hashes(starts, ends))
            places.append(np.repeat(np.arange(k, k + len(count)), count))
        k = to
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _postings(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by term, then by text: term, text and number of occurrences."""
    order = np.argsort(hashes, kind="stable")  # texts are in order already
    h, p = hashes[order], places[order]
    head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (p[1:] != p[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[head], p[head], np.diff(np.append(head, len(h)))


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.RecordBatch] = []
    docs = size = 0

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting)
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
        h, p = occurrences(table.column("__text"))
        lens = np.bincount(p, minlength=len(table)).astype(np.int64)
        h, p, tf = _postings(h, p)
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        ids = table.column("doc_id").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [one(ids), pa.array([lens.tobytes()]), pa.array([int((lens > 0).sum())]), pa.array([int(lens.sum())]), one(pa.array(h[first].view(np.int64))), one(pa.array(np.diff(np.append(first, len(h))).astype(np.int32))), pa.array([p.astype(np.uint16).tobytes()]), pa.array([tf.astype(np.uint32).tobytes()])]
        return pa.RecordBatch.from_arrays(columns, ["ids", "lens", "n_docs", "n_terms", "terms", "dfs", "docs", "tfs"])

    for batch in batches:
        for piece in pieces(batch, "__text", BLOCK_BYTES // 4):
            for k in range(0, len(piece), BLOCK_DOCS // 4):
                part = piece.slice(k, BLOCK_DOCS // 4)
                offsets = raw(part.column(1))[1]
                if waiting and (docs + len(part) > BLOCK_DOCS or size + offsets[-1] - offsets[0] > BLOCK_BYTES):
                    yield block()
                    waiting, docs, size = [], 0, 0
                waiting.append(part)
                docs, size = docs + len(part), size + int(offsets[-1] - offsets[0])
    if waiting:
        yield block()


def build_index(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """An inverted index of docs, written at path: a row for each block of documents, sorted by doc_id within the block.

    A block has its documents' ids and numbers of terms, its terms, and of each term the documents with it and how often they have it. Numbers that
    depend on the corpus as a whole (weights, impacts) are made when it is searched, so blocks of several builds can be searched together.
    """
    kind = docs.select(doc_id).dtypes[0][1]
    schema = f"ids array<{kind}>, lens binary, n_docs long, n_terms long, terms array<long>, dfs array<int>, docs binary, tfs binary"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).mapInArrow(_index_rows, schema)
    return stored(rows.withColumn("block", F.monotonically_increasing_id()), path)


def greater(key: np.ndarray, begin: np.ndarray, strict: bool) -> np.ndarray:
    """For each entry the nearest one before it, in its own list (which starts at begin), whose key is larger, or, if not strict, as large; -1 for none.

    All entries step at once from one to the one that this has found so far, so that runs are crossed in doubling steps.
    """
    found = np.arange(-1, len(key) - 1)
    found[found < begin] = -1
    active = np.flatnonzero(found >= 0)
    while len(active):
        at = found[active]
        ok = key[at] > key[active] if strict else key[at] >= key[active]
        active = active[~ok]
        found[active] = found[found[active]]
        active = active[found[active] >= 0]
    return found


def treaps(impact: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, roots) of one treap for each list of postings, lists of these sizes one after another: search order by place (documents
    ascending), heap order by impact; equal impacts are ordered by a fixed pseudorandom number, which keeps the trees shallow."""
    n = len(impact)
    key = (impact << 16) | ((np.arange(n, dtype=np.int64) * 40503 + 12345) * 2654435761 >> 13 & 0xFFFF)
    ends = np.cumsum(sizes)
    begin = np.repeat(ends - sizes, sizes)
    before = greater(key, begin, False)
    back = greater(key[::-1], np.repeat(n - ends[::-1], sizes[::-1]), True)[::-1]
    after = np.where(back >= 0, n - 1 - back, -1)
    left, right = np.full(n, -1), np.full(n, -1)
    # the parent is the smaller of the nearest larger ones on both sides
    by_left = (before >= 0) & ((after < 0) | (key[before] < key[after]))
    by_right = (after >= 0) & ~by_left
    i = np.arange(n)
    right[before[by_left]] = i[by_left]
    left[after[by_right]] = i[by_right]
    roots = i[(before < 0) & (after < 0)]
    return left, right, roots


def _heads(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, group[1:] != group[:-1]))


def _best_of(item: np.ndarray, score: np.ndarray, k: int, n: int) -> np.ndarray:
    """(n, k): of each item its k highest scores, descending, -1 beyond."""
    out = np.full((n, k), -1, np.int64)
    if len(item):
        order = np.lexsort((-score, item))
        i, s = item[order], score[order]
        at = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        place = np.arange(len(i)) - np.repeat(at, np.diff(np.append(at, len(i))))
        near = place < k
        out[i[near], place[near]] = s[near]
    return out


def _within(node: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """From each node on downwards, the highest one with a document from begin to end; -1 for none."""
    out = node.copy()
    move = np.arange(len(out))
    while len(move):
        d = doc[out[move]]
        late, early = d >= end[move], d < begin[move]
        out[move[late]] = left[out[move[late]]]
        out[move[early]] = right[out[move[early]]]
        move = move[late | early]
        move = move[out[move] >= 0]
    return out


def search_block(doc: np.ndarray, impact: np.ndarray, sizes: np.ndarray, n_docs: int, item: np.ndarray, term: np.ndarray, weight: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of all documents that may be among an item's k best; more may come, and each one's score is exact.

    doc, impact: lists of postings of the given sizes, one for each term; item, term, weight: the items' terms, sorted by item; floor: (items, k) scores that
    earlier blocks gave, descending, -1 beyond. Each item walks the treaps of its terms together: a state is a range of documents with the
    treaps' highest nodes in it, and its bound is the sum of their weighted impacts. The document of the node that gives most is scored, and the range is
    split there. A range whose bound is below the k-th score so far is not opened.
    """
    left, right, roots = treaps(impact, sizes)
    list_of = np.repeat(np.arange(len(sizes)), sizes)
    address = list_of * n_docs + doc  # ascending
    top = floor.copy()
    items, docs, scored = [], [], []
    # ranges: their items, documents from begins to ends, and bounds; parts: the range, node and weight of each treap in a range
    heads = _heads(item)
    r_item, p_range, p_node, p_weight = item[heads], np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(item)))), roots[term], weight
    begins, ends = np.zeros(len(heads), np.int64), np.full(len(heads), n_docs)
    bound = np.add.reduceat(p_weight * impact[p_node], heads)
    opened = OPEN
    while len(r_item):
        alive = bound >= np.maximum(top[r_item, k - 1], 1)
        order = np.lexsort((-bound, r_item, ~alive))[: int(alive.sum())]
        if not len(order):
            break
        starts = _heads(r_item[order])
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        state = np.zeros(len(r_item), np.int8)  # 0: closed for good, 1: waits, 2: is opened
        state[order] = np.where(place < opened, 2, 1)
        opened *= 2
        of_part = state[p_range]
        now, wait = of_part == 2, of_part == 1
        number = np.cumsum(state == 2) - 1
        own, node, w = number[p_range[now]], p_node[now], p_weight[now]
        mine = r_item[state == 2]
        gain = w * impact[node]
        first = _heads(own)
        most = np.maximum.reduceat(gain, first)
        is_most = np.flatnonzero(gain == most[own])
        pivot = doc[node[is_most[_heads(own[is_most])]]]
        there = pivot[own]
        # the pivot's score: its posting in each of the lists, if there is one
        want = list_of[node] * n_docs + there
        at = np.searchsorted(address, want)
        at[at == len(address)] = 0
        score = np.add.reduceat(np.where(address[at] == want, w * impact[at], 0), first)
        items.append(mine)
        docs.append(pivot)
        scored.append(score)
        top = -np.sort(-np.concatenate([top, _best_of(mine, score, k, len(top))], axis=1), axis=1)[:, :k]
        # both sides of the pivot: the highest node of each treap there
        r_from, r_to = begins[state == 2], ends[state == 2]
        low, high = _within(node, doc, left, right, r_from[own], there), _within(node, doc, left, right, there + 1, r_to[own])
        rest = np.cumsum(state == 1) - 1
        n_rest = int((state == 1).sum())
        is_low, is_high = low >= 0, high >= 0
        parts = [(rest[p_range[wait]], p_node[wait], p_weight[wait]), (n_rest + own[is_low], low[is_low], w[is_low]), (n_rest + len(mine) + own[is_high], high[is_high], w[is_high])]
        p_range, p_node, p_weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        r_item = np.concatenate([r_item[state == 1], mine, mine])
        begins, ends = np.concatenate([begins[state == 1], r_from, pivot + 1]), np.concatenate([ends[state == 1], pivot, r_to])
        if not len(p_range):
            break
        # number those ranges that have parts anew
        heads = _heads(p_range)
        r_item, begins, ends = (x[p_range[heads]] for x in (r_item, begins, ends))
        p_range = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(p_range))))
        bound = np.add.reduceat(p_weight * impact[p_node], heads)
    if not items:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return np.concatenate(items), np.concatenate(docs), np.concatenate(scored)


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count is worth in a document of so many terms, in whole numbers; of any size on the way."""
    if len(length) and 25 * int(length.max()) * n_docs >= 1 << 63:
        m = np.array([75 + 25 * x * n_docs // n_terms for x in length.tolist()], np.int64)
    else:
        m = 75 + 25 * length * n_docs // max(1, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., begin[1], ...: so many of each."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _search(k: int, n_docs: int, n_terms: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}

        def out() -> pa.RecordBatch:
            rows = [(i, x[2], -x[0]) for i, found in best.items() for x in found]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])

        for batch in batches:
            for j in range(batch.num_rows):
                x = {c: batch.column(c)[j] for c in batch.schema.names}
                number = {c: np.frombuffer(x[c].as_buffer(), t) for c, t in (("lens", np.int64), ("docs", np.uint16), ("tfs", np.uint32), ("items", np.int64), ("sizes", np.int32), ("wanted", np.uint64), ("weights", np.int64))}
                ids, lens = x["ids"].values, number["lens"]
                terms, dfs = (x[c].values.to_numpy() for c in ("terms", "dfs"))
                terms = terms.view(np.uint64)
                item = np.repeat(np.arange(len(number["items"])), number["sizes"])
                at = np.searchsorted(terms, number["wanted"])
                at[at == len(terms)] = 0
                here = np.flatnonzero(terms[at] == number["wanted"]) if len(terms) else np.zeros(0, np.int64)
                if not len(here):
                    continue
                used, term = np.unique(at[here], return_inverse=True)
                sizes = dfs[used].astype(np.int64)
                which = _spread((np.cumsum(dfs, dtype=np.int64) - dfs)[used], sizes)
                doc, tf = number["docs"][which].astype(np.int64), number["tfs"][which].astype(np.int64)
                floor = np.full((len(number["items"]), k), -1, np.int64)
                for i, key in enumerate(number["items"].tolist()):
                    found = best.get(key, ())
                    floor[i, : len(found)] = [-e[0] for e in found]
                i, d, s = search_block(doc, impacts(tf, lens[doc], n_docs, n_terms), sizes, len(lens), item[here], term, number["weights"][here], floor, k)
                # the k best of this block: score descending, document ascending
                keep = s > 0
                order = np.lexsort((d[keep], -s[keep], i[keep]))
                i, d, s = i[keep][order], d[keep][order], s[keep][order]
                if not len(i):
                    continue
                heads = _heads(i)
                for a, b in zip(heads, np.append(heads[1:], len(i)), strict=True):
                    key = int(number["items"][i[a]])
                    names = ids.take(pa.array(d[a : min(b, a + k)])).to_pylist()
                    new = [(-int(v), n is None, n) for v, n in zip(s[a:b], names)]
                    best[key] = _first(best.get(key, []) + new, k)
            if len(best) > 1 << 15:
                yield out()
        yield out()

    return run


def _first(entries: list[tuple], k: int) -> list[tuple]:
    """The first k: score descending, id ascending, null ids last."""
    some = sorted(e for e in entries if not e[1])
    return sorted(some + [e for e in entries if e[1]], key=lambda e: (e[0], e[1]))[:k]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "__text"):
            h, p, n = _postings(*occurrences(piece.column(1)))
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(p)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["item", "term", "times"])


def _gather(table: pa.Table) -> pa.Table:
    item = table.column("item").to_numpy()
    order = np.lexsort((table.column("term").to_numpy(), item))
    items, sizes = np.unique(item, return_counts=True)
    column = lambda c: table.column(c).to_numpy()[order].astype(np.int64).tobytes()
    row = [table.column("tid")[0].as_py(), items.astype(np.int64).tobytes(), sizes.astype(np.int32).tobytes(), column("term"), column("weight")]
    return pa.table([[x] for x in row], schema=pa.schema([("tid", pa.int64()), ("items", pa.binary()), ("sizes", pa.binary()), ("wanted", pa.binary()), ("weights", pa.binary())]))


def search(index: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of an index that score highest for each item, those with score 0 left out.

    A term is a run of digits, ASCII letters and characters beyond ASCII, A-Z lower-cased. With N documents that have a term, L terms in all, df documents
    with a term and n terms in a document, a term weighs floor(1000 ln((2N + 2) / (2 df + 1))), a document has m = 75 + 25 n N div L, and its score is
    the sum over the item's terms, repeats included, of weight * (10^9 tf div (1000 tf + 12 m)). Equal scores are ordered by doc_id, null ids last.

    Items are cut into blocks; each meets each block of documents in a row of a join. There a treap of impacts is made for each term that is asked for, and
    search_block walks them; a task carries each item's k best from block to block. Terms are told by 64-bit hashes.

    Items equal in id and text are asked once, items that share an id each by itself; an item without terms, or a null text, gives no rows. Documents with a null
    text count as without terms; each row is a document of its own, whatever its id. Other columns are not read. An empty index gives no rows.
    """
    spark = index.sparkSession
    place = workspace(spark, "search")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("__text")).filter("__text is not null").distinct()
    asked = asked.withColumn("item", F.xxhash64("item_id", "__text"))
    terms = stored(asked.select("item", "__text").mapInArrow(_item_terms, "item long, term long, times long"), f"{place}/terms")
    n_asked = terms.count()
    blocks = max(1, -(-n_asked // ITEM_TERMS))
    found = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    df = found.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = terms.join(df, "term").select("item", "term", (weight * F.col("times")).alias("weight")).filter("weight > 0")
    gathered = weighed.withColumn("tid", F.pmod("item", F.lit(blocks))).groupBy("tid").applyInArrow(_gather, _GATHERED)
    gathered = stored(gathered, f"{place}/items")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    blocked = index.withColumn("tid", every(F.lit(blocks)))
    if n_asked <= BROADCAST_TERMS:
        cells = blocked.join(F.broadcast(gathered), "tid")
    else:  # a block of items meets a slot's blocks of documents in a shuffle
        slots = F.lit(max(1, min(SLOTS, index.count())))
        cells = blocked.withColumn("slot", F.pmod("block", slots).cast("long")).join(gathered.withColumn("slot", every(slots)).hint("merge"), ["tid", "slot"])
    cells = cells.select("ids", "lens", "terms", "dfs", "docs", "tfs", "items", "sizes", "wanted", "weights")
    kind = dict(index.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    arrow = spark.createDataFrame([], f"x {kind}").toArrow().schema.field("x").type
    rows = stored(cells.mapInArrow(_search(k, n_docs, n_terms, arrow), f"item long, doc_id {kind}, score long"), f"{place}/found", 8)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = stored(rows.withColumn("rank", rank).filter(F.col("rank") <= k), workspace(spark, "search-result"))
    out = best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
    remove(spark, place)
    return out
