"""Mixing sources to target weights (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.dataset import dataset
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from remembra.llm._bytes import Texts, pieces
from remembra.llm._graph import join_hot
from remembra.llm._store import file_system, quoted, remove, stored, workspace

#: Words of a block, slots of an output shard on average, most takes of a text, and the weights that sources get in turn.
BLOCK, SHARD, REPEATS, WEIGHTS = 128, 4096, 3, (1, 2, 3)
#: Rows of a source whose places are numbered by one task, on average, and output shards that are drawn by one.
CHUNK, SHARDS_AT_ONCE = 8192, 16
#: Populations from which numpy draws without replacement are smaller than this.
EXACT = 10**9

_U = np.uint64


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text; none in a null."""
    return Texts.of(column).words()[2].astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "__text"):
            yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(word_counts(piece.column(3)))], ["doc_id", "source", "row", "size"])


def targets(sizes: list[int], weights: list[float], repeats: float = REPEATS) -> list[float]:
    """The sum of sizes shared by weight; no share exceeds `repeats` times its size, the excess is shared again by weight.

    Shares are the smaller of weight * level and repeats * size at one level, found with the sources in the order in which they fill up.
    """
    most, weight = [repeats * n for n in sizes], np.array(weights, float)
    order = sorted(range(len(sizes)), key=lambda i: most[i] / weights[i])
    left, open_ = float(sum(sizes)), float(weight.sum())
    level = 0.0
    for i in order:
        level = left / open_
        if weights[i] * level <= most[i]:
            break
        left -= most[i]
        open_ -= weights[i]
    else:
        level = float("inf")
    return [float(min(m, w * level)) if m else 0.0 for m, w in zip(most, weights, strict=True)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of range(n), told by key, takes each index: a Feistel network, walked until it lands below n."""
    half = np.maximum(1, (np.frexp(np.maximum(n - 1, 1).astype(np.float64))[1] + 1) // 2).astype(_U)
    low = (_U(1) << half) - _U(1)
    key, x, todo = key.astype(_U), index.astype(_U), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        a, b = x[todo] >> h, x[todo] & m
        for r in range(4):
            f = _mixed(b + _mixed(k + _U((r + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))))
            a, b = b, a ^ ((f >> _U(20)) & m)
        x[todo] = (a << h) | b
        todo = todo[x[todo] >= n[todo].astype(_U)]
    return x.astype(np.int64)


def without_replacement(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn of good + bad are good.

    From EXACT on, where numpy has no such draw: binomial if the smaller of what is drawn and what counts is so small that no draw is
    likely to meet another, else a rounded normal draw of the same mean and variance.
    """
    total = good + bad
    if total < EXACT:
        return int(rng.hypergeometric(good, bad, n))
    few, many = sorted((min(good, bad), min(n, total - n)))
    if few * few < total:
        x = int(rng.binomial(few, many / total))
    else:
        share = many / total
        x = round(few * share + (few * share * (1 - share) * (total - few) / (total - 1)) ** 0.5 * rng.standard_normal())
    x = min(max(x, 0), few)
    # x counts the rarer kind within the smaller of the two parts
    x = x if good <= bad else min(n, total - n) - x
    x = x if n <= total - n else good - x
    return min(max(x, n - bad, 0), good, n)


def several_without_replacement(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among n drawn of all: multivariate hypergeometric."""
    left = int(counts.sum())
    if left < EXACT:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out = np.zeros(len(counts), np.int64)
    for i, c in enumerate(counts.tolist()):
        out[i] = without_replacement(rng, c, left - c, n)
        left, n = left - c, n - int(out[i])
    return out


class Draw:
    """The draw of each output shard's source counts: multinomial, given each source's total and the shards' equal sizes.

    Of `slots` of a source with `blocks` blocks, those that fill whole epochs (every block once) are dealt to the shards in order of
    index; a shard gets as many as it draws. Of the last epoch's indices, each shard owns an equal range; it takes the first
    of them, as many as it draws. Shards are halved again and again, and their slots with them: of a source's last epoch a half gets what a
    draw without replacement from all indices has in its range, and of the whole epochs of all sources as many, drawn
    without replacement, as make its size up. Where whole epochs cannot, slots of last epochs that have room in the other half's range
    change sides; where these cannot either (all ranges full), shards differ by that rounding. Each draw's seed is the halves'
    place, so that any task can draw any shard's counts by itself.
    """

    def __init__(self, blocks: np.ndarray, slots: np.ndarray, shards: int, seed: int):
        self.blocks, self.shards, self.seed = blocks.astype(np.int64), shards, seed
        self.epochs = slots // np.maximum(blocks, 1)
        self.rest = slots - self.epochs * blocks

    def _edge(self, shard: int) -> np.ndarray:
        """Where the shard's range of the last epoch's indices starts."""
        q, r = np.divmod(self.blocks, self.shards)
        return q * shard + (r * shard) // self.shards

    def counts(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard of first:last its number, where its whole-epoch indices start and how many there are, and the same of the last epoch."""

        def halves(a: int, b: int, start: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> Iterator:
            if b <= first or a >= last:
                return
            if b - a == 1:
                yield a, start, whole, self._edge(a), rest
                return
            m = (a + b) // 2
            rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([self.seed, a, b])))
            mid = self._edge(m)
            room, other = mid - self._edge(a), self._edge(b) - mid
            if (room + other < EXACT).all():
                part = rng.hypergeometric(room, other, rest)
            else:
                part = np.array([without_replacement(rng, *x) for x in zip(room.tolist(), other.tolist(), rest.tolist(), strict=True)], np.int64)
            size, dealt = (int(whole.sum()) + int(rest.sum())) * (m - a) // (b - a), int(whole.sum())
            over, under = int(part.sum()) - size, size - int(part.sum()) - dealt
            if over > 0:
                some = np.minimum(part, other - (rest - part))
                part = part - several_without_replacement(rng, some, min(over, int(some.sum())))
            elif under > 0:
                some = np.minimum(rest - part, room - part)
                part = part + several_without_replacement(rng, some, min(under, int(some.sum())))
            mine = several_without_replacement(rng, whole, min(max(size - int(part.sum()), 0), dealt))
            yield from halves(a, m, start, mine, part)
            yield from halves(m, b, start + mine, whole - mine, rest - part)

        zero = np.zeros(len(self.blocks), np.int64)
        yield from halves(0, self.shards, zero, self.epochs * self.blocks, self.rest)

    def slots(self, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each shard of first:last: the source and the block of each of its slots, by the permutations of `seed`, in random order."""
        seed = _U(seed * 0xD1342543DE82EF95 & (2**64 - 1))
        for shard, start, whole, edge, rest in self.counts(first, last):
            n = np.stack([whole, rest], 1).ravel()
            at = np.stack([start, self.epochs * self.blocks + edge], 1).ravel()
            source = np.repeat(np.repeat(np.arange(len(self.blocks)), 2), n)
            j = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
            epoch, index = np.divmod(j, self.blocks[source])
            key = _mixed(_mixed(source.astype(_U) + seed) + epoch.astype(_U))
            order = np.random.Generator(np.random.Philox(np.random.SeedSequence([self.seed, shard]))).permutation(len(source))
            yield shard, source[order], permuted(index, self.blocks[source], key)[order]


def _goals(block: int, repeats: int, weights: tuple[float, ...], kind: pa.DataType):
    """Number, target, blocks and slots of each source, in code point order, null last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (r[0] is None, r[0]))
        sizes = [r[1] for r in rows]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], repeats) if rows else []
        blocks = [-(-n // block) for n in sizes]
        slots = [round(t * b / n) if n else 0 for t, b, n in zip(goal, blocks, sizes, strict=True)]
        columns = [pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], kind), pa.array(sizes, pa.int64()), pa.array(goal, pa.float64()), pa.array(blocks, pa.int64()), pa.array(slots, pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["s", "source", "source_size", "target", "blocks", "slots", "__count"])

    return run


def _draw(sources: str, shards: int, seed: int, draw_seed: int):
    """The slots of ranges of output shards; the sources are read from where they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = None
        for batch in batches:
            for at in batch.column(0).to_pylist():
                if draw is None:
                    fs, path = file_system(sources)
                    table = dataset(path, filesystem=fs, format="parquet").to_table(["s", "blocks", "slots"]).sort_by("s")
                    draw = Draw(table.column("blocks").to_numpy(), table.column("slots").to_numpy(), shards, draw_seed)
                for shard, source, block in draw.slots(at * SHARDS_AT_ONCE, min(shards, (at + 1) * SHARDS_AT_ONCE), seed):
                    yield pa.RecordBatch.from_arrays([pa.array(source.astype(np.int32)), pa.array(np.full(len(source), shard, np.int64)), pa.array(np.arange(len(source))), pa.array(block)], ["s", "shard", "slot", "block"])

    return run


class Mix:
    """A mix of docs (doc_id, source, text). Attributes, all lazy DataFrames over written tables:

    sources (s, source, source_size, target, blocks, slots, __count): one row per source, in code point order, null last;
    rows (doc_id, source, row, s, size, start): each row of docs, the hash of its text, and where it starts among its source's words;
    slots (s, shard, slot, block): the output, each slot of a shard a block of `block` words of its source.

    A source's words, in an order fixed by doc_id, are cut into blocks; its target needs so many slots. Each
    output shard draws how many slots of each source it holds, given the sources' totals, and maps them through one
    permutation of the source's blocks after another, so that no block comes more often than `repeats` times; see Draw. All follows from
    the rows, the seed (of the permutations) and the seed of the draw. Null and empty texts have no words and
    are never taken; repeated rows are rows of their own; an empty table makes an empty mix. The sources, one row each, are numbered by one task
    and read by those that draw; the driver gets two sums.
    """

    def __init__(self, docs: DataFrame, block: int = BLOCK, repeats: int = REPEATS, weights: tuple[float, ...] = WEIGHTS, seed: int = 7, draw_seed: int = 7):
        spark = docs.sparkSession
        self.spark, self.place, self.block = spark, workspace(spark, "mixing"), block
        kinds = dict(docs.select("doc_id", "source").dtypes)
        sized = docs.select("doc_id", "source", F.xxhash64("text").alias("row"), F.col("text").alias("__text")).mapInArrow(_sizes, f"doc_id {kinds['doc_id']}, source {kinds['source']}, row long, size long")
        sized = stored(sized, f"{self.place}/sizes")
        known = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        goals = known.repartition(1).mapInArrow(_goals(block, repeats, weights, to_arrow_type(sized.schema["source"].dataType)), f"s int, source {kinds['source']}, source_size long, target double, blocks long, slots long, __count long")
        self.sources = stored(goals, f"{self.place}/sources")
        slots, count = self.sources.agg(F.sum("slots"), F.sum("__count")).first()
        self.total = count or 0

        chunks = max(1, -(-self.total // CHUNK))
        named = self.sources.select("s", F.struct("source").alias("__source"), "__count")
        numbered = lambda rows: join_hot(rows.withColumn("__source", F.struct("source")), named, "__source", self.total)
        # equal rows are placed together; rows without words need no place
        groups = sized.filter("size > 0").groupBy("doc_id", "source", "row", "size").agg(F.count("*").alias("times"))
        groups = numbered(groups).withColumn("c", F.pmod(F.xxhash64("doc_id", "row"), F.lit(chunks))).withColumn("n", F.col("size") * F.col("times"))
        sums = groups.groupBy("s", "c").agg(F.sum("n").alias("m"))
        sums = sums.withColumn("base", F.sum("m").over(W.partitionBy("s").orderBy("c")) - F.col("m")).withColumnRenamed("s", "__s").withColumnRenamed("c", "__c").drop("m")
        inside = F.sum("n").over(W.partitionBy("s", "c").orderBy("doc_id", "row", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
        groups = groups.withColumn("inside", inside).join(sums, (F.col("s") == F.col("__s")) & (F.col("c") == F.col("__c")))
        groups = groups.select("doc_id", "source", "row", "s", "size", "times", (F.col("base") + F.col("inside")).alias("start"))
        # a row for each copy; more than a chunk of them are made by several tasks
        many = groups.filter(F.col("times") > CHUNK).withColumn("k", F.explode(F.expr(f"sequence(0L, (times - 1) div {CHUNK})")))
        many = many.repartition("s", "start", "k").withColumns({"start": F.col("start") + F.col("k") * CHUNK * F.col("size"), "times": F.least(F.col("times") - F.col("k") * CHUNK, F.lit(CHUNK))}).drop("k")
        copies = groups.filter(F.col("times") <= CHUNK).unionByName(many).withColumn("k", F.explode(F.expr("sequence(0L, times - 1)")))
        placed = copies.select("doc_id", "source", "row", "s", "size", (F.col("start") + F.col("k") * F.col("size")).alias("start"))
        empty = numbered(sized.filter("size = 0")).select("doc_id", "source", "row", "s", "size", F.lit(0).cast("long").alias("start"))
        self.rows = stored(placed.unionByName(empty), f"{self.place}/rows")
        remove(spark, f"{self.place}/sizes")

        shards = max(1, -(-(slots or 0) // SHARD))
        tasks = -(-shards // SHARDS_AT_ONCE)
        drawn = spark.range(0, tasks, 1, tasks).mapInArrow(_draw(f"{self.place}/sources", shards, seed, draw_seed), "s int, shard long, slot long, block long")
        self.slots = stored(drawn, f"{self.place}/slots")  # of a size that Spark knows: by its few ranges it would broadcast them

    def about(self, rows: DataFrame, *columns: str) -> DataFrame:
        """rows joined with columns of `sources` by s; a source of many rows is not shuffled."""
        return join_hot(rows, self.sources.select("s", *columns, "__count"), "s", self.total).drop("__count")

    def _pieces(self) -> DataFrame:
        """Each row of `rows` with words, once for each block that it reaches, and how many words it has there."""
        at = self.rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {self.block}, (start + size - 1) div {self.block})")))
        return at.withColumn("words", F.expr(f"least(start + size, (block + 1) * {self.block}) - greatest(start, block * {self.block})"))

    def taken(self) -> DataFrame:
        """(doc_id, source, row, s, size, taken) for each row: how many of its words the slots take, repeats counted."""
        times = self.slots.groupBy("s", "block").agg(F.count("*").alias("times"))
        words = self._pieces().join(times, ["s", "block"]).groupBy("s", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        some = self.rows.filter("size > 0").join(words, ["s", "start"], "left").select("doc_id", "source", "row", "s", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        return some.union(self.rows.filter("size = 0").select("doc_id", "source", "row", "s", "size", F.lit(0).cast("long")))

    def packed(self, docs: DataFrame) -> DataFrame:
        """(shard, slot, source, text): the words of every slot's block, one space between. docs: as given; equal rows are one text."""
        text = docs.select(F.struct(F.col("doc_id"), F.xxhash64("text")).alias("__id"), F.col("text").alias("__text")).dropDuplicates(["__id"])
        text = text.select("__id", F.expr(r"filter(split(__text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')").alias("all"))
        part = F.slice("all", (F.greatest("start", F.col("block") * self.block) - F.col("start") + 1).cast("int"), F.col("words").cast("int"))
        cut = self._pieces().withColumn("__id", F.struct(F.col("doc_id"), F.col("row"))).join(text, "__id").select("s", "block", "start", F.array_join(part, " ").alias("text"))
        whole = cut.groupBy("s", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), " ").alias("text"))
        return self.about(self.slots.join(whole, ["s", "block"]), "source").select("shard", "slot", "source", "text")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs; see Mix for nulls, empty texts and repeated rows."""
    mix = Mix(docs)
    taken = stored(mix.taken().drop("source"), f"{mix.place}/taken")
    out = stored(mix.about(taken, "source", "source_size", "target").select("doc_id", "source", "size", "source_size", "target", "taken"), workspace(mix.spark, "mixed"))
    remove(mix.spark, mix.place)
    return out


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns: whole documents, 0 to 3 times.

    A row comes by its taken words over its own, rounded so that the words of a source add up: the rows of a chunk of a source, by
    size, round the sum of the shares before them up or down, so that the chunk is off by no more than its longest row. Equal
    rows come equally often. Null and empty texts have no words and go; an empty table stays empty.
    """
    mix = Mix(docs)
    key = F.struct(F.col("doc_id"), F.col("source"), F.col("row"))
    chunks = max(1, -(-mix.total // CHUNK))
    groups = stored(mix.taken(), f"{mix.place}/taken").filter("size > 0").groupBy("s", "doc_id", "source", "row", "size").agg(F.sum("taken").alias("t"), F.count("*").alias("__count"))
    groups = groups.withColumn("c", F.pmod(F.xxhash64("doc_id", "row"), F.lit(chunks))).withColumn("n", F.col("size") * F.col("__count"))
    order = W.partitionBy("s", "c").orderBy("n", "doc_id", "row", "source")
    start = F.pmod(F.xxhash64("s", "c", F.lit("start")), F.lit(1 << 20)) / (1 << 20)
    groups = groups.withColumn("upto", F.sum(F.col("t") / F.col("n")).over(order.rowsBetween(W.unboundedPreceding, 0)) + start)
    copies = F.least(F.floor("upto") - F.floor(F.coalesce(F.lag("upto").over(order), start)), F.ceil(F.col("t") / F.col("n")))
    ids = groups.select(key.alias("__key"), copies.cast("int").alias("__copies"), "__count")
    ids = stored(ids.filter("__copies > 0"), workspace(mix.spark, "copies"))
    remove(mix.spark, mix.place)
    # nearly all rows are taken, so ids are as many as rows: they aren't broadcast while they are still small enough to be
    rows = join_hot(docs.withColumn("__key", F.struct(F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("row"))), ids, "__key", mix.total, hint="merge")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*map(quoted, docs.columns))
