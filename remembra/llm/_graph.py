"""Joins and components that stand hot keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remembra.llm._store import remove, stored, workspace

#: A key is hot if over 1 of so many rows has it; hence there are fewer hot keys than this.
HOT = 1000
#: Words of 64 bits of which those are broadcast that keys set.
WORDS = 1 << 17
#: Rows of a file of a round of components, more or less: small tables are not spread over as many tasks as the session has shuffle partitions.
FILE = 1 << 14


def join_hot(rows: DataFrame, groups: DataFrame, key: str, total: int, count: str = "__count", hint: str | None = None) -> DataFrame:
    """rows inner-joined with groups, which has one row for each key and in `count` how many rows have it.

    The fewer than HOT keys with over total / HOT rows are broadcast, so the rows of a hot key
    stay where they are; all others meet in a shuffle, where no key has more than total / HOT rows. hint: how these are joined, whatever their size.
    """
    hot = groups.filter(F.col(count) * HOT > total)
    cold = groups.filter(F.col(count) * HOT <= total)
    cold = cold.hint(hint) if hint else cold
    apart = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return apart.unionByName(rest)


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose `key` is one of those of keys, and few others; what follows is an exact join, whose shuffle takes only these.

    Of WORDS words of 64 bits, those that the keys set are broadcast: some megabytes, however many keys there are. Of other rows a share of up to
    (number of keys) / (64 * WORDS) comes along.
    """
    h = F.xxhash64(F.col(key), F.lit("bit"))
    word, bit = F.pmod(h, F.lit(WORDS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")
    set_ = keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    marked = rows.withColumns({"__at": word, "__bit": bit})
    return marked.join(F.broadcast(set_), (F.col("__at") == F.col("__word")) & (F.bit_get("__bits", F.col("__bit")) == 1), "left_semi").drop("__at", "__bit")


def stars(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (a, b), a > b, there are, and whether each of their components is a star: every node is the larger end of one edge, or the smaller end of some."""
    ends = edges.selectExpr("a as node", "1 as up", "0 as down").union(edges.selectExpr("b", "0", "1"))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, open_ = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.max(F.expr("up > 1 or (up = 1 and down = 1)")), F.lit(False))).first()
    return n, not open_


def components(edges: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """(node, root) for each node of edges (a, b): root is the smallest node of its component.

    Alternating stars: each round hangs every node's larger neighbours on its smallest one, then
    the smaller ones too; the number of rounds grows with the logarithm of the component's size, and there is none if all are stars.
    Every round is a written table, in files of some FILE rows. Also returns what removes those tables once the result is used.
    """
    spark = edges.sparkSession
    place = workspace(spark, "components")

    def put(df: DataFrame, most: int, name: str) -> DataFrame:
        return stored(df.coalesce(max(1, -(-most // FILE))), f"{place}/{name}")

    now = stored(edges.selectExpr("greatest(a, b) as a", "least(a, b) as b").filter("a <> b").distinct(), f"{place}/0")
    (count, done), k = stars(now), 0
    while not done:
        # a > b and no edge is there twice, so both has each edge once from either end
        both, most = now.selectExpr("a as u", "b as v").union(now.selectExpr("b", "a")), 2 * count
        least = put(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__count")).withColumn("m", F.least("m", "u")), most, f"{k}-least")
        # both and down have no more rows than this; m <= u < v, so a larger neighbour hangs on a smaller node
        down = put(join_hot(both, least, "u", most).filter("v > u").selectExpr("v as u", "m as v").distinct(), most, f"{k}-down")
        least = put(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__count")), most, f"{k}-least2")
        small = join_hot(down, least, "u", most).selectExpr("v as a", "m as b").union(least.select("u", "m")).filter("a <> b").distinct()
        k += 1
        before, now = now, put(small, most, f"{k}")
        for name in ("least", "down", "least2"):
            remove(spark, f"{place}/{k - 1}-{name}")
        remove(spark, f"{place}/{k - 1}")
        del before
        count, done = stars(now)
    out = now.selectExpr("a as node", "b as root")
    return out.union(out.selectExpr("root", "root").distinct()), lambda: remove(spark, place)
