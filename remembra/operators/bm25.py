"""Text relevance: tokens, postings and BM25, for many queries at once."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remembra.sources.log import Log
from remembra.sources.store import Store


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


#: Terms of a query up to which their counts are gathered and broadcast, and terms of all queries up to which these are broadcast.
FEW_TERMS, MOST_ASKED = 1000, 100_000


def tokens(text: Column) -> Column:
    """[a-z0-9]+ of the text with A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit("[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame, id_: str = "id", text: str = "content", wanted: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, dl): the inverted index, each row with its document's length; of the terms of `wanted` only, if given. A document's terms are
    counted where it is read, so no token is shuffled. Ids are distinct."""
    kind = dict(docs.dtypes)[id_]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = re.compile(rb"[a-z0-9]+")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                terms, tf, dl, of = [], [], [], []
                for row, content in enumerate(part.column(1).cast(pa.binary())):
                    found = Counter(m.group() for m in token.finditer((content.as_py() or b"").lower()))
                    terms += found
                    tf += found.values()
                    dl += [found.total()] * len(found)
                    of += [row] * len(found)
                columns = [pa.array(terms, pa.binary()).cast(pa.string()), part.column(0).take(pa.array(of, pa.int32())), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["term", "id", "tf", "dl"])

    each = docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(count, f"term string, id {kind}, tf long, dl long")
    return each if wanted is None else each.join(wanted, "term", "left_semi")


def lengths(docs: DataFrame, text: str = "content") -> tuple[int, int]:
    """Documents, and tokens of all."""
    found = docs.agg(F.count("*"), F.sum(F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).cast("long"))).first()
    return found[0], found[1] or 0


def scores(found: DataFrame, queries: DataFrame, n: int, total: int, params: Bm25 = Bm25(), few: bool = False) -> DataFrame:
    """(q, id, bm25) for postings `found` of the terms of queries (q, term), distinct; n documents have `total` tokens. few: the terms are those of
    a query or so, and their counts and they themselves go to every task; else the counts and queries are broadcast up to MOST_ASKED rows, and the postings
    are dealt by their document, whose score is then made where they meet.

    A term's documents are counted by an aggregation, so a common one is no single task's. Scores are rounded to nine decimals, so
    that the order of a sum's parts decides no tie.
    """
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    if few:
        spark = found.sparkSession
        df = F.broadcast(spark.createDataFrame(df.collect(), "term string, df long"))  # a row for each of the terms
        queries = F.broadcast(queries)
    elif _asked(queries):
        found, df, queries = found.repartition("id"), F.broadcast(df), F.broadcast(queries)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = params.k1 * (1 - params.b + params.b * F.col("dl") / F.lit(total / n if total else 1.0))
    part = idf * F.col("tf") * (params.k1 + 1) / (F.col("tf") + norm)
    return found.join(df, "term").join(queries, "term").groupBy("q", "id").agg(F.round(F.sum(part), 9).alias("bm25"))


def _asked(queries: DataFrame) -> bool:
    return queries.limit(MOST_ASKED + 1).count() <= MOST_ASKED


def _of(found: DataFrame, queries: DataFrame) -> DataFrame:
    """The postings of the queries' terms; by a broadcast, if they are not too many, as by a shuffle a common term would be one task's."""
    terms = queries.select("term").distinct()
    return found.join(F.broadcast(terms) if _asked(queries) else terms, "term", "left_semi")


def bm25(docs: DataFrame, queries: DataFrame, params: Bm25 = Bm25(), id_: str = "id", text: str = "content") -> DataFrame:
    """(q, id, bm25) for each document that has a term of query q, without an index: every text is read twice. queries: (q, term), distinct."""
    return scores(_of(postings(docs, id_, text), queries), queries, *lengths(docs, text), params)


class TextIndex:
    """Postings of documents in a folder, by a hash of the term, and how many documents and tokens there are in all: two parts of a log of versions, one
    for postings and one for lengths, so a change of both takes effect at once.

    A query reads the files of its terms' buckets, in which row groups without the terms are skipped. add() indexes more documents beside
    those that are there; remove() makes what has been added of some ids so far count no more; build() makes all of it anew beside what is there, which counts until then.
    """

    SCHEMA = "term string, id {}, tf long, dl long, bucket int"

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "string", buckets: int = 64, log: Log | None = None):
        self.spark, self.id_type, self.buckets = spark, id_type, buckets
        self.log = log or Log(spark, folder)
        self.postings = Store(spark, folder, log=self.log, part="postings", partition="bucket")
        self.lengths = Store(spark, folder, log=self.log, part="lengths", partition=None)

    def _totals(self) -> tuple[int, int]:
        """Documents and tokens."""
        facts = self.lengths.facts()
        return facts.get("n", 0), facts.get("total", 0)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _parts(self, docs: DataFrame, id_: str, text: str) -> tuple[DataFrame, DataFrame]:
        rows = postings(docs, id_, text).withColumn("bucket", self._bucket(F.col("term")))
        # a bucket's rows go to a few tasks, so that a common term is not one task's
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "term", "id")
        return dealt, docs.select(F.col(id_).alias("id"), F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).cast("long").alias("dl"))

    @staticmethod
    def _sums(lengths: DataFrame) -> dict[str, int]:
        n, total = lengths.agg(F.count("*"), F.sum("dl")).first()
        return {"n": n, "total": total or 0}

    def build(self, docs: DataFrame, id_: str = "id", text: str = "content") -> TextIndex:
        """docs are all that is indexed from now on."""
        rows, lengths = self._parts(docs, id_, text)
        with self.log.transaction():
            self.postings.write(rows)
            self.lengths.write(lengths, self._sums)
        return self

    def add(self, docs: DataFrame, id_: str = "id", text: str = "content") -> TextIndex:
        rows, lengths = self._parts(docs, id_, text)
        with self.log.transaction():
            self.postings.append(rows)
            self.lengths.append(lengths, self._sums)
        return self

    def remove(self, ids: DataFrame) -> TextIndex:
        """What has been added of ids (id) so far counts no more."""
        if self.lengths.exists():
            with self.log.transaction():
                gone = ids.select("id").distinct()
                lost = self._sums(self.lengths.read().join(gone, "id", "left_semi"))
                self.postings.delete(gone)
                self.lengths.delete(gone, {k: -v for k, v in lost.items()})
        return self

    def bm25(self, queries: DataFrame, terms: Sequence[str] | None = None, params: Bm25 = Bm25()) -> DataFrame:
        """(q, id, bm25) as the function bm25 gives it. queries: (q, term), distinct; terms: all their terms, if they are few."""
        rows = self.postings.read() if self.postings.exists() else self.spark.createDataFrame([], self.SCHEMA.format(self.id_type))
        if terms is None:
            found = _of(rows, queries)
        else:
            # constants, so that other buckets' files are not even listed
            found = rows.filter(F.col("bucket").isin([self._bucket(F.lit(t)) for t in terms]) & F.col("term").isin(list(terms)))
        n, total = self._totals()
        return scores(found.select("term", "id", "tf", "dl"), queries, n, total, params, terms is not None and len(terms) <= FEW_TERMS)


def normalised(scores: DataFrame, by: str = "q") -> DataFrame:
    """bm25 divided by the largest of its query's candidates; zero where all are."""
    most = F.max("bm25").over(W.partitionBy(by))
    return scores.withColumn("bm25", F.when(most > 0, F.col("bm25") / most).otherwise(0.0))
