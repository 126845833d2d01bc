"""Near copies by the Jaccard similarity of shingles: operator 3's ball hashing and, for copies whose fingerprints lie farther apart, buckets of
minima find candidates; their shingles decide."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remembra.llm._bytes import pieces
from remembra.llm._graph import components, join_hot, likely
from remembra.llm._store import held, quoted, released, remove, stored, workspace
from remembra.llm.minhash import link_sets, sketch
from remembra.llm.simhash import SEED, _shingles, links, majority

#: Words of a shingle, and 100 times the least similarity of near copies.
SHINGLE, PERCENT = 5, 80

_SKETCH = sketch(SHINGLE)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the fingerprint and what sketch gives in the place of the text."""
    for batch in batches:
        for piece in pieces(batch, "__text"):
            fp = majority(*_shingles(piece.column(piece.num_columns - 1), SHINGLE, SEED))
            made = pa.Table.from_batches(_SKETCH(iter([piece]))).combine_chunks().to_batches()[0]
            yield made.append_column("fp", pa.array(fp.view("int64")))


def _balls(texts: DataFrame, place: str) -> DataFrame:
    """Candidates (a, b), a < b, of texts (node, fp): a fingerprint's texts with its first one, and the first ones of fingerprints that ball hashing links."""
    groups = stored(texts.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("__count")), f"{place}/fingerprints")
    same = join_hot(texts.select("node", "fp"), groups, "fp", texts.count()).filter("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    a, b = (groups.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}")) for c in "ab")
    near = links(groups).join(a, "a").join(b, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    return same.union(near)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that links lead to a row that comes before; equal rows of one doc_id and text are one.

    Texts are linked at a Jaccard similarity of their 5-word shingles of 0.8 or more; a shorter text
    is one shingle. Rows come in order of doc_id, those without one last, then of the text's hash, so
    of rows that share a doc_id each is judged by its own text; of rows equal in both, one stays that the hash of all columns picks.
    Texts without words, null ones too, are linked. All columns are kept, whatever their names; an empty table stays empty.
    """
    spark = docs.sparkSession
    place = workspace(spark, "copies")
    kind = dict(docs.dtypes)["doc_id"]
    every = F.xxhash64(*(F.col(quoted(c)) for c, k in docs.dtypes if "map<" not in k))
    keyed = docs.select(held(docs.columns).alias("__doc"), "doc_id", F.xxhash64("doc_id", "text").alias("row"), every.alias("whole"), F.col("text").alias("__text"))
    rows = keyed.select("doc_id", "row", "whole", "__text").mapInArrow(_rows, f"doc_id {kind}, row long, whole long, n_shingles long, node long, signature binary, fp long")
    rows = stored(rows, f"{place}/rows")
    best = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row", "whole")).alias("best")
    some = [F.any_value(c).alias(c) for c in ("n_shingles", "signature", "fp")]
    texts = stored(rows.groupBy("node").agg(best, F.count("*").alias("__count"), *some), f"{place}/texts")
    total = rows.count()
    remove(spark, f"{place}/rows")

    def whole(nodes: DataFrame) -> DataFrame:
        those = texts.join(nodes, "node", "left_semi").select(F.col("best.whole").alias("whole"), "node", "__count")
        those = stored(those, f"{place}/those")
        return join_hot(likely(keyed.select("whole", "__text"), those, "whole"), those, "whole", total).select("node", "__text")

    alike = link_sets(texts, whole, place, PERCENT, SHINGLE, _balls(texts.filter("n_shingles > 0"), place))
    roots, done = components(alike)
    found = texts.select("node", "best").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
    first = stored(found.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"), F.col("best.whole").alias("whole")), f"{place}/first")
    done()
    for name in ("texts", "fingerprints", "those"):
        remove(spark, f"{place}/{name}")
    kept = keyed.join(first, ["row", "whole"], "left_semi").dropDuplicates(["row", "whole"])
    return kept.select(F.col("__doc").alias("__row")).select(*released(docs.columns))
