"""Hybrid ranked search: candidates by vector and by text, then gates, filters and a linear score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remembra.functions import scoring, tiers, vectors
from remembra.operators.bm25 import TextIndex, bm25, normalised
from remembra.operators.metric import VectorIndex


@dataclass(frozen=True)
class Options:
    limit: int = 10
    namespace: str | None = None
    namespace_prefix: bool = False
    type: str | None = None
    tags: Sequence[str] = field(default_factory=tuple)
    min_importance: float | None = None
    min_vector_score: float = 0.3
    min_text_score: float = 0.4
    min_score: float = 0.3
    project: str | None = None
    after: str | None = None
    before: str | None = None
    depth: int = 2
    boost: float = 0.15

    @property
    def candidates(self) -> int:
        """Filters come after the candidates, so a type filter fetches more of them."""
        return self.limit * (20 if self.type else 3)


def vector_candidates(table: DataFrame, query: Sequence[float], k: int, id_: str = "id", vector: str = "vector") -> DataFrame:
    """(id, vector_score): the exact k nearest by squared distance, ties to the smaller id."""
    asked = F.array(*(F.lit(float(x)) for x in query))
    near = table.select(F.col(id_).alias("id"), vectors.squared_l2(F.col(vector), asked).alias("distance"))
    return near.orderBy("distance", "id").limit(k).select("id", vectors.similarity(F.col("distance")).alias("vector_score"))


def text_candidates(memories: DataFrame, terms: Sequence[str], k: int, index: TextIndex | None = None) -> DataFrame:
    """(id, bm25): the k best by BM25, ties to the smaller id, divided by the best; from the index, if there is one."""
    terms = sorted(set(terms))
    queries = memories.sparkSession.createDataFrame([(0, t) for t in terms], "q int, term string")
    found = bm25(memories, queries) if index is None else index.bm25(queries, terms)
    best = found.orderBy(F.col("bm25").desc(), "id").limit(k)
    return normalised(best).select("id", F.col("bm25"))


def merged(by_vector: DataFrame, by_text: DataFrame) -> DataFrame:
    """(id, vector_score, bm25, has_vector, has_text), scores 0 where a side lacks the id."""
    both = by_vector.withColumn("has_vector", F.lit(True)).join(by_text.withColumn("has_text", F.lit(True)), "id", "full_outer")
    return both.select("id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("has_vector", F.lit(False)).alias("has_vector"), F.coalesce("has_text", F.lit(False)).alias("has_text"))


def gate(o: Options) -> Column:
    """What only one side found has to score there."""
    return (F.col("has_vector") & F.col("has_text")) | (F.col("has_vector") & (F.col("vector_score") >= o.min_vector_score)) | (F.col("has_text") & (F.col("bm25") >= o.min_text_score))


def in_namespace(name: str, prefix: bool = False) -> Column:
    ns = F.col("namespace")
    if not prefix:
        return ns == name
    below = name if name.endswith("/") else name + "/"
    return (ns == name) | ns.startswith(below)


def project() -> Column:
    """The project that a row's metadata names; none in other metadata, or in none."""
    return F.coalesce(F.get_json_object("metadata", "$.project"), F.lit(""))


def filters(o: Options) -> Column:
    """Namespace, type, importance, tags, project and creation; a row whose metadata names no project passes the project filter."""
    out = F.lit(True)
    if o.namespace:
        out = out & in_namespace(o.namespace, o.namespace_prefix)
    if o.type:
        out = out & (F.col("type") == o.type)
    if o.min_importance:
        out = out & (F.col("importance") >= o.min_importance)
    if o.tags:
        out = out & F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, o.tags))), F.lit(False))
    if o.project:
        out = out & project().isin("", o.project)
    utc = lambda t: F.to_timestamp(F.lit(f"{t}+00:00"), "yyyy-MM-dd HH:mm:ssXXX")
    if o.after:
        out = out & (F.col("created_at").isNull() | (F.col("created_at") >= utc(o.after)))
    if o.before:
        out = out & (F.col("created_at").isNull() | (F.col("created_at") < utc(o.before)))
    return out


def ranked(memories: DataFrame, candidates: DataFrame, as_of: Column, o: Options, boosted: DataFrame | None = None) -> DataFrame:
    """The search's result: candidates that pass, with their scores, best first. boosted: ids whose score is raised, up to 1.

    The candidates, at most two times o.candidates, are few: their ids go into the scan's filter, so of the memories only row groups
    that may hold one of them are read.
    """
    passed = candidates.filter(gate(o)).collect()
    kept = memories.sparkSession.createDataFrame(passed, candidates.schema)
    rows = memories.filter(F.col("id").isin([r.id for r in passed])).join(F.broadcast(kept), "id").filter(filters(o))
    rows = rows.withColumn("recency_score", scoring.recency(F.col("accessed_at"), as_of))
    score = scoring.hybrid(F.col("vector_score"), F.col("bm25"), F.col("recency_score"), F.col("importance"), F.col("access_count"), F.col("type"))
    rows = rows.withColumn("score", score)
    if boosted is not None:
        rows = rows.join(boosted.select("id").distinct().withColumn("__b", F.lit(True)), "id", "left")
        rows = rows.withColumn("score", F.when(F.col("__b"), F.least(F.lit(1.0), F.col("score") + o.boost)).otherwise(F.col("score"))).drop("__b")
    content = tiers.at_depth(F.col("content"), tiers.l0(F.col("content")), tiers.l1(F.col("content")), o.depth)
    best = rows.filter(F.col("score") >= o.min_score).orderBy(F.col("score").desc(), "id").limit(o.limit)
    return best.withColumn("content", content)


def search(memories: DataFrame, vector_table: DataFrame, query: Sequence[float], terms: Sequence[str], as_of: Column, o: Options = Options(), boosted: DataFrame | None = None, index: TextIndex | None = None, near: VectorIndex | None = None) -> DataFrame:
    """near: an index of the vectors, in place of a scan of vector_table."""
    by_vector = vector_candidates(vector_table, query, o.candidates) if near is None else near.candidates(list(query), o.candidates)
    both = merged(by_vector, text_candidates(memories, terms, o.candidates, index))
    return ranked(memories, both, as_of, o, boosted)


def touched(result: DataFrame, as_of: Column) -> DataFrame:
    """(id, accessed_at, accesses): what a search changes in the rows that it returned; see store.fold."""
    return result.select("id", as_of.alias("accessed_at"), F.lit(1).cast("long").alias("accesses"))


def recall(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall at 1, 5 and 10 and the mean reciprocal rank over queries; ranks: a row per query with `rank` or null."""
    at = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}")
    return ranks.groupBy(*by).agg(F.count("*").alias("queries"), at(1), at(5), at(10), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def regressions(results: DataFrame, by: str, order: str, most_loss: float = 0.05, most_latency: float = 1.5) -> DataFrame:
    """For each run and its predecessor, whether recall fell by more than most_loss or the latency grew beyond most_latency times."""
    w = W.partitionBy(by).orderBy(order)
    out = results.withColumn("before_recall", F.lag("recall").over(w)).withColumn("before_latency", F.lag("latency").over(w))
    return out.withColumn("regressed", F.coalesce((F.col("before_recall") - F.col("recall") > most_loss) | (F.col("latency") > most_latency * F.col("before_latency")), F.lit(False)))
