"""Statistics, decay, curation and exact deduplication of the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remembra.functions import scoring
from remembra.functions.text import contains_any, content_hash, words

STALE_DAYS, STALE_IMPORTANCE = 60, 0.4
DECAY_AFTER_DAYS, DECAY_STEP = 7, 0.01
CURATE_IMPORTANCE, FRAGMENT_WORDS = 0.6, 20

# The namespace of some types, and project names looked for in tags, in this order.
NAMESPACES = {"session": "sessions", "belief": "beliefs", "reflection": "reflections", "decision": "decisions", "person": "people", "project-state": "projects"}
PROJECTS = ["myapp", "dashboard", "blog", "docs", "trading", "videogen", "mybrand", "viral-machine"]


def tiers(importance: Column) -> Column:
    return F.when(importance > 0.7, "high").when(importance >= 0.4, "medium").otherwise("low")


def stats(memories: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, creation range and mean importance, in all or by some columns; one aggregation."""
    return memories.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min(F.unix_micros("created_at")).alias("first_created"),
        F.max(F.unix_micros("created_at")).alias("last_created"),
        F.round(F.avg("importance"), 3).alias("avg_importance"),
        F.count_if(F.col("importance") > 0.7).alias("high"),
        F.count_if((F.col("importance") >= 0.4) & (F.col("importance") <= 0.7)).alias("medium"),
        F.count_if(F.col("importance") < 0.4).alias("low"),
    )


def share(df: DataFrame, by: str, count: str = "n") -> DataFrame:
    """Rows of each value and their part of all, which is counted by itself."""
    return df.groupBy(by).agg(F.count("*").alias(count)).withColumn("share", F.col(count) / df.select(F.count("*")).scalar())


def top(memories: DataFrame, column: str, k: int = 10) -> DataFrame:
    return memories.orderBy(F.col(column).desc(), "id").limit(k)


def stale(as_of: Column) -> Column:
    """Not looked at for 60 days, and of little importance."""
    return (scoring.days_between(as_of, F.col("accessed_at")) > STALE_DAYS) & (F.col("importance") < STALE_IMPORTANCE)


def health(memories: DataFrame, as_of: Column) -> DataFrame:
    return memories.agg(
        F.count("*").alias("total"),
        F.round(F.avg("importance"), 3).alias("avg_importance"),
        F.count_if(stale(as_of)).alias("stale"),
        F.min(F.unix_micros("accessed_at")).alias("first_accessed"),
        F.max(F.unix_micros("accessed_at")).alias("last_accessed"),
        F.lit(0).cast("long").alias("duplicates"),
    )


def decay(memories: DataFrame, as_of: Column, half_life: float = 30, least: float = 0.05) -> DataFrame:
    """(id, importance, decayed, days): the rows whose importance falls by more than a step; rows accessed within a week are left alone."""
    days = scoring.days_between(as_of, F.col("accessed_at"))
    out = memories.withColumn("days", days).filter(F.col("days") >= DECAY_AFTER_DAYS)
    out = out.withColumn("decayed", scoring.decayed(F.col("importance"), F.col("days"), half_life, least))
    return out.filter(F.col("decayed") < F.col("importance") - DECAY_STEP).select("id", "importance", "decayed", "days")


def curate(memories: DataFrame, as_of: Column, least: float = CURATE_IMPORTANCE, older_than_days: float = 0) -> DataFrame:
    """The memories that a look-through flags, with its reasons: no use so far, a pasted chat, a fragment."""
    c = F.col("content")
    old = F.lit(True) if not older_than_days else scoring.days_between(as_of, F.col("created_at")) > older_than_days
    pasted = (
        (c.contains("**User:**") & c.contains("**Assistant:**"))
        | (c.contains('"role": "system"') & c.contains('"content":'))
        | (c.contains('"role": "user"') & c.contains('"role": "assistant"'))
        | F.exists("tags", lambda t: F.lower(t).startswith("chatgpt"))
    )
    reasons = F.concat_ws(
        ", ",
        F.when((F.col("importance") < least) & (F.col("access_count") == 0) & old, F.concat(F.lit("low-importance("), F.col("importance").cast("string"), F.lit(")"))),
        F.when(pasted, "chatgpt-noise"),
        F.when(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) < FRAGMENT_WORDS, "fragment"),
    )
    return memories.withColumn("reasons", reasons).filter(F.col("reasons") != "")


def export(memories: DataFrame, namespace: str | None = None, kind: str | None = None, limit: int = 50, project: str | None = None) -> DataFrame:
    """One markdown line a memory, the most important first; of a project only those whose metadata names it."""
    out = memories
    if namespace:
        out = out.filter(F.col("namespace") == namespace)
    if kind:
        out = out.filter(F.col("type") == kind)
    if project:
        out = out.filter(F.get_json_object("metadata", "$.project") == project)
    out = out.orderBy(F.col("importance").desc(), "id").limit(limit)
    return out.withColumn("line", F.concat(F.lit("- ["), "type", F.lit("] "), F.substring(F.regexp_replace("content", r"\s+", " "), 1, 120)))


def duplicates(memories: DataFrame) -> DataFrame:
    """Rows whose trimmed content an older row has, with that row's id (created first, then the smaller id)."""
    w = W.partitionBy("hash").orderBy("created_at", "id")
    ranked = memories.withColumn("hash", content_hash(F.col("content"))).select("id", "hash", "created_at", F.row_number().over(w).alias("n"), F.first("id").over(w).alias("kept"))
    return ranked.filter("n > 1").select("id", "kept")


def new_rows(batch: DataFrame, store: DataFrame, order: str = "id") -> DataFrame:
    """The rows of a batch whose content neither the store nor an earlier row of the batch has."""
    hashed = batch.withColumn("hash", content_hash(F.col("content")))
    first = hashed.withColumn("n", F.row_number().over(W.partitionBy("hash").orderBy(order))).filter("n = 1").drop("n")
    known = store.select(content_hash(F.col("content")).alias("hash")).distinct()
    return first.join(known, "hash", "left_anti")


def laid_out(projects: Sequence[str] = tuple(PROJECTS)) -> Column:
    """The namespace that a row belongs to: by its type, else by the first project that a tag contains, else its own."""
    out = F.col("namespace")
    for p in reversed(projects):
        named = F.size(F.filter(F.transform("tags", F.lower), lambda t: F.contains(t, F.lit(p)))) > 0  # noqa: B023
        out = F.when(named, F.lit("projects/" + p.replace("-", "", 1))).otherwise(out)
    for kind, ns in NAMESPACES.items():
        out = F.when(F.col("type") == kind, F.lit(ns)).otherwise(out)
    return out


def topics(memories: DataFrame, since: Column, most: int = 10) -> DataFrame:
    """The commonest of the first ten longer words of the rows created since then."""
    recent = memories.filter(F.col("created_at") >= since)
    each = recent.select(F.explode(F.slice(words(F.lower("content"), 4), 1, 10)).alias("topic"))
    return each.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "topic").limit(most)


def reflection(memories: DataFrame, beliefs: DataFrame, since: Column, hours: int, most_types: int = 5, most_topics: int = 5) -> DataFrame:
    """One row (memories, types, topics, stale, sentence) on the memories created since then: the commonest types and topics as `name(count)`, and the
    number of beliefs (with `stale`, see beliefs.active) that nothing has challenged for long."""
    recent = memories.filter(F.col("created_at") >= since)
    listed = lambda df, name: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(name).alias("name"), "n"))), lambda x: F.concat(x["name"], F.lit("("), x["n"].cast("string"), F.lit(")"))), ", ")).first()[0]  # noqa: E731  # a few rows
    kinds = listed(recent.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "type").limit(most_types), "type")
    words_ = listed(topics(memories, since, most_topics), "topic")
    stale_ = beliefs.agg(F.count_if("stale")).first()[0]
    text = F.concat(F.lit(f"Reflection on last {hours} hours: "), F.col("memories").cast("string"), F.lit(f" memories saved. Top types: {kinds}. Top topics: {words_}. Stale beliefs: {stale_}."))
    return recent.agg(F.count("*").alias("memories")).select("memories", F.lit(kinds).alias("types"), F.lit(words_).alias("topics"), F.lit(stale_).alias("stale"), text.alias("sentence"))


# Words of the self-review's classes; avoidance is what is due and not said to be done.
SYCOPHANCY = ["great idea", "excellent", "perfect", "i agree", "sounds good", "absolutely"]
DUE, DONE = ["should", "need to", "todo"], ["completed", "done"]
FABRICATION = ["i think", "probably", "might", "assume"]


def shadow(memories: DataFrame, since: Column, hours: float, most_projects: int = 5) -> DataFrame:
    """(class, n, first_id): rows of each class created since then, and the first; `breadth` counts projects, if they are many within a day."""
    low = F.lower("content")
    recent = memories.filter(F.col("created_at") >= since)
    classes = {"sycophancy": contains_any(low, SYCOPHANCY), "avoidance": contains_any(low, DUE) & ~contains_any(low, DONE), "fabrication": contains_any(low, FABRICATION)}
    aggregates = [f(x).alias(f"{k}_{n}") for n, c in classes.items() for k, f, x in (("n", F.count_if, c), ("id", F.min, F.when(c, F.col("id"))))]
    one = recent.agg(*aggregates, F.count_distinct("source").alias("projects"))
    rows = [F.struct(F.lit(n).alias("class"), F.col(f"n_{n}").alias("n"), F.col(f"id_{n}").alias("first_id")) for n in classes]
    rows.append(F.struct(F.lit("breadth").alias("class"), F.when((F.col("projects") > most_projects) & F.lit(hours <= 24), F.col("projects")).otherwise(F.lit(0)).cast("long").alias("n"), F.lit(None).cast("long").alias("first_id")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def shadow_total(classes: DataFrame) -> DataFrame:
    """One row (total) of the classes that shadow gives: all instances, and one more if there is too much breadth."""
    return classes.agg(F.sum(F.when(F.col("class") == "breadth", F.least(F.lit(1), F.col("n"))).otherwise(F.col("n"))).cast("long").alias("total"))
