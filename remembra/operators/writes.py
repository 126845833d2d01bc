"""What is written: inputs made whole, clusters merged, and the changes of state of typed memories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remembra.functions import scoring, tiers
from remembra.functions.text import matches, trim
from remembra.schemas import TYPES

MERGED_CHARS, MERGED_IMPORTANCE = 500, 0.7
HISTORY = "array<struct<date:timestamp,confidence:double,reason:string>>"


def row_id(content: Column, source: Column, place: Column) -> Column:
    """An id of 36 characters that the same input always gets."""
    h = F.sha2(F.concat_ws("\u0001", source, content, place.cast("string")), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def prepared(inputs: DataFrame, as_of: Column, source: str = "cli", importance: float | None = None) -> DataFrame:
    """Inputs (content, and any of namespace, type, importance, source, tags, metadata) as rows of `memories`.

    Missing columns and nulls get the defaults: namespace general, type semantic, importance by type
    (or the one given, as for tool calls), no tags, empty metadata; short forms are made. Equal inputs are told apart by a number.
    """
    have = set(inputs.columns)
    col = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    out = inputs.withColumn("__type", col("type", F.lit("semantic"))).withColumn("__source", col("source", F.lit(source)))
    out = out.withColumn("__n", F.row_number().over(W.partitionBy("content", "__source").orderBy("__type")))
    c = F.col("content")
    return out.select(
        row_id(c, F.col("__source"), F.col("__n")).alias("id"),
        c,
        tiers.l0(c).alias("l0_content"),
        tiers.l1(c).alias("l1_content"),
        col("namespace", F.lit("general")).alias("namespace"),
        F.col("__type").alias("type"),
        col("importance", scoring.default_importance(F.col("__type")) if importance is None else F.lit(importance)).alias("importance"),
        F.col("__source").alias("source"),
        col("tags", F.expr("cast(array() as array<string>)")).alias("tags"),
        col("metadata", F.lit("{}")).alias("metadata"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
        as_of.alias("accessed_at"),
        F.lit(0).cast("long").alias("access_count"),
    )


def invalid(inputs: DataFrame) -> DataFrame:
    """The inputs with a reason why they are not taken: an unknown type, a confidence or importance outside 0 to 1, an outcome that is none, a deadline that is no date."""
    have = set(inputs.columns)
    unit = lambda c: ~F.col(c).between(0, 1)
    rules = [("type", lambda: ~F.col("type").isin(TYPES)), ("confidence", lambda: unit("confidence")), ("importance", lambda: unit("importance")), ("outcome", lambda: ~F.col("outcome").isin("correct", "wrong", "partial")), ("deadline", lambda: F.col("deadline").isNotNull() & F.expr("try_cast(deadline as date)").isNull())]
    reasons = F.concat_ws(", ", *(F.when(F.coalesce(rule(), F.lit(False)), name) for name, rule in rules if name in have))
    return inputs.withColumn("reason", reasons).filter("reason <> ''")


def consolidated(clusters: DataFrame, memories: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """New memories for leader clusters (seed, member), and the ids (id) that they replace.

    A cluster's contents are joined, seed first; what is longer than MERGED_CHARS is cut and says of how many
    it was made. The namespace is the seed's.
    """
    seeds = clusters.select("seed").distinct().select("seed", F.col("seed").alias("id"))
    rows = clusters.select("seed", F.col("member").alias("id")).union(seeds).join(memories, "id").withColumn("follows", F.col("id") != F.col("seed"))
    parts = F.array_sort(F.collect_list(F.struct("follows", (-F.col("importance")).alias("i"), "id", F.substring("content", 1, MERGED_CHARS + 1).alias("content"))))
    by = rows.groupBy("seed").agg(parts.alias("all"), F.max_by("namespace", ~F.col("follows")).alias("namespace"))
    joined = F.array_join(F.transform("all", lambda x: x["content"]), "\n---\n")
    text = F.when(F.length(joined) > MERGED_CHARS, F.concat(F.substring(joined, 1, MERGED_CHARS), F.lit("\n[consolidated from "), F.size("all").cast("string"), F.lit(" memories]"))).otherwise(joined)
    ids = F.transform("all", lambda x: x["id"].cast("string"))
    made = by.select(text.alias("content"), F.coalesce("namespace", F.lit("general")).alias("namespace"), F.lit("semantic").alias("type"), F.lit(MERGED_IMPORTANCE).alias("importance"), F.lit("consolidation").alias("source"), F.to_json(F.struct(ids.alias("supersededIds"))).alias("metadata"))
    return prepared(made, as_of), rows.select("id")


def judged(beliefs: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """beliefs with verdicts (id, verdict: confirmed or refuted, why) taken in: status, time, counter and history."""
    hit = F.col("verdict").isNotNull()
    step = F.array(F.struct(as_of.alias("date"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.concat_ws(": ", "verdict", "why").alias("reason")))
    one = lambda v: F.when(F.col("verdict") == v, 1).otherwise(0)
    return (
        beliefs.join(verdicts, "id", "left")
        .withColumn("history", F.when(hit, F.concat(F.coalesce("history", F.expr(f"cast(array() as {HISTORY})")), step)).otherwise(F.col("history")))
        .withColumn("times_confirmed", F.coalesce("times_confirmed", F.lit(0)) + one("confirmed"))
        .withColumn("times_refuted", F.coalesce("times_refuted", F.lit(0)) + one("refuted"))
        .withColumn("status", F.coalesce("verdict", "status"))
        .withColumn("last_challenged", F.when(hit, as_of).otherwise(F.col("last_challenged")))
        .drop("verdict", "why")
    )


def settled(rows: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Predictions or follow-ups with outcomes (id, outcome, text): status, resolution and time."""
    hit = F.col("outcome").isNotNull()
    out = rows.join(outcomes, "id", "left").withColumn("status", F.coalesce("outcome", "status"))
    return out.withColumn("resolution", F.when(hit, F.col("text")).otherwise(F.col("resolution"))).withColumn("resolved_at", F.when(hit, as_of).otherwise(F.col("resolved_at"))).drop("outcome", "text")


def predictions(statements: DataFrame, as_of: Column) -> DataFrame:
    """New predictions of (content, confidence, deadline, holder, domain): open, and of importance 0.7 or their confidence."""
    meta = F.to_json(F.struct("confidence", "holder", "deadline", "domain", F.lit("open").alias("status")))
    rows = statements.select("content", F.lit("prediction").alias("type"), F.greatest(F.lit(0.7), F.col("confidence")).alias("importance"), F.lit("prediction-system").alias("source"), meta.alias("metadata"))
    return prepared(rows, as_of)


def journal(entries: DataFrame, as_of: Column) -> DataFrame:
    """Entries (content) as reflections, tagged with the day."""
    rows = entries.select("content", F.lit("reflection").alias("type"), F.lit(0.8).alias("importance"), F.lit("journal").alias("source"), F.array(F.lit("journal"), F.date_format(as_of, "yyyy-MM-dd")).alias("tags"))
    return prepared(rows, as_of)


def behaviours(signals: DataFrame, as_of: Column) -> DataFrame:
    """What was done, of signals (content, holder, related_beliefs)."""
    meta = F.to_json(F.struct("holder", F.coalesce("related_beliefs", F.expr("cast(array() as array<string>)")).alias("relatedBeliefs")))
    return prepared(signals.select("content", F.lit("behavior").alias("type"), F.lit(0.6).alias("importance"), F.lit("behavior-tracker").alias("source"), meta.alias("metadata")), as_of)


def attentions(records: DataFrame, as_of: Column) -> DataFrame:
    """What was looked at, of records (topics, holder, duration in minutes; none or zero counts as one)."""
    given = F.coalesce("duration", F.lit(0.0)) != 0
    minutes = F.regexp_replace(F.col("duration").cast("string"), r"\.0$", "")
    content = F.concat(F.lit("Attention on: "), F.array_join("topics", ", "), F.when(given, F.concat(F.lit(" ("), minutes, F.lit("m)"))).otherwise(""))
    meta = F.to_json(F.struct("holder", "topics", F.when(given, F.col("duration")).otherwise(1.0).alias("durationMinutes"), as_of.alias("timestamp")))
    return prepared(records.select(content.alias("content"), F.lit("attention").alias("type"), F.lit(0.3).alias("importance"), F.lit("attention-tracker").alias("source"), meta.alias("metadata")), as_of)


def follow_ups(items: DataFrame, as_of: Column) -> DataFrame:
    """Open follow-ups of items (content, holder, created_from)."""
    meta = F.to_json(F.struct("holder", F.col("created_from").alias("source"), F.lit("open").alias("status"), "created_from"))
    return prepared(items.select("content", F.lit("follow-up").alias("type"), F.lit(0.8).alias("importance"), F.lit("follow-up-tracker").alias("source"), meta.alias("metadata")), as_of)


def beliefs(statements: DataFrame, as_of: Column) -> DataFrame:
    """New beliefs of (content, confidence, domain, holder, evidence, tags): active, and of importance 0.6 or their confidence."""
    have = set(statements.columns)
    texts = "cast(array() as array<string>)"
    col = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    history = F.array(F.struct(as_of.alias("date"), F.col("confidence"), F.lit("initial belief").alias("reason")))
    meta = F.to_json(
        F.struct(
            "confidence", "domain", col("holder", F.lit("agent")).alias("holder"), F.lit("active").alias("status"), col("evidence", F.expr(texts)).alias("evidence_for"), F.expr(texts).alias("evidence_against"),
            as_of.alias("last_challenged"), F.lit(0).alias("times_confirmed"), F.lit(0).alias("times_refuted"), F.col("confidence").alias("stated_confidence"), history.alias("history"),
        )
    )
    rows = statements.select("content", F.lit("belief").alias("type"), F.greatest(F.lit(0.6), F.col("confidence")).alias("importance"), F.lit("belief-system").alias("source"), col("tags", F.expr(texts)).alias("tags"), meta.alias("metadata"))
    return prepared(rows, as_of)


def _once(text: Column, old: str, new: str) -> Column:
    """text with the first `old` replaced."""
    at = F.instr(text, old)
    return F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text)))


def challenge_queries(statement: Column) -> Column:
    """What to search for to challenge a belief: its negation, its counterpart, and problems of its first longer word."""
    low = F.lower(statement)
    first = F.get(F.filter(F.split(low, " "), lambda w: F.length(w) > 3), F.lit(0))
    parts = [
        F.when(low.contains("is not"), _once(low, "is not", "is")).when(low.contains(" is "), _once(low, " is ", " is not ")),
        F.when(low.contains("distribution"), _once(low, "distribution", "product")),
        F.when(low.contains("product"), _once(low, "product", "distribution")),
        *(F.concat(first, F.lit(tail)) for tail in (" problems", " issues", " needs improvement")),
    ]
    return F.filter(F.array(*parts), lambda q: q.isNotNull())


def challenged(results: DataFrame, limit: int = 10) -> DataFrame:
    """results (belief, query_no, id, type, score): each memory that is no belief once per belief, as its first query found it, the best of them."""
    first = F.row_number().over(W.partitionBy("belief", "id").orderBy("query_no", F.col("score").desc()))
    rows = results.filter("type <> 'belief'").withColumn("n", first).filter("n = 1")
    rank = F.row_number().over(W.partitionBy("belief").orderBy(F.col("score").desc(), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select("belief", "rank", "id", "score")


# Words that carry no topic in a short form, and patterns of sentences that matter.
SHORT_STOP = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might "
    "shall can this that these those i you he she it we they me him her us them my your his its our their what which who how when where why not no "
    "so if as up out about into through during also just more than then now very too all"
).split()


def frequent_short_form(content: Column, most: int = 6) -> Column:
    """The other short form: the first sentence and the commonest longer words that it lacks; names and acronyms count twice more."""
    c = trim(content)
    sentence = F.get(F.split(c, r"(?<=[.!?])\s+|\n+"), F.lit(0))
    short = F.when(F.length(sentence) > 300, F.concat(F.substring(sentence, 1, 297), F.lit("..."))).otherwise(sentence)
    plain = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\w\s'-]", " "), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(SHORT_STOP) & w.rlike("^[a-z]"))
    special = F.transform(F.concat(F.regexp_extract_all(c, F.lit(r"(?<!\w)[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?!\w)"), F.lit(0)), F.regexp_extract_all(c, F.lit(r"(?<!\w)[A-Z]{2,}(?!\w)"), F.lit(0))), F.lower)
    every = F.array_distinct(F.concat(plain, special))
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    weighed = F.transform(every, lambda t, i: F.struct((-(count(plain, t) + 2 * count(special, t))).alias("n"), i.alias("i"), t.alias("t")))
    best = F.transform(F.slice(F.array_sort(weighed), 1, most), lambda x: x["t"])
    new = F.filter(best, lambda t: ~F.contains(F.lower(short), t))
    return F.when(c == "", "").otherwise(F.concat(short, F.when(F.size(new) > 0, F.concat(F.lit(" ["), F.array_join(new, ", "), F.lit("]"))).otherwise("")))


MARKERS = [
    r"\b(decided|decision|resolved|conclusion|therefore|thus)\b", r"\b(learned|lesson|insight|takeaway|key finding)\b",
    r"\b(important|critical|essential|note:|warning:)\b", r"\b(result:|outcome:|conclusion:)\b",
]
#: Words of the longer short form.
OVERVIEW_WORDS, SHORT_OVERVIEW = 375, 200


def overview(content: Column) -> Column:
    """The other longer form: a short text as it is, else the first paragraph (and the second, if that makes little), headings and up to five sentences that matter, cut at 375 words."""
    words = lambda t: F.split(t, r"\s+")
    keep = lambda a, least: F.filter(a, lambda x: F.length(x) > least)
    marked = lambda s: reduce(lambda a, b: a | b, (matches(s, "(?i)" + m) for m in MARKERS))

    def made(c: Column) -> Column:
        paragraphs = keep(F.transform(F.split(c, r"\n{2,}"), lambda p: trim(F.regexp_replace(p, "\n", " "))), 10)
        headings = F.regexp_extract_all(c, F.lit(r"(?m)^#{1,3}[^\S\n]+[^\n]+$"), F.lit(0))
        sentences = keep(F.transform(F.split(c, r"(?<=[.!?])\s+(?=[A-Z\"'\u2018\u2019\u201C])|(?<=[.!?])\z"), trim), 0)
        points = F.slice(F.filter(F.slice(sentences, 2, 1 << 30), marked), 1, 5)
        head = F.slice(paragraphs, 1, 1)
        rest = F.concat(
            F.when(F.size(headings) > 0, F.array(F.concat(F.lit("\n"), F.array_join(headings, "\n")))).otherwise(F.expr("cast(array() as array<string>)")),
            F.when(F.size(points) > 0, F.array(F.concat(F.lit("\nKey points: "), F.array_join(points, " ")))).otherwise(F.expr("cast(array() as array<string>)")),
        )
        short = F.size(words(F.array_join(F.concat(head, rest), "\n"))) < SHORT_OVERVIEW
        parts = F.concat(head, F.when(short, F.slice(paragraphs, 2, 1)).otherwise(F.expr("cast(array() as array<string>)")), rest)
        cut = lambda t: F.when(F.size(words(t)) > OVERVIEW_WORDS, F.concat(F.array_join(F.slice(words(t), 1, OVERVIEW_WORDS), " "), F.lit("..."))).otherwise(t)
        return F.transform(F.array(trim(F.array_join(parts, "\n"))), cut)[0]

    return F.transform(F.array(trim(content)), lambda c: F.when(F.size(words(c)) <= OVERVIEW_WORDS, c).otherwise(made(c)))[0]


def check_new(new: DataFrame, near: DataFrame, memories: DataFrame, least_similarity: float = 0.5) -> DataFrame:
    """(a, b, score, kind): contradictions of new memories with those that are near (q, id, vector_score), themselves left out."""
    from remembra.operators import contradictions as K

    pairs = near.filter((F.col("vector_score") >= least_similarity) & (F.col("q") != F.col("id"))).select(F.col("q").alias("a_id"), F.col("id").alias("b_id"))
    rows = pairs.join(K.features(new, "a"), "a_id").join(K.features(memories, "b"), "b_id")
    return K.temporal(K.scored(rows)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "score", "kind")


def embedded(memories: DataFrame, embed, dimensions: int, text: str = "content") -> DataFrame:
    """memories with `vector`: embed(list of texts) gives the vectors; it is called for Arrow batches, and loads what it needs when it is first called there."""
    @F.pandas_udf("array<float>")
    def vectors(column: pd.Series) -> pd.Series:
        made = embed(column.fillna("").tolist())
        if any(len(v) != dimensions for v in made):
            raise ValueError(f"a vector has not {dimensions} components")
        return pd.Series([list(map(float, v)) for v in made])

    return memories.withColumn("vector", vectors(F.col(text)))


def summarised(sessions: DataFrame, summarise, most: int = 15) -> DataFrame:
    """(session, kind, text): what summarise(list of (user, assistant)) says of each session's first exchanges, cut at 400 and 600 characters; it returns pairs of kind and text."""
    first = F.row_number().over(W.partitionBy("session").orderBy("exchange"))
    rows = sessions.withColumn("n", first).filter(F.col("n") <= most).select("session", "exchange", F.substring("user", 1, 400).alias("user"), F.substring("assistant", 1, 600).alias("assistant"))
    kind = dict(sessions.dtypes)["session"]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("exchange")
        said = summarise(list(zip(part["user"], part["assistant"], strict=True)))
        return pd.DataFrame([(part["session"].iloc[0], k, t) for k, t in said], columns=["session", "kind", "text"])

    return rows.groupBy("session").applyInPandas(one, f"session {kind}, kind string, text string")


def imported(rows: DataFrame, names: Sequence[str] = ("content", "namespace", "type", "importance", "source", "tags", "metadata")) -> DataFrame:
    """rows with those of the inputs' columns that they have."""
    return rows.select(*(c for c in names if c in rows.columns))
