"""Pairs of memories that contradict each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remembra.functions.text import java, trim

# Status words and their opposites, negations, and words that carry no topic.
OPPOSITES = {
    "working": ["broken", "not working", "down", "failed", "failing", "crashed", "busted"],
    "broken": ["working", "fixed", "repaired", "resolved", "functional"],
    "deployed": ["not deployed", "undeployed", "down", "offline", "pending deployment"],
    "undeployed": ["deployed", "live", "running"],
    "live": ["down", "offline", "dead", "not live"],
    "down": ["live", "up", "online", "running", "working"],
    "active": ["inactive", "disabled", "off", "deactivated", "paused"],
    "inactive": ["active", "enabled", "running"],
    "enabled": ["disabled", "off", "deactivated"],
    "disabled": ["enabled", "on", "active"],
    "connected": ["disconnected", "offline", "not connected"],
    "disconnected": ["connected", "online"],
    "passing": ["failing", "failed", "broken"],
    "failing": ["passing", "working", "fixed"],
    "healthy": ["unhealthy", "sick", "down", "broken"],
    "success": ["failure", "failed", "error", "unsuccessful"],
    "failed": ["succeeded", "success", "working", "passing"],
    "open": ["closed", "shut", "resolved"],
    "closed": ["open", "active", "unresolved"],
    "available": ["unavailable", "down", "offline"],
    "unavailable": ["available", "up", "online"],
    "complete": ["incomplete", "in progress", "pending", "unfinished"],
    "incomplete": ["complete", "done", "finished"],
    "running": ["stopped", "crashed", "halted", "terminated"],
    "stopped": ["running", "started", "active"],
    "secure": ["insecure", "vulnerable", "exposed"],
    "insecure": ["secure", "safe", "protected"],
    "profitable": ["unprofitable", "losing money", "in the red"],
    "unprofitable": ["profitable", "making money", "in the black"],
}
NEGATION = r"\b(?i:not|no|never|doesn't|don't|won't|can't|cannot|isn't|aren't|hasn't|haven't|neither|nor|without|unable|fails?)\b|\w+n't\b"
STOP_WORDS = (
    "the a an and or but in on at to for of with is are was were be been being have has had do does did will would could should may might shall "
    "that this these those it its i we you he she they my our your his her their as by from up about into through during before after then if when "
    "while so just than also both each few more most other some such only own same very still yet even already back over under again further once "
    "here there where why how all any what which who whom whose am now new old one two three four five six seven eight nine ten many much long great little"
).split()
DOLLAR = r"\$(\d[\d,]*(?:\.\d+)?(?:[kKmMbB])?)"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
COUNT = r"(?i)\b(\d+)\s+(users?|items?|errors?|members?|customers?|installs?|downloads?|repos?|followers?|stars?|issues?|bugs?|days?|hours?|months?|years?|weeks?|records?|rows?|entries)\b"
LEAST = 0.3


def content_words(text: Column) -> Column:
    """Longer words without stop words, repeats kept."""
    found = F.split(F.lower(text), r"[^a-z0-9'-]+")
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def is_sentence(part: Column) -> Column:
    """Whether a trimmed part of a text is long enough to say something."""
    return (F.length(part) > 8) & (F.size(F.split(part, r"\s+")) >= 3)


#: NEGATION, spelled for Java so that most places are told by one look back.
_NEGATED = NEGATION.replace(r"\b(?i:", r"(?<!\w)(?i:").replace(r")\b|", r")(?!\w)|").replace(r"\w+n't\b", r"\wn't(?!\w)")


def negated(sentence: Column) -> Column:
    return sentence.rlike(_NEGATED)


def numbers(text: Column) -> Column:
    """Amounts, percentages and counts, in this order, as doubles; k, m and b behind an amount multiply it."""

    def amount(raw: Column) -> Column:
        low = F.lower(F.regexp_replace(raw, ",", ""))
        times = F.when(low.endswith("k"), 1e3).when(low.endswith("m"), 1e6).when(low.endswith("b"), 1e9).otherwise(1.0)
        return F.regexp_replace(low, "[kmb]", "").cast("double") * times

    found = lambda p: F.regexp_extract_all(text, F.lit(java(p)), F.lit(1))
    plain = lambda x: x.cast("double")
    return F.concat(F.transform(found(DOLLAR), amount), F.transform(found(PERCENT), plain), F.transform(found(COUNT), plain))


def opposed(a: Column, b: Column) -> Column:
    """Whether a has a status word and b an opposite of it, as parts of words too."""
    out = F.lit(False)
    for word, others in OPPOSITES.items():
        some = F.lit(False)
        for o in others:
            some = some | b.contains(o)
        out = out | (a.contains(word) & some)
    return out


def features(memories: DataFrame, prefix: str) -> DataFrame:
    """The columns of memories (id, content, ...) and those that scoring needs, under a prefix. Computed once for a memory, not for a pair."""
    c = F.col("content")
    # no word reaches over the end of a part, so the text's words are those of its parts
    parts = F.transform(F.split(c, r"[.!?\n]+"), lambda s: F.struct(trim(s).alias("s"), content_words(s).alias("w")))
    cut = memories.select("id", "created_at", "content", parts.alias("parts"))
    said = F.transform(F.filter("parts", lambda p: is_sentence(p["s"])), lambda p: F.struct(F.array_distinct(p["w"]).alias("w"), negated(p["s"]).alias("n")))
    return cut.select(
        F.col("id").alias(f"{prefix}_id"),
        F.col("created_at").alias(f"{prefix}_at"),
        F.flatten(F.transform("parts", lambda p: p["w"])).alias(f"{prefix}_words"),
        said.alias(f"{prefix}_said"),
        F.lower(c).alias(f"{prefix}_low"),
        numbers(c).alias(f"{prefix}_numbers"),
    )


def scored(pairs: DataFrame) -> DataFrame:
    """pairs, with features under a and b, with `overlap`, `score` and `kind` (negation, status or numerical); those below LEAST go."""
    rows = pairs.withColumn("overlap", jaccard(F.col("a_words"), F.col("b_words")))

    def best_against(x: Column) -> Column:
        def one(y: Column) -> Column:
            sim = jaccard(x["w"], y["w"])
            return F.when((x["n"] != y["n"]) & (sim > 0.45), F.least(F.lit(0.95), 0.45 + sim * 0.75)).otherwise(0.0)

        return F.coalesce(F.array_max(F.transform("b_said", one)), F.lit(0.0))

    negation = F.coalesce(F.array_max(F.transform("a_said", best_against)), F.lit(0.0))
    over = F.col("overlap")
    status = F.when((over > 0.15) & (opposed(F.col("a_low"), F.col("b_low")) | opposed(F.col("b_low"), F.col("a_low"))), F.least(F.lit(0.9), 0.4 + over * 0.7)).otherwise(0.0)

    def differs(x: Column, y: Column) -> Column:
        low = F.least(x, y)
        ratio = F.when(low == 0, 10.0).otherwise(F.greatest(x, y) / low)
        return (x != y) & ((ratio > 1.5) | ((ratio > 1.1) & (over > 0.5)))

    some = F.exists("a_numbers", lambda x: F.exists("b_numbers", lambda y: differs(x, y)))
    numerical = F.when((over > 0.25) & some, F.least(F.lit(0.92), 0.35 + over * 0.7)).otherwise(0.0)
    kinds = ["negation", "status", "numerical"]
    told = F.struct(negation.alias("negation"), status.alias("status"), numerical.alias("numerical"))
    # rows that score too little go from an array, as a filter would have the scores made again below it
    rows = rows.withColumn("told", F.explode(F.filter(F.array(told), lambda x: F.greatest(*(x[k] for k in kinds)) >= LEAST)))
    rows = rows.withColumns({k: F.col(f"told.{k}") for k in kinds}).drop("told")
    score = F.greatest(*kinds)
    kind = F.when(F.col("negation") == score, "negation").when(F.col("status") == score, "status").otherwise("numerical")
    return rows.withColumn("score", score).withColumn("kind", kind)


def temporal(rows: DataFrame) -> DataFrame:
    """scored rows; those that overlap, score well and lie apart in time count as temporal and somewhat more."""
    days = F.abs(F.unix_micros("a_at") - F.unix_micros("b_at")) / 86_400_000_000
    is_ = (F.col("overlap") >= 0.35) & (F.col("score") >= 0.45) & (days >= 0.001)
    return rows.withColumn("kind", F.when(is_, "temporal").otherwise(F.col("kind"))).withColumn("score", F.when(is_, F.least(F.lit(0.98), F.col("score") + 0.08)).otherwise(F.col("score")))


def upserted(found: DataFrame) -> DataFrame:
    """(memory_a, memory_b, score, kind) for each unordered pair of found (a, b, score, kind, at): the best score, the kind first found."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return found.groupBy(low.alias("memory_a"), high.alias("memory_b")).agg(F.max("score").alias("score"), F.min_by("kind", "at").alias("kind"))


def unresolved(rows: DataFrame) -> DataFrame:
    return rows.filter("resolved_at is null").orderBy(F.col("score").desc(), F.col("created_at").desc(), "id")


def of_memory(rows: DataFrame, id_) -> DataFrame:
    return rows.filter((F.col("memory_a") == id_) | (F.col("memory_b") == id_))


def resolved(rows: DataFrame, id_, text: str, as_of: Column) -> DataFrame:
    hit = (F.col("id") == id_) & F.col("resolved_at").isNull()
    return rows.withColumn("resolution", F.when(hit, F.lit(text)).otherwise(F.col("resolution"))).withColumn("resolved_at", F.when(hit, as_of).otherwise(F.col("resolved_at")))


def superseded(found: DataFrame, beliefs: DataFrame, least: float = 0.8) -> DataFrame:
    """(old, new, resolve): for each contradiction (new, old, score), best first for an old belief, whose new belief is as sure as the old or surer; resolve if it scores high within a domain."""
    b = beliefs.select("id", "confidence", "domain")
    n = b.select(F.col("id").alias("new"), F.col("confidence").alias("nc"), F.col("domain").alias("nd"))
    o = b.select(F.col("id").alias("old"), F.col("confidence").alias("oc"), F.col("domain").alias("od"))
    rows = found.join(n, "new").join(o, "old").filter("nc >= oc")
    first = F.row_number().over(W.partitionBy("old").orderBy(F.col("score").desc(), "new"))
    return rows.withColumn("r", first).filter("r = 1").select("old", "new", ((F.col("score") > least) & (F.col("nd") == F.col("od"))).alias("resolve"))
