"""The knowledge graph: entities of texts, their relationships, and queries over both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remembra.functions.text import all_matches, from_word, trim
from remembra.sources.store import stored, workspace

# Patterns of entities, verbs of strong relationships, and capitalised words that are no names.
URL = r"https?://[^\s,;)\"'\]]+"
DATE = r"(?i)\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b"
COMPANY = r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:Inc|LLC|Corp|Ltd|Co|AI|Labs|Technologies|Systems|Solutions|Group|Media|Studio|Studios)\.?)\b"
VERBS = (
    "built created uses used owns wrote developed founded leads manages works joined left acquired deployed launched shipped runs implements "
    "supports integrates connects defines contains depends extends replaces includes requires maintains configures"
).split()
COMMON = (
    "The This That These Those It Its A An I We You He She They My Our Your His Her Their In On At To For Of With By From Up Down "
    "Is Are Was Were Be Been Being Have Has Had Do Does Did Will Would Could Should May Might Can Must Shall And Or But So Yet Nor Not "
    "If Then When Where While Because Although Since After Before Until As Just Now Also Very New Old First Last Next Other Some All Any "
    "Each Both More Most Such Than How What Which Who January February March April June July August September October November December "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday True False Null None Yes No Ok Okay"
).split()
SENTENCE_END = r"(?<=[.!?])\s+"
STRONG, WEAK, TOGETHER = 0.8, 0.3, 6


#: Two or more words in a row that start, behind what is no letter, with a capital and a small letter.
RUN = r"(?<!\S)[^a-zA-Z'\s]*[A-Z][a-z]\S*(?:\s+[^a-zA-Z'\s]*[A-Z][a-z]\S*)+"
#: A strong verb between two words.
VERB = rf"(?i)\s+(?:(?:has|also|just|now)\s+)?({'|'.join(VERBS)})(?:s|ed|ing)?\s+"


def _people(sentence: Column) -> Column:
    """Pairs of capitalised words, not at the sentence's start, from left to right without overlap. Only runs of such words are taken apart."""
    rest = F.regexp_replace(trim(sentence), r"^\S+", "")
    start = F.struct(F.lit(None).cast("string").alias("open"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        good = (F.length(t) >= 2) & t.rlike("^[A-Z][a-z]") & ~t.isin(COMMON)
        pair = acc["open"].isNotNull() & good
        return F.struct(F.when(good & acc["open"].isNull(), t).alias("open"), F.when(pair, F.concat(acc["out"], F.array(F.concat(acc["open"], F.lit(" "), t)))).otherwise(acc["out"]).alias("out"))

    def pairs(run: Column) -> Column:
        clean = F.transform(F.split(run, r"\s+"), lambda t: F.regexp_replace(t, r"^[^a-zA-Z']+|[^a-zA-Z']+\z", ""))
        return F.aggregate(clean, start, step, lambda acc: acc["out"])

    return F.flatten(F.transform(F.regexp_extract_all(rest, F.lit(RUN), F.lit(0)), pairs))


def entities(memories: DataFrame, known: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """(id, place, name, type) of memories (id, content): known entities (pattern, name, type) first, then URLs, dates, companies and people; a name (in any case) counts once, as what it was first found as."""
    c = F.col("content")
    of = lambda found, kind: F.transform(found, lambda n: F.struct(trim(n).alias("name"), F.lit(kind).alias("type")))
    parts = []
    for pattern, name, kind in known:
        parts.append(F.when(c.rlike("(?i)" + pattern), F.array(F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type")))).otherwise(F.expr("cast(array() as array<struct<name:string,type:string>>)")))
    parts += [of(all_matches(c, URL), "url"), of(all_matches(c, from_word(DATE), 1), "date"), of(all_matches(c, from_word(COMPANY), 1), "company")]
    named = F.filter(F.split(c, SENTENCE_END), lambda s: s.rlike(RUN))
    parts.append(of(F.flatten(F.transform(named, _people)), "person"))
    rows = memories.select("id", F.posexplode(F.concat(*parts)).alias("place", "e")).select("id", "place", "e.name", "e.type").filter("length(name) between 2 and 120")
    first = F.row_number().over(W.partitionBy("id", F.lower("name")).orderBy("place"))
    return rows.withColumn("n", first).filter("n = 1").drop("n")


def upserted(found: DataFrame) -> DataFrame:
    """(entity, name, type, mentions): one row for each name in any case; spelling and type are those of its first memory."""
    first = F.struct("id", "place")
    return found.groupBy(F.lower("name").alias("entity")).agg(F.min_by("name", first).alias("name"), F.min_by("type", first).alias("type"), F.count_distinct("id").alias("mentions"))


def together(memories: DataFrame, found: DataFrame) -> DataFrame:
    """(id, source, target): pairs of a memory's entities that stand in one sentence, among the first six there."""
    sentences = memories.select("id", F.posexplode(F.split("content", SENTENCE_END)).alias("s", "sentence"))
    there = sentences.join(found, "id").filter(F.lower("sentence").contains(F.lower("name")))
    ranked = there.withColumn("r", F.row_number().over(W.partitionBy("id", "s").orderBy("place"))).filter(F.col("r") <= TOGETHER).select("id", "s", "r", F.lower("name").alias("name"))
    right = ranked.select("id", "s", F.col("r").alias("r2"), F.col("name").alias("target"))
    return ranked.join(right, ["id", "s"]).filter("r < r2").select("id", F.col("name").alias("source"), "target").distinct()


def _said(sentence: Column, names: Column) -> Column:
    """array<struct<a, b, relation>>: of each strong verb the longest name before it and the first of the names behind it, from left to right without overlap."""
    hits = F.zip_with(
        F.zip_with(F.split(sentence, VERB, -1), F.regexp_extract_all(sentence, F.lit(VERB), F.lit(0)), lambda p, h: F.struct(F.length(p).alias("n"), h.alias("h"))),
        F.regexp_extract_all(sentence, F.lit(VERB), F.lit(1)),
        lambda x, v: F.struct(x["n"].alias("n"), x["h"].alias("h"), F.lower(v).alias("verb")),
    )
    low = F.lower(sentence)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("done"), F.expr("cast(array() as array<struct<a:string,b:string,relation:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["n"]
        end = at + F.length(x["h"])
        left, right = F.substring(low, acc["done"] + 1, at - acc["done"]), F.substring(low, end + 1, F.length(low))
        before = F.array_max(F.transform(F.filter(names, lambda n: F.endswith(left, n)), lambda n: F.struct(F.length(n).alias("k"), n.alias("n"))))["n"]
        behind = F.get(F.filter(names, lambda n: F.startswith(right, n)), F.lit(0))
        hit = before.isNotNull() & behind.isNotNull()
        one = F.array(F.struct(before.alias("a"), behind.alias("b"), x["verb"].alias("relation")))
        return F.struct(end.alias("at"), F.when(hit, end + F.length(behind)).otherwise(acc["done"]).alias("done"), F.when(hit & (before != behind), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.filter(hits, lambda x: x["h"].isNotNull()), start, step, lambda acc: acc["out"])


def relationships(memories: DataFrame, found: DataFrame) -> DataFrame:
    """(id, source, target, relation, weight): what a sentence says of two entities with a strong verb, else that they share it (the first six of a sentence).

    Names are lower-cased. Sentences are rows, names arrays; no pattern is made of names.
    """
    names = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: F.lower(x["name"])).alias("names")).filter(F.size("names") >= 2)
    rows = memories.select("id", "content").join(names, "id").select("id", "names", F.explode(F.split("content", SENTENCE_END)).alias("sentence"))
    rows = rows.withColumn("near", F.filter("names", lambda n: F.contains(F.lower("sentence"), n))).filter(F.size("near") >= 2)
    rows = rows.withColumn("said", _said(F.col("sentence"), F.col("names"))).withColumn("near", F.slice("near", 1, TOGETHER))
    pairs = F.flatten(F.transform("near", lambda x, i: F.transform(F.slice("near", i + 2, F.lit(TOGETHER)), lambda y: F.struct(x.alias("a"), y.alias("b"), F.lit("co-occurs-with").alias("relation")))))
    weak = F.filter(pairs, lambda p: ~F.exists("said", lambda s: ((s["a"] == p["a"]) & (s["b"] == p["b"])) | ((s["a"] == p["b"]) & (s["b"] == p["a"]))))
    each = rows.select("id", F.explode(F.concat(F.transform("said", lambda s: F.struct(s.alias("r"), F.lit(STRONG).alias("w"))), F.transform(weak, lambda s: F.struct(s.alias("r"), F.lit(WEAK).alias("w"))))).alias("e"))
    return each.select("id", F.col("e.r.a").alias("source"), F.col("e.r.b").alias("target"), F.col("e.r.relation").alias("relation"), F.col("e.w").alias("weight")).distinct()


def entity_id(name: Column) -> Column:
    """An entity's id: of its name in any case."""
    return F.md5(F.lower(name))


def tables(memories: DataFrame, known: Sequence[tuple[str, str, str]] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities (id, name, type, aliases), mentions (id, entity, memory) and relations (id, source, target, relation, weight, memory) of memories (id, content).

    Their ids follow from what they say, so rows that are made again have the ids of those that are there.
    """
    found = stored(entities(memories, known), f"{workspace(memories.sparkSession, 'entities')}/found")
    nodes = upserted(found).select(F.md5("entity").alias("id"), "name", "type", F.expr("cast(array() as array<string>)").alias("aliases"))
    mentions = found.select(entity_id(F.col("name")).alias("entity"), F.col("id").alias("memory")).distinct()
    mentions = mentions.select(F.md5(F.concat_ws("|", "entity", F.col("memory").cast("string"))).alias("id"), "entity", "memory")
    edges = relationships(memories, found).select(F.md5("source").alias("source"), F.md5("target").alias("target"), "relation", "weight", F.col("id").alias("memory"))
    edges = edges.select(F.md5(F.concat_ws("|", "source", "target", "relation", F.col("memory").cast("string"))).alias("id"), "source", "target", "relation", "weight", "memory")
    return nodes, mentions, edges


def query_entities(entities_: DataFrame, text: str, known: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """(entity): the entities that a query names: by name in any case, or the shortest name that contains it."""
    spark = entities_.sparkSession
    asked = entities(spark.createDataFrame([(0, text)], "id long, content string"), known).select(F.lower("name").alias("asked"))
    near = entities_.join(F.broadcast(asked), F.contains(F.lower("name"), F.col("asked")))  # asked has the few names of one query
    rank = F.struct((F.lower("name") != F.col("asked")).alias("other"), F.length("name").alias("n"), "id")
    return near.groupBy("asked").agg(F.min_by("id", rank).alias("entity")).select("entity").distinct()


# ---- queries; entities (id, name, type), edges (source, target, relation, weight) ----


def lookup(entities_: DataFrame, name: str) -> DataFrame:
    """The entity of that name in any case, or else the one with the shortest name that contains it."""
    low = name.lower()
    near = entities_.filter(F.lower("name").contains(low))
    return near.orderBy((F.lower("name") == low).desc(), F.length("name"), "id").limit(1)


def fuzzy(entities_: DataFrame, part: str, limit: int = 20) -> DataFrame:
    """Entities whose name, or one of whose aliases, has the part, in any case."""
    has = F.lower("name").contains(part.lower())
    if "aliases" in entities_.columns:
        has = has | F.coalesce(F.exists("aliases", lambda x: F.lower(x).contains(part.lower())), F.lit(False))
    return entities_.filter(has).orderBy("name", "id").limit(limit)


def of_entity(edges: DataFrame, entities_: DataFrame, id_: str) -> DataFrame:
    """(direction, relation, weight, other, name): the relationships of one entity, both ways."""
    other = entities_.select(F.col("id").alias("other"), "name")
    out = edges.filter(F.col("source") == id_).select(F.lit("out").alias("direction"), "relation", "weight", F.col("target").alias("other"))
    into = edges.filter(F.col("target") == id_).select(F.lit("in").alias("direction"), "relation", "weight", F.col("source").alias("other"))
    return out.unionByName(into).join(other, "other").select("direction", "relation", "weight", "other", "name")


def mentioning(mentions: DataFrame, memories: DataFrame, ids: DataFrame, limit: int = 10) -> DataFrame:
    """(memory, content, deleted): the first `limit` memories by id that mention any of the entities (entity); of a deleted one the content is "(deleted)"."""
    found = linked_memories(mentions, ids).orderBy("memory").limit(limit)
    rows = memories.select(F.col("id").alias("memory"), "content", F.lit(False).alias("deleted"))
    return found.join(rows, "memory", "left").select("memory", F.when(F.col("deleted").isNull(), "(deleted)").otherwise(F.col("content")).alias("content"), F.col("deleted").isNull().alias("deleted"))


def linked_memories(mentions: DataFrame, ids: DataFrame) -> DataFrame:
    """The memories (memory) that mention any of the entities (entity)."""
    return mentions.join(ids.select("entity"), "entity", "left_semi").select("memory").distinct()


def traverse(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(id, depth, parent, label): breadth first from the entities of start (id), along edges either way; of several parents the smallest id (then label)."""
    spark = edges.sparkSession
    place = workspace(spark, "traverse")
    steps = edges.select(F.col("source").alias("parent"), F.concat(F.lit("→"), "relation", F.lit("→")).alias("label"), F.col("target").alias("id")).union(edges.select("target", F.concat(F.lit("←"), "relation", F.lit("←")), "source"))
    seen = start.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("label"))
    front = seen
    for d in range(1, depth + 1):
        found = steps.join(front.select(F.col("id").alias("parent")), "parent").join(seen.select("id"), "id", "left_anti")
        front = stored(found.groupBy("id").agg(F.min(F.struct("parent", "label")).alias("p")).select("id", F.lit(d).alias("depth"), "p.parent", "p.label"), f"{place}/{d}")
        seen = seen.union(front)
    return seen


def degrees(edges: DataFrame, entities_: DataFrame) -> DataFrame:
    """(id, name, degree) of every entity, those without relationships too."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target"))
    return entities_.select("id", "name").join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
