"""The store with all that hangs on it: vectors, the inverted index, the graph and the contradictions, kept in step by each change."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remembra.functions import tiers
from remembra.operators import beliefs, clusters, contradictions, graph, maintenance, search, writes
from remembra.operators.blocks import knn
from remembra.operators.bm25 import TextIndex
from remembra.operators.metric import VectorIndex
from remembra.schemas import METADATA
from remembra.sources.log import Log
from remembra.sources.store import Store, stored, workspace

#: Neighbours that a new memory is checked against, and their least similarity.
CHECKED, CHECKED_SIMILARITY = 10, 0.5
HASH = "sha2(concat_ws('|', {}), 256)"


def whole(change):
    """All that a method changes takes effect together, if it does not fail."""

    @wraps(change)
    def run(self: Memory, *args, **options):
        with self.log.transaction():
            return change(self, *args, **options)

    return run


class Memory:
    """Memories in a folder: rows with vectors, postings, entities, mentions, relations and contradictions.

    embed(texts) gives vectors of `dimensions` components; it runs in the tasks. Every change takes its time, as_of. What a change does to the rows, the two
    indexes, the graph and the contradictions is one version of one log, so it takes effect at once or not at all; two changes at once that touch
    different rows both succeed. Searches add touches, which meet nothing. Each part can be made again from the rows (rebuild_index, backfill_graph).
    """

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[list[str]], Sequence[Sequence[float]]], dimensions: int, known: Sequence[tuple[str, str, str]] = (), buckets: int = 64):
        self.spark, self.embed, self.dimensions, self.known = spark, embed, dimensions, known
        self.log = Log(spark, folder)
        part = lambda name: Store(spark, folder, log=self.log, part=name, unique=name in ("entities", "mentions", "relations"))
        self.store, self.index, self.vectors = part("memories"), TextIndex(spark, folder, buckets=buckets, log=self.log), VectorIndex(spark, folder, self.log)
        self.entities, self.mentions, self.relations, self.conflicts = map(part, ("entities", "mentions", "relations", "contradictions"))

    def read(self) -> DataFrame:
        return self.store.read()

    def _made(self, rows: DataFrame) -> DataFrame:
        return stored(rows, f"{workspace(self.spark, 'memory')}/rows")

    # ---- writing ----

    def save(self, inputs: DataFrame, as_of: Column, dedup: bool = False, check: bool = False, source: str = "cli", importance: float | None = None, batch: str | None = None) -> DataFrame:
        """Take in inputs (content, and any of the columns that writes.prepared names); the rows that were made.

        batch: a name of this save; if one of that name has been committed, nothing is done and no rows are told. dedup: those whose content is there, or earlier in the batch, are left out. check: contradictions with similar memories are
        looked for, and beliefs that a new one contradicts are superseded. Invalid inputs raise, and nothing is taken.
        """
        with self.log.transaction(batch) as now:
            if now.done:
                return self.read().limit(0)
            bad = writes.invalid(inputs).select("reason").first()
            if bad is not None:
                raise ValueError(f"not taken: {bad.reason}")
            rows = writes.prepared(writes.imported(inputs), as_of, source, importance)
            if dedup:
                there = self.read() if self.store.exists() else rows.limit(0)
                rows = maintenance.new_rows(rows, there).drop("hash")
            # the same text may be saved again: the time and a number tell the rows apart
            rows = rows.withColumn("id", writes.row_id(F.col("id"), F.unix_micros(as_of).cast("string"), F.lit(uuid.uuid4().hex)))
            made = self._made(writes.embedded(rows, self.embed, self.dimensions))
            self._take(made)
            if check:
                self.check(made, as_of)
            return made

    @whole
    def _take(self, made: DataFrame) -> None:
        self.store.append(made)
        self.index.add(made)
        self.vectors.add(made)
        self.link(made)

    @whole
    def save_beliefs(self, statements: DataFrame, as_of: Column) -> DataFrame:
        """Take in beliefs (content, confidence, domain, and any of holder, evidence, tags). (id, merged_into): one that restates a belief that
        is there changes that one's confidence, domain and history instead of being saved."""
        rows = writes.beliefs(statements, as_of)
        rows = rows.withColumn("id", writes.row_id(F.col("id"), F.unix_micros(as_of).cast("string"), F.lit(uuid.uuid4().hex)))
        new = self._made(writes.embedded(rows, self.embed, self.dimensions))
        held = self.read().filter("type = 'belief'") if self.store.exists() else new.limit(0)
        near = knn(new.select("id", "vector"), held.select("id", "vector"), 1).withColumn("vector_score", 1 / (1 + F.col("distance")))
        told = self._made(beliefs.stated_again(new, near))
        fresh = told.filter("merged_into is null").drop("merged_into")
        if not fresh.isEmpty():
            self._take(self._made(fresh))
        again = told.filter("merged_into is not null")
        if not again.isEmpty():
            said = again.select(F.col("merged_into").alias("id"), F.from_json("metadata", METADATA["belief"]).alias("n"), "created_at")
            said = said.groupBy("id").agg(F.max_by("n", "created_at").alias("n"))
            old = held.join(said, "id").withColumn("m", F.from_json("metadata", METADATA["belief"]))
            step = F.array(F.struct(as_of.alias("date"), F.col("n.confidence"), F.lit("updated via saveBelief").alias("reason")))
            history = F.concat(F.coalesce("m.history", F.expr(f"cast(array() as {writes.HISTORY})")), step)
            meta = F.col("m").withField("confidence", F.col("n.confidence")).withField("domain", F.col("n.domain")).withField("last_challenged", as_of).withField("history", history)
            self.store.update(self._made(old.select("id", F.to_json(meta).alias("metadata"))))
        return told.select("id", "merged_into")

    @whole
    def challenge(self, id_: str, as_of: Column, limit: int = 10) -> tuple[DataFrame, DataFrame]:
        """Of a belief the memories that may contradict it (belief, rank, id, score), and those that support it (id, score); its metadata says when it was challenged."""
        found = self.store.get(id_).filter("type = 'belief'").select("id", "content", "metadata", writes.challenge_queries(F.col("content")).alias("queries")).first()
        if found is None:
            raise ValueError(f"no belief {id_}")
        options = search.Options(limit=limit)
        parts = [self.search(q, as_of, options).select(F.lit(found.id).alias("belief"), F.lit(k).alias("query_no"), "id", "type", "score") for k, q in enumerate(found.queries)]  # six queries at most
        against = self._made(writes.challenged(reduce(DataFrame.union, parts), limit))
        supporting = self._made(self.search(found.content, as_of, options).filter((F.col("id") != found.id) & (F.col("type") != "belief")).select("id", "score"))
        meta = F.from_json("metadata", METADATA["belief"]).withField("last_challenged", as_of)
        self.store.update(self._made(self.read().filter(F.col("id") == found.id).select("id", F.to_json(meta).alias("metadata"))))
        return against, supporting

    @whole
    def update(self, changes: DataFrame, as_of: Column) -> DataFrame:
        """Columns of changes (id, any of content, namespace, type, importance, tags, metadata) replace those of the rows; short forms, vectors and
        postings follow the content. The rows as they are now; ids that are not there have none."""
        rows = self.read()
        names = [c for c in changes.columns if c != "id"]
        new = rows.join(changes.select("id", *(F.col(c).alias(f"__{c}") for c in names)), "id")
        new = new.select(*(F.coalesce(F.col(f"__{c}").cast(rows.schema[c].dataType), F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns))
        c = F.col("content")
        new = new.withColumns({"l0_content": tiers.l0(c), "l1_content": tiers.l1(c), "updated_at": as_of})
        made = self._made(writes.embedded(new.drop("vector"), self.embed, self.dimensions).select(*rows.columns))
        self.store.replace(made)
        for index in (self.index, self.vectors):
            index.remove(made)
            index.add(made)
        return made

    @whole
    def delete(self, ids: DataFrame) -> int:
        """Delete the rows of ids (id); how many were there."""
        gone = self._made(self.read().join(ids.select("id").distinct(), "id", "left_semi").select("id"))
        count = gone.count()
        if count:
            self.store.delete(gone)
            self.index.remove(gone)
            self.vectors.remove(gone)
        return count

    @whole
    def delete_prefix(self, prefix: str) -> bool:
        """Delete the one row whose id starts so, its postings and its vector; False, and nothing changes, if there is none or more than one."""
        found = self.read().filter(F.col("id").startswith(prefix)).select("id").limit(2).collect()
        return len(found) == 1 and self.delete(self.spark.createDataFrame([(found[0].id,)], "id string")) == 1

    # ---- changes of state ----

    def _typed(self, kind: str, changes: DataFrame) -> DataFrame:
        """The rows of a type that changes (id) name, their metadata as columns besides as text."""
        rows = self.read().filter(F.col("type") == kind).join(changes.select("id").distinct(), "id", "left_semi")
        rows = rows.select("id", "type", "importance", "metadata", F.col("metadata").alias("__text"))
        return beliefs.typed(rows, kind).withColumnRenamed("__text", "metadata")

    def _restate(self, kind: str, rows: DataFrame, as_of: Column) -> DataFrame:
        """Write back what the columns of a type's rows say; (id, metadata, importance)."""
        made = self._made(rows.select("id", beliefs.encoded(kind).alias("metadata"), "importance", as_of.alias("updated_at")))
        if not made.isEmpty():
            self.store.update(made)
        return made.drop("updated_at")

    @whole
    def reweigh(self, changes: DataFrame, as_of: Column) -> DataFrame:
        """Give beliefs the confidences of changes (id, new_confidence, reason), one for each id: counted as confirmed or refuted against the old one (0.5 without), added to the
        history, and the importance follows. The beliefs that changed, (id, metadata, importance); ids of no belief do nothing."""
        held = self._typed("belief", changes).withColumn("confidence", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5)))
        return self._restate("belief", beliefs.reweighed(held, changes, as_of).withColumn("last_challenged", as_of), as_of)

    @whole
    def judge(self, verdicts: DataFrame, as_of: Column) -> DataFrame:
        """Take verdicts (id, verdict: confirmed or refuted, why) on beliefs into their status, counters and history; as reweigh."""
        bad = verdicts.filter(~F.coalesce(F.col("verdict").isin("confirmed", "refuted"), F.lit(False))).first()
        if bad is not None:
            raise ValueError(f"no verdict: {bad.verdict}")
        return self._restate("belief", writes.judged(self._typed("belief", verdicts), verdicts, as_of), as_of)

    @whole
    def settle(self, outcomes: DataFrame, as_of: Column) -> DataFrame:
        """Take outcomes (id, outcome: correct, wrong or partial, text) of predictions into their status and resolution; as reweigh."""
        bad = writes.invalid(outcomes).select("reason").first()
        if bad is not None:
            raise ValueError(f"not taken: {bad.reason}")
        return self._restate("prediction", writes.settled(self._typed("prediction", outcomes), outcomes, as_of), as_of)

    @whole
    def follow_up(self, resolutions: DataFrame, as_of: Column) -> DataFrame:
        """Resolve the follow-ups of resolutions (id, text); as reweigh."""
        outcomes = resolutions.select("id", F.lit("resolved").alias("outcome"), "text")
        return self._restate("follow-up", writes.settled(self._typed("follow-up", outcomes), outcomes, as_of), as_of)

    def conflict(self, id_: str) -> DataFrame:
        """The contradiction with a whole id, or the first by id of those that start with it; none if there is none."""
        return self.conflicts.get(id_, 64) if self.conflicts.exists() else self.spark.createDataFrame([], "id string, memory_a string, memory_b string, score double, kind string, resolution string, resolved_at timestamp")

    @whole
    def resolve(self, id_: str, text: str, as_of: Column) -> bool:
        """Resolve a contradiction that is not yet (see conflict); whether there was one."""
        found = self._made(contradictions.resolved(self.conflict(id_).filter("resolved_at is null"), F.col("id"), text, as_of).select("id", "resolution", "resolved_at"))
        if not found.isEmpty():
            self.conflicts.update(found)
        return not found.isEmpty()

    # ---- searching ----

    def search(self, text: str, as_of: Column, options: search.Options = search.Options(), graph_boost: bool = False, touch: bool = True) -> DataFrame:
        """The ranked result; touch: the rows that it has count as accessed."""
        words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        boosted = self.boosted(text) if graph_boost and self.entities.exists() else None
        rows = self.read()
        found = self._made(search.search(rows, rows.select("id", "vector"), list(map(float, self.embed([text])[0])), words, as_of, options, boosted, self.index, self.vectors))
        if touch and not found.isEmpty():
            self.store.fold(search.touched(found, as_of))
        return found.orderBy(F.col("score").desc(), "id")

    def boosted(self, text: str) -> DataFrame:
        """(id): the memories that mention an entity of the text."""
        asked = graph.query_entities(self.entities.read(), text, self.known)
        return graph.linked_memories(self.mentions.read(), asked).withColumnRenamed("memory", "id")

    def mentioning(self, name: str, limit: int = 10) -> DataFrame:
        """(memory, content, deleted): memories that mention the entity that a name finds; deleted ones are told as such."""
        asked = graph.lookup(self.entities.read(), name).select(F.col("id").alias("entity"))
        return graph.mentioning(self.mentions.read(), self.read(), asked, limit)

    # ---- what hangs on the rows ----

    @whole
    def link(self, rows: DataFrame) -> None:
        """Take the entities, mentions and relations of rows into the graph; what is there stays as it is."""
        for part, new in zip((self.entities, self.mentions, self.relations), graph.tables(rows.select("id", "content"), self.known), strict=True):
            part.append(new.join(part.read().select("id"), "id", "left_anti") if part.exists() else new)

    @whole
    def backfill_graph(self) -> int:
        """Link the memories that no entity mentions yet; how many there are."""
        rows = self.read()
        if self.mentions.exists():
            rows = rows.join(self.mentions.read().select(F.col("memory").alias("id")).distinct(), "id", "left_anti")
        rows = self._made(rows.select("id", "content"))
        self.link(rows)
        return rows.count()

    @whole
    def rebuild_index(self) -> None:
        """Make both indexes anew from the rows."""
        self.index.build(self.read())
        self.vectors.build(self.read())

    @whole
    def check(self, new: DataFrame, as_of: Column, least: float = CHECKED_SIMILARITY) -> DataFrame:
        """least: the similarity from which a memory is compared (0.4 for a check by hand). (memory_a, memory_b, score, kind) of contradictions of new rows with similar ones; they are kept, the best score of each pair, and
        beliefs that a surer new one contradicts are superseded."""
        rows = self.read()
        near = self.vectors.nearest(new.select(F.col("id").alias("q"), "vector"), CHECKED, own=False).withColumn("vector_score", 1 / (1 + F.col("distance")))
        found = self._made(writes.check_new(new, near, rows, least))
        pairs = contradictions.upserted(found.withColumn("at", F.lit(0)))
        pairs = pairs.withColumn("id", F.expr(HASH.format("memory_a, memory_b"))).withColumn("created_at", as_of).withColumns({"resolution": F.lit(None).cast("string"), "resolved_at": F.lit(None).cast("timestamp")})
        if self.conflicts.exists():
            old = self.conflicts.read().select("id", F.col("score").alias("__s"), F.col("kind").alias("__k"), F.col("created_at").alias("__c"), F.col("resolution").alias("__r"), F.col("resolved_at").alias("__t"))
            pairs = pairs.join(old, "id", "left")
            pairs = pairs.select("memory_a", "memory_b", F.greatest("score", "__s").alias("score"), F.coalesce("__k", "kind").alias("kind"), "id", F.coalesce("__c", "created_at").alias("created_at"), F.coalesce("__r", "resolution").alias("resolution"), F.coalesce("__t", "resolved_at").alias("resolved_at"))
        pairs = self._made(pairs)
        if not pairs.isEmpty():
            self.conflicts.replace(pairs)
        self._supersede(found, as_of)
        return pairs.select("memory_a", "memory_b", "score", "kind")

    @whole
    def _supersede(self, found: DataFrame, as_of: Column) -> None:
        rows = self.read()
        held = beliefs.typed(rows, "belief").select("id", "confidence", "domain")
        done = self._made(contradictions.superseded(found.select(F.col("a").alias("new"), F.col("b").alias("old"), "score"), held))
        if done.isEmpty():
            return
        # an old belief is refuted, and its metadata says by which one
        old = rows.join(done.select(F.col("old").alias("id"), F.col("new").alias("__by")), "id")
        meta = F.from_json("metadata", "map<string,string>")
        told = F.map_concat(F.map_filter(F.coalesce(meta, F.create_map()), lambda k, v: ~k.isin("status", "supersededBy", "supersededAt")), F.create_map(F.lit("status"), F.lit("superseded"), F.lit("supersededBy"), F.col("__by"), F.lit("supersededAt"), as_of.cast("string")))
        self.store.update(old.select("id", F.to_json(told).alias("metadata")))
        resolve = done.filter("resolve").select(F.expr(HASH.format("least(old, new), greatest(old, new)")).alias("id"), F.concat(F.lit("superseded by "), "new").alias("resolution"), as_of.alias("resolved_at"))
        self.conflicts.update(resolve)

    # ---- upkeep ----

    @whole
    def dedup(self, least: float = 0.9, auto: bool = False) -> DataFrame:
        """(component, keep, id, similarity) of near duplicates that can go; auto: they go."""
        rows = self.read()
        found, links = clusters.groups(rows.select("id", "vector"), least)
        out = self._made(clusters.dedup_groups(found, links, rows))
        if auto:
            self.delete(out)
        return out

    @whole
    def consolidate(self, as_of: Column, least: float = 0.85, dry_run: bool = True) -> DataFrame:
        """(seed, member) of clusters of similar memories; unless dry_run, each becomes one memory and its members go."""
        rows = self.read()
        keys = rows.select("id", F.struct((-F.col("importance")).alias("i"), "id").alias("key"))
        found = self._made(clusters.leaders(rows.select("id", "vector"), keys, least))
        if not dry_run and not found.isEmpty():
            made, gone = writes.consolidated(found, rows, as_of)
            made, gone = self._made(made), self._made(gone)
            self.save(made.drop("id", "l0_content", "l1_content", "created_at", "updated_at", "accessed_at", "access_count"), as_of)
            self.delete(gone)
        return found

    @whole
    def decay(self, as_of: Column, apply: bool = False, **options: float) -> DataFrame:
        """The rows whose importance falls, and to what; apply: it does."""
        out = self._made(maintenance.decay(self.read(), as_of, **options))
        if apply and not out.isEmpty():
            self.store.update(out.select("id", F.col("decayed").alias("importance")))
        return out

    @whole
    def curate(self, as_of: Column, delete: bool = False, **options: float) -> DataFrame:
        """The rows that a look-through flags, with reasons; delete: they go."""
        out = self._made(maintenance.curate(self.read(), as_of, **options).select("id", "reasons"))
        if delete:
            self.delete(out)
        return out

    @whole
    def purge_copies(self) -> int:
        """Delete rows whose content an older row has; how many."""
        return self.delete(maintenance.duplicates(self.read()))

    @whole
    def lay_out(self, projects: Sequence[str] = tuple(maintenance.PROJECTS)) -> DataFrame:
        """Move rows to the namespaces that they belong to; (id, namespace) of those that moved."""
        rows = self.read().withColumn("__new", maintenance.laid_out(projects))
        moved = self._made(rows.filter(~F.col("__new").eqNullSafe(F.col("namespace"))).select("id", F.col("__new").alias("namespace")))
        if not moved.isEmpty():
            self.store.update(moved)
        return moved

    def storage(self) -> dict[str, float]:
        """Megabytes of the rows, of what hangs on them, and of both."""
        total, rows = round(self.log.megabytes(), 2), round(self.log.megabytes(self.store.part), 2)
        return {"table_mb": rows, "index_mb": round(total - rows, 2), "total_mb": total}
