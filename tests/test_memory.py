"""The whole store: what is saved is found, changed, merged and deleted, and what hangs on it follows."""

import json
import math
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from remembra.memory import Memory
from remembra.operators.bm25 import TextIndex, bm25
from remembra.operators.search import Options
from remembra.sources import files
from remembra.sources.store import Store, workspace
from remembra.streaming import sessions


def at(day=1, hour=0):
    return F.lit(datetime(2024, 6, day, hour)).cast("timestamp")


def embedder():
    def embed(texts):
        """Words counted in 32 places, unit length."""
        out = []
        for t in texts:
            v = [0.0] * 32
            for w in re.findall("[a-z]+", t.lower()):
                v[sum(map(ord, w)) * 7 % 32] += 1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out

    return embed


@pytest.fixture
def memory(spark):
    return Memory(spark, workspace(spark, "memory"), embedder(), 32, buckets=4)


TEXTS = ["Acme Labs uses Big Data Systems. Then Ada Lovelace joined.", "The cat sleeps on the warm windowsill every day", "Postgres backups run nightly at two", "The cat sleeps on the warm windowsill every single day", "Deploy the api with git push"]


def saved(spark, memory):
    df = spark.createDataFrame([(t, "fact" if i % 2 else None, 0.9 if i == 3 else None) for i, t in enumerate(TEXTS)], "content string, type string, importance double")
    return {r.content: r.id for r in memory.save(df, at()).collect()}


def test_save_search_update_dedup_delete(spark, memory):
    ids = saved(spark, memory)
    assert memory.read().count() == 5 and all(len(i) == 36 for i in ids.values())
    found = memory.search("warm cat windowsill", at(2)).collect()
    assert {r.id for r in found[:2]} == {ids[TEXTS[1]], ids[TEXTS[3]]} and found[0].score >= found[1].score
    touched = {r.id: r for r in memory.read().collect()}
    assert touched[found[0].id].access_count == 1 and touched[found[0].id].accessed_at == datetime(2024, 6, 2)
    # the same texts again: none are new, unless they are let in
    assert memory.save(spark.createDataFrame([(TEXTS[2],), ("brand new words",), ("brand new words",)], "content string"), at(2), dedup=True).count() == 1
    assert memory.save(spark.createDataFrame([(TEXTS[2],)], "content string"), at(2)).count() == 1 and memory.read().count() == 7
    assert memory.purge_copies() == 1 and memory.read().count() == 6

    changed = memory.update(spark.createDataFrame([(ids[TEXTS[2]], "MySQL snapshots happen weekly. They are kept", None), ("nobody", "x", None)], "id string, content string, namespace string"), at(3)).collect()
    assert len(changed) == 1 and changed[0].l0_content.startswith("MySQL snapshots") and changed[0].updated_at == datetime(2024, 6, 3) and changed[0].created_at == datetime(2024, 6, 1) and changed[0].namespace == "general"
    assert [r.id for r in memory.search("mysql snapshots weekly", at(3)).collect()][0] == ids[TEXTS[2]]
    assert memory.search("nightly postgres", at(3), Options(min_vector_score=0.99)).count() == 0

    groups = memory.dedup(0.9).collect()
    assert [(r.keep, r.id) for r in groups] == [(ids[TEXTS[3]], ids[TEXTS[1]])] and groups[0].similarity >= 0.9
    assert memory.read().count() == 6
    memory.dedup(0.9, auto=True)
    assert memory.read().count() == 5 and ids[TEXTS[1]] not in {r.id for r in memory.read().collect()}
    assert memory.delete(spark.createDataFrame([(ids[TEXTS[4]],), ("nobody",)], "id string")) == 1
    assert memory.search("deploy api git push", at(3), Options(min_vector_score=0.99)).count() == 0
    with pytest.raises(ValueError):
        memory.save(spark.createDataFrame([("x", "no such type")], "content string, type string"), at())


def test_index_equals_a_full_scan(spark, memory):
    saved(spark, memory)
    memory.save(spark.createDataFrame([("the cat and the dog",), ("the the the",)], "content string"), at())
    memory.delete(memory.read().filter("content = 'the the the'").select("id"))
    memory.update(memory.read().filter("content like 'Postgres%'").select("id", F.lit("the backups of the cat").alias("content")), at())
    queries = spark.createDataFrame([(0, "the"), (0, "cat"), (1, "api"), (1, "absent")], "q int, term string")
    rows = lambda df: sorted((r.q, r.id, r.bm25) for r in df.collect())
    want = rows(bm25(memory.read(), queries))
    assert len(want) > 4 and rows(memory.index.bm25(queries)) == want and rows(memory.index.bm25(queries, ["the", "cat", "api", "absent"])) == want
    memory.rebuild_index()
    assert rows(memory.index.bm25(queries)) == want
    assert TextIndex(spark, workspace(spark, "empty")).bm25(queries).count() == 0


def test_graph_follows(spark, memory):
    ids = saved(spark, memory)
    names = {r.name for r in memory.entities.read().collect()}
    assert {"Acme Labs", "Big Data Systems", "Ada Lovelace"} <= names
    by = {r.id: r.name for r in memory.entities.read().collect()}
    assert ("Acme Labs", "Big Data Systems", "uses") in {(by[r.source], by[r.target], r.relation) for r in memory.relations.read().collect()}
    assert {r.id for r in memory.boosted("Then what of Ada Lovelace?").collect()} == {ids[TEXTS[0]]}
    plain = {r.id: r.score for r in memory.search("Then what of Ada Lovelace? cat", at(), Options(min_score=0.0, min_vector_score=0.0), touch=False).collect()}
    more = {r.id: r.score for r in memory.search("Then what of Ada Lovelace? cat", at(), Options(min_score=0.0, min_vector_score=0.0), graph_boost=True, touch=False).collect()}
    assert abs(more[ids[TEXTS[0]]] - min(1.0, plain[ids[TEXTS[0]]] + 0.15)) < 1e-9
    before = (memory.entities.read().count(), memory.mentions.read().count(), memory.relations.read().count())
    memory.link(memory.read())
    assert before == (memory.entities.read().count(), memory.mentions.read().count(), memory.relations.read().count())
    assert memory.backfill_graph() == memory.read().count() - 1


def test_upkeep(spark, memory):
    ids = saved(spark, memory)
    assert memory.decay(at(3)).count() == 0
    later = F.lit(datetime(2024, 8, 1)).cast("timestamp")
    fell = {r.id: r.decayed for r in memory.decay(later, apply=True).collect()}
    assert len(fell) == 5 and {r.id: r.importance for r in memory.read().collect()} == fell
    assert memory.curate(later).count() == 5
    assert {r.namespace for r in memory.lay_out(["myapp"]).collect()} == set()
    assert memory.consolidate(later, 0.9).count() == 1 and memory.read().count() == 5
    memory.consolidate(later, 0.9, dry_run=False)
    rows = memory.read().collect()
    assert len(rows) == 4
    made = [r for r in rows if r.source == "consolidation"][0]
    assert set(json.loads(made.metadata)["supersededIds"]) == {ids[TEXTS[1]], ids[TEXTS[3]]} and made.importance == 0.7
    assert memory.curate(later, delete=True).count() == 3 and memory.read().count() == 1
    size = memory.storage()
    assert size["table_mb"] > 0 and size["index_mb"] > 0 and abs(size["table_mb"] + size["index_mb"] - size["total_mb"]) < 0.02


def test_beliefs_and_contradictions(spark, memory):
    say = lambda text, sure, day: memory.save_beliefs(spark.createDataFrame([(text, sure, "ops")], "content string, confidence double, domain string"), at(day)).first()
    first = say("The payment service is working fine today", 0.6, 1)
    again = say("The payment service is working fine today", 0.7, 2)
    assert first.merged_into is None and again.merged_into == first.id and memory.read().count() == 1
    meta = json.loads(memory.read().first().metadata)
    assert meta["confidence"] == 0.7 and [h["reason"] for h in meta["history"]] == ["initial belief", "updated via saveBelief"]
    memory.save(spark.createDataFrame([("The payment service is not working fine today", "fact"), ("payment problems all over", "fact")], "content string, type string"), at(3))
    against, supporting = memory.challenge(first.id, at(4))
    assert against.count() >= 1 and supporting.count() >= 1 and {r.belief for r in against.collect()} == {first.id}
    assert json.loads(memory.store.get(first.id).first().metadata)["last_challenged"].startswith("2024-06-04")
    # a surer belief that contradicts it
    new = memory.save(spark.createDataFrame([("The payment service is not working fine today", "belief", json.dumps({"confidence": 0.9, "domain": "ops", "status": "active"}))], "content string, type string, metadata string"), at(5), check=True).first()
    pairs = memory.conflicts.read().collect()
    assert {(first.id, new.id), (new.id, first.id)} & {(p.memory_a, p.memory_b) for p in pairs} and all(p.kind for p in pairs)
    old = json.loads(memory.store.get(first.id).first().metadata)
    assert old["status"] == "superseded" and old["supersededBy"] == new.id
    count = len(pairs)
    memory.check(memory.store.get(new.id), at(6))
    assert memory.conflicts.read().count() == count


def test_changes_of_state(spark, memory):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    made = {}
    for kind, text, meta in (("belief", "Tea is better than coffee", {"confidence": 0.5, "domain": "food", "note": "kept"}), ("belief", "The sky is blue", None), ("prediction", "It rains tomorrow", {"status": "open", "confidence": 0.8}), ("follow-up", "Call Ada", {"status": "open", "holder": "me"}), ("fact", "Water is wet", None)):
        made[text] = (kind, json.dumps(meta) if meta else None)
    ids = {r.content: r.id for r in memory.save(frame([(t, k, m) for t, (k, m) in made.items()], "content string, type string, metadata string"), at()).collect()}
    tea, sky, rain, call, wet = (ids[t] for t in made)
    got = {r.id: r for r in memory.reweigh(frame([(tea, 0.9, "tasted"), (sky, 0.2, "clouds"), (wet, 0.1, "no belief")], "id string, new_confidence double, reason string"), at(2)).collect()}
    assert set(got) == {tea, sky} and got[tea].importance == 0.9 and got[sky].importance == 0.6
    memory.judge(frame([(tea, "confirmed", "again")], "id string, verdict string, why string"), at(3))
    memory.settle(frame([(rain, "wrong", "dry"), (tea, "wrong", "no prediction")], "id string, outcome string, text string"), at(3))
    memory.follow_up(frame([(call, "called")], "id string, text string"), at(4))
    with pytest.raises(ValueError):
        memory.judge(frame([(sky, "maybe", "x")], "id string, verdict string, why string"), at(3))
    rows = {r.id: r for r in memory.read().collect()}
    meta = {i: json.loads(r.metadata) for i, r in rows.items() if r.metadata}
    assert (meta[tea]["confidence"], meta[tea]["status"], meta[tea]["times_confirmed"], meta[tea]["note"], meta[tea]["domain"]) == (0.9, "confirmed", 2, "kept", "food")
    assert [(h["confidence"], h["reason"]) for h in meta[tea]["history"]] == [(0.9, "tasted"), (0.9, "confirmed: again")] and meta[tea]["last_challenged"].startswith("2024-06-03")
    assert meta[sky]["times_refuted"] == 1 and meta[rain]["status"] == "wrong" and meta[rain]["resolution"] == "dry" and meta[call]["status"] == "resolved"
    assert rows[tea].updated_at == datetime(2024, 6, 3) and rows[wet].updated_at == datetime(2024, 6, 1)
    # contradictions by hand, and deletion by prefix
    memory.conflicts.append(frame([("ab1", tea, sky, 0.6, "negation", datetime(2024, 6, 1), None, None), ("ab2", tea, wet, 0.5, "negation", datetime(2024, 6, 1), None, None)], "id string, memory_a string, memory_b string, score double, kind string, created_at timestamp, resolution string, resolved_at timestamp"))
    assert memory.resolve("ab", "both hold", at(5)) and not memory.resolve("ab1", "again", at(6)) and not memory.resolve("zz", "none", at(6))
    assert {r.id: r.resolution for r in memory.conflicts.read().collect()} == {"ab1": "both hold", "ab2": None}
    assert not memory.delete_prefix("") and memory.delete_prefix(wet[:30]) and memory.read().count() == 4
    assert memory.index.bm25(frame([(0, "wet")], "q int, term string")).count() == 0 and wet not in {r.id for r in memory.vectors.rows.read().collect()}


def test_store_recovers(spark):
    store = Store(spark, workspace(spark, "store"), {"note": "none"})
    store.append(spark.createDataFrame([(k, f"t{k}", "fact" if k % 2 else "belief") for k in range(10)], "id long, content string, type string"))

    def fails(_):
        raise RuntimeError("lost")

    broken = spark.createDataFrame([(99, "x", "fact")], "id long, content string, type string").withColumn("content", F.udf(fails, "string")("content"))
    for _ in range(2):
        with pytest.raises(Exception):
            store.append(broken)
        assert store.read().count() == 10
    store.append(spark.createDataFrame([(10, "t10", "fact", "new")], "id long, content string, type string, note string"))
    assert {(r.id, r.note) for r in store.read().filter("id >= 9").collect()} == {(9, "none"), (10, "new")}
    # a writer that was lost while it wrote a version
    path = store._path(f"{store.folder}/versions/{store.version() + 1:012d}.json")
    store._fs.create(path, False).close()
    assert store.read().count() == 11
    with pytest.raises(RuntimeError):
        store.delete(spark.createDataFrame([(1,)], "id long"))
    store._fs.setTimes(path, 1000, 1000)
    store.delete(spark.createDataFrame([(1,)], "id long"))
    assert store.read().count() == 10
    store.update(spark.createDataFrame([(2, "changed", None), (3, None, None)], "id long, content string, note string"), also_nulls=["note"])
    got = {r.id: r for r in store.read().collect()}
    assert got[2].content == "changed" and got[3].content == "t3" and got[2].note is None and got[4].note == "none"
    # two writers of one version
    number, segments = store._version()
    store.delete(spark.createDataFrame([(4,)], "id long"))
    with pytest.raises(Exception):
        store._commit(number, segments)
    assert "PartitionFilters: [" in store.read().filter("type = 'belief'")._jdf.queryExecution().toString()
    store.compact()
    store.vacuum()
    assert {r.id for r in store.read().collect()} == {0, 2, 3, 5, 6, 7, 8, 9, 10} and len(store._numbers()) == 1


def test_files_and_sessions(spark, memory, tmp_path):
    for name in ("a.md", "b.MD", "c.Txt", "d.json"):
        (tmp_path / name).write_text("x")
    found = files.text_files(spark, str(tmp_path))
    assert sorted(r.file.rsplit("/", 1)[1] for r in found.collect()) == ["a.md", "b.MD", "c.Txt"]
    ledger = found.filter("file like '%a.md'").select("file")
    assert files.not_taken(found, ledger).count() == 2 and files.not_taken(found, ledger, limit=1).count() == 1 and files.not_taken(found, ledger, force=True).count() == 3
    (tmp_path / "known.json").write_text(json.dumps([{"pattern": "acme", "name": "Acme", "type": "project"}]))
    (tmp_path / "bad.json").write_text("{")
    assert files.known_entities(spark, str(tmp_path / "known.json")) == [("acme", "Acme", "project")]
    assert files.known_entities(spark, str(tmp_path / "bad.json")) == files.known_entities(spark, str(tmp_path / "none.json")) == []
    rows = spark.createDataFrame([("s1", k, f"How do I deploy number {k}?", f"Push it with git push, as decided in step {k}.", ["bash"]) for k in range(3)], "session string, exchange long, user string, assistant string, tools array<string>")
    take = sessions.sessions_into(memory, at())
    take(rows, 0)
    take(rows, 1)
    got = memory.read().collect()
    assert sorted(r.type for r in got) == ["episodic"] * 3 + ["session"] and json.loads([r for r in got if r.type == "session"][0].metadata)["exchangeCount"] == 3
