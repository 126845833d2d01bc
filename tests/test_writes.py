"""What is written, on hand-made rows."""

import json
import re
from datetime import datetime

from pyspark.sql import functions as F

from remembra.operators import beliefs, clusters, writes
from remembra.operators.blocks import knn, similar_pairs


def as_of():
    return F.lit(datetime(2024, 6, 1)).cast("timestamp")


def test_prepared(spark):
    df = spark.createDataFrame([("a text", None, None), ("a text", None, None), ("other. More", "belief", 0.1)], "content string, type string, importance double")
    got = sorted(writes.prepared(df, as_of()).collect(), key=lambda r: r.content)
    assert [(r.type, r.importance, r.namespace, r.source) for r in got] == [("semantic", 0.5, "general", "cli")] * 2 + [("belief", 0.1, "general", "cli")]
    assert len({r.id for r in got}) == 3 and all(len(r.id) == 36 for r in got)
    again = {r.id for r in writes.prepared(df, as_of()).collect()}
    assert again == {r.id for r in got}
    assert {r.importance for r in writes.prepared(df.select("content"), as_of(), "mcp", 0.5).collect()} == {0.5}


def test_invalid(spark):
    df = spark.createDataFrame([("belief", 0.5, "2024-01-01"), ("nothing", 2.0, "soon"), (None, None, None)], "type string, confidence double, deadline string")
    assert [r.reason for r in writes.invalid(df).collect()] == ["type, confidence, deadline"]


def test_consolidation(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.05]), (3, [0.98, 0.1]), (4, [0.0, 1.0])], "id long, vector array<double>")
    m = spark.createDataFrame([(1, "oatmeal for breakfast", "health", 0.5), (2, "breakfast is oatmeal " + "x" * 600, "health", 0.9), (3, "oatmeal again", "health", 0.5), (4, "ship it", "projects", 0.5)], "id long, content string, namespace string, importance double")
    keys = m.select("id", F.struct((-F.col("importance")).alias("i"), "id").alias("key"))
    found = clusters.leader_clusters(similar_pairs(vectors, 0.85), keys)
    made, gone = writes.consolidated(found, m, as_of())
    one = made.collect()
    assert len(one) == 1 and one[0].content.startswith("breakfast is oatmeal") and one[0].content.endswith("[consolidated from 3 memories]")
    assert one[0].namespace == "health" and json.loads(one[0].metadata)["supersededIds"] == ["2", "1", "3"]
    assert {r.id for r in gone.collect()} == {1, 2, 3}


def test_verdicts_and_outcomes(spark):
    meta = json.dumps({"confidence": 0.7, "status": "active"})
    b = beliefs.typed(spark.createDataFrame([(1, "belief", meta), (2, "belief", meta)], "id long, type string, metadata string"), "belief")
    got = {r.id: r for r in writes.judged(b, spark.createDataFrame([(1, "refuted", "seen")], "id long, verdict string, why string"), as_of()).collect()}
    assert got[1].status == "refuted" and got[1].times_refuted == 1 and got[1].history[0].reason == "refuted: seen" and got[2].status == "active"
    made = writes.predictions(spark.createDataFrame([("it rains", 0.9, "2024-07-01", "user", "weather")], "content string, confidence double, deadline string, holder string, domain string"), as_of())
    assert made.first().importance == 0.9
    p = beliefs.typed(made, "prediction")
    done = writes.settled(p, p.select("id").withColumn("outcome", F.lit("wrong")).withColumn("text", F.lit("sun")), as_of()).first()
    assert (done.status, done.resolution, done.domain) == ("wrong", "sun", "weather") and done.resolved_at == datetime(2024, 6, 1)
    assert writes.journal(spark.createDataFrame([("dear diary",)], "content string"), as_of()).first().tags == ["journal", "2024-06-01"]


def test_challenges(spark):
    q = spark.createDataFrame([("The product is not ready",), ("distribution is hard",)], "s string").select(writes.challenge_queries(F.col("s")).alias("q")).collect()
    assert q[0].q == ["the product is ready", "the distribution is not ready", "product problems", "product issues", "product needs improvement"]
    assert q[1].q == ["distribution is not hard", "product is hard", "distribution problems", "distribution issues", "distribution needs improvement"]
    rows = spark.createDataFrame([(1, 0, 5, "fact", 0.4), (1, 1, 5, "fact", 0.9), (1, 1, 6, "fact", 0.8), (1, 0, 7, "belief", 1.0)], "belief long, query_no int, id long, type string, score double")
    assert [(r.rank, r.id, r.score) for r in writes.challenged(rows).orderBy("rank").collect()] == [(1, 6, 0.8), (2, 5, 0.4)]


def test_new_memories_are_checked(spark):
    m = spark.createDataFrame([(1, "The payment service is working fine today", datetime(2024, 1, 1)), (2, "The payment service is not working fine today", datetime(2024, 1, 5)), (3, "Other topic entirely different", datetime(2024, 1, 5))], "id long, content string, created_at timestamp")
    v = writes.embedded(m, lambda texts: [[1.0, 0.0] if "payment" in t else [0.0, 1.0] for t in texts], 2)
    near = knn(v, v, 2).withColumn("vector_score", 1 / (1 + F.col("distance")))
    got = writes.check_new(m.filter("id = 2"), near.filter("q = 2"), m).collect()
    assert [(r.a, r.b, r.kind) for r in got] == [(2, 1, "temporal")]


def test_short_form_and_summaries(spark):
    r = spark.createDataFrame([("We met. Then NASA and Ada Lovelace spoke about rockets, rockets and rockets.",), ("",)], "c string").select(writes.frequent_short_form(F.col("c")).alias("s")).collect()
    assert r[0].s.startswith("We met. [") and "rockets" in r[0].s and "nasa" in r[0].s and r[1].s == ""
    s = spark.createDataFrame([("s", k, f"u{k}", "a" * 700) for k in range(20)], "session string, exchange long, user string, assistant string")
    got = writes.summarised(s, lambda pairs: [("lesson", f"{len(pairs)} {len(pairs[0][1])} {pairs[-1][0]}")]).collect()
    assert [(r.session, r.kind, r.text) for r in got] == [("s", "lesson", "15 600 u14")]


def test_logs(spark):
    b = writes.behaviours(spark.createDataFrame([("skipped the run", "user", ["b1"]), ("slept", "agent", None)], "content string, holder string, related_beliefs array<string>"), as_of()).orderBy("content").collect()
    assert [(r.type, r.importance, r.source) for r in b] == [("behavior", 0.6, "behavior-tracker")] * 2
    assert json.loads(b[0].metadata) == {"holder": "user", "relatedBeliefs": ["b1"]} and json.loads(b[1].metadata)["relatedBeliefs"] == []
    a = writes.attentions(spark.createDataFrame([(["x", "y"], "user", 25.0), (["z"], "user", None)], "topics array<string>, holder string, duration double"), as_of()).orderBy("content").collect()
    assert [r.content for r in a] == ["Attention on: x, y (25m)", "Attention on: z"] and [json.loads(r.metadata)["durationMinutes"] for r in a] == [25.0, 1.0]
    f = writes.follow_ups(spark.createDataFrame([("call back", "user", "shadow")], "content string, holder string, created_from string"), as_of())
    assert f.first().importance == 0.8 and beliefs.follow_ups(beliefs.typed(f, "follow-up").withColumnRenamed("source", "s"), resolved=False).count() == 1
    r = beliefs.typed(writes.beliefs(spark.createDataFrame([("it holds", 0.4, "d")], "content string, confidence double, domain string"), as_of()), "belief").first()
    assert (r.importance, r.confidence, r.status, r.holder, r.stated_confidence) == (0.6, 0.4, "active", "agent", 0.4) and r.history[0].reason == "initial belief"


def brute_overview(content):
    text = content.strip()
    words = lambda t: re.split(r"\s+", t)
    if len(words(text)) <= 375:
        return text
    paragraphs = [p for p in (p.replace("\n", " ").strip() for p in re.split(r"\n{2,}", text)) if len(p) > 10]
    parts = paragraphs[:1]
    headings = re.findall(r"^#{1,3}[^\S\n]+[^\n]+$", text, re.M)
    if headings:
        parts.append("\n" + "\n".join(headings))
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z\"'])", text) if s.strip()]
    points = [s for s in sentences[1:] if any(re.search(m, s, re.I) for m in writes.MARKERS)][:5]
    if points:
        parts.append("\nKey points: " + " ".join(points))
    if len(words("\n".join(parts))) < 200 and len(paragraphs) > 1:
        parts.insert(1, paragraphs[1])
    out = "\n".join(parts).strip()
    return " ".join(words(out)[:375]) + "..." if len(words(out)) > 375 else out


def test_overview(spark):
    long = "# Title here\n\nThe first paragraph says little.\n\n## Part two\n\n" + "\n\n".join(f"Paragraph {k} goes on and on. It was decided to keep part {k}. A lesson: learned nothing in {k}!" for k in range(60))
    texts = ["", " short. text ", long, "word " * 500, "One. " + "Important thing number one is this. " * 200, "para one is long enough\n\n" + "x " * 600]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", writes.overview(F.col("c")).alias("o")).collect()
    assert {r.i: r.o for r in got} == {i: brute_overview(t) for i, t in enumerate(texts)}
