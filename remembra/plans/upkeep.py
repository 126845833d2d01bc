"""Queries of statistics, upkeep, beliefs and predictions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from remembra.operators import beliefs as B
from remembra.operators import maintenance as M
from remembra.operators import writes
from remembra.plans.search import rounded, trim_sql
from remembra.schemas import DECAY, METADATA
from remembra.sources.memories import AS_OF, DAYS_SQL, MEMORIES_SQL, memories, moment, table
from remembra.sources.store import Store, workspace

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


STATS_SQL = """count(*) AS n, min(epoch_us(created_at)) AS first_created, max(epoch_us(created_at)) AS last_created, round(avg(importance), 3) AS avg_importance,
count(*) FILTER (importance > 0.7) AS high, count(*) FILTER (importance >= 0.4 AND importance <= 0.7) AS medium, count(*) FILTER (importance < 0.4) AS low"""


@query(f"{MEMORIES_SQL} SELECT {STATS_SQL} FROM memories")
def store_stats(spark, sf):
    return M.stats(memories(spark, sf))


@query(f"{MEMORIES_SQL} SELECT type, {STATS_SQL} FROM memories GROUP BY type")
def stats_by_type(spark, sf):
    return M.stats(memories(spark, sf), ["type"])


@query(f"{MEMORIES_SQL} SELECT CASE WHEN importance > 0.7 THEN 'high' WHEN importance >= 0.4 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM memories GROUP BY 1")
def stats_importance_tiers(spark, sf):
    return memories(spark, sf).groupBy(M.tiers(F.col("importance")).alias("tier")).agg(F.count("*").alias("n"))


@query(f"{MEMORIES_SQL}, c AS (SELECT coalesce(namespace, 'general') AS namespace, count(*) AS n FROM memories GROUP BY 1) SELECT namespace, n, round(n / sum(n) OVER (), 6) AS share FROM c")
def namespace_share(spark, sf):
    return rounded(M.share(memories(spark, sf).withColumn("namespace", F.coalesce("namespace", F.lit("general"))), "namespace"))


@query(f"{MEMORIES_SQL} SELECT id, access_count FROM memories ORDER BY access_count DESC, id LIMIT 10")
def reflect_top_access(spark, sf):
    return M.top(memories(spark, sf), "access_count").select("id", "access_count")


@query(f"{MEMORIES_SQL} SELECT id, importance FROM memories ORDER BY importance DESC, id LIMIT 10")
def reflect_top_importance(spark, sf):
    return M.top(memories(spark, sf), "importance").select("id", "importance")


STALE_SQL = f"{DAYS_SQL.format('accessed_at')} > 60 AND importance < 0.4"


@query(f"{MEMORIES_SQL} SELECT id, importance, round({DAYS_SQL.format('accessed_at')}, 6) AS days FROM memories WHERE {STALE_SQL}")
def stale_memories(spark, sf):
    from remembra.functions.scoring import days_between

    return rounded(memories(spark, sf).filter(M.stale(moment())).select("id", "importance", days_between(moment(), F.col("accessed_at")).alias("days")))


@query(f"{MEMORIES_SQL} SELECT count(*) AS total, round(avg(importance), 3) AS avg_importance, count(*) FILTER ({STALE_SQL}) AS stale, min(epoch_us(accessed_at)) AS first_accessed, max(epoch_us(accessed_at)) AS last_accessed, 0::BIGINT AS duplicates FROM memories")
def health(spark, sf):
    return M.health(memories(spark, sf), moment())


DECAY_SQL = f"greatest(0.05::DOUBLE, round(importance * exp(-{DECAY}::DOUBLE * days / 30), 3))"


@query(f"{MEMORIES_SQL}, d AS (SELECT *, {DAYS_SQL.format('accessed_at')} AS days FROM memories), e AS (SELECT *, {DECAY_SQL} AS decayed FROM d WHERE days >= 7) SELECT id, importance, decayed, round(days, 6) AS days FROM e WHERE decayed < importance - 0.01::DOUBLE")
def decay_preview(spark, sf):
    return M.decay(memories(spark, sf), moment()).withColumn("days", F.round("days", 6))


@query(f"{MEMORIES_SQL}, d AS (SELECT *, {DAYS_SQL.format('accessed_at')} AS days FROM memories), e AS (SELECT *, {DECAY_SQL} AS decayed FROM d) SELECT id, CASE WHEN days >= 7 AND decayed < importance - 0.01::DOUBLE THEN decayed ELSE importance END AS importance FROM e")
def decay_apply(spark, sf):
    m = memories(spark, sf)
    return m.join(M.decay(m, moment()).select("id", "decayed"), "id", "left").select("id", F.coalesce("decayed", "importance").alias("importance"))


CURATE_SQL = """concat_ws(', ', CASE WHEN importance < 0.6 AND access_count = 0 THEN 'low-importance(' || importance::VARCHAR || ')' END,
 CASE WHEN (contains(content, '**User:**') AND contains(content, '**Assistant:**')) OR (contains(content, '"role": "system"') AND contains(content, '"content":')) OR (contains(content, '"role": "user"') AND contains(content, '"role": "assistant"')) OR len(list_filter(tags, lambda t: starts_with(lower(t), 'chatgpt'))) > 0 THEN 'chatgpt-noise' END,
 CASE WHEN len(list_filter(string_split_regex(content, '[\\t-\\r ]+'), lambda w: w <> '')) < 20 THEN 'fragment' END)"""


@query(f"{MEMORIES_SQL} SELECT * FROM (SELECT id, {CURATE_SQL} AS reasons FROM memories) WHERE reasons <> ''")
def curate_flags(spark, sf):
    return M.curate(memories(spark, sf), moment()).select("id", "reasons")


@query(f"{MEMORIES_SQL} SELECT id, '- [' || type || '] ' || substring(regexp_replace(content, '[\\t-\\r ]+', ' ', 'g'), 1, 120) AS line FROM memories WHERE type = 'fact' ORDER BY importance DESC, id LIMIT 50")
def export_topn(spark, sf):
    return M.export(memories(spark, sf), kind="fact").select("id", "line")


HASH_SQL = f"sha256({trim_sql('content')})"


@query(f"{MEMORIES_SQL}, h AS (SELECT id, row_number() OVER w AS n, first_value(id) OVER w AS kept FROM (SELECT *, {HASH_SQL} AS hash FROM memories) WINDOW w AS (PARTITION BY hash ORDER BY created_at, id)) SELECT id, kept FROM h WHERE n > 1")
def exact_dedup_keep_oldest(spark, sf):
    return M.duplicates(memories(spark, sf))


@query(f"{MEMORIES_SQL}, h AS (SELECT id, {HASH_SQL} AS hash FROM memories), b AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS n FROM h WHERE id % 2 = 1) SELECT id, hash FROM b WHERE n = 1 AND hash NOT IN (SELECT hash FROM h WHERE id % 2 = 0)")
def batch_anti_join(spark, sf):
    m = memories(spark, sf)
    return M.new_rows(m.filter("id % 2 = 1"), m.filter("id % 2 = 0")).select("id", "hash")


NAMESPACE_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.NAMESPACES.items()) + " ELSE CASE " + " ".join(f"WHEN len(list_filter(tags, lambda t: contains(lower(t), '{p}'))) > 0 THEN 'projects/{p.replace('-', '', 1)}'" for p in ["de", "src1", *M.PROJECTS]) + " ELSE namespace END END"


@query(f"{MEMORIES_SQL}, n AS (SELECT *, {NAMESPACE_SQL} AS new FROM memories) SELECT new AS namespace, count(*) AS n FROM n WHERE new IS DISTINCT FROM namespace GROUP BY new")
def namespace_migration(spark, sf):
    m = memories(spark, sf).withColumn("new", M.laid_out(["de", "src1", *M.PROJECTS]))
    return m.filter(~F.col("new").eqNullSafe(F.col("namespace"))).groupBy(F.col("new").alias("namespace")).agg(F.count("*").alias("n"))


WORDS_SQL = "list_filter(string_split_regex(lower({}), '[^0-9A-Za-z_]+'), lambda w: len(w) > {})"


@query(f"{MEMORIES_SQL}, t AS (SELECT unnest(list_slice({WORDS_SQL.format('content', 4)}, 1, 10)) AS topic FROM memories WHERE created_at >= TIMESTAMP '2024-01-05') SELECT topic, count(*) AS n FROM t GROUP BY topic ORDER BY n DESC, topic LIMIT 10")
def reflect_topics(spark, sf):
    return M.topics(memories(spark, sf), moment("2024-01-05 00:00:00"))


def _any(terms):
    return "(" + " OR ".join(f"contains(low, '{t}')" for t in terms) + ")"


@query(f"""{MEMORIES_SQL}, r AS (SELECT *, lower(content) AS low FROM memories WHERE created_at >= TIMESTAMP '2024-01-05'),
c AS (SELECT *, {_any(M.SYCOPHANCY)} AS s, {_any(M.DUE)} AND NOT {_any(M.DONE)} AS a, {_any(M.FABRICATION)} AS f FROM r)
SELECT 'sycophancy' AS class, count(*) FILTER (s) AS n, min(id) FILTER (s) AS first_id FROM c UNION ALL SELECT 'avoidance', count(*) FILTER (a), min(id) FILTER (a) FROM c
UNION ALL SELECT 'fabrication', count(*) FILTER (f), min(id) FILTER (f) FROM c UNION ALL SELECT 'breadth', CASE WHEN count(DISTINCT source) > 5 THEN count(DISTINCT source) ELSE 0 END, NULL FROM c""")
def shadow_patterns(spark, sf):
    return M.shadow(memories(spark, sf), moment("2024-01-05 00:00:00"), 24)


SHADOW_SQL = f"""{MEMORIES_SQL}, r AS (SELECT *, lower(content) AS low FROM memories WHERE created_at >= TIMESTAMP '2024-01-05')"""


@query(f"{SHADOW_SQL} SELECT (count(*) FILTER ({_any(M.SYCOPHANCY)}) + count(*) FILTER ({_any(M.DUE)} AND NOT {_any(M.DONE)}) + count(*) FILTER ({_any(M.FABRICATION)}) + (count(DISTINCT source) > 5)::INT)::BIGINT AS total FROM r")
def shadow_total(spark, sf):
    return M.shadow_total(M.shadow(memories(spark, sf), moment("2024-01-05 00:00:00"), 24))


# ---- beliefs: from conversations; what an assistant says is believed, what a user says was done ----


def claims(spark, sf, role: str):
    c = table(spark, sf, "conversations").filter(F.col("role") == role)
    tail = F.element_at(F.array(*map(F.lit, [" committed and delivered", " skipped it", " consistent", " ignored again", ""])), (F.col("turn") % 5 + 1).cast("int"))
    # both tables of the pair: id, holder, content, created_at
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        (F.col("conv_id") % 50).alias("holder"),
        F.concat(F.coalesce("text", F.lit("")), tail).alias("content") if role == "user" else F.coalesce("text", F.lit("")).alias("content"),
        F.timestamp_micros(F.unix_micros(moment("2024-01-01 00:00:00")) + (F.col("conv_id") * 86400 + F.col("turn") * 60) * 1_000_000).alias("created_at"),
        (F.col("conv_id") % 100 / 100.0).alias("confidence"),
        F.when(F.col("turn") % 3 == 0, F.lit(0.0)).when(F.col("turn") % 3 == 1, F.col("turn") % 10 / 10.0).alias("stated_confidence"),
        F.lit(None).cast("double").alias("revealed_confidence"),
        F.when(F.col("turn") % 4 == 0, F.lit("")).when(F.col("turn") % 4 == 1, F.lit("active")).when(F.col("turn") % 4 == 2, F.lit("refuted")).alias("status"),
        (F.col("conv_id") % 7).cast("string").alias("domain"),
        F.when(F.col("turn") % 2 == 0, F.timestamp_micros(F.unix_micros(moment()) - F.col("conv_id") % 20 * 86400_000_000)).alias("last_challenged"),
        F.when(F.col("turn") % 6 == 0, F.array(F.col("conv_id") * 1000 + F.col("turn") + 1)).otherwise(F.expr("cast(array() as array<bigint>)")).alias("related"),
    )


CLAIMS_SQL = """WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id % 50 AS holder, coalesce(text, '') AS text, turn, role,
 TIMESTAMP '2024-01-01' + to_seconds(conv_id * 86400 + turn * 60) AS created_at, conv_id % 100 / 100.0::DOUBLE AS confidence,
 CASE WHEN turn % 3 = 0 THEN 0::DOUBLE WHEN turn % 3 = 1 THEN turn % 10 / 10.0::DOUBLE END AS stated_confidence,
 CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'active' WHEN 2 THEN 'refuted' END AS status, (conv_id % 7)::VARCHAR AS domain,
 CASE WHEN turn % 2 = 0 THEN TIMESTAMP '""" + AS_OF + """' - to_seconds(conv_id % 20 * 86400) END AS last_challenged,
 CASE WHEN turn % 6 = 0 THEN [conv_id * 1000 + turn + 1] ELSE [] END AS related FROM conversations),
beliefs AS (SELECT *, text AS content FROM c WHERE role = 'assistant'),
behaviours AS (SELECT *, text || list_extract([' committed and delivered', ' skipped it', ' consistent', ' ignored again', ''], (turn % 5 + 1)::INT) AS content FROM c WHERE role = 'user')"""


@query(f"{CLAIMS_SQL} SELECT id, confidence, {DAYS_SQL.format('coalesce(last_challenged, created_at)')} > 7 AS stale FROM beliefs WHERE coalesce(status, '') IN ('', 'active')")
def beliefs_active(spark, sf):
    return B.active(claims(spark, sf, "assistant"), moment()).select("id", "confidence", "stale")


@query(f"{CLAIMS_SQL} SELECT holder, rank, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY holder ORDER BY confidence DESC, id)::INT AS rank FROM beliefs) WHERE rank <= 10")
def beliefs_by_holder_topn(spark, sf):
    return B.top_by_holder(claims(spark, sf, "assistant")).select("holder", "rank", "id", "confidence")


@query(f"""{CLAIMS_SQL}, u AS (SELECT *, CASE WHEN id % 3 = 0 THEN (id % 11) / 10.0::DOUBLE END AS new FROM beliefs)
SELECT id, coalesce(new, confidence) AS confidence, (coalesce(new > confidence, false))::INT AS times_confirmed, (coalesce(new < confidence, false))::INT AS times_refuted, CASE WHEN new IS NULL THEN 0.6::DOUBLE ELSE greatest(0.6::DOUBLE, new) END AS importance, (new IS NOT NULL)::INT AS changes FROM u""")
def belief_confidence_update(spark, sf):
    b = claims(spark, sf, "assistant").withColumns({"history": F.expr("cast(null as array<struct<date:timestamp,confidence:double,reason:string>>)"), "times_confirmed": F.lit(0), "times_refuted": F.lit(0), "importance": F.lit(0.6)})
    changes = b.filter("id % 3 = 0").select("id", (F.col("id") % 11 / 10.0).alias("new_confidence"), F.lit("seen").alias("reason"))
    return B.reweighed(b, changes, moment()).select("id", "confidence", "times_confirmed", "times_refuted", "importance", F.coalesce(F.size("history"), F.lit(0)).alias("changes"))


@query(f"""{MEMORIES_SQL}, r AS (SELECT * FROM memories WHERE created_at >= TIMESTAMP '2024-01-05'), bt AS (SELECT type, count(*) AS n FROM r GROUP BY type ORDER BY n DESC, type LIMIT 5),
w AS (SELECT unnest(list_slice({WORDS_SQL.format('content', 4)}, 1, 10)) AS topic FROM r), tt AS (SELECT topic, count(*) AS n FROM w GROUP BY topic ORDER BY n DESC, topic LIMIT 5), {CLAIMS_SQL.removeprefix("WITH ")},
x AS (SELECT (SELECT count(*) FROM r) AS memories, (SELECT string_agg(type || '(' || n || ')', ', ' ORDER BY n DESC, type) FROM bt) AS types, (SELECT string_agg(topic || '(' || n || ')', ', ' ORDER BY n DESC, topic) FROM tt) AS topics,
 (SELECT count(*) FROM beliefs WHERE coalesce(status, '') IN ('', 'active') AND {DAYS_SQL.format('coalesce(last_challenged, created_at)')} > 7) AS stale)
SELECT *, 'Reflection on last 24 hours: ' || memories || ' memories saved. Top types: ' || types || '. Top topics: ' || topics || '. Stale beliefs: ' || stale || '.' AS sentence FROM x""")
def period_reflection(spark, sf):
    return M.reflection(memories(spark, sf), B.active(claims(spark, sf, "assistant"), moment()), moment("2024-01-05 00:00:00"), 24)


_LOW = "lower(b.content)"


def _has(x, terms):
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


GAPS_SQL = f"""{CLAIMS_SQL},
bw AS (SELECT id, holder, unnest({WORDS_SQL.format('content', 3)}) AS w FROM beliefs),
hw AS (SELECT id, holder, unnest(list_distinct({WORDS_SQL.format('content', 3)})) AS w FROM behaviours),
pairs AS (SELECT bw.id AS belief, hw.id AS behaviour FROM bw JOIN hw ON bw.holder = hw.holder AND bw.w = hw.w GROUP BY ALL HAVING count(*) >= 2
 UNION SELECT b.id, h.id FROM behaviours h JOIN beliefs b ON b.holder = h.holder AND list_contains(h.related, b.id)),
s AS (SELECT p.belief, b.id, b.created_at, {_has(_LOW, B.SUPPORTS)} AS yes, {_has(_LOW, B.CONTRADICTS)} AS no, {_has(_LOW, B.ALIGNED)} AS aligned,
 row_number() OVER (PARTITION BY p.belief ORDER BY b.created_at DESC, b.id DESC) <= 3 AS recent FROM pairs p JOIN behaviours b ON b.id = p.behaviour),
g AS (SELECT belief, count(*) AS signals, count(*) FILTER (yes) AS up, count(*) FILTER (no AND NOT yes) AS down, avg(aligned::INT) FILTER (recent) AS now, avg(aligned::INT) FILTER (NOT recent) AS before FROM s GROUP BY belief),
r AS (SELECT b.id, b.holder, coalesce(nullif(stated_confidence, 0), nullif(confidence, 0), 0.5::DOUBLE) AS stated, CASE WHEN up + down = 0 THEN 0.5::DOUBLE ELSE up / (up + down) END AS revealed, now, before, signals FROM g JOIN beliefs b ON b.id = g.belief)"""


@query(f"{GAPS_SQL} SELECT id, holder, stated, round(revealed, 6) AS revealed, round(abs(stated - revealed), 6) AS gap, signals FROM r")
def belief_gaps(spark, sf):
    return rounded(B.gaps(claims(spark, sf, "assistant"), claims(spark, sf, "user")).drop("trend"))


@query(f"{GAPS_SQL} SELECT CASE WHEN before IS NULL OR abs(now - before) < 0.1 THEN 'stable' WHEN now > before THEN 'narrowing' ELSE 'widening' END AS trend, count(*) AS n FROM r GROUP BY 1")
def gap_trend(spark, sf):
    return B.gaps(claims(spark, sf, "assistant"), claims(spark, sf, "user")).groupBy("trend").agg(F.count("*").alias("n"))


# ---- predictions and attention: from events ----


def micros(column: str):
    """Microseconds of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast({column} as timestamp_ntz))")


def prediction_rows(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    status = F.element_at(F.array(*map(F.lit, ["open", "correct", "wrong", "partial", "open"])), (F.col("event_id") % 5 + 1).cast("int"))
    deadline = F.expr("date_add(cast(ts as date), cast(event_id % 30 as int))")
    return e.select(F.col("event_id").alias("id"), (k / 100.0).alias("confidence"), (F.col("user_id") % 3).alias("holder"), F.col("event_type").alias("domain"), status.alias("status"), deadline.alias("deadline"))


PREDICTIONS_SQL = """WITH p AS (SELECT event_id AS id, json_extract_string(props, '$.k')::DOUBLE / 100.0::DOUBLE AS confidence, user_id % 3 AS holder, event_type AS domain,
 list_extract(['open', 'correct', 'wrong', 'partial', 'open'], (event_id % 5 + 1)::INT) AS status, ts::DATE + (event_id % 30)::INT AS deadline FROM events),
r AS (SELECT *, CASE status WHEN 'correct' THEN 1::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS actual,
 CASE WHEN confidence >= 0.9 THEN '90-100%' WHEN confidence >= 0.7 THEN '70-89%' WHEN confidence >= 0.5 THEN '50-69%' WHEN confidence >= 0.3 THEN '30-49%' ELSE '0-29%' END AS bucket FROM p WHERE status <> 'open'),
q AS (SELECT *, (confidence - actual) * (confidence - actual) AS brier FROM r)"""
#: When the predictions are looked at: within the events' time.
LOOKED_AT = "2024-01-15"


@query(f"{PREDICTIONS_SQL} SELECT id, holder, domain, epoch_us(deadline::TIMESTAMP) AS deadline FROM p WHERE status = 'open' AND DATE '{LOOKED_AT}' > deadline")
def predictions_expired(spark, sf):
    rows = prediction_rows(spark, sf)
    return B.predictions(rows, F.lit(LOOKED_AT).cast("timestamp"), expired=True).select("id", "holder", "domain", micros("deadline").alias("deadline"))


@query(f"{PREDICTIONS_SQL}, d AS (SELECT id, (deadline - DATE '{LOOKED_AT}')::INT AS days FROM p WHERE status = 'open') SELECT id, CASE WHEN days > 0 THEN 'due in ' || days || 'd' WHEN days = 0 THEN 'due today' ELSE 'overdue by ' || abs(days) || 'd' END AS label FROM d")
def prediction_due_label(spark, sf):
    days = F.datediff("deadline", F.lit(LOOKED_AT).cast("date"))
    return prediction_rows(spark, sf).filter("status = 'open'").select("id", B.due_label(days).alias("label"))


CALIBRATION_SQL = "round(avg(brier), 6) AS brier, round(avg(confidence), 6) AS predicted, round(avg(actual), 6) AS actual, count(*) AS n"


@query(f"{PREDICTIONS_SQL} SELECT 'all' AS part, '' AS value, {CALIBRATION_SQL} FROM q UNION ALL SELECT 'bucket', bucket, {CALIBRATION_SQL} FROM q GROUP BY bucket UNION ALL SELECT 'domain', domain, {CALIBRATION_SQL} FROM q GROUP BY domain UNION ALL SELECT 'holder', holder::VARCHAR, {CALIBRATION_SQL} FROM q GROUP BY holder")
def calibration_grouping_sets(spark, sf):
    return rounded(B.calibration(prediction_rows(spark, sf)))


@query(f"{PREDICTIONS_SQL}, a AS (SELECT count(*) AS resolved, avg(brier) AS brier FROM q) SELECT resolved, round(brier, 6) AS brier, CASE WHEN brier < 0.2 THEN 'good' WHEN brier < 0.3 THEN 'fair' WHEN brier < 0.5 THEN 'poor' ELSE 'bad' END AS grade FROM a")
def calibration_overall(spark, sf):
    a = B.calibration(prediction_rows(spark, sf)).filter("part = 'all'")
    return rounded(a.select(F.col("n").alias("resolved"), "brier", B.brier_grade(F.col("brier")).alias("grade")))


@query(f"{PREDICTIONS_SQL}, b AS (SELECT bucket, avg(confidence) AS p, avg(actual) AS a, count(*) AS n FROM q GROUP BY bucket) SELECT bucket, n, round(p, 6) AS predicted, round(a, 6) AS actual, CASE WHEN abs(p - a) < 0.1 THEN 'calibrated' WHEN p > a THEN 'overconfident' ELSE 'underconfident' END AS verdict FROM b")
def calibration_buckets(spark, sf):
    a = B.calibration(prediction_rows(spark, sf)).filter("part = 'bucket'")
    return rounded(a.select(F.col("value").alias("bucket"), "n", "predicted", "actual", B.bucket_verdict(F.col("predicted"), F.col("actual")).alias("verdict")))


@query(f"{PREDICTIONS_SQL} SELECT domain, count(*) AS n, round(avg(brier), 6) AS brier FROM q GROUP BY domain")
def calibration_by_domain(spark, sf):
    return rounded(B.calibration(prediction_rows(spark, sf)).filter("part = 'domain'").select(F.col("value").alias("domain"), "n", "brier"))


def attention_rows(spark, sf):
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 20).alias("holder"), F.array("event_type", F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string"))).alias("topics"), F.when(F.col("event_id") % 9 == 0, F.lit(0.0)).otherwise(F.round("value", 2)).alias("duration"), F.timestamp_micros(micros("ts")).alias("created_at"))


ATTENTION_SQL = """WITH a AS (SELECT user_id % 20 AS holder, [event_type, 'k' || (event_id % 4)] AS topics, CASE WHEN event_id % 9 = 0 THEN 0::DOUBLE ELSE round(value, 2) END AS duration, epoch_us(ts) AS t FROM events),
n AS (SELECT * FROM a WHERE t >= epoch_us(TIMESTAMP '2024-01-15') - 240 * 3600000000)"""
ATTENTION_HOURS = 240


@query(f"{ATTENTION_SQL}, d AS (SELECT unnest(topics) AS topic, CASE WHEN coalesce(duration, 0) = 0 THEN 1::DOUBLE ELSE duration END AS m FROM n), g AS (SELECT topic, sum(m) AS minutes FROM d GROUP BY topic) SELECT topic, round(minutes, 4) AS minutes, round(minutes / sum(minutes) OVER (), 6) AS share FROM g")
def attention_topics(spark, sf):
    a = B.attention(attention_rows(spark, sf), moment("2024-01-15 00:00:00"), ATTENTION_HOURS)
    return a.select("topic", F.round("minutes", 4).alias("minutes"), F.round("share", 6).alias("share"))


@query(f"{ATTENTION_SQL}, g AS (SELECT holder, count(*) AS records, count(*) FILTER (t > epoch_us(TIMESTAMP '2024-01-15') - 120 * 3600000000) AS late FROM n GROUP BY holder), k AS (SELECT holder, count(DISTINCT x) AS topic_count FROM (SELECT holder, unnest(topics) AS x FROM n) GROUP BY holder) SELECT holder, records, CASE WHEN late * 2 > records THEN 'increasing' WHEN late * 2 < records THEN 'decreasing' ELSE 'stable' END AS trend, topic_count, least(1::DOUBLE, topic_count / 10) AS breadth FROM g JOIN k USING (holder)")
def attention_trend(spark, sf):
    return B.attention_trend(attention_rows(spark, sf), moment("2024-01-15 00:00:00"), ATTENTION_HOURS)


@query(f"{ATTENTION_SQL}, k AS (SELECT holder, least(1::DOUBLE, count(DISTINCT x) / 10) AS breadth FROM (SELECT holder, unnest(topics) AS x FROM n) GROUP BY holder) SELECT holder, breadth, CASE WHEN breadth < 0.3 THEN 'Very focused' WHEN breadth < 0.6 THEN 'Moderately focused' WHEN breadth < 0.8 THEN 'Somewhat scattered' ELSE 'Very scattered' END AS focus FROM k")
def attention_focus(spark, sf):
    a = B.attention_trend(attention_rows(spark, sf), moment("2024-01-15 00:00:00"), ATTENTION_HOURS)
    return a.select("holder", "breadth", B.focus(F.col("breadth")).alias("focus"))


@query("SELECT event_id AS id, user_id AS holder, epoch_us(ts) AS created FROM events WHERE event_type = 'error' AND event_id % 3 <> 0")
def followups_open(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("holder"), micros("ts").alias("created"), F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("open").alias("status"))
    return B.follow_ups(e, resolved=False).drop("status")


# ---- stores that are written, changed and read again ----


def _store(spark, sf) -> Store:
    store = Store(spark, workspace(spark, "store"))
    store.append(memories(spark, sf).filter("id % 2 = 0"))
    store.append(memories(spark, sf).filter("id % 2 = 1"))
    return store


CHANGED_SQL = f"""{MEMORIES_SQL} SELECT id, type, namespace, CASE WHEN id % 10 = 3 THEN round(importance / 2, 9) ELSE round(importance, 9) END AS importance,
 access_count + CASE WHEN id % 5 = 1 THEN 2 ELSE 0 END + CASE WHEN id % 6 = 1 THEN 1 ELSE 0 END AS access_count,
 epoch_us(CASE WHEN id % 6 = 1 OR id % 5 = 1 THEN greatest(accessed_at, TIMESTAMP '{AS_OF}') ELSE accessed_at END) AS accessed_at
 FROM memories WHERE id % 7 <> 4"""


def _changed(spark, sf) -> Store:
    """Touched, updated, touched again, and some deleted."""
    store = _store(spark, sf)
    rows = memories(spark, sf)
    touch = lambda some, n: rows.filter(some).select("id", moment().alias("accessed_at"), F.lit(n).cast("long").alias("accesses"))
    store.fold(touch("id % 5 = 1", 2))
    store.update(rows.filter("id % 10 = 3").select("id", (F.col("importance") / 2).alias("importance")))
    store.fold(touch("id % 6 = 1", 1), "once")
    store.fold(touch("id % 6 = 1", 1), "once")
    store.delete(rows.filter("id % 7 = 4"))
    return store


def _told(store: Store):
    return store.read().select("id", "type", "namespace", F.round("importance", 9).alias("importance"), "access_count", F.unix_micros("accessed_at").alias("accessed_at"))


@query(CHANGED_SQL)
def store_changes(spark, sf):
    return _told(_changed(spark, sf))


@query(CHANGED_SQL)
def store_compacted(spark, sf):
    store = _changed(spark, sf)
    store.compact()
    return _told(store)


@query(f"{CLAIMS_SQL} SELECT id, CASE WHEN id % 4 = 0 THEN 'confirmed' WHEN id % 4 = 1 THEN 'refuted' ELSE status END AS status, confidence, (id % 4 = 0)::INT AS times_confirmed, (id % 4 = 1)::INT AS times_refuted, (id % 4 < 2)::INT AS changes FROM beliefs")
def store_beliefs_judged(spark, sf):
    """Beliefs as rows with JSON metadata in a store, judged, written back, and read again."""
    held = claims(spark, sf, "assistant").withColumns({"metadata": F.lit(None).cast("string"), "type": F.lit("belief")})
    names = [f for f in T.StructType.fromDDL(METADATA["belief"]).fields]
    held = held.select(*[c for c in held.columns if c in ("id", "type", "content", "metadata", "created_at")], *[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in held.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in names])
    store = Store(spark, workspace(spark, "store"))
    store.append(held.withColumn("metadata", B.encoded("belief")).select("id", "type", "content", "created_at", "metadata"))
    verdicts = held.filter("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, "confirmed").otherwise("refuted").alias("verdict"), F.lit("seen").alias("why"))
    told = B.typed(store.read().withColumn("__m", F.col("metadata")), "belief").withColumnRenamed("__m", "metadata")
    store.update(writes.judged(told, verdicts, moment()).select("id", B.encoded("belief").alias("metadata")))
    return B.typed(store.read(), "belief").select("id", "status", "confidence", F.coalesce("times_confirmed", F.lit(0)).alias("times_confirmed"), F.coalesce("times_refuted", F.lit(0)).alias("times_refuted"), F.coalesce(F.size("history"), F.lit(0)).alias("changes"))
