"""Queries of ingestion, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from remembra.operators import ingest as I
from remembra.plans.search import trim_sql
from remembra.sources.files import lines
from remembra.sources.memories import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def file_lines(spark, sf):
    """Lines of all documents, some made headings, bullets, blanks or lines of high signal by their number."""
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text")
    n, line = F.col("n"), F.col("line")
    made = F.when(n % 7 == 2, F.concat(F.lit("## "), line)).when(n % 5 == 1, F.concat(F.lit("- "), line)).when(n % 11 == 3, "").when(n % 13 == 4, F.concat(F.lit("* Lesson: "), line)).when(n % 13 == 5, F.concat(F.lit("prefer: always "), line)).otherwise(line)
    return lines(files).select("file", "n", made.alias("line"))


LINES_SQL = """WITH raw AS (SELECT doc_id AS file, string_split(text, chr(10)) AS ls FROM documents),
l0 AS (SELECT file, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM raw),
lines AS (SELECT file, n::INT AS n, CASE WHEN n % 7 = 2 THEN '## ' || line WHEN n % 5 = 1 THEN '- ' || line WHEN n % 11 = 3 THEN '' WHEN n % 13 = 4 THEN '* Lesson: ' || line WHEN n % 13 = 5 THEN 'prefer: always ' || line ELSE line END AS line FROM l0)"""


def cases(column: str, table_, default) -> str:
    def lit(v):
        return quoted(v) if isinstance(v, str) else f"{v}::DOUBLE"

    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({column}), {quoted(w)})" for w in words) + f" THEN {lit(v)}" for words, v in table_) + f" ELSE {lit(default)} END"


def blocks_sql(source: str) -> str:
    return f"""marked AS (SELECT file, n, regexp_matches(line, '^##?\\s+.+') AS h, NOT regexp_matches(line, '^##?\\s+.+') AND regexp_matches(line, '^[-*]\\s+.+') AS b, {trim_sql('line')} = '' AS e, line FROM {source}),
placed AS (SELECT file, n, sum((h OR b OR e)::INT) OVER w AS block, coalesce(last_value(CASE WHEN h THEN {trim_sql("regexp_extract(line, '^##?\\s+(.+)', 1)")} END IGNORE NULLS) OVER w, '') AS section,
 CASE WHEN h OR e THEN NULL WHEN b THEN {trim_sql("regexp_extract(line, '^[-*]\\s+(.+)', 1)")} ELSE {trim_sql('line')} END AS part FROM marked WINDOW w AS (PARTITION BY file ORDER BY n ROWS UNBOUNDED PRECEDING)),
blocks AS (SELECT file, block::BIGINT AS block, min(section) AS section, {trim_sql("string_agg(part, chr(10) ORDER BY n)")} AS content FROM placed WHERE part IS NOT NULL GROUP BY file, block)"""


@query(f"{LINES_SQL}, {blocks_sql('lines')} SELECT file, block, section, {cases('section', I.SECTION_TYPES, 'semantic')} AS type, {cases('content', I.TEXT_IMPORTANCE, 0.5)} AS importance, CASE WHEN section <> '' THEN regexp_replace(lower(section), '\\s+', '-', 'g') ELSE '' END AS tag, content FROM blocks WHERE content <> ''")
def markdown_blocks(spark, sf):
    return I.markdown_blocks(file_lines(spark, sf)).withColumn("tag", F.array_join("tags", ",")).drop("tags")


@query("SELECT label, " + cases("name", I.SECTION_TYPES, "semantic") + " AS type FROM (SELECT doc_id AS label, source || ' ' || list_extract(['Decision log', 'How to', 'Team', 'Facts', 'Status', 'Likes', 'Other', 'Lesson'], (doc_id % 8 + 1)::INT) AS name FROM documents)")
def infer_type(spark, sf):
    name = F.concat(F.col("source"), F.lit(" "), F.element_at(F.array(*map(F.lit, ["Decision log", "How to", "Team", "Facts", "Status", "Likes", "Other", "Lesson"])), (F.col("doc_id") % 8 + 1).cast("int")))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("label"), I.section_type(name).alias("type"))


PREFIX_SQL = "CASE " + " ".join(f"WHEN regexp_matches(bare, '^(?i:{p}):\\s*.+') THEN {k}" for k, (p, _, _) in enumerate(I.PREFIXES)) + " ELSE -1 END"
SIGNAL_SQL = f"bared AS (SELECT *, {trim_sql("regexp_replace(line, '^[-*]\\s+', '')")} AS bare FROM lines), signal AS (SELECT *, {PREFIX_SQL} AS which FROM bared)"


@query(f"{LINES_SQL}, {SIGNAL_SQL} SELECT file, n, list_extract([{', '.join(quoted(t) for _, t, _ in I.PREFIXES)}], which + 1) AS type, list_extract([{', '.join(f'{v}::DOUBLE' for _, _, v in I.PREFIXES)}], which + 1) AS importance, {trim_sql("regexp_extract(bare, '^[A-Za-z]+:\\s*(.+)', 1)")} AS content FROM signal WHERE which >= 0")
def high_signal_lines(spark, sf):
    return I.high_signal(file_lines(spark, sf))[0]


@query(f"""{LINES_SQL}, {SIGNAL_SQL}, rest AS (SELECT file, n, line FROM signal WHERE which < 0), {blocks_sql('rest')}
SELECT file, list_extract([{', '.join(quoted(t) for _, t, _ in I.PREFIXES)}], which + 1) AS type, list_extract([{', '.join(f'{v}::DOUBLE' for _, _, v in I.PREFIXES)}], which + 1) AS importance, 'high-signal' AS tag, {trim_sql("regexp_extract(bare, '^[A-Za-z]+:\\s*(.+)', 1)")} AS content FROM signal WHERE which >= 0
UNION ALL SELECT file, {cases('section', I.SECTION_TYPES, 'semantic')}, least({cases('content', I.TEXT_IMPORTANCE, 0.5)}, 0.3::DOUBLE), CASE WHEN section <> '' THEN regexp_replace(lower(section), '\\s+', '-', 'g') ELSE '' END, content FROM blocks WHERE content <> ''""")
def smart_markdown(spark, sf):
    return I.smart_markdown(file_lines(spark, sf)).withColumn("tag", F.array_join("tags", ",")).drop("tags")


TAILS = [" We decided to keep it.", " Lesson: check it twice.", " The version is 3 now and stays.", " I talked to Alice Smith about that.", " Bob said no.", "", " > quote", " api key rotated by Sarah,"]


def transcript_lines(spark, sf):
    c = table(spark, sf, "conversations")
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (F.col("turn") % len(TAILS) + 1).cast("int"))
    head = F.when(F.col("conv_id") % 5 == 0, F.lit("[User]: ")).when(F.col("conv_id") % 5 == 1, F.lit("user: ")).otherwise(F.lit(""))
    files = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("file"), F.concat(head, F.coalesce("text", F.lit("")), tail).alias("text"))
    return lines(files)


TRANSCRIPT_SQL = f"""WITH raw AS (SELECT conv_id * 1000 + turn AS file, string_split(CASE conv_id % 5 WHEN 0 THEN '[User]: ' WHEN 1 THEN 'user: ' ELSE '' END || coalesce(text, '') || list_extract([{', '.join(map(quoted, TAILS))}], (turn % {len(TAILS)} + 1)::INT), chr(10)) AS ls FROM conversations),
lines AS (SELECT file, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INT AS n FROM raw),
cleaned AS (SELECT *, {trim_sql("regexp_replace(regexp_replace(line, '" + I.SPEAKER + "', ''), '" + I.MARKS + "', '')")} AS clean FROM lines),
good AS (SELECT *, regexp_extract_all(clean, '[^.!?]+[.!?]+') AS ss FROM cleaned WHERE length(clean) >= 15 AND NOT regexp_matches(line, '{I.SKIPPED}')),
parts AS (SELECT file, n, CASE WHEN length(clean) > 300 AND len(ss) > 0 THEN list_transform(ss, lambda s: {trim_sql('s')}) ELSE [clean] END AS ps FROM good),
segments AS (SELECT * FROM (SELECT file, n, unnest(ps) AS segment, (generate_subscripts(ps, 1) - 1)::INT AS k FROM parts) WHERE length(segment) >= 15)"""


@query(f"{TRANSCRIPT_SQL} SELECT file, n, k, segment FROM segments")
def transcript_segments(spark, sf):
    return I.segments(transcript_lines(spark, sf))


def any_sql(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {quoted('(?i)' + p)})" for p in patterns) + ")"


CLASS_SQL = f"CASE WHEN {any_sql('segment', I.DECISION)} THEN 'decision' WHEN {any_sql('segment', I.LESSON)} THEN 'lesson' WHEN {any_sql('segment', I.FACT)} AND length(segment) >= 30 THEN 'fact' END"


@query(f"{TRANSCRIPT_SQL} SELECT * FROM (SELECT file, n, k, {CLASS_SQL} AS class FROM segments) WHERE class IS NOT NULL")
def transcript_classes(spark, sf):
    return I.segments(transcript_lines(spark, sf)).select("file", "n", "k", I.segment_class(F.col("segment")).alias("class")).filter("class is not null")


NAMES_SQL = f"""named AS (SELECT *, list_filter([{', '.join(trim_sql(f'regexp_extract(segment, {quoted(p)}, 1)') for p in I.PERSON)}], lambda x: length(x) > 2 AND lower(x) NOT IN ({', '.join(map(quoted, I.NO_NAMES))})) AS a,
 list_filter(list_transform(list_filter(string_split_regex(segment, '\\s+'), lambda w: lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')) IN ({', '.join(map(quoted, I.FIRST_NAMES))}) AND w[1] = upper(w[1])), lambda w: regexp_replace(w, '^([a-zA-Z]*)[^a-zA-Z]', '\\1')), lambda x: length(x) > 2) AS b FROM segments),
listed AS (SELECT file, n, k, segment, list_concat(a, b) AS names FROM named),
mentions AS (SELECT file, n, k, segment, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM listed)"""


@query(f"{TRANSCRIPT_SQL}, {NAMES_SQL} SELECT DISTINCT file, n, k, name FROM mentions")
def person_mentions(spark, sf):
    s = I.segments(transcript_lines(spark, sf))
    return s.select("file", "n", "k", F.explode(I.person_mentions(F.col("segment"))).alias("name"))


EXTRACTED_SQL = f"""{TRANSCRIPT_SQL}, {NAMES_SQL}, once AS (SELECT file, n, k, segment, name, min(i) AS i FROM mentions GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY file, n, k ORDER BY i) - 1 AS j FROM once),
people AS (SELECT *, row_number() OVER (PARTITION BY file, lower(name) ORDER BY n, k, j) AS f FROM placed),
classed AS (SELECT *, {CLASS_SQL} AS class FROM segments),
mem AS (SELECT file, n, k, j::INT AS j, 'semantic' AS type, 0.6::DOUBLE AS importance, 'user/people' AS namespace, 'person,' || lower(name) AS tag, 'Person mentioned in conversation: ' || name || '. Context: "' || substring(segment, 1, 150) || '"' AS content FROM people WHERE f = 1
 UNION ALL SELECT file, n, k, {I.SEGMENT}, CASE class WHEN 'decision' THEN 'belief' WHEN 'lesson' THEN 'reflection' ELSE 'semantic' END, CASE class WHEN 'decision' THEN 0.8::DOUBLE WHEN 'lesson' THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END, 'general', class || ',extracted', segment FROM classed WHERE class IS NOT NULL)"""


def _memories(df):
    return df.withColumn("tag", F.array_join("tags", ",")).drop("tags", "source")


@query(f"{EXTRACTED_SQL} SELECT * FROM mem")
def transcript_memories(spark, sf):
    return _memories(I.transcript_memories(transcript_lines(spark, sf)))


# ---- sessions ----

NOTES = ["", " It was deployed with git push.", " We learned about src/app/main.py and docs/a-b.md.", " See https://example.com/x?y=1 and abc1234def.", " The weather is fine.", " decided on api and dashboard"]


def messages(spark, sf):
    c = table(spark, sf, "conversations")
    note = F.element_at(F.array(*map(F.lit, NOTES)), ((F.col("conv_id") + F.col("turn")) % len(NOTES) + 1).cast("int"))
    tools = F.when(F.col("turn") % 3 == 1, F.array(F.lit("read"), F.lit("write"))).when(F.col("turn") % 3 == 2, F.array(F.lit("read"))).otherwise(F.expr("cast(array() as array<string>)"))
    return c.select(F.col("conv_id").alias("session"), "turn", "role", F.concat(F.coalesce("text", F.lit("")), note).alias("text"), tools.alias("tools"))


SESSIONS_SQL = f"""WITH m AS (SELECT conv_id AS session, turn, role, coalesce(text, '') || list_extract([{', '.join(map(quoted, NOTES))}], ((conv_id + turn) % {len(NOTES)} + 1)::INT) AS text, CASE turn % 3 WHEN 1 THEN ['read', 'write'] WHEN 2 THEN ['read'] ELSE [] END AS tools FROM conversations WHERE role IN ('user', 'assistant')),
x AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS exchange FROM m),
g AS (SELECT session, exchange, max(text) FILTER (role = 'user') AS u, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant' AND {trim_sql('text')} <> '') AS a, coalesce(flatten(list(tools ORDER BY turn) FILTER (role = 'assistant')), []) AS tools FROM x GROUP BY session, exchange),
e AS (SELECT session, exchange, substring(u, 1, 2000) AS "user", substring(a, 1, 3000) AS assistant, tools FROM g WHERE u <> '' AND a <> '')"""


@query(f'{SESSIONS_SQL} SELECT session, exchange, "user", assistant, array_to_string(tools, \',\') AS tools FROM e')
def session_exchanges(spark, sf):
    return I.exchanges(messages(spark, sf)).withColumn("tools", F.array_join("tools", ","))


GOOD_SQL = f"""length({trim_sql('"user"')}) >= 10 AND length({trim_sql('assistant')}) >= 20 AND NOT ((contains(assistant, 'HEARTBEAT_OK') OR starts_with(assistant, 'Error:')) AND length({trim_sql('assistant')}) < 100)"""


@query(f"""{SESSIONS_SQL} SELECT session, exchange, 'User: ' || "user" || chr(10) || chr(10) || 'Assistant: ' || assistant || CASE WHEN len(tools) > 0 THEN chr(10) || chr(10) || 'Tools used: ' || (SELECT string_agg(t, ', ' ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest(tools) AS t, generate_subscripts(tools, 1) AS i) GROUP BY t)) ELSE '' END AS content FROM e WHERE {GOOD_SQL}""")
def substantive_exchanges(spark, sf):
    return I.exchanges(messages(spark, sf)).filter(I.substantive()).select("session", "exchange", I.exchange_content().alias("content"))


def _score(patterns, value):
    return f"CASE WHEN regexp_matches(low, {quoted('|'.join(patterns))}) THEN {value}::DOUBLE ELSE 0::DOUBLE END"


@query(f"""{SESSIONS_SQL}, l AS (SELECT *, lower("user" || ' ' || assistant) AS low FROM e) SELECT session, exchange, round(greatest(0.1::DOUBLE, least(0.9::DOUBLE, 0.3::DOUBLE + {_score(I.HIGH, 0.15)} + {_score(I.MEDIUM, 0.1)} + CASE WHEN len(tools) >= 5 THEN 0.1::DOUBLE WHEN len(tools) >= 2 THEN 0.05::DOUBLE ELSE 0::DOUBLE END + CASE WHEN length(assistant) > 1500 THEN 0.05::DOUBLE ELSE 0::DOUBLE END - {_score(I.LOW, 0.1)})), 6) AS importance FROM l""")
def exchange_importance(spark, sf):
    return I.exchanges(messages(spark, sf)).select("session", "exchange", F.round(I.exchange_importance(), 6).alias("importance"))


def _once(pattern, n, where="true"):
    return f"""(SELECT coalesce(string_agg(h, ',' ORDER BY i), '') FROM (SELECT h, min(i) AS i FROM (SELECT * FROM (SELECT h, row_number() OVER (ORDER BY j) AS i FROM (SELECT unnest(hs) AS h, generate_subscripts(hs, 1) AS j FROM (SELECT regexp_extract_all(t, {quoted(pattern)}) AS hs)) WHERE {where}) WHERE i <= {n}) GROUP BY h))"""


@query(f"""{SESSIONS_SQL}, t AS (SELECT session, exchange, "user" || ' ' || assistant AS t FROM e) SELECT session, exchange, {_once(I.FILE_PATH, 10, "NOT starts_with(h, 'http') AND NOT contains(h, '@')")} AS files, {_once(I.URL, 5)} AS urls, {_once(I.COMMIT, 5, "NOT regexp_full_match(h, '[0-9]+')")} AS commits,
({' OR '.join(f"contains(lower(t), {quoted(d)})" for d in I.DEPLOYED)}) AS deployed, list_extract(list_filter([{', '.join(map(quoted, I.MAIN_PROJECTS))}], lambda p: contains(lower(t), p)), 1) AS project FROM t""")
def exchange_metadata(spark, sf):
    e = I.exchanges(messages(spark, sf)).withColumn("m", I.exchange_metadata(F.concat_ws(" ", "user", "assistant")))
    return e.select("session", "exchange", *(F.array_join(f"m.{c}", ",").alias(c) for c in ("files", "urls", "commits")), "m.deployed", "m.project")


@query(f"""{SESSIONS_SQL} SELECT session, exchange, array_to_string(list_filter([{', '.join(map(quoted, I.ALL_PROJECTS))}], lambda p: contains(lower("user" || ' ' || assistant), p)), ',') AS projects FROM e""")
def projects_detected(spark, sf):
    e = I.exchanges(messages(spark, sf))
    return e.select("session", "exchange", F.array_join(I.projects(F.concat_ws(" ", "user", "assistant")), ",").alias("projects"))


@query(f"""{SESSIONS_SQL}, p AS (SELECT *, {trim_sql("replace(substring(\"user\", 1, 100), chr(10), ' ')")} AS topic, list_extract(list_filter([{', '.join(map(quoted, I.MAIN_PROJECTS))}], lambda p: contains(lower("user" || ' ' || assistant), p)), 1) AS project FROM e),
s AS (SELECT session, count(*) AS exchanges, list(topic ORDER BY exchange) FILTER (length(topic) > 15) AS topics FROM p GROUP BY session HAVING count(*) >= 3),
pr AS (SELECT session, string_agg(project, ', ' ORDER BY x) AS projects FROM (SELECT session, project, min(exchange) AS x FROM p WHERE project IS NOT NULL GROUP BY ALL) GROUP BY session),
tl AS (SELECT session, string_agg(t, ', ' ORDER BY x, i) AS tools FROM (SELECT session, t, min(exchange) AS x, min_by(i, exchange * 1000 + i) AS i FROM (SELECT session, exchange, unnest(tools) AS t, generate_subscripts(tools, 1) AS i FROM e) GROUP BY session, t) GROUP BY session)
SELECT session, exchanges, concat_ws(chr(10), 'Session ' || substring(session::VARCHAR, 1, 8) || ' — ' || exchanges || ' exchanges', 'Projects: ' || projects, 'Tools: ' || tools, CASE WHEN len(topics) > 0 THEN 'Topics:' || chr(10) || array_to_string(list_transform(list_slice(topics, 1, 8), lambda t: '- ' || t), chr(10)) END) AS summary FROM s LEFT JOIN pr USING (session) LEFT JOIN tl USING (session)""")
def session_summary(spark, sf):
    return I.session_summary(I.exchanges(messages(spark, sf)))
