"""Queries of the graph, of clusters and of contradictions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remembra.operators import beliefs as B
from remembra.operators import clusters as C
from remembra.operators import contradictions as K
from remembra.operators import graph as G
from remembra.operators import ingest as I
from remembra.operators import maintenance as M
from remembra.operators import writes as Wr
from remembra.operators.blocks import knn
from remembra.plans.intake import EXTRACTED_SQL, TRANSCRIPT_SQL, quoted, transcript_lines
from remembra.plans.search import DISTANCE_SQL, TOKENS_SQL, rounded, run_search, search_sql, trim_sql, vector_table
from remembra.plans.upkeep import WORDS_SQL
from remembra.sources.memories import MEMORIES_SQL, files_of, memories, moment, table
from remembra.sources.store import stored, workspace

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- entities of texts ----

SAID = [" See https://a.example.com/x, and (https://b.example.org/y).", " It was 2024-01-05 or Jan 5, 2024 here.", " They met Acme Labs and Big Data Systems today.", " Then said Ada Lovelace to Bob Stone.", " Acme Labs uses Big Data Systems.", "", " The next day Ada Lovelace left."]


def noted(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, SAID)), (F.col("id") % len(SAID) + 1).cast("int"))
    more = F.element_at(F.array(*map(F.lit, SAID)), (F.col("id") * 3 % len(SAID) + 1).cast("int"))
    return memories(spark, sf).select("id", F.concat(F.coalesce("content", F.lit("")), tail, more).alias("content"))


_TAILS = "[" + ", ".join(map(quoted, SAID)) + "]"
_C = ", ".join(map(quoted, G.COMMON))
ENTITIES_SQL = rf"""WITH noted AS (SELECT doc_id AS id, coalesce(text, '') || list_extract({_TAILS}, (doc_id % {len(SAID)} + 1)::INT) || list_extract({_TAILS}, (doc_id * 3 % {len(SAID)} + 1)::INT) AS content FROM documents),
sents AS (SELECT id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS s FROM (SELECT id, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM noted)),
toks AS (SELECT id, s, unnest(ts) AS t, generate_subscripts(ts, 1) AS k FROM (SELECT id, s, list_transform(string_split_regex({trim_sql('sentence')}, '\s+'), lambda t: regexp_replace(t, '^[^a-zA-Z'']+|[^a-zA-Z'']+$', '', 'g')) AS ts FROM sents)),
good AS (SELECT *, k - row_number() OVER (PARTITION BY id, s ORDER BY k) AS island FROM toks WHERE k >= 2 AND length(t) >= 2 AND regexp_matches(t, '^[A-Z][a-z]') AND t NOT IN ({_C})),
runs AS (SELECT *, row_number() OVER (PARTITION BY id, s, island ORDER BY k) AS p, lead(t) OVER (PARTITION BY id, s, island ORDER BY k) AS nxt FROM good),
found AS (SELECT id, 1 AS c, 0 AS s, i AS k, {trim_sql('n')} AS name, 'url' AS type FROM (SELECT id, unnest(x) AS n, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(content, {quoted(G.URL)}) AS x FROM noted))
 UNION ALL SELECT id, 2, 0, i, {trim_sql('n')}, 'date' FROM (SELECT id, unnest(x) AS n, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(content, {quoted(G.DATE)}, 1) AS x FROM noted))
 UNION ALL SELECT id, 3, 0, i, {trim_sql('n')}, 'company' FROM (SELECT id, unnest(x) AS n, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(content, {quoted(G.COMPANY)}, 1) AS x FROM noted))
 UNION ALL SELECT id, 4, s, k, t || ' ' || nxt, 'person' FROM runs WHERE p % 2 = 1 AND nxt IS NOT NULL),
entities AS (SELECT id, name, type, row_number() OVER (PARTITION BY id ORDER BY c, s, k) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(name) ORDER BY c, s, k) AS n FROM found WHERE length(name) BETWEEN 2 AND 120) WHERE n = 1)"""


@query(f"{ENTITIES_SQL} SELECT id, name, type FROM entities")
def entities_extracted(spark, sf):
    return G.entities(noted(spark, sf)).select("id", "name", "type")


@query(f"{ENTITIES_SQL} SELECT lower(name) AS entity, min_by(name, id * 100000 + place) AS name, min_by(type, id * 100000 + place) AS type, count(DISTINCT id) AS mentions FROM entities GROUP BY lower(name)")
def entity_upsert(spark, sf):
    return G.upserted(G.entities(noted(spark, sf)))


@query(f"""{ENTITIES_SQL}, t AS (SELECT s.id, s.s, e.name, row_number() OVER (PARTITION BY s.id, s.s ORDER BY e.place) AS r FROM sents s JOIN entities e ON e.id = s.id AND contains(lower(s.sentence), lower(e.name)))
SELECT DISTINCT a.id, lower(a.name) AS source, lower(b.name) AS target FROM t a JOIN t b ON a.id = b.id AND a.s = b.s AND a.r < b.r WHERE a.r <= 6 AND b.r <= 6""")
def entity_cooccurrence(spark, sf):
    m = noted(spark, sf)
    return G.together(m, G.entities(m))


_VERB = quoted(G.VERB)
RELATIONS_SQL = f"""{ENTITIES_SQL}, e AS (SELECT id, lower(name) AS name, place FROM entities), many AS (SELECT id FROM e GROUP BY id HAVING count(*) >= 2),
near AS (SELECT *, row_number() OVER (PARTITION BY id, s ORDER BY place) AS r FROM (SELECT t.id, t.s, t.sentence, e.name, e.place FROM sents t JOIN e ON e.id = t.id AND contains(lower(t.sentence), e.name) WHERE t.id IN (SELECT id FROM many))),
two AS (SELECT DISTINCT id, s, sentence FROM near WHERE r = 2),
cut AS (SELECT id, s, string_split_regex(sentence, {_VERB}) AS parts, regexp_extract_all(sentence, {_VERB}, 1) AS verbs FROM two),
hits AS (SELECT id, s, unnest(range(1, len(parts))) AS i, parts, verbs FROM cut),
src AS (SELECT h.id, h.s, h.i, arg_max(e.name, length(e.name)) AS a FROM hits h JOIN e ON e.id = h.id AND ends_with(lower(h.parts[h.i]), e.name) GROUP BY ALL),
tgt AS (SELECT h.id, h.s, h.i, lower(h.verbs[h.i]) AS relation, arg_min(e.name, e.place) AS b FROM hits h JOIN e ON e.id = h.id AND starts_with(lower(h.parts[h.i + 1]), e.name) GROUP BY ALL),
said AS (SELECT id, s, a, b, relation FROM src JOIN tgt USING (id, s, i) WHERE a <> b),
weak AS (SELECT x.id, x.s, x.name AS a, y.name AS b FROM near x JOIN near y ON x.id = y.id AND x.s = y.s AND x.r < y.r WHERE y.r <= 6)
SELECT DISTINCT id, a AS source, b AS target, relation, 0.8::DOUBLE AS weight FROM said UNION SELECT DISTINCT id, a, b, 'co-occurs-with', 0.3::DOUBLE FROM weak w WHERE NOT EXISTS (SELECT 1 FROM said t WHERE t.id = w.id AND t.s = w.s AND ((t.a = w.a AND t.b = w.b) OR (t.a = w.b AND t.b = w.a)))"""


@query(RELATIONS_SQL)
def entity_relations_svo(spark, sf):
    m = noted(spark, sf)
    return G.relationships(m, G.entities(m))


#: The graph's tables of each data folder that this process has asked, by application and the folder's files.
_GRAPHS: dict[tuple, DataFrame] = {}


def graph_table(spark, sf, which):
    """Entities (0), mentions (1) or relations (2) of the folder's notes; the first query that needs one writes it, as a store keeps them beside its rows."""
    key = (spark.sparkContext.applicationId, files_of(spark, sf, "documents", "labels"), which)
    if key not in _GRAPHS:
        made = G.tables(noted(spark, sf))
        for k, table_ in enumerate(made):
            # entities and mentions come of one extraction, which is written; relations wait until they are asked for
            if k == which or k < 2 and which < 2:
                _GRAPHS[key[:2] + (k,)] = stored(table_, f"{workspace(spark, 'graph')}/{k}")
    return _GRAPHS[key]


QUESTION = "Then what did Ada Lovelace say of Acme Labs?"


@query(search_sql(score="CASE WHEN id IN (SELECT id FROM entities WHERE lower(name) IN ('ada lovelace', 'acme labs')) THEN least(1::DOUBLE, score + 0.15::DOUBLE) ELSE score END", min_score=0.1, extra=", " + ENTITIES_SQL.removeprefix("WITH ")))
def search_graph_boost(spark, sf):
    linked = G.linked_memories(graph_table(spark, sf, 1), G.query_entities(graph_table(spark, sf, 0), QUESTION)).withColumnRenamed("memory", "id")
    return run_search(spark, sf, boosted=linked, min_score=0.1)


@query(f"{ENTITIES_SQL} SELECT DISTINCT md5(lower(name)) AS entity, id AS memory FROM entities")
def graph_mentions(spark, sf):
    return graph_table(spark, sf, 1).select("entity", "memory")


@query(f"SELECT md5(source) AS source, md5(target) AS target, relation, weight, id AS memory FROM ({RELATIONS_SQL})")
def graph_relations(spark, sf):
    return graph_table(spark, sf, 2).select("source", "target", "relation", "weight", "memory")


# ---- the graph of customers, suppliers, nations and regions ----


def star(spark, sf):
    t = lambda n: table(spark, sf, n)
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    nodes = (
        t("customer").select(key("c", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("type"))
        .union(t("supplier").select(key("s", "s_suppkey"), "s_name", F.lit("supplier")))
        .union(t("nation").select(key("n", "n_nationkey"), "n_name", F.lit("nation")))
        .union(t("region").select(key("r", "r_regionkey"), "r_name", F.lit("region")))
    )
    edges = (
        t("customer").select(key("c", "c_custkey").alias("source"), key("n", "c_nationkey").alias("target"), F.lit("lives in").alias("relation"), F.lit(0.8).alias("weight"))
        .union(t("supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey"), F.lit("based in"), F.lit(0.3)))
        .union(t("nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"), F.lit("part of"), F.lit(0.8)))
    )
    return nodes, edges


STAR_SQL = """WITH RECURSIVE nodes AS (SELECT 'c:' || c_custkey AS id, c_name AS name, 'customer' AS type FROM customer UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'r:' || r_regionkey, r_name, 'region' FROM region),
edges AS (SELECT 'c:' || c_custkey AS source, 'n:' || c_nationkey AS target, 'lives in' AS relation, 0.8::DOUBLE AS weight FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'based in', 0.3 FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'part of', 0.8 FROM nation)"""


@query(f"{STAR_SQL} SELECT id, name, type FROM nodes WHERE contains(lower(name), '1') ORDER BY lower(name) = '1' DESC, length(name), id LIMIT 1")
def entity_lookup(spark, sf):
    return G.lookup(star(spark, sf)[0], "1")


@query(f"{STAR_SQL} SELECT id, name, type FROM nodes WHERE contains(lower(name), '00') ORDER BY name, id LIMIT 20")
def entity_fuzzy(spark, sf):
    return G.fuzzy(star(spark, sf)[0], "00")


@query(f"{STAR_SQL} SELECT direction, relation, weight, other, name FROM (SELECT 'out' AS direction, relation, weight, target AS other FROM edges WHERE source = 'n:3' UNION ALL SELECT 'in', relation, weight, source FROM edges WHERE target = 'n:3') JOIN nodes ON id = other")
def entity_relationships(spark, sf):
    nodes, edges = star(spark, sf)
    return G.of_entity(edges, nodes, "n:3")


@query(f"{STAR_SQL} SELECT DISTINCT source AS memory FROM edges WHERE target IN (SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def linked_memories(spark, sf):
    nodes, edges = star(spark, sf)
    ids = edges.filter("target = 'r:1'").select(F.col("source").alias("entity"))
    return G.linked_memories(edges.select(F.col("target").alias("entity"), F.col("source").alias("memory")), ids)


@query(f"""{STAR_SQL}, steps AS (SELECT source AS parent, '→' || relation || '→' AS label, target AS id FROM edges UNION ALL SELECT target, '←' || relation || '←', source FROM edges),
l1 AS (SELECT id, 1 AS depth, min((parent, label)) AS p FROM steps WHERE parent = 'n:3' GROUP BY id),
l2 AS (SELECT s.id, 2 AS depth, min((s.parent, s.label)) AS p FROM steps s JOIN l1 ON s.parent = l1.id WHERE s.id <> 'n:3' AND s.id NOT IN (SELECT id FROM l1) GROUP BY s.id)
SELECT 'n:3' AS id, 0 AS depth, NULL AS parent, NULL AS label UNION ALL SELECT id, depth, p[1], p[2] FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2)""")
def graph_bfs(spark, sf):
    return G.traverse(star(spark, sf)[1], spark.createDataFrame([("n:3",)], "id string"))


@query(f"{STAR_SQL}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) SELECT n.id, n.name, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN d USING (id) ORDER BY degree DESC, n.id LIMIT 10")
def graph_degree_top(spark, sf):
    nodes, edges = star(spark, sf)
    return G.degrees(edges, nodes).orderBy(F.col("degree").desc(), "id").limit(10)


@query(f"{STAR_SQL} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def graph_type_counts(spark, sf):
    return star(spark, sf)[0].groupBy("type").agg(F.count("*").alias("n"))


# ---- clusters ----

#: Least cosine of the embeddings' clusters; those of the documents' hashed vectors follow the store's own thresholds.
NEAR, LEADER, SAME, COPY = 0.35, 0.98, 0.99, 0.95


def leaders_sql(edges: str) -> str:
    """`leaders`: (seed, member), from `ranked` (id, rank) and edges (a, b), by the pass itself, one row at a time."""
    return f"""e AS ({edges}), nb AS (SELECT r.rank, coalesce(list(s.rank) FILTER (s.rank < r.rank), []) AS ns FROM ranked r LEFT JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) x ON x.a = r.id LEFT JOIN ranked s ON s.id = x.b GROUP BY r.rank),
st AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS seeds UNION ALL SELECT k + 1, CASE WHEN list_has_any(seeds, ns) THEN seeds ELSE list_append(seeds, k + 1) END FROM st JOIN nb ON nb.rank = k + 1),
last AS (SELECT seeds FROM st ORDER BY k DESC LIMIT 1),
leaders AS (SELECT s.id AS seed, m.id AS member FROM (SELECT nb.rank, list_min(list_intersect(ns, seeds)) AS seed FROM nb, last WHERE NOT list_contains(seeds, nb.rank)) x JOIN ranked s ON s.rank = x.seed JOIN ranked m ON m.rank = x.rank)"""


def hashed_sql(least: float, strict: bool = False) -> str:
    """`pairs`: (a, b) of documents by the cosine of their hashed vectors."""
    return f"""tf AS (SELECT doc_id AS id, ('0x' || substring(md5(t), 1, 6))::INT % {C.DIMENSIONS} AS k, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS t FROM documents) GROUP BY ALL),
size AS (SELECT id, sqrt(sum(n * n)) AS s FROM tf GROUP BY id),
dots AS (SELECT x.id AS a, y.id AS b, sum(x.n * y.n) AS d FROM tf x JOIN tf y ON x.k = y.k AND x.id < y.id GROUP BY ALL),
pairs AS (SELECT a, b FROM dots JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE d / (p.s * q.s) {'>' if strict else '>='} {least})"""


EMBEDDED_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding AS x, sqrt(list_sum(list_transform(embedding, lambda t: t::DOUBLE * t::DOUBLE))) AS s FROM embeddings),
pairs AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id WHERE list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (a.s * b.s) >= {NEAR})"""


@query(f"{EMBEDDED_SQL}, ranked AS (SELECT id, row_number() OVER (ORDER BY -(id % 10), id) AS rank FROM v), {leaders_sql('SELECT a, b FROM pairs')} SELECT seed, member FROM leaders")
def leader_clusters(spark, sf):
    v = vector_table(spark, sf)
    keys = v.select("id", F.struct((-(F.col("id") % 10)).alias("i"), "id").alias("key"))
    return C.leaders(v, keys, NEAR)


@query(MEMORIES_SQL.replace("WITH typed", "WITH RECURSIVE typed", 1) + f", {hashed_sql(LEADER)}, ranked AS (SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS rank FROM memories WHERE id IN (SELECT a FROM pairs UNION SELECT b FROM pairs)), {leaders_sql('SELECT a, b FROM pairs')} SELECT seed, count(*) + 1 AS size FROM leaders GROUP BY seed")
def consolidation_clusters(spark, sf):
    m = memories(spark, sf)
    keys = m.select("id", F.struct((-F.col("importance")).alias("i"), "id").alias("key"))
    found = C.leaders(C.hashed_vectors(m), keys, LEADER)
    return found.groupBy("seed").agg((F.count("*") + 1).alias("size"))


@query(MEMORIES_SQL.replace("WITH typed", "WITH RECURSIVE typed", 1) + f", {hashed_sql(COPY, True)}, ranked AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS rank FROM memories WHERE id IN (SELECT a FROM pairs UNION SELECT b FROM pairs)), {leaders_sql('SELECT a, b FROM pairs')} SELECT seed, member FROM leaders")
def audit_duplicates(spark, sf):
    m = memories(spark, sf)
    return C.leaders(C.hashed_vectors(m), m.select("id", F.struct("created_at", "id").alias("key")), COPY, strict=True)


@query(MEMORIES_SQL.replace("WITH typed", "WITH RECURSIVE typed", 1) + f""", {hashed_sql(SAME)}, sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS x, a AS y FROM sym UNION SELECT reach.x, sym.b FROM reach JOIN sym ON reach.y = sym.a), comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x)
SELECT component, arg_min(id, (-importance, created_at, id)) AS keep, count(*) - 1 AS removed FROM comp JOIN memories USING (id) GROUP BY component""")
def dedup_components(spark, sf):
    m = memories(spark, sf)
    found, _ = C.groups(C.hashed_vectors(m), SAME)
    return C.keepers(found, m)


@query(TRANSCRIPT_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + f""", seg AS (SELECT file, file || ':' || n || ':' || k AS id, n, k, list_distinct({WORDS_SQL.format('segment', 4)}) AS w FROM segments),
ranked AS (SELECT id, row_number() OVER (ORDER BY file, n, k) AS rank FROM seg), {leaders_sql('SELECT x.id AS a, y.id AS b FROM seg x JOIN seg y ON x.file = y.file AND x.id < y.id WHERE least(len(x.w), len(y.w)) > 0 AND len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)) > 0.7')} SELECT seed, member FROM leaders""")
def containment_dedup(spark, sf):
    s = I.segments(transcript_lines(spark, sf)).withColumn("id", F.concat_ws(":", "file", "n", "k"))
    keys = s.select("id", F.struct("file", "n", "k").alias("key"))
    return C.leader_clusters(C.containment_edges(s.select("file", "id", F.col("segment").alias("text"))), keys)


@query(EXTRACTED_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + f""", seg AS (SELECT *, file || ':' || n || ':' || k || ':' || j AS id, list_distinct({WORDS_SQL.format('content', 4)}) AS w FROM mem),
ranked AS (SELECT id, row_number() OVER (ORDER BY file, n, k, j) AS rank FROM seg), {leaders_sql('SELECT x.id AS a, y.id AS b FROM seg x JOIN seg y ON x.file = y.file AND x.id < y.id WHERE least(len(x.w), len(y.w)) > 0 AND len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)) > 0.7')}
SELECT file, n, k, j, type, importance, namespace, tag, content FROM seg WHERE id NOT IN (SELECT member FROM leaders)""")
def transcript_extract(spark, sf):
    return I.extracted(transcript_lines(spark, sf)).withColumn("tag", F.array_join("tags", ",")).drop("tags", "source")


@query(MEMORIES_SQL.replace("WITH typed", "WITH RECURSIVE typed", 1) + f""", {hashed_sql(SAME)}, cosines AS (SELECT a, b, d / (p.s * q.s) AS c FROM dots JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE d / (p.s * q.s) >= {SAME}), sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS x, a AS y FROM sym UNION SELECT reach.x, sym.b FROM reach JOIN sym ON reach.y = sym.a), comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x),
g AS (SELECT component, arg_min(id, (-importance, created_at, id)) AS keep FROM comp JOIN memories USING (id) GROUP BY component), s AS (SELECT component, round(max(c), 4) AS similarity FROM cosines JOIN comp ON id = a GROUP BY component)
SELECT component, keep, id, similarity FROM comp JOIN g USING (component) JOIN s USING (component) WHERE id <> keep""")
def dedup_apply(spark, sf):
    m = memories(spark, sf)
    found, links = C.groups(C.hashed_vectors(m), SAME)
    return C.dedup_groups(found, links, m)


# ---- contradictions ----

CLAIMS = [" The service is working now.", " The service is not working now.", " The plan costs $49 per month.", " The plan costs $1.5k per month.", " It has 10 users today.", " It has 300 users today.", " The flag is disabled.", " The flag is enabled and 50% done."]


def claimed(spark, sf):
    c = table(spark, sf, "conversations")
    tail = lambda k: F.element_at(F.array(*map(F.lit, CLAIMS)), (k % len(CLAIMS) + 1).cast("int"))
    at = lambda d: F.timestamp_micros(F.unix_micros(moment("2024-01-01 00:00:00")) + d * 86_400_000_000)
    id_ = F.col("conv_id") * 1000 + F.col("turn")
    text = F.coalesce("text", F.lit(""))
    a = c.select((id_ * 2).alias("id"), F.concat(text, tail(F.col("turn"))).alias("content"), at(F.col("turn")).alias("created_at"))
    b = c.select((id_ * 2 + 1).alias("id"), F.concat(text, tail(F.col("turn") + 1 + F.col("conv_id") % 4)).alias("content"), at(F.col("turn") + F.col("conv_id") % 2).alias("created_at"))
    return a, b


def contradicted(spark, sf):
    a, b = claimed(spark, sf)
    return K.scored(K.features(a, "a").join(K.features(b, "b"), F.col("b_id") == F.col("a_id") + 1))


def contradicted_once(spark, sf):
    """contradicted, scored once and written, for queries that read it several times."""
    rows = contradicted(spark, sf).select("a_id", "b_id", "a_at", "b_at", "overlap", "score", "kind")
    return stored(rows, f"{workspace(spark, 'contradicted')}/rows")


_CL = "[" + ", ".join(map(quoted, CLAIMS)) + "]"
_STOP = ", ".join(map(quoted, K.STOP_WORDS))


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\\s''-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"


def features_sql(x: str) -> str:
    return f"""{words_sql(x)} AS words, list_filter(list_transform(string_split_regex({x}, '[.!?\\n]+'), lambda s: {trim_sql('s')}), lambda s: length(s) > 8 AND len(string_split_regex(s, '\\s+')) >= 3) AS said, lower({x}) AS low,
 list_concat(list_concat(list_transform(regexp_extract_all({x}, {quoted(K.DOLLAR)}, 1), lambda r: regexp_replace(replace(lower(r), ',', ''), '[kmb]', '')::DOUBLE * CASE WHEN suffix(lower(r), 'k') THEN 1e3::DOUBLE WHEN suffix(lower(r), 'm') THEN 1e6::DOUBLE WHEN suffix(lower(r), 'b') THEN 1e9::DOUBLE ELSE 1::DOUBLE END),
  list_transform(regexp_extract_all({x}, {quoted(K.PERCENT)}, 1), lambda r: r::DOUBLE)), list_transform(regexp_extract_all({x}, {quoted(K.COUNT)}, 1), lambda r: r::DOUBLE)) AS nums"""


def opposed_sql(a: str, b: str) -> str:
    return "(" + " OR ".join(f"(contains({a}, {quoted(w)}) AND (" + " OR ".join(f"contains({b}, {quoted(o)})" for o in os) + "))" for w, os in K.OPPOSITES.items()) + ")"


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1::DOUBLE ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


CONTRADICTIONS_SQL = f"""WITH c AS (SELECT (conv_id * 1000 + turn) * 2 AS id, conv_id, turn, coalesce(text, '') || list_extract({_CL}, (turn % {len(CLAIMS)} + 1)::INT) AS a, coalesce(text, '') || list_extract({_CL}, ((turn + 1 + conv_id % 4) % {len(CLAIMS)} + 1)::INT) AS b FROM conversations),
fa AS (SELECT id, conv_id, turn, {features_sql('a')} FROM c), fb AS (SELECT id, {features_sql('b')} FROM c),
sa AS (SELECT id, s, list_distinct({words_sql('s')}) AS w, regexp_matches(s, {quoted(K.NEGATION)}) AS neg FROM (SELECT id, unnest(said) AS s FROM fa)),
sb AS (SELECT id, s, list_distinct({words_sql('s')}) AS w, regexp_matches(s, {quoted(K.NEGATION)}) AS neg FROM (SELECT id, unnest(said) AS s FROM fb)),
neg AS (SELECT id, max(least(0.95::DOUBLE, 0.45::DOUBLE + sim * 0.75::DOUBLE)) AS score FROM (SELECT sa.id, {jaccard_sql('sa.w', 'sb.w')} AS sim FROM sa JOIN sb ON sa.id = sb.id AND sa.neg <> sb.neg) WHERE sim > 0.45 GROUP BY id),
o AS (SELECT fa.id, conv_id, turn, {jaccard_sql('fa.words', 'fb.words')} AS overlap, fa.low AS al, fb.low AS bl, fa.nums AS an, fb.nums AS bn FROM fa JOIN fb USING (id)),
num AS (SELECT DISTINCT id FROM (SELECT o.id, overlap, x, y FROM o, unnest(an) AS p(x), unnest(bn) AS q(y)) WHERE x <> y AND (CASE WHEN least(x, y) = 0 THEN 10 ELSE greatest(x, y) / least(x, y) END > 1.5 OR (CASE WHEN least(x, y) = 0 THEN 10 ELSE greatest(x, y) / least(x, y) END > 1.1 AND overlap > 0.5))),
s AS (SELECT o.id AS a, o.id + 1 AS b, conv_id, turn, overlap, coalesce(neg.score, 0) AS n,
 CASE WHEN overlap > 0.15 AND ({opposed_sql('al', 'bl')} OR {opposed_sql('bl', 'al')}) THEN least(0.9::DOUBLE, 0.4::DOUBLE + overlap * 0.7::DOUBLE) ELSE 0::DOUBLE END AS st,
 CASE WHEN overlap > 0.25 AND o.id IN (SELECT id FROM num) THEN least(0.92::DOUBLE, 0.35::DOUBLE + overlap * 0.7::DOUBLE) ELSE 0::DOUBLE END AS nu FROM o LEFT JOIN neg USING (id)),
scored AS (SELECT *, greatest(n, st, nu) AS score, CASE WHEN n >= st AND n >= nu THEN 'negation' WHEN st >= nu THEN 'status' ELSE 'numerical' END AS kind FROM s WHERE greatest(n, st, nu) >= 0.3),
temporal AS (SELECT a, b, overlap, CASE WHEN conv_id % 2 = 1 AND overlap >= 0.35 AND score >= 0.45 THEN least(0.98::DOUBLE, score + 0.08::DOUBLE) ELSE score END AS score, CASE WHEN conv_id % 2 = 1 AND overlap >= 0.35 AND score >= 0.45 THEN 'temporal' ELSE kind END AS kind FROM scored)"""


@query(f"{CONTRADICTIONS_SQL} SELECT a, b, round(overlap, 6) AS overlap, round(score, 6) AS score, kind FROM scored")
def contradiction_score(spark, sf):
    return rounded(contradicted(spark, sf).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "overlap", "score", "kind"))


@query(f"{CONTRADICTIONS_SQL} SELECT a, b, round(score, 6) AS score, kind FROM temporal")
def temporal_contradiction(spark, sf):
    return rounded(K.temporal(contradicted(spark, sf)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "score", "kind"))


@query(f"{CONTRADICTIONS_SQL} SELECT s.a AS memory_a, s.b AS memory_b, round(greatest(s.score, t.score), 6) AS score, s.kind FROM scored s JOIN temporal t ON s.a = t.a")
def contradiction_upsert(spark, sf):
    first = contradicted_once(spark, sf)
    cols = lambda df, x, y, at: df.select(F.col(x).alias("a"), F.col(y).alias("b"), "score", "kind", F.lit(at).alias("at"))
    return rounded(K.upserted(cols(first, "a_id", "b_id", 1).union(cols(K.temporal(first), "b_id", "a_id", 2))))


KEPT_SQL = f"{CONTRADICTIONS_SQL}, kept AS (SELECT a AS id, a AS memory_a, b AS memory_b, round(score, 6) AS score, kind, a % 1000 AS created, CASE WHEN a % 3 = 0 THEN 'settled' END AS resolution FROM temporal)"


def kept(spark, sf, made=contradicted):
    """Contradictions as they are kept; every third is resolved."""
    c = K.temporal(made(spark, sf))
    at = lambda s: F.timestamp_micros(F.unix_micros(moment("2024-01-01 00:00:00")) + s * 1_000_000)
    done = F.col("a_id") % 3 == 0
    return c.select(F.col("a_id").alias("id"), F.col("a_id").alias("memory_a"), F.col("b_id").alias("memory_b"), F.round("score", 6).alias("score"), "kind", at(F.col("a_id") % 1000).alias("created_at"), F.when(done, "settled").alias("resolution"), F.when(done, at(F.lit(0))).alias("resolved_at"))


@query(f"{KEPT_SQL} SELECT id, memory_a, memory_b, score, kind FROM kept WHERE resolution IS NULL ORDER BY kept.score DESC, created DESC, id LIMIT 50")
def contradictions_unresolved(spark, sf):
    return K.unresolved(kept(spark, sf)).limit(50).select("id", "memory_a", "memory_b", "score", "kind")


@query(f"{KEPT_SQL} SELECT id, memory_a, memory_b, score, kind FROM kept WHERE memory_a IN (4, 6004, 8001) OR memory_b IN (4, 6004, 8001)")
def contradictions_of_memory(spark, sf):
    rows = kept(spark, sf, contradicted_once)
    of = [K.of_memory(rows, i) for i in (4, 6004, 8001)]
    return of[0].union(of[1]).union(of[2]).select("id", "memory_a", "memory_b", "score", "kind").distinct()


@query(f"{KEPT_SQL} SELECT id, CASE WHEN id = 6004 AND resolution IS NULL THEN 'by hand' ELSE resolution END AS resolution FROM kept")
def contradictions_resolved(spark, sf):
    rows = K.resolved(kept(spark, sf), 6004, "by hand", moment())
    return rows.select("id", F.when(F.col("resolved_at").isNotNull(), F.col("resolution")).alias("resolution"))


@query(f"""{CONTRADICTIONS_SQL}, f AS (SELECT b AS new, a // 4 AS old, round(score, 6) AS score FROM temporal), bel AS (SELECT DISTINCT id, (id % 10) / 10::DOUBLE AS confidence, id % 3 AS domain FROM (SELECT new AS id FROM f UNION SELECT old FROM f)),
r AS (SELECT f.old, f.new, f.score > 0.8::DOUBLE AND n.domain = o.domain AS resolve, row_number() OVER (PARTITION BY f.old ORDER BY f.score DESC, f.new) AS k FROM f JOIN bel n ON n.id = f.new JOIN bel o ON o.id = f.old WHERE n.confidence >= o.confidence) SELECT old, new, resolve FROM r WHERE k = 1""")
def beliefs_superseded(spark, sf):
    found = K.temporal(contradicted_once(spark, sf)).select(F.col("b_id").alias("new"), F.floor(F.col("a_id") / 4).cast("long").alias("old"), F.round("score", 6).alias("score"))
    ids = found.select(F.col("new").alias("id")).union(found.select("old")).distinct()
    return K.superseded(found, ids.select("id", (F.col("id") % 10 / 10.0).alias("confidence"), (F.col("id") % 3).alias("domain")))


@query(f"{CONTRADICTIONS_SQL} SELECT id, len(words) AS n_words, len(said) AS n_sentences, len(list_filter(said, lambda s: regexp_matches(s, {quoted(K.NEGATION)}))) AS n_negated FROM fa")
def negation_sentences(spark, sf):
    a, _ = claimed(spark, sf)
    f = K.features(a, "a")
    return f.select(F.col("a_id").alias("id"), F.size("a_words").cast("long").alias("n_words"), F.size("a_said").cast("long").alias("n_sentences"), F.size(F.filter("a_said", lambda s: s["n"])).cast("long").alias("n_negated"))


@query(f"{CONTRADICTIONS_SQL} SELECT id, array_to_string(list_transform(nums, lambda x: x::BIGINT), ',') AS numbers FROM fb")
def number_extract(spark, sf):
    _, b = claimed(spark, sf)
    return K.features(b, "b").select((F.col("b_id") - 1).alias("id"), F.array_join(F.transform("b_numbers", lambda x: F.round(x).cast("long").cast("string")), ",").alias("numbers"))


@query(f"{CONTRADICTIONS_SQL} SELECT id, round(overlap, 6) AS overlap FROM o")
def content_words_jaccard(spark, sf):
    a, b = claimed(spark, sf)
    p = K.features(a, "a").join(K.features(b, "b"), F.col("b_id") == F.col("a_id") + 1)
    return rounded(p.select(F.col("a_id").alias("id"), K.jaccard(F.col("a_words"), F.col("b_words")).alias("overlap")))


def _of_kind(kind: str):
    def ask(spark, sf):
        found = contradicted(spark, sf).filter(F.col("kind") == kind)
        return rounded(found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "score"))

    ask.__name__ = f"{kind}_pairs"
    return query(f"{CONTRADICTIONS_SQL} SELECT a, b, round(score, 6) AS score FROM scored WHERE kind = '{kind}'")(ask)


negation_pairs, status_pairs, numerical_pairs = map(_of_kind, ("negation", "status", "numerical"))


# ---- writes ----


@query(f"""WITH n AS (SELECT doc_id, text, source, row_number() OVER (PARTITION BY text, source ORDER BY doc_id) AS n FROM documents), h AS (SELECT *, sha256(source || chr(1) || text || chr(1) || n) AS h FROM n)
SELECT substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS id, 'general' AS namespace, 'semantic' AS type, 0.5::DOUBLE AS importance, source, 0::BIGINT AS access_count FROM h""")
def prepared_rows(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("text").alias("content"), "source")
    return Wr.prepared(rows, moment()).select("id", "namespace", "type", "importance", "source", "access_count")


@query(f"""WITH s AS (SELECT (conv_id * 1000 + turn) * 2 AS id, lower(coalesce(text, '') || list_extract({_CL}, (turn % {len(CLAIMS)} + 1)::INT)) AS low FROM conversations),
f AS (SELECT *, list_extract(list_filter(string_split(low, ' '), lambda w: length(w) > 3), 1) AS first FROM s)
SELECT id, array_to_string(list_filter([CASE WHEN contains(low, 'is not') THEN regexp_replace(low, 'is not', 'is') WHEN contains(low, ' is ') THEN regexp_replace(low, ' is ', ' is not ') END,
 CASE WHEN contains(low, 'distribution') THEN regexp_replace(low, 'distribution', 'product') END, CASE WHEN contains(low, 'product') THEN regexp_replace(low, 'product', 'distribution') END,
 first || ' problems', first || ' issues', first || ' needs improvement'], lambda q: q IS NOT NULL), ' | ') AS queries FROM f""")
def challenge_queries(spark, sf):
    a, _ = claimed(spark, sf)
    return a.select("id", F.array_join(Wr.challenge_queries(F.col("content")), " | ").alias("queries"))


NEIGHBOURS_SQL = f"""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS id, 1 / (1 + {DISTANCE_SQL.format('a.embedding', 'b.embedding')}) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
near AS (SELECT *, rank() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank FROM p QUALIFY rank <= 6)"""


def neighbours(spark, sf):
    v = vector_table(spark, sf)
    return knn(v, v, 6).withColumn("vector_score", 1 / (1 + F.col("distance")))


@query(f"{NEIGHBOURS_SQL}, m AS (SELECT q, arg_min(id, rank) AS merged_into FROM near WHERE s > 0.9 GROUP BY q) SELECT vec_id AS id, merged_into FROM embeddings LEFT JOIN m ON q = vec_id")
def belief_restated(spark, sf):
    return B.stated_again(vector_table(spark, sf).select("id"), neighbours(spark, sf))


@query(f"""{NEIGHBOURS_SQL}, r AS (SELECT q AS belief, rank % 3 AS query_no, id // 2 AS id, CASE WHEN id % 5 = 0 THEN 'belief' ELSE 'fact' END AS type, round(s, 6) AS score FROM near),
f AS (SELECT *, row_number() OVER (PARTITION BY belief, id ORDER BY query_no, score DESC) AS n FROM r WHERE type <> 'belief') SELECT belief, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY belief ORDER BY score DESC, id)::INT AS rank FROM f WHERE n = 1) WHERE rank <= 3""")
def belief_challenged(spark, sf):
    n = neighbours(spark, sf)
    rows = n.select(F.col("q").alias("belief"), (F.col("rank") % 3).alias("query_no"), F.floor(F.col("id") / 2).cast("long").alias("id"), F.when(F.col("id") % 5 == 0, "belief").otherwise("fact").alias("type"), F.round("vector_score", 6).alias("score"))
    return Wr.challenged(rows, 3)


@query(f"""WITH d AS (SELECT doc_id, text, source, {trim_sql('text')} AS bare FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY text, source ORDER BY doc_id) AS n FROM d WHERE doc_id % 2 = 1), h AS (SELECT *, sha256(source || chr(1) || text || chr(1) || n) AS h FROM n),
i AS (SELECT *, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS id FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY bare ORDER BY id) AS k FROM i)
SELECT id, sha256(bare) AS hash, source, 'semantic' AS type FROM r WHERE k = 1 AND bare NOT IN (SELECT bare FROM d WHERE doc_id % 2 = 0)""")
def save_batch(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), "source")
    batch = Wr.prepared(docs.filter("doc_id % 2 = 1").drop("doc_id"), moment())
    return M.new_rows(batch, docs.filter("doc_id % 2 = 0")).select("id", "hash", "source", "type")
