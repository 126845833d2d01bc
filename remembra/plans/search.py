"""Queries of ranked search, scores and short forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remembra.functions import scoring, text, tiers, vectors
from remembra.operators import search as S
from remembra.operators.blocks import knn, similar_pairs
from remembra.operators.bm25 import TextIndex, normalised, tokens
from remembra.operators.metric import VectorIndex
from remembra.schemas import DEFAULT_IMPORTANCE, TYPE_BOOSTS
from remembra.sources.memories import AS_OF, DAYS_SQL, MEMORIES_SQL, case_sql, files_of, memories, moment, table
from remembra.sources.store import workspace

QUERIES, ORACLE = {}, {}

#: The question of the search queries: a vector and the words of a benchmark item.
ASKED_VECTOR, ASKED_ITEM = 0, 0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def asked(spark: SparkSession, sf: str) -> tuple[list[float], list[str]]:
    vector = table(spark, sf, "embeddings").filter(F.col("vec_id") == ASKED_VECTOR).first().embedding
    item = table(spark, sf, "benchmark").filter(F.col("item_id") == ASKED_ITEM).select(tokens(F.col("text"))).first()[0]
    return vector, item


def vector_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


TOKENS_SQL = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
DISTANCE_SQL = "list_sum(list_transform(list_zip({}, {}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
KNN_SQL = f"SELECT v.vec_id AS id, {DISTANCE_SQL.format('v.embedding', 'q.embedding')} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = {ASKED_VECTOR}) q"
TERMS_SQL = f"SELECT DISTINCT unnest({TOKENS_SQL.format('text')}) AS term FROM benchmark WHERE item_id = {ASKED_ITEM}"
BM25_SQL = f"""terms AS ({TERMS_SQL}),
split AS (SELECT doc_id AS id, {TOKENS_SQL.format('text')} AS words FROM documents),
about AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM split),
tf AS (SELECT w.id, w.dl, w.term, count(*) AS tf FROM (SELECT id, len(words) AS dl, unnest(words) AS term FROM split) w JOIN terms USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm25 AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS bm25 FROM tf JOIN df USING (term), about GROUP BY id)"""


@query(f"SELECT id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM ({KNN_SQL}) ORDER BY distance, id LIMIT 30")
def knn_topk(spark, sf):
    vector, _ = asked(spark, sf)
    near = vector_table(spark, sf).select("id", vectors.squared_l2(F.col("vector"), F.array(*(F.lit(float(x)) for x in vector))).alias("distance"))
    return rounded(near.orderBy("distance", "id").limit(30).withColumn("similarity", vectors.similarity(F.col("distance"))))


#: The inverted index of each data folder that this process has searched, by application and the folder's files.
_INDEXES: dict[tuple, TextIndex] = {}


def text_index(spark: SparkSession, sf: str) -> TextIndex:
    """The folder's index; the first search makes it, as a store keeps one beside its rows."""
    key = (spark.sparkContext.applicationId, files_of(spark, sf, "documents", "labels"))
    if key not in _INDEXES:
        _INDEXES[key] = TextIndex(spark, workspace(spark, "text-index"), "long").build(memories(spark, sf).select("id", "content"))
    return _INDEXES[key]


def _bm25(spark, sf):
    terms = sorted(set(asked(spark, sf)[1]))
    return text_index(spark, sf).bm25(spark.createDataFrame([(0, t) for t in terms], "q int, term string"), terms)


@query(f"WITH {BM25_SQL} SELECT id, round(bm25, 6) AS bm25 FROM bm25 ORDER BY bm25.bm25 DESC, id LIMIT 30")
def bm25_topk(spark, sf):
    return rounded(_bm25(spark, sf).orderBy(F.col("bm25").desc(), "id").limit(30).select("id", "bm25"))


@query(f"WITH {BM25_SQL}, best AS (SELECT * FROM bm25 ORDER BY bm25.bm25 DESC, id LIMIT 30) SELECT id, round(bm25 / max(bm25) OVER (), 6) AS bm25 FROM best")
def bm25_normalized(spark, sf):
    return rounded(normalised(_bm25(spark, sf).orderBy(F.col("bm25").desc(), "id").limit(30)).select("id", "bm25"))


def candidates_sql(k: int) -> str:
    return f"""{BM25_SQL},
v AS (SELECT id, 1 / (1 + distance) AS s FROM ({KNN_SQL}) ORDER BY distance, id LIMIT {k}),
t0 AS (SELECT * FROM bm25 ORDER BY bm25.bm25 DESC, id LIMIT {k}),
t AS (SELECT id, bm25 / max(bm25) OVER () AS b FROM t0),
candidates AS (SELECT coalesce(v.id, t.id) AS id, coalesce(s, 0) AS vector_score, coalesce(b, 0) AS bm25, v.id IS NOT NULL AS has_vector, t.id IS NOT NULL AS has_text FROM v FULL JOIN t ON v.id = t.id)"""


@query(f"WITH {candidates_sql(30)} SELECT id, round(vector_score, 6) AS vector_score, round(bm25, 6) AS bm25, has_vector, has_text FROM candidates")
def hybrid_candidates_outer(spark, sf):
    vector, terms = asked(spark, sf)
    o = S.Options()
    return rounded(S.merged(S.vector_candidates(vector_table(spark, sf), vector, o.candidates), S.text_candidates(memories(spark, sf), terms, o.candidates, text_index(spark, sf))))


RECENCY_SQL = f"exp(-0.693::DOUBLE * {DAYS_SQL.format('accessed_at')} / 14)"
ACCESS_SQL = "least(1::DOUBLE, log2(access_count + 1) / 5)"


BOOST_SQL = case_sql(TYPE_BOOSTS, 0.5)
HYBRID_SQL = f"0.35::DOUBLE * vector_score + 0.3::DOUBLE * bm25 + 0.15::DOUBLE * {RECENCY_SQL} + 0.1::DOUBLE * importance + 0.05::DOUBLE * {ACCESS_SQL} + 0.05::DOUBLE * {BOOST_SQL}"


def search_sql(where: str = "true", k: int = 30, limit: int = 10, min_score: float = 0.3, columns: str = "", extra: str = "", score: str = "score") -> str:
    return f"""{MEMORIES_SQL}, {candidates_sql(k)}{extra},
scored AS (SELECT m.*, vector_score, bm25, {HYBRID_SQL} AS score FROM candidates JOIN memories m USING (id)
 WHERE ((has_vector AND has_text) OR (has_vector AND vector_score >= 0.3) OR (has_text AND bm25 >= 0.4)) AND ({where})),
boosted AS (SELECT * REPLACE ({score} AS score) FROM scored)
SELECT id, type, namespace, round(score, 6) AS score, round(vector_score, 6) AS vector_score, round(bm25, 6) AS bm25{columns} FROM boosted WHERE score >= {min_score} ORDER BY boosted.score DESC, id LIMIT {limit}"""


def run_search(spark, sf, *columns, boosted=None, rows=None, **options):
    vector, terms = asked(spark, sf)
    found = S.search(memories(spark, sf) if rows is None else rows, vector_table(spark, sf), vector, terms, moment(), S.Options(**options), boosted, text_index(spark, sf))
    return rounded(found.select("id", "type", "namespace", "score", "vector_score", "bm25", *columns))


@query(search_sql(columns=", content"))
def hybrid_search(spark, sf):
    return run_search(spark, sf, "content")


@query(search_sql("namespace = 'projects' OR starts_with(namespace, 'projects/')"))
def search_namespace_prefix(spark, sf):
    return run_search(spark, sf, namespace="projects", namespace_prefix=True)


@query(search_sql("namespace = 'src1'", min_score=0.1))
def search_namespace_exact(spark, sf):
    return run_search(spark, sf, namespace="src1", min_score=0.1)


@query(search_sql("type = 'decision'", k=200, min_score=0.1))
def search_type_filter(spark, sf):
    return run_search(spark, sf, type="decision", min_score=0.1)


@query(search_sql("list_has_any(tags, ['de', 'src3'])", min_score=0.1))
def search_tags_any(spark, sf):
    return run_search(spark, sf, tags=("de", "src3"), min_score=0.1)


@query(search_sql("created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at < TIMESTAMP '2024-01-25 00:00:00'", min_score=0.1))
def search_date_range(spark, sf):
    return run_search(spark, sf, after="2024-01-05 00:00:00", before="2024-01-25 00:00:00", min_score=0.1)


@query(search_sql("importance >= 0.7", min_score=0.1))
def search_min_importance(spark, sf):
    return run_search(spark, sf, min_importance=0.7, min_score=0.1)


@query(search_sql("json_extract_string('{\"project\": \"' || CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'alpha' ELSE 'beta' END || '\"}', '$.project') IN ('', 'alpha')", min_score=0.1))
def search_project(spark, sf):
    meta = F.to_json(F.struct(F.when(F.col("id") % 3 == 1, "alpha").when(F.col("id") % 3 == 2, "beta").alias("project")))
    return run_search(spark, sf, rows=memories(spark, sf).withColumn("metadata", meta), project="alpha", min_score=0.1)


@query(search_sql(columns=", epoch_us(TIMESTAMP '" + AS_OF + "') AS touched_at, (access_count + 1)::BIGINT AS new_count"))
def search_touch(spark, sf):
    found = run_search(spark, sf, "access_count")
    touched = S.touched(found, moment()).select("id", F.unix_micros("accessed_at").alias("touched_at"), "accesses")
    return found.join(touched, "id").select("id", "type", "namespace", "score", "vector_score", "bm25", "touched_at", (F.col("access_count") + F.col("accesses")).alias("new_count"))


@query(f"{MEMORIES_SQL} SELECT id, round({RECENCY_SQL}, 6) AS recency FROM memories")
def recency_score(spark, sf):
    return rounded(memories(spark, sf).select("id", scoring.recency(F.col("accessed_at"), moment()).alias("recency")))


@query(f"{MEMORIES_SQL} SELECT id, round({ACCESS_SQL}, 6) AS access_score FROM memories")
def access_frequency(spark, sf):
    return rounded(memories(spark, sf).select("id", scoring.access_frequency(F.col("access_count")).alias("access_score")))


@query(f"{MEMORIES_SQL} SELECT id, type, {BOOST_SQL} AS boost FROM memories")
def type_boost(spark, sf):
    return memories(spark, sf).select("id", "type", scoring.type_boost(F.col("type")).alias("boost"))


@query(f"{MEMORIES_SQL} SELECT id, round({HYBRID_SQL}, 6) AS score FROM (SELECT *, (id % 10) / 10::DOUBLE AS vector_score, (id % 7) / 7::DOUBLE AS bm25 FROM memories)")
def hybrid_score_static(spark, sf):
    m = memories(spark, sf)
    score = scoring.hybrid(F.col("id") % 10 / 10.0, F.col("id") % 7 / 7.0, scoring.recency(F.col("accessed_at"), moment()), F.col("importance"), F.col("access_count"), F.col("type"))
    return rounded(m.select("id", score.alias("score")))


_SP = text.SPACE


def trim_sql(x: str) -> str:
    return "regexp_replace(" + x + f", '^[{_SP}]+|[{_SP}]+$', '', 'g')"


_SENTENCE = trim_sql(r"CASE WHEN regexp_extract(content, '^[^.!?\n]+(?:[.!?]|$)') <> '' THEN regexp_extract(content, '^[^.!?\n]+(?:[.!?]|$)') ELSE substring(content, 1, 200) END")
TIERS_SQL = rf"""{MEMORIES_SQL}, s AS (SELECT id, content, {_SENTENCE} AS sentence FROM memories),
found AS (SELECT id, term, min(pos) AS pos FROM (SELECT id, sentence, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM (SELECT *, regexp_extract_all(content, '{tiers.TERM}') AS terms FROM s)) WHERE NOT contains(lower(sentence), lower(term)) GROUP BY id, term),
k AS (SELECT id, string_agg(term, ', ' ORDER BY pos) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM found) WHERE n <= 10 GROUP BY id),
tiers AS (SELECT s.id, s.content, substring(sentence || CASE WHEN terms IS NOT NULL THEN ' [' || terms || ']' ELSE '' END, 1, 400) AS l0,
 {trim_sql(r"substring(CASE WHEN strpos(content, chr(10) || chr(10)) > 1 THEN substring(content, 1, strpos(content, chr(10) || chr(10)) - 1) ELSE content END, 1, 2000)")} AS l1 FROM s LEFT JOIN k USING (id))"""


@query(f"{TIERS_SQL} SELECT id, l0, l1 FROM tiers")
def tiers_l0_l1(spark, sf):
    c = F.col("content")
    return memories(spark, sf).select("id", tiers.l0(c).alias("l0"), tiers.l1(c).alias("l1"))


@query(f"{TIERS_SQL} SELECT id, CASE id % 3 WHEN 0 THEN CASE WHEN l0 <> '' THEN l0 ELSE substring(content, 1, 400) END WHEN 1 THEN CASE WHEN id % 2 = 0 THEN substring(content, 1, 2000) WHEN l1 <> '' THEN l1 ELSE substring(content, 1, 2000) END ELSE content END AS shown FROM tiers")
def content_depth(spark, sf):
    m = memories(spark, sf).withColumn("l0", tiers.l0(F.col("content"))).withColumn("l1", F.when(F.col("id") % 2 == 0, "").otherwise(tiers.l1(F.col("content"))))
    pick = F.when(F.col("id") % 3 == 0, tiers.at_depth(F.col("content"), F.col("l0"), F.col("l1"), 0)).when(F.col("id") % 3 == 1, tiers.at_depth(F.col("content"), F.col("l0"), F.col("l1"), 1)).otherwise(tiers.at_depth(F.col("content"), F.col("l0"), F.col("l1"), 2))
    return m.select("id", pick.alias("shown"))


@query(f"SELECT doc_id AS id, sha256({trim_sql('text')}) AS hash FROM documents")
def content_hash(spark, sf):
    return memories(spark, sf).select("id", text.content_hash(F.col("content")).alias("hash"))


@query(f"{MEMORIES_SQL} SELECT type, count(*) AS n, {case_sql(DEFAULT_IMPORTANCE, 0.5)} AS importance FROM memories GROUP BY type")
def default_importance(spark, sf):
    return memories(spark, sf).groupBy("type").agg(F.count("*").alias("n")).select("type", "n", scoring.default_importance(F.col("type")).alias("importance"))


DOT_SQL = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(f"WITH n AS (SELECT *, sqrt({DOT_SQL.format('embedding', 'embedding')}) AS size FROM embeddings), pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, {DOT_SQL.format('a.embedding', 'b.embedding')} / (a.size * b.size) AS cosine FROM n a JOIN n b ON a.vec_id < b.vec_id) SELECT a, b, round(cosine, 6) AS cosine FROM pairs WHERE cosine >= 0.35")
def pairwise_cosine(spark, sf):
    return rounded(similar_pairs(vector_table(spark, sf), 0.35))


@query(f"WITH p AS (SELECT a.vec_id AS q, b.vec_id AS id, {DISTANCE_SQL.format('a.embedding', 'b.embedding')} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT q, rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, id)::INT AS rank FROM p) WHERE rank <= 6")
def knn_join(spark, sf):
    v = vector_table(spark, sf)
    return rounded(knn(v, v, 6))


@query(f"""WITH q AS (SELECT item_id AS q, list_distinct({TOKENS_SQL.format('text')}) AS terms, text FROM benchmark),
qt AS (SELECT q, unnest(terms) AS term FROM q),
split AS (SELECT doc_id AS id, {TOKENS_SQL.format('text')} AS words FROM documents),
about AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM split),
tf AS (SELECT w.id, w.dl, w.term, count(*) AS tf FROM (SELECT id, len(words) AS dl, unnest(words) AS term FROM split) w WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT q, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS bm25 FROM tf JOIN df USING (term) JOIN qt USING (term), about GROUP BY q, id),
r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, id) AS rank FROM s),
best AS (SELECT b.item_id AS q, min(r.rank) AS rank FROM benchmark b LEFT JOIN (SELECT r.* FROM r JOIN benchmark x ON r.q = x.item_id JOIN documents d ON d.doc_id = r.id WHERE rank <= 10 AND contains(d.text, x.text)) r ON r.q = b.item_id GROUP BY b.item_id)
SELECT count(*) AS queries, avg(CASE WHEN rank <= 1 THEN 1::DOUBLE ELSE 0 END) AS recall_at_1, avg(CASE WHEN rank <= 5 THEN 1::DOUBLE ELSE 0 END) AS recall_at_5, avg(CASE WHEN rank <= 10 THEN 1::DOUBLE ELSE 0 END) AS recall_at_10, round(avg(coalesce(1::DOUBLE / rank, 0)), 6) AS mrr FROM best""")
def recall_mrr(spark, sf):
    from pyspark.sql import Window as W

    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), "text")
    terms = items.select("q", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    m = memories(spark, sf)
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.round("bm25", 9).desc(), "id"))
    top = text_index(spark, sf).bm25(terms).withColumn("rank", rank).filter("rank <= 10")
    hit = top.join(m.select("id", "content"), "id").join(items, "q").filter(F.col("content").contains(F.col("text"))).groupBy("q").agg(F.min("rank").alias("rank"))
    return rounded(S.recall(items.select("q").join(hit, "q", "left")))


@query("""WITH runs AS (SELECT event_type AS suite, date_trunc('day', ts) AS day, round(avg(value), 6) AS recall, round(avg(value * value), 6) AS latency FROM events GROUP BY ALL),
w AS (SELECT *, lag(recall) OVER (PARTITION BY suite ORDER BY day) AS r, lag(latency) OVER (PARTITION BY suite ORDER BY day) AS l FROM runs)
SELECT suite, epoch_us(day) AS day, recall, latency, coalesce(r - recall > 0.05 OR latency > 1.5 * l, false) AS regressed FROM w""")
def regression_check(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(date_trunc('day', ts) as timestamp_ntz))")))
    runs = e.groupBy(F.col("event_type").alias("suite"), "day").agg(F.round(F.avg("value"), 6).alias("recall"), F.round(F.avg(F.col("value") * F.col("value")), 6).alias("latency"))
    return S.regressions(runs, "suite", "day").select("suite", F.unix_micros("day").alias("day"), "recall", "latency", "regressed")


# ---- indexes that are built, changed and asked ----


@query(f"""WITH c AS (SELECT * FROM embeddings WHERE vec_id % 11 <> 5 AND embedding IS NOT NULL), q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT q.vec_id AS q, c.vec_id AS id, {DISTANCE_SQL.format('c.embedding', 'q.embedding')} AS distance FROM q JOIN c ON q.vec_id <> c.vec_id)
SELECT q, rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, id)::INT AS rank FROM p) WHERE rank <= 10""")
def metric_index_knn(spark, sf):
    """An index of half of the vectors, the rest added, some removed; then the ten nearest of each hundredth."""
    rows = vector_table(spark, sf)
    index = VectorIndex(spark, workspace(spark, "vectors")).build(rows.filter("id % 2 = 0"))
    index.add(rows.filter("id % 2 = 1"))
    index.remove(rows.filter("id % 11 = 5"))
    return rounded(index.nearest(rows.filter("id % 100 = 0").select(F.col("id").alias("q"), "vector"), 10, own=False))


@query(f"WITH {BM25_SQL.replace('FROM documents', 'FROM documents WHERE doc_id % 3 <> 1')} SELECT id, round(bm25, 6) AS bm25 FROM bm25 ORDER BY bm25.bm25 DESC, id LIMIT 30")
def text_index_changes(spark, sf):
    """An index of half of the documents, the rest added, a third removed."""
    rows = memories(spark, sf).select("id", "content")
    index = TextIndex(spark, workspace(spark, "text-index"), "long").build(rows.filter("id % 2 = 0"))
    index.add(rows.filter("id % 2 = 1"))
    index.remove(rows.filter("id % 3 = 1"))
    terms = sorted(set(asked(spark, sf)[1]))
    found = index.bm25(spark.createDataFrame([(0, t) for t in terms], "q int, term string"), terms)
    return rounded(found.orderBy(F.col("bm25").desc(), "id").limit(30).select("id", "bm25"))
