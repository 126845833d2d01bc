"""DuckDB SQL for those opN queries that SQL can express."""

from __future__ import annotations

from remembra.llm.repetition import MAX_LINE_CHAR_SHARE, MAX_LINE_SHARE, MAX_NGRAM_SHARE

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def _covered(n: int) -> str:
    """Words and characters of each document in n-word windows that occur twice or more in it."""
    return f"""g{n} AS (SELECT doc, pos, size, string_agg(w, ' ') OVER win AS g, count(*) OVER win AS k FROM words WINDOW win AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)),
t{n} AS (SELECT *, k = {n} AND count(*) FILTER (k = {n}) OVER (PARTITION BY doc, g) > 1 AS twice FROM g{n}),
c{n} AS (SELECT doc, count(*) AS n_words, sum(size) AS chars FROM (SELECT doc, size, bool_or(twice) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM t{n}) WHERE inside GROUP BY doc)"""


_REJECTED = " OR ".join([f"n_dup_lines > {MAX_LINE_SHARE}::DOUBLE * n_lines", f"dup_line_chars > {MAX_LINE_CHAR_SHARE}::DOUBLE * word_chars", *(f"dup_chars_{n} > {s}::DOUBLE * word_chars" for n, s in MAX_NGRAM_SHARE.items())])

OP1 = rf"""WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc, {WORDS.format('text')} AS ws FROM docs),
words AS (SELECT doc, w, pos, length(w) AS size FROM (SELECT doc, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM split)),
lines AS (SELECT doc, line, list_sum(list_transform({WORDS.format('line')}, lambda w: length(w))) AS size, count(*) AS n FROM (SELECT doc, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc, line),
l AS (SELECT doc, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines, sum((n - 1) * size) AS dup_line_chars FROM lines GROUP BY doc),
{", ".join(_covered(n) for n in (3, *MAX_NGRAM_SHARE))},
s AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c3.n_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
 {", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n in MAX_NGRAM_SHARE)}
 FROM docs d JOIN split USING (doc) LEFT JOIN l USING (doc) LEFT JOIN c3 USING (doc) {" ".join(f"LEFT JOIN c{n} USING (doc)" for n in MAX_NGRAM_SHARE)}),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT (base_failed OR {_REJECTED}) AS kept FROM b"""

OP7 = rf"""WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, {WORDS.format('text')} AS ws FROM documents),
words AS (SELECT doc, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM docs),
g AS (SELECT doc, doc_id, pos, w, string_agg(w, ' ') OVER win AS g, count(*) OVER win AS k FROM words WINDOW win AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT *, k = 13 AND coalesce(min(doc_id) FILTER (k = 13) OVER (PARTITION BY g) < doc_id, false) AS seen FROM g),
c AS (SELECT doc, pos, w, bool_or(seen) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc, count(*) FILTER (gone) AS n, string_agg(w, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN k USING (doc)"""

OP9 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM p) WHERE rank <= 10"""

OP10 = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top, row_number() OVER (PARTITION BY payload_digest, page_id) AS copy FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND top IS NOT NULL AND (page_id IS DISTINCT FROM top OR copy > 1) AS visit FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN visit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN visit THEN top END AS refers_to FROM r"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
raw AS (SELECT doc, array_to_string(ws, ' ') AS g FROM docs WHERE len(ws) BETWEEN 1 AND 4
 UNION ALL SELECT doc, array_to_string(ws[i:i + 4], ' ') FROM (SELECT doc, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM docs WHERE len(ws) >= 5)),
g AS (SELECT DISTINCT doc, hash(g) AS g FROM raw),
n AS (SELECT doc, count(*) AS n FROM g GROUP BY doc),
i AS (SELECT a.doc AS a, b.doc AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc < b.doc GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc = a JOIN n y ON y.doc = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc, doc AS to_doc FROM docs UNION SELECT r.doc, e.b FROM r JOIN e ON e.a = r.to_doc),
c AS (SELECT r.doc, min(d.doc_id) AS component_id FROM r JOIN docs d ON d.doc = r.to_doc GROUP BY r.doc)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM docs JOIN c USING (doc) LEFT JOIN n USING (doc)"""

OP12 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = o.label AS same, o.vec_id AS id, coalesce(list_sum(list_transform(list_zip(a.e, o.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM v a JOIN v o ON a.vec_id <> o.vec_id AND len(a.e) = len(o.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5"""

_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce({_TERMS.format('text')}, []) AS ts FROM documents),
c AS (SELECT count(*) AS nn, coalesce(sum(len(ts)), 0)::BIGINT AS ll FROM d WHERE len(ts) > 0),
p AS (SELECT doc, t, count(*) AS tf FROM (SELECT doc, unnest(ts) AS t FROM d) GROUP BY doc, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
m AS (SELECT doc, doc_id, 100 - 25 + ((25 * len(ts) * nn) // ll) AS m FROM d, c WHERE len(ts) > 0),
q AS (SELECT row_number() OVER () AS item, item_id, {_TERMS.format('text')} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark)),
u AS (SELECT item, t, count(*) AS times FROM (SELECT item, unnest(ts) AS t FROM q) GROUP BY item, t),
w AS (SELECT item, t, times * floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM u JOIN f USING (t), c),
s AS (SELECT item, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM w JOIN p USING (t) JOIN m USING (doc) GROUP BY item, doc, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, doc)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN q USING (item) WHERE rank <= 20"""

ORACLE_SQL = {"op1_repetition": OP1, "op7_substring": OP7, "op9_ann": OP9, "op10_warc": OP10, "op11_minhash": OP11, "op12_hard_negatives": OP12, "op13_treaps": OP13}
