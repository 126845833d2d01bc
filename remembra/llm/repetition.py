"""Quality rules: how much of a document lies inside text that it repeats (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remembra.llm._bytes import SPACE, Texts, mix, ngrams, pieces, repeated
from remembra.llm._store import held, released

#: A document is rejected if more than this share of its word characters lies in n-grams that occur twice or more.
MAX_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: ... or more than this share of its lines, or of its word characters, is in lines that repeat an earlier line.
MAX_LINE_SHARE, MAX_LINE_CHAR_SHARE = 0.30, 0.20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in MAX_NGRAM_SHARE)


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """The columns of STATS for each text of an Arrow column, each text by itself."""
    t = Texts.of(column)
    starts, ends, n_words = t.words()
    doc = np.repeat(np.arange(t.n), n_words)
    salt = mix(np.arange(1, t.n + 1, dtype=np.uint64))
    letters = ~SPACE[t.data] & ((t.data & 0xC0) != 0x80)
    before = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(letters, out=before[1:])
    total = lambda mask, weight=None: np.bincount(doc[mask], None if weight is None else weight[mask], t.n).astype(np.int64)
    size = before[ends] - before[starts]
    out = {"n_words": n_words.astype(np.int64), "word_chars": before[t.end] - before[t.begin], "n_symbols": t.count(_SYMBOL[t.data])}

    cut = np.flatnonzero(t.data == 10)
    a, b = cut[:-1] + 1, cut[1:]
    full = before[b] > before[a]
    a, b = a[full], b[full]
    line_doc = np.searchsorted(t.begin, a, "right") - 1
    keys = t.hashes(a, b) ^ salt[line_doc]
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    out["n_lines"] = np.bincount(line_doc, None, t.n).astype(np.int64)
    out["n_dup_lines"] = np.bincount(line_doc[later], None, t.n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc[later], (before[b] - before[a])[later], t.n).astype(np.int64)

    out["n_repeat_words"] = np.zeros(t.n, np.int64)
    out |= {f"dup_chars_{n}": np.zeros(t.n, np.int64) for n in MAX_NGRAM_SHARE}
    for n, hashed, whole in ngrams(t.hashes(starts, ends), doc, max(MAX_NGRAM_SHARE)):
        if n != 3 and n not in MAX_NGRAM_SHARE:
            continue
        twice = np.flatnonzero(whole)
        twice = twice[repeated(hashed[twice] ^ salt[doc[twice]])]
        step = np.zeros(len(doc) + 1, np.int32)
        step[twice] += 1
        step[twice + n] -= 1
        # a word may start one window and follow another: += above needs distinct positions, which `twice` has
        inside = np.cumsum(step[:-1]) > 0
        if n == 3:
            out["n_repeat_words"] = total(inside)
        else:
            out[f"dup_chars_{n}"] = total(inside, size)
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "__text"):
            found = text_stats(piece.column(piece.schema.get_field_index("__text")))
            rest = [(n, piece.column(i)) for i, n in enumerate(piece.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(found[n.split()[0]]) for n in STATS.split(", ")], [n for n, _ in rest] + [n.split()[0] for n in STATS.split(", ")])


def rejected() -> Column:
    """Whether the repetition rules reject a row of STATS."""
    rules = [F.col("n_dup_lines") > MAX_LINE_SHARE * F.col("n_lines"), F.col("dup_line_chars") > MAX_LINE_CHAR_SHARE * F.col("word_chars")]
    rules += [F.col(f"dup_chars_{n}") > share * F.col("word_chars") for n, share in MAX_NGRAM_SHARE.items()]
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    return out


def base_failed() -> Column:
    """Too short (n_words < 50), or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def repetition_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, the columns of STATS, base_failed and kept; one row for each row, no shuffle.

    A null or empty text has no word, fails the base rule and is not kept. Repeated rows stay
    separate. Documents of any length are measured whole; other columns of docs are not read.
    """
    named = docs.select(*keep, F.col(text).alias("__text"))
    schema = named.select(*keep).schema
    for column in STATS.split(", "):
        schema = schema.add(*column.split())
    rows = named.mapInArrow(_stats, schema)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | rejected()))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that repetition_rules keeps, with all their columns, whatever their names; null and empty texts go, repeated rows are judged each."""
    whole = docs.select(held(docs.columns), "text")
    return repetition_rules(whole, keep=("__row",)).filter("kept").select(*released(docs.columns))
