"""Short forms of a content: a sentence with key terms, the first paragraph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from remembra.functions.text import all_matches, trim

L0_CHARS, L1_CHARS, FALLBACK_CHARS, KEY_TERMS = 400, 2000, 200, 10

# Fixed value: what counts as a key term.
TERM = r"\b(?:[A-Z][a-zA-Z]{2,}(?:\.[a-zA-Z]+)*|[a-z]+(?:DB|AI|ML|API|CLI|SDK|URL|LLM|RAG|MCP|SST|CDK|SQS|SNS|RDS|EC2|S3|VPC|IAM))\b"
#: The same for Spark: a term starts and ends with word characters.
WHOLE_TERM = r"(?<!\w)".join(TERM.split(r"\b", 1)).replace(r"\b", r"(?!\w)")
SENTENCE = r"^[^.!?\n]+(?:[.!?]|\z)"


def first_sentence(c: Column) -> Column:
    found = F.regexp_extract(c, SENTENCE, 0)
    return trim(F.when(found != "", found).otherwise(F.substring(c, 1, FALLBACK_CHARS)))


def first_paragraph(c: Column) -> Column:
    at = F.instr(c, "\n\n")
    return trim(F.substring(F.when(at > 1, F.substring(c, F.lit(1), at - 1)).otherwise(c), 1, L1_CHARS))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value made once however often `then` names it: as the item of an array of one."""
    return F.transform(F.array(value), then)[0]


def key_terms(c: Column, sentence: Column) -> Column:
    # distinct first: a text has far fewer different terms than terms
    return _bound(F.lower(sentence), lambda low: F.slice(F.filter(F.array_distinct(all_matches(c, WHOLE_TERM)), lambda t: ~F.contains(low, F.lower(t))), 1, KEY_TERMS))


def l0(c: Column) -> Column:
    def with_terms(sentence: Column) -> Column:
        tail = _bound(key_terms(c, sentence), lambda terms: F.when(F.size(terms) > 0, F.concat(F.lit(" ["), F.array_join(terms, ", "), F.lit("]"))).otherwise(""))
        return F.substring(F.concat(sentence, tail), 1, L0_CHARS)

    return _bound(first_sentence(c), with_terms)


def l1(c: Column) -> Column:
    return first_paragraph(c)


def at_depth(content: Column, l0_: Column, l1_: Column, depth: int) -> Column:
    """depth 0 or 1: the short form, or the content's start where it is empty; 2: the content."""
    if depth == 2:
        return content
    short, n = (l0_, L0_CHARS) if depth == 0 else (l1_, L1_CHARS)
    return F.when(F.coalesce(short, F.lit("")) != "", short).otherwise(F.substring(content, 1, n))
