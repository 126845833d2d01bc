"""Text expressions that behave alike for ASCII word boundaries and all white space.

Patterns are written once, with \\b as ASCII boundary and $ as the very end; `java` spells them for
Spark (where \\b is a Unicode boundary and $ also matches before a last newline).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes, as a character class body.
SPACE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def from_word(pattern: str) -> str:
    """A pattern whose first \\b stands before a word character, spelled so that most places are told by one look back."""
    return pattern.replace(r"\b", r"(?<!\w)", 1)


def java(pattern: str) -> str:
    end = re.sub(r"\$(?=\)|\Z)", lambda _: r"\z", pattern)
    return end.replace(r"\b", _BOUNDARY)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns, whatever the case, is found, in one pass over the text; each begins with \\b before a word character."""
    return text.rlike(r"(?i)(?<!\w)(?:" + "|".join(java(p.removeprefix(r"\b")) for p in patterns) + ")")


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def words(text: Column, longer_than: int = 0) -> Column:
    """Maximal runs of ASCII word characters, longer than the given length."""
    return F.filter(F.split(text, r"\W+"), lambda w: F.length(w) > longer_than)


def content_hash(text: Column) -> Column:
    return F.sha2(trim(text), 256)


def contains_any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def first_case(pairs: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(default)
    for condition, value in reversed(pairs):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out
