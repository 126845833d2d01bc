"""Ranking scores as column expressions. Each takes an explicit time; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from remembra.schemas import DECAY, DEFAULT_IMPORTANCE, TYPE_BOOSTS, WEIGHTS

DAY = 86400.0


def days_between(later: Column, earlier: Column) -> Column:
    """Days, of timestamps of microseconds."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / (DAY * 1e6)


def recency(at: Column, as_of: Column, half_life: float = 14) -> Column:
    return F.exp(-DECAY * days_between(as_of, at) / half_life)


def access_frequency(n: Column) -> Column:
    return F.least(F.lit(1.0), F.log2(n + 1) / 5)


def _lookup(kind: Column, table: dict[str, float], default: float) -> Column:
    by_value: dict[float, list[str]] = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    out = F.lit(default)
    for value, names in by_value.items():
        out = F.when(kind.isin(names), F.lit(value)).otherwise(out)
    return out


def type_boost(kind: Column) -> Column:
    return _lookup(kind, TYPE_BOOSTS, 0.5)


def default_importance(kind: Column) -> Column:
    return _lookup(kind, DEFAULT_IMPORTANCE, 0.5)


def hybrid(vector: Column, text: Column, recent: Column, importance: Column, accesses: Column, kind: Column) -> Column:
    parts = (vector, text, recent, importance, access_frequency(accesses), type_boost(kind))
    out = WEIGHTS[0] * parts[0]
    for w, p in zip(WEIGHTS[1:], parts[1:], strict=True):
        out = out + w * p
    return out


def decayed(importance: Column, days: Column, half_life: float = 30, least: float = 0.05) -> Column:
    return F.greatest(F.lit(least), F.round(importance * F.exp(-DECAY * days / half_life), 3))
