"""Scores as columns: cosine, keyword score, normalisation, freshness, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as Win
from pyspark.sql import functions as F


def dot(a: Column, b: Column, dim: int) -> Column:
    """Dot product of arrays of a known dimension, as one generated expression."""
    out = F.get(a, F.lit(0)).cast("double") * F.get(b, F.lit(0)).cast("double")
    for i in range(1, dim):
        out = out + F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double")
    return out


def cosine(a: Column, b: Column, dim: int) -> Column:
    """0 where either vector is zero."""
    n = F.sqrt(dot(a, a, dim)) * F.sqrt(dot(b, b, dim))
    return F.when(n > 0, dot(a, b, dim) / n).otherwise(0.0)


def bm25(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.greatest(avgdl, F.lit(1e-9))))


def minmax(x: Column, over: Win) -> Column:
    """To 0..1 within a window; all 1 where the values don't differ."""
    lo, hi = F.min(x).over(over), F.max(x).over(over)
    return F.when(hi - lo <= 1e-12, 1.0).otherwise((x - lo) / F.greatest(hi - lo, F.lit(1e-300)))


def freshness(at: Column, as_of: Column) -> Column:
    """exp(-age in days / 90), 1 at most; 0 where the time is unknown."""
    days = (F.unix_micros(as_of) - F.unix_micros(at)) / 86_400e6
    return F.coalesce(F.exp(-days / 90.0), F.lit(0.0))


def metadata_score(fresh: Column, title: Column, section: Column, priority: Column, workspace: Column) -> Column:
    raw = 0.30 * fresh + 0.35 * title + 0.25 * section + 0.05 * F.least(priority, F.lit(1.0)) + 0.05 * workspace
    return F.least(raw, F.lit(1.0))


def confidence(top: Column, rerank_top: Column, coverage: Column) -> Column:
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), top))
    base = 0.6 * clipped + 0.4 * coverage
    return F.round(F.when(rerank_top - clipped >= 0.3, F.least(F.lit(1.0), base + 0.05)).otherwise(base), 4)
