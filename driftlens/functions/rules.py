"""Word-rule classifiers: stance and sector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.text import bind, contains_any


def _padded(text: Column) -> Column:
    folded = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")
    return F.concat(F.lit(" "), folded, F.lit(" "))


def stance_cues(text: Column, debunk=None, question=None, spread=None) -> Column:
    """STRUCT of what a stance needs of a text: each cue is searched once, whatever the kinds of its posts."""
    def search(t: Column) -> Column:
        return F.struct(
            contains_any(t, fixed.DEBUNK_CUES if debunk is None else debunk).alias("debunk"),
            contains_any(t, fixed.QUESTION_CUES if question is None else question).alias("question"),
            contains_any(t, fixed.SPREAD_CUES if spread is None else spread).alias("spread"),
            F.trim(t).endswith("?").alias("asks"),
        )

    return bind(_padded(text), search)


def stance_from_cues(cues: Column, kind: Column) -> Column:
    """debunking > questioning > spreading > reacting, first rule that fires."""
    return (
        F.when(cues["debunk"], "debunking")
        .when(cues["question"] | (kind.isin(fixed.COMMENT_KINDS) & cues["asks"]), "questioning")
        .when(kind.isin(fixed.SPREAD_KINDS) | cues["spread"], "spreading")
        .otherwise("reacting")
    )


def stance(text: Column, kind: Column, debunk=None, question=None, spread=None) -> Column:
    """Stance of a post: ``stance_from_cues`` of its own text."""
    return bind(stance_cues(text, debunk, question, spread), lambda c: stance_from_cues(c, kind))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal phrase. Most phrases do not
    occur at all, and a plain containment test is far cheaper than a replace."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))
    return F.when(text.contains(phrase), (removed / len(phrase)).cast("int")).otherwise(0)


def sector_hits(text: Column, sectors: dict[str, list[str]] | None = None) -> Column:
    """STRUCT of keyword hits per sector. Hits add up across the texts of a
    topic, so a topic's sector is decided on summed structs, never on one long
    concatenated string."""
    sectors = fixed.SECTORS if sectors is None else sectors

    def count(t: Column) -> Column:
        columns = []
        for name, keywords in sectors.items():
            total = F.lit(0)
            for keyword in keywords:
                total = total + occurrences(t, keyword)
            columns.append(total.alias(name))
        return F.struct(*columns)

    return bind(_padded(text), count)


def sector_from_hits(hits: dict[str, Column], min_hits: int = 1) -> Column:
    """First sector with the most hits, "other" below ``min_hits``."""
    best = F.greatest(*hits.values()) if len(hits) > 1 else next(iter(hits.values()))
    choice = F.when(best < min_hits, "other")
    for name, n in hits.items():
        choice = choice.when(n == best, name)
    return choice.otherwise("other")


def sector(text: Column, sectors: dict[str, list[str]] | None = None, min_hits: int = 1) -> Column:
    names = list(fixed.SECTORS if sectors is None else sectors)
    return bind(sector_hits(text, sectors), lambda h: sector_from_hits({n: h[n] for n in names}, min_hits))


def strict_sector(text: Column, sectors: dict[str, list[str]] | None = None) -> Column:
    return sector(text, sectors, min_hits=2)


def sector_level(posts: Column, priority_alerts: Column, manufactured: Column, share: Column,
                 max_burst: Column) -> Column:
    return (
        F.when(posts == 0, "quiet")
        .when((priority_alerts > 0) & (manufactured > 0), "critical")
        .when((manufactured > 0) | (share >= 0.10), "elevated")
        .when((share >= 0.02) | (max_burst >= 3), "watch")
        .otherwise("normal")
    )
