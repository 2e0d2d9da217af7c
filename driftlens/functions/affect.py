"""Lexicon affect scores and their composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.text import bind


def lexicon_scores(text: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """STRUCT of five scores in [0, 1].

    Two cue hits saturate a dimension. Words match whole tokens, entries with a
    space match as substrings. Shouting ("!!" or a capitalised word of four or
    more letters) adds 0.25 to the larger of anxiety and excitement.
    """
    lexicon = fixed.AFFECT_LEXICON if lexicon is None else lexicon

    def base(low: Column) -> Column:
        tokens = F.regexp_extract_all(low, F.lit(r"[a-zऀ-ॿ]+"), F.lit(0))
        found = F.array_distinct(F.filter(tokens, lambda t: t.isin(every_word)))
        return bind(F.struct(found.alias("found"), low.alias("low")), per_dimension)

    def per_dimension(x: Column) -> Column:
        out = []
        for dim in fixed.AFFECT_DIMENSIONS:
            words = [c for c in lexicon.get(dim, []) if " " not in c]
            hits = F.size(F.filter(x["found"], lambda t: t.isin(words))) if words else F.lit(0)
            for phrase in (c for c in lexicon.get(dim, []) if " " in c):
                hits = hits + x["low"].contains(phrase).cast("int")
            out.append(F.least(F.lit(1.0), hits / 2.0).alias(dim))
        return F.struct(*out)

    every_word = sorted({c for d in fixed.AFFECT_DIMENSIONS for c in lexicon.get(d, []) if " " not in c})
    loud = text.contains("!!") | text.rlike(r"(?U)\b[A-Z]{4,}\b")
    return bind(F.struct(bind(F.lower(text), base).alias("s"), loud.alias("loud")), _apply_loudness)


def _apply_loudness(x: Column) -> Column:
    s, loud = x["s"], x["loud"]
    anx, exc = s["anxiety"], s["excitement"]
    raised = F.least(F.lit(1.0), F.greatest(anx, exc) + 0.25)
    values = {d: s[d] for d in fixed.AFFECT_DIMENSIONS}
    values["anxiety"] = F.when(loud & (anx >= exc), raised).otherwise(anx)
    values["excitement"] = F.when(loud & (anx < exc), raised).otherwise(exc)
    return F.struct(*[values[d].alias(d) for d in fixed.AFFECT_DIMENSIONS])


def compose_affect(scores: Column, mode: str = "lexicon") -> Column:
    """Adds ``neutral`` and ``sentiment`` to the five scores.

    ``lexicon`` compares sums; ``model`` compares maxima and needs a top score
    of at least 0.5.
    """
    s = {d: scores[d] for d in fixed.AFFECT_DIMENSIONS}
    top = F.greatest(s["anxiety"], s["excitement"], s["supportive"], s["against"])
    neutral = F.greatest(F.lit(0.0), F.lit(1.0) - top)
    if mode == "lexicon":
        good, bad = s["supportive"] + s["excitement"], s["against"] + s["anxiety"]
        sentiment = F.when(good > bad, "positive").when(bad > 0, "negative").otherwise("neutral")
    elif mode == "model":
        good = F.greatest(s["supportive"], s["excitement"])
        bad = F.greatest(s["against"], s["anxiety"])
        sentiment = F.when(top < 0.5, "neutral").when(good > bad, "positive").otherwise("negative")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.struct(
        *[s[d].alias(d) for d in fixed.AFFECT_DIMENSIONS],
        neutral.alias("neutral"),
        sentiment.alias("sentiment"),
    )
