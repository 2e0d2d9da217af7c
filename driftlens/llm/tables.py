"""What every operator here shares: input tables, labelled samples, languages."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import textblock as tb
from driftlens.session import ship_package

FOLDS = 5

# Frequent function words of the supported languages.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "on", "are", "this", "be", "by", "from"],
    "de": ["der", "die", "das", "und", "den", "von", "ist", "des", "mit", "nicht", "auf", "dem", "sich", "ein", "eine", "zu"],
    "fr": ["le", "la", "les", "des", "du", "et", "est", "que", "dans", "pour", "qui", "par", "sur", "une", "au", "elle"],
    "es": ["el", "los", "las", "del", "y", "que", "en", "se", "por", "con", "para", "una", "su", "lo", "de", "no"],
}
LANGUAGES = [*FUNCTION_WORDS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file. ``DRIFTLENS_TOKENIZERS`` names another
    folder than that of the installed package."""
    folder = os.environ.get("DRIFTLENS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id"):
    """Rows of the held-out fold. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the
    held-out fold, picked by a hash of their id. Labels that are null are left
    out; of several labels of a document the largest counts."""
    known = labels.where(F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    picked = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` ids, so the broadcast is bounded
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")


_WORDS = {lang: np.array([tb.word_hash(w) for w in words], np.uint64) for lang, words in FUNCTION_WORDS.items()}
_BITS = np.uint64(0xFFFF)
_MAYBE = np.zeros(1 << 16, bool)
for _hashes in _WORDS.values():
    _MAYBE[(_hashes & _BITS).astype(np.int64)] = True


def function_word_counts(b: tb.Block) -> np.ndarray:
    """(texts, languages) counts of function words."""
    at = np.flatnonzero(_MAYBE[(b.hashes & _BITS).astype(np.int64)])
    seen, owner = b.hashes[at], np.searchsorted(b.word_at, at, side="right") - 1
    return np.stack([np.bincount(owner[np.isin(seen, _WORDS[x])], minlength=len(b)) for x in LANGUAGES], axis=1)


def languages(b: tb.Block) -> np.ndarray:
    """Index into LANGUAGES for each text, by its own words; ties and texts
    without function words go to the first."""
    return function_word_counts(b).argmax(axis=1)
