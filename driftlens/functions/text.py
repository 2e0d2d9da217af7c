"""Text expressions: Column in, Column out. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions import fixed


def _any(terms: list[Column]) -> Column:
    """Disjunction that codegen can short-circuit; false for no terms."""
    return reduce(lambda a, b: a | b, terms) if terms else F.lit(False)


def contains_any(text: Column, phrases: list[str]) -> Column:
    return _any([text.contains(p) for p in phrases])


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once per row.

    A Column used in several places is an expression repeated in several
    places; a one-element transform gives it a name instead.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def nonblank(col: Column) -> Column:
    """NULL for an empty string: the value that a falsy check would skip."""
    return F.when(col != "", col)


def fold_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


# -- extraction --------------------------------------------------------------
def extract_hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)#(\w+)"), F.lit(1))


def extract_mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)@(\w+)"), F.lit(1))


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)https?://\S+"), F.lit(0))


def search_terms(query: Column) -> Column:
    """Words of a free-text query; no operator syntax survives."""
    return F.regexp_extract_all(query, F.lit(r"(?U)[\w#@]+"), F.lit(0))


# -- normalisation -----------------------------------------------------------
def normalize_for_model(text: Column) -> Column:
    return fold_spaces(F.regexp_replace(text, r"(?U)@\w+|https?://\S+", " "))


def duplicate_key(text: Column) -> Column:
    """Equality key for "the same text": normalised, lower-cased, hashed so that
    shuffles carry 32 characters instead of the whole text."""
    return F.md5(F.lower(normalize_for_model(text)))


def topic_text(text: Column) -> Column:
    folded = fold_spaces(F.regexp_replace(text, r"(?U)@\w[\w.]*|https?://\S+", " "))
    return F.coalesce(nonblank(folded), text)


def collapse_repeats(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)(.)\1{2,}", "$1$1")


def phonetic_key(token: Column) -> Column:
    squeezed = collapse_repeats(F.lower(token))
    tail = F.regexp_replace(F.right(squeezed, F.length(squeezed) - 1), "[aeiou]", "")
    return F.when(token == "", token).otherwise(F.concat(F.lower(F.substring(token, 1, 1)), tail))


def canonicalize_tokens(text: Column, variants=None, emoji=None) -> Column:
    """Emoji become bracketed tags, spelling variants one form, spaces fold."""
    variants = fixed.SPELLING_VARIANTS if variants is None else variants
    emoji = fixed.EMOJI_TAGS if emoji is None else emoji
    for symbol, tag in emoji.items():
        text = F.replace(text, F.lit(symbol), F.lit(f" {tag} "))
    table = F.create_map(*[F.lit(x) for pair in variants.items() for x in pair])
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    canonical = F.transform(
        words, lambda w: F.coalesce(F.try_element_at(table, F.btrim(F.lower(w), F.lit(".,!?;:"))), w)
    )
    return F.array_join(canonical, " ")


def decode_entities(text: Column, entities=None) -> Column:
    """Named entities from a table and numeric ones by code point."""
    for entity, char in (fixed.HTML_ENTITIES if entities is None else entities).items():
        if entity != "&amp;":
            text = F.replace(text, F.lit(entity), F.lit(char))
    text = _decode_numeric(text, r"&#(\d{1,7});", 10, "&#")
    text = _decode_numeric(text, r"&#x([0-9a-fA-F]{1,6});", 16, "&#x")
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _decode_numeric(text: Column, pattern: str, base: int, prefix: str) -> Column:
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))

    def substitute(acc: Column, code: Column) -> Column:
        char = F.decode(F.unhex(F.lpad(F.conv(code, base, 16), 8, "0")), "UTF-32")
        return F.replace(acc, F.concat(F.lit(prefix), code, F.lit(";")), char)

    return F.aggregate(codes, text, substitute)


_TRAILER = (
    r"\s+(via\s+(The\s+)?[A-Z][\w]*(\s[A-Z][\w]*){0,3}|Read more.*|Catch the complete story.*)\s*$"
)


def clean_text(text: Column) -> Column:
    """Plain text of a feed item: no tags, entities, links or source trailers."""
    t = decode_entities(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " "))
    t = F.regexp_replace(t, r"https?://\S+", "")
    t = F.regexp_replace(t, _TRAILER, "")
    t = F.regexp_replace(t, r"\s*🔗\s*", " ")
    return fold_spaces(t)


def sanitize_post(text: Column, max_chars: int = fixed.DIGEST_CHARS) -> Column:
    t = F.regexp_replace(text, r"<[^>]{0,200}>", " ")
    t = F.regexp_replace(t, "```|\\x00", " ")
    return F.substring(fold_spaces(t), 1, max_chars)


# -- tokens, scripts and languages -------------------------------------------
def topic_tokens(text: Column, stopwords=None) -> Column:
    stop = fixed.TOPIC_STOPWORDS if stopwords is None else stopwords
    found = F.regexp_extract_all(F.lower(text), F.lit(r"#?[a-z][a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~F.ltrim(t, F.lit("#")).isin(stop))


def _count_class(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def detect_script(text: Column) -> Column:
    counts = F.struct(
        _count_class(text, r"ऀ-ॿ").alias("deva"), _count_class(text, "a-zA-Z").alias("latin"),
        _count_class(text, r"؀-ۿ").alias("arabic"),
    )
    return bind(counts, lambda c: (
        F.when((c["deva"] > c["latin"]) & (c["deva"] > c["arabic"]), "devanagari")
        .when((c["arabic"] > c["latin"]) & (c["arabic"] > c["deva"]), "arabic")
        .otherwise("latin")
    ))


def _latin_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z]+\b"), F.lit(0))


def is_hinglish(text: Column, lexicon=None, threshold: float = 0.25) -> Column:
    known = fixed.HINGLISH_WORDS if lexicon is None else lexicon

    def dense(words: Column) -> Column:
        share = F.coalesce(F.try_divide(_count_in(words, known), F.size(words)), F.lit(0.0))
        return (F.size(words) >= 3) & (share >= threshold)

    return (detect_script(text) == "latin") & bind(_latin_words(text), dense)


def _count_in(words: Column, known: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(known)))


def profile_language(text: Column, profiles=None) -> Column:
    """Language whose function words occur most often; "en" when none occur.
    Ties go to the language listed first."""
    profiles = fixed.LANGUAGE_PROFILES if profiles is None else profiles
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))

    def votes(w: Column) -> Column:
        return F.struct(*[_count_in(w, stop).alias(lang) for lang, stop in profiles.items()])

    def choose(v: Column) -> Column:
        best = F.array_max(F.array(*[v[lang] for lang in profiles]))
        choice = F.when(best <= 0, "en")
        for lang in profiles:
            choice = choice.when(v[lang] == best, lang)
        return choice.otherwise("en")

    return bind(bind(words, votes), choose)


def detect_lang(text: Column, lexicon=None, profiles=None) -> Column:
    return (
        F.when(text.isNull() | ~text.rlike(r"(?U)\S"), "unknown")
        .when(detect_script(text) == "devanagari", "hi")
        .when(is_hinglish(text, lexicon), "hi-Latn")
        .otherwise(profile_language(text, profiles))
    )


# -- labels ------------------------------------------------------------------
_LABEL_EDGES = " -–—,:;"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def label_from_text(text: Column, max_words: int = 7) -> Column:
    """Readable topic name from one post, or NULL when it yields none."""
    t = F.regexp_replace(text, r"(?U)#\w+|@\w[\w.]*|https?://\S+|\[[^\]]*\]", " ")
    parts = F.filter(
        F.transform(F.split(t, r"(?U)[!?.]+|\s[-–—]\s"), lambda p: F.btrim(p, F.lit(_LABEL_EDGES))),
        lambda p: p != "",
    )

    def longest(p: Column) -> Column:
        first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return F.when(F.size(_words(second)) > F.size(_words(first)), second).otherwise(first)

    def without_prefix(p: Column) -> Column:
        return F.trim(F.regexp_replace(p, r"(?i)^(breaking|alert|urgent|warning|update|news|fyi|exclusive)\s*[:\-!]\s*", ""))

    def finish(body: Column) -> Column:
        short = F.rtrim(F.array_join(F.slice(_words(body), 1, max_words), " "), F.lit(" ,;:-"))
        usable = (F.size(_words(body)) >= 2) & body.rlike("[A-Za-z]")
        return F.when(usable, bind(short, capitalised))

    def capitalised(s: Column) -> Column:
        shouting = (F.upper(s) == s) & (F.lower(s) != s)
        cased = F.when(shouting, F.initcap(F.lower(s))).otherwise(s)
        return bind(cased, lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.right(c, F.length(c) - 1)))

    return bind(bind(parts, lambda p: without_prefix(longest(p))), finish)


# -- JSON --------------------------------------------------------------------
def parse_json_default(value: Column, schema: str, default: Column) -> Column:
    """Parsed value, or the default for NULL, empty or malformed text."""
    valid = F.try_parse_json(value).isNotNull()
    return F.coalesce(F.when(valid, F.from_json(value, schema)), default)


def canonical_json(df, columns: list[str] | None = None) -> Column:
    """Sorted-key JSON of some columns, nulls kept, nested structs sorted too."""
    from pyspark.sql import types as T

    def ordered(col: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StructType):
            fields = sorted(dtype.fields, key=lambda f: f.name)
            rebuilt = F.struct(*[ordered(col.getField(f.name), f.dataType).alias(f.name) for f in fields])
            return F.when(col.isNotNull(), rebuilt)
        if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            return F.transform(col, lambda x: ordered(x, dtype.elementType))
        return col

    names = sorted(columns or df.columns)
    parts = [ordered(F.col(f"`{n}`"), df.schema[n].dataType).alias(n) for n in names]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
