"""Scalar functions over whole texts."""

from pyspark.sql import functions as F

from driftlens.functions import affect, audience, fixed, numeric, rules
from driftlens.functions import text as tx
from driftlens.functions.time import time_bucket
from driftlens.operators import demographics as dm
from driftlens.operators.topics import centroid
from driftlens.plans import views as vw
from driftlens.plans.catalog import joined, query, r6, sql_ts, ts
from driftlens.plans.views import NORMAL_SQL, Views, with_views

W = "[\\p{L}\\p{M}\\p{N}_]"
HINDI = ["the", "of", "and", "der", "que", "les", "to", "in"]


@query("x01_extract_tokens", with_views(["v_posts"], f"""
    SELECT post_id, array_to_string(regexp_extract_all(text || ' #' || tag, '#({W}+)', 1), ',') AS hashtags,
      array_to_string(regexp_extract_all(text, '@({W}+)', 1), ',') AS mentions,
      array_to_string(regexp_extract_all(text, 'https?://\\S+'), ',') AS urls FROM v_posts"""))
def _(v: Views):
    tagged = F.concat("text", F.lit(" #"), F.get("hashtags", F.lit(0)))
    return v.posts.select("post_id", joined(tx.extract_hashtags(tagged)).alias("hashtags"),
                          joined(tx.extract_mentions(F.col("text"))).alias("mentions"), joined(tx.extract_urls(F.col("text"))).alias("urls"))


def _per_text(v: Views, expr, name: str):
    return v.texts.select("doc_id", expr.alias(name))


@query("x02_normalize_for_model", with_views(["v_texts"], f"SELECT doc_id, md5({NORMAL_SQL.format('text')}) AS normal_md5 FROM v_texts"))
def _(v: Views):
    return _per_text(v, F.md5(tx.normalize_for_model(F.col("text"))), "normal_md5")


_VARIANTS = "MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in fixed.SPELLING_VARIANTS.items()) + "}"


@query("x03_canonicalize_tokens", with_views(["v_texts"], f"""
    SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''),
      lambda w: coalesce({_VARIANTS}[trim(lower(w), '.,!?;:')], w)), ' ')) AS canonical_md5 FROM v_texts"""))
def _(v: Views):
    return _per_text(v, F.md5(tx.canonicalize_tokens(F.col("text"))), "canonical_md5")


_COLLAPSE = ("array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: i < 3 OR {0}[i] = chr(10) OR {0}[i] <> {0}[i-1] "
             "OR {0}[i] <> {0}[i-2]), lambda i: {0}[i]), '')")


@query("x04_collapse_repeats", with_views(["v_texts"], f"""
    SELECT doc_id, md5({_COLLAPSE.format('ch')}) AS collapsed_md5 FROM (SELECT doc_id, string_split(text || 'zzzz', '') AS ch FROM v_texts)"""))
def _(v: Views):
    return _per_text(v, F.md5(tx.collapse_repeats(F.concat("text", F.lit("zzzz")))), "collapsed_md5")


@query("x05_phonetic_key", with_views(["v_texts"], f"""
    SELECT key AS phonetic, count(*) AS spellings FROM (
      SELECT substr(w, 1, 1) || regexp_replace(substr({_COLLAPSE.format('ch')}, 2), '[aeiou]', '', 'g') AS key FROM (
        SELECT w, string_split(w, '') AS ch FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM v_texts))) GROUP BY 1"""))
def _(v: Views):
    words = v.texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("w")).distinct()
    return words.groupBy(tx.phonetic_key(F.col("w")).alias("phonetic")).agg(F.count("*").alias("spellings"))


@query("x06_detect_script", with_views(["v_texts"], """
    SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'devanagari' WHEN 2 THEN 'arabic' ELSE 'latin' END AS script FROM v_texts"""))
def _(v: Views):
    mark = F.when(F.col("doc_id") % 3 == 1, "क").when(F.col("doc_id") % 3 == 2, "ع").otherwise("")
    return _per_text(v, tx.detect_script(F.concat("text", F.repeat(mark, F.length("text") + 1))), "script")


_WORDS = f"regexp_extract_all(lower(text), '{W}+')"
_ASCII_WORDS = f"list_filter({_WORDS}, lambda w: regexp_full_match(w, '[a-z]+'))"


@query("x07_is_hinglish", with_views(["v_texts"], f"""
    SELECT doc_id, len(w) >= 3 AND len(list_filter(w, lambda t: t IN ({', '.join(repr(x) for x in HINDI)}))) / greatest(len(w), 1) >= 0.25 AS hinglish
    FROM (SELECT doc_id, {_ASCII_WORDS} AS w FROM v_texts)"""))
def _(v: Views):
    return _per_text(v, tx.is_hinglish(F.col("text"), HINDI), "hinglish")


def _vote(lang: str) -> str:
    return f"len(list_filter(w, lambda t: t IN ({', '.join(repr(x) for x in fixed.LANGUAGE_PROFILES[lang])})))"


@query("x08_detect_lang", with_views(["v_texts"], f"""
    SELECT doc_id, CASE WHEN len(a) >= 3 AND len(list_filter(a, lambda t: t IN ({', '.join(repr(x) for x in fixed.HINGLISH_WORDS)}))) / greatest(len(a), 1) >= 0.25
      THEN 'hi-Latn' WHEN greatest(en, fr, es, de) = 0 THEN 'en' WHEN en = greatest(en, fr, es, de) THEN 'en' WHEN fr = greatest(en, fr, es, de) THEN 'fr'
      WHEN es = greatest(en, fr, es, de) THEN 'es' ELSE 'de' END AS detected
    FROM (SELECT doc_id, a, {_vote('en')} AS en, {_vote('fr')} AS fr, {_vote('es')} AS es, {_vote('de')} AS de
          FROM (SELECT doc_id, {_WORDS} AS w, {_ASCII_WORDS} AS a FROM v_texts))"""))
def _(v: Views):
    return _per_text(v, tx.detect_lang(F.col("text")), "detected")


@query("x09_topic_text", with_views(["v_texts"], f"""
    SELECT doc_id, md5(coalesce(nullif(trim(regexp_replace(regexp_replace(text, '@{W}[\\p{{L}}\\p{{M}}\\p{{N}}_.]*|https?://\\S+', ' ', 'g'), '\\s+', ' ', 'g')), ''), text))
      AS topic_md5 FROM v_texts"""))
def _(v: Views):
    return _per_text(v, F.md5(tx.topic_text(F.col("text"))), "topic_md5")


@query("x10_tokens", with_views(["v_texts"], f"""
    SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (
      SELECT doc_id, list_filter(regexp_extract_all(lower(text), '#?[a-z][a-z0-9]+'),
        lambda t: ltrim(t, '#') NOT IN ({', '.join(repr(x) for x in fixed.TOPIC_STOPWORDS)})) AS t FROM v_texts)"""))
def _(v: Views):
    t = tx.topic_tokens(F.col("text"))
    return v.texts.select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def _entities_sql(expr: str) -> str:
    for entity, char in fixed.HTML_ENTITIES.items():
        quoted = "''" if char == "'" else char
        expr = f"replace({expr}, '{entity}', '{quoted}')"
    return expr


@query("x11_clean_text", f"""
    SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_entities_sql("regexp_replace(html, '<[^>]+>', ' ', 'g')")},
      'https?://\\S+', '', 'g'), '\\s+(via\\s+(The\\s+)?[A-Z][\\w]*(\\s[A-Z][\\w]*){{0,3}}|Read more.*|Catch the complete story.*)\\s*$', ''),
      '\\s*🔗\\s*', ' ', 'g'), '\\s+', ' ', 'g'))) AS clean_md5 FROM pages""")
def _(v: Views):
    return v.table("pages").select("page_id", F.md5(tx.clean_text(F.col("html"))).alias("clean_md5"))


@query("x12_sanitize_post", """
    SELECT page_id, substr(trim(regexp_replace(replace(regexp_replace(html, '<[^>]{0,200}>', ' ', 'g'), '```', ' '), '\\s+', ' ', 'g')), 1, 400) AS sanitized FROM pages""")
def _(v: Views):
    return v.table("pages").select("page_id", tx.sanitize_post(F.col("html")).alias("sanitized"))


@query("x13_readable_label")
def _(v: Views):
    return _per_text(v, F.coalesce(tx.label_from_text(F.col("text")), F.lit("")), "label")


def _any_sql(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


STANCE_SQL = f"""CASE WHEN {_any_sql('padded', vw.DEBUNK)} THEN 'debunking'
      WHEN {_any_sql('padded', vw.QUESTION)} OR (kind IN ('reply', 'comment') AND ends_with(trim(padded), '?')) THEN 'questioning'
      WHEN kind IN ('post', 'repost', 'forward', 'share') OR {_any_sql('padded', vw.SPREAD)} THEN 'spreading' ELSE 'reacting' END"""
PADDED = "' ' || regexp_replace(lower(text), '\\s+', ' ', 'g') || ' '"


def stance_of(text, kind):
    return rules.stance(text, kind, vw.DEBUNK, vw.QUESTION, vw.SPREAD)


@query("x14_stance", with_views(["v_posts"], f"SELECT post_id, {STANCE_SQL} AS stance FROM (SELECT post_id, kind, {PADDED} AS padded FROM v_posts)"))
def _(v: Views):
    return v.posts.select("post_id", stance_of(F.col("text"), F.col("kind")).alias("stance"))


def _sector_sql(min_hits: int) -> str:
    sums = [
        "(" + " + ".join(f"(length(padded) - length(replace(padded, '{k}', ''))) // {len(k)}" for k in words) + f") AS h_{name}"
        for name, words in fixed.SECTORS.items()
    ]
    best = "greatest(" + ", ".join(f"h_{n}" for n in fixed.SECTORS) + ")"
    cases = " ".join(f"WHEN h_{n} = {best} THEN '{n}'" for n in fixed.SECTORS)
    return with_views(["v_texts"], f"""SELECT doc_id, CASE WHEN {best} < {min_hits} THEN 'other' {cases} END AS sector
      FROM (SELECT doc_id, {', '.join(sums)} FROM (SELECT doc_id, {PADDED} AS padded FROM v_texts))""")


@query("x15_sector", _sector_sql(1))
def _(v: Views):
    return _per_text(v, rules.sector(F.col("text")), "sector")


@query("x16_strict_sector", _sector_sql(2))
def _(v: Views):
    return _per_text(v, rules.strict_sector(F.col("text")), "sector")


# Audience cues leave only as released cohorts.
def _cohort_sql(bucket: str, source: str, views: list[str]) -> str:
    return with_views(views, f"SELECT * FROM (SELECT {bucket} AS bucket, count(*) AS n FROM {source} GROUP BY 1) WHERE bucket IS NOT NULL AND n >= {vw.K}")


def _cohort(d, bucket):
    counts = d.select(F.lit("cue").alias("dimension"), bucket.alias("bucket")).where("bucket IS NOT NULL").groupBy("dimension", "bucket").agg(F.count("*").alias("n"))
    return dm.release_counts(counts, k=vw.K, epsilon=0)[0].select("bucket", F.col("count").alias("n"))


@query("x17_infer_region", _cohort_sql("region", "v_accounts LEFT JOIN v_gaz ON alias = lower(location_text)", ["v_accounts", "v_gaz"]))
def _(v: Views):
    return _cohort(audience.infer_region(v.accounts, v.gazetteer, vw.GAZETTEER_CHARS), F.col("region"))


INTEREST_SQL = ("CASE WHEN contains(lower(bio), 'building') THEN 'building' WHEN contains(lower(bio), 'automobile') THEN 'driving' "
                "WHEN contains(lower(bio), 'household') OR contains(lower(bio), 'furniture') THEN 'home' ELSE 'other' END")


@query("x18_infer_interest", _cohort_sql(INTEREST_SQL, "v_accounts", ["v_accounts"]))
def _(v: Views):
    return _cohort(v.accounts, audience.infer_interest(F.col("bio"), vw.INTERESTS))


_BORN = "CAST(nullif(regexp_extract(lower(bio), '\\bborn\\s+(\\d{4})\\b', 1), '') AS INTEGER)"
AGE_SQL = (f"CASE WHEN {_BORN} IS NOT NULL THEN CASE WHEN {vw.AS_OF_YEAR} - {_BORN} < 18 THEN NULL WHEN {vw.AS_OF_YEAR} - {_BORN} < 25 THEN '18-24' "
           f"WHEN {vw.AS_OF_YEAR} - {_BORN} < 35 THEN '25-34' WHEN {vw.AS_OF_YEAR} - {_BORN} < 50 THEN '35-49' ELSE '50+' END "
           "WHEN contains(lower(bio), 'class 12') THEN NULL WHEN contains(lower(bio), 'retired') THEN '50+' WHEN contains(lower(bio), 'phd') THEN '25-34' END")


@query("x19_infer_age_bracket", _cohort_sql(AGE_SQL, "v_accounts", ["v_accounts"]))
def _(v: Views):
    return _cohort(v.accounts, audience.infer_age_bracket(F.col("bio"), vw.AS_OF_YEAR))


@query("x20_lexicon_scores", with_views(["v_text_emo"], "SELECT doc_id, anxiety, excitement, supportive, against, sarcasm FROM v_text_emo"))
def _(v: Views):
    scores = affect.lexicon_scores(tx.normalize_for_model(F.col("text")), vw.LEXICON)
    return v.texts.select("doc_id", scores.alias("s")).select("doc_id", "s.*")


@query("x21_compose_affect", with_views(["v_text_emo"], """
    SELECT doc_id, round(greatest(0.0, 1.0 - greatest(anxiety, excitement, supportive, against)), 6) AS neutral,
      CASE WHEN supportive + excitement > against + anxiety THEN 'positive' WHEN against + anxiety > 0 THEN 'negative' ELSE 'neutral' END AS by_lexicon,
      CASE WHEN greatest(anxiety, excitement, supportive, against) < 0.5 THEN 'neutral'
           WHEN greatest(supportive, excitement) > greatest(against, anxiety) THEN 'positive' ELSE 'negative' END AS by_model FROM v_text_emo"""))
def _(v: Views):
    s = affect.lexicon_scores(tx.normalize_for_model(F.col("text")), vw.LEXICON)
    d = v.texts.select("doc_id", s.alias("s"))
    a, m = affect.compose_affect(F.col("s")), affect.compose_affect(F.col("s"), "model")
    return d.select("doc_id", r6(a["neutral"]).alias("neutral"), a["sentiment"].alias("by_lexicon"), m["sentiment"].alias("by_model"))


@query("x22_logistic", "SELECT event_id, round(1 / (1 + exp(-(value - 20) / 10)), 6) AS p FROM events")
def _(v: Views):
    return v.table("events").select("event_id", r6(numeric.logistic((F.col("value") - 20) / 10)).alias("p"))


@query("x23_cosine", """
    WITH c AS (SELECT label, list(m ORDER BY i) AS center FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), center), 6) AS similarity FROM embeddings JOIN c USING (label)""")
def _(v: Views):
    e = v.table("embeddings")
    centers = centroid(e.select("label", F.col("embedding").alias("vector")), ["label"]).select("label", F.col("vector").alias("center"))
    return e.join(centers, "label").select("vec_id", r6(numeric.cosine(F.col("embedding"), F.col("center"))).alias("similarity"))


@query("x24_hamming64", with_views(["v_media"], """
    SELECT a.media_id, bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || b.phash)::UBIGINT)) AS hamming
    FROM v_media a JOIN v_media b ON b.media_id = a.media_id || 'v'"""))
def _(v: Views):
    a = v.media.select("media_id", F.col("phash").alias("pa"))
    b = v.media.where(F.col("media_id").endswith("v")).select(F.rtrim("media_id", F.lit("v")).alias("media_id"), F.col("phash").alias("pb"))
    return a.join(b, "media_id").select("media_id", numeric.hamming64(F.col("pa"), F.col("pb")).alias("hamming"))


_SECRET = b"benchmark"
_IPAD = bytes(k ^ 0x36 for k in _SECRET.ljust(64, b"\0")).hex()
_OPAD = bytes(k ^ 0x5C for k in _SECRET.ljust(64, b"\0")).hex()


@query("x25_pseudonymize", with_views(["v_accounts"], f"""
    SELECT handle, substr(sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(account_id)))), 1, 16) AS pseudonym FROM v_accounts"""))
def _(v: Views):
    return v.accounts.select("handle", numeric.pseudonymize(F.col("account_id"), _SECRET).alias("pseudonym"))


@query("x26_canonical_json", """
    SELECT event_id, '{"event_id":' || event_id || ',"inner":{"a":"' || event_type || '","b":' || user_id || '},"zip":null}' AS payload FROM events""")
def _(v: Views):
    d = v.table("events").select(F.lit(None).cast("string").alias("zip"), F.struct(F.col("user_id").alias("b"), F.col("event_type").alias("a")).alias("inner"), "event_id")
    return d.select("event_id", tx.canonical_json(d).alias("payload"))


@query("x27_time_bucket", f"""
    SELECT event_id, {sql_ts("date_trunc('minute', ts)")} AS m1, {sql_ts("time_bucket(INTERVAL 10 MINUTE, ts)")} AS m10,
      {sql_ts("date_trunc('hour', ts)")} AS h1, {sql_ts("CAST(date_trunc('day', ts) AS TIMESTAMP)")} AS d1 FROM events""")
def _(v: Views):
    at = F.col("ts").cast("timestamp")
    return v.table("events").select("event_id", *[ts(time_bucket(at, w)).alias(n) for w, n in (("1m", "m1"), ("10m", "m10"), ("1h", "h1"), ("1d", "d1"))])


@query("x28_search_terms", with_views(["v_texts"], f"SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_#@]+'), ' ')) AS terms_md5 FROM v_texts"))
def _(v: Views):
    return _per_text(v, F.md5(F.array_join(tx.search_terms(F.col("text")), " ")), "terms_md5")


@query("x29_parse_json_default", """
    SELECT event_id, CASE WHEN event_id % 10 < 2 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def _(v: Views):
    m = F.col("event_id") % 10
    value = F.when(m == 0, "{broken").when(m == 1, "").otherwise(F.col("props"))
    default = F.from_json(F.lit('{"k": -1}'), "k BIGINT")
    return v.table("events").select("event_id", tx.parse_json_default(value, "k BIGINT", default)["k"].alias("k"))
