"""Scalar functions on hand-made inputs."""

import hashlib
import hmac

import numpy as np
from pyspark.sql import functions as F

from driftlens.functions import affect, audience, numeric, rules
from driftlens.functions import text as tx
from driftlens.functions.time import parse_event_time


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t STRING").select(expr(F.col("t")).alias("x")).first()["x"]


def test_tokens_and_normalisation(spark):
    assert one(spark, "a #बाढ़ #dam_1 b", tx.extract_hashtags) == ["बाढ़", "dam_1"]
    assert one(spark, "hey  @bob see https://x.y/z now", tx.normalize_for_model) == "hey see now"
    assert one(spark, "sooooo gooood aab", tx.collapse_repeats) == "soo good aab"
    assert one(spark, "Nhi, 🔥 bohot theek", tx.canonicalize_tokens) == "nahi [fire] bahut theek"
    assert one(spark, "bhai", tx.phonetic_key) == "bh"
    assert one(spark, "@bob http://a.b", tx.topic_text) == "@bob http://a.b"
    assert one(spark, '<p>a &lt;b&gt; &amp;amp; &#39;q&#x41; via The Big Paper', tx.clean_text) == "a <b> &amp; 'qA"


def test_language(spark):
    assert one(spark, "बाँध टूट गया", tx.detect_lang) == "hi"
    assert one(spark, "yaar kya hai yeh bahut galat", tx.detect_lang) == "hi-Latn"
    assert one(spark, "  ", tx.detect_lang) == "unknown"
    assert one(spark, "le chat est dans la maison avec une souris", tx.detect_lang) == "fr"
    assert one(spark, "zzz qqq", tx.detect_lang) == "en"


def test_label(spark):
    assert one(spark, "BREAKING: Dam has cracked near the town hall today folks! Run", tx.label_from_text) == \
        "Dam has cracked near the town hall"
    assert one(spark, "PETROL PRICE UP", tx.label_from_text) == "Petrol Price Up"
    assert one(spark, "#only @tags", tx.label_from_text) is None


def test_stance_and_sector(spark):
    d = spark.createDataFrame([("This is FAKE, share", "post"), ("is it true", "post"), ("ok?", "reply"),
                               ("breaking news", "reply"), ("hmm", "reply")], "t STRING, k STRING")
    got = [r[0] for r in d.select(rules.stance(F.col("t"), F.col("k"))).collect()]
    assert got == ["debunking", "questioning", "questioning", "spreading", "reacting"]
    assert one(spark, "petrol price and fuel tax", rules.sector) == "economy"
    assert one(spark, "the dam", rules.strict_sector) == "other"


def test_affect(spark):
    s = one(spark, "Evacuate NOW!! danger", affect.lexicon_scores)
    assert s["anxiety"] == 1.0 and s["sarcasm"] == 0.0
    s = one(spark, "great WORK yes", affect.lexicon_scores)
    assert s["excitement"] == 0.75 and s["anxiety"] == 0.0


def test_age_and_minors(spark):
    def age(bio):
        return one(spark, bio, lambda c: audience.infer_age_bracket(c, 2024))

    assert age("Class 12 student") is None
    assert age("B.Tech 2nd yr student") == "18-24"
    assert age("Retired teacher") == "50+"
    assert age("born 2010") is None and age("born 1990") == "25-34"


def test_region_is_whole_word(spark):
    d = spark.createDataFrame([("startup founder",), ("Lives in Navi Mumbai",), ("Pune, Kerala",), (None,)], "location_text STRING")
    got = {r["location_text"]: r["region"] for r in audience.infer_region(d, audience.default_gazetteer(spark)).collect()}
    assert got == {"startup founder": None, "Lives in Navi Mumbai": "maharashtra", "Pune, Kerala": "maharashtra", None: None}


def test_hmac_and_hashes(spark):
    want = hmac.new(b"k", b"acc", hashlib.sha256).hexdigest()[:16]
    assert one(spark, "acc", lambda c: numeric.pseudonymize(c, b"k")) == want
    assert one(spark, "ffffffffffffffff", lambda c: numeric.hamming64(c, F.lit("0000000000000001"))) == 63


def test_event_times(spark):
    def at(v):
        return one(spark, v, lambda c: F.date_format(parse_event_time(c), "yyyy-MM-dd HH:mm:ss"))

    assert at("2024-11-07 17:20:00 IST") == "2024-11-07 11:50:00"
    assert at("1730998800") == "2024-11-07 17:00:00"
    assert at("2024-11-07") == "2024-11-07 00:00:00"
    assert at("2024-11-07T17:05:00Z") == "2024-11-07 17:05:00"


def test_noise_has_the_right_scale(spark):
    d = spark.range(2000).select(numeric.laplace_from_uniform(numeric.uniform_from_key(F.col("id"), F.lit(1)), 2.0).alias("x"))
    x = np.array([r[0] for r in d.collect()])
    assert abs(x.mean()) < 0.5 and 2.0 < x.std() < 3.8


def test_canonical_json(spark):
    d = spark.createDataFrame([(1, None, ("é", 2))], "b INT, a STRING, c STRUCT<z: STRING, y: INT>")
    assert d.select(tx.canonical_json(d).alias("j")).first()["j"] == '{"a":null,"b":1,"c":{"y":2,"z":"é"}}'


def test_numbered(spark):
    from driftlens.functions.sequence import numbered

    names = [f"k{(i * 37) % 101:03d}" for i in range(101)]
    got = numbered(spark.createDataFrame([(x,) for x in names], "name string"), ["name"], "place").collect()
    assert {r["name"]: r["place"] for r in got} == {x: i for i, x in enumerate(sorted(names))}
    assert numbered(spark.createDataFrame([], "name string"), ["name"], "place").collect() == []
