"""URL filter against a plain version of rules and models."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from driftlens.llm import urls

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    if not m:
        return "", ""
    host = re.sub("[A-Z]+", lambda x: x[0].lower(), m[1])
    return host, m[2]


def ruled(host, path):
    best = None
    for text, verdict in RULES:
        h, p = text.split("/", 1)[0], text[text.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return best or (None, None)


def grams(text):
    t = "\x02" * 4 + text + "\x03"
    return [t[i : i + 5] for i in range(len(text) + 1)]


def model(texts, kinds):
    n, after = Counter(), {}
    for t in texts:
        for g in grams(t):
            for k in range(1, 6):
                n[g[5 - k :]] += 1
                after.setdefault(g[5 - k : 4], Counter())[g[-1]] += 1

    def log_p(g):
        p = 1 / (kinds + 1)
        for k in range(1, 6):
            seen = after.get(g[5 - k : 4])
            if seen:
                p = (n[g[5 - k :]] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return math.log(p)

    return log_p


def fixture():
    rng = random.Random(5)
    hosts = ["a.example.net", "example.net", "b.example.com", "x.example.org", "EXAMPLE.com", "net", "knet", "casino.example.com"]
    rows = [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(400)}{rng.choice(['', '?q=1', '#t', '/'])}" for _ in range(300)]
    rows += [None, "", "nothing", "http://", "http://net", "http://NET/x?y://z", "ftp://ä.org/fr/ü🙂", "x://y.org#a/fr/", rows[0], rows[0], "http://h.org/" + "a" * 20_000]
    return list(enumerate(rows))


def test_against_plain(spark):
    rows = fixture()
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame([(i, u, 1, "s") for i, u in rows], "page_id long, url string, score int, label string")).collect()}
    assert len(got) == len(rows)
    texts, label = {}, {}
    for i, u in rows:
        host, path = parts(u)
        rule, verdict = ruled(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if verdict:
            assert got[i]["verdict"] == verdict and got[i]["score"] is None
        texts[i], label[host + path] = host + path, verdict
    seen = [t for t, v in label.items() if v and zlib.crc32(t.encode()) % 5]
    kinds = len({g[-1] for t in seen for g in grams(t)})
    allow, block = (model([t for t in seen if label[t] == v], kinds) for v in ("allow", "block"))
    limits = {"allow": [], "block": []}
    for i, t in texts.items():
        if not label[t]:
            want = sum(allow(g) - block(g) for g in grams(t)) / len(grams(t))
            assert got[i]["score"] == pytest.approx(want, abs=1e-9)
            limits[got[i]["verdict"]].append(want)
    if limits["allow"] and limits["block"]:
        assert min(limits["allow"]) >= max(limits["block"])


def test_nothing_to_learn_from(spark):
    rows = [(1, "http://a.org/x"), (2, "http://b.net/x"), (3, None)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["allow", "block", "allow"]
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_models_tell_languages_apart(spark):
    """Without the rule that decides a part of the URLs, the method still judges
    them like the URLs that resemble them."""
    rng = random.Random(6)
    good = [f"http://news.example.org/fr/article-{rng.randrange(10**6)}" for _ in range(150)]
    bad = [f"http://casino.win.net/bonus/{rng.randrange(10**6)}" for _ in range(150)]
    asked = [f"http://news.example.com/fr/article-{rng.randrange(10**6)}" for _ in range(20)] + [f"http://casino.win.com/bonus/{rng.randrange(10**6)}" for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(good + bad + asked)), "page_id long, url string")
    got = [r["verdict"] for r in urls.judge_urls(df).orderBy("page_id").collect()][300:]
    assert got == ["allow"] * 20 + ["block"] * 20
