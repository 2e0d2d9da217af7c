"""Small fixtures and plain Python versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, key binary, _lost int, _gone string, slot int"


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def shingles_of(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared lines and passages, odd cases."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(3, 90)) for _ in range(n)]
    shared = ["This very line is held by many documents.", "  another SHARED line of text, held often\t", "short line", "", "ä" * 20]
    texts = list(base)
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(w))
    texts += [rng.choice(base) for _ in range(15)]
    texts = [t if rng.random() < 0.5 else "\n".join([t, *rng.sample(shared, 2)]) for t in texts]
    texts += [None, "", "   \n\t ", "one two", "one two", "ONE Two", "a b c d e", "A b c d E", "\n\n", sentence(rng, 6000), "y" * 300_000, "Ünïcode 🙂 text – with ß and İ"]
    return list(enumerate(texts))


def frame(spark, rows):
    """A documents table with columns that operators may use inside."""
    data = [(i, t, "en", "s", len(t) if t is not None else None, "l", 0.5, b"k", 1, "g", 2) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA)


ODD_ROWS = [(None, "a row without an id, and with words enough"), (5, "a row of a repeated id, and with words enough"), (5, "a row of a repeated id, and with words enough")]


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
