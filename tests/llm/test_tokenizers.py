"""Token counts and piece ids against the public libraries."""

import os
import random
import subprocess
import sys

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from small import corpus, frame

from driftlens.llm import pieces, transducer
from driftlens.llm.tables import tokenizer_path

sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("tokenizers")
ODD = [
    "it's 'twas we'll'd o''s 'sing 12345 1st ²½ Ⅷ", "don't!!!'s --'s", "<|endoftext|>hello<|startoftext|> x<|endof", "İstanbul ΣΑΣ ςσ ﬁ", "日本語テキスト🙂🙂\u200bzero",
    "a\u2003b\u00a0c\x1fd\x85e", "x" * 5000, "ab" * 3000 + " " + "the" * 999, "e\u0301 café A\u030a", "!" * 777, "١٢٣ १२३", "<|ENDOFTEXT|>", "\u0300\u0345a", "  two  spaces ",
    "a\nb\tc", " \n\n ", "x</s>y", "<0x0A> <s>", " " * 300, "-" * 217 + "x" * 99 + "=" * 400,
]
ANY = st.text(alphabet=st.one_of(st.sampled_from("abctheing 's.\n▁<|>0é"), st.characters(codec="utf-8")), max_size=80)


@pytest.fixture(scope="module")
def word_library():
    return tokenizers.Tokenizer.from_file(tokenizer_path(transducer.WORD_MODEL))


@pytest.fixture(scope="module")
def piece_library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.PIECE_MODEL))


@pytest.fixture(scope="module")
def counter():
    return transducer.Counter(transducer.WordModel.read(tokenizer_path(transducer.WORD_MODEL)))


@pytest.fixture(scope="module")
def codec():
    v = pieces.Vocabulary.read(tokenizer_path(pieces.PIECE_MODEL))
    return pieces.Encoder(v), pieces.Decoder(v)


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts(counter, word_library):
    texts = [t or "" for _, t in corpus()] + ODD
    assert counter.counts(texts).tolist() == lengths(word_library, texts)


def test_counts_in_small_chunks(word_library, monkeypatch):
    """Words longer than chunks, chunks without a word end, states cleared often."""
    monkeypatch.setattr(transducer, "CHUNK", 3)
    monkeypatch.setattr(transducer, "MAX_STATES", 50)
    monkeypatch.setattr(transducer, "BLOCK_CHARS", 40)
    own = transducer.Counter(transducer.WordModel.read(tokenizer_path(transducer.WORD_MODEL)))
    texts = ODD[:6] + ["internationalisation of the thing"] + [t or "" for _, t in corpus()[:40]]
    assert own.counts(texts).tolist() == lengths(word_library, texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(ANY, min_size=1, max_size=4))
def test_any_counts(counter, word_library, texts):
    assert counter.counts(texts).tolist() == lengths(word_library, texts)


def test_count_query(spark, word_library):
    rows = corpus(2)
    got = {r["doc_id"]: r for r in transducer.count_tokens(frame(spark, rows), tokenizer_path(transducer.WORD_MODEL)).collect()}
    want = lengths(word_library, [t or "" for _, t in rows])
    assert [got[i]["n_tokens"] for i, _ in rows] == want
    assert [got[i]["n_bytes"] for i, _ in rows] == [len((t or "").encode()) for _, t in rows]
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got.values())
    assert transducer.count_tokens(frame(spark, []), tokenizer_path(transducer.WORD_MODEL)).collect() == []


def test_pieces(codec, piece_library):
    encoder, decoder = codec
    for t in [t or "" for _, t in corpus()] + ODD:
        ids = encoder.encode(t).tolist()
        assert ids == piece_library.encode(t)
        assert decoder.decode(ids) == piece_library.decode(ids) == t


@settings(max_examples=300, deadline=None)
@given(ANY)
def test_any_pieces(codec, piece_library, text):
    encoder, decoder = codec
    ids = encoder.encode(text).tolist()
    assert ids == piece_library.encode(text)
    assert decoder.decode(ids) == piece_library.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=20))
def test_any_ids(codec, piece_library, ids):
    assert codec[1].decode(ids) == piece_library.decode(ids)


def test_stream_commits_early(codec):
    """Pieces come out while the text is still being read, in a bounded window."""
    encoder, _ = codec
    rng = random.Random(4)
    text = "".join(rng.choice(["tion", "the", "ing", "qz", "é", "日"]) for _ in range(4000))
    widest = []
    inner = encoder._meeting
    encoder._meeting = lambda last, now: widest.append(len(last)) or inner(last, now)
    out = list(encoder.stream(text))
    del encoder._meeting
    assert "".join(out) == text and len(widest) > 100 and max(widest) <= 12 * encoder.v.longest


def test_piece_query(spark, piece_library):
    rows = corpus(2)
    got = {r["doc_id"]: r for r in pieces.encode_documents(frame(spark, rows), tokenizer_path(pieces.PIECE_MODEL)).collect()}
    for i, t in rows:
        assert got[i]["ids"] == piece_library.encode(t or "") and got[i]["round_trip"] and got[i]["n_tokens"] == len(got[i]["ids"])
    assert pieces.encode_documents(frame(spark, []), tokenizer_path(pieces.PIECE_MODEL)).collect() == []


def test_words_and_parts(piece_library, monkeypatch):
    """Texts cut into short parts, words walked in the window, a store that is cleared often."""
    own = pieces.Encoder(pieces.Vocabulary.read(tokenizer_path(pieces.PIECE_MODEL)))
    for name, n in (("PART_CHARS", 12), ("WINDOW", 5), ("MAX_FITS", 30), ("MAX_WORDS", 20)):
        monkeypatch.setattr(pieces, name, n)
    texts = ODD + ["a  b   c", "▁x ▁▁ y▁", "no spaces at  the   end  ", "x" * 40, "x" * 40 + "  y"] + [(t or "")[:3000] for _, t in corpus()]
    for t in texts:
        assert own.encode(t).tolist() == piece_library.encode(t)
    ids, bounds = own.encode_all(pa.array(["left out", *texts, None])[1:-1])
    assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == piece_library.encode(texts)


def test_memory_of_a_long_text():
    """50 million characters: what a worker holds grows by the text, its ids and little else."""
    script = """
import resource
import numpy as np
from driftlens.llm import pieces
from driftlens.llm.tables import tokenizer_path
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
v = pieces.Vocabulary.read(tokenizer_path(pieces.PIECE_MODEL))
encoder, decoder = pieces.Encoder(v), pieces.Decoder(v)
words = ["".join(chr(97 + (i * k) % 26) for k in range(3, 9)) for i in range(4000)]
text = " ".join(words)
decoder.decode(encoder.encode((text + " ") * 20).tolist())
before = peak()
text = (text + " ") * (50_000_000 // (len(text) + 1))
ids = encoder.encode(text)
walked = peak()
(back,) = decoder.decode_all(ids, np.array([0, len(ids)]))
assert back.decode() == text and len(text) > 49_900_000
print((walked - before) // len(text), (peak() - before) // len(text), before // 1_000_000)
"""
    run = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=240, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert not run.stderr, run.stderr[-2000:]
    walked, decoded, before = map(int, run.stdout.split())
    assert walked <= 10 and decoded <= 24 and before < 700, (walked, decoded, before)
