"""op1, op8: round trips and the tokenizers library itself as brute force."""

import hashlib
import json
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioflow.llm import bpe, pfor
from folioflow.llm.common import tokenizer_json

ODD = [
    "", " ", "  \n\n a  b", "ÀÉ İ ß Σς ﬁ ①²", "<|endoftext|>hello <|endoftext|> x<|startoftext|>", "a\x1cb\x85c　d", "a" * 3000, "'s don't we'll I'VE",
    "日本語テキスト 123 ١٢٣ ½", "́ á é", "😀😀 👨‍👩‍👧", "\t\t x\r\n\x0b\x0c y", "hello<|endoftext|", "\0<|endoftext|>", "\0a \0\0", "word, word. (word)\nWord;", "x.,;y , ,", "é.a.1,2!b's ,x. \n", "a" * 70 + ". " + "b" * 65,
]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("high", [1, 2, 50_000, 2**32 - 1])
def test_blocks_round_trip(n, high):
    rng = np.random.default_rng(n + high)
    ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    if n > 100:
        ids[rng.integers(0, n, 20)] = 2**32 - 1  # outliers become exceptions
    part, before, docs, lengths, back = pfor.read_file(pfor.file_bytes(3, 7, np.arange(4), np.arange(4), ids))
    assert (part, before) == (3, 7) and (back == ids).all() and (docs == np.arange(4)).all() and (lengths == np.arange(4)).all()


def test_exceptions_keep_blocks_narrow():
    ids = np.full(128 * 50, 5, dtype=np.uint32)
    ids[::40] = 40_000
    assert len(pfor.pack(ids)[1]) < len(ids)


SPEC = {n: open(tokenizer_json(n), encoding="utf-8").read() for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


@pytest.fixture(scope="module")
def codecs():
    spec = SPEC
    return {
        "word": (pfor.ChunkEncoder(spec["word_bpe_49k.json"]), Tokenizer.from_str(spec["word_bpe_49k.json"])),
        "byte": (bpe.ByteBpe(spec["byte_bpe_50k.json"]), Tokenizer.from_str(spec["byte_bpe_50k.json"])),
    }


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_ids_are_the_librarys(codecs, kind):
    own, library = codecs[kind]
    for got, want in zip(own.encode(ODD), library.encode_batch(ODD, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == want.ids


def test_any_text(codecs):
    @settings(max_examples=200, deadline=None)
    @given(st.text(max_size=60))
    def check(text):
        for own, library in codecs.values():
            assert np.frombuffer(own.encode([text])[0], dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids

    check()


def test_small_caches_change_nothing(codecs, monkeypatch):
    monkeypatch.setattr(pfor, "CACHE", 3)
    own, library = codecs["word"]
    for t in ["one two three four", "two three five", "one six"] * 3:
        assert own.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_small_caches_of_words_change_nothing(codecs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 6)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 2)
    own, library = bpe.ByteBpe(SPEC["byte_bpe_50k.json"]), codecs["byte"][1]
    rng = random.Random(6)
    for _ in range(30):
        texts = [" ".join(rng.choice("one two three four five <|endoftext|> six seven".split()) for _ in range(rng.randint(0, 9))) for _ in range(3)]
        for got, want in zip(own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, dtype="<u4").tolist() == want.ids


def test_equal_hashes_change_nothing(codecs, monkeypatch):
    """Chunks with one hash are told apart by their bytes."""
    own, library = pfor.ChunkEncoder(SPEC["word_bpe_49k.json"]), codecs["word"][1]
    monkeypatch.setattr(pfor.ChunkEncoder, "_hashes", lambda self, raw, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = ["one two three four eleven internationalization", "six ten abc, internationalisation two", "one ten; xyzxyzxy xyzxyzxz"] * 2
    for got, want in zip(own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_long_words(codecs):
    """Places by rank give the same ids as rounds over the whole word, and a long word takes seconds."""
    own, library = codecs["byte"]
    rng = random.Random(5)
    for alphabet in ("ab", "aetionsrhl", "abcdefghijklmnopqrstuvwxyz", "aé日"):
        for n in (257, 900, 4000):
            word = "".join(rng.choice(alphabet) for _ in range(n))
            assert own.merge_long(word.encode()).tolist() == library.encode(word, add_special_tokens=False).ids
    began = time.time()
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    ids = own.encode([word])[0]
    assert own.decode(ids) == word and time.time() - began < 60


def test_vocabularies_with_merges_out_of_order_are_refused(codecs):
    d = json.loads(SPEC["byte_bpe_50k.json"])
    d["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        bpe.ByteBpe(json.dumps(d))


ROWS = [(5, "Hello world"), (1, None), (3, ""), (3, "three again"), (9, "x" * 500), (7, "Hello world"), (5, "Hello world"), (None, "no id"), (11, "w" * 9_000 + " " + "xyz" * 5_000 + ", " + "long text. " * 300_000)]


def test_token_files(spark, codecs):
    docs = spark.createDataFrame([(*r, "extra") for r in ROWS], "doc_id long, text string, start string")
    got = [tuple(r) for r in pfor.tokenize(docs, tokenizer_json("word_bpe_49k.json")).orderBy("start").collect()]
    library = codecs["word"][1]
    at = 0
    assert [r[0] for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    left = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in ROWS]
    for doc, start, n, crc in got:
        assert start == at
        at += n
        left.remove(next(x for x in left if x[0] == doc and len(x[1]) == n and zlib.crc32(np.array(x[1], dtype="<u4").tobytes()) == crc))
    assert not left


def test_encode_and_decode(spark, codecs):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows = bpe.encode_and_decode(docs, tokenizer_json("byte_bpe_50k.json")).collect()
    library = codecs["byte"][1]
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pfor.tokenize(none, tokenizer_json("word_bpe_49k.json")).count() == 0
    assert bpe.encode_and_decode(none, tokenizer_json("byte_bpe_50k.json")).count() == 0
