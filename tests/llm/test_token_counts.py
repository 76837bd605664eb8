import random

import pytest
from helpers import corpus, frame

P = pytest.importorskip("public_tokenizers")
from tidewake.llm import token_counts as t  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
PARTS = ["a", "the ", "  ", "\n", "'re", "'", "s", "9", " ", "é", "漢", "<|endoftext|>", "<|endof", "!?", "😀", "x" * 70, "   \n  ", "\u3000", "Ünïcödé"]


def test_splices_equal_the_library():
    e, rng = t.Encoder(PATH), random.Random(1)
    for _ in range(1500):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 120)))
        want = len(e.library.encode(s, add_special_tokens=False).ids)
        assert t.count_tokens(s, e, rng.choice([80, 100, 150]), rng.choice([40, 48, 64])) == want, s


def test_one_piece_longer_than_every_overlap():
    e = t.Encoder(PATH)
    for s in ("x" * 1000, " " * 1000, "x" * 500 + " y" * 300, "a " * 50 + "9" * 700 + " b"):
        assert t.count_tokens(s, e, 80, 40) == len(e.library.encode(s, add_special_tokens=False).ids)


def test_fast_encoder_has_the_files_vocabulary():
    e = t.Encoder(PATH)
    assert e.fast is not None
    for r in corpus():
        assert e.count(r[1] or "") == len(e.library.encode(r[1] or "", add_special_tokens=False).ids)


def test_rows(spark):
    e = t.Encoder(PATH)
    got = sorted(map(tuple, t.token_counts(frame(spark), PATH, limit=20, chunk=2000, overlap=64).collect()))
    want = sorted((r[0], len((r[1] or "").encode()), n := len(e.library.encode(r[1] or "", add_special_tokens=False).ids), n > 20) for r in corpus())
    assert got == want and t.token_counts(frame(spark, []), PATH).count() == 0


def test_other_tokenizer_files():
    e = t.Encoder(P.path("word_bpe_49k.json"))
    assert not e.by_pieces and e.count("Hello there, world") == len(e.library.encode("Hello there, world", add_special_tokens=False).ids)
