import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import bpe
from linkloom.llm.queries import tokenizer

RANKS = tokenizer("byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file here")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefg  \n\t's12。，的是我们éß\x1c　👩🏽"), max_size=300), st.integers(1, 40))
def test_cut_and_glue_are_exact(text, size):
    enc = bpe.encoder(RANKS)
    assert bpe.encode_text(enc, text, size) == enc.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["aeinrstlo" * 9, "的一不是我们" * 12, "12345" * 11, " " * 37, "'s", "'", "don't", "!?.," * 15, "\n\n", " x", "\u3000", "é́" * 9, "👩🏽‍🚀" * 5, "\x1c"]), max_size=9), st.integers(1, 90), st.sampled_from([1, 8, 60]))
def test_runs_without_a_sure_place_are_exact(pieces, size, window):
    enc, text = bpe.encoder(RANKS), "".join(pieces)
    held, bpe.WINDOW = bpe.WINDOW, window
    try:
        assert bpe.encode_text(enc, text, size) == enc.encode_ordinary(text)
    finally:
        bpe.WINDOW = held


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aeinrstlot的一不", max_size=30), min_size=1, max_size=9))
def test_tree_of_unsplit_blocks(blocks):
    enc = bpe.encoder(RANKS)
    whole = bpe.encode_piece(enc, "".join(blocks).encode())
    out = []
    for block in blocks:
        out = bpe.glue(enc, out, bpe.encode_piece(enc, block.encode()))
    assert out == whole


def test_joins_encode_again_around_the_cut(monkeypatch):
    """Long texts of the corpus' kinds are joined at cuts inside words and inside unsplit stretches alike."""
    enc, glued, joined = bpe.encoder(RANKS), [], []
    glue, join = bpe.glue, bpe.join
    monkeypatch.setattr(bpe, "glue", lambda *a: glued.append(1) or glue(*a))
    monkeypatch.setattr(bpe, "join", lambda *a: joined.append(1) or join(*a))
    prose = "The helper carried box 17 up the stairs, didn't she? " * 200
    assert bpe.encode_text(enc, prose, 1024) == enc.encode_ordinary(prose) and len(joined) == -(-len(prose) // 1024) - 1 and not glued
    run = "箱子里有几件东西没人知道" * 500
    assert bpe.encode_text(enc, run, 1024) == enc.encode_ordinary(run) and len(glued) == -(-len(run) // 1024) - 1


@pytest.mark.parametrize("fan", [2, 32])
def test_corpus(spark, fan):
    enc = bpe.encoder(RANKS)
    texts = [None, "", " ", "a", "<|endoftext|> is text", "长" * 9000, "word " * 3000, "x" * 7000 + "  \n " + "y" * 5000, "long" * 1500, "long" * 1500, " " * 6000]
    rows = [(k if k != 9 else 8, t, 1, 1) for k, t in enumerate(texts)]
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, k int, n int"), "doc_id", "text", RANKS, fan=fan).collect())
    assert got == sorted((d, enc.encode_ordinary(t) if t else []) for d, t, _, _ in rows)
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", RANKS).count() == 0
