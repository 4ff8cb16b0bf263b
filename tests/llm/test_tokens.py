import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(text):
    return len(tokens.tokenizer(PATH).encode(text or "", add_special_tokens=False))


PIECES = ["plain words here", "\n\n   ", "<|endoftext|>", "  it's 12,5 ", " " * 90, "x" * 700, "日本語 é🎉", "\t\r\n", "a.b!!", "don't 'LL"]


@pytest.mark.parametrize("seed", range(6))
def test_chunks_count_as_the_whole(seed):
    rng = random.Random(seed)
    for _ in range(40):
        text = "".join(rng.choices(PIECES, k=rng.randrange(30, 120)))
        chunk, overlap = rng.choice([(400, 160), (700, 160), (1500, 300)])
        assert tokens.count_long(tokens.tokenizer(PATH), text, chunk, overlap) == library(text)


def test_no_boundary_widens_to_the_whole():
    for text in ("x" * 5000, " " * 5000, "é" * 3001 + " end"):
        assert tokens.count_long(tokens.tokenizer(PATH), text, 400, 160) == library(text)


@given(st.lists(st.one_of(st.sampled_from(["'s", "'LL", " ", "\n", "\x1c", "\x85", "\xa0", "²", "ª", "‘", "Ё", "1", "don't"]), st.characters(max_codepoint=0x527), st.characters()), max_size=40).map("".join))
@settings(max_examples=600, deadline=None)
def test_pre_tokens_count_as_the_whole(text):
    assert tokens.counter(PATH, tokens.CHUNK, tokens.OVERLAP)([text]) == [[library(text)]]


def test_every_plain_character():
    plain = [chr(c) for c in range(0x2030) if tokens.PLAIN.fullmatch(chr(c))]
    texts = [form.format(c) for c in plain for form in ("a{0}b 1{0}2 .{0}!", " {0} {0}{0}\n{0}")]
    assert tokens.counter(PATH, tokens.CHUNK, tokens.OVERLAP)(texts) == [[library(t) for t in texts]]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_splits_are_left_to_the_library(name):
    path = public_tokenizers.path(name)
    texts = ["Don't  stop <|endoftext|> now", "x" * 100, None, ""]
    assert not tokens.counter(path, 1000, 200).by_words
    assert tokens.counter(path, 1000, 200)(texts) == [[len(tokens.tokenizer(path).encode(t or "", add_special_tokens=False)) for t in texts]]


def test_rows(docs, clashing):
    rows = [(1, "under the MIT license"), (2, None), (3, ""), (1, "again"), (None, "ß 🎉"), (2**60 + 1, "word " * 600), (7, "long text, " * 9000)]
    got = sorted(map(tuple, tokens.token_counts(docs(rows), PATH).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), library(t), library(t) > 512) for d, t in rows), key=str)
    assert tokens.token_counts(docs([]), PATH).count() == 0
    assert tokens.token_counts(clashing, PATH).count() == 4
    with pytest.raises(ValueError):
        tokens.token_counts(docs(rows), PATH, chunk=100, overlap=100)
