import pytest

from matchloom.llm import sentencepiece as sp

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "  a", " ", "a ", "   x  y   ", "<s> hi</s>", "<0x41>", "\x00a", "日本語 🎉‍ x", "\t\n a\r\n", "▁▁ab ▁", "a" * 3000, "é" * 50 + "ﬁ", "<unk>", "The quick brown fox. " * 400]


def test_parity_with_the_library():
    c = sp.Codec(PATH, 1, 10**9)
    ids = [e.ids for e in c.tok.encode_batch_fast(TEXTS, add_special_tokens=False)]
    assert ids == c.other.encode(TEXTS)
    assert c.tok.decode_batch(ids, skip_special_tokens=False) == c.other.decode(ids)


def test_a_difference_hands_the_batch_over():
    c = sp.Codec(PATH, 1, 1)
    ids, back, backend = c.encode(TEXTS)
    assert backend == "tokenizers" and back == [x == t for x, t in zip(c.other.decode(ids), TEXTS)]

    class Broken:
        def encode_batch_fast(self, texts, add_special_tokens):
            return [type("E", (), {"ids": [1]}) for _ in texts]

        def decode_batch(self, ids, skip_special_tokens):
            return ["" for _ in ids]

    c.tok = Broken()
    ids, back, backend = c.encode(TEXTS)
    assert backend == "sentencepiece" and ids == c.other.encode(TEXTS) and back == [x == t for x, t in zip(c.other.decode(ids), TEXTS)]


def test_runs_of_blanks(docs):
    """Ties between the marker pieces' merges: every row has the library's ids, wherever it falls in its batch."""
    runs = ["x" + " " * n + "y" for n in range(1, 601)]
    texts = ["a b", *runs, *[t + " z" for t in runs], *[" " * n for n in range(1, 601)], "▁" * 16 + "y", "x ▁ " + "▁" * 30 + "y z"]
    c = sp.Codec(PATH, 1, 10**9)
    want = c.other.encode(texts)
    plain = [e.ids for e in c.tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert any(x != y for x, y in zip(plain, want))
    for _ in range(2):  # the second time by the words that are known
        ids, back, backends = c.encode_rows(texts)
        assert ids == want and back == [x == t for x, t in zip(c.other.decode(ids), texts)]
        assert backends == ["tokenizers" if x == y else "sentencepiece" for x, y in zip(plain, want)]
    for i, r in enumerate(sorted(sp.encode(docs(list(enumerate(texts))), PATH).collect(), key=lambda r: r.doc_id)):
        assert r.ids == want[i]


def test_words_prove_their_texts():
    """The ids of a text are those of its words, one by one, in both libraries."""
    import random

    c = sp.Codec(PATH, 1, 10**9)
    assert c.by_words
    rng = random.Random(4)
    parts = ["for", "x=", "\n", " ", "  ", "    ", " " * 16, "▁", "ab", "aaaa", "====", "日本", "🎉", "1234", "\t", "<s>", "é", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(3000)]
    mark = c.other.piece_to_id(sp.MARK)
    for t, want in zip(texts, c.other.encode(texts)):
        words = sp.WORDS.findall(" " + t.replace(sp.MARK, " "))
        assert want == [i for w in words for i in (c.other.encode(w[1:]) if w != " " else [mark])]
    assert c.encode_rows(texts)[0] == c.other.encode(texts)
    # every distinct word was held against the library, so the texts are, also where little is remembered
    sp_known, sp.KNOWN = sp.KNOWN, 50
    try:
        for a in range(0, 3000, 100):
            assert c.encode_rows(texts[a : a + 100])[0] == c.other.encode(texts[a : a + 100])
            assert len(c.known) < 2000
    finally:
        sp.KNOWN = sp_known


def test_whole_documents_as_the_library(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    c = sp.Codec(PATH, 2)
    ids, back, backends = c.encode_rows([t for _, t in rows])
    assert ids == c.other.encode([t for _, t in rows]) and all(back)
    assert c.tok.decode_batch(ids, skip_special_tokens=False) == [t for _, t in rows]


def test_unigram_models(tmp_path):
    """A unigram model of our own, written field by field."""
    import struct

    import sentencepiece

    def field(n, kind, value):
        key = n << 3 | kind
        if kind == 0:
            return bytes([key & 127 | 128, key >> 7, value]) if key > 127 else bytes([key, value])
        if kind == 5:
            return bytes([key]) + struct.pack("<f", value)
        return bytes([key]) + bytes([len(value)]) + value

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁ab", -4.2, 1), ("ba", -5.0, 1), ("s", -6.0, 1)]
    data = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, s) + field(3, 0, k)) for t, s, k in pieces)
    data += field(2, 2, field(3, 0, 1)) + field(3, 2, field(3, 0, 1) + field(4, 0, 1) + field(5, 0, 1))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    other = sentencepiece.SentencePieceProcessor(model_file=str(path))
    tok = sp.build(str(path))
    for text in ("ab ba", "aba  bab", " abab ", "b", "", "a b a b"):
        assert tok.encode(text, add_special_tokens=False).ids == other.encode(text), text


def unigram_of(path, place):
    """The same pieces, bytes and normaliser as a unigram model with scores like log probabilities: what is written again, wins."""
    import math
    import struct

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    data, n = b"", 0
    for number, value in sp.fields(open(path, "rb").read()):
        if number == 1:
            n += 1
            value += b"\x15" + struct.pack("<f", -3 - math.log(n + 1) * (1 + 0.001 * math.sin(n)))
        value = value + b"\x18\x01" if number == 2 else value
        data += varint(number << 3 | 2) + varint(len(value)) + value
    place.write_bytes(data)
    return str(place)


def test_a_large_unigram_model(spark, docs, tmp_path):
    """32,000 pieces with their scores and byte fallback, over whole documents, each row against the library."""
    import sentencepiece

    path = unigram_of(PATH, tmp_path / "unigram.model")
    assert sp.parse(path)["model_type"] == sp.UNIGRAM
    rows = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + TEXTS
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(sp.encode(docs(list(enumerate(rows))), path).collect(), key=lambda r: r.doc_id)
    assert [r.ids for r in got] == other.encode(rows)
    assert [r.round_trip for r in got] == [x == t for x, t in zip(other.decode([r.ids for r in got]), rows)]
    assert sum(r.backend == "tokenizers" for r in got) >= 0.95 * len(rows)


def test_rows(docs, clashing):
    rows = list(enumerate(TEXTS)) + [(100, None), (None, "x y"), (3, "a ")]
    got = sp.encode(docs(rows), PATH, verify_every=2).collect()
    assert len(got) == len(rows) and all(r.backend == "tokenizers" for r in got)
    # a marker in the text itself comes back as a blank, from the library too
    assert {r.doc_id for r in got if not r.round_trip} == {TEXTS.index("▁▁ab ▁")}
    back = {r.doc_id: r.text for r in sp.decode(sp.encode(docs(rows), PATH), PATH).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in rows}
    assert sp.encode(docs([]), PATH).count() == 0 and sp.encode(clashing, PATH, with_ids=False, keep=["id", "n"]).count() == 4
