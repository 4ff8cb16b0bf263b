"""SentencePiece models run by the tokenizers library.

``parse`` reads the model's protobuf by hand; ``build`` makes a tokenizer of the
same normaliser, white space marker, pieces, scores and byte fallback: a unigram
model of the pieces' log probabilities, or, for a BPE model, merges ranked by
the score of what they make.  Batches are encoded by several threads.

Parity: every row is held against the reference library.  In a BPE model with
all byte pieces, no normalisation and no piece that holds a marker behind
another character, no merge crosses the start of a run of blanks, so a text's
ids are those of its words, a run of blanks and what follows it, in both
libraries.  There, each distinct word is encoded by both, in batches, once a
process as long as it is remembered, and a text's ids are put together from its
words'.  For any other model, unigram ones among them, each row is encoded by
both, and so is every ``verify_every``-th row in any case.  Rows that differ or
hold a word that does (the libraries break ties of equal scores in their own
ways, as in long runs of blanks) get the reference library's ids and say
``backend = 'sentencepiece'``.  Every other row says 'tokenizers'.

Null and empty texts have no tokens and decode to the empty text; an empty table
gives an empty result; texts of any length are encoded whole; repeated rows and
ids are encoded each for itself; scores that tie are settled by the reference
library, as above.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rowwise

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A run of blanks and what follows it.
WORDS = re.compile(" +[^ ]*")
#: Words that a process remembers, and their greatest length; others are encoded again.
KNOWN, KNOWN_CHARS = 300_000, 64
#: Words that are encoded as one text.
TOGETHER = 2000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def fields(data: bytes):
    """Yield (field number, value) of a protobuf message: int, 4 or 8 raw bytes, or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"protobuf wire type {kind}")
        yield key >> 3, value


def parse(path: str) -> dict:
    """Pieces as (text, score, type), and the settings that encoding needs."""
    with open(path, "rb") as f:
        data = f.read()
    model = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True, "suffix_mark": False}
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    text = v.decode("utf-8")
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            model["pieces"].append((text, score, kind))
        elif number == 2:
            names = {3: "model_type", 24: "suffix_mark", 35: "byte_fallback"}
            model |= {names[n]: v for n, v in fields(value) if n in names}
        elif number == 3:
            names = {2: "charsmap", 3: "dummy_prefix", 4: "squeeze", 5: "escape"}
            model |= {names[n]: v for n, v in fields(value) if n in names}
    if model["model_type"] not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model['model_type']} is not supported")
    if model["suffix_mark"]:
        raise ValueError("models that mark white space at a word's end are not supported")
    return model


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    whole = {t: s for t, s, kind in pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = [(-whole[t], i, t[:i], t[i:]) for t in whole for i in range(1, len(t)) if t[:i] in whole and t[i:] in whole]
    return [(a, b) for _, _, a, b in sorted(found, key=lambda x: x[:2])]


def build(path: str):
    """A tokenizer of the model in ``path``."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse(path)
    pieces = m["pieces"]
    unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    if m["model_type"] == UNIGRAM:
        # reserved pieces are never taken from a text
        scored = [(t if kind in (NORMAL, USER_DEFINED, BYTE, UNKNOWN) else "\ufdd0" + t, s) for t, s, kind in pieces]
        tok = Tokenizer(models.Unigram(scored, unknown, bool(m["byte_fallback"])))
    else:
        tok = Tokenizer(models.BPE({t: i for i, (t, _, _) in enumerate(pieces)}, _merges(pieces), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=bool(m["byte_fallback"])))
    steps: list = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["squeeze"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Replace(" ", MARK)] if m["escape"] else []
    if m["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK if m["escape"] else " "))
    tok.normalizer = normalizers.Sequence(steps)
    # no piece holds a marker behind another character: then no merge crosses the start of a run of markers
    if m["escape"] and not any(MARK in t.lstrip(MARK) for t, _, kind in pieces if kind in (NORMAL, USER_DEFINED)):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    if own := [t for t, _, kind in pieces if kind == USER_DEFINED]:
        tok.add_tokens([AddedToken(t, normalized=True) for t in own])
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m["dummy_prefix"] else [])])
    return tok


class Codec:
    """Encodes and decodes batches, held against the reference library."""

    def __init__(self, path: str, threads: int = 2, verify_every: int = 64):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece

        self.tok, self.every, self.threads = build(path), verify_every, threads
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        m = parse(path)
        kinds = {NORMAL: lambda t: t.replace(MARK, " ").encode(), USER_DEFINED: str.encode, BYTE: lambda t: bytes((int(t[3:5], 16),))}
        self.bytes = [kinds[k](t) if k in kinds else b"" for t, _, k in m["pieces"]]
        own = {k for _, _, k in m["pieces"]}
        self.by_words = (
            m["model_type"] == BPE and m["dummy_prefix"] and m["escape"] and m["byte_fallback"] and not m["charsmap"] and not m["squeeze"] and USER_DEFINED not in own
            and UNUSED not in own and sum(k == BYTE for _, _, k in m["pieces"]) == 256 and (MARK, NORMAL) in {(t, k) for t, _, k in m["pieces"]}
            and not any(MARK in t.lstrip(MARK) for t, _, k in m["pieces"] if k == NORMAL)
        )
        mark = next((i for i, (t, _, k) in enumerate(m["pieces"]) if t == MARK and k == NORMAL), 0)
        self.starts = np.array([k == NORMAL and t.startswith(MARK) for t, _, k in m["pieces"]])
        self.blank = np.array([k == NORMAL and not t.strip(MARK) for t, _, k in m["pieces"]])
        #: Words to their ids, as 32-bit little-endian numbers; words that the libraries encode in different ways; words whose ids' bytes are not theirs.
        self.known: dict[str, bytes] = {" ": struct.pack("<i", mark)}
        self.odd: set[str] = set()
        self.unsure: set[str] = set()

    def _learn(self, words: list[str]) -> None:
        """Encode words by both libraries: many as one text, and those of a text on which they differ one by one."""
        some = [w for w in words if w[-1] != " "]  # a run of blanks alone would join the next word's
        for a in range(0, len(some), TOGETHER):
            part = some[a : a + TOGETHER]
            # the prefix stands for the first blank
            joined = "".join(part)
            ids = self.tok.encode_batch_fast([joined[1:]], add_special_tokens=False)[0].ids
            packed = np.asarray(ids, "<i4")
            # a word begins with a marker that no marker stands before
            cut = np.flatnonzero(self.starts[packed] & ~np.concatenate([[False], self.blank[packed[:-1]]]))
            known = len(cut) == len(part) and ids == self.other.encode(joined[1:])
            if not known or b"".join([self.bytes[i] for i in ids]) != joined.encode("utf-8", "replace"):
                self._learn_each(part)
                continue
            raw = packed.tobytes()
            ends = [*(4 * cut[1:]).tolist(), len(raw)]
            self.known.update(zip(part, [raw[x:y] for x, y in zip([0, *ends], ends)]))
        self._learn_each([w for w in words if w[-1] == " "])

    def _learn_each(self, words: list[str]) -> None:
        rest = [w[1:] for w in words]
        mine = [e.ids for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
        for w, x, y in zip(words, mine, self.other.encode(rest, num_threads=self.threads)):
            self.known[w] = struct.pack(f"<{len(x)}i", *x)
            if x != y:
                self.odd.add(w)
            elif b"".join([self.bytes[i] for i in x]) != w.encode("utf-8", "replace"):
                self.unsure.add(w)

    def _forget(self, words: list[str]) -> None:
        """Keep no long words, and not too many."""
        if len(self.known) > KNOWN:
            self.known = {" ": self.known[" "]}
            self.odd.clear()
            self.unsure.clear()
        for w in words:
            if len(w) > KNOWN_CHARS and self.known.pop(w, None) is not None:
                self.odd.discard(w)
                self.unsure.discard(w)

    def _by_words(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """Ids of a batch, whether they surely decode to their text, and whether they must be held against the other library."""
        words = [WORDS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        seen = set(chain.from_iterable(words))
        new = list(seen - self.known.keys())
        self._learn(new)
        odd, unsure = self.odd & seen, self.unsure & seen
        ids = [b"".join(map(self.known.__getitem__, w)) for w in words]
        # a marker of the text itself comes back as a blank
        sure = [MARK not in t and (not unsure or unsure.isdisjoint(w)) for t, w in zip(texts, words)]
        held = [bool(odd) and not odd.isdisjoint(w) for w in words]
        self._forget(new)
        return ids, sure, held

    def encode_packed(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[str]]:
        """Ids of a batch (32-bit little-endian), whether they decode to their text, and the library each row's come from."""
        pack = lambda x: struct.pack(f"<{len(x)}i", *x)
        if self.by_words:
            ids, back, held = self._by_words(texts)
        else:
            ids = [pack(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            back, held = [False] * len(texts), [True] * len(texts)
        check = [i for i, h in enumerate(held) if h or i % self.every == 0]
        true = [pack(x) for x in self.other.encode([texts[i] for i in check], num_threads=self.threads)]
        backends = ["tokenizers"] * len(texts)
        for i, x in zip(check, true):
            if ids[i] != x:
                ids[i], back[i], backends[i] = x, False, "sentencepiece"
        unpack = lambda x: list(struct.unpack(f"<{len(x) // 4}i", x))
        for name, decode in (("tokenizers", lambda x: self.tok.decode_batch(x, skip_special_tokens=False)), ("sentencepiece", lambda x: self.other.decode(x, num_threads=self.threads))):
            open_ = [i for i, b in enumerate(back) if not b and backends[i] == name]
            for i, x in zip(open_, decode([unpack(ids[i]) for i in open_]) if open_ else []):
                back[i] = x == texts[i]
        return ids, back, backends

    def encode_rows(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[str]]:
        """``encode_packed`` with lists of ids."""
        ids, back, backends = self.encode_packed(texts)
        return [list(struct.unpack(f"<{len(x) // 4}i", x)) for x in ids], back, backends

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool], str]:
        """``encode_rows`` with one name for the batch: 'sentencepiece' where any row's ids are that library's."""
        ids, back, backends = self.encode_rows(texts)
        return ids, back, min(backends, default="tokenizers")


_codecs: dict = {}


def codec(path: str, threads: int, verify_every: int) -> Codec:
    key = path, threads, verify_every
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, verify_every: int = 64, batch: int = 256, with_ids: bool = True, keep=()) -> DataFrame:
    """Per row: the id, ``keep`` columns, ``n_tokens``, ``ids`` (if asked for), ``ids_sha256`` (32-bit little-endian ids), ``round_trip`` (the decoded text is the text) and ``backend``."""
    rows = docs.select(F.col(id_col).alias("__id"), *[F.col(c) for c in keep if c != id_col], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def make():
        c = codec(path, threads, verify_every)

        def fn(texts):
            out: list[list] = [[] for _ in range(4 + with_ids)]
            for a in range(0, len(texts), batch):
                part = texts[a : a + batch]
                ids, back, backends = c.encode_packed(part)
                new = [[len(x) // 4 for x in ids], *([[np.frombuffer(x, "<i4") for x in ids]] if with_ids else []), [hashlib.sha256(x).hexdigest() for x in ids], back, backends]
                for column, values in zip(out, new):
                    column += values
            return out

        return fn

    return rowwise(rows, ["__text"], make, f"n_tokens long, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, round_trip boolean, backend string").withColumnRenamed("__id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id and ``text``, the decoded ids; null ids decode to the empty text."""
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def make():
        tok = codec(path, 1, 64).tok
        return lambda ids: [tok.decode_batch([x or [] for x in ids], skip_special_tokens=False)]

    return rowwise(rows, ["ids"], make, "text string").withColumnRenamed("id", id_col)
