"""Token counts of whole texts, with overlap resynchronisation for huge documents.

Texts of more than ``chunk`` characters are cut into chunks that overlap; both
sides of a cut are encoded with offsets and joined where both place the start of
a pre-token (the unit that the merge rules never cross) at the same character.
A pre-token's end depends on the text up to two characters past it only, and
what follows a start depends on nothing before it, so such a common start, away
from the left side's end, holds in the encoding of the whole text too.  Where an
overlap has none, it is doubled, in the end to the rest of the text.

Texts up to ``chunk`` characters are one chunk.  For the byte-level split by the
usual pattern, a text of ``PLAIN`` characters, whose classes no version of
Unicode disputes, is split here; each distinct pre-token is encoded by the
library once a process as long as it is remembered, and a text has as many
tokens as its pre-tokens: split by itself, a pre-token is itself again.  All
other texts, and those that hold a special string, are encoded whole.

Null and empty texts have 0 bytes and 0 tokens.  An empty table gives an empty
result; repeated rows and ids are counted each for itself; very long texts are
the chunks' case; there are no ties.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rowwise

CHUNK = 32_768
OVERLAP = 512
#: Characters before a left chunk's end in which its pre-tokens may still change; longer than any special string.
MARGIN = 64
#: Characters of texts that are encoded in one batch.
BATCH = 1 << 20
#: Pre-tokens that a process remembers, and their greatest length.
KNOWN, KNOWN_CHARS = 300_000, 48

# Letters, numbers and blanks among the characters of PLAIN texts.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u0527"
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
BLANKS = "\t-\r \u0085\u00a0"
PLAIN = re.compile("[\0-\u024f\u0400-\u0481\u048a-\u0527\u2010-\u2027]*")
#: The split of byte-level models, for PLAIN texts.
SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?(?:[{LETTERS}]+|[{NUMBERS}]+|[^{BLANKS}{LETTERS}{NUMBERS}]+)|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")

_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, once per process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def _starts(enc, base: int, low: int, high: int) -> dict[int, int]:
    """Characters of the whole text, from ``low`` up to ``high``, at which a pre-token starts, to its first token's index."""
    n = len(enc.ids)
    first = n
    while first > 0 and base + enc.token_to_chars(first - 1)[1] > low:
        first -= 1
        if base + enc.token_to_chars(first)[0] > high and (jump := enc.char_to_token(high - base)) is not None:
            first = min(first, jump + 1)
    out: dict[int, int] = {}
    for i in range(first, n):
        a, _ = enc.token_to_chars(i)
        if base + a > high:
            break
        word = enc.token_to_word(i)
        if i == 0 or ((word is None or word != enc.token_to_word(i - 1)) and a >= enc.token_to_chars(i - 1)[1]):
            if base + a >= low:
                out.setdefault(base + a, i)  # a start inside the character before it is none
    return out


def count_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, encoded by chunks."""
    n, at, total = len(text), 0, 0
    left = tok.encode(text[:chunk], add_special_tokens=False)
    end = min(chunk, n)
    skip = sure = 0  # the tokens of ``left`` that are counted already, and the character where the others start
    while end < n:
        wide = overlap
        while True:
            begin = max(at, end - wide)
            stop = min(n, begin + max(chunk, 2 * wide))
            right = tok.encode(text[begin:stop], add_special_tokens=False)
            left_starts, right_starts = (_starts(e, base, begin + 1, end - MARGIN) for e, base in ((left, at), (right, begin)))
            common = [c for c in left_starts if c in right_starts and left_starts[c] >= skip]
            if common and stop > end:
                sure = max(common)
                total += left_starts[sure] - skip
                left, skip, at, end = right, right_starts[sure], begin, stop
                break
            if begin == at:  # widened to all that is left: encode from the last sure start on
                return total + len(tok.encode(text[sure:], add_special_tokens=False))
            wide *= 2
    return total + len(left) - skip


class Counter:
    """Token counts of texts by one tokenizer file."""

    def __init__(self, path: str, chunk: int, overlap: int):
        self.tok, self.chunk, self.overlap = tokenizer(path), chunk, overlap
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made["pre_tokenizer"] or {}
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.by_words = usual and made["normalizer"] is None and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
        special = [re.escape(t["content"]) for t in made.get("added_tokens") or []]
        self.special = re.compile("|".join(special)) if special else None
        self.known: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, texts: list[str]) -> list[int]:
        words = [SPLIT.findall(t) for t in texts]
        new = list(set(chain.from_iterable(words)) - self.known.keys())
        rare = dict(zip(new, self._whole(new)))
        self.known.update(rare)
        out = [sum(map(self.known.__getitem__, w)) for w in words]
        for w in rare:
            if len(w) > KNOWN_CHARS:
                del self.known[w]
        if len(self.known) > KNOWN:
            self.known.clear()
        return out

    def __call__(self, texts: list) -> list[list[int]]:
        counts = [0] * len(texts)
        held: dict[bool, list[int]] = {True: [], False: []}
        size = 0

        def flush():
            for plain, at in held.items():
                for i, n in zip(at, (self._plain if plain else self._whole)([texts[i] for i in at]) if at else []):
                    counts[i] = n
                at.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > self.chunk:
                counts[i] = count_long(self.tok, t, self.chunk, self.overlap)
                continue
            held[self.by_words and PLAIN.fullmatch(t) is not None and not (self.special and self.special.search(t))].append(i)
            size += len(t)
            if size > BATCH:
                flush()
                size = 0
        flush()
        return [counts]


_counters: dict = {}


def counter(*key) -> Counter:
    """One counter a process, whose memory outlives a task."""
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path`` is the tokenizer's file, the same place on every machine.  No
    shuffle; rows with the same id or text are counted each for itself.
    """
    if overlap <= 2 * MARGIN or chunk <= 2 * overlap:
        raise ValueError("chunk must exceed 2 * overlap, and overlap 2 * MARGIN")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = rowwise(rows, ["text"], lambda: counter(path, chunk, overlap), "n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
