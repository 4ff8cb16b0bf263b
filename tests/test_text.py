import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import measures, similarity, text

CASES = {"NA": "na", "  \t ": "", "  ÉCOLE   Café ": "école café", "ＡＢＣ": "abc", "వ్యాపారం": "వ్యాపారం", "NULL": "null", "Straße": "strasse", "ﬁn\x1c\x85x": "fin x"}


def test_normalisation_cases(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "x string")
    found = {r.x: r.y for r in rows.select("x", text.normalize_text("x").alias("y")).collect()}
    assert found == CASES


@given(st.text())
def test_normalising_twice_changes_no_words(value):
    once = text.normalize(value)
    assert text.normalize(once).split() == text.normalize(text.normalize(once)).split()
    assert once == once.strip() and "  " not in once


def test_null_stays_null(spark):
    assert spark.createDataFrame([(None,)], "x string").select(text.normalize_text("x")).first()[0] is None


def test_tokens_keep_marks(spark):
    rows = spark.createDataFrame([('école "or" (cafe*)',), ("వ్యాపారం చంద్ర",), ("b a b",)], "x string")
    got = [r[0] for r in rows.select(text.word_tokens(F.col("x"))).collect()]
    assert got == [["cafe", "or", "école"], ["చంద్ర", "వ్యాపారం"], ["a", "b"]]
    assert rows.select(text.word_occurrences(F.col("x"))).collect()[2][0] == ["b", "a", "b"]


def test_blanks(spark):
    rows = spark.createDataFrame([("",), (" \t　\x1f",), ("NA",), ("​",)], "x string")
    assert [r[0] for r in rows.select(text.is_blank(F.col("x"))).collect()] == [True, True, False, False]


def grams(value, low, high):
    out = []
    for word in value.split():
        word = f" {word} "
        for n in range(low, high + 1):
            out += [word[i : i + n] for i in range(max(1, len(word) - n + 1))]
            if len(word) <= n:
                break
    return out


def test_character_grams(spark):
    values = ["", "a", "ab cde", "abcdef  x", "é"]
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    for low, high in ((2, 4), (3, 3)):
        got = {r.x: sorted(r.g) for r in rows.select("x", text.char_grams(F.col("x"), low, high).alias("g")).collect()}
        assert got == {v: sorted(grams(v, low, high)) for v in values}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(st.text("abc é", max_size=30), st.text("abc é", max_size=80))
def test_indel_is_the_subsequence_ratio(a, b):
    expected = 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b))
    assert similarity.indel(a, b) == pytest.approx(expected)


def test_both_ratios_agree(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choices("ab ", k=rng.randrange(7))), "".join(rng.choices("ab ", k=rng.randrange(9)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(similarity.indel_ratio("a", "b").alias("x"), similarity.indel_ratio_sql(F.col("a"), F.col("b")).alias("y")).collect()
    assert all(r.x == pytest.approx(r.y) for r in got)


def test_token_sort_and_guard(spark):
    df = spark.createDataFrame([("b a", "a b"), ("", "a"), ("ab", "ac")], "a string, b string")
    got = df.select(similarity.guarded(F.col("a"), F.col("b"), similarity.token_sort_ratio(F.col("a"), F.col("b"))).alias("x")).collect()
    assert [r.x for r in got] == [1.0, 0.0, 0.5]


def test_f05_cases(spark):
    cases = [(0, 0, 0, 1.0), (0, 0, 1, 0.0), (0, 1, 0, 0.0), (2, 2, 2, 1.0), (1, 2, 1, 5 / 6), (2, 2, 3, 5 / 7), (1, 2, 2, 0.5)]
    df = spark.createDataFrame(cases, "tp int, t int, c int, want double")
    assert all(r.got == pytest.approx(r.want) for r in df.select("want", measures.f05(F.col("tp"), F.col("t"), F.col("c")).alias("got")).collect())


def test_hash_rank(spark):
    df = spark.createDataFrame([("S1-é",)], "k string")
    assert df.select(measures.hash_rank(F.col("k"), 42)).first()[0] == hashlib.sha256("42\0S1-é".encode()).hexdigest()[:32]


def test_short_numbers_hashes_and_sql(spark):
    import json

    from matchloom.functions import registry

    values = [0.1, 1 / 3, 1e-9, 100.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(measures.short_number("x")).collect()] == [None if v is None else f"{v:.12g}" for v in values]
    df = spark.createDataFrame([("S1-a", 'É "q"')], "a string, b string")
    want = hashlib.sha256(json.dumps(["S1-a", 'É "q"'], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert df.select(measures.record_hash("a", "b")).first()[0] == want
    assert registry.register(spark) == ["normalize_text", "indel_ratio", "short_number"]
    assert tuple(spark.sql("SELECT normalize_text(' A  b'), indel_ratio('AB', 'AC'), short_number(0.25D)").first()) == ("a b", 0.5, "0.25")
