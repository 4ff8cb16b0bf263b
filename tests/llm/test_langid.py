import random
import zlib

import numpy as np

from matchloom.llm import langid

SOUNDS = {"aa": ["ba", "lo", "mi", "tu", "re"], "bb": ["sch", "ung", "ät", "kei", "ver"], "cc": ["qué", "ño", "ión", "lla", "os"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        words = ["".join(rng.choices(SOUNDS[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(15, 90))]
        rows.append((i, " ".join(words), lang))
    return rows


SCHEMA = "doc_id long, text string, lang string"


def test_gradients():
    rng = np.random.default_rng(0)
    p = {"x": rng.normal(0, 0.5, (2, 256, 9)), "u": rng.normal(0, 0.5, (2, 3, 9)), "v": rng.normal(0, 0.5, (2, 3, 2)), "c": rng.normal(0, 0.5, 2)}
    s = rng.integers(97, 101, (4, 6)).astype(np.uint8)
    mask = np.ones((6, 4), bool)
    mask[4:, 1] = False
    y = np.array([0, 1, 1, 0])
    steps = np.stack([s.T, s.T[::-1]])
    p = {k: a.astype(np.float32) for k, a in p.items()}
    _, g = langid._gradients(p, steps, y, mask)
    for k in p:
        for at in [tuple(rng.integers(0, n) for n in p[k].shape) if k != "x" else (int(rng.integers(0, 2)), int(rng.integers(97, 101)), int(rng.integers(0, 9))) for _ in range(6)]:
            losses = []
            for d in (1e-2, -1e-2):
                q = {n: a.copy() for n, a in p.items()}
                q[k][at] += d
                losses.append(langid._gradients(q, steps, y, mask)[0])
            assert abs((losses[0] - losses[1]) / 2e-2 - g[k][at]) < 2e-3, (k, at)


def test_reader_agrees_with_the_training_pass():
    model = langid.train([("a", "abcabc" * 9), ("b", "xyzxyz" * 9)], hidden=4, steps=3)
    raws = [b"abcxyz" * 40, b"", b"q", bytes(range(256))]
    got = langid.Reader(model).documents(raws)
    assert got.shape == (4, 2) and (got[1] == 0).all()
    for raw, prob in zip(raws, got):
        if raw:
            total = np.zeros(2)
            for a in range(0, len(raw), langid.WINDOW):
                # the reader's windows are padded; the mask of the backward pass starts in the padding
                s = np.zeros(langid.WINDOW, np.uint8)
                s[: len(raw[a : a + langid.WINDOW])] = np.frombuffer(raw[a : a + langid.WINDOW], np.uint8)
                h, _ = langid._forward(model, np.stack([s, s[::-1]])[:, :, None])
                total += langid._outputs(model, h)[: len(raw[a : a + langid.WINDOW]), 0].sum(0)
            assert np.allclose(total / len(raw), prob, atol=1e-4)


def test_held_out_accuracy(spark):
    rows = corpus()
    extra = [(900, None, "aa"), (901, "", "bb"), (902, "12 --", "cc"), (903, "lo ba mi", None), (None, "ba lo mi tu", "aa")]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    got = {r.doc_id: r for r in langid.identify(df, steps=120).collect()}
    truth = {i: lang for i, _, lang in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False


def test_held_out_rows_teach_nothing(spark):
    rows = [r for r in corpus(60) if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert langid.fit(spark.createDataFrame(rows, SCHEMA)) is None
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()} == {"und"}


def test_accepted_keeps_columns_and_clean_rows(spark, clashing):
    df = spark.createDataFrame([(*r, "x", 1.5) for r in corpus(80)] + [(500, "!!", "aa", "y", None)], SCHEMA + ", lang_pred string, score double")
    kept = langid.accepted(df, steps=60)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(80))
    assert langid.accepted(clashing, steps=1).count() == 2
    assert langid.identify(df.limit(0)).count() == 0


def test_long_texts_repeated_rows_and_ties(spark):
    rows = corpus()
    long = next(t for i, t, lang in rows if lang == "bb") * 3000
    df = spark.createDataFrame([*rows, *rows[:20], (7001, long, "bb"), (7002, long, None)], SCHEMA)
    got = langid.identify(df, steps=120).collect()
    assert len(got) == len(rows) + 22
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (7001, 7002)} == {("bb", next(r.score for r in got if r.doc_id == 7001))}
    by: dict = {}
    for r in got:
        assert by.setdefault(r.doc_id, r) == r
    # probabilities that tie: the first label by name
    model = langid.train([("b", "abab"), ("a", "baba")], hidden=2, steps=0)
    flat = {k: np.zeros_like(v) if k != "labels" else v for k, v in model.items()}
    tied = langid.predict(spark.createDataFrame([(1, "xyz")], "doc_id long, text string"), flat).first()
    assert (tied.lang_pred, tied.score) == ("a", 0.5)


def test_of_many_labels_the_most_frequent_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LABELS", 2)
    rows = [r for r in corpus() if r[2] != "cc" or r[0] % 5 == 0]
    labels = {a for a, _ in langid.sample(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "lang")}
    assert labels == {"aa", "bb"}
