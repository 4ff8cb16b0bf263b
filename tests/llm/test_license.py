import random
import re

import duckdb
import pytest

from matchloom.llm import license

TEXTS = [
    None, "", "Released under the MIT License.", "x under the mit license, Apache License, Version 2.0 and under THE mit-license",
    "CC BY-NC 4.0; cc by nc cc by nc", "cc by cc by nc", "Licensed under the GNU General Public License, version 3.", "licensed under the GNU General Public License, version 2",
    "permission is hereby granted free of charge to any other person obtaining a copy of this software and its associated documentation files the software to deal in the software without restriction",
    "é under the mit license", "under the mit", "License, under the", "a b",
]


def places(text):
    words = re.findall(license.LICENSE_WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for phrase, label in license.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), found


def test_base_is_exact(docs):
    got = {r.doc_id: r for r in license.scan(docs(list(enumerate(TEXTS)))).collect()}
    for i, text in enumerate(TEXTS):
        n, found = places(text)
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(found)), text
        assert r.first_word == (min(found)[0] if found else None) and r.last_word == (max(found)[0] if found else None)
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert (got[6].labels, got[7].labels, got[0].labels) == ("gpl-3", "gpl-2", "")
    assert got[8].labels == "mit" and 0.8 <= got[8].score < 1  # a word put in twice
    assert got[8].n_spans == 1


NOTICE = license.NOTICES[0][1].split()
BODY = next(t for label, t in license.NOTICES if label == "mit" and len(t.split()) > 100).split()


def brute(text):
    """(labels, score) of the notices, by trying every band of diagonals."""
    words = re.findall(license.LICENSE_WORD, (text or "").lower())
    labels, score, k = set(), 0.0, license.K
    for label, template in [(v, p) for p, v in license.PHRASES.items()] + license.NOTICES:
        t = template.split()
        n = len(t) - k + 1
        hits = [(p, i) for p in range(len(words) - k + 1) for i in range(n) if words[p : p + k] == t[i : i + k]]
        for d in {p - i for p, i in hits}:
            band = [(p, i) for p, i in hits if d <= p - i <= d + license.NEIGHBOUR]
            stands = {p + j for p, _ in band for j in range(k)}
            cover = min(len({i for _, i in band}) / n, len(stands) / (max(stands) - min(stands) + 1))
            score = max(score, cover)
            if cover >= (1 if n < license.SHORT else license.SIMILARITY):
                labels.add(label)
    return ",".join(sorted(labels)), score


def test_spans_are_verified(docs):
    shards = [w for i in range(0, len(NOTICE), 3) for w in (*NOTICE[i : i + 3], "filler")]
    turned = NOTICE[14:] + NOTICE[:14]
    strewn = [w for i in range(0, len(BODY), 4) for w in (*BODY[i : i + 4], "x", "y")]
    one_off = [*NOTICE[:9], "new", *NOTICE[9:20], *NOTICE[21:]]
    texts = [" ".join(x) for x in (shards, turned, strewn, one_off, BODY, BODY[:60] + BODY[62:], NOTICE + ["a"] * 40 + NOTICE, ["of", "this", "software"] * 30)]
    got = {r.doc_id: r for r in license.scan(docs(list(enumerate(texts)))).collect()}
    assert [got[i].labels for i in range(8)] == ["", "", "", "mit", "mit", "mit", "mit", ""]
    assert max(got[i].score for i in (0, 1, 2, 7)) < 0.7 and got[4].score == 1.0 and got[6].n_spans == 2
    for i, text in enumerate(texts):
        assert (got[i].labels, pytest.approx(got[i].score)) == brute(text), text


def test_random_texts_as_by_brute_force(docs):
    rng = random.Random(4)
    pool = [t.split() for _, t in license.NOTICES]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            t = rng.choice(pool)
            a, b = sorted((rng.randrange(len(t)), rng.randrange(len(t) + 1)))
            words += [w for w in (t if rng.random() < 0.5 else t[a:b]) if rng.random() > 0.03]
            words += ["prose"] * rng.randrange(0, 6)
        texts.append(" ".join(words))
    got = {r.doc_id: r for r in license.scan(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        labels, score = brute(text)
        assert (got[i].labels, got[i].score) == (labels, pytest.approx(score)), text
    assert sum(bool(brute(t)[0]) for t in texts) > 20


def test_as_duckdb(docs):
    rows = list(enumerate(TEXTS * 3 + [" ".join(NOTICE[:9] + ["new"] + NOTICE[9:] + BODY), " ".join(w + " é" * (i % 4 == 0) for i, w in enumerate(BODY))]))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(license.oracle()).fetchall()
    assert sorted(map(tuple, license.scan(docs(rows)).collect()), key=str) == sorted(want, key=str)


def test_input_edges(docs, clashing):
    assert license.scan(docs([])).count() == 0
    got = license.scan(clashing).collect()
    assert sorted((r.doc_id, r.labels) for r in got) == [(1, "mit"), (1, "mit"), (2, ""), (3, "")]
    long = "word " * 30_000 + "under the mit license " + "the license " * 20_000
    assert license.scan(docs([(1, long)])).first().first_word == 30_000
    with pytest.raises(ValueError):
        license.templates({"two words": "x"})
