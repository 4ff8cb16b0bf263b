import hashlib
import zlib

import numpy as np
import pytest

from matchloom.llm import tiff


@pytest.mark.parametrize("how", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [0, 16, 48])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_round_trip(how, tile, order, predictor):
    rng = np.random.default_rng(how + tile)
    pages = [rng.integers(0, top, (h, w, c)).astype(np.uint8) for h, w, c, top in ((1, 1, 1, 256), (70, 33, 3, 4), (129, 64, 1, 256), (40, 200, 1, 2))]
    got = list(tiff.read_pages(tiff.write_pages(pages, how, predictor, tile, order, strip=1000)))
    assert len(got) == 4 and all(np.array_equal(a, b) for (_, a), b in zip(got, pages))


def test_codecs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 127, 128, 129, 300, 70_000):
        for top in (1, 3, 256):
            data = rng.integers(0, top, n).astype(np.uint8).tobytes()
            assert tiff.unpack_bits(tiff.pack_bits(data)) == data
            assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
    # fixed values: a run, a literal, a header that does nothing
    assert tiff.unpack_bits(bytes((254, 7, 128, 1, 8, 9))) == bytes((7, 7, 7, 8, 9))


@pytest.mark.parametrize("damage", [lambda b: b"GIF8" + b[4:], lambda b: b[:40], lambda b: b[:4] + b"\xff\xff\xff\x00" + b[8:], lambda b: b[:-4] + b[4:8]])
def test_damage_is_told(damage):
    whole = tiff.write_pages([np.zeros((9, 64, 1), np.uint8)])
    with pytest.raises(ValueError):
        list(tiff.read_pages(damage(whole)))


@pytest.mark.parametrize("layout", tiff.LAYOUTS)
def test_random_damage_raises_nothing_else(layout):
    how, predictor, tile, order = layout
    rng = np.random.default_rng(7)
    whole = tiff.write_pages([rng.integers(0, 4, (90, 64, 1)).astype(np.uint8), np.zeros((3, 5, 2), np.uint8)], how, predictor, tile, order, strip=700)
    told = 0
    for _ in range(400):
        b = bytearray(whole)
        for at in rng.integers(0, len(b), rng.integers(1, 9)):
            b[at] = rng.integers(0, 256)
        try:
            list(tiff.read_pages(bytes(b[: rng.integers(8, len(b) + 1)]), 1 << 22))
        except ValueError:
            told += 1
    assert told > 100


def test_missing_tags_and_huge_sizes_are_told():
    """A file of one page without each of its tags, and with a value that no file can hold."""
    for tile in (0, 16):
        whole = tiff.write_pages([np.ones((40, 64, 1), np.uint8)], tiff.DEFLATE, 1, tile)
        at = int.from_bytes(whole[4:8], "little")
        n = int.from_bytes(whole[at : at + 2], "little")
        for i in range(n):
            place = at + 2 + 12 * i
            tag = int.from_bytes(whole[place : place + 2], "little")
            gone = whole[:place] + (60000 + i).to_bytes(2, "little") + whole[place + 2 :]
            huge = whole[: place + 8] + b"\xff\xff\xff\x7f" + whole[place + 12 :]
            for b in (gone, huge):
                try:
                    assert sum(a.size for _, a in tiff.read_pages(b)) < 1 << 20, tag
                except ValueError:
                    pass
    bomb = tiff.write_pages([np.zeros((4000, 4000, 1), np.uint8)])
    with pytest.raises(ValueError):
        list(tiff.read_pages(bomb, 1 << 20))


def test_every_layout_is_used_and_read_back(docs):
    rows = [(i, f"text {i} " * (1 + i * 7)) for i in range(90)]
    stored = tiff.store(docs(rows))
    seen = {(r.compression, r.predictor, r.tiled) for r in tiff.pages(stored).collect()}
    assert seen == {(how, predictor, tile > 0) for how, predictor, tile, _ in tiff.LAYOUTS}
    assert {r.media[:2] for r in stored.collect()} == {b"II", b"MM"}


def test_a_damaged_file_among_others(spark):
    good = tiff.encode(b"x" * 640)
    rows = spark.createDataFrame([(1, 640, bytearray(good)), (2, 1, bytearray(good[:50])), (3, 640, bytearray(good)), (4, 0, None)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in tiff.digests(rows).collect()}
    assert got[1].payload_sha256 == got[3].payload_sha256 == hashlib.sha256(b"x" * 640).hexdigest()
    assert got[2].payload_sha256 is None and got[2].feature.startswith("error=") and got[4].feature == "error=null file"


def test_pages_of_files(spark):
    two = tiff.write_pages([np.full((3, 64, 1), 5, np.uint8), np.zeros((2, 8, 3), np.uint8)], tiff.PACKBITS)
    rows = spark.createDataFrame([(1, bytearray(two)), (2, bytearray(b"no")), (None, None), (1, bytearray(two))], "id long, media binary")
    got = sorted(((r.id, r.page, r.height, r.width, r.channels, r.mean, r.error is None) for r in tiff.pages(rows, "id").collect()), key=str)
    ok = [(1, 1, 3, 64, 1, 5.0, True), (1, 2, 2, 8, 3, 0.0, True)]
    assert got == sorted(ok * 2 + [(2, 1, None, None, None, None, False), (None, 1, None, None, None, None, False)], key=str)
    assert tiff.pages(rows.limit(0), "id").count() == 0


def test_texts_as_media(docs, clashing, monkeypatch):
    rows = [(1, "That it."), (2, None), (3, ""), (4, "é" * 64), (5, "x" * 64), (6, "long \n" * 100_000), (1, "That it."), (None, "ß")]
    for page in (1 << 22, 4096):
        monkeypatch.setattr(tiff, "PAGE", page)
        got = {}
        for r in tiff.digests(tiff.store(docs(rows))).collect():
            assert got.setdefault(r.doc_id, r) == r  # equal texts, equal values
        for i, text in rows:
            raw = (text or "").encode()
            payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
            r = got[i]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert r.media_bytes > 0 and len(r.media_sha256) == 64
    assert tiff.digests(tiff.store(clashing)).count() == 4 and tiff.digests(tiff.store(docs([]))).count() == 0
