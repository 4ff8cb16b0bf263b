"""TIFF media columns: a reader of baseline TIFF and a writer for lossless 8-bit payloads.

``pages`` walks the directories of each file (both byte orders, any number of
directories), decodes strips or tiles that are plain, PackBits, LZW or deflate,
undoes the horizontal predictor, and emits one row per page.  ``encode`` lays a
payload out as rows of 64 samples, one page per ``PAGE`` bytes, in one of the
``LAYOUTS``, which its digest chooses: so the stored column has strips and tiles
of all four codecs, with and without predictor, in both byte orders.
``digests`` folds the page rows back into one row a file.

Faults (no TIFF header, a directory loop, an unknown compression, missing or
impossible tags, too few samples, more than ``MOST`` bytes of samples) raise
``ValueError`` in ``read_pages``; ``pages`` turns them into one row with
``error`` set, so a damaged file stops nothing.  A null file gives one such row
too; an empty table gives none.  Null and empty texts are payloads of 64 zeros;
texts of any length are stored whole, in as many pages as they need; repeated
rows give repeated, equal results.  Files are handled one at a time in the task
that scans them, page by page: no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import rowwise

WIDTH = 64
#: Payload bytes of a page and of a strip; side of a tile.
PAGE, STRIP, TILE = 1 << 16, 1 << 14, 32
#: Bytes of samples that a file may decode to.
MOST = 1 << 30

# Fixed values of the TIFF format: tags, sizes of field types, compressions.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS = 256, 257, 258, 259, 262, 273
SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Field types that tags are read from; others count as absent.
TYPE_CODE = {1: "B", 3: "H", 4: "I"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: (compression, predictor, side of tiles or 0 for strips, byte order).
LAYOUTS = [(PLAIN, 1, 0, "<"), (PACKBITS, 1, 0, ">"), (LZW, 1, 0, "<"), (DEFLATE, 2, 0, "<"), (DEFLATE, 1, TILE, ">"), (LZW, 2, TILE, "<"), (PACKBITS, 2, TILE, "<"), (DEFLATE, 1, 0, ">")]

_RUNS = re.compile(rb"(?s)(.)\1{2,127}")


def unpack_bits(data: bytes, most: int = MOST) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three to 128 equal bytes as repeats, all else as literals of up to 128."""
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for a in range(at, end, 128):
            part = data[a : min(a + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUNS.finditer(data):
        literal(run.start())
        at = run.end()
        out += bytes((257 - (at - run.start()), data[at - 1]))
    literal(len(data))
    return bytes(out)


def unpack_lzw(data: bytes, most: int = MOST) -> bytes:
    """TIFF's LZW: codes from the high bit, 9 to 12 bits, widened one code early; 256 clears, 257 ends."""
    out, entries, width, hold, held, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        hold, held = hold << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = hold >> held
        hold &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            entries, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if not entries:
            raise ValueError("LZW data without a first clear code")
        if last is None:
            if code > 255:
                raise ValueError("LZW code out of range")
            word = entries[code]
        else:
            if code > len(entries):
                raise ValueError("LZW code out of range")
            word = entries[code] if code < len(entries) else last + last[:1]
            if len(entries) < 4096:
                entries.append(last + word[:1])
            if len(entries) + 1 >= 1 << width and width < 12:
                width += 1
        out += word
        last = word
        if len(out) >= most:
            break
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, hold, held, width = bytearray(), 0, 0, 9
    codes: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal hold, held
        hold, held = hold << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(hold >> held)
            hold &= (1 << held) - 1

    put(256)
    codes, after = {bytes((i,)): i for i in range(256)}, 258
    word = b""
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in codes:
            word = more
            continue
        put(codes[word])
        codes[more] = after
        after += 1
        if after + 1 > 1 << width:
            width += 1
        if after >= 4094:
            width = min(width, 12)
            put(256)
            codes, after, width = {bytes((k,)): k for k in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(codes[word])
        after += 1
        if after + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if held:
        out.append(hold << (8 - held) & 255)
    return bytes(out)


def _unpack(data: bytes, how: int, most: int) -> bytes:
    """The decoded bytes; decoding stops where there are ``most``."""
    if how == PLAIN:
        return data
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most + 1)
    if how == PACKBITS:
        return unpack_bits(data, most + 1)
    if how == LZW:
        return unpack_lzw(data, most + 1)
    raise ValueError(f"compression {how} is not supported")


def _pack(data: bytes, how: int) -> bytes:
    return {PLAIN: bytes, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits, LZW: pack_lzw}[how](data)


def _values(blob: bytes, order: str, at: int) -> tuple[int, tuple]:
    tag, kind, n = struct.unpack_from(order + "HHI", blob, at)
    size = TYPE_SIZE.get(kind, 1) * n
    where = at + 8 if size <= 4 else struct.unpack_from(order + "I", blob, at + 8)[0]
    if kind not in TYPE_CODE:
        return tag, ()
    if where + size > len(blob):
        raise ValueError("a field lies outside the file")
    return tag, struct.unpack_from(f"{order}{n}{TYPE_CODE[kind]}", blob, where)


def directories(blob: bytes):
    """Yield the tags of each image directory."""
    if len(blob) < 8 or blob[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    order = "<" if blob[:2] == b"II" else ">"
    at, seen = struct.unpack_from(order + "I", blob, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", blob, at)
        yield dict(_values(blob, order, at + 2 + 12 * i) for i in range(n))
        (at,) = struct.unpack_from(order + "I", blob, at + 2 + 12 * n)


def _block(blob: bytes, at: int, size: int, how: int, rows: int, width: int, samples: int, predictor: int, exact: bool) -> np.ndarray:
    need = rows * width * samples
    raw = _unpack(blob[at : at + size], how, need)
    if len(raw) < need or exact and len(raw) != need:
        raise ValueError("a strip or tile has the wrong number of samples")
    a = np.frombuffer(raw, np.uint8, need).reshape(rows, width, samples)
    if predictor == 2:
        a = np.add.accumulate(a, axis=1, dtype=np.uint8)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} is not supported")
    return a


def _page(blob: bytes, tags: dict, room: int) -> np.ndarray:
    """Samples of one page as rows x columns x channels; ``room``: bytes that it may take."""
    get = lambda tag, other: (tags.get(tag) or (other,))[0]
    width, length, samples = get(IMAGE_WIDTH, 0), get(IMAGE_LENGTH, 0), get(SAMPLES, 1)
    if min(width, length, samples) < 1:
        raise ValueError("a page without samples")
    if any(b != 8 for b in tags.get(BITS, (1,))) or get(PLANAR, 1) != 1:
        raise ValueError("only 8-bit samples, stored together, are supported")
    how, predictor = get(COMPRESSION, PLAIN), get(PREDICTOR, 1)
    tiled = TILE_OFFSETS in tags
    offsets, sizes = (tags.get(t, ()) for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    rows, columns = (get(TILE_LENGTH, 0), get(TILE_WIDTH, 0)) if tiled else (min(get(ROWS_PER_STRIP, length), length), width)
    if min(rows, columns) < 1:
        raise ValueError("strips or tiles without samples")
    across, down = -(-width // columns), -(-length // rows)
    if len(offsets) != across * down or len(sizes) != len(offsets):
        raise ValueError("strips or tiles are missing")
    if max(down * rows, length) * across * columns * samples > room:
        raise ValueError("more samples than a file may have")
    if not tiled:
        return np.concatenate([_block(blob, at, size, how, min(rows, length - k * rows), width, samples, predictor, False) for k, (at, size) in enumerate(zip(offsets, sizes))])
    image = None
    for k, (at, size) in enumerate(zip(offsets, sizes)):
        block = _block(blob, at, size, how, rows, columns, samples, predictor, True)
        if image is None:  # not before a tile is whole
            image = np.zeros((down * rows, across * columns, samples), np.uint8)
        y, x = k // across * rows, k % across * columns
        image[y : y + rows, x : x + columns] = block
    return image[:length, :width]


def read_pages(blob: bytes, most: int = MOST):
    """Yield (tags, samples as rows x columns x channels) of each page."""
    left = most
    try:
        for tags in directories(blob):
            image = _page(blob, tags, left)
            left -= image.size
            yield tags, image
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"damaged TIFF: {e}") from e


def _difference(a: np.ndarray) -> np.ndarray:
    d = a.copy()
    d[:, 1:] -= a[:, :-1]
    return d


def write_pages(images, how: int = DEFLATE, predictor: int = 1, tile: int = 0, order: str = "<", strip: int = STRIP) -> bytes:
    """A TIFF file of pages (rows x columns x channels, uint8); ``tile``: side of square tiles, a multiple of 16."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for image in images:
        length, width, samples = image.shape
        blocks = []
        if tile:
            for y in range(0, length, tile):
                for x in range(0, width, tile):
                    part = np.zeros((tile, tile, samples), np.uint8)
                    cut = image[y : y + tile, x : x + tile]
                    part[: cut.shape[0], : cut.shape[1]] = cut
                    blocks.append(part)
        else:
            per = max(1, strip // max(1, width * samples))
            blocks = [image[y : y + per] for y in range(0, length, per)]
        places = []
        for b in blocks:
            data = _pack((_difference(b) if predictor == 2 else np.ascontiguousarray(b)).tobytes(), how)
            places.append((len(out), len(data)))
            out += data
            out += b"\0" * (len(out) % 2)
        tags = {IMAGE_WIDTH: ("I", [width]), IMAGE_LENGTH: ("I", [length]), BITS: ("H", [8] * samples), COMPRESSION: ("H", [how]), PHOTOMETRIC: ("H", [1 if samples < 3 else 2]), SAMPLES: ("H", [samples]), PREDICTOR: ("H", [predictor])}
        if tile:
            tags |= {TILE_WIDTH: ("I", [tile]), TILE_LENGTH: ("I", [tile]), TILE_OFFSETS: ("I", [a for a, _ in places]), TILE_COUNTS: ("I", [n for _, n in places])}
        else:
            tags |= {ROWS_PER_STRIP: ("I", [per]), STRIP_OFFSETS: ("I", [a for a, _ in places]), STRIP_COUNTS: ("I", [n for _, n in places])}
        fields = bytearray()
        for tag in sorted(tags):
            code, values = tags[tag]
            data = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(data) > 4:
                at = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack(order + "I", at)
            fields += struct.pack(order + "HHI", tag, 3 if code == "H" else 4, len(values)) + data.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + fields
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def encode(payload: bytes) -> bytes:
    """Lossless TIFF of a payload whose length is a multiple of 64: 64 samples a row, in the layout that its digest chooses."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 1)
    how, predictor, tile, order = LAYOUTS[hashlib.sha256(payload).digest()[0] % len(LAYOUTS)]
    per = PAGE // WIDTH
    return write_pages([a[i : i + per] for i in range(0, len(a), per)], how, predictor, tile, order)


PAGE_SCHEMA = "file long, media_bytes long, media_sha256 string, page int, width int, height int, channels int, compression int, predictor int, tiled boolean, samples binary, mean double, error string"
#: Bytes of samples in an Arrow batch of pages, about.
BATCH = 1 << 24


def _arrow(ddl: str):
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def pages(files: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep=()) -> DataFrame:
    """One row per page of each file: the id, ``keep`` columns, the file's place in its task, size and digest, the page's layout, its samples, their mean; or ``error``.

    Pages of a file follow one another.
    """
    from pyspark.sql import types as T

    ship(files.sparkSession)
    made = T.StructType.fromDDL(PAGE_SCHEMA)
    kinds = list(_arrow(PAGE_SCHEMA).types)
    held = [f"k{i}" for i in range(len(keep) + 1)]
    names = [*held, *made.names]
    rows = files.select(*[F.col(c).alias(k) for c, k in zip([id_col, *keep], held)], F.col(media_col).alias("media"))

    def walk(batches):
        import pyarrow as pa

        def batch(b, rows):
            at = pa.array([r[0] for r in rows], pa.int64())
            return pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in held], *[pa.array(v, k) for v, k in zip(list(zip(*rows))[1:], kinds)]], names=names)

        file = 0
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for n in range(b.num_rows):
                blob, k = b.column("media")[n].as_py(), 0
                about = (n, file, len(blob), hashlib.sha256(blob).hexdigest()) if blob is not None else (n, file, None, None)
                file += 1
                try:
                    if blob is None:
                        raise ValueError("null file")
                    for k, (tags, a) in enumerate(read_pages(blob), 1):
                        rows.append((*about, k, a.shape[1], a.shape[0], a.shape[2], tags.get(COMPRESSION, (PLAIN,))[0], tags.get(PREDICTOR, (1,))[0], TILE_OFFSETS in tags, a.tobytes(), float(a.mean()), None))
                        size += a.size
                        if size > BATCH:
                            yield batch(b, rows)
                            rows, size = [], 0
                except ValueError as e:
                    rows.append((*about, k + 1, *[None] * 8, str(e)))
            if rows:
                yield batch(b, rows)

    schema = T.StructType([*rows.schema.fields[:-1], *made.fields])
    out = rows.mapInArrow(walk, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip([id_col, *keep], held)], *made.names)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_bytes`` and ``media``: the padded UTF-8 text of each row as a TIFF file."""

    def make():
        def fn(texts):
            raws = [t.encode("utf-8", "replace") if t else b"" for t in texts]
            return [[len(r) for r in raws], [encode(r + b"\0" * (max(64, -(-len(r) // 64) * 64) - len(r))) for r in raws]]

        return fn

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rowwise(rows, ["text"], make, "n_bytes long, media binary").withColumnRenamed("id", id_col)


_DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Fold:
    """What the pages of one file add up to."""

    def __init__(self):
        self.sha, self.tail, self.error = hashlib.sha256(), b"", None
        self.size = self.height = self.count = self.total = self.steps = 0

    def add(self, width: int, height: int, data: bytes, error: str | None) -> None:
        if error is not None:
            self.error = error
            return
        a = np.frombuffer(data, np.uint8)
        self.sha.update(data)
        self.tail = (self.tail + data)[-64:]
        self.size, self.height, self.count = self.size + len(data), self.height + height, self.count + 1
        self.total += int(a.sum(dtype=np.int64))
        # samples of a row, from one to the next
        rows = a.reshape(height, -1).astype(np.int16)
        self.steps += int(np.abs(rows[:, 1:] - rows[:, :-1]).sum(dtype=np.int64))

    def row(self, media_bytes, media_sha256) -> tuple:
        if self.error is not None or not self.size:
            return None, None, None, media_bytes, media_sha256, f"error={self.error or 'no page'}"
        feature = f"pages={self.count};rows={self.height};mean={self.total / self.size:.4f};step={self.steps / (self.height * (WIDTH - 1)):.4f}"
        return self.size, self.sha.hexdigest(), zlib.crc32(self.tail), media_bytes, media_sha256, feature


def digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the stored files back as page rows and fold these: digests of payload and file, and a feature string.

    The feature is the number of pages and rows, the mean sample, and the mean
    of the absolute steps along rows, over all pages.  A file with a fault has
    no payload and names its fault.
    """
    from pyspark.sql import types as T

    read = pages(stored, id_col, keep=["n_bytes"]).select(F.col(id_col).alias("id"), "n_bytes", "file", "media_bytes", "media_sha256", "width", "height", "samples", "error")
    kinds = list(_arrow(_DIGESTS).types)

    def fold(batches):
        import pyarrow as pa

        file, held, about, ids = None, None, (), []
        rows: list[tuple] = []

        def batch():
            first = pa.concat_tables(ids).combine_chunks()
            return pa.RecordBatch.from_arrays([*[c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in first.columns], *[pa.array(v, k) for v, k in zip(zip(*rows), kinds)]], names=names)

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("file", "media_bytes", "media_sha256", "width", "height", "samples", "error")]
            for n, (of, size, sha, *page) in enumerate(zip(*columns)):
                if of != file:
                    if held is not None:
                        rows.append(held.row(*about))
                    if len(rows) >= 1000:
                        yield batch()
                        rows, ids = [], []
                    file, held, about = of, _Fold(), (size, sha)
                    ids.append(pa.Table.from_batches([b.select(["id", "n_bytes"]).slice(n, 1)]))
                held.add(*page)
        if held is not None:
            rows.append(held.row(*about))
            yield batch()

    schema = T.StructType([*read.schema.fields[:2], *T.StructType.fromDDL(_DIGESTS).fields])
    names = schema.names
    return read.mapInArrow(fold, schema).withColumnRenamed("id", id_col)
