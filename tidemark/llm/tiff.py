"""TIFF pages: a walk over the image directories, decoders for strips and tiles, and one row for each page.

Reads both byte orders, uncompressed, PackBits, LZW and deflate data, strips and tiles, 8-bit samples (any number a pixel, chunky)
and horizontal differencing. The writer makes such files, too, so round trips can be tested.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._session import chosen
from tidemark.llm.words import sliced

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES = 284, 317, 322, 323, 324, 325
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_bits(row: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(row):
        run = 1
        while run < 128 and i + run < len(row) and row[i + run] == row[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, row[i]))
            i += run
            continue
        j = i + 1
        while j < len(row) and j - i < 128 and (j + 1 >= len(row) or row[j] != row[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + row[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, table, width, bits, held, last = [], [], 9, 0, 0, None
    clear, end = 256, 257
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        code = held >> (bits - width)
        bits -= width
        held &= (1 << bits) - 1
        if code == end:
            break
        if code == clear:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, last = 9, None
            continue
        if last is None:
            word = table[code]
        else:
            if code > len(table):
                raise TiffError("LZW code out of order")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            out.append((held >> (bits - 8)) & 255)
            bits -= 8
        held &= (1 << bits) - 1

    table, word, width = {bytes((i,)): i for i in range(256)}, b"", 9
    following = 258
    put(256, 9)
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word], width)
        table[more] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4094:
            put(256, width)
            table, following, width = {bytes((i,)): i for i in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 1024, tile: int = 0, order: str = "<", level: int = 1) -> bytes:
    """``pages``: uint8 arrays (height, width) or (height, width, samples). ``tile``: the side of square tiles, 0 for strips."""
    body = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        h, w, s = page.shape
        blocks = []
        for y in range(0, h, tile or rows):
            for x in range(0, w, tile or w):
                b = page[y : y + (tile or rows), x : x + (tile or w)]
                if tile:
                    b = np.pad(b, ((0, tile - b.shape[0]), (0, tile - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], 1)
                raw = np.ascontiguousarray(b).tobytes()
                if compression == DEFLATE:
                    raw = zlib.compress(raw, level)
                elif compression == LZW:
                    raw = lzw_encode(raw)
                elif compression == PACKBITS:
                    line = b.shape[1] * s
                    raw = b"".join(pack_bits(raw[i : i + line]) for i in range(0, len(raw), line))
                blocks.append(raw)
        at = []
        for raw in blocks:
            at.append(len(body))
            body += raw + b"\0" * (len(raw) % 2)
        sizes = [len(b) for b in blocks]
        tags = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8] * s), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if s == 3 else 1]), SAMPLES: (3, [s]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILES: (4, at), TILE_SIZES: (4, sizes)} if tile else {STRIPS: (4, at), ROWS: (4, [rows]), STRIP_SIZES: (4, sizes)}
        entries = b""
        for tag in sorted(tags):
            kind, values = tags[tag]
            raw = struct.pack(f"{order}{len(values)}{TYPES[kind][0]}", *values)
            if len(raw) > 4:
                place = struct.pack(order + "I", len(body))
                body += raw + b"\0" * (len(raw) % 2)
            else:
                place = raw.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + place
        body[link : link + 4] = struct.pack(order + "I", len(body))
        body += struct.pack(order + "H", len(tags)) + entries
        link = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in the order of their chain; a chain that turns back on itself ends there."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in TYPES:
                code, size = TYPES[kind]
                place = at + 10 + 12 * i
                place = struct.unpack_from(order + "I", data, place)[0] if size * count > 4 else place
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
        yield tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _block(raw: bytes, compression: int) -> bytes:
    if compression == NONE:
        return raw
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    if compression == LZW:
        return lzw_decode(raw)
    if compression == PACKBITS:
        return unpack_bits(raw)
    raise TiffError(f"compression {compression}")


def decode(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """The samples of one directory as (height, width, samples)."""
    one = lambda tag, other=None: tags.get(tag, (other,))[0]
    w, h, s, packed, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if w is None or h is None or any(b != 8 for b in tags.get(BITS, (1,))) or one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise TiffError("layout")
    tiled = TILES in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(one(ROWS, h), h))
    places, sizes = (tags[TILES], tags[TILE_SIZES]) if tiled else (tags[STRIPS], tags[STRIP_SIZES])
    out, across = np.zeros((h, w, s), np.uint8), -(-w // bw)
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        b = np.frombuffer(_block(data[place : place + size], packed), np.uint8)
        if len(b) < rows * bw * s:
            raise TiffError("short block")
        b = b[: rows * bw * s].reshape(rows, bw, s)
        if predictor == 2:
            b = np.cumsum(b, axis=1, dtype=np.uint8)
        part = out[y : y + rows, x : x + bw]
        part[:] = b[: part.shape[0], : part.shape[1]]
    return out


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and a 16-bin histogram of the samples, in whole thousandths."""
    flat = samples.ravel()
    count = np.bincount(flat, minlength=256)
    n = max(1, len(flat))
    mean = float((count * np.arange(256)).sum() / n)
    spread = float((count * (np.arange(256) - mean) ** 2).sum() / n) ** 0.5
    return ":".join([f"{mean:.3f}", f"{spread:.3f}", *(str(int(1000 * v // n)) for v in count.reshape(16, 16).sum(1))])


BROKEN = (TiffError, struct.error, zlib.error, KeyError, IndexError, ValueError, TypeError, ZeroDivisionError, OverflowError, MemoryError)
PAGE = "page int, width int, height int, samples int, pixels binary, feature string, error string"


def pages(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each page of each file, with the ``keep`` columns: page (from 0), size, pixels, feature.

    A null or broken file, or a page that can't be decoded, gives one row with ``error`` and null pixels; all other pages stay. Only a
    broken directory ends the walk, since the place of the next one isn't known.
    """
    own = chosen(media, media_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            rows, out, held = [], [], 0
            for i, value in enumerate(batch.column(0)):
                data = value.as_py() or b""
                walk, k, tags = directories(data), -1, {}
                while tags is not None:
                    k, tags, row = k + 1, None, None
                    try:
                        tags = next(walk, None)
                        if tags is not None:
                            p = decode(data, tags)
                            row = (k, p.shape[1], p.shape[0], p.shape[2], p.tobytes(), feature(p), None)
                            held += p.size
                    except BROKEN as e:
                        row = (k, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])
                    if row:
                        out.append(row)
                        rows.append(i)
                if held > 1 << 24:
                    yield batch_of(batch, rows, out)
                    rows, out, held = [], [], 0
            yield batch_of(batch, rows, out)

    def batch_of(batch: pa.RecordBatch, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
        cols = [pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)]
        names = [x.split()[0] for x in PAGE.split(", ")]
        own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(1, batch.num_columns)]
        return pa.RecordBatch.from_arrays([*own, *cols], names=[*keep, *names])

    schema = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(run, f"{schema}, {PAGE}")


def store_texts(docs: DataFrame, width: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes, padded with 0 to a positive multiple of ``width``, as one deflated
    TIFF page of that width. Null counts as empty."""
    own = chosen(docs, id_col, text_col).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 256):
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            padded = [np.frombuffer(t + b"\0" * (-len(t) % width or (0 if t else width)), np.uint8).reshape(-1, width) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_tiff([p]) for p in padded], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back and digest what was read."""
    read = pages(store_texts(docs), keep=("doc_id", "n_bytes", "media"))
    return read.select(
        "doc_id", "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
