import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tiff as T


@pytest.mark.parametrize("compression", [T.NONE, T.LZW, T.DEFLATE, T.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4, (37, 50)).astype(np.uint8), rng.integers(0, 256, (20, 33, 3)).astype(np.uint8), np.zeros((1, 1), np.uint8), np.full((200, 100), 7, np.uint8)]
    data = T.write_tiff(pages, compression, predictor, rows=8, tile=tile, order=order)
    back = [T.decode(data, d) for d in T.directories(data)]
    assert len(back) == 4
    for a, b in zip(pages, back, strict=True):
        assert np.array_equal(a.reshape(b.shape), b)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_codecs(data, times):
    data = data * times
    assert T.lzw_decode(T.lzw_encode(data)) == data
    assert T.unpack_bits(T.pack_bits(data)) == data


def test_pages_of_files(spark):
    p = np.arange(64, dtype=np.uint8).reshape(8, 8)
    two = T.write_tiff([p, p[:4]], T.LZW)
    rows = [(1, two), (2, None), (3, b"II*\0junk"), (4, two[: len(two) // 2]), (5, b"")]
    got = T.pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.page, r.height, bytes(r.pixels)) for r in sorted(by[1], key=lambda r: r.page)] == [(0, 8, p.tobytes()), (1, 4, p[:4].tobytes())]
    assert all(by[k][-1].error and by[k][-1].pixels is None for k in (2, 3, 4, 5))


def test_a_page_that_cannot_be_decoded_hides_no_other(spark):
    p = np.arange(64, dtype=np.uint8).reshape(8, 8)
    data = bytearray(T.write_tiff([p, p[:4], p[:2]], T.DEFLATE))
    at = int.from_bytes(data[4:8], "little")
    at = int.from_bytes(data[at + 2 + 12 * int.from_bytes(data[at : at + 2], "little") :][:4], "little")  # the second directory
    tag = next(at + 2 + 12 * i for i in range(20) if int.from_bytes(data[at + 2 + 12 * i :][:2], "little") == T.COMPRESSION)
    odd = data[: tag + 8] + (7).to_bytes(2, "little") + data[tag + 10 :]  # JPEG
    zero = data[:at] + b"\xff\xff" + data[at + 2 :]  # a directory that says more than the file holds
    got = T.pages(spark.createDataFrame([(1, bytes(odd)), (2, bytes(zero))], "doc_id long, media binary")).collect()
    by = {i: sorted((r.page, r.height, r.error is None) for r in got if r.doc_id == i) for i in (1, 2)}
    assert by == {1: [(0, 8, True), (1, None, False), (2, 2, True)], 2: [(0, 8, True), (1, None, False)]}


def test_text_digest(spark):
    texts = [(1, None, 0), (2, "", 0), (3, "é" * 32, 0), (4, "x" * 65, 0), (5, "long " * 200_000, 0), (6, "x" * 65, 1), (None, "y", 2)]
    got = {r.doc_id: r for r in T.media_digest(spark.createDataFrame(texts, "doc_id long, text string, page int")).collect()}
    for doc_id, text, _ in texts:
        raw = (text or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[4][3:] == got[6][3:]
