import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from graphloom.llm import tiff_media as T


@pytest.mark.parametrize("scheme", [T.RAW, T.PACKBITS, T.LZW, T.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages_survive(scheme, predictor, tile):
    r = np.random.default_rng(scheme)
    for order in "<>":
        pages = [r.integers(0, 9, (37, 50), dtype=np.uint8), r.integers(0, 256, (20, 33, 3), dtype=np.uint8), r.integers(0, 65536, (9, 17), dtype=np.uint16), np.zeros((70, 64), np.uint8)]
        back = list(T.Reader(T.write(pages, scheme, predictor, tile, rows=7, order=order)).pages())
        assert [p.error for p in back] == [""] * 4 and [p.tiled for p in back] == [tile is not None] * 4
        for p, q in zip(pages, back):
            assert (q.pixels == p.reshape(q.pixels.shape)).all() and q.pixels.dtype == p.dtype


def test_codecs_round_trip():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 127, 128, 129, 300, 5000, 70000):
        for letters in (b"a", b"ab", bytes(range(256))):
            data = bytes(r.choice(letters) for _ in range(n))
            assert T.unpack_bits(T.pack_bits(data), n) == data
            assert T.lzw_decode(T.lzw_encode(data), n) == data


def test_known_streams():
    # the worked example of the PackBits rule, and an LZW stream of clear, 7, 258, 8, 8, 258, 6, 6, end
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert T.unpack_bits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert T.lzw_decode(data, 10) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_planar_samples():
    a, b = np.arange(12, dtype=np.uint8).reshape(3, 4), np.arange(12, 24, dtype=np.uint8).reshape(3, 4)
    import struct

    fields = [(256, 4, [4]), (257, 4, [3]), (258, 3, [8, 8]), (259, 3, [1]), (273, 4, [8, 20]), (277, 3, [2]), (278, 4, [3]), (279, 4, [12, 12]), (284, 3, [2])]
    at = 32 + 2 + 12 * len(fields) + 4
    entries, extra = b"", b""
    for tag, t, v in fields:
        p = struct.pack(f"<{len(v)}{'H' if t == 3 else 'I'}", *v)
        if len(p) > 4:
            extra, p = extra + p, struct.pack("<I", at + len(extra))
        entries += struct.pack("<HHI", tag, t, len(v)) + p.ljust(4, b"\0")
    data = b"II*\0" + struct.pack("<I", 32) + a.tobytes() + b.tobytes() + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + extra
    page = next(T.Reader(data).pages())
    assert not page.error and (page.pixels == np.stack((a, b), axis=2)).all()


def test_broken_files_give_errors(spark):
    r = random.Random(4)
    good = T.write([np.arange(6400, dtype=np.uint16).astype(np.uint8).reshape(100, 64)] * 2)
    files = [None, b"", b"II*\0", b"no tiff at all", good[: len(good) // 2], good[:8] + b"\xff" * 40]
    for _ in range(150):
        x = bytearray(good)
        for _ in range(r.randrange(1, 6)):
            x[r.randrange(len(x))] = r.randrange(256)
        files.append(bytes(x))
    df = spark.createDataFrame(list(enumerate(files)) + [(None, good)], "doc_id long, media binary").selectExpr("media", "doc_id", "1 AS page")
    rows = T.read_pages(df).collect()
    assert {x.doc_id for x in rows} == {*range(len(files)), None}
    assert all((x.error is None) == (x.pixels is not None) for x in rows)
    assert [x.page for x in rows if x.doc_id is None] == [0, 1]


def test_texts_come_back(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "word " * 60000, "\0\0", "x" * 64]
    df = spark.createDataFrame([*enumerate(texts), (None, "n")], "doc_id long, text string").selectExpr("1 AS media", "text", "doc_id", "2 AS n_bytes")
    got = {x.doc_id: x for x in T.features(T.store(df)).collect()}
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        x = got[d]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert (x.media_bytes, x.media_sha256) == (len(T.from_text(raw)), hashlib.sha256(T.from_text(raw)).hexdigest())
    assert got[4].feature == got[8].feature and got[6].n_pages == 5 and len(got) == 10
    assert T.features(T.store(df.limit(0))).count() == 0
    pages = T.read_pages(T.store(df).filter("doc_id = 6")).orderBy("page").collect()
    assert b"".join(bytes(p.pixels) for p in pages)[:300000] == texts[6].encode()


def test_texts_take_every_form(spark):
    """All schemes, with both predictors, in strips and tiles, each by the samples of its page; the pages give the texts."""
    r = random.Random(8)
    texts = [" ".join(r.choice(["ab", "the", "xyzzy", "é"]) for _ in range(r.choice([3, 30, 3000, 40000]))) for _ in range(60)]
    rows = T.read_pages(T.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id", "page").collect()
    assert {(x.compression, x.predictor, x.tiled) for x in rows} == {(c, p, t) for c in ("lzw", "packbits", "deflate") for p in (1, 2) for t in (False, True)}
    for d, text in enumerate(texts):
        pages = [x for x in rows if x.doc_id == d]
        assert b"".join(bytes(x.pixels) for x in pages).rstrip(b"\0") == text.encode()
        for x in pages:
            scheme, predictor, tile = T.form_of(np.frombuffer(bytes(x.pixels), np.uint8))
            assert (T.NAMES[scheme], predictor, tile is not None) == (x.compression, x.predictor, x.tiled)


def test_negative_fields_are_errors():
    r = np.random.default_rng(6)
    pixels = r.integers(0, 256, (40, 30), dtype=np.uint8)
    for tile in (None, (16, 16)):
        good = T.write([pixels], tile=tile)
        n = struct.unpack_from("<H", good, (at := struct.unpack_from("<I", good, 4)[0]))[0]
        for k in range(n):
            place = at + 2 + 12 * k
            for kind in (1, 3, 4, 6, 8, 9):
                for value in (-1, -(2**31), 0, 2**31 - 1):
                    bad = bytearray(good)
                    struct.pack_into("<H", bad, place + 2, kind)
                    struct.pack_into("<i", bad, place + 8, value)
                    try:
                        for p in T.Reader(bytes(bad)).pages():
                            assert p.error or p.pixels is not None
                    except T.Bad:
                        pass
    both = bytearray(T.write([pixels]))
    at = struct.unpack_from("<I", both, 4)[0]
    for k in range(struct.unpack_from("<H", both, at)[0]):
        if struct.unpack_from("<H", both, at + 2 + 12 * k)[0] in (T.WIDTH, T.HEIGHT):
            struct.pack_into("<H", both, at + 4 + 12 * k, 9)
            struct.pack_into("<i", both, at + 10 + 12 * k, -3)
    assert [p.error for p in T.Reader(bytes(both)).pages()] == ["no size, or too large a one"]
