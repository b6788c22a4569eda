"""TIFF pages: reading and writing of grey and colour images of 8-bit and 16-bit samples.

The reader walks the chain of image directories (and SubIFDs), decodes uncompressed, PackBits, LZW and
deflate data in strips or tiles, chunky or planar, undoes the horizontal predictor, and gives one page
for each directory. It takes bytes of any origin: lengths and counts are checked against the file, loops
in the chain end the walk, and a page that cannot be read gives a row with its error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit
from graphloom.llm.durable import map_arrow

# Fixed values of the format: tags, field types with their sizes, and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SUB_IFDS = 284, 317, 322, 323, 324, 325, 330
TYPES = {1: ("B", 1), 2: ("B", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 13: ("I", 4)}
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {RAW: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}

MOST_PIXELS = 1 << 28
ROW = 64  # samples in a row of a text's image
PAGE_ROWS, STRIP_ROWS = 1024, 256
TILE = (16, ROW // 2)  # rows and samples of a tile of a text's page


class Bad(ValueError):
    """A file or page that is not well formed."""


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        else:
            if k > 128 and i + 1 < n:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 2 if k > 128 else 1
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        stop = i + 1
        while stop < n and stop - i < 128 and not (stop + 2 < n and data[stop] == data[stop + 1] == data[stop + 2]):
            stop += 1
        out.append(stop - i - 1)
        out += data[i:stop]
        i = stop
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, width, held, bits, last = list(base), bytearray(), 9, 0, 0, None
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        while bits >= width:
            bits -= width
            code = held >> bits & (1 << width) - 1
            if code == 256:
                table, width, last = list(base), 9, None
                continue
            if code == 257:
                return bytes(out[:size])
            if last is None:
                if code >= len(table):
                    raise Bad("LZW code without an entry")
                entry = table[code]
            else:
                if code > len(table):
                    raise Bad("LZW code without an entry")
                entry = table[code] if code < len(table) else last + last[:1]
                if len(table) < 4096:
                    table.append(last + entry[:1])
            out += entry
            last = entry
            if len(out) >= size:
                return bytes(out[:size])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table, width, nxt = {bytes([i]): i for i in range(256)}, 9, 258
    codes: list[tuple[int, int]] = [(256, 9)]
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if longer in table:
            run = longer
            continue
        codes.append((table[run], width))
        table[longer] = nxt
        nxt += 1
        if nxt >= (1 << width) and width < 12:
            width += 1
        if nxt >= 4094:
            codes.append((256, width))
            table, width, nxt = {bytes([k]): k for k in range(256)}, 9, 258
        run = data[i : i + 1]
    if run:
        codes.append((table[run], width))
        nxt += 1
        if nxt >= (1 << width) and width < 12:
            width += 1
    codes.append((257, width))
    for code, w in codes:
        held = held << w | code
        bits += w
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def decompress(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == RAW:
        return data[:size]
    if scheme == PACKBITS:
        return unpack_bits(data, size)
    if scheme == LZW:
        return lzw_decode(data, size)
    if scheme in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise Bad(f"deflate: {e}") from None
    raise Bad(f"compression {scheme} is not supported")


def compress(data: bytes, scheme: int) -> bytes:
    return {RAW: lambda: data, PACKBITS: lambda: pack_bits(data), LZW: lambda: lzw_encode(data), DEFLATE: lambda: zlib.compress(data, 1)}[scheme]()


@dataclass
class Page:
    index: int
    pixels: np.ndarray | None  # height x width x samples
    compression: str = ""
    tiled: bool = False
    predictor: int = 1
    error: str = ""


class Reader:
    def __init__(self, data: bytes):
        if data[:2] not in (b"II", b"MM") or len(data) < 8:
            raise Bad("no TIFF header")
        self.data, self.order = data, "<" if data[:2] == b"II" else ">"
        if self._at("H", 2) != 42:
            raise Bad("no TIFF header")

    def _at(self, kind: str, at: int) -> int:
        if at < 0 or at + struct.calcsize(kind) > len(self.data):
            raise Bad("an offset lies outside the file")
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def _directory(self, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
        n = self._at("H", at)
        fields: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            e = at + 2 + 12 * k
            tag, kind, count = self._at("H", e), self._at("H", e + 2), self._at("I", e + 4)
            if kind in TYPES:
                letter, size = TYPES[kind]
                place = e + 8 if size * count <= 4 else self._at("I", e + 8)
                if place + size * count > len(self.data):
                    raise Bad(f"tag {tag} lies outside the file")
                fields[tag] = struct.unpack_from(f"{self.order}{count}{letter}", self.data, place)
        return fields, self._at("I", at + 2 + 12 * n)

    def pages(self) -> Iterator[Page]:
        todo, seen, index = [self._at("I", 4)], set(), 0
        while todo:
            at = todo.pop(0)
            if not at or at in seen:
                continue
            seen.add(at)
            try:
                fields, after = self._directory(at)
            except Bad as e:
                yield Page(index, None, error=str(e))
                return
            try:
                yield self._page(index, fields)
            except Bad as e:
                yield Page(index, None, error=str(e))
            index += 1
            todo[:0] = [*fields.get(SUB_IFDS, ()), after]

    def _page(self, index: int, f: dict[int, tuple[int, ...]]) -> Page:
        one = lambda tag, default: (f.get(tag) or (default,))[0]
        width, height, samples, planar = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(PLANAR, 1)
        scheme, predictor, bits = one(COMPRESSION, RAW), one(PREDICTOR, 1), one(BITS, 1)
        if bits not in (8, 16) or len(set(f.get(BITS, (bits,)))) > 1:
            raise Bad(f"{bits} bits in a sample are not supported")
        if min(width, height, samples) < 1 or width * height * samples > MOST_PIXELS:
            raise Bad("no size, or too large a one")
        if predictor not in (1, 2):
            raise Bad(f"predictor {predictor} is not supported")
        tiled = TILES in f or TILE_WIDTH in f
        if tiled:
            across, down, offsets, counts = one(TILE_WIDTH, width), one(TILE_HEIGHT, height), f.get(TILES, f.get(STRIPS, ())), f.get(TILE_BYTES, f.get(STRIP_BYTES, ()))
        else:
            across, down, offsets, counts = width, min(one(ROWS, height), height), f.get(STRIPS, ()), f.get(STRIP_BYTES, ())
        if min(across, down) < 1 or across * down > MOST_PIXELS:
            raise Bad("strips or tiles have no size")
        if min((*offsets, *counts, 0)) < 0:
            raise Bad("strips or tiles lie before the file")
        columns, rows = -(-width // across), -(-height // down)
        planes, depth = (samples, 1) if planar == 2 else (1, samples)
        if len(offsets) < columns * rows * planes or len(counts) < len(offsets):
            raise Bad("strips or tiles are missing")
        kind = np.dtype(f"{self.order}u{bits // 8}")
        out = np.zeros((height, width, samples), kind.newbyteorder("="))
        for plane in range(planes):
            for k in range(columns * rows):
                at, n = offsets[plane * columns * rows + k], counts[plane * columns * rows + k]
                if at + n > len(self.data):
                    raise Bad("a strip or tile lies outside the file")
                y, x = k // columns * down, k % columns * across
                tall = down if tiled else min(down, height - y)
                size = tall * across * depth * kind.itemsize
                raw = decompress(self.data[at : at + n], scheme, size)
                if len(raw) < size:
                    raise Bad("a strip or tile is too short")
                block = np.frombuffer(raw, kind).reshape(tall, across, depth).astype(kind.newbyteorder("="))
                if predictor == 2:
                    np.cumsum(block, axis=1, dtype=block.dtype, out=block)
                part = block[: height - y, : width - x]
                out[y : y + part.shape[0], x : x + part.shape[1], plane if planar == 2 else slice(None)] = part[:, :, 0] if planar == 2 else part
        return Page(index, out, NAMES.get(scheme, str(scheme)), tiled, predictor)


def write(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 2, tile: tuple[int, int] | None = None, rows: int = STRIP_ROWS, order: str = "<", forms: list[tuple] | None = None) -> bytes:
    """A file of these pages (height x width, or height x width x samples; 8 or 16 bits), all in one form or each
    in its own of `forms` (scheme, predictor, tile)."""
    parts, link, size = [b"II*\0" if order == "<" else b"MM\0*", b""], 1, 8
    for n, pixels in enumerate(pages):
        if forms:
            scheme, predictor, tile = forms[n]
        pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
        high, wide, samples = pixels.shape
        kind = pixels.dtype.newbyteorder(order)
        across, down = tile or (wide, min(rows, high))
        data = []
        for y in range(0, high, down):
            for x in range(0, wide, across):
                block = pixels[y : y + down, x : x + across]
                if tile and block.shape[:2] != (down, across):
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
                data.append(compress(block.astype(kind).tobytes(), scheme))
        counts = [len(d) for d in data]
        offsets = (size + np.concatenate(([0], np.cumsum(counts)[:-1]))).astype(int).tolist()
        body = b"".join(data)
        body += b"\0" * (len(body) & 1)
        size += len(body)
        fields = [(WIDTH, 4, [wide]), (HEIGHT, 4, [high]), (BITS, 3, [pixels.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [across]), (TILE_HEIGHT, 4, [down]), (TILES, 4, offsets), (TILE_BYTES, 4, counts)] if tile else [(STRIPS, 4, offsets), (ROWS, 4, [down]), (STRIP_BYTES, 4, counts)]
        fields.sort()
        parts[link] += struct.pack(order + "I", size)
        extra_at, entries, extra = size + 2 + 12 * len(fields) + 4, b"", b""
        for tag, t, values in fields:
            packed = struct.pack(f"{order}{len(values)}{TYPES[t][0]}", *values)
            if len(packed) <= 4:
                value = packed.ljust(4, b"\0")
            else:
                value = struct.pack(order + "I", extra_at + len(extra))
                extra += packed + b"\0" * (len(packed) & 1)
            entries += struct.pack(order + "HHI", tag, t, len(values)) + value
        parts += [body, struct.pack(order + "H", len(fields)) + entries, b"", extra]
        link = len(parts) - 2
        size = extra_at + len(extra)
    parts[link] += struct.pack(order + "I", 0)
    return b"".join(parts)


def form_of(page: np.ndarray) -> tuple[int, int, tuple[int, int] | None]:
    """Scheme, predictor and tile of a text's page, by the CRC-32 of its samples: a quarter of the pages each is
    stored with LZW and PackBits, half of them with deflate; half of each as they are and half as differences,
    and of these half in strips and half in tiles."""
    h = zlib.crc32(page.tobytes())
    return (LZW, PACKBITS, DEFLATE, DEFLATE)[h & 3], 1 + (h >> 2 & 1), TILE if h >> 3 & 1 else None


def from_text(raw: bytes) -> bytes:
    """A text as a file: bytes 0 up to a positive multiple of ROW, one 8-bit sample a byte, pages of
    PAGE_ROWS rows, each in its form (form_of). Equal texts give equal files."""
    padded = raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW))
    grid = np.frombuffer(padded, np.uint8).reshape(-1, ROW)
    pages = [grid[y : y + PAGE_ROWS] for y in range(0, len(grid), PAGE_ROWS)]
    return write(pages, forms=[form_of(p) for p in pages])


def read_pages(media: DataFrame) -> DataFrame:
    """A row for each page of media (doc_id, media): doc_id, page, width, height, samples, bits,
    compression, tiled, predictor, pixels (samples in rows, chunky, in the machine's byte order of little
    end first), error.

    What is no TIFF file gives one row with page 0, an error and nulls; null media too. Repeated rows give
    repeated pages; other columns are not read.
    """
    schema = "doc_id long, page int, width int, height int, samples int, bits int, compression string, tiled boolean, predictor int, pixels binary, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 5, pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    if not data.is_valid:
                        raise Bad("null")
                    for p in Reader(data.as_py()).pages():
                        if p.pixels is None:
                            rows.append((doc, p.index, *[None] * 8, p.error))
                        else:
                            h, w, s = p.pixels.shape
                            rows.append((doc, p.index, w, h, s, p.pixels.dtype.itemsize * 8, p.compression, p.tiled, p.predictor, p.pixels.tobytes(), None))
                except Bad as e:
                    rows.append((doc, 0, *[None] * 8, str(e)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return map_arrow(media.select(F.col("doc_id").cast("long").alias("doc_id"), "media"), run, schema)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of docs (doc_id, text) as a TIFF file; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, at, raw in textkit.chunks(batch.column(1)):
                files = [from_text(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Of each file of stored (doc_id, n_bytes, media), read back page by page: payload_bytes,
    payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes, media_sha256, feature and n_pages.

    A null text is an empty one, and a null n_bytes stays null; files that this module has not stored may be
    read as well, if their pages are of one width; a page that cannot be read is an error of the job.
    Repeated rows give repeated rows, other columns are not read.

    feature is "<pages>x<width>x<rows>:<mean sample, 1/1000>:<64-bit mean hash>": each bit tells whether
    the mean of one of 8 x 8 areas of all rows is above the whole mean.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]

    def feature(pages: list[np.ndarray]) -> str:
        grid = np.concatenate(pages)[:, :, 0]
        edges = np.linspace(0, len(grid), 9).astype(int)
        total = np.concatenate((np.zeros((1, 8)), np.cumsum(grid.reshape(len(grid), 8, -1).sum(2, dtype=np.int64), axis=0)))
        count = np.maximum(edges[1:] - edges[:-1], 1)[:, None] * (grid.shape[1] // 8)
        area = (total[edges[1:]] - total[edges[:-1]]) / count
        mean = int(grid.sum(dtype=np.int64)) * 1000 // grid.size
        bits = "".join("1" if x * 1000 > mean else "0" for x in area.ravel())
        return f"{len(pages)}x{grid.shape[1]}x{len(grid)}:{mean}:{int(bits, 2):016x}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2):
                media = data.as_py()
                pages = []
                for p in Reader(media).pages():
                    if p.pixels is None:
                        raise Bad(p.error)
                    pages.append(p.pixels)
                payload = b"".join(p.tobytes() for p in pages)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages), len(pages)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]], names)

    return map_arrow(stored.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")
