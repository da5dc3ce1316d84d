"""TIFF images in a media column: directories, strips and tiles, PackBits, LZW and deflate, predictors."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import FLUSH_BYTES, bounded_batches, in_slices

#: Compression codes, and struct codes of the field types 1 to 12.
NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
CLEAR, EOI, FIRST = 256, 257, 258
#: Codes after a Clear until the table of 4094 entries is full; the width of each follows from its place.
SPAN = 4094 - FIRST + 1
#: Directories of one file and bytes of one page that a reader accepts; beyond, the file's error says so.
MOST_PAGES, MOST_BYTES = 1 << 20, 1 << 31


def _widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a Clear, for the early change of TIFF's LZW: the reader's table has k - 1 new entries before code k."""
    size = FIRST + np.maximum(np.arange(n) - 1, -1) + 1
    return 9 + (size >= 511) + (size >= 1023) + (size >= 2047)


_WIDTH = _widths(SPAN + 2)
_END = np.cumsum(_WIDTH)


def lzw_encode(data: bytes) -> bytes:
    segments: list[list[int]] = []
    codes: list[int] = []
    fresh = {bytes([i]): i for i in range(256)}
    table, w = dict(fresh), b""
    size = FIRST
    for k in range(len(data)):
        c = data[k : k + 1]
        wc = w + c
        if wc in table:
            w = wc
            continue
        codes.append(table[w])
        table[wc] = size
        size += 1
        if len(codes) == SPAN - 1:
            segments.append([*codes, CLEAR])
            codes, table, size = [], dict(fresh), FIRST
        w = c
    if w:
        codes.append(table[w])
    segments.append([*codes, EOI])
    values = np.concatenate([[CLEAR], *segments]).astype(np.uint32)
    widths = np.concatenate([[9], *(_WIDTH[: len(s)] for s in segments)])
    bits = ((values[:, None] << np.arange(20, 32, dtype=np.uint32)) >> 31).astype(np.uint8)  # the 12 low bits, high first
    return np.packbits(bits[np.arange(12) >= 12 - widths[:, None]]).tobytes()


def lzw_decode(data: bytes, most: int = 0) -> bytes:
    """Stops once there are `most` bytes, if given."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    at = size = 0
    while at + 9 <= len(bits) and not (most and size >= most):
        n = int(np.searchsorted(_END, len(bits) - at, "right"))
        width, end = _WIDTH[:n], at + _END[:n]
        padded = np.zeros((n, 12), np.uint8)
        take = end[:, None] - 12 + np.arange(12)
        keep = np.arange(12) >= 12 - width[:, None]
        padded[keep] = bits[take[keep]]
        codes = padded.astype(np.int64) @ (1 << np.arange(11, -1, -1))
        stop = np.flatnonzero((codes == CLEAR) | (codes == EOI))
        last = int(stop[0]) if len(stop) else n
        table, previous = list(base), b""
        for code in codes[:last].tolist():
            if not previous:
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                table.append(previous + entry[:1])
            elif code == len(table):
                entry = previous + previous[:1]
                table.append(entry)
            else:
                raise ValueError(f"LZW code {code} is beyond the table")
            out.append(entry)
            previous = entry
            size += len(entry)
            if most and size >= most:
                break
        if not len(stop) or codes[last] == EOI:
            break
        at = int(end[last])
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    out: list[bytes] = []

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            out.append(bytes([min(128, b - k) - 1]) + data[k : min(b, k + 128)])

    at = 0
    for m in _RUN.finditer(data):
        literal(at, m.start())
        out.append(bytes([257 - (m.end() - m.start()), data[m.start()]]))
        at = m.end()
    literal(at, len(data))
    return b"".join(out)


def packbits_decode(data: bytes, most: int = 0) -> bytes:
    """Stops once there are `most` bytes, if given."""
    out: list[bytes] = []
    at = size = 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
        size += len(out[-1]) if n != 128 else 0
        if most and size >= most:
            break
    return b"".join(out)


def inflate(data: bytes, most: int) -> bytes:
    """Stops at the size the directory gives, whatever the stream claims."""
    return zlib.decompressobj().decompress(data, most or 1)


_ENCODE = {NONE: lambda x: x, PACKBITS: packbits_encode, LZW: lzw_encode, ADOBE_DEFLATE: lambda x: zlib.compress(x, 6), DEFLATE: lambda x: zlib.compress(x, 6)}


def _decode(data: bytes, compression: int, most: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_decode(data, most)
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (ADOBE_DEFLATE, DEFLATE):
        return inflate(data, most)
    raise ValueError(f"compression {compression} isn't known")


def difference(rows: np.ndarray, predictor: int) -> np.ndarray:
    """Rows (height, width, samples) with each sample less its left neighbour (2), or as they are (1)."""
    if predictor == 1:
        return rows
    if predictor == 2 and rows.dtype.kind == "u":
        out = rows.copy()
        out[:, 1:] -= rows[:, :-1]
        return out
    if predictor == 3 and rows.dtype.kind == "f":
        h, w, s = rows.shape
        planes = rows.astype(rows.dtype.newbyteorder(">")).view(np.uint8).reshape(h, w * s, -1).transpose(0, 2, 1).reshape(h, -1)
        return np.concatenate([planes[:, :s], planes[:, s:] - planes[:, :-s]], axis=1)
    raise ValueError(f"predictor {predictor} isn't known for {rows.dtype}")


def undo(data: bytes, h: int, w: int, s: int, kind: np.dtype, predictor: int) -> np.ndarray:
    need = h * w * s * kind.itemsize
    if len(data) < need:
        raise ValueError(f"{len(data)} bytes where {need} are needed")
    if predictor == 3:
        raw = np.frombuffer(data, np.uint8, need).reshape(h, -1, s)
        planes = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(h, kind.itemsize, w * s)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).astype(kind.newbyteorder("=")).reshape(h, w, s)
    rows = np.frombuffer(data, kind, h * w * s).reshape(h, w, s).astype(kind.newbyteorder("="))
    if predictor == 2:
        return np.cumsum(rows, axis=1, dtype=rows.dtype)
    if predictor == 1:
        return rows
    raise ValueError(f"predictor {predictor} isn't known")


@dataclass
class Page:
    """One directory's image: samples (height, width, samples a pixel)."""

    pixels: np.ndarray
    compression: int = NONE
    predictor: int = 1
    tile: int = 0  # side of square tiles, a multiple of 16; 0: strips
    rows_per_strip: int = 0  # 0: all


def write_tiff(pages: list[Page], endian: str = "<") -> bytes:
    """A classic TIFF of these pages, chunky samples."""
    out = bytearray((b"II" if endian == "<" else b"MM") + struct.pack(endian + "HI", 42, 0))
    link = 4
    for page in pages:
        px = page.pixels
        h, w, s = px.shape
        kind = px.dtype.newbyteorder(endian)
        parts: list[bytes] = []
        if page.tile:
            side = page.tile
            for y in range(0, h, side):
                for x in range(0, w, side):
                    block = np.zeros((side, side, s), px.dtype)
                    own = px[y : y + side, x : x + side]
                    block[: own.shape[0], : own.shape[1]] = own
                    parts.append(_bytes(block, kind, page))
        else:
            step = page.rows_per_strip or h
            parts = [_bytes(px[y : y + step], kind, page) for y in range(0, h, step)]
        offsets = []
        for part in parts:
            offsets.append(len(out))
            out += part + b"\0" * (len(part) % 2)
        form = {"u": 1, "i": 2, "f": 3}[px.dtype.kind]
        tags: list[tuple[int, int, list[int]]] = [(256, 4, [w]), (257, 4, [h]), (258, 3, [px.dtype.itemsize * 8] * s), (259, 3, [page.compression]), (262, 3, [2 if s >= 3 else 1]), (277, 3, [s]), (284, 3, [1]), (317, 3, [page.predictor]), (339, 3, [form] * s)]
        if page.tile:
            tags += [(322, 3, [page.tile]), (323, 3, [page.tile]), (324, 4, offsets), (325, 4, [len(p) for p in parts])]
        else:
            tags += [(273, 4, offsets), (278, 4, [page.rows_per_strip or h]), (279, 4, [len(p) for p in parts])]
        entries = []
        for code, kind_code, values in sorted(tags):
            packed = struct.pack(f"{endian}{len(values)}{FIELDS[kind_code]}", *values)
            if len(packed) > 4:
                at = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack(endian + "I", at)
            entries.append(struct.pack(endian + "HHI", code, kind_code, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into(endian + "I", out, link, len(out))
        out += struct.pack(endian + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _bytes(block: np.ndarray, kind: np.dtype, page: Page) -> bytes:
    rows = difference(block, page.predictor)
    return _ENCODE[page.compression](rows.tobytes() if page.predictor == 3 else rows.astype(kind).tobytes())


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tag values of each directory along the chain; a link back ends it."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF header")
    e = "<" if data[:1] == b"I" else ">"
    at, seen = struct.unpack_from(e + "I", data, 4)[0], set()
    while at and at not in seen:
        if len(seen) >= MOST_PAGES:
            raise ValueError("too many directories")
        seen.add(at)
        (n,) = struct.unpack_from(e + "H", data, at)
        tags: dict[int, tuple] = {}
        for k in range(n):
            code, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
            if kind not in FIELDS:
                continue
            form = f"{e}{count}s" if FIELDS[kind] == "s" else e + FIELDS[kind] * count if len(FIELDS[kind]) > 1 else f"{e}{count}{FIELDS[kind]}"
            where = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                (where,) = struct.unpack_from(e + "I", data, where)
            tags[code] = struct.unpack_from(form, data, where)
        tags[0] = (e,)
        yield tags
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)


def read_page(data: bytes, tags: dict[int, tuple]) -> Page:
    first = lambda code, default: tags.get(code, (default,))[0]
    w, h, s = first(256, 0), first(257, 0), first(277, 1)
    bits, form, predictor, compression = first(258, 1), first(339, 1), first(317, 1), first(259, NONE)
    if bits not in (8, 16, 32, 64) or first(284, 1) != 1:
        raise ValueError(f"{bits} bits a sample, planar configuration {first(284, 1)}")
    kind = np.dtype({1: "u", 2: "i", 3: "f"}[form] + str(bits // 8)).newbyteorder(tags[0][0])
    if w * h * s * kind.itemsize > MOST_BYTES:
        raise ValueError("the page is too large")
    if tile := first(322, 0):
        tall = first(323, tile)
        pixels = np.zeros((h, w, s), kind.newbyteorder("="))
        grid = [(y, x) for y in range(0, h, tall) for x in range(0, w, tile)]
        if len(grid) != len(tags[324]):
            raise ValueError(f"{len(tags[324])} tiles where {len(grid)} are needed")
        for (y, x), at, n in zip(grid, tags[324], tags[325]):
            block = undo(_decode(data[at : at + n], compression, tall * tile * s * kind.itemsize), tall, tile, s, kind, predictor)
            own = pixels[y : y + tall, x : x + tile]
            own[:] = block[: own.shape[0], : own.shape[1]]
        return Page(pixels, compression, predictor, tile)
    step = min(first(278, h), h) or 1
    rows = []
    for k, (at, n) in enumerate(zip(tags[273], tags[279])):
        tall = min(step, h - k * step)
        rows.append(undo(_decode(data[at : at + n], compression, tall * w * s * kind.itemsize), tall, w, s, kind, predictor))
    return Page(np.concatenate(rows), compression, predictor, 0, step)


COLUMNS = "page int, width long, height long, samples int, bits int, compression int, predictor int, n_blocks int, layout string, pixels binary, error string"


def tiff_pages(media: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """One row for each page of each TIFF of content_col: (id, page, width, height, samples, bits, compression, predictor, n_blocks, layout, pixels, error).

    Pixels are the decoded samples, row by row, in the machine's little-endian order. A file or page that can't be
    read, null content included, gives a row with error instead of failing the job; pages before it stay. Rows
    repeat as the input does; other columns are ignored; an empty table gives no rows. Narrow: no shuffle, memory bounded by one file and its pages, whatever a compressed strip claims.
    """
    bounded_batches(media.sparkSession, 128)
    kind = media.schema[id_col].dataType.simpleString()
    names = ["id", *(x.split()[0] for x in COLUMNS.split(", "))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 64):
            rows, size = [], 0
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = 0
                try:
                    for tags in directories(data or b""):
                        page = read_page(data, tags)
                        px = page.pixels
                        n = len(tags[324] if page.tile else tags[273])
                        rows.append((key, k, px.shape[1], px.shape[0], px.shape[2], px.dtype.itemsize * 8, page.compression, page.predictor, n, "tiles" if page.tile else "strips", px.tobytes(), None))
                        size += px.nbytes
                        k += 1
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    rows.append((key, k, *[None] * 9, str(e)[:200]))
                if size > FLUSH_BYTES:
                    yield _batch(rows, names, batch.schema.field(0).type)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, names, batch.schema.field(0).type)

    return media.select(media[id_col].alias("id"), media[content_col].alias("content")).mapInArrow(read, f"id {kind}, {COLUMNS}")


def _batch(rows: list[tuple], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.string(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded with 0 to a positive multiple of width, as the samples of a one-page 8-bit TIFF.

    The bytes' checksum picks the coding, so equal texts give equal files and all codings are in use.
    Null is empty; repeated rows and null ids stay; other columns are ignored; an empty table gives no rows. A text of any length is one file. Narrow.
    """
    bounded_batches(docs.sparkSession, 128)
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 64):
            keys, lengths, files, size = [], [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                text = text or b""
                padded = text.ljust(max(1, -(-len(text) // width)) * width, b"\0")
                pick = zlib.crc32(padded)
                pixels = np.frombuffer(padded, np.uint8).reshape(-1, width, 1)
                compression = (PACKBITS, LZW, ADOBE_DEFLATE)[pick % 3]
                tile = (0, 16)[pick // 3 % 2]
                media = write_tiff([Page(pixels, compression, 1 + pick // 6 % 2, tile, 128)], "<>"[pick // 12 % 2])
                keys.append(key)
                lengths.append(len(text))
                files.append(media)
                size += len(media)
                if size > FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(lengths, pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])
                    keys, lengths, files, size = [], [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(lengths, pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(write, f"id {kind}, n_bytes long, media binary")
