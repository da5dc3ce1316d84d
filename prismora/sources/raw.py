"""RAW containers: TIFF directory trees, summaries, uncompressed Bayer payloads and embedded previews."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes and struct codes of the field types, links to other directories, and names of tags.
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
SUB_IFDS, EXIF_IFD = 330, 34665
NAMES = {
    256: "width", 257: "height", 258: "bits_per_sample", 259: "compression", 262: "photometric", 271: "make", 272: "model", 273: "strip_offsets", 274: "orientation", 277: "samples_per_pixel",
    279: "strip_byte_counts", 322: "tile_width", 323: "tile_length", 324: "tile_offsets", 325: "tile_byte_counts", 513: "jpeg_offset", 514: "jpeg_length", 33421: "cfa_dim", 33422: "cfa_pattern",
    33434: "exposure_time", 33437: "aperture", 34855: "iso", 36867: "taken", 37386: "focal_length", 50706: "dng_version", 50714: "black_level", 50717: "white_level", 50721: "color_matrix", 50728: "as_shot_neutral",
}
TAGS = "path string, ifd int, offset long, tag int, name string, type int, count long, num array<double>, str string, bin binary, error string"


class Container:
    """A TIFF file's bytes, read directory by directory. Links are followed breadth first; one that was seen ends its way."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        if data[:4] not in (b"II*\0", b"MM\0*"):
            raise ValueError("not a TIFF container")
        self.e = "<" if data[:1] == b"I" else ">"

    def _unpack(self, form: str, at: int) -> tuple:
        if at + struct.calcsize(self.e + form) > len(self.data):
            raise ValueError("a directory ends outside the file")
        return struct.unpack_from(self.e + form, self.data, at)

    def directories(self) -> Iterator[tuple[int, int, dict[int, tuple[int, int, tuple]]]]:
        """(number, offset, tag -> (type, count, values))."""
        queue, seen, number = [self._unpack("I", 4)[0]], set(), 0
        while queue:
            at = queue.pop(0)
            if not at or at in seen:
                continue
            seen.add(at)
            (n,) = self._unpack("H", at)
            tags = dict(self._entry(at + 2 + 12 * k) for k in range(n))
            yield number, at, {code: v for code, v in tags.items() if v is not None}
            number += 1
            queue.append(self._unpack("I", at + 2 + 12 * n)[0])
            for link in (SUB_IFDS, EXIF_IFD):
                if tags.get(link):
                    queue += [int(v) for v in tags[link][2]]

    def _entry(self, at: int) -> tuple[int, tuple[int, int, tuple] | None]:
        code, kind, count = self._unpack("HHI", at)
        if kind not in FIELDS:
            return code, None
        unit = FIELDS[kind]
        form = f"{count}s" if unit == "s" else unit * count if len(unit) > 1 else f"{count}{unit}"
        where = at + 8
        if struct.calcsize(self.e + form) > 4:
            (where,) = self._unpack("I", where)
        return code, (kind, count, self._unpack(form, where))


def _value(kind: int, values: tuple) -> tuple[list[float | None] | None, str | None, bytes | None]:
    """(numbers, text, bytes): text stops at NUL, a rational of denominator 0 is null."""
    if kind == 2:
        return None, values[0].split(b"\0")[0].decode("ascii", "replace"), None
    if kind == 7:
        return None, None, values[0]
    if kind in (5, 10):
        return [a / b if b else None for a, b in zip(values[::2], values[1::2])], None, None
    return [float(v) for v in values], None, None


def read_tags(files: DataFrame) -> DataFrame:
    """One row for each tag of each directory of (path, content); a file that isn't a container has one row with error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TAGS.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    for number, at, tags in Container(bytes(content or b"")).directories():
                        rows += [(path, number, at, code, NAMES.get(code), kind, count, *_value(kind, values), None) for code, (kind, count, values) in tags.items()]
                except (ValueError, struct.error) as e:
                    rows.append((path, *[None] * 9, str(e)))
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, TAGS)


def summary(tags: DataFrame) -> DataFrame:
    """(path, num: name -> first number, str: name -> text): the first hit of each tag, directories of larger images first."""
    size = tags.where(F.col("name").isin("width", "height")).groupBy("path", "ifd").agg(F.max(F.when(F.col("name") == "width", F.col("num")[0])).alias("w"), F.max(F.when(F.col("name") == "height", F.col("num")[0])).alias("h"))
    ranked = tags.where("name is not null").join(size, ["path", "ifd"], "left").withColumn("area", F.coalesce(F.col("w") * F.col("h"), F.lit(0.0)))
    best = ranked.groupBy("path", "name").agg(F.max_by(F.struct("num", "str"), F.struct("area", -F.col("ifd"))).alias("v"))
    return best.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", F.get("v.num", F.lit(0)).alias("v")))).alias("num"), F.map_from_entries(F.collect_list(F.struct("name", F.col("v.str").alias("v")))).alias("str"))


def bayer_rows(files: DataFrame) -> DataFrame:
    """(path, y, px, error): the samples of each file's largest uncompressed mosaic of 12, 14 or 16 bits a sample, in strips or 16-bit tiles, a row at a time; a file that has none gives one row with error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    px = mosaic(bytes(content or b""))
                    yield pd.DataFrame({"path": path, "y": range(len(px)), "px": list(px.astype(np.int32)), "error": None})
                except (ValueError, KeyError, struct.error) as e:
                    yield pd.DataFrame({"path": [path], "y": [None], "px": [None], "error": [str(e)]}).astype({"y": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, y int, px array<int>, error string")


def mosaic(data: bytes) -> np.ndarray:
    box = Container(data)
    found = [{c: v for c, (_, _, v) in tags.items()} for _, _, tags in box.directories()]
    found = [t for t in found if (273 in t or 324 in t) and 256 in t and 257 in t]
    if not found:
        raise ValueError("no image directory")
    t = max(found, key=lambda t: t[256][0] * t[257][0])
    w, h, bits = t[256][0], t[257][0], t.get(258, (16,))[0]
    if t.get(259, (1,))[0] != 1 or bits not in (12, 14, 16) or t.get(277, (1,))[0] != 1:
        raise ValueError(f"compression {t.get(259, (1,))[0]}, {bits} bits, {t.get(277, (1,))[0]} samples a pixel")
    word = np.dtype("u2").newbyteorder(box.e)
    if 324 in t:
        tw, th = t[322][0], t[323][0]
        across, down = -(-w // tw), -(-h // th)
        if bits != 16 or len(t[324]) != across * down:
            raise ValueError("tiles don't fit the image")
        out = np.zeros((down * th, across * tw), np.uint16)
        for k, at in enumerate(t[324]):
            y, x = k // across * th, k % across * tw
            out[y : y + th, x : x + tw] = np.frombuffer(data, word, tw * th, at).reshape(th, tw)
        return out[:h, :w]
    payload = b"".join(data[a : a + n] for a, n in zip(t[273], t[279]))
    row = -(-w * bits // 8)
    if len(payload) != h * row:
        raise ValueError(f"{len(payload)} bytes where {h * row} are needed")
    if bits == 16:
        return np.frombuffer(payload, word).reshape(h, w).astype(np.uint16)
    b = np.unpackbits(np.frombuffer(payload, np.uint8).reshape(h, row), axis=1)[:, : w * bits].reshape(h, w, bits)
    return (b @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint16)


def embedded_preview(content: Column, offset: Column, length: Column) -> Column:
    """The embedded JPEG's bytes, null unless they begin as one does."""
    part = F.substring(content, offset.cast("int") + 1, length.cast("int"))
    return F.when(F.hex(F.substring(part, 1, 2)) == "FFD8", part)


def read_files(spark: SparkSession, folder: str, limit: int = 200) -> DataFrame:
    """(path, content) of a folder's RAW files, the first by name; suffixes are filtered before a file is opened."""
    from .paths import discover

    found = spark.read.format("binaryFile").load(folder)
    chosen = discover(found.select("path"), limit)
    return found.join(F.broadcast(chosen), "path", "left_semi").select("path", "content")  # at most `limit` names


def synthetic(width: int = 16, height: int = 16, bits: int = 16, e: str = "<") -> bytes:
    """A container of a gradient mosaic, black 64 and white 4095, as tests read it."""
    y, x = np.mgrid[0:height, 0:width]
    v = 0.12 + 0.62 * x / max(1, width - 1) + 0.18 * y / max(1, height - 1)
    v = np.where((y % 2 == 0) & (x % 2 == 0), v * 1.08, np.where((y % 2 == 1) & (x % 2 == 1), v * 0.92, v))
    dn = np.rint(64 + np.clip(v, 0.02, 0.95) * (4095 - 64)).astype(np.uint16)
    if bits == 16:
        payload = dn.astype(np.dtype("u2").newbyteorder(e)).tobytes()
    else:
        payload = np.packbits(((dn[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).reshape(height, -1), axis=1).tobytes()
    tags = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (bits,)), (259, 3, (1,)), (262, 3, (32803,)), (271, 2, (b"Maker\0",)), (272, 2, (b"Model One\0",)), (273, 4, (8,)), (277, 3, (1,)), (278, 4, (height,)), (279, 4, (len(payload),)), (33421, 3, (2, 2)), (33422, 1, (0, 1, 1, 2)), (50706, 1, (1, 4, 0, 0)), (50714, 3, (64,)), (50717, 3, (4095,)), (50728, 5, (1, 1, 1, 1, 1, 1))]
    out = bytearray(b"\0" * 8) + payload + b"\0" * (len(payload) % 2)
    entries = b""
    for code, kind, values in tags:
        unit = FIELDS[kind]
        n = len(values[0]) if unit == "s" else len(values) // len(unit)
        packed = values[0] if unit == "s" else struct.pack(e + unit * n, *values)
        if len(packed) > 4:
            at = len(out)
            out += packed + b"\0" * (len(packed) % 2)
            packed = struct.pack(e + "I", at)
        entries += struct.pack(e + "HHI", code, kind, n) + packed.ljust(4, b"\0")
    struct.pack_into(e + "2sHI", out, 0, b"II" if e == "<" else b"MM", 42, len(out))
    return bytes(out + struct.pack(e + "H", len(tags)) + entries + b"\0\0\0\0")
