"""Image encoders of the standard library alone, as columns: PPM, PNG and deflated TIFF of 8 or 16 bits."""

from __future__ import annotations

import os
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ppm(px: np.ndarray) -> bytes:
    return f"P6\n{px.shape[1]} {px.shape[0]}\n255\n".encode() + px.astype(np.uint8).tobytes()


def png(px: np.ndarray) -> bytes:
    """8-bit RGB, unfiltered rows."""
    h, w, _ = px.shape
    raw = np.zeros((h, 1 + 3 * w), np.uint8)
    raw[:, 1:] = px.reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def tiff(px: np.ndarray) -> bytes:
    """RGB of the array's depth, one deflated strip."""
    h, w, _ = px.shape
    bits = px.dtype.itemsize * 8
    data = zlib.compress(px.astype(px.dtype.newbyteorder("<")).tobytes(), 6)
    data += b"\0" * (len(data) % 2)
    depth_at = 8 + len(data)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, depth_at), (259, 3, 1, 8), (262, 3, 1, 2), (273, 4, 1, 8), (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, len(data)), (284, 3, 1, 1)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"
    return struct.pack("<2sHI", b"II", 42, depth_at + 6) + data + struct.pack("<HHH", bits, bits, bits) + ifd


ENCODERS = {"ppm": ppm, "png": png, "tiff": tiff}


def encode(rgb: DataFrame, kind: str) -> DataFrame:
    """(photo, image): each photo's (y, x, r, g, b) pixels as one file's bytes. A photo is a group, as a file is."""
    to = ENCODERS[kind]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        px = rows[["r", "g", "b"]].to_numpy().astype(np.uint8).reshape(rows["y"].nunique(), -1, 3)
        return pd.DataFrame({"photo": [rows["photo"].iloc[0]], "image": [to(px)]})

    return rgb.select("photo", "y", "x", "r", "g", "b").groupBy("photo").applyInPandas(run, "photo long, image binary")


def size(head: bytes) -> tuple[int, int]:
    """(width, height) of a PNG, TIFF or JPEG; (0, 0) if it can't be told."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack_from(">II", head, 16)
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(head) and head[at] == 0xFF:
            if head[at + 1] in (0xC0, 0xC1, 0xC2):
                h, w = struct.unpack_from(">HH", head, at + 5)
                return w, h
            at += 2 + struct.unpack_from(">H", head, at + 2)[0]
        return 0, 0
    if head[:4] in (b"II*\0", b"MM\0*"):
        from .raw import Container

        try:
            for _, _, tags in Container(head).directories():
                if 256 in tags and 257 in tags:
                    return int(tags[256][2][0]), int(tags[257][2][0])
        except (ValueError, struct.error):
            pass
    return 0, 0


def write(images: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Writes (name, image) rows as files of a folder that all executors share, each to a temporary name first and then in place, so a task that runs again leaves whole files; (name, bytes) of what was written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, image in zip(batch["name"], batch["image"]):
                fd, part = tempfile.mkstemp(dir=folder)
                with os.fdopen(fd, "wb") as f:
                    f.write(image)
                os.replace(part, os.path.join(folder, f"{name}{suffix}"))
            yield pd.DataFrame({"name": batch["name"], "bytes": batch["image"].map(len)})

    return images.select(F.col("name").cast("string").alias("name"), "image").mapInPandas(run, "name string, bytes long")
