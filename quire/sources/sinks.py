"""Pages as image files: encoders as Column functions and a Spark data source that writes
one file a page."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def encode_column(kind: str) -> Column:
    """pgm or ppm from gray ``pixels``, ``width`` and ``height``, in the JVM (pgm only)."""
    if kind != "pgm":
        raise ValueError(f"{kind!r} is written by encode_gray")
    header = F.concat(F.lit("P5\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(header, "us-ascii"), F.col("pixels"))


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(rows: np.ndarray, kind: int) -> bytes:
    """From (height, width x channels) bytes; every row is filtered by Paeth's predictor. It guesses a row
    that is like the one above it without a difference, so only the others are worked out."""
    step = {0: 1, 2: 3, 6: 4}[kind]
    h, stride = rows.shape
    lines = np.zeros((h, stride + 1), np.uint8)
    lines[:, 0] = 4
    new = np.ones(h, bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    x, up = rows[at].astype("i2"), np.zeros((len(at), stride), "i2")
    up[1:] = rows[at[1:] - 1]
    left, corner = np.zeros_like(x), np.zeros_like(x)
    left[:, step:], corner[:, step:] = x[:, :-step], up[:, :-step]
    da, db = up - corner, left - corner  # the guess less what is to the left, and less what is above
    dc = np.abs(da + db)
    da, db = np.abs(da), np.abs(db)
    best = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
    lines[at, 1:] = (x - best) & 255
    lines = lines.tobytes()
    head = struct.pack(">IIBBBBB", stride // step, h, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + png_chunk(b"IHDR", head) + png_chunk(b"IDAT", zlib.compress(lines, 1)) + png_chunk(b"IEND", b"")


def rgb_rows(pixels: bytes, width: int, height: int, mode: str) -> np.ndarray:
    """(height, 3 x width) RGB bytes of pixels in one of the pixel modes."""
    n = {"Mono8": 1, "Rgb8": 3, "Bgr8": 3, "Xbgr8": 4, "Cmyk8": 4, "DeviceN8": 8}.get(mode)
    if mode == "Mono1":
        bits = np.unpackbits(np.frombuffer(pixels, np.uint8).reshape(height, -1), axis=1)[:, :width]
        v = np.repeat(bits[:, :, None] * 255, 3, axis=2)
    elif n is None:
        raise ValueError(f"unknown pixel mode {mode!r}")
    else:
        v = np.frombuffer(pixels, np.uint8).reshape(height, width, n)
        if mode == "Mono8":
            v = np.repeat(v, 3, axis=2)
        elif mode in ("Bgr8", "Xbgr8"):
            v = v[:, :, ::-1][:, :, -3:] if mode == "Bgr8" else v[:, :, 3:0:-1]
        elif n >= 4:  # of DeviceN the process colours
            c = v.astype("i4")
            v = np.clip(255 - c[:, :, :3] - c[:, :, 3:4], 0, 255)
    return v.astype(np.uint8).reshape(height, -1)


def encode_page(pixels: bytes, width: int, height: int, channels: int, kind: str, alpha: bytes | None = None) -> bytes:
    """A file of a page of 1 or 3 channels: pgm, ppm, png (with an alpha plane if given), or pbm
    with ink below the middle. Gray pages as ppm and colour pages as pgm are converted."""
    if len(pixels) != width * height * channels:
        raise ValueError(f"{len(pixels)} pixels for {width} x {height} x {channels}")
    rows = np.frombuffer(pixels, np.uint8).reshape(height, width * channels)
    size = b"%d %d\n" % (width, height)
    if kind == "png" and alpha is not None:
        rgb = rows.reshape(height, width, channels)
        plane = np.frombuffer(alpha, np.uint8).reshape(height, width, 1)
        return png(np.concatenate([np.broadcast_to(rgb, (height, width, 3)), plane], axis=2).reshape(height, -1), 6)
    if kind == "png":
        return png(rows, 0 if channels == 1 else 2)
    if kind == "ppm":
        return b"P6\n" + size + b"255\n" + (rows if channels == 3 else np.repeat(rows, 3, axis=1)).tobytes()
    if channels == 3:
        from quire.drawing.page import luma

        rows = luma(rows.reshape(height, width, 3))
    if kind == "pgm":
        return b"P5\n" + size + b"255\n" + rows.tobytes()
    if kind == "pbm":
        return b"P4\n" + size + np.packbits(rows < 128, axis=1).tobytes()
    raise ValueError(f"unsupported format {kind!r}")


def encode_gray(pixels: bytes, width: int, height: int, kind: str) -> bytes:
    return encode_page(pixels, width, height, 1, kind)


class PageWriter(DataSourceArrowWriter):
    """Files are written under a name of their own and then renamed, so a task that runs
    again leaves whole files. The path must be one that all executors share."""

    def __init__(self, options: dict):
        self.path, self.kind, self.digits = options["path"], options.get("kind", "pgm"), int(options.get("digits", "4"))

    def write(self, batches: Iterator) -> WriterCommitMessage:
        import os
        import uuid

        n = 0
        os.makedirs(self.path, exist_ok=True)
        for batch in batches:
            for row in batch.to_pylist():
                if row["pixels"] is None:
                    continue
                name = f"{row['doc_id']}-{row['page_num']:0{self.digits}d}.{self.kind}".replace("/", "_")
                own = os.path.join(self.path, f".{uuid.uuid4().hex}")
                with open(own, "wb") as f:
                    f.write(encode_page(row["pixels"], row["width"], row["height"], row["channels"], self.kind))
                os.replace(own, os.path.join(self.path, name))
                n += 1
        return PagesWritten(n)


class PagesWritten(WriterCommitMessage):
    def __init__(self, n: int):
        self.n = n


class PageSink(DataSource):
    """``df.write.format("pages").option("kind", "png").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "doc_id string, page_num int, width int, height int, channels int, pixels binary"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(dict(self.options))


def write_pages(pages: DataFrame, path: str, kind: str = "pgm") -> None:
    spark = pages.sparkSession
    spark.dataSource.register(PageSink)
    rows = pages.select(F.col("doc_id").cast("string").alias("doc_id"), "page_num", "width", "height", F.coalesce("channels", F.lit(1)).alias("channels"), "pixels")
    rows.write.format("pages").option("kind", kind).option("path", path).mode("append").save()
