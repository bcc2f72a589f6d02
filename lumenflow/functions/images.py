"""EXIF values and classical measures of gray images (pixel arrays as inputs; decoders are injected)."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exif_time(text) -> Column:
    return F.try_to_timestamp(F.trim(text), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def exposure_text(seconds) -> Column:
    """1/200 under a second, else up to six significant digits; null up to zero."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    places = lambda k: F.regexp_replace(F.format_string(f"%.{k}f", s), r"\.?0+$", "") if k else F.format_string("%.0f", s)
    long = F.regexp_replace(F.format_string("%.5e", s), r"\.?0+e", "e")
    for k in range(6):  # so many decimals leave six significant digits
        long = F.when(s < 10 ** (6 - k) - 0.5 * 10**-k, places(k)).otherwise(long)
    return F.substring(F.when(s <= 0, None).when(s >= 1, long).otherwise(F.concat(F.lit("1/"), F.bround(1 / s, 0).cast("long").cast("string"))), 1, 30)


def number(text) -> Column:
    """The first number of "a,b" or "(a, b)"; null if it isn't one."""
    return F.trim(F.regexp_extract(text, r"^\s*[(\[]?\s*([^,)\]]*)", 1)).try_cast("double")


def clean_text(text, limit: int = 100) -> Column:
    t = F.substring(F.trim(F.replace(text, F.lit("\0"), F.lit(""))), 1, limit)
    return F.when(t != "", t)


def oriented(width, height, orientation) -> tuple[Column, Column]:
    """Width and height as shown; orientations 5 to 8 swap them."""
    swap = F.coalesce(F.col(orientation).isin(5, 6, 7, 8), F.lit(False))
    return F.when(swap, F.col(height)).otherwise(F.col(width)), F.when(swap, F.col(width)).otherwise(F.col(height))


def classical(gray: np.ndarray) -> tuple[float, float, float, float]:
    """Laplacian variance (edges mirrored), share of highlights (250 and up), of shadows (5 and under), mean."""
    return tuple(float(x[0]) for x in _classical(gray[None]))


def _classical(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``classical`` of several images of one size."""
    g = np.pad(gray.astype(np.float64), ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    lap = g[:, :-2, 1:-1] + g[:, 2:, 1:-1] + g[:, 1:-1, :-2] + g[:, 1:-1, 2:] - 4 * g[:, 1:-1, 1:-1]
    over = (1, 2)
    return lap.var(axis=over), (gray >= 250).mean(axis=over), (gray <= 5).mean(axis=over), gray.mean(axis=over)


#: Pixels that are measured at once, about.
PIXELS = 1 << 20


def measured(images: DataFrame, decode: Callable[[bytes], np.ndarray | None]) -> DataFrame:
    """(path, sharpness, highlights, shadows, luma, status) of binary files; one that can't be decoded gets its status. Images of one size are measured together."""
    names = ["sharpness", "highlights", "shadows", "luma"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, status = np.full((len(pdf), 4), np.nan), ["ok"] * len(pdf)
            waiting: dict[tuple, list] = {}
            pixels = 0
            for k, content in enumerate(pdf["content"]):
                try:
                    gray = decode(content)
                    if gray.ndim != 2 or not gray.size:
                        raise ValueError("not a gray image")
                    waiting.setdefault((gray.shape, gray.dtype), []).append((k, gray))
                    pixels += gray.size
                except Exception as error:  # a bad image is a row, not a failed job
                    status[k] = type(error).__name__
                if pixels >= PIXELS or k == len(pdf) - 1:
                    for same in waiting.values():
                        at, grays = zip(*same)
                        values[list(at)] = np.stack(_classical(np.stack(grays)), axis=1)
                    waiting, pixels = {}, 0
            yield pd.DataFrame({"path": pdf["path"].to_numpy(), **{n: values[:, k] for k, n in enumerate(names)}, "status": status})

    return images.select("path", "content").mapInPandas(run, "path string, sharpness double, highlights double, shadows double, luma double, status string")


def encoded(images: DataFrame, make: Callable[[], Callable[[list[bytes]], np.ndarray]], batch: int = 8) -> DataFrame:
    """(path, embedding, status): ``make`` builds an encoder once in each task; a failing batch is tried one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in batches:
            rows = []
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                try:
                    rows += [(p, list(map(float, v)), "ok") for p, v in zip(part["path"], encode(part["content"].tolist()), strict=True)]
                except Exception:
                    for p, c in zip(part["path"], part["content"], strict=True):
                        try:
                            rows.append((p, list(map(float, encode([c])[0])), "ok"))
                        except Exception as error:
                            rows.append((p, None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["path", "embedding", "status"])

    return images.select("path", "content").mapInPandas(run, "path string, embedding array<float>, status string")


def pgm(content: bytes) -> np.ndarray:
    """A decoder of binary PGM, which needs no image library."""
    magic, size, top, data = content.split(b"\n", 3)
    if magic != b"P5" or int(top) > 255:
        raise ValueError("not an 8-bit PGM")
    w, h = map(int, size.split())
    return np.frombuffer(data, np.uint8, w * h).reshape(h, w)


# The EXIF tags that are read.
_TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x8769: "more", 0x829A: "exposure", 0x829D: "f_number", 0x8827: "iso", 0x9003: "taken", 0x0132: "changed"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _directory(tiff: bytes, at: int, order: str, found: dict) -> None:
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        if tag not in _TAGS or kind not in _SIZES:
            continue
        size = _SIZES[kind] * count
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", tiff, at + 10 + 12 * k)[0]
        raw = tiff[where : where + size]
        if kind == 2:
            value = raw.split(b"\0")[0].decode("utf-8", "replace").strip() or None
        elif kind in (5, 10):
            top, bottom = struct.unpack_from(order + ("II" if kind == 5 else "ii"), raw)
            value = top / bottom if bottom else None
        else:
            value = struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind], raw)[0]
        if tag == 0x8769:
            _directory(tiff, value, order, found)
        else:
            found[_TAGS[tag]] = value


def exif(content: bytes) -> dict:
    """EXIF values and the size of a JPEG as stored; what is missing or broken is left out."""
    found: dict = {}
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], struct.unpack_from(">H", content, at + 2)[0]
        body = content[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            order = "<" if body[6:8] == b"II" else ">"
            try:
                _directory(body[6:], struct.unpack_from(order + "I", body, 10)[0], order, found)
            except (struct.error, IndexError, TypeError, RecursionError):
                pass
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            found["height"], found["width"] = struct.unpack_from(">HH", body, 1)
            break
        elif marker == 0xDA:
            break
        at += 2 + size
    return found


def exif_rows(images: DataFrame) -> DataFrame:
    """(path, taken_at, camera_make, camera_model, exposure_time, f_number, iso, width, height, byte_size) of JPEG files."""
    fields = {"taken": "string", "make": "string", "model": "string", "exposure": "double", "f_number": "double", "iso": "int", "orientation": "int", "width": "int", "height": "int"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                x = exif(content)
                x.setdefault("taken", x.get("changed"))
                rows.append((path, len(content), *(x.get(k) for k in fields)))
            out = pd.DataFrame(rows, columns=["path", "byte_size", *fields], dtype=object)
            yield out

    raw = images.select("path", "content").mapInPandas(run, "path string, byte_size long, " + ", ".join(f"{k} {t}" for k, t in fields.items()))
    width, height = oriented("width", "height", "orientation")
    return raw.select("path", exif_time("taken").alias("taken_at"), clean_text("make").alias("camera_make"), clean_text("model").alias("camera_model"), exposure_text("exposure").alias("exposure_time"), "f_number", "iso", width.alias("width"), height.alias("height"), "byte_size")
