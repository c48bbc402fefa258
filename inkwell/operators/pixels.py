"""Pixel work on images as rows: thresholds natively, the rest in Arrow batches with NumPy.

An image is a struct as Spark's image source gives it: origin, height, width,
nChannels, mode, data (rows of BGR, BGRA or gray bytes). The functions take one
image at a time inside a batch; Spark deals the rows out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import select_line, with_lines

_BYTES = bytes(range(256)).decode("latin-1")
IMAGE = "origin string, height int, width int, nChannels int, mode int, data binary"


def binarize(pixels: Column, threshold: Column | int) -> Column:
    """255 for gray values above the threshold and 0 for the others; the threshold is moved into 0 to 255."""
    t = F.least(F.greatest(threshold if isinstance(threshold, Column) else F.lit(threshold), F.lit(0)), F.lit(255))
    return F.transform(pixels, lambda p: F.when(p > t, 255).otherwise(0))


def binarize_unclamped(pixels: Column, threshold: Column | int) -> Column:
    """The same with the threshold as it is."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.transform(pixels, lambda p: F.when(p > t, 255).otherwise(0))


def gray_bytes(pixels: Column) -> Column:
    """Gray values from 0 to 255 as bytes."""
    return F.unhex(F.array_join(F.transform(pixels, lambda p: F.lpad(F.hex(p), 2, "0")), ""))


def binarize_bytes(pixels: Column, threshold: Column | int, clamped: bool = True) -> Column:
    """``binarize`` on bytes, one a pixel, which stay bytes: a look-up in a table of 256 characters per threshold.

    A byte is one character of the Latin-1 text; it becomes the hexadecimal
    digit of 0 or 255, which twice gives the byte.
    """
    t = (threshold if isinstance(threshold, Column) else F.lit(threshold)).cast("int")
    dark = F.greatest(F.least(t, F.lit(255)), F.lit(0 if clamped else -1)) + 1
    table = F.concat(F.repeat(F.lit("0"), dark), F.repeat(F.lit("F"), 256 - dark))
    digits = F.call_function("translate", F.decode(pixels, "ISO-8859-1"), F.lit(_BYTES), table)
    return F.unhex(F.replace(F.replace(digits, F.lit("0"), F.lit("00")), F.lit("F"), F.lit("FF")))


def as_array(image) -> np.ndarray | None:
    """Height x width x channels, or None for an image that could not be decoded."""
    if image is None or image["height"] is None or image["height"] <= 0:
        return None
    shape = [int(image[c]) for c in ("height", "width", "nChannels")]  # floats where a batch holds nulls
    return np.frombuffer(image["data"], dtype=np.uint8).reshape(shape)


def as_image(pixels: np.ndarray, origin: str | None) -> dict:
    pixels = pixels if pixels.ndim == 3 else pixels[:, :, None]
    h, w, c = pixels.shape
    return {"origin": origin, "height": h, "width": w, "nChannels": c, "mode": {1: 0, 3: 16, 4: 24}[c], "data": pixels.astype(np.uint8).tobytes()}


def gray(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    b, g, r = (pixels[:, :, i].astype(np.float64) for i in range(3))
    return np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of gray or BGR pixels; alpha is dropped."""
    if pixels.ndim == 3 and pixels.shape[2] == 1:
        pixels = pixels[:, :, 0]
    kind = 0 if pixels.ndim == 2 else 2
    rows = pixels if kind == 0 else pixels[:, :, 2::-1]
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows.reshape(len(rows), -1)], axis=1).tobytes()

    def part(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def _around(a: np.ndarray, reduce: Callable) -> np.ndarray:
    """A 3 x 3 minimum or maximum; outside the image nothing counts."""
    fill = 255 if reduce is np.minimum else 0
    wide = np.pad(a, 1, constant_values=fill)
    h, w = a.shape
    out = wide[1 : h + 1, 1 : w + 1]
    for dy in range(3):
        for dx in range(3):
            out = reduce(out, wide[dy : dy + h, dx : dx + w])
    return out


def close_open(a: np.ndarray, opened: bool = True) -> np.ndarray:
    """Closing and, unless left out, opening of a gray image."""
    closed = _around(_around(a, np.maximum), np.minimum)
    return _around(_around(closed, np.minimum), np.maximum) if opened else closed


def _smooth(a: np.ndarray) -> np.ndarray:
    """A 5 x 5 Gaussian."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    wide = np.pad(a.astype(np.float64), 2, mode="reflect" if min(a.shape) > 2 else "edge")
    rows = sum(k[i] * wide[i : i + a.shape[0], :] for i in range(5))
    return sum(k[i] * rows[:, i : i + a.shape[1]] for i in range(5))


def edges(a: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge pixels: local maxima of the gradient above ``high``, and those above ``low`` that hang on to them."""
    wide = np.pad(a.astype(np.float64), 1, mode="edge")
    h, w = a.shape

    def at(dy: int, dx: int) -> np.ndarray:
        return wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.abs(gx) + np.abs(gy)
    turn = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    wide_size = np.pad(size, 1)
    peak = np.zeros((h, w), dtype=bool)
    for k, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
        ahead, behind = wide_size[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], wide_size[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        peak |= (turn == k) & (size > behind) & (size >= ahead)
    weak = peak & (size > low)
    strong = weak & (size > high)
    while True:
        grown = weak & _around(strong.astype(np.uint8), np.maximum).astype(bool)
        if (grown == strong).all():
            return strong
        strong = grown


def find_segments(edge: np.ndarray, votes: int, min_length: int, max_gap: int) -> list[tuple[int, int, int, int]]:
    """Straight segments of edge pixels, by votes for angle and distance in whole degrees and pixels.

    The line of most votes is taken first and walked along its longer axis;
    pixels that a segment covers don't vote again. The result depends on the
    pixels alone, so it differs from detectors that draw pixels at random.
    """
    y, x = np.nonzero(edge)
    out: list[tuple[int, int, int, int]] = []
    theta = np.arange(180) * np.pi / 180
    cos, sin = np.cos(theta), np.sin(theta)
    reach = int(np.hypot(*edge.shape)) + 1
    while len(x) >= max(votes, 2):
        rho = np.rint(x[:, None] * cos + y[:, None] * sin).astype(np.int64) + reach
        table = np.bincount((rho + np.arange(180) * (2 * reach + 1)).ravel(), minlength=180 * (2 * reach + 1))
        best = int(table.argmax())
        if table[best] < votes:
            break
        angle, distance = divmod(best, 2 * reach + 1)
        near = np.flatnonzero(np.abs(x * cos[angle] + y * sin[angle] - (distance - reach)) <= 1.5)
        for _ in range(2):  # from whole degrees to the direction of the pixels themselves
            mx, my = x[near].mean(), y[near].mean()
            u = np.linalg.eigh(np.cov(x[near], y[near], bias=True))[1][:, 1]
            close = np.flatnonzero(np.abs((y - my) * u[0] - (x - mx) * u[1]) <= 1.5)
            if len(close) < votes:
                break
            near = close
        along = (x[near] - mx) * u[0] + (y[near] - my) * u[1]
        near, along = near[np.argsort(along, kind="stable")], np.sort(along)
        cuts = np.flatnonzero(np.diff(along) > max_gap) + 1
        for first, last in zip(np.append(0, cuts), np.append(cuts, len(along)) - 1):
            ends = [(int(round(mx + t * u[0])), int(round(my + t * u[1]))) for t in (along[first], along[last])]
            (x1, y1), (x2, y2) = sorted(ends)
            if max(x2 - x1, abs(y2 - y1)) >= min_length:
                out.append((x1, y1, x2, y2))
        stay = np.ones(len(x), dtype=bool)
        stay[near] = False
        x, y = x[stay], y[stay]
    return out


#: How each detector prepares an image: smoothing, opening after closing, votes.
DETECTORS = {"server": (True, True, 50), "util": (True, True, 50), "local": (False, False, 100)}


def detect(pixels: np.ndarray, profile: str, min_length: int, max_gap: int, morphology: bool) -> tuple[list[tuple[int, int, int, int]], int]:
    smooth, opened, votes = DETECTORS[profile]
    a = gray(pixels)
    if morphology:
        a = close_open(a, opened)
    edge = edges(_smooth(a) if smooth else a)
    return find_segments(edge, votes, min_length, max_gap), int(edge.sum())


def segments(images: DataFrame, keys: list[str], image: str = "image", profile: str = "server", min_length: int = 50, max_gap: int = 20, morphology: bool = False) -> DataFrame:
    """``(keys, edge_pixels, segments, error)`` per image; ``segments`` is an array of x1, y1, x2, y2.

    An image that can't be decoded has no segments and an error.
    """
    kind = images.select(*keys).schema.toDDL()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for one in batch["image"]:
                pixels = as_array(one)
                found.append(([], 0, "undecodable") if pixels is None else (*detect(pixels, profile, min_length, max_gap, morphology), None))
            own = batch[keys].copy()
            own["edge_pixels"] = [f[1] for f in found]
            own["segments"] = [[dict(zip(("x1", "y1", "x2", "y2"), s)) for s in f[0]] for f in found]
            own["error"] = [f[2] for f in found]
            yield own

    schema = f"{kind}, edge_pixels long, segments array<struct<x1: int, y1: int, x2: int, y2: int>>, error string"
    return images.select(*keys, F.col(image).alias("image")).mapInPandas(run, schema)


def turned(pixels: np.ndarray, degrees: float, border: int = 255, expand: bool = False) -> np.ndarray:
    """Turned counter-clockwise about the middle; bilinear, on the same or on a canvas that holds all of it."""
    h, w, _ = pixels.shape
    t = np.deg2rad(degrees)
    cos, sin = np.cos(t), np.sin(t)
    cx, cy = (w // 2, h // 2) if not expand else ((w - 1) / 2, (h - 1) / 2)
    oh, ow, ox, oy = h, w, cx, cy
    if expand:
        ow, oh = int(np.ceil(abs(w * cos) + abs(h * sin) - 1e-9)), int(np.ceil(abs(w * sin) + abs(h * cos) - 1e-9))
        ox, oy = (ow - 1) / 2, (oh - 1) / 2
    yy, xx = np.mgrid[0:oh, 0:ow].astype(np.float64)
    sx = cos * (xx - ox) - sin * (yy - oy) + cx
    sy = sin * (xx - ox) + cos * (yy - oy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[:, :, None], (sy - y0)[:, :, None]
    wide = np.pad(pixels, ((1, 1), (1, 1), (0, 0)), constant_values=border).astype(np.float64)

    def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return wide[np.clip(y + 1, 0, h + 1), np.clip(x + 1, 0, w + 1)]

    mixed = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


#: Border colour, and whether the canvas grows, of each detector's rotation.
ROTATIONS = {"server": (255, False), "util": (0, False), "local": (0, True)}


def rotate(images: DataFrame, angle: str = "rotation_angle", image: str = "image", profile: str = "server") -> DataFrame:
    """``images`` with ``rotated``, the turned image; null where there is nothing to turn.

    The "local" profile counts angles clockwise, and leaves an image with angle 0 as it is.
    """
    border, expand = ROTATIONS[profile]
    sign = -1 if profile == "local" else 1

    @F.pandas_udf(IMAGE)
    def run(image: pd.DataFrame, angle: pd.Series) -> pd.DataFrame:
        out = []
        for (_, one), degrees in zip(image.iterrows(), angle):
            pixels = as_array(one if pd.notna(one["height"]) else None)
            if pixels is None or pd.isna(degrees):
                out.append(dict.fromkeys(["origin", "height", "width", "nChannels", "mode", "data"]))
            else:
                out.append(as_image(pixels if profile == "local" and not degrees else turned(pixels, sign * degrees, border, expand), one["origin"]))
        return pd.DataFrame(out, columns=["origin", "height", "width", "nChannels", "mode", "data"])

    found = images.withColumn("rotated", run(F.col(image), F.col(angle).cast("double")))
    return found.withColumn("rotated", F.when(F.col("rotated.height").isNotNull(), F.col("rotated")))


def align(images: DataFrame, keys: list[str], image: str = "image", profile: str = "server", **detector) -> DataFrame:
    """Each image with its line, its rotation angle and the turned image; ``keys`` identify an image."""
    found = segments(images, keys, image, profile, **detector)
    each = found.select(*keys, F.posexplode("segments").alias("line_index", "s")).select(*keys, "line_index", "s.*")
    chosen = with_lines(found.drop("segments"), select_line(each, keys, profile=profile), keys)
    return rotate(images.select(*keys, F.col(image).alias("image")).join(chosen, keys), profile=profile)


def _per_image(name: str, kind: T.DataType, work: Callable[[np.ndarray], object]) -> Callable:
    @F.pandas_udf(kind)
    def run(image: pd.DataFrame) -> pd.Series:
        arrays = (as_array(one if pd.notna(one["height"]) else None) for _, one in image.iterrows())
        return pd.Series([None if a is None else work(a) for a in arrays], dtype=object)

    run.__name__ = name
    return run


#: An image as a PNG file.
to_png = _per_image("to_png", T.BinaryType(), png)
#: Gray values, row by row.
gray_values = _per_image("gray_values", T.ArrayType(T.IntegerType()), lambda a: gray(a).astype(np.int32).ravel().tolist())


def binary_png(threshold: int) -> Callable:
    """A black and white PNG of an image; the threshold is moved into 0 to 255."""
    t = min(max(int(threshold), 0), 255)
    return _per_image("binary_png", T.BinaryType(), lambda a: png(np.where(gray(a) > t, 255, 0).astype(np.uint8)))


def downscaled(most: int = 2048) -> Callable:
    """A PNG of the image, made smaller by averaging where a side is over ``most`` pixels; the proportions stay."""

    def work(a: np.ndarray) -> bytes:
        h, w, _ = a.shape
        scale = min(1.0, most / max(h, w))
        nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
        ys, xs = np.linspace(0, h, nh + 1).astype(int), np.linspace(0, w, nw + 1).astype(int)
        sums = np.add.reduceat(np.add.reduceat(a.astype(np.float64), ys[:-1], axis=0), xs[:-1], axis=1)
        return png((sums / (np.diff(ys)[:, None, None] * np.diff(xs)[None, :, None])).round().astype(np.uint8))

    return _per_image("downscaled", T.BinaryType(), work)


def with_line(images: DataFrame, image: str = "image", color: tuple[int, int, int] = (255, 0, 0), width: int = 3) -> DataFrame:
    """``images`` (with x1, y1, x2, y2) with ``marked``, a PNG in which that line is drawn in a BGR colour."""

    @F.pandas_udf("binary")
    def run(image: pd.DataFrame, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        out = []
        for (_, one), ends in zip(image.iterrows(), zip(x1, y1, x2, y2)):
            a = as_array(one if pd.notna(one["height"]) else None)
            if a is None:
                out.append(None)
                continue
            a = (np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]).copy()
            if not any(pd.isna(e) for e in ends):
                p, q = np.array(ends[:2], float), np.array(ends[2:], float)
                yy, xx = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
                d = q - p
                t = np.clip(((xx - p[0]) * d[0] + (yy - p[1]) * d[1]) / max(d @ d, 1e-9), 0, 1)
                a[np.hypot(xx - p[0] - t * d[0], yy - p[1] - t * d[1]) <= width / 2] = color
            out.append(png(a))
        return pd.Series(out, dtype=object)

    return images.withColumn("marked", run(F.col(image), *(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))))
