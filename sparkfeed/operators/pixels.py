"""Pixel kernels on decoded images: colour spaces, mirror, crop, resize, rotation, Sobel channel.

Images are rows of pixels from the top, channels last. A task holds few images at a time as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Images of an Arrow batch that are arrays at a time.
IMAGES = 16
#: Weights of red, green and blue in brightness, and of the two colour differences.
LUMA, RED_DIFF, BLUE_DIFF = (0.299, 0.587, 0.114), 0.713, 0.564
#: Kernel of the Sobel derivative along columns.
SOBEL = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))


def _rgb(x: np.ndarray, space: str) -> np.ndarray:
    if space == "RGB":
        return x
    if space == "BGR":
        return x[..., ::-1]
    if space == "GRAY":
        return np.repeat(x[..., :1], 3, axis=2)
    if space == "YCR_CB":
        y, cr, cb = (x[..., k] for k in range(3))
        r, b = y + (cr - 128) / RED_DIFF, y + (cb - 128) / BLUE_DIFF
        return np.stack([r, (y - LUMA[0] * r - LUMA[2] * b) / LUMA[1], b], axis=2)
    if space == "HSV":
        h, s, v = x[..., 0] / 30, x[..., 1] / 255, x[..., 2]
        part = lambda k: v - v * s * np.clip(np.minimum((k + h) % 6, 4 - (k + h) % 6), 0, 1)
        return np.stack([part(5), part(3), part(1)], axis=2)
    raise ValueError(f"no colour space {space}")


def convert_color(x: np.ndarray, source: str, target: str) -> np.ndarray:
    """Between RGB, BGR, GRAY, YCR_CB and HSV, on the scale 0 to 255; hues go from 0 to 180."""
    if source == target:
        return x
    rgb = _rgb(x, source)
    if target in ("RGB", "BGR"):
        return rgb if target == "RGB" else rgb[..., ::-1]
    y = rgb @ np.array(LUMA)
    if target == "GRAY":
        return y[..., None]
    if target == "YCR_CB":
        return np.stack([y, (rgb[..., 0] - y) * RED_DIFF + 128, (rgb[..., 2] - y) * BLUE_DIFF + 128], axis=2)
    if target == "HSV":
        r, g, b = (rgb[..., k] for k in range(3))
        v = rgb.max(axis=2)
        d = v - rgb.min(axis=2)
        some = np.where(d > 0, d, 1)
        h = np.where(v == r, (g - b) / some % 6, np.where(v == g, (b - r) / some + 2, (r - g) / some + 4))
        return np.stack([np.where(d > 0, h, 0) * 30, np.where(v > 0, d / np.where(v > 0, v, 1), 0) * 255, v], axis=2)
    raise ValueError(f"no colour space {target}")


def _sample(x: np.ndarray, rows: np.ndarray, columns: np.ndarray, outside: bool) -> np.ndarray:
    """Bilinear samples; beyond the edge the image goes on as zeros (``outside``) or as its edge."""
    h, w = x.shape[:2]
    r0, c0 = np.floor(rows).astype(int), np.floor(columns).astype(int)
    out = np.zeros((*rows.shape, x.shape[2]))
    for r, fr in ((r0, 1 - (rows - r0)), (r0 + 1, rows - r0)):
        for c, fc in ((c0, 1 - (columns - c0)), (c0 + 1, columns - c0)):
            weight = fr * fc * (((r >= 0) & (r < h) & (c >= 0) & (c < w)) if outside else 1)
            out += weight[..., None] * x[np.clip(r, 0, h - 1), np.clip(c, 0, w - 1)]
    return out


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, by the centres of pixels."""
    at = lambda n, size: (np.arange(n) + 0.5) * size / n - 0.5
    rows, columns = np.meshgrid(at(height, x.shape[0]), at(width, x.shape[1]), indexing="ij")
    return _sample(x, rows, columns, False)


def rotate(x: np.ndarray, radians: float, background=0.0) -> np.ndarray:
    """Anticlockwise about the centre; the background, a value or an image, shows where none of it is."""
    h, w = x.shape[:2]
    rows, columns = np.meshgrid(np.arange(h) - h // 2, np.arange(w) - w // 2, indexing="ij")
    sin, cos = np.sin(radians), np.cos(radians)
    from_rows, from_columns = cos * rows + sin * columns + h // 2, cos * columns - sin * rows + w // 2
    alpha = _sample(np.ones((h, w, 1)), from_rows, from_columns, True)
    return _sample(x, from_rows, from_columns, True) + np.broadcast_to(background, x.shape) * (1 - alpha)


def sobel(gray: np.ndarray) -> np.ndarray:
    """Each pixel's gradient magnitude; beyond the edge the image goes on as its edge."""
    h, w = gray.shape
    p, kernel = np.pad(gray, 1, mode="edge"), np.array(SOBEL)
    along = lambda k: sum(k[i, j] * p[i : i + h, j : j + w] for i in range(3) for j in range(3))
    return np.hypot(along(kernel), along(kernel.T))


def _value(row: dict, x):
    return row[x] if isinstance(x, str) else x


def _apply(x: np.ndarray, space: str, steps: list[tuple], row: dict) -> tuple[np.ndarray, str]:
    for kind, *args in steps:
        if kind == "color":
            x, space = convert_color(x, space, args[0]), args[0]
        elif kind == "mirror":
            x = x[:, ::-1] if _value(row, args[0] if args else True) else x
        elif kind == "crop":
            y0, y1, x0, x1 = (_value(row, a) for a in args)
            x = x[y0:y1, x0:x1]
        elif kind == "resize":
            x = resize(x, *args)
        elif kind == "rotate":
            x = rotate(x, _value(row, args[0]), args[1] if len(args) > 1 else 0.0)
        elif kind == "sobel":
            gray = x[..., 2] if space == "HSV" else x[..., 0] if space in ("YCR_CB", "GRAY") else convert_color(x, space, "GRAY")[..., 0]
            x = np.concatenate([x, sobel(gray)[..., None]], axis=2)
        else:
            raise ValueError(f"no step {kind}")
    return x, space


def transform_images(df: DataFrame, steps: list[tuple], space: str = "BGR", data: str = "data") -> DataFrame:
    """``df`` with ``height``, ``width``, ``channels`` and ``pixels`` (array of floats) after all steps.

    ``data`` is bytes, as ``read_images`` gives them in BGR order, or an array of numbers. Steps:
    ``("color", space)``, ``("mirror",)`` or ``("mirror", column)``, ``("crop", y0, y1, x0, x1)``,
    ``("resize", height, width)``, ``("rotate", radians)`` with a background value or image after it,
    ``("sobel",)``, which adds a channel. Where a column's name may stand, it is that row's own value.
    Rows without data have null pixels. Resizing is bilinear.
    """
    bad = [s[0] for s in steps if s[0] not in ("color", "mirror", "crop", "resize", "rotate", "sobel")]
    if bad:
        raise ValueError(f"no step {bad[0]}")
    own = [c for c in df.columns if c not in (data, "height", "width", "channels", "pixels")]
    schema = T.StructType([*(df.schema[c] for c in own), *(T.StructField(c, T.IntegerType()) for c in ("height", "width", "channels")), T.StructField("pixels", T.ArrayType(T.FloatType()))])
    names = [a for s in steps for a in s[1:] if isinstance(a, str) and s[0] != "color"]
    rows = df.select(*own, F.col("height").alias("height"), F.col("width").alias("width"), F.col("channels").alias("channels"), F.col(data).alias("pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, IMAGES):
                batch = whole.slice(at, IMAGES)
                shapes, pixels = [], []
                asked = batch.select(names).to_pylist() if names else [{}] * batch.num_rows
                for row, h, w, c, p in zip(asked, *(batch.column(k).to_pylist() for k in ("height", "width", "channels")), batch.column("pixels"), strict=True):
                    if not p.is_valid:
                        shapes.append((h, w, c))
                        pixels.append(None)
                        continue
                    flat = np.frombuffer(p.as_buffer(), np.uint8) if pa.types.is_binary(p.type) else p.values.to_numpy(zero_copy_only=False)
                    x, _ = _apply(flat.astype(np.float64).reshape(h, w, c), space, steps, row)
                    shapes.append(x.shape)
                    pixels.append(x.ravel().astype(np.float32))
                made = [pa.array([s[k] for s in shapes], pa.int32()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *made, pa.array(pixels, pa.list_(pa.float32()))], names=schema.names)

    return rows.mapInArrow(run, schema)
