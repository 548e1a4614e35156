"""Pixels as arrays of 0 to 255, row by row: change as an expression; structural similarity, edges, structure and resizing in
Arrow batches, all images of a batch at once.

Images without pixels, or with another number than height times width, give null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.score import visual_score
from tracewright.functions.text import hash_distance
from tracewright.operators.ordered import in_order

LOW, HIGH = 80, 160  # of the gradients that make edges
TAN = 13573  # the tangent of 22.5 degrees in units of 2**-15, by which gradients are told horizontal, vertical or oblique


def diff_score(before: Column, after: Column) -> Column:
    """Mean absolute difference, 0 to 1; 0 where there is no image before."""
    apart = F.aggregate(F.zip_with(before, after, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.when(before.isNull(), F.lit(0.0)).otherwise(apart / F.size(after) / 255)


def blurred(x: np.ndarray, size: int = 7, sigma: float = 1.5) -> np.ndarray:
    """Images (n, height, width) under a Gaussian; edges are mirrored without the edge itself."""
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (size // 2, size // 2)
        wide = np.pad(x, pad, mode="reflect")
        x = sum(w * np.take(wide, range(i, i + x.shape[axis]), axis=axis) for i, w in enumerate(k))
    return x


def ssim_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean structural similarity of each pair of images."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = blurred(a), blurred(b)
    va, vb, ab = blurred(a * a) - ma * ma, blurred(b * b) - mb * mb, blurred(a * b) - ma * mb
    at = (2 * ma * mb + c1) * (2 * ab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return at.mean(axis=(1, 2))


def shifted(x: np.ndarray, down: int, right: int) -> np.ndarray:
    """Images (n, height, width) as seen from each pixel's neighbour ``down`` and ``right`` of it; 0 beyond the edge."""
    n, h, w = x.shape
    wide = np.zeros((n, h + 2, w + 2), x.dtype)
    wide[:, 1:-1, 1:-1] = x
    return wide[:, 1 + down : 1 + down + h, 1 + right : 1 + right + w]


def edges_of(x: np.ndarray, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """Canny edges of images: Sobel gradients of 3 by 3 (the border repeated), thinned along the gradient, those over ``high``,
    and all over ``low`` that are connected with them, also obliquely."""
    h, w = x.shape[1:]
    wide = np.pad(x.astype(np.int64), [(0, 0), (1, 1), (1, 1)], mode="edge")
    at = lambda i, j: wide[:, 1 + i : 1 + i + h, 1 + j : 1 + j + w]
    dx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    dy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.abs(dx) + np.abs(dy)
    flat, steep = np.abs(dx) * TAN, np.abs(dy) << 15
    beside = (size > shifted(size, 0, -1)) & (size >= shifted(size, 0, 1))
    above = (size > shifted(size, -1, 0)) & (size >= shifted(size, 1, 0))
    falling = (size > shifted(size, -1, -1)) & (size > shifted(size, 1, 1))
    rising = (size > shifted(size, -1, 1)) & (size > shifted(size, 1, -1))
    oblique = np.where((dx ^ dy) < 0, rising, falling)
    thin = np.where(steep < flat, beside, np.where(steep > flat + (np.abs(dx) << 16), above, oblique)) & (size > low)
    found = thin & (size > high)
    while True:  # grows along thin lines
        near = np.logical_or.reduce([shifted(found, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]) & thin
        if (near == found).all():
            return found
        found = near


def structure_of(x: np.ndarray) -> np.ndarray:
    """0 to 1: the share of edges, and contrast."""
    contrast = np.minimum(1.0, x.std(axis=(1, 2)) / 128)
    return np.clip(0.65 * edges_of(x).mean(axis=(1, 2)) + 0.35 * contrast, 0.0, 1.0)


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Images made smaller by area: a new pixel is the mean of the region that it covers, parts of pixels by their share."""

    def along(x: np.ndarray, new: int) -> np.ndarray:
        old = x.shape[1]
        sums = np.concatenate([np.zeros_like(x[:, :1]), np.cumsum(x, axis=1)], axis=1)
        at = np.arange(new + 1) * (old / new)
        whole = np.minimum(np.floor(at).astype(int), old)
        part = (at - whole)[None, :, None]
        upto = sums[:, whole] + part * x[:, np.minimum(whole, old - 1)]
        return np.diff(upto, axis=1) / (old / new)

    out = along(x.astype(float), height)
    return np.rint(np.round(along(out.transpose(0, 2, 1), width).transpose(0, 2, 1), 9))


def with_images(df: DataFrame, columns: list[str], height: int, width: int, name: str, kind: str, of: Callable[..., np.ndarray]) -> DataFrame:
    """``df`` with the column ``name``: ``of`` the images (n, height, width) in ``columns``, null where one isn't an image."""
    n = height * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [batch.column(c).to_pylist() for c in columns]
            at = [i for i in range(len(batch)) if all(x[i] is not None and len(x[i]) == n and None not in x[i] for x in images)]
            out = [None] * len(batch)
            if at:
                for i, value in zip(at, of(*(np.array([x[i] for i in at], float).reshape(-1, height, width) for x in images)).tolist()):
                    out[i] = value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()) if kind.startswith("array") else pa.float64())], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, {name} {kind}")


def ssim(pairs: DataFrame, height: int, width: int) -> DataFrame:
    """Adds ``ssim`` of ``before`` and ``after``."""
    return with_images(pairs, ["before", "after"], height, width, "ssim", "double", ssim_of)


def edge_delta(pairs: DataFrame, height: int, width: int) -> DataFrame:
    """Adds ``edge_delta``: the share of pixels that are an edge in one of ``before`` and ``after`` only."""
    return with_images(pairs, ["before", "after"], height, width, "edge_delta", "double", lambda a, b: (edges_of(a) != edges_of(b)).mean(axis=(1, 2)))


def structure(images: DataFrame, height: int, width: int) -> DataFrame:
    """Adds ``structure`` of ``pixels``: how much there is to see, 0 to 1."""
    return with_images(images, ["pixels"], height, width, "structure", "double", structure_of)


def resize(images: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """``pixels`` made ``new_height`` by ``new_width``, none larger than it was."""
    if new_height > height or new_width > width:
        raise ValueError("images are only made smaller")
    small = with_images(images, ["pixels"], height, width, "__small", "array<int>", lambda x: resized(x, new_height, new_width).astype(np.int32).reshape(len(x), -1))
    return small.withColumn("pixels", F.col("__small")).drop("__small")


def fit_width(images: DataFrame, height: int, width: int, most: int) -> tuple[DataFrame, int, int]:
    """Images no wider than ``most`` in their old proportions, with their height and width."""
    if width <= most:
        return images, height, width
    new = max(1, int(height * (most / width)))
    return resize(images, height, width, new, most), new, most


def frame_metrics(frames: DataFrame, height: int, width: int) -> DataFrame:
    """Frames (job_id, ord, pixels, hash, ...) with how they differ from their job's previous one that has an image: absdiff,
    ssim_delta, edge_delta, hash_delta, their weighted sum visual_score, and boundary_score, the same until text is known.

    The first is 0 in all. Frames without an image are left out."""
    seen = frames.where(F.size("pixels") == height * width)
    pairs = seen.withColumns({"before": F.lag("pixels").over(in_order()), "__hash": F.lag("hash").over(in_order())}).withColumnRenamed("pixels", "after")
    pairs = edge_delta(ssim(pairs, height, width), height, width)
    known = lambda x: F.when(F.col("before").isNull(), F.lit(0.0)).otherwise(x)
    parts = {
        "absdiff": diff_score(F.col("before"), F.col("after")), "ssim_delta": known(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("ssim")))),
        "edge_delta": known(F.col("edge_delta")), "hash_delta": known(F.least(F.lit(1.0), hash_distance(F.col("__hash"), F.col("hash")) / 64)),
    }
    rows = pairs.withColumns(parts)
    score = visual_score(*(F.col(c) for c in parts))
    return rows.withColumns({"visual_score": score, "boundary_score": score}).withColumnRenamed("after", "pixels").drop("before", "ssim", "__hash")
