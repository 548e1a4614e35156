"""Edges, structure, resizing and frame metrics against plain loops over pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import pixels
from tracewright.operators import boundaries


def brute_edges(x, low=80, high=160):
    h, w = x.shape
    px = lambda i, j: int(x[min(max(i, 0), h - 1), min(max(j, 0), w - 1)])
    gx, gy, size = {}, {}, {}
    for i in range(h):
        for j in range(w):
            gx[i, j] = sum(k * (px(i + d, j + 1) - px(i + d, j - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy[i, j] = sum(k * (px(i + 1, j + d) - px(i - 1, j + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            size[i, j] = abs(gx[i, j]) + abs(gy[i, j])
    m = lambda i, j: size.get((i, j), 0)
    thin = set()
    for i, j in size:
        a, b, v = abs(gx[i, j]), abs(gy[i, j]), size[i, j]
        if v <= low:
            continue
        if (b << 15) < a * 13573:
            ok = v > m(i, j - 1) and v >= m(i, j + 1)
        elif (b << 15) > a * 13573 + (a << 16):
            ok = v > m(i - 1, j) and v >= m(i + 1, j)
        else:
            s = -1 if (gx[i, j] ^ gy[i, j]) < 0 else 1
            ok = v > m(i - 1, j - s) and v > m(i + 1, j + s)
        if ok:
            thin.add((i, j))
    found = [p for p in thin if size[p] > high]
    seen = set(found)
    while found:
        i, j = found.pop()
        for q in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if q in thin and q not in seen:
                seen.add(q)
                found.append(q)
    out = np.zeros((h, w), bool)
    for p in seen:
        out[p] = True
    return out


def some_images(n, h, w, seed=2):
    rng = np.random.default_rng(seed)
    smooth = np.cumsum(rng.normal(0, 9, (n, h, w)), axis=2) + np.cumsum(rng.normal(0, 9, (n, h, w)), axis=1) + 128
    flat = np.full((n, h, w), 90.0)
    flat[:, h // 3 : h // 2, w // 4 :] += rng.integers(0, 150, (n, 1, 1))
    noise = rng.integers(0, 256, (n, h, w))
    return np.clip(np.concatenate([smooth, flat, noise]), 0, 255).astype(int)


@pytest.mark.parametrize("size", [(8, 8), (13, 21), (3, 40), (1, 5)])
def test_edges(size):
    x = some_images(12, *size)
    assert (pixels.edges_of(x) == np.stack([brute_edges(i) for i in x])).all()


def test_line_grows():
    """Weak pixels are edges as far as they hang together with a strong one."""
    x = np.zeros((1, 30, 30), int)
    x[0, :, 15:] = np.linspace(25, 60, 30).astype(int)[:, None]
    found = pixels.edges_of(x)[0]
    assert (found == brute_edges(x[0])).all() and 20 <= found.sum() <= 30 and not pixels.edges_of(x - x % 200).any()


def brute_resize(x, h, w):
    out = np.zeros((h, w))
    sy, sx = x.shape[0] / h, x.shape[1] / w
    for i in range(h):
        for j in range(w):
            total = 0.0
            for r in range(x.shape[0]):
                for c in range(x.shape[1]):
                    total += x[r, c] * max(0.0, min(r + 1, (i + 1) * sy) - max(r, i * sy)) * max(0.0, min(c + 1, (j + 1) * sx) - max(c, j * sx))
            out[i, j] = total / sy / sx
    return np.rint(np.round(out, 9))


@pytest.mark.parametrize("size", [(8, 8), (4, 4), (5, 3), (7, 8), (1, 1), (3, 7)])
def test_resize(size):
    x = some_images(3, 8, 8)
    assert (pixels.resized(x, *size) == np.stack([brute_resize(i, *size) for i in x])).all()


def test_columns(spark):
    x = some_images(2, 6, 9)
    rows = [(i, v.reshape(-1).tolist()) for i, v in enumerate(x)] + [(90, None), (91, []), (92, [1, 2]), (93, [None] * 54)]
    df = spark.createDataFrame(rows, "id int, pixels array<int>")
    got = {r.id: r.structure for r in pixels.structure(df, 6, 9).collect()}
    for i, v in enumerate(x):
        assert abs(got[i] - min(1.0, 0.65 * brute_edges(v).mean() + 0.35 * min(1.0, v.std() / 128))) < 1e-9
    assert [got[i] for i in (90, 91, 92, 93)] == [None] * 4
    small, h, w = pixels.fit_width(df, 6, 9, 4)
    assert (h, w) == (2, 4) and {r.id: r.pixels for r in small.collect()}[1] == brute_resize(x[1], 2, 4).astype(int).reshape(-1).tolist()
    assert pixels.fit_width(df, 6, 9, 9)[1:] == (6, 9) and pixels.structure(df.limit(0), 6, 9).count() == 0
    with pytest.raises(ValueError):
        pixels.resize(df, 6, 9, 7, 9)


def test_frame_metrics(spark):
    """From pixels to boundaries: a change of picture begins a segment, and nothing else does."""
    a, b = some_images(1, 8, 8)[0], some_images(1, 8, 8, 5)[2]
    shown = [a, a, a, None, b, b, a]
    rows = [(1, i, i * 5.0, None if v is None else v.reshape(-1).tolist(), f"{0 if v is a else 2**64 - 1:016x}") for i, v in enumerate(shown)] + [(2, 0, 0.0, b.reshape(-1).tolist(), None)]
    got = pixels.frame_metrics(spark.createDataFrame(rows, "job_id int, ord int, time_sec double, pixels array<int>, hash string"), 8, 8)
    m = {(r.job_id, r.ord): r for r in got.collect()}
    assert set(m) == {(1, i) for i in (0, 1, 2, 4, 5, 6)} | {(2, 0)}
    assert all(m[k].visual_score == 0.0 for k in [(1, 0), (1, 1), (1, 2), (1, 5), (2, 0)])
    r = m[1, 4]
    assert abs(r.absdiff - np.abs(a - b).mean() / 255) < 1e-9 and abs(r.edge_delta - (brute_edges(a) != brute_edges(b)).mean()) < 1e-9 and r.hash_delta == 1.0
    assert abs(r.visual_score - (0.40 * r.absdiff + 0.35 * r.ssim_delta + 0.15 * r.edge_delta + 0.10 * r.hash_delta)) < 1e-9
    assert {x.ord for x in boundaries.boundary_candidates(got.where("job_id = 1"), 9).collect()} == {4, 6}
    assert got.where(F.col("job_id") == 2).first().boundary_score == 0.0
