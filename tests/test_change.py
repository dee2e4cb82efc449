from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from urbanchange.config import Grid
from urbanchange.operators import (
    components,
    context,
    patches,
    registry,
    resample,
    simple_diff,
    threshold,
)


def pixels(spark, image, name="value", band=1):
    h, w = image.shape
    r, c = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
    pdf = pd.DataFrame({"row_": r.ravel(), "col_": c.ravel(), name: image.ravel()})
    df = spark.createDataFrame(pdf).select(
        F.lit(band).alias("band"),
        F.col("row_").cast("int").alias("row_"),
        F.col("col_").cast("int").alias("col_"),
        name,
    )
    return df


def image_of(df, shape, name="value"):
    out = np.full(shape, np.nan)
    for r in df.select("row_", "col_", name).collect():
        out[r["row_"], r["col_"]] = np.nan if r[name] is None else r[name]
    return out


def flood(binary, full):
    """Labels by breadth-first search, row-major."""
    h, w = binary.shape
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    if full:
        steps += [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    labels, n = np.zeros(binary.shape, int), 0
    for i in range(h):
        for j in range(w):
            if binary[i, j] and not labels[i, j]:
                n += 1
                todo = [(i, j)]
                labels[i, j] = n
                while todo:
                    a, b = todo.pop()
                    for di, dj in steps:
                        p, q = a + di, b + dj
                        if 0 <= p < h and 0 <= q < w and binary[p, q] and not labels[p, q]:
                            labels[p, q] = n
                            todo.append((p, q))
    return labels


def snake(h, w):
    """One long winding object and one speck: needs many merges between tiles."""
    out = np.zeros((h, w), int)
    out[::2] = 1
    for i in range(1, h, 2):
        out[i, -1 if (i // 2) % 2 == 0 else 0] = 1
    out[-1] = 0
    out[-1, w // 2] = 0
    return out


@pytest.mark.parametrize("hot_rows", [10**6, 0])
@pytest.mark.parametrize("full", [False, True])
def test_components_across_tiles(spark, full, hot_rows):
    rng = np.random.default_rng(5)
    for binary in (rng.integers(0, 100, (15, 22)) < 45, snake(13, 17) > 0):
        binary = binary.astype(int)
        df = pixels(spark, binary, "changed")
        found = components.label_components(df, full=full, tile=4, hot_rows=hot_rows)
        want = flood(binary, full)
        sizes = np.bincount(want.ravel())
        seen = {}
        rows = found.collect()
        assert len(rows) == binary.sum()
        for r in rows:
            label = want[r["row_"], r["col_"]]
            assert r["size"] == sizes[label]
            assert seen.setdefault(label, r["root"]) == r["root"]
        assert len(set(seen.values())) == len(seen)


def test_remove_small_and_segment(spark):
    rng = np.random.default_rng(6)
    binary = (rng.integers(0, 100, (12, 12)) < 40).astype(int)
    df = pixels(spark, binary, "changed")
    want = flood(binary, False)
    keep = np.bincount(want.ravel()) >= 3
    keep[0] = False
    got = image_of(components.remove_small(df, 3, tile=5), binary.shape, "changed")
    assert np.array_equal(got, keep[want].astype(float))
    labels = flood(binary, True)
    big = np.bincount(labels.ravel()) >= 4
    big[0] = False
    got = image_of(components.segment(df, 4, tile=5), binary.shape, "label")
    assert np.array_equal(got, np.where(big[labels], labels, 0))


@pytest.mark.parametrize("full", [False, True])
def test_small_tiles_share_a_call(spark, monkeypatch, full):
    """Python calls grow with blocks of pixels, not with tiles; tiles keep their own labels."""
    groups = []

    def spread(df, keys):
        groups.append(df.select(*keys).distinct().count())
        return df

    monkeypatch.setattr(components, "spread", spread)
    binary = (np.random.default_rng(8).integers(0, 100, (23, 19)) < 50).astype(int)
    df = pixels(spark, binary, "changed")
    ones = df.where("changed > 0")
    want = np.full(binary.shape, np.nan)
    for i in range(0, 23, 4):
        for j in range(0, 19, 4):
            part = flood(binary[i : i + 4, j : j + 4], full)
            for label in range(1, part.max() + 1):
                rows, cols = np.nonzero(part == label)
                want[rows + i, cols + j] = (rows[0] + i) * 2**components.WIDTH_BITS + cols[0] + j
    for most, calls in ((512, 1), (8, 9), (3, 30)):
        monkeypatch.setattr(components, "TILE", most)
        local = components._local(ones, ["band"], 4, full)
        assert np.array_equal(image_of(local, binary.shape, "local"), want, equal_nan=True)
        assert groups.pop() == calls


def test_remove_small_keeps_every_row(spark):
    """Repeated pixels stay as they are, those without a flag or a band are unchanged."""
    rows = [(1, 0, 0, 1), (1, 0, 0, 1), (1, 0, 1, 1), (1, 5, 5, 1), (1, 5, 6, 0), (1, 7, 7, None), (None, 0, 0, 1)]
    df = spark.createDataFrame(rows, "band int, row_ int, col_ int, changed int")
    got = sorted(map(tuple, components.remove_small(df, 2).collect()), key=repr)
    want = [(1, 0, 0, 1), (1, 0, 0, 1), (1, 0, 1, 1), (1, 5, 5, 0), (1, 5, 6, 0), (1, 7, 7, 0), (None, 0, 0, 0)]
    assert got == sorted(want, key=repr)
    none = df.where("changed = 0")
    assert [tuple(r) for r in components.remove_small(none, 2).collect()] == [(1, 5, 6, 0)]
    assert [tuple(r) for r in components.segment(none, 2).collect()] == [(1, 5, 6, 0)]


def best_split(counts, classes):
    """Exhaustive between-class variance search on bins, first maximum."""
    n = len(counts)
    bins = np.arange(n)

    def score(edges):
        total = 0.0
        for a, b in zip([0, *[e + 1 for e in edges]], [*edges, n - 1]):
            w, s = counts[a : b + 1].sum(), (counts * bins)[a : b + 1].sum()
            total += s * s / w if w else 0.0
        return total

    if classes == 2:
        options = [(i,) for i in range(n - 1)]
    else:
        options = [(i, j) for i in range(n - 1) for j in range(i + 1, n - 1)]
    return max(options, key=lambda e: (score(e), tuple(-x for x in e)))


def test_otsu_family(spark):
    rng = np.random.default_rng(7)
    image = np.concatenate([rng.normal(0.2, 0.03, 200), rng.normal(0.5, 0.03, 100), rng.normal(0.9, 0.02, 60)])
    image = image.reshape(18, 20)
    lo, hi = image.min(), image.max()
    counts = np.bincount(
        np.minimum(np.floor((image.ravel() - lo) / (hi - lo) * 256), 255).astype(int), minlength=256
    )
    df = pixels(spark, image)

    def centre(i):
        return lo + (i + 0.5) * (hi - lo) / 256

    (i,) = best_split(counts, 2)
    assert np.isclose(threshold.otsu(df).first()["threshold"], centre(i))
    row = threshold.multi_otsu(df).first()
    i, j = best_split(counts, 3)
    assert np.isclose(row["lower"], centre(i)) and np.isclose(row["threshold"], centre(j))
    assert np.isclose(threshold.scaled_otsu(df, 1.5).first()["threshold"], 1.5 * threshold.otsu(df).first()["threshold"])
    binary = threshold.apply_strategy(df, "multiotsu", 1)
    assert np.array_equal(image_of(binary, image.shape, "changed"), (image > centre(j)).astype(float))


def test_degenerate_histograms(spark):
    flat = pixels(spark, np.full((3, 3), 0.5))
    assert threshold.otsu(flat).first()["threshold"] == 0.5
    assert threshold.apply_strategy(flat, "otsu", 1).agg(F.sum("changed")).first()[0] == 0
    assert threshold.multi_otsu(flat).first()["threshold"] is None
    three = pixels(spark, np.array([[0.0, 0.5, 1.0, 1.0]]))
    row = threshold.multi_otsu(three).first()
    assert np.isclose(row["lower"], 0.5 / 256) and np.isclose(row["threshold"], 128.5 / 256)


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        threshold.apply_strategy(pixels(spark, np.eye(3)), "magic")
    with pytest.raises(ValueError):
        registry.get_method("magic")


def triangle_level(h):
    """Farthest level from the line of the peak and the longer tail's end."""
    filled = np.nonzero(h)[0]
    left, right = filled[0], filled[-1]
    left -= left > 0
    right += right < 255
    top = int(np.argmax(h))
    flip = top - left < right - top
    if flip:
        h = h[::-1]
        left, top = 255 - right, 255 - top
    best, level = 0, left
    for i in range(left + 1, top + 1):
        d = h[top] * i + (left - top) * h[i]
        if d > best:
            best, level = d, i
    level -= 1
    return 255 - level if flip else level


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_triangle(spark, seed):
    rng = np.random.default_rng(seed)
    image = np.clip(rng.exponential(0.1, (20, 20)), 0, 1)
    if seed == 2:
        image = 1 - image
    h = np.bincount(np.floor(image.ravel() * 255).astype(int), minlength=256)
    got = threshold.triangle(pixels(spark, image)).first()["threshold"]
    assert np.isclose(got, triangle_level(h) * 0.5 / 255)


def test_gaussian_and_adaptive(spark):
    rng = np.random.default_rng(8)
    image = rng.uniform(size=(9, 7))
    radius, sigma = 8, 2.0
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()
    padded = np.pad(image, radius, mode="edge")
    rows = np.apply_along_axis(lambda v: np.convolve(v, taps, "valid"), 1, padded)
    want = np.apply_along_axis(lambda v: np.convolve(v, taps, "valid"), 0, rows)
    df = pixels(spark, image)
    assert np.allclose(image_of(threshold.gaussian(df, sigma), image.shape), want)
    got = image_of(threshold.adaptive(df, 1, sigmas=[sigma]), image.shape, "changed")
    assert np.array_equal(got, (image > 2 * want).astype(float))


def test_patches_cover_and_restore(spark):
    rng = np.random.default_rng(9)
    image = rng.uniform(size=(11, 9))
    grid = Grid(9, 11)
    df = pixels(spark, image)
    packed = patches.extract_patches(df, grid, 4, 2)
    rows = {(r["pi"], r["pj"]): r["patch"] for r in packed.collect()}
    assert len(rows) == 4 * 3
    for (i, j), patch in rows.items():
        window = image[2 * i : 2 * i + 4, 2 * j : 2 * j + 4]
        assert np.allclose(np.array(patch).reshape(4, 4), window)
    flat = patches.unpack_patches(packed, 4)
    got = image_of(patches.reconstruct(flat, df.select("band", "row_", "col_"), 4, 2), image.shape)
    want = image.copy()
    want[10:, :] = 0
    want[:, 8:] = 0
    assert np.allclose(got, want)
    assert patches.extract_patches(df, grid, 256).count() == 0


def test_patch_scores_keep_the_extent(spark):
    pairs = pixels(spark, np.zeros((64, 64)), "v1").withColumn("v2", F.lit(1.0) + F.col("col_"))
    half = lambda a, b: np.abs(b - a)[::2, ::2]  # noqa: E731  smaller than the patch: resized
    got = image_of(patches.score_patches(pairs, Grid(64, 64), half, 16), (64, 64))
    assert np.isfinite(got).all() and got.min() == 0 and got.max() == 1


def test_resample(spark):
    rng = np.random.default_rng(10)
    image = rng.uniform(size=(5, 6))
    for th, tw in ((10, 12), (3, 4), (5, 6), (7, 13), (1, 1)):
        r = np.clip((np.arange(th) + 0.5) * 5 / th - 0.5, 0, 4)
        c = np.clip((np.arange(tw) + 0.5) * 6 / tw - 0.5, 0, 5)
        r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
        r1, c1 = np.minimum(r0 + 1, 4), np.minimum(c0 + 1, 5)
        fr, fc = (r - r0)[:, None], (c - c0)[None]
        want = (
            image[r0][:, c0] * (1 - fr) * (1 - fc)
            + image[r0][:, c1] * (1 - fr) * fc
            + image[r1][:, c0] * fr * (1 - fc)
            + image[r1][:, c1] * fr * fc
        )
        got = image_of(resample.resample_bilinear(pixels(spark, image), (5, 6), (th, tw)), (th, tw))
        assert np.allclose(got, want)


@pytest.mark.parametrize("excluded", [0, 1])
def test_spatial_context(spark, excluded):
    rng = np.random.default_rng(11)
    a, b = rng.uniform(0.5, 1, (8, 9)), rng.uniform(0.5, 1, (8, 9))
    pairs = pixels(spark, a, "v1").join(pixels(spark, b, "v2"), ["band", "row_", "col_"])
    n = 3
    pa, pb = np.pad(a, n), np.pad(b, n)
    pp, pq = np.zeros_like(a), np.zeros_like(a)
    for dy in range(-n, n + 1):
        for dx in range(-n, n + 1):
            if abs(dy) > excluded and abs(dx) > excluded:
                s = np.s_[dy + n : dy + n + 8, dx + n : dx + n + 9]
                pp += (pa * pa)[s]
                pq += (pa * pb)[s]
    got = image_of(context.spatial_context(pairs, n, excluded), a.shape)
    assert np.allclose(got, np.abs(a * pq / pp - b))


def test_pca_kmeans_finds_the_changed_block(spark):
    rng = np.random.default_rng(12)
    before = rng.normal(0, 0.05, (14, 14))
    after = before + rng.normal(0, 0.05, (14, 14))
    after[3:10, 3:10] += 5
    pairs = pixels(spark, before, "v1").join(pixels(spark, after, "v2"), ["band", "row_", "col_"])
    got = image_of(context.pca_kmeans(pairs, [1]), (14, 14), "cluster")
    inside = got[5, 5]
    assert (got[4:9, 4:9] == inside).all() and got[0, 0] != inside and got[13, 13] != inside


def test_neighbour_blocks(spark):
    image = np.arange(12.0).reshape(3, 4)
    df = pixels(spark, image).unionByName(pixels(spark, image * 10, band=2))
    padded = np.pad(image, 1)
    for r in context.neighbour_blocks(df, [1, 2]).collect():
        want = padded[r["row_"] : r["row_"] + 3, r["col_"] : r["col_"] + 3].ravel()
        assert np.allclose(r["block"], np.concatenate([want, want * 10]))


def test_simple_difference_uses_one_scale_per_date(spark):
    rng = np.random.default_rng(13)
    parts, cubes = None, {}
    for period in (1, 2):
        cube = rng.uniform(0, 10 * period, (2, 6, 5))
        cube[0, 0, 0] = np.nan
        cubes[period] = cube
        for band in (1, 2):
            df = pixels(spark, cube[band - 1], band=band).withColumn("period", F.lit(period))
            df = df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
            parts = df if parts is None else parts.unionByName(df)
    z = {}
    for period, cube in cubes.items():
        cube = np.nan_to_num(cube, nan=np.nanmin(cube))
        z[period] = (cube - cube.mean()) / cube.std()
    found = simple_diff.change_map(parts, 1, 2)
    for band in (1, 2):
        d = np.abs(z[2][band - 1] - z[1][band - 1])
        want = (d - d.min()) / (d.max() - d.min())
        assert np.allclose(image_of(found.where(F.col("band") == band), (6, 5)), want)


def test_registry_runs_every_method(spark):
    rng = np.random.default_rng(14)
    a, b = rng.uniform(size=(8, 8)), rng.uniform(size=(8, 8))
    df = pixels(spark, a).withColumn("period", F.lit(1)).unionByName(
        pixels(spark, b).withColumn("period", F.lit(2))
    )
    for name in registry.METHODS:
        options = {"size": 4} if name == "user_patch" else {}
        out = registry.binary_changes(df, 1, 2, Grid(8, 8), name, "otsu", 1, **options)
        assert out.count() == 64
        assert set(r[0] for r in out.select("changed").distinct().collect()) <= {0, 1}
