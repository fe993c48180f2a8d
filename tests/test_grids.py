from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import grids

G = ["grid_id"]


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(5)
    rows = [(g, y, x, *map(float, rng.integers(0, 256, 3)), f"p{y}-{x}") for g, (h, w) in enumerate([(11, 13), (11, 13), (1, 1), (3, 20), (8, 8)]) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "grid_id int, y int, x int, r double, g double, b double, note string").withColumn("v", F.col("r"))
    return df.repartition(3).cache()


CASES = {
    "box3": lambda c: grids.box3(c, G),
    "box_mean": lambda c: grids.box_mean(c, G, 2),
    "box3_bytes": lambda c: grids.box3_bytes(c, G, 3),
    "opened": lambda c: grids.opened(c, G, 2),
    "alpha_stretch": lambda c: grids.alpha_stretch(c, G, 200.0, 50.0, 4, 60),
    "dehaze": lambda c: grids.dehaze(c, G, 60),
    "median3": lambda c: grids.median3(c, G, 70),
    "unsharp": lambda c: grids.unsharp(c, G, 1.5, 5, 2),
    "midtone_clarity": lambda c: grids.midtone_clarity(c, G, 0.8),
    "high_freq_boost": lambda c: grids.high_freq_boost(c, G, 0, 0, 1.2),
    "edge_gated_sharpen": lambda c: grids.edge_gated_sharpen(c, G, 0, 0, 0.9),
    "edge_enhance": lambda c: grids.edge_enhance(c, G, 0, 0, 0.9),
    "edge_smooth": lambda c: grids.edge_smooth(c, G, 60),
}


def table(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(CASES))
def test_tiles_make_no_difference(pixels, monkeypatch, name):
    """Tiles of five pixels with their borders give what whole grids give."""
    whole = table(CASES[name](pixels))
    monkeypatch.setattr(grids, "on_grids", partial(grids.on_grids, tile=5))
    assert table(CASES[name](pixels)) == whole and len(whole) == pixels.count()


@pytest.mark.parametrize(("name", "most"), [("midtone_clarity", 1), ("median3", 1), ("edge_enhance", 1), ("edge_gated_sharpen", 1), ("box3_bytes", 1), ("unsharp", 1), ("dehaze", 2)])
def test_pixels_are_shuffled_once(spark, pixels, name, most):
    plan = CASES[name](spark.createDataFrame(pixels.limit(0).collect(), pixels.schema))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == most


def test_other_columns_and_missing_pixels(spark, pixels):
    out = grids.box3(pixels.where("NOT (y = 1 AND x = 1)"), G, "r", "mean")
    assert out.columns == [*pixels.columns, "mean"] and out.count() == pixels.where("NOT (y = 1 AND x = 1)").count()
    assert out.where("note <> concat('p', y, '-', x) OR mean IS NULL").count() == 0
    holes = spark.createDataFrame([(0, 0, x, float(x)) for x in (0, 1, 3)], "grid_id int, y int, x int, v double")
    got = [r.v for r in grids.box_mean(holes, G, 1).orderBy("x").collect()]
    assert got == [0.5, 0.5, 3.0]  # a missing pixel is outside
    assert grids.box3_bytes(pixels.limit(0), G).count() == 0


def test_equalise_against_loops(spark):
    rng = np.random.default_rng(6)
    h, w, tiles, strength = 21, 21, 8, 80
    rgb = rng.integers(0, 256, (h, w, 3)).astype(float)
    df = spark.createDataFrame([(0, y, x, *map(float, rgb[y, x])) for y in range(h) for x in range(w)], "grid_id int, y int, x int, r double, g double, b double")
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in grids.tile_equalise(df, G, w, h, strength, tiles).collect()}
    size = -(-w // tiles)
    lum = np.clip(np.rint(0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]), 0, 255).astype(int)
    limit, maps = max(1, int(2.0 * size * size / 256)), {}
    for ty in range(tiles):
        for tx in range(tiles):
            n = np.bincount(lum[ty * size : ty * size + size, tx * size : tx * size + size].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            share = np.array([over // 256 + (k < over % 256) for k in range(256)])
            maps[ty, tx] = np.clip(np.rint(np.cumsum(np.minimum(n, limit) + share) * 255.0 / max(1, n.sum())), 0, 255)
    clip = lambda k: min(max(k, 0), tiles - 1)
    for y in range(h):
        for x in range(w):
            fy, fx = (y - size / 2) / size, (x - size / 2) / size
            j, i = int(np.floor(fy)), int(np.floor(fx))
            m = lambda a, b: maps[clip(j + a), clip(i + b)][lum[y, x]]
            new = (m(0, 0) * (1 - fx + i) + m(0, 1) * (fx - i)) * (1 - fy + j) + (m(1, 0) * (1 - fx + i) + m(1, 1) * (fx - i)) * (fy - j)
            want = [np.clip(np.rint(v + (np.rint(v * new / max(1.0, lum[y, x])) - v) * 0.2 * 0.8), 0, 255) for v in rgb[y, x]]
            assert np.allclose(got[y, x], want, atol=1)  # sums in another order may fall on the other side of a half


def test_otsu_without_parts(spark):
    rows = [("even", i, 0.3) for i in range(9)] + [("none", i, None) for i in range(4)] + [("two", i, float(i % 2)) for i in range(8)]
    df = spark.createDataFrame(rows, "grid_id string, x int, v double")
    got = {r.grid_id: (r.threshold, round(r.fg, 3), round(r.bg, 3)) for r in grids.otsu(df, ["grid_id"]).collect()}
    assert got == {"even": (128, 0.502, 0.362), "none": (None, 0.78, 0.42), "two": (0, 0.35, 0.21)}
