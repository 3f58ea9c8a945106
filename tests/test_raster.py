import random

import numpy as np
import pytest

from shelfsight.operators import raster as R
from shelfsight.sources import images as I

SIDES = [(1, 1), (4, 4), (5, 5), (5, 40), (40, 7), (24, 24), (130, 60)]


def _grids():
    rng = np.random.default_rng(5)
    out = []
    for k, (h, w) in enumerate(SIDES):
        g = rng.integers(225, 256, size=(h, w, 4), dtype=np.int64)
        g[..., 3] = 255 if k % 2 else rng.choice([0, 255], size=(h, w), p=[0.85, 0.15])
        out.append(g)
    out.append(np.full((30, 30, 4), 255))
    clear = np.full((30, 30, 4), 255)
    clear[..., 3] = 0
    out.append(clear)
    return out


def _pixel_by_pixel(grid, thr=245, least=85):
    """Background state from the definition: every pixel is asked which of the three regions it lies in."""
    h, w = grid.shape[:2]
    side = min(h, w)
    ring, corner = max(1, side * 5 // 100), max(5, side * 2 // 100)
    clear, white, upper, lower = [], [], [], []
    for y in range(h):
        for x in range(w):
            r, g, b, a = (int(v) for v in grid[y, x])
            darkest = min(r, g, b)
            # a pixel counts once for every strip of the ring that holds it
            for inside in (y < ring, y >= h - ring, x < ring, x >= w - ring):
                if inside:
                    clear.append(a < 32)
                    white.append(darkest >= thr)
            for near_side in (x < corner, x >= w - corner):
                if near_side and y < corner:
                    upper.append(darkest >= thr)
                if near_side and y >= h - corner:
                    lower.append(darkest >= thr - 15)
    share = lambda marks: 100 * sum(marks) / len(marks)
    if share(clear) >= 80:
        return "transparent", 0.0
    good = share(white) >= least and share(upper) >= 95 and share(lower) >= 80
    return ("white" if good else "complex"), share(white)


@pytest.fixture(scope="module")
def pixels(spark):
    data = []
    for k, g in enumerate(_grids()):
        h, w = g.shape[:2]
        data += [(k, w, h, x, y, *[int(v) for v in g[y, x]]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(data, "image_id long, width int, height int, x int, y int, r int, g int, b int, a int").cache()


def test_background_state_matches_single_pixels(pixels):
    got = {r.image_id: r for r in R.background_state(pixels).collect()}
    for k, g in enumerate(_grids()):
        state, white = _pixel_by_pixel(g)
        assert got[k].source_state == state, k
        assert got[k].white_percent == pytest.approx(white), k


def test_packed_rasters_give_the_same_counts(spark, pixels):
    rasters = spark.createDataFrame(
        [(k, g.shape[0], g.shape[1], 4, bytearray(g[..., [2, 1, 0, 3]].astype(np.uint8).tobytes())) for k, g in enumerate(_grids())],
        "image_id long, height int, width int, n_channels int, data binary",
    )
    key = lambda df: sorted(tuple(r) for r in df.select("image_id", "ring", "ring_clear", "ring_white", "top", "top_white", "bottom", "bottom_white").collect())
    assert key(I.raster_border_sums(rasters)) == key(R.border_sums(pixels))
    back = I.pixels_from_rasters(rasters)
    assert back.exceptAll(pixels.select(back.columns)).count() == 0


def test_boxes(pixels):
    alpha = {r.image_id: r for r in R.bbox_alpha(pixels).collect()}
    white = {r.image_id: r for r in R.bbox_nonwhite(pixels).collect()}
    for k, g in enumerate(_grids()):
        h, w = g.shape[:2]
        ys, xs = np.nonzero(g[..., 3])
        want = (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1) if len(xs) else (None,) * 4
        assert tuple(alpha[k])[1:] == want, k
        ys, xs = np.nonzero((g[..., :3] < 245).any(axis=2))
        want = (max(0, xs.min() - 1), max(0, ys.min() - 1), min(w, xs.max() + 2), min(h, ys.max() + 2)) if len(xs) else (None,) * 4
        assert tuple(white[k])[1:] == want, k


def test_thresholds_are_inclusive(rows):
    sums = lambda i, clear, white, top, bottom: (i, 1000, clear, white, 100, top, 100, bottom)
    df = rows(
        "image_id int, ring long, ring_clear long, ring_white long, top long, top_white long, bottom long, bottom_white long",
        sums(1, 800, 0, 0, 0), sums(2, 799, 0, 0, 0), sums(3, 0, 850, 95, 80), sums(4, 0, 849, 95, 80), sums(5, 0, 850, 94, 80), sums(6, 0, 850, 95, 79),
    )
    got = {r.image_id: r.source_state for r in R.state_from_sums(df).collect()}
    assert got == {1: "transparent", 2: "complex", 3: "white", 4: "complex", 5: "complex", 6: "complex"}


def test_canvas_geometry(rows):
    rng = random.Random(1)
    sizes = [(i, rng.randint(1, 3000), rng.randint(1, 3000)) for i in range(200)] + [(900, 806, 10), (901, 806, 806), (902, 1, 5000)]
    got = R.canvas_geometry(rows("i int, width int, height int", *sizes), 960, 8).collect()
    for r in got:
        inner = max(1, int(960 * (1 - 16 / 100)))
        scale = min(inner / r.width, inner / r.height)
        w, h = r.width, r.height
        if scale < 1.0 or (w < inner and h < inner):
            w, h = max(1, int(w * scale)), max(1, int(h * scale))
        assert (r.new_width, r.new_height, r.offset_x, r.offset_y) == (w, h, (960 - w) // 2, (960 - h) // 2), r
    with pytest.raises(ValueError):
        R.canvas_geometry(rows("width int, height int", (1, 1)), 0)


def test_flatten_short_and_long_colours(rows):
    px = rows("image_id int, x int, y int, width int, height int, r int, g int, b int, a int", (1, 0, 0, 1, 1, 100, 100, 100, 0), (1, 1, 0, 1, 1, 100, 100, 100, 128))
    a, b = R.flatten_on_color(px, "#0af").orderBy("x").collect()
    assert (a.r, a.g, a.b) == (0, 170, 255)
    assert (b.r, b.g, b.b) == tuple(round((100 * 128 + c * 127) / 255) for c in (0, 170, 255))


def test_pasting_through_own_opacity_squares_it(rows):
    px = rows("image_id int, x int, y int, width int, height int, r int, g int, b int, a int", (1, 0, 0, 1, 1, 9, 9, 9, 128))
    box = rows("image_id int, left int, top int, right int, bottom int", (1, 0, 0, 1, 1))
    r = R.crop_translate(px, box, 3).collect()[0]
    assert (r.x, r.y, r.a) == (1, 1, round(128 * 128 / 255))
