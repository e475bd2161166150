"""Raster queries take the raster's own extent: rows beyond the hundredth count, and a lower one has its own border."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import raster
from fieldloom.plans import registry

ROWS, COLS = 131, 100


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """events of a raster of 131 rows: clear to row 104, set below but for a hole and a bay at the lower border."""
    folder = str(tmp_path_factory.mktemp("tall"))
    row, col = F.expr("id div 100"), F.expr("id % 100")
    hole = (row.between(110, 112) & col.between(10, 12)) | ((row >= 125) & col.between(50, 54))
    value = F.when((row >= 104) & ~hole, 100.0).otherwise(row * 0.01)
    spark.range(ROWS * COLS).select(
        F.col("id").alias("event_id"), F.lit(0).alias("user_id"), F.lit("view").alias("event_type"), value.alias("value")
    ).write.parquet(f"{folder}/events.parquet")
    return folder


def grid(df, name="v"):
    out = np.full((ROWS, COLS), np.nan)
    for r in df.collect():
        assert np.isnan(out[r["row"], r["col"]])
        out[r["row"], r["col"]] = r[name]
    return out


@pytest.fixture(scope="module")
def ones():
    out = np.zeros((ROWS, COLS))
    out[104:] = 1
    out[110:113, 10:13] = out[125:, 50:55] = 0
    return out


def test_every_cell_is_blended(spark, tall):
    for name, per_cell in (("blend_windows", 4), ("blend_windows_hann", 4), ("argmax_class", 1)):
        got = registry.queries()[name](spark, tall)
        assert got.count() == got.select("row", "col").distinct().count() * per_cell == ROWS * COLS * per_cell, name


def test_windows_reach_every_edge(spark):
    for height, width in ((10, 3), (20, 36), (21, 37), (131, 100)):
        cells = spark.range(height * width).selectExpr(f"id div {width} AS row", f"id % {width} AS col")
        assert raster.extent(cells) == (height, width)
        assert raster.window_cells(cells, 20, 16, height, width).select("row", "col").distinct().count() == height * width
    assert raster.extent(cells.limit(0)) == (0, 0)


def test_samples_are_cut_below_row_100(spark, tall, ones):
    got = {(r["w_row"], r["w_col"]): r["total"] for r in registry.queries()["cut_samples"](spark, tall).collect()}
    sums = {(i, j): ones[i * 16 : i * 16 + 20, j * 16 : j * 16 + 20].sum() for i in range(8) for j in range(6)}
    want = {k: v for k, v in sums.items() if v >= 120}
    assert want and got == want


def test_holes_end_at_the_true_border(spark, tall, ones):
    want = ones.copy()
    want[110:113, 10:13] = 1
    assert (grid(registry.queries()["fill_mask_holes"](spark, tall)) == want).all()


def test_smoothing_mirrors_at_the_true_border(spark, tall, ones):
    k = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    k /= k.sum()
    padded = np.pad(ones, 6, mode="symmetric")
    rows = np.array([np.convolve(c, k, "valid") for c in padded.T]).T
    smooth = np.array([np.convolve(c, k, "valid") for c in rows])
    got = grid(registry.queries()["gaussian_smooth"](spark, tall))
    assert not np.isnan(got).any() and (got == (smooth > 0.5))[np.abs(smooth - 0.5) > 1e-9].all()


def test_mask_pipeline_gives_every_cell(spark, tall):
    got = grid(registry.queries()["mask_pipeline"](spark, tall))
    assert not np.isnan(got).any() and got[115:120].all() and not got[:100].any()


def test_target_grids_cover_the_raster(spark, tall):
    got = registry.queries()["align_raster_pair"](spark, tall)
    assert got.agg(F.max("trow"), F.max("tcol"), F.count("*")).first()[:] == (77, 58, 78 * 59)
    assert got.where("trow = 76 and value is null").count() == 0
    got = registry.queries()["reproject_raster"](spark, tall).where("value is not null")
    north = lambda lat: math.log(math.tan((90 + lat) * math.pi / 360)) * 20037508.342789244 / math.pi
    assert got.agg(F.max("row")).first()[0] >= (north(34 + ROWS * 0.01) - north(34)) // 2500 - 1


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
def test_rows_beyond_the_pole_have_no_place_on_the_plane(spark, method):
    pixels = spark.range(60).selectExpr("id div 3 AS row", "id % 3 AS col", "cast(id as double) AS value")
    cells = lambda df, height: sorted(map(tuple, raster.reproject_raster(df, 108.0, 89.0, 0.1, height, 3, 20000.0, method).collect()))
    got = cells(pixels, 20)  # up to latitude 91
    assert got == cells(pixels.where("row < 10"), 10) and {v for *_, v in got} >= {0.0 if method == "nearest" else None}
    with pytest.raises(ValueError):
        raster.reproject_raster(pixels, 108.0, 95.0, 0.1, 5, 3, 20000.0)
