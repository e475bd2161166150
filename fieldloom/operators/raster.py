"""Rasters as pixel tables (row, col, value columns; null is no data): map algebra, terrain, windows and masks."""

from __future__ import annotations

import math
from functools import reduce
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.operators.selection import percentiles

#: Functions that a raster expression may call.
ALLOWED = frozenset("abs sqrt exp ln log10 power least greatest sin cos tan atan coalesce isnull when case if floor ceil round nullif".split())


def band_pivot(pixels: DataFrame, bands: list[int]) -> DataFrame:
    """Bands side by side: row, col, band_<n>."""
    wide = pixels.groupBy("row", "col").pivot("band", bands).agg(F.first("value"))
    return wide.select("row", "col", *[F.col(f"`{b}`").alias(f"band_{b}") for b in bands])


def checked_expression(text: str, columns: list[str]) -> Column:
    """A column expression of band names, numbers, operators and ALLOWED functions; anything else is an error."""
    if not re.fullmatch(r"[\w\s.+\-*/%()<>=!,]*", text):
        raise ValueError(f"sign not allowed in {text!r}")
    for word in re.findall(r"[A-Za-z_]\w*", text):
        if word.lower() not in ALLOWED and word not in columns and word.lower() not in ("and", "or", "not", "then", "else", "end", "null"):
            raise ValueError(f"name not allowed: {word}")
    return F.expr(text)


def raster_calculator(wide: DataFrame, text: str, nodata: float = -9999.0) -> DataFrame:
    """row, col, value of a checked expression; no data (null or NaN) becomes ``nodata``."""
    value = checked_expression(text, wide.columns).cast("double")
    return wide.select("row", "col", F.when(value.isNull() | F.isnan(value), F.lit(nodata)).otherwise(value).alias("value"))


def reclassify(pixels: DataFrame, rules: list[tuple[float, float, float]], nodata: float) -> DataFrame:
    """``[low, high)`` to a value; later rules win, no rule gives ``nodata``."""
    out = F.lit(float(nodata))
    for low, high, value in rules:
        out = F.when((F.col("value") >= low) & (F.col("value") < high), F.lit(float(value))).otherwise(out)
    return pixels.withColumn("value", out)


def raster_statistics(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """min, max, mean, population deviation, median (exact, by selection) and counts of valid, all and missing cells."""
    whole = pixels.groupBy(*keys).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.count("value").alias("valid"), F.count("*").alias("total"), (F.count("*") - F.count("value")).alias("missing"),
    )
    median = percentiles(pixels, keys, "value", [0.5]).select(*keys, F.col("value").alias("median"))
    return whole.join(median, keys, "left").select(*keys, "min", "max", "mean", "std", "median", "valid", "total", "missing")


def histogram(pixels: DataFrame, bins: int) -> DataFrame:
    """(bin from 0, count) of equal-width bins over the valid values; the maximum belongs to the last bin."""
    ends = pixels.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()  # two numbers
    lo, width = ends["lo"], ((ends["hi"] or 0) - (ends["lo"] or 0)) / bins or 1.0
    at = F.least(F.floor((F.col("value") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    return pixels.where(F.col("value").isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def _gradient(value: str, along: str, across: list[str], res: float) -> Column:
    w = W.partitionBy(*across).orderBy(along)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    first, last = F.lag(along).over(w).isNull(), F.lead(along).over(w).isNull()
    step = F.when(first | last, 1.0).otherwise(2.0)
    return (F.when(last, F.col(value)).otherwise(after) - F.when(first, F.col(value)).otherwise(before)) / step / res


def slope(pixels: DataFrame, res: float) -> DataFrame:
    """row, col, gx, gy, slope in degrees: central differences inside, one-sided at the edges; null beside no data."""
    g = pixels.withColumn("gx", _gradient("value", "col", ["row"], res)).withColumn("gy", _gradient("value", "row", ["col"], res))
    g = g.withColumn("gx", F.when(F.col("value").isNotNull(), F.col("gx"))).withColumn("gy", F.when(F.col("value").isNotNull(), F.col("gy")))
    return g.select("row", "col", "gx", "gy", F.degrees(F.atan(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))).alias("slope"))


def hillshade(pixels: DataFrame, res: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """row, col, shade 0..255: cos(alt) cos(s) + sin(alt) sin(s) cos(az' - aspect), cut off; no data gives 0."""
    g = slope(pixels, res)
    az, alt = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    s, aspect = F.atan(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)), F.atan2(F.col("gy"), -F.col("gx"))
    shade = math.cos(alt) * F.cos(s) + math.sin(alt) * F.sin(s) * F.cos(F.lit(az) - aspect)
    return g.select("row", "col", F.coalesce(F.greatest(F.least(F.floor(shade * 255), F.lit(255)), F.lit(0)), F.lit(0)).cast("int").alias("shade"))


def resample(pixels: DataFrame, factor: int, how: str) -> DataFrame:
    """Cells of ``factor`` x ``factor`` become one: average, mode (smallest on ties), max, min, med, q1, q3 or sum."""
    agg = {
        "average": F.avg("value"), "mode": F.expr("mode(value, true)"), "max": F.max("value"), "min": F.min("value"), "sum": F.sum("value"),
        "med": F.expr("percentile(value, 0.5)"), "q1": F.expr("percentile(value, 0.25)"), "q3": F.expr("percentile(value, 0.75)"),
    }[how]
    block = [F.floor(F.col(c) / factor).cast("long").alias(c) for c in ("row", "col")]
    return pixels.groupBy(*block).agg(agg.alias("value"))


def resample_scale(pixels: DataFrame, scale: float, height: int, width: int, how: str = "bilinear") -> DataFrame:
    """The raster at int(height * scale) x int(width * scale) cells, by any factor: ``bilinear`` or ``nearest``.

    Bilinear weights fall with the distance of cell centres to 0 at one cell of the coarser of both grids, and are shared
    among the cells with data; cells without any get no row. Each source cell is sent to the target cells it counts for.
    """
    reach = max(1.0, 1 / scale)
    rows, cols = int(height * scale), int(width * scale)

    def targets(axis: str, n: int) -> Column:
        at = F.col(axis).cast("double")
        if how == "nearest":
            low, high = F.ceil(at * scale - 0.5), F.ceil((at + 1) * scale - 0.5) - 1
        else:
            low, high = F.ceil((at - reach + 0.5) * scale - 0.5), F.floor((at + reach + 0.5) * scale - 0.5)
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(n - 1))
        return F.when(low <= high, F.sequence(low.cast("long"), high.cast("long")))

    def weight(axis: str) -> Column:
        return F.lit(1.0) - F.abs((F.col(f"t_{axis}") + 0.5) / scale - 0.5 - F.col(axis)) / reach

    sent = pixels.where("value is not null").withColumn("t_row", F.explode(targets("row", rows))).withColumn("t_col", F.explode(targets("col", cols)))
    if how == "nearest":
        return sent.select(F.col("t_row").alias("row"), F.col("t_col").alias("col"), "value")
    sent = sent.withColumns({"wr": weight("row"), "wc": weight("col")}).where("wr > 1e-12 and wc > 1e-12").withColumn("w", F.col("wr") * F.col("wc"))
    return sent.groupBy(F.col("t_row").alias("row"), F.col("t_col").alias("col")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def bilinear(pixels: DataFrame, targets: DataFrame, x0: float, y0: float, res: float) -> DataFrame:
    """Values at ``targets`` (key columns and x, y): weights of the up to four cells around, over those with data.

    The grid's lower-left corner is (x0, y0); row 0 is the lowest. Targets without any valid cell get null.
    """
    keys = targets.columns
    u, v = (F.col("x") - x0) / res - 0.5, (F.col("y") - y0) / res - 0.5
    four = targets.withColumns({"u": u, "v": v}).withColumn("dc", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("dr", F.explode(F.array(F.lit(0), F.lit(1))))
    four = four.withColumns({"col": (F.floor("u") + F.col("dc")).cast("long"), "row": (F.floor("v") + F.col("dr")).cast("long")})
    four = four.withColumn("w", (1 - F.abs(F.col("u") - F.col("col"))) * (1 - F.abs(F.col("v") - F.col("row")))).where("w > 0")
    met = four.join(pixels.where("value is not null").select("row", "col", "value"), ["row", "col"])
    found = met.groupBy(*keys).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return targets.join(found, keys, "left")


def mosaic(layers: DataFrame) -> DataFrame:
    """(row, col, value, priority) of many rasters on one grid: the valid value of the smallest priority."""
    return layers.where("value is not null").groupBy("row", "col").agg(F.min_by("value", "priority").alias("value"))


def mosaic_on_grid(layers: DataFrame, res: float) -> DataFrame:
    """``mosaic`` of rasters with corners of their own: rows (row, col, value, priority, x0, y0), ``x0, y0`` a raster's
    lower-left corner.

    The common grid begins at the smallest corner; every raster moves to the nearest of its cells. Gives row, col, value and
    the grid's corner.
    """
    low = layers.agg(F.min("x0").alias("gx"), F.min("y0").alias("gy"))
    step = lambda c, g: F.floor((F.col(c) - F.col(g)) / res + 0.5).cast("long")
    placed = layers.crossJoin(F.broadcast(low)).withColumns({"row": F.col("row") + step("y0", "gy"), "col": F.col("col") + step("x0", "gx")})  # one row
    return mosaic(placed.select("row", "col", "value", "priority")).crossJoin(F.broadcast(low)).withColumnsRenamed({"gx": "x0", "gy": "y0"})


def sample_at_points(pixels: DataFrame, points: DataFrame, x0: float, y0: float, res: float) -> DataFrame:
    """``points`` with the value of the cell that holds them; null outside (row 0 is the lowest)."""
    at = points.withColumns({"col": F.floor((F.col("x") - x0) / res).cast("long"), "row": F.floor((F.col("y") - y0) / res).cast("long")})
    return at.join(pixels.select("row", "col", "value"), ["row", "col"], "left").drop("row", "col")


def spectral_class(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Hue 0..180, saturation and value 0..255 of 8-bit colours."""
    high, low = F.greatest(red, green, blue), F.least(red, green, blue)
    d = high - low
    hue = (
        F.when(d == 0, 0.0)
        .when(high == red, 60 * (green - blue) / d)
        .when(high == green, 120 + 60 * (blue - red) / d)
        .otherwise(240 + 60 * (red - green) / d)
    )
    return F.when(hue < 0, hue + 360).otherwise(hue) / 2, F.when(high == 0, 0.0).otherwise(255 * d / high), high


def zonal_statistics(pixels: DataFrame, zones: DataFrame, key: str, cell: float = 1.0) -> DataFrame:
    """count, min, max, mean of the cells whose centres lie in each (half-open) box; cells are ``cell`` wide."""
    from fieldloom.operators.vector import rasterize

    covered = rasterize(zones, cell).select(key, "row", "col")
    return pixels.where("value is not null").join(covered, ["row", "col"]).groupBy(key).agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )


def difference_map(a: DataFrame, b: DataFrame) -> DataFrame:
    """|A - B| over the greatest difference, and the quarter 0..3 that it falls in."""
    d = a.select("row", "col", F.col("value").alias("a")).join(b.select("row", "col", F.col("value").alias("b")), ["row", "col"])
    d = d.select("row", "col", F.abs(F.col("a") - F.col("b")).alias("d")).where("d is not null")
    top = d.agg(F.max("d").alias("top"))
    share = F.when(F.col("top") > 0, F.col("d") / F.col("top")).otherwise(0.0)
    joined = d.join(F.broadcast(top))  # one row
    return joined.select("row", "col", share.alias("share"), F.least(F.floor(share * 4), F.lit(3)).cast("int").alias("band"))


def percentile_stretch(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values between two percentiles to 0..255, cut off outside."""
    found = percentiles(pixels, [], "value", [low, high]).orderBy("share").collect()  # two rows
    if not found:
        return pixels
    ends = [found[0]["value"], found[-1]["value"]]
    width = ends[1] - ends[0] or 1.0
    return pixels.withColumn("value", F.greatest(F.least((F.col("value") - ends[0]) / width, F.lit(1.0)), F.lit(0.0)) * 255)


# Masks: (row, col, v) with v 0 or 1.


def _disk(radius: int, norm: str = "l2") -> list[tuple[int, int]]:
    reach = range(-radius, radius + 1)
    inside = (lambda i, j: i * i + j * j <= radius * radius) if norm == "l2" else (lambda i, j: abs(i) + abs(j) <= radius) if norm == "l1" else (lambda i, j: True)
    return [(i, j) for i in reach for j in reach if inside(i, j)]


def _spread(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Set cells moved by all offsets, each target once."""
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    return cells.select("row", "col", F.explode(moves).alias("m")).select((F.col("row") + F.col("m.i")).alias("row"), (F.col("col") + F.col("m.j")).alias("col")).distinct()


def dilate(mask: DataFrame, radius: int, norm: str = "l2", value: int = 1) -> DataFrame:
    """Cells within a disk of a cell with ``value`` take that value; cells outside the raster count as neutral."""
    hit = _spread(mask.where(F.col("v") == value).select("row", "col"), _disk(radius, norm)).withColumn("hit", F.lit(True))
    return mask.join(hit, ["row", "col"], "left").withColumn("v", F.when(F.col("hit"), F.lit(value)).otherwise(F.col("v"))).drop("hit")


def erode(mask: DataFrame, radius: int, norm: str = "l2") -> DataFrame:
    return dilate(mask, radius, norm, 0)


def open_mask(mask: DataFrame, radius: int) -> DataFrame:
    return dilate(erode(mask, radius), radius)


def close_mask(mask: DataFrame, radius: int) -> DataFrame:
    return erode(dilate(mask, radius), radius)


def mask_union(*masks: DataFrame) -> DataFrame:
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m)
    return out.groupBy("row", "col").agg(F.max("v").alias("v"))


def gaussian_smooth(mask: DataFrame, sigma: float, threshold: float, height: int, width: int) -> DataFrame:
    """Separable Gaussian (cut at 4 sigma, mirrored edges), then v = 1 above the threshold."""
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weights = [x / sum(raw) for x in raw]

    def along(df: DataFrame, axis: str, n: int) -> DataFrame:
        other = "col" if axis == "row" else "row"
        taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-reach, reach + 1), weights)])
        moved = df.select(other, "v", F.explode(taps).alias("t"), F.col(axis).alias("from")).withColumn("to", F.col("from") + F.col("t.k"))
        # A mirrored cell also reaches targets inside through its images beyond both edges.
        images = F.array(F.col("to"), -F.col("to") - 1, 2 * n - 1 - F.col("to"))
        inside = moved.select(other, "v", F.col("t.w").alias("w"), F.explode(F.array_distinct(F.filter(images, lambda x: (x >= 0) & (x < n)))).alias(axis))
        return inside.groupBy("row", "col").agg(F.sum(F.col("v") * F.col("w")).alias("v"))

    smooth = along(along(mask.withColumn("v", F.col("v").cast("double")), "row", height), "col", width)
    return smooth.select("row", "col", F.when(F.col("v") > threshold, 1).otherwise(0).alias("v"))


def boundary(mask: DataFrame, norm: str = "box") -> DataFrame:
    """Set cells that a 3x3 (``box``) or 4-neighbour (``l1``) erosion takes away."""
    return mask.where("v = 1").select("row", "col").join(erode(mask, 1, norm).where("v = 0").select("row", "col"), ["row", "col"], "left_semi")


def boundary_f1(truth: DataFrame, pred: DataFrame, tolerance: int = 2) -> DataFrame:
    """precision, recall, f1 of boundary cells with a match within a city-block distance."""
    t, p = boundary(truth), boundary(pred)
    hit_p = p.join(_spread(t, _disk(tolerance, "l1")), ["row", "col"], "left_semi").agg(F.count("*").alias("hp"))
    hit_t = t.join(_spread(p, _disk(tolerance, "l1")), ["row", "col"], "left_semi").agg(F.count("*").alias("ht"))
    one = hit_p.join(hit_t).join(p.agg(F.count("*").alias("np"))).join(t.agg(F.count("*").alias("nt")))  # single rows
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    both = one.select(ratio("hp", "np").alias("precision"), ratio("ht", "nt").alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return both.withColumn("f1", f1)


def class_boundaries(cells: DataFrame) -> DataFrame:
    """row, col, class of the cells that a 3x3 erosion takes from their class; what lies outside the raster is no class."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    met = cells.select("row", "col", "class", F.explode(around).alias("m")).select((F.col("row") + F.col("m.i")).alias("row"), (F.col("col") + F.col("m.j")).alias("col"), "class")
    inner = met.groupBy("row", "col", "class").agg(F.count("*").alias("n")).where("n = 9").drop("n")
    return cells.select("row", "col", "class").join(inner, ["row", "col", "class"], "left_anti")


def class_boundary_f1(truth: DataFrame, pred: DataFrame, classes: list[int], tolerance: int = 2) -> DataFrame:
    """class, precision, recall, f1 of each of the classes that ``truth`` holds: boundary cells with a boundary cell of the
    same class on the other side within a city-block distance. All classes at once; a class without cells in ``pred`` has 0."""
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _disk(tolerance, "l1")])

    def near(edge: DataFrame) -> DataFrame:
        moved = edge.select("class", "row", "col", F.explode(moves).alias("m"))
        return moved.select("class", (F.col("row") + F.col("m.i")).alias("row"), (F.col("col") + F.col("m.j")).alias("col")).distinct().withColumn("hit", F.lit(1))

    t, p = (class_boundaries(x.where(F.col("class").isin(classes))) for x in (truth, pred))
    on = ["class", "row", "col"]
    share = lambda a, b, name: a.join(near(b), on, "left").groupBy("class").agg((F.count("hit") / F.count("*")).alias(name))
    both = share(t, p, "recall").join(share(p, t, "precision"), "class", "left").select("class", F.coalesce("precision", F.lit(0.0)).alias("precision"), "recall")
    return both.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-8)))


def mean_boundary_f1(truth: DataFrame, pred: DataFrame, classes: list[int], tolerance: int = 2) -> DataFrame:
    """One row: the mean f1 over the classes that ``truth`` holds (0 if none), and their number."""
    return class_boundary_f1(truth, pred, classes, tolerance).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"), F.count("*").alias("classes"))


# Windows.


def sliding_windows(headers: DataFrame, size: int, stride: int, scheme: str) -> DataFrame:
    """(raster_id, row0, col0, height, width) of each window over headers (raster_id, height, width).

    ``full``: whole windows only. ``last``: also one that ends at the edge. ``clamp``: starts at each stride, moved back
    into the raster (duplicates stay). ``ragged``: starts at each stride, cut at the edge. ``fit``: as ``full``, but a raster
    smaller than a window has one, cut at its edges.
    """

    def starts(n: Column) -> Column:
        room = F.greatest(n - size, F.lit(0))
        if scheme == "full":
            return F.when(n >= size, F.sequence(F.lit(0), room, F.lit(stride)))
        if scheme == "fit":
            return F.sequence(F.lit(0), room, F.lit(stride))
        if scheme == "last":
            return F.array_distinct(F.concat(F.sequence(F.lit(0), room, F.lit(stride)), F.array(room)))
        every = F.sequence(F.lit(0), n - 1, F.lit(stride))
        return F.transform(every, lambda s: F.least(s, room)) if scheme == "clamp" else every

    h, w = F.col("height").cast("int"), F.col("width").cast("int")
    out = headers.select("raster_id", h.alias("h"), w.alias("w"), F.explode(starts(h)).alias("row0"), starts(w).alias("cs"))
    out = out.select("raster_id", "h", "w", "row0", F.explode("cs").alias("col0"))
    return out.select(
        "raster_id", "row0", "col0", F.least(F.lit(size), F.col("h") - F.col("row0")).alias("height"), F.least(F.lit(size), F.col("w") - F.col("col0")).alias("width")
    )


def extent(pixels: DataFrame) -> tuple[int, int]:
    """Height and width of a raster: one past its last row and column."""
    last = pixels.agg(F.max("row").alias("row"), F.max("col").alias("col")).first()  # one row
    return (0, 0) if last["row"] is None else (last["row"] + 1, last["col"] + 1)


def window_cells(pixels: DataFrame, size: int, stride: int, height: int, width: int) -> DataFrame:
    """Pixels with each window (w_row, w_col: its number) that holds them; the last window reaches or is cut at the edge."""
    rows, cols = -(-max(height - size, 0) // stride), -(-max(width - size, 0) // stride)

    def numbers(c: str, last: int) -> Column:
        lo = F.greatest(F.ceil((F.col(c) - size + 1) / stride), F.lit(0)).cast("long")
        hi = F.least(F.floor(F.col(c) / stride), F.lit(last)).cast("long")
        return F.when(hi >= lo, F.sequence(lo, hi))

    return pixels.withColumn("w_row", F.explode(numbers("row", rows))).withColumn("w_col", F.explode(numbers("col", cols)))


def cut_samples(pixels: DataFrame, size: int, stride: int, height: int, width: int, least_sum: float, max_tiles: int) -> DataFrame:
    """(w_row, w_col, total): windows whose label sum reaches ``least_sum``, the first ``max_tiles`` in row-major order."""
    tiles = window_cells(pixels, size, stride, height, width).groupBy("w_row", "w_col").agg(F.sum("value").alias("total"))
    return tiles.where(F.col("total") >= least_sum).orderBy("w_row", "w_col").limit(max_tiles)


def blend_windows(probabilities: DataFrame, weight: Column | None = None) -> DataFrame:
    """(row, col, class, prob): mean of overlapping windows' probabilities, plain or weighted."""
    w = F.lit(1.0) if weight is None else weight
    return probabilities.withColumn("w", w).groupBy("row", "col", "class").agg((F.sum(F.col("prob") * F.col("w")) / F.sum("w")).alias("prob"))


def argmax_class(probabilities: DataFrame) -> DataFrame:
    """(row, col, class): the class of the highest probability, the lowest class on ties."""
    return probabilities.groupBy("row", "col").agg(F.max_by("class", F.struct("prob", -F.col("class"))).alias("class"))


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy-map tile numbers of a point."""
    n, r = 1 << zoom, F.radians(lat)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n)
    keep = lambda v: F.greatest(F.least(v, F.lit(n - 1)), F.lit(0)).cast("long")
    return keep(x), keep(y)


def tile_bounds(zoom: int, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of a tile in degrees."""
    n = 1 << zoom
    north = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return x / n * 360 - 180, north(y + 1), (x + 1) / n * 360 - 180, north(y)


def tiles_of_boxes(boxes: DataFrame, key: str, zoom: int) -> DataFrame:
    """(key, x, y): the tiles from that of a lon/lat box's upper left corner to that of its lower right one."""
    left, top = tile_of(F.col("x0"), F.col("y1"), zoom)
    right, bottom = tile_of(F.col("x1"), F.col("y0"), zoom)
    return boxes.select(key, F.explode(F.sequence(left, right)).alias("x"), top.alias("t"), bottom.alias("b")).select(key, "x", F.explode(F.sequence("t", "b")).alias("y"))


def max_zoom(degrees_per_pixel: Column) -> Column:
    """Two more than the first zoom, counted down from 22, with pixels no larger than the raster's, at most 20; else 14.

    Pixels shrink with the zoom, so that only zoom 22 decides.
    """
    finest = 40075016.686 / (256 * 2**22)
    return F.when(degrees_per_pixel * 111000 >= finest, 20).otherwise(14)


def in_range(values: tuple[Column, ...], ranges: tuple[tuple[float, float], ...]) -> Column:
    """Every value lies in its closed range."""
    return reduce(lambda a, b: a & b, [v.between(lo, hi) for v, (lo, hi) in zip(values, ranges)])


#: Closed ranges of hue (0..180), saturation and value (0..255).
FOREST = ((35, 85), (40, 255), (40, 255))
GRASS = ((25, 75), (20, 120), (60, 200))


def vegetation(h: Column, s: Column, v: Column) -> tuple[Column, Column]:
    """Whether a cell is forest, and whether it is grassland, which forest cells never are."""
    forest = in_range((h, s, v), FOREST)
    return forest, in_range((h, s, v), GRASS) & ~forest


def tiles_with_data(pixels: DataFrame, size: int, stride: int, height: int, width: int, max_tiles: int) -> DataFrame:
    """(w_row, w_col, cells): windows with any cell that is neither null nor 0, the first ``max_tiles`` in row-major order."""
    tiles = window_cells(pixels, size, stride, height, width).groupBy("w_row", "w_col").agg(
        F.count("value").alias("cells"), F.coalesce(F.max(F.col("value") != 0), F.lit(False)).alias("any")
    )
    return tiles.where("any").drop("any").orderBy("w_row", "w_col").limit(max_tiles)


def raster_profile(pixels: DataFrame) -> DataFrame:
    """Per band: min, max, mean, population deviation, with height and width of the whole raster."""
    size = pixels.agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    stats = raster_statistics(pixels, ["band"]).select("band", "min", "max", "mean", "std")
    return stats.join(F.broadcast(size))  # one row


def window_read(pixels: DataFrame, box: tuple[float, float, float, float], x0: float, y0: float, res: float) -> DataFrame:
    """Cells whose centres lie in the (half-open) box; row 0 is the lowest."""
    lo = lambda v, o: F.lit(math.ceil((v - o) / res - 0.5))
    ax, ay, bx, by = box
    return pixels.where((F.col("col") >= lo(ax, x0)) & (F.col("col") < lo(bx, x0)) & (F.col("row") >= lo(ay, y0)) & (F.col("row") < lo(by, y0)))


def hann_weight(size: int, floor: float = 0.05) -> Column:
    """Weight of a cell by its place (i, j) in a window: product of two Hann curves, at least ``floor``."""
    curve = lambda c: 0.5 - 0.5 * F.cos(2 * math.pi * F.col(c) / (size - 1))
    return F.greatest(curve("i") * curve("j"), F.lit(floor))


def reproject_raster(pixels: DataFrame, lon0: float, lat0: float, res: float, height: int, width: int, metres: float, method: str = "nearest") -> DataFrame:
    """A lon/lat raster on a Mercator grid of ``metres``: nearest or bilinear value of each target cell, null outside or
    without data.

    Target row 0 and column 0 begin at the raster's lower-left corner. Of a raster that reaches beyond the pole only the rows
    up to it have a place on the plane: the target ends where that of those rows would.
    """
    from fieldloom.functions.geometry import HALF, from_mercator

    stretch = lambda lat: math.tan((90 + lat) * math.pi / 360)
    if stretch(lat0) <= 0:
        raise ValueError(f"no place on the Mercator plane at latitude {lat0}")
    top = lat0 + height * res
    if stretch(top) <= 0:
        height, top = math.floor((90 - lat0) / res + 1e-9), 90.0
        pixels = pixels.where(F.col("row") < height)
    merc = lambda lon, lat: (lon * HALF / 180, math.log(stretch(lat)) * HALF / math.pi)
    (ax, ay), (bx, by) = merc(lon0, lat0), merc(lon0 + width * res, top)
    rows, cols = math.ceil((by - ay) / metres), math.ceil((bx - ax) / metres)
    target = pixels.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).alias("t_row"), (F.col("id") % cols).alias("t_col"))
    lon, lat = from_mercator(ax + (F.col("t_col") + 0.5) * metres, ay + (F.col("t_row") + 0.5) * metres)
    if method == "bilinear":
        inside = (lon >= lon0) & (lon < lon0 + width * res) & (lat >= lat0) & (lat < lat0 + height * res)
        places = target.select(F.col("t_row").alias("r"), F.col("t_col").alias("c"), F.when(inside, lon).alias("x"), F.when(inside, lat).alias("y"))
        known = bilinear(pixels, places.where("x is not null"), lon0, lat0, res).select("r", "c", "value")
        return places.join(known, ["r", "c"], "left").select(F.col("r").alias("row"), F.col("c").alias("col"), "value")
    at = target.select("t_row", "t_col", F.floor((lon - lon0) / res).cast("long").alias("col"), F.floor((lat - lat0) / res).cast("long").alias("row"))
    return at.join(pixels.select("row", "col", "value"), ["row", "col"], "left").select(F.col("t_row").alias("row"), F.col("t_col").alias("col"), "value")


def boundary_distance(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Mean nearest distance of boundary cells (4-neighbour erosion) each way, the larger and the mean of both."""
    from fieldloom.operators.vector import nearest_distance

    def points(mask: DataFrame) -> DataFrame:
        b = boundary(mask, "l1")
        return b.select((F.col("row") * 1_000_000 + F.col("col")).alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))

    t, p = points(truth), points(pred)
    there = nearest_distance(t, p, "id", 4.0).agg(F.avg("distance").alias("to_pred"))
    back = nearest_distance(p, t, "id", 4.0).agg(F.avg("distance").alias("to_truth"))
    return there.join(back).select("to_pred", "to_truth", F.greatest("to_pred", "to_truth").alias("hausdorff"), ((F.col("to_pred") + F.col("to_truth")) / 2).alias("mean"))
