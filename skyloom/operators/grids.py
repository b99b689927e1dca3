"""Relational operators on pixel grids (frame, y, x, v): blocks, stencils, drizzle, cells, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import LUMA, MAD_SIGMA


def block_stats(pixels: DataFrame, block: int) -> DataFrame:
    """(frame, by, bx, location, sigma, fraction): lower median, scaled MAD and share of valid pixels."""
    p = pixels.withColumn("by", F.floor(F.col("y") / block).cast("long")).withColumn("bx", F.floor(F.col("x") / block).cast("long"))
    p = p.withColumn("m", F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v) OVER (PARTITION BY frame, by, bx)")).withColumn("d", F.abs(F.col("v") - F.col("m")))
    return p.groupBy("frame", "by", "bx").agg(F.max("m").alias("location"), (F.lit(MAD_SIGMA) * F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)")).alias("sigma"), (F.count("v") / F.count("*")).alias("fraction"))


def block_medians(pixels: DataFrame, block: int, least: float = 0.5) -> DataFrame:
    """(frame, by, bx, median): averaging median, NULL where fewer than ``least`` of the pixels are valid."""
    p = pixels.withColumn("by", F.floor(F.col("y") / block).cast("long")).withColumn("bx", F.floor(F.col("x") / block).cast("long"))
    return p.groupBy("frame", "by", "bx").agg(F.when(F.count("v") / F.count("*") >= least, F.median("v")).alias("median"))


def norm_maps(frame_blocks: DataFrame, reference_blocks: DataFrame, scale: Column | float = 1.0, least: float = 0.5) -> DataFrame:
    """(frame, by, bx, scale, offset): what brings a block to the reference's; bad blocks take the value of the
    nearest good one in their frame."""
    r = reference_blocks.select("by", "bx", F.col("location").alias("ref"), F.col("fraction").alias("rf"))
    s = F.lit(scale) if not isinstance(scale, Column) else scale
    j = frame_blocks.join(r, ["by", "bx"]).withColumn("scale", s).withColumn("good", (F.col("fraction") >= least) & (F.col("rf") >= least))
    j = j.withColumn("offset", F.col("ref") - F.col("scale") * F.col("location"))
    good = j.filter("good").select("frame", F.col("by").alias("gy"), F.col("bx").alias("gx"), F.col("offset").alias("go"))
    bad = j.filter(~F.col("good")).select("frame", "by", "bx")
    d2 = (F.col("gy") - F.col("by")) * (F.col("gy") - F.col("by")) + (F.col("gx") - F.col("bx")) * (F.col("gx") - F.col("bx"))
    filled = bad.join(good, "frame").groupBy("frame", "by", "bx").agg(F.min(F.struct(d2.alias("d"), "gy", "gx", "go"))["go"].alias("fill"))
    return j.join(filled, ["frame", "by", "bx"], "left").select("frame", "by", "bx", "scale", F.when(F.col("good"), F.col("offset")).otherwise(F.col("fill")).alias("offset"))


def bilinear_upsample(grid: DataFrame, height: int, width: int, rows: int, cols: int, value: str = "v") -> DataFrame:
    """(frame, y, x, value) of a coarse grid (frame, by, bx, value) at every pixel, borders clamped."""
    n, m = F.lit(rows), F.lit(cols)
    p = grid.sparkSession.range(height * width).select(F.floor(F.col("id") / width).cast("long").alias("y"), (F.col("id") % width).alias("x"))
    gy = F.least(F.greatest((F.col("y") + 0.5) * n / height - 0.5, F.lit(0.0)), n - 1.0)
    gx = F.least(F.greatest((F.col("x") + 0.5) * m / width - 0.5, F.lit(0.0)), m - 1.0)
    p = p.withColumn("gy", gy).withColumn("gx", gx).withColumn("y0", F.floor("gy")).withColumn("x0", F.floor("gx")).withColumn("ty", F.col("gy") - F.col("y0")).withColumn("tx", F.col("gx") - F.col("x0"))
    corners = F.array(*[F.struct(F.least(F.col("y0") + i, n - 1).cast("long").alias("by"), F.least(F.col("x0") + j, m - 1).cast("long").alias("bx"), ((F.col("ty") if i else 1 - F.col("ty")) * (F.col("tx") if j else 1 - F.col("tx"))).alias("k")) for i in (0, 1) for j in (0, 1)])
    taps = p.select("y", "x", F.explode(corners).alias("c")).select("y", "x", F.col("c.by").alias("by"), F.col("c.bx").alias("bx"), F.col("c.k").alias("k"))
    j = taps.join(grid.select("frame", "by", "bx", F.col(value).alias("g")), ["by", "bx"])
    return j.groupBy("frame", "y", "x").agg((F.sum(F.col("g") * F.col("k")) / F.sum(F.when(F.col("g").isNotNull(), F.col("k")))).alias(value))


def reflect(i: Column, n: int) -> Column:
    """An index beyond an edge, mirrored about the edge pixel."""
    return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)


def taps(pixels: DataFrame, height: int, width: int, offsets: list[tuple[int, int]]) -> DataFrame:
    """(frame, y, x, v, dy, dx, t): every pixel with its neighbours at ``offsets``."""
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i, j in offsets])
    want = pixels.select("frame", "y", "x", "v", F.explode(steps).alias("s")).select("frame", "y", "x", "v", F.col("s.dy").alias("dy"), F.col("s.dx").alias("dx"))
    want = want.withColumn("ny", reflect(F.col("y") + F.col("dy"), height)).withColumn("nx", reflect(F.col("x") + F.col("dx"), width))
    have = pixels.select("frame", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("t"))
    return want.join(have, ["frame", "ny", "nx"]).drop("ny", "nx")


RING = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def neighbour_stats(pixels: DataFrame, height: int, width: int, stride: int = 1) -> DataFrame:
    """(frame, y, x, v, median: the fourth smallest of eight neighbours, most)."""
    t = taps(pixels, height, width, [(i * stride, j * stride) for i, j in RING])
    return t.groupBy("frame", "y", "x", "v").agg(F.get(F.array_sort(F.collect_list("t")), F.lit(3)).alias("median"), F.max("t").alias("most"))


def hot_pixels(pixels: DataFrame, height: int, width: int, sigma: DataFrame, kappa: float = 5.0) -> DataFrame:
    """``pixels`` with hot ones replaced by their neighbours' median: more than ``kappa`` sigmas above it while
    no neighbour rises by a third of that. ``sigma``: (frame, sigma)."""
    n = neighbour_stats(pixels, height, width).join(F.broadcast(sigma), "frame")
    dev = F.col("v") - F.col("median")
    hot = (dev > kappa * F.col("sigma")) & (F.col("most") - F.col("median") < 0.3 * dev + F.col("sigma"))
    return n.select("frame", "y", "x", F.when(hot, F.col("median")).otherwise(F.col("v")).alias("v"), hot.alias("hot"))


def debayer_bilinear(mosaic: DataFrame, height: int, width: int, pattern: str = "RGGB") -> DataFrame:
    """(frame, y, x, r, g, b): the weighted mean of the sites of each colour in the 3x3 neighbourhood."""
    from ..functions.columns import bayer_colour

    coloured = mosaic.withColumn("colour", bayer_colour(pattern, "y", "x"))
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx"), F.lit(float((2 - abs(i)) * (2 - abs(j)))).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    want = coloured.select("frame", "y", "x", F.explode(steps).alias("s"))
    want = want.select("frame", "y", "x", F.col("s.k").alias("k"), reflect(F.col("y") + F.col("s.dy"), height).alias("ny"), reflect(F.col("x") + F.col("s.dx"), width).alias("nx"))
    have = coloured.select("frame", F.col("y").alias("ny"), F.col("x").alias("nx"), "v", "colour")
    j = want.join(have, ["frame", "ny", "nx"])
    mean = lambda c: (F.sum(F.when(F.col("colour") == c, F.col("v") * F.col("k"))) / F.sum(F.when(F.col("colour") == c, F.col("k")))).alias(c.lower())
    return j.groupBy("frame", "y", "x").agg(mean("R"), mean("G"), mean("B"))


def calibrate(lights: DataFrame, dark: DataFrame | None = None, flat: DataFrame | None = None, pedestal: float = 0.0) -> DataFrame:
    """(light - dark) / flat + pedestal, 0 at least; masters are keyed by place."""
    out, v = lights, F.col("v")
    if dark is not None:
        out = out.join(dark.select("y", "x", F.col("v").alias("d")), ["y", "x"])
        v = v - F.col("d")
    if flat is not None:
        out = out.join(flat.select("y", "x", F.col("v").alias("f")), ["y", "x"])
        v = v / F.greatest(F.col("f"), F.lit(1e-6))
    return out.select("frame", "y", "x", F.greatest(v + pedestal, F.lit(0.0)).alias("v"))


def luma(pixels: DataFrame) -> DataFrame:
    """(frame, y, x, v) of (frame, c, y, x, v): weighted over three channels, or the only one."""
    w = F.when(F.col("c") == 0, LUMA[0]).when(F.col("c") == 1, LUMA[1]).otherwise(LUMA[2])
    return pixels.groupBy("frame", "y", "x").agg(F.when(F.count("*") == 1, F.max("v")).otherwise(F.sum(F.col("v") * w)).alias("v"))


def drizzle(samples: DataFrame, scale: float, drop: list[tuple[float, float, float]]) -> DataFrame:
    """(oy, ox, num, den): samples (x, y on the reference grid, v, w) dropped on a finer grid as points (dy, dx,
    share); partial sums meet in one shuffle."""
    steps = F.array(*[F.struct(F.lit(float(i)).alias("dy"), F.lit(float(j)).alias("dx"), F.lit(float(k)).alias("k")) for i, j, k in drop])
    s = samples.filter("v is not null").withColumn("s", F.explode(steps))
    s = s.withColumn("oy", F.floor((F.col("y") + 0.5 + F.col("s.dy")) * scale).cast("long")).withColumn("ox", F.floor((F.col("x") + 0.5 + F.col("s.dx")) * scale).cast("long"))
    k = F.col("w") * F.col("s.k")
    return s.groupBy("oy", "ox").agg(F.sum(F.col("v") * k).alias("num"), F.sum(k).alias("den"))


def drizzle_image(sums: DataFrame, least: float = 0.1) -> DataFrame:
    """(oy, ox, v): num / den, 0 where den is below ``least`` of its median."""
    t = sums.agg((F.median("den") * least).alias("t"))
    return sums.join(F.broadcast(t)).select("oy", "ox", F.when(F.col("den") >= F.col("t"), F.col("num") / F.greatest(F.col("den"), F.lit(1e-12))).otherwise(0.0).alias("v"))


def star_cells(stars: DataFrame, width: int, height: int, cells: int = 4, least: int = 8) -> DataFrame:
    """(frame, row, col, stars, fwhm, elongation, angle, coherence) per cell of the sensor; NULL below ``least``
    stars. Angles are averaged doubled, weighted by elongation less one."""
    at = lambda c, n: F.least(F.floor(F.col(c) * cells / n), F.lit(cells - 1)).cast("long")
    s = stars.withColumn("row", at("y", height)).withColumn("col", at("x", width))
    w = F.greatest(F.col("elongation") - 1, F.lit(0.0))
    c, d, t = F.sum(w * F.cos(2 * F.col("theta"))), F.sum(w * F.sin(2 * F.col("theta"))), F.sum(w)
    g = s.groupBy("frame", "row", "col").agg(F.count("*").alias("stars"), F.median("fwhm").alias("fwhm"), F.median("elongation").alias("elongation"), c.alias("c"), d.alias("d"), t.alias("t"))
    enough = F.col("stars") >= least
    angle = F.degrees(F.atan2("d", "c")) / 2
    return g.select("frame", "row", "col", "stars", F.when(enough, F.col("fwhm")).alias("fwhm"), F.when(enough, F.col("elongation")).alias("elongation"), F.when(enough, angle).alias("angle"), F.when(enough & (F.col("t") > 0), F.sqrt(F.col("c") * F.col("c") + F.col("d") * F.col("d")) / F.col("t")).alias("coherence"))


def plane_sums(cells: DataFrame, value: str = "fwhm", n: int = 4) -> DataFrame:
    """Per frame the sums of the normal equations of value = a + b x + c y + k r^2 over cell centres in -1..1;
    ``solve_plane`` turns a row into the coefficients."""
    x, y = (2 * F.col("col") + 1) / n - 1, (2 * F.col("row") + 1) / n - 1
    basis = {"1": F.lit(1.0), "x": x, "y": y, "r": x * x + y * y}
    names = list(basis)
    sums = [F.sum(F.when(F.col(value).isNotNull(), basis[a] * basis[b])).alias(f"s{a}{b}") for i, a in enumerate(names) for b in names[i:]]
    return cells.groupBy("frame").agg(F.count(value).alias("n"), *sums, *[F.sum(basis[a] * F.col(value)).alias(f"t{a}") for a in names])


def solve_plane(row: dict) -> tuple[float, float, float, float] | None:
    """(level, tilt x, tilt y, curvature): curvature from five cells on, nothing below three."""
    import numpy as np

    names = ["1", "x", "y", "r"][: 4 if row["n"] >= 5 else 3]
    if row["n"] < 3:
        return None
    a = [[row.get(f"s{p}{q}", row.get(f"s{q}{p}")) for q in names] for p in names]
    fit = np.linalg.lstsq(np.array(a, float), np.array([row[f"t{p}"] for p in names], float), rcond=None)[0]
    return tuple(float(v) for v in (*fit, *[0.0] * (4 - len(names))))


def fit_planes(cells: DataFrame, value: str = "fwhm", n: int = 4) -> DataFrame:
    """(frame, n, level, tilt_x, tilt_y, curvature): a plane fitted to each frame's cells; NULL below three cells."""
    sums = plane_sums(cells, value, n)
    kind = sums.schema["frame"].dataType.simpleString()

    def solve(batches):
        for b in batches:
            fits = [solve_plane(row) or (None,) * 4 for row in b.to_dict("records")]
            out = b[["frame", "n"]].copy()
            for k, name in enumerate(("level", "tilt_x", "tilt_y", "curvature")):
                out[name] = [f[k] for f in fits]
            yield out.astype({c: "float64" for c in out.columns[2:]})

    out = sums.mapInPandas(solve, f"frame {kind}, n long, level double, tilt_x double, tilt_y double, curvature double")
    return out.replace(float("nan"), None, ["level", "tilt_x", "tilt_y", "curvature"])


def mapped_box(points: DataFrame, by: list[str]) -> DataFrame:
    """Bounding boxes of mapped points: floor of the least, ceiling of the greatest."""
    return points.groupBy(*by).agg(F.floor(F.min("x")).alias("x0"), F.floor(F.min("y")).alias("y0"), F.ceil(F.max("x")).alias("x1"), F.ceil(F.max("y")).alias("y1"))


def blend(tiles: DataFrame, hard: bool = False) -> DataFrame:
    """(y, x, v, coverage) of (tile, y, x, v, w): the weighted mean, or the tile with most weight (ties: the
    smaller tile)."""
    v = F.max_by("v", F.struct(F.col("w"), -F.col("tile"))) if hard else F.sum(F.col("v") * F.col("w")) / F.sum("w")
    return tiles.filter("w > 0 and v is not null").groupBy("y", "x").agg(v.alias("v"), F.count("*").alias("coverage"))


def gaussian_blur(pixels: DataFrame, sigma: float) -> DataFrame:
    """Normalised separable convolution within 4 sigmas, rows and then columns; missing pixels are left out."""
    import math

    reach = max(1, math.ceil(4 * sigma))
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    out = pixels.withColumn("n", F.when(F.col("v").isNotNull(), 1.0).otherwise(0.0)).withColumn("s", F.coalesce("v", F.lit(0.0)))
    for axis in ("x", "y"):
        steps = F.array(*[F.struct(F.lit(i).alias("d"), F.lit(w).alias("k")) for i, w in zip(range(-reach, reach + 1), k, strict=True)])
        spread = out.select("frame", "y", "x", "s", "n", F.explode(steps).alias("t")).withColumn(axis, F.col(axis) + F.col("t.d"))
        summed = spread.groupBy("frame", "y", "x").agg(F.sum(F.col("s") * F.col("t.k")).alias("s"), F.sum(F.col("n") * F.col("t.k")).alias("n"))
        out = out.select("frame", "y", "x").join(summed, ["frame", "y", "x"])
    return out.select("frame", "y", "x", F.when(F.col("n") > 1e-9, F.col("s") / F.col("n")).alias("v"))


def session_median(maps: DataFrame) -> DataFrame:
    """(row, col, fwhm): the median over frames of each cell."""
    return maps.groupBy("row", "col").agg(F.median("fwhm").alias("fwhm"))


def frame_scatter(cells: DataFrame, least: int = 3) -> DataFrame:
    """One row: the median over cells of the spread of FWHM over its frame's median; NULL below ``least`` frames."""
    w = Window.partitionBy("frame")
    r = cells.withColumn("rel", F.col("fwhm") / F.median("fwhm").over(w))
    each = r.groupBy("row", "col").agg(F.stddev_pop("rel").alias("s"), F.count("rel").alias("n"))
    frames = cells.agg(F.count_distinct("frame").alias("frames"))
    return each.filter("n >= 1").agg(F.median("s").alias("s")).join(F.broadcast(frames)).select(F.when(F.col("frames") >= least, F.col("s")).alias("scatter"))
