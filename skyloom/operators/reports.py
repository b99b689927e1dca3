"""Session summaries, reference choice and report tables over frames and star cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import exposure_key, finite, focal_length


def sharpest(frames: DataFrame, n: int) -> DataFrame:
    """The max(2, n) frames with the least FWHM (unknown last), heavier ones first among equals."""
    order = [finite("fwhm").asc_nulls_last(), F.col("weight").desc(), F.col("frame")]
    return frames.orderBy(*order).limit(max(2, n))


def choose_reference(frames: DataFrame) -> DataFrame:
    """The one reference frame: on the finest pixel scale where scales differ, from the exposure that carries most
    time (three frames at least), with 0.8 of the median stars, with 0.9 of the 90th percentile of star light a
    second, least fwhm * (1 + 0.1 * noise over its median). ``frames``: frame, fwhm, noise, stars, light,
    exposure, scale. Medians are of the session: one row."""
    f = frames.filter(finite("fwhm").isNotNull())
    lo = f.agg(F.min("scale").alias("__lo"), F.max("scale").alias("__hi"), (F.count("scale") == F.count("*")).alias("__all"))
    f = f.join(F.broadcast(lo)).filter(~(F.col("__all") & (F.col("__hi") > 1.01 * F.col("__lo"))) | (F.col("scale") <= 1.01 * F.col("__lo"))).withColumn("__e", exposure_key("exposure"))
    each = f.groupBy("__e").agg(F.count("*").alias("__c")).withColumn("__time", F.coalesce("__e", F.lit(0.0)) * F.col("__c"))
    first = each.orderBy(F.desc("__time"), F.col("__e").asc_nulls_last()).limit(1)
    several = each.agg((F.count("*") > 1).alias("__several"))
    main = first.select(F.col("__e").alias("__main"), F.col("__c").alias("__n")).join(F.broadcast(several))
    f = f.join(F.broadcast(main)).filter(~(F.col("__several") & F.col("__main").isNotNull() & (F.col("__n") >= 3)) | (F.col("__e") == F.col("__main")))
    middle = f.agg(F.median("stars").alias("__ms"), F.median("noise").alias("__mn"))
    f = f.join(F.broadcast(middle)).filter(F.col("stars") >= 0.8 * F.col("__ms"))
    timed = f.agg(F.min(F.coalesce(F.col("exposure") > 0, F.lit(False))).alias("__timed"))
    f = f.join(F.broadcast(timed)).withColumn("__light", F.when(F.col("__timed"), F.col("light") / F.col("exposure")).otherwise(F.col("light")))
    top = f.agg(F.expr("percentile(__light, 0.9)").alias("__top"))
    f = f.join(F.broadcast(top)).filter(F.col("__light") >= 0.9 * F.col("__top"))
    score = F.col("fwhm") * (1 + 0.1 * F.col("noise") / F.greatest(F.col("__mn"), F.lit(1e-9)))
    return f.withColumn("score", score).orderBy("score", "frame").limit(1).select("frame", "score")


def flip_summary(frames: DataFrame) -> DataFrame:
    """(flipped, frames, fwhm, transparency) on the two sides of the meridian: rotation beyond 90 degrees."""
    return frames.groupBy((F.abs("rotation") > 90).alias("flipped")).agg(F.count("*").alias("frames"), F.median(finite("fwhm")).alias("fwhm"), F.median(finite("transparency")).alias("transparency"))


def regional_medians(points: DataFrame, width: int, height: int, cells: int = 4, least: int = 5) -> DataFrame:
    """(row, col, n, median) of a value over the cells of an image; NULL below ``least``."""
    at = lambda c, n: F.least(F.floor(F.col(c) * cells / n), F.lit(cells - 1)).cast("long")
    return points.groupBy(at("y", height).alias("row"), at("x", width).alias("col")).agg(F.count(finite("v")).alias("n"), F.when(F.count(finite("v")) >= least, F.median(finite("v"))).alias("median"))


def field_factors(cells: DataFrame, low: float = 0.5, high: float = 2.0, prior: float = 16.0) -> DataFrame:
    """(frame, row, col, factor): how much sharper than the session a frame is in a cell, 1 / ratio^2 of FWHM over
    its frame's and then the cell's median, clipped and drawn towards 1 where few stars were measured."""
    v = F.when(finite("fwhm") > 0, F.col("fwhm"))
    c = cells.withColumn("__r", v / F.median(v).over(Window.partitionBy("frame")))
    ratio = F.col("__r") / F.median("__r").over(Window.partitionBy("row", "col"))
    factor = F.when(ratio.isNotNull(), F.least(F.greatest(1 / (ratio * ratio), F.lit(low)), F.lit(high))).otherwise(1.0)
    trust = F.greatest(F.col("stars"), F.lit(0)) / (F.greatest(F.col("stars"), F.lit(0)) + F.lit(prior))
    return c.withColumn("factor", factor).select("frame", "row", "col", F.exp(F.log("factor") * trust).alias("factor"))


def tilt_verdict(level: str = "level", tx: str = "tilt_x", ty: str = "tilt_y", curve: str = "curvature", scatter: str = "scatter") -> F.Column:
    """A line of text on a fitted plane: tilt against scatter, curvature, or an even field."""
    tilt = F.sqrt(F.col(tx) * F.col(tx) + F.col(ty) * F.col(ty)) / F.greatest(F.col(level), F.lit(1e-9))
    side = F.concat(F.when(F.col(ty) > 0, "bottom ").otherwise("top "), F.when(F.col(tx) > 0, "right").otherwise("left"))
    return F.when(F.col(level).isNull(), "too few stars").when((F.col(scatter) > 0) & (tilt < F.col(scatter)), "tilt is within the scatter of frames").when(tilt > 0.1, F.concat(F.lit("tilted, soft towards the "), side)).when(F.abs(F.col(curve)) / F.greatest(F.col(level), F.lit(1e-9)) > 0.1, "curved field").otherwise("even field")


def overlap_residuals(blocks: DataFrame, least: float = 4.5) -> DataFrame:
    """(i, j, by, bx, residual, z): blocks of tile pairs whose level differs by ``least`` robust sigmas from the
    pair's, the eight worst of each. ``blocks``: i, j, by, bx, a, b (the two tiles' medians)."""
    w = Window.partitionBy("i", "j")
    b = blocks.withColumn("residual", F.col("a") - F.col("b")).withColumn("__m", F.median("residual").over(w)).withColumn("__d", F.abs(F.col("residual") - F.col("__m")))
    z = F.col("__d") / (1.4826 * F.median("__d").over(w) + 1e-9)
    worst = Window.partitionBy("i", "j").orderBy(F.desc("z"), "by", "bx")
    return b.withColumn("z", z).filter(F.col("z") >= least).withColumn("__n", F.row_number().over(worst)).filter("__n <= 8").select("i", "j", "by", "bx", "residual", "z")


def frame_rows(frames: DataFrame) -> DataFrame:
    """The rows of the frame report: numbers rounded as they are shown."""
    digits = {"fwhm": 3, "noise": 4, "sky": 2, "transparency": 4, "weight": 4, "rotation": 3, "exposure": 2}
    return frames.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in frames.columns])


def write_csv(frame: DataFrame, path: str) -> None:
    """A report as CSV with a header, NULL as nothing; the report is a row a frame."""
    frame.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def session_table(lights: DataFrame, judged: DataFrame, aligned: DataFrame, weighed: DataFrame) -> DataFrame:
    """A row a frame of a stack with all that was measured and decided, and why it is not in the image if so.
    ``lights``: frame, path, header; the others: what the stages of the stack give."""
    cell = lambda c, form: F.array_join(F.transform(c, lambda v: F.when(v.isNull() | F.isnan(v.cast("double")), "nan").otherwise(F.format_string(form, v))), " ")
    told = lights.select("frame", "path", focal_length("header").alias("focal_length_mm"))
    a = aligned.select("frame", "matrix", "matched", "refined", "rms", "failure")
    w = weighed.select("frame", "flux_ratio", F.col("transparency").alias("relative_flux"), "psfsw", F.col("measured").alias("phot_stars"), F.when(F.col("reason").isNull(), F.col("weight")).alias("weight"), F.col("reason").alias("filtered"))
    j = judged.join(told.drop("path"), "frame").join(a, "frame", "left").join(w, "frame", "left")
    at = lambda k: F.get("matrix", F.lit(k))
    turn = F.degrees(F.atan2(at(3), at(0)))
    excluded = F.coalesce("reason", "failure", "filtered")
    return j.select(
        "frame", F.element_at(F.split("path", "/"), -1).alias("file"), excluded.isNull().alias("stacked"), F.col("exposure").alias("exposure_s"), "focal_length_mm", "camera", F.col("arcsec").alias("pixel_scale_arcsec"),
        F.round(F.col("fwhm") * F.col("arcsec"), 3).alias("fwhm_arcsec"), "stars", F.when(F.col("exposure") > 0, F.col("light") / F.col("exposure")).alias("bright_star_rate"), F.round(finite("fwhm"), 3).alias("fwhm_px"),
        cell("grid", "%.2f").alias("fwhm_grid"), cell("counts", "%d").alias("fwhm_grid_counts"), F.round("noise", 4).alias("noise"), F.round("sky", 2).alias("background"), F.round("relative_flux", 4).alias("transparency"), F.round("flux_ratio", 4).alias("flux_ratio"),
        F.round("psfsw", 6).alias("psfsw"), "phot_stars", F.round("weight", 4).alias("weight"), F.round(at(2), 3).alias("shift_x"), F.round(at(5), 3).alias("shift_y"), F.round(turn, 4).alias("rotation_deg"),
        F.round(F.sqrt(at(0) * at(0) + at(3) * at(3)), 6).alias("scale"), "matched", F.col("refined").alias("refined_matches"), F.round(finite("rms"), 3).alias("residual_rms_px"), (F.abs(turn) > 90).alias("flipped"), excluded.alias("excluded"),
    )
