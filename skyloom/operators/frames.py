"""Cohort statistics, filters, weights, reference ranking and grouping over a frame table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import exposure_key, finite, psf_signal, psf_signal_normalised
from ..sources.stages import use_checkpoints

#: Transparency, stars, sky and FWHM thresholds by name (0 switches a check off).
PRESETS = {"Lenient": (0.5, 0.3, 3.0, 2.0), "Balanced": (0.7, 0.5, 2.0, 1.5), "Selective": (0.85, 0.7, 1.5, 1.25)}
#: What a mode multiplies (see ``frame_weights``).
WEIGHT_MODES = {
    "none": (), "noise": ("quiet",), "fwhm": ("sharp",), "both": ("quiet", "sharp"), "psfsnr": ("clear",), "psfsnr+fwhm": ("clear", "sharp"), "psfsnr+field": ("clear",),
    "psfsw": ("signal",), "psfsw-ln": ("normalised signal",),
}


def cohort_median(value: Column, by: list[Column | str], least: int = 3) -> Column:
    """The median over a cohort of at least ``least`` finite values, else NULL."""
    w = Window.partitionBy(*by)
    return F.when(F.count(finite(value)).over(w) >= least, F.median(finite(value)).over(w))


def filter_frames(frames: DataFrame, stars_min: float = 0.5, sky_max: float = 2.0, fwhm_max: float = 1.5) -> DataFrame:
    """``frames`` (frame, stars, sky, fwhm, exposure, and optional reason) with ``reason``: why a frame is
    dropped, or NULL. Stars and sky are held against the median of the same exposure where there are several
    exposures and three frames of it, else against the session's; nothing is dropped below three frames."""
    usable = F.col("reason").isNull() if "reason" in frames.columns else F.lit(True)
    f = frames.withColumn("__key", exposure_key("exposure")).withColumn("__ok", usable)
    # medians of the session and of the exposures are small tables
    base = f.filter("__ok")
    session = base.agg(F.count("*").alias("__n"), F.median(finite("stars")).alias("__stars"), F.median(finite("sky")).alias("__sky"), F.median(finite("fwhm")).alias("__fwhm"), (F.count_distinct("__key") + F.max(F.col("__key").isNull().cast("int"))).alias("__groups"))
    each = base.groupBy("__key").agg(F.count("*").alias("__c"), F.median("stars").alias("__gstars"), F.median("sky").alias("__gsky")).filter("__c >= 3")
    each = each.withColumn("__known", F.col("__key").isNotNull()).withColumn("__key", F.coalesce("__key", F.lit(-1.0)))
    f = f.withColumn("__known", F.col("__key").isNotNull()).withColumn("__key", F.coalesce("__key", F.lit(-1.0)))
    j = f.join(F.broadcast(session)).join(each, ["__key", "__known"], "left")
    several = F.col("__groups") > 1
    stars, sky = F.when(several, F.coalesce("__gstars", "__stars")).otherwise(F.col("__stars")), F.when(several, F.coalesce("__gsky", "__sky")).otherwise(F.col("__sky"))
    checks = [
        F.when(F.lit(stars_min > 0) & (F.col("stars") < stars_min * stars), "stars"),
        F.when(F.lit(sky_max > 0) & (sky > 0) & (F.col("sky") > sky_max * sky), "sky"),
        F.when(F.lit(fwhm_max > 0) & (finite("fwhm") > fwhm_max * F.col("__fwhm")), "fwhm"),
    ]
    said = F.nullif(F.concat_ws("; ", *checks), F.lit(""))
    old = F.col("reason") if "reason" in frames.columns else F.lit(None).cast("string")
    reason = F.when(F.col("__ok") & (F.col("__n") >= 3), F.concat(F.lit("filter: "), said)).otherwise(old)
    return j.withColumn("reason", F.coalesce(reason, old)).drop(*[c for c in j.columns if c.startswith("__")])


def filter_preset(name: str) -> dict[str, float]:
    _, stars, sky, fwhm = PRESETS[name]
    return {"stars_min": stars, "sky_max": sky, "fwhm_max": fwhm}


def filter_transparency(frames: DataFrame, least: float = 0.7) -> DataFrame:
    """Renormalises transparency by the session's median, then by the camera's (three frames at least), and
    drops frames below ``least``."""
    session = frames.agg(F.when(F.count(finite("transparency")) >= 3, F.median(finite("transparency"))).alias("__t"))  # one row
    out = frames.join(F.broadcast(session)).withColumn("transparency", F.col("transparency") / F.coalesce("__t", F.lit(1.0))).drop("__t")
    out = out.withColumn("transparency", F.col("transparency") / F.coalesce(cohort_median(F.col("transparency"), ["camera"]), F.lit(1.0)))
    return out.filter(F.col("transparency").isNull() | (F.col("transparency") >= least))


def relative_signal(frames: DataFrame, noise: str = "noise", ratio: str = "flux_ratio", exposure: str = "exposure") -> DataFrame:
    """Adds ``psfsw``: (flux ratio / noise)^2 over the median of its exposure group (three valid at least)."""
    n, r = finite(noise), finite(ratio)
    out = frames.withColumn("__raw", F.when((n > 0) & (r > 0), (r / n) * (r / n))).withColumn("__key", F.coalesce(exposure_key(exposure), F.lit(-1.0)))
    return out.withColumn("psfsw", F.col("__raw") / cohort_median(F.col("__raw"), ["__key"])).drop("__raw", "__key")


def filter_signal(frames: DataFrame, least: float = 0.5) -> DataFrame:
    """Drops frames whose ``psfsw`` (see ``relative_signal``) is known and below ``least`` of its group's median."""
    return frames.filter(F.lit(least <= 0) | F.coalesce(~(finite("psfsw") < least), F.lit(True)))


def frame_weights(frames: DataFrame, mode: str = "psfsnr") -> DataFrame:
    """Adds ``weight``: the product of the mode's factors over its median, clipped to 0.05..20; 1 where it cannot be
    told. Noise, width and transparency enter as squares against the session's medians (a one-row table)."""
    if mode not in WEIGHT_MODES:
        raise ValueError(f"unknown weighting {mode!r}")
    parts = WEIGHT_MODES[mode]
    if not parts:
        return frames.withColumn("weight", F.lit(1.0))
    have = lambda c, default: finite(c) if c in frames.columns else F.lit(default)
    session = frames.agg(F.median(finite("noise")).alias("__noise"), F.median(finite("fwhm")).alias("__fwhm"))
    f = frames.join(F.broadcast(session))
    flux = F.coalesce(have("transparency", None), F.lit(1.0))
    quiet = F.col("__noise") / F.greatest(finite("noise"), F.lit(1e-9))
    sharp = F.col("__fwhm") / F.greatest(F.coalesce(finite("fwhm"), F.col("__fwhm")), F.lit(0.5))
    width = F.coalesce(F.when(finite("fwhm") > 0, finite("fwhm")), F.col("__fwhm"), F.lit(1.0))
    factor = {
        "quiet": lambda: F.pow(quiet, F.lit(2.0)),
        "clear": lambda: F.pow(flux * quiet, F.lit(2.0)),
        "sharp": lambda: F.coalesce(F.pow(sharp, F.lit(2.0)), F.lit(1.0)),
        "signal": lambda: psf_signal(flux, width, "noise", "sky"),
        "normalised signal": lambda: psf_signal_normalised(flux, width, "noise", "sky", "scale", "offset"),
    }
    product = factor[parts[0]]()
    for part in parts[1:]:
        product = product * factor[part]()
    f = f.withColumn("__w", product)
    f = f.join(F.broadcast(f.agg(F.median("__w").alias("__m"))))
    relative = F.col("__w") / F.when(F.col("__m") > 0, F.col("__m")).otherwise(1.0)
    return f.withColumn("weight", F.greatest(F.least(F.coalesce(relative, F.lit(1.0)), F.lit(20.0)), F.lit(0.05))).drop("__noise", "__fwhm", "__w", "__m")


def numbered(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """Rows with their place in an order, from 1: dealt by ranges of it, placed within a range, and moved on by the
    sizes of the ranges before (a row a partition on the driver). No task holds all rows."""
    use_checkpoints(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint(eager=True)
    before, held = [], 0
    for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():
        before.append((r["__part"], held))
        held += r["n"]
    offsets = rows.sparkSession.createDataFrame(before, "__part int, __before long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("long")
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + place).drop("__part", "__before")


def sharpness_factors(frames: DataFrame) -> DataFrame:
    """Adds ``factor``: the square of the best camera's median angular FWHM over the own camera's, 1 at most.
    Only where every camera and scale is known and scales differ by more than 1 %."""
    angular = F.when(finite("fwhm") > 0, F.col("fwhm") * F.col("scale"))
    known = frames.agg((F.count(F.when(F.col("camera").isNull() | F.col("scale").isNull(), 1)) == 0).alias("__all"), F.min("scale").alias("__lo"), F.max("scale").alias("__hi"))
    f = frames.join(F.broadcast(known)).withColumn("__a", angular)
    f = f.withColumn("__own", cohort_median(F.col("__a"), ["camera", "scale"]))
    best = f.agg(F.min("__own").alias("__best"))
    f = f.join(F.broadcast(best))
    against = F.coalesce("__own", "__a")
    ratio = F.col("__best") / against
    active = F.col("__all") & (F.col("__hi") > 1.01 * F.col("__lo")) & F.col("__best").isNotNull() & (against > 0)
    return f.withColumn("factor", F.when(active, F.least(F.lit(1.0), ratio * ratio)).otherwise(1.0)).drop("__all", "__lo", "__hi", "__a", "__own", "__best")


def rank_references(frames: DataFrame) -> DataFrame:
    """Adds ``rank``: frames with fewer than 0.8 of the median stars come behind the others, then by
    sharpness * (1 + 0.1 * noise over its median), then by name; excluded frames have none."""
    usable = ~F.col("excluded") & finite("stars").isNotNull() & finite("fwhm").isNotNull() & finite("noise").isNotNull()
    f = frames.withColumn("__ok", usable)
    timed = F.min(F.coalesce(F.col("exposure") > 0, F.lit(False)))
    base = f.filter("__ok").agg(F.median("stars").alias("__stars"), timed.alias("__timed"), F.median(F.col("noise") / F.sqrt(F.col("exposure"))).alias("__nt"), F.median("noise").alias("__n"))
    f = f.join(F.broadcast(base))
    noise = F.when(F.col("__timed"), F.col("noise") / F.sqrt(F.col("exposure"))).otherwise(F.col("noise"))
    middle = F.when(F.col("__timed"), F.col("__nt")).otherwise(F.col("__n"))
    score = F.col("fwhm") * (1 + 0.1 * noise / F.greatest(middle, F.lit(1e-9)))
    tier = F.when(F.col("stars") < 0.8 * F.col("__stars"), 1).otherwise(0)
    f = f.withColumn("__score", score).withColumn("__tier", tier)
    inner = ("__ok", "__stars", "__timed", "__nt", "__n", "__score", "__tier")
    ranked = numbered(f.filter("__ok"), ["__tier", "__score", "frame"], "rank").withColumn("rank", F.col("rank").cast("int"))
    return ranked.unionByName(f.filter("NOT __ok").withColumn("rank", F.lit(None).cast("int"))).drop(*inner)


def group_frames(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, frames, group_no from 1 in order of first appearance); unknown keys are UNKNOWN."""
    named = [F.coalesce(F.col(k).cast("string"), F.lit("UNKNOWN")).alias(k) for k in keys]
    out = frames.select(*named, F.col(order).alias("__o")).groupBy(*keys).agg(F.count("*").alias("frames"), F.min("__o").alias("__first"))
    return numbered(out, ["__first", *keys], "group_no").withColumn("group_no", F.col("group_no").cast("int")).drop("__first")


def stratified_sample(items: DataFrame, stratum: str, order: str, limit: int) -> DataFrame:
    """A deterministic sample of ``limit``: quotas by largest remainder, one a stratum at least, and in each
    stratum places spaced evenly, from the middle of each stretch."""
    sizes = items.groupBy(stratum).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(F.lit(0))
    share = F.col("__n") * F.lit(float(limit)) / F.sum("__n").over(w)
    q = sizes.withColumn("__share", share).withColumn("__q", F.greatest(F.floor("__share"), F.lit(1)))
    q = q.withColumn("__left", F.lit(limit) - F.sum("__q").over(w)).withColumn("__r", F.row_number().over(Window.orderBy(F.desc(F.col("__share") - F.floor("__share")), stratum)))
    q = q.withColumn("__q", F.least(F.col("__n"), F.col("__q") + (F.col("__r") <= F.col("__left")).cast("long"))).select(stratum, "__n", "__q")
    placed = items.withColumn("__i", F.row_number().over(Window.partitionBy(stratum).orderBy(order)) - 1).join(F.broadcast(q), stratum)
    # place i is the middle of stretch j: floor((2 j + 1) n / (2 q))
    j = F.floor(F.col("__i") * F.col("__q") / F.col("__n"))
    near = [F.floor((2 * (j + d) + 1) * F.col("__n") / (2 * F.col("__q"))) for d in (-1, 0, 1)]
    hit = F.lit(False)
    for d, c in zip((-1, 0, 1), near, strict=True):
        hit = hit | ((F.col("__i") == c) & (j + d >= 0) & (j + d < F.col("__q")))
    return placed.filter(hit).drop("__i", "__n", "__q")
