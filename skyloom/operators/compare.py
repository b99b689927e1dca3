"""Comparison of two stacks of the same field by their star catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import nearest, unmatched


def compare(mine: DataFrame, reference: DataFrame, radius: float = 2.5, group: str | None = None) -> DataFrame:
    """(g, matched, fwhm_ratio, flux_ratio, elongation_gap): each reference star with its nearest of ``mine``
    within ``radius``; medians of the ratios. Catalogues: id, x, y, fwhm, flux, elongation and ``group``."""
    pairs = nearest(reference, mine, radius, group)
    by = [F.col(group).alias("g")] if group else [F.lit(0).alias("g")]
    side = lambda d, k, p: d.select(*by, F.col("id").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in ("fwhm", "flux", "elongation")])
    j = pairs.join(side(reference, "l_id", "r"), ["g", "l_id"]).join(side(mine, "r_id", "m"), ["g", "r_id"])
    ratio = lambda c: F.median(F.when(F.col(f"r_{c}") > 0, F.col(f"m_{c}") / F.col(f"r_{c}")))
    return j.groupBy("g").agg(F.count("*").alias("matched"), ratio("fwhm").alias("fwhm_ratio"), ratio("flux").alias("flux_ratio"), F.median(F.col("m_elongation") - F.col("r_elongation")).alias("elongation_gap"))


def only_in_reference(mine: DataFrame, reference: DataFrame, radius: float = 2.5, group: str | None = None) -> DataFrame:
    """Reference stars that ``mine`` lacks."""
    return unmatched(reference, mine, radius, group)


def verdict(ratio: str = "fwhm_ratio", band: float = 0.02) -> F.Column:
    """Sharper, softer or alike within ``band``."""
    return F.when(F.col(ratio) < 1 - band, "sharper").when(F.col(ratio) > 1 + band, "softer").otherwise("alike")


def compare_many(candidates: DataFrame, reference: DataFrame, stack: str = "stack", radius: float = 2.5) -> DataFrame:
    """``compare`` for the catalogues of several stacks (column ``stack``) against one. A reference star goes to the
    stacks that have a star in its own or a neighbouring cell of the radius, by an equi-join."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    there = candidates.select(stack, cell("x").alias("__x"), cell("y").alias("__y")).distinct()
    near = there.withColumn("s", F.explode(around)).select(stack, (F.col("__x") + F.col("s.i")).alias("__x"), (F.col("__y") + F.col("s.j")).alias("__y")).distinct()
    repeated = reference.withColumn("__x", cell("x")).withColumn("__y", cell("y")).join(near, ["__x", "__y"]).drop("__x", "__y")
    return compare(candidates, repeated, radius, stack)
