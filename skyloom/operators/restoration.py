"""Joint deconvolution of chosen frames: kernels a frame, then tiles of all of them with borders, one task each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import deconvolution as de
from ..functions import images as im
from .images import luma_of
from .stacking import Grid

ASSETS = "frame long, source string, size int, psf binary, discs array<double>"
RESTORED = "c int, ty int, tx int, y0 int, x0 int, h int, w int, data binary, rounds int"


def levelled(planes: np.ndarray, frame: dict, base: list[float]) -> np.ndarray:
    """A frame's planes on the reference's level. ``frame``: location and scale a channel."""
    return np.stack([(p - frame["location"][c]) * frame["scale"][c] + base[c] for c, p in enumerate(planes)])


def planes_in(pdf: pd.DataFrame, box: tuple[int, int, int, int]) -> np.ndarray:
    """A frame's pieces as planes over a box, NaN where there is none."""
    y0, y1, x0, x1 = box
    out = np.full((int(pdf["c"].max()) + 1, y1 - y0, x1 - x0), np.nan)
    for r in pdf.itertuples(index=False):
        piece = np.frombuffer(r.data, "<f4").reshape(r.h, r.w)
        a, b, c, d = max(y0, r.y0), min(y1, r.y0 + r.h), max(x0, r.x0), min(x1, r.x0 + r.w)
        if a < b and c < d:
            out[r.c, a - y0 : b - y0, c - x0 : d - x0] = piece[a - r.y0 : b - r.y0, c - r.x0 : d - r.x0]
    return out


def kernels(tiles: DataFrame, chosen: dict[int, dict], base: list[float], grid: Grid) -> DataFrame:
    """ASSETS of the chosen frames (a parameter's number of them): a kernel from stars, and the discs of saturated
    ones. A task holds one frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = int(pdf["frame"].iloc[0])
        planes = planes_in(pdf, (0, grid.height, 0, grid.width))
        luma = np.nan_to_num(luma_of(levelled(planes, chosen[frame], base)))
        stars = im.detect(luma, 5.0)
        psf, source = de.estimate_psf(luma, stars, chosen[frame]["fwhm"])
        return pd.DataFrame([(frame, source, len(psf), psf.astype("<f8").tobytes(), de.saturated_stars(luma, stars).ravel().tolist())], columns=["frame", "source", "size", "psf", "discs"])

    return tiles.filter(F.col("frame").isin(list(chosen))).groupBy("frame").applyInPandas(run, ASSETS)


def restored(tiles: DataFrame, assets: list[dict], chosen: dict[int, dict], base: list[float], grid: Grid, how: de.Restoration, side: int = 512) -> DataFrame:
    """RESTORED squares of the image. Pieces of the chosen frames go to the squares that they touch, borders of three
    kernels included; a task restores one square from all frames. Colour follows the luminance."""
    widest = max(a["size"] for a in assets)
    psfs = {a["frame"]: np.pad(np.frombuffer(a["psf"], "<f8").reshape(a["size"], -1), (widest - a["size"]) // 2) for a in assets}
    discs = {a["frame"]: np.array(a["discs"], float).reshape(-1, 3) for a in assets}
    coarse = Grid(grid.height, grid.width, side=side, halo=3 * widest)
    reach = coarse.halo
    touched = lambda first, size: F.sequence(F.greatest(F.floor((F.col(first) - reach) / side), F.lit(0)).cast("int"), F.floor((F.col(first) + F.col(size) - 1 + reach) / side).cast("int"))
    sent = tiles.filter(F.col("frame").isin(list(chosen))).drop("ty", "tx").withColumn("ty", F.explode(touched("y0", "h"))).withColumn("tx", F.explode(touched("x0", "w")))
    sent = sent.filter((F.col("ty") * side < grid.height) & (F.col("tx") * side < grid.width))

    def run(key, pdf):
        ty, tx = map(int, key)
        box = coarse.box(ty, tx, reach)
        y, colour, keep, variance, used = [], [], [], [], []
        for frame, mine in pdf.groupby("frame", sort=True):
            native = planes_in(mine, box)
            planes = levelled(native, chosen[frame], base)
            y.append(luma_of(planes))
            colour.append(planes)
            keep.append(de.keep_mask(y[-1].shape, discs[frame], (box[0], box[2])))
            variance.append(de.luma_variance(native, chosen[frame]["gain"], chosen[frame]["read_noise"], chosen[frame]["scale"]))
            used.append(psfs[frame])
        image, rounds = de.restore(np.stack(y), np.stack(used), np.stack(keep), np.stack(variance), how)
        if len(colour[0]) == 3:
            planes = np.stack(colour)
            n = (~np.isnan(planes)).sum(0)
            image = de.apply_luminance(np.nansum(planes, 0) / np.maximum(n, 1), image)
        else:
            image = image[None]
        y0, y1, x0, x1 = coarse.box(ty, tx)
        out = [(c, ty, tx, y0, x0, y1 - y0, x1 - x0, p[y0 - box[0] : y1 - box[0], x0 - box[2] : x1 - box[2]].astype("<f4").tobytes(), rounds) for c, p in enumerate(image)]
        return pd.DataFrame(out, columns=["c", "ty", "tx", "y0", "x0", "h", "w", "data", "rounds"])

    return sent.groupBy("ty", "tx").applyInPandas(run, RESTORED)
