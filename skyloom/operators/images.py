"""Dense kernels applied to frames: a task holds one frame, one band of rows, or one tile at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images as im
from .combine import gesd_sides

BANDS = "frame long, c int, band int, row_start int, n_rows int, width int, data binary"


def array_of(row) -> np.ndarray:
    return np.frombuffer(row.data, "<f4").reshape(row.n_rows, row.width).astype(np.float64)


def with_halo(bands: DataFrame, halo: int, last_band: int) -> DataFrame:
    """Bands with ``for_band``: each goes whole to itself, and its last or first ``halo`` rows to the band below or
    above, whose stencils need them (bands must be at least ``halo`` rows high)."""
    own = bands.withColumn("for_band", F.col("band"))
    if not halo:
        return own
    line = 4 * F.col("width")
    piece = lambda first, n: F.substring("data", (first * line + 1).cast("int"), (n * line).cast("int"))
    n = F.least(F.lit(halo), F.col("n_rows"))
    down = bands.withColumn("for_band", F.col("band") + 1).withColumn("data", piece(F.col("n_rows") - n, n)).withColumn("row_start", (F.col("row_start") + F.col("n_rows") - n).cast("int")).withColumn("n_rows", n)
    up = bands.withColumn("for_band", F.col("band") - 1).withColumn("data", piece(F.lit(0), n)).withColumn("n_rows", n)
    return own.unionByName(down.filter(F.col("for_band") <= last_band)).unionByName(up.filter(F.col("for_band") >= 0))


def stencil(bands: DataFrame, kernel, halo: int, last_band: int) -> DataFrame:
    """``kernel`` (2-D array -> array of the same shape) over bands with ``halo`` rows of their neighbours."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_start")
        mine = pdf[pdf["band"] == pdf["for_band"]].iloc[0]
        full = np.concatenate([array_of(r) for r in pdf.itertuples(index=False)])
        top = int(pdf["row_start"].iloc[0])
        a = max(0, mine.row_start - halo - top)
        b = min(len(full), mine.row_start + mine.n_rows + halo - top)
        got = kernel(full[a:b])[mine.row_start - top - a :][: mine.n_rows]
        return pd.DataFrame([(mine.frame, mine.c, mine.band, mine.row_start, mine.n_rows, mine.width, got.astype("<f4").tobytes())], columns=["frame", "c", "band", "row_start", "n_rows", "width", "data"])

    return with_halo(bands, halo, last_band).groupBy("frame", "c", "for_band").applyInPandas(run, BANDS)


def stack_bands(bands: DataFrame, method: str = "sigma", low: float = 3.0, high: float = 3.0, rounds: int = 5, weights: dict[int, float] | None = None) -> DataFrame:
    """(c, band, row_start, n_rows, width, data, coverage, n_low, n_high) of all frames: the vector form of
    ``combine``; a group is one band of one channel over all frames. NaN means not covered."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        x = np.stack([array_of(r) for r in pdf.itertuples(index=False)])
        side = sides(x, method, low, high, rounds)
        kept = np.where(side == 0, x, np.nan)
        valid = ~np.isnan(kept)
        if weights:
            w = np.array([weights.get(int(f), 1.0) for f in pdf["frame"]])[:, None, None]
            value = np.where(valid, kept * w, 0).sum(0) / np.maximum(np.where(valid, w, 0).sum(0), 1e-12)
        else:
            n = valid.sum(0)
            value = np.where(n > 0, np.where(valid, kept, 0).sum(0) / np.maximum(n, 1), low_median(x))
        if method == "median":
            value = low_median(x)
        one = pdf.iloc[0]
        row = (one.c, one.band, one.row_start, one.n_rows, one.width, np.nan_to_num(value).astype("<f4").tobytes(), (~np.isnan(x)).sum(0).astype("<u2").tobytes(), int((side < 0).sum()), int((side > 0).sum()))
        return pd.DataFrame([row], columns=["c", "band", "row_start", "n_rows", "width", "data", "coverage", "n_low", "n_high"])

    return bands.groupBy("c", "band").applyInPandas(run, "c int, band int, row_start int, n_rows int, width int, data binary, coverage binary, n_low long, n_high long")


def low_median(x: np.ndarray) -> np.ndarray:
    """Lower median over the first axis; NaN where nothing is valid."""
    s = np.sort(x, 0)
    n = (~np.isnan(x)).sum(0)
    return np.take_along_axis(s, np.maximum(n - 1, 0)[None] // 2, 0)[0]


def sides(x: np.ndarray, method: str, low: float, high: float, rounds: int) -> np.ndarray:
    side = np.zeros(x.shape, np.int8)
    if method in ("none", "median"):
        return side
    if method == "gesd":
        return gesd_sides(x.reshape(len(x), -1)).reshape(x.shape)
    if method == "percentile":
        c = low_median(x)
        rel = (x - c) / np.maximum(np.abs(c), 1e-6)
        return np.where(rel < -low, -1, np.where(rel > high, 1, 0)).astype(np.int8)
    for _ in range(max(1, rounds)):
        a = np.where(side == 0, x, np.nan)
        n = (~np.isnan(a)).sum(0)
        c = low_median(a)
        if method == "winsorized":
            s = 1.4826 * low_median(np.abs(a - c))
            for _ in range(3):
                p = np.clip(a, c - 1.5 * s, c + 1.5 * s)
                c = np.where(n > 0, np.nansum(p, 0) / np.maximum(n, 1), np.nan)
                s = 1.134 * np.sqrt(np.nansum((p - c) ** 2, 0) / (np.maximum(n, 2) - 1))
        else:
            s = np.sqrt(np.nansum((a - c) ** 2, 0) / (np.maximum(n, 2) - 1))
        dev, s = a - c, np.maximum(s, 1e-12)
        new = np.where(dev < -low * s, -1, np.where(dev > high * s, 1, 0)).astype(np.int8)
        if not new.any():
            break
        side = np.where(side == 0, new, side)
    return side


def per_frame(bands: DataFrame, make, schema: str) -> DataFrame:
    """``make`` (frame number, (channels, height, width) array) -> DataFrame, for each whole frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        planes = [np.concatenate([array_of(r) for r in p.sort_values("row_start").itertuples(index=False)]) for _, p in pdf.groupby("c", sort=True)]
        return make(int(pdf["frame"].iloc[0]), np.stack(planes))

    return bands.groupBy("frame").applyInPandas(run, schema)


STARS = "frame long, id long, x double, y double, flux double, peak double, fwhm double, elongation double, theta double"


def luma_of(image: np.ndarray) -> np.ndarray:
    return image[0] if len(image) == 1 else np.tensordot([0.2126, 0.7152, 0.0722], image[:3], 1)


#: Counts that stand for 1 in frames scaled to unit range, and the pedestal that keeps calibrated skies above 0.
FULL_SCALE, PEDESTAL = 65535.0, 200.0


def unit_range(bands: DataFrame) -> DataFrame:
    """(frame, unit): whether no sample of a frame exceeds 1."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"frame": pdf["frame"], "most": [float(np.frombuffer(d, "<f4").max(initial=-np.inf)) for d in pdf["data"]]})

    return bands.select("frame", "data").mapInPandas(run, "frame long, most double").groupBy("frame").agg((F.max("most") <= 1 + 1e-6).alias("unit"))


def like(master: np.ndarray, unit: bool, wanted: bool, channels: int) -> np.ndarray:
    """A master in the range and the channels of the frame that it is used on."""
    out = master if unit == wanted else master * FULL_SCALE if unit else master / FULL_SCALE
    if len(out) == channels:
        return out
    if channels == 1:
        return out.mean(0, keepdims=True)
    if len(out) == 1:
        return np.repeat(out, channels, 0)
    raise ValueError(f"a master of {len(out)} channels does not fit frames of {channels}")


def master_planes(bands: DataFrame) -> tuple[np.ndarray, bool]:
    """The one frame of a master as planes, and whether it is of unit range."""
    rows = bands.orderBy("c", "row_start").collect()  # one frame
    planes = np.stack([np.concatenate([array_of(r) for r in rows if r.c == c]) for c in sorted({r.c for r in rows})])
    return planes, bool(planes.max() <= 1 + 1e-6)


def flat_gain(flat: np.ndarray, bias: tuple[np.ndarray, bool] | None = None) -> np.ndarray:
    """A flat less its bias, each channel over its lower median."""
    if bias is not None:
        flat = flat - like(*bias, bool(flat.max() <= 1 + 1e-6), len(flat))
    flat = np.maximum(flat, 1e-6)
    return flat / np.array([im.lower_median(p) for p in flat])[:, None, None]


def calibrate_bands(lights: DataFrame, dark: DataFrame | None = None, bias: DataFrame | None = None, flat: DataFrame | None = None, pedestal: float = 0.0) -> DataFrame:
    """Lights less the dark (without one, the bias), over the flat, plus a pedestal, 0 at least. Masters are brought
    to the range of each light; without a stated pedestal a dark or bias brings PEDESTAL counts.

    Masters are one frame each and go to every task; lights stay where they are but for a flag a frame."""
    spark = lights.sparkSession
    held = {k: master_planes(m) if m is not None else None for k, m in (("dark", dark), ("bias", bias), ("flat", flat))}
    gain = flat_gain(held["flat"][0], held["bias"]) if held["flat"] else None
    channels = lights.agg(F.max("c")).first()[0]
    shared = spark.sparkContext.broadcast((held["dark"] or held["bias"], gain, (channels if channels is not None else 0) + 1))

    def run(frames):
        below, gain, channels = shared.value
        fitted = {u: like(*below, u, channels) for u in (False, True)} if below else None
        over = like(gain, False, False, channels) if gain is not None else None
        for pdf in frames:
            data = []
            for r in pdf.itertuples(index=False):
                rows, v = slice(r.row_start, r.row_start + r.n_rows), array_of(r)
                v = v - fitted[r.unit][r.c][rows] if fitted else v
                v = v / over[r.c][rows] if over is not None else v
                up = pedestal or (PEDESTAL / (FULL_SCALE if r.unit else 1) if fitted else 0.0)
                data.append(np.maximum(v + up, 0).astype("<f4").tobytes())
            yield pdf.drop(columns="unit").assign(data=data)

    return lights.join(unit_range(lights), "frame").mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lights.schema))


def cosmetic(image: np.ndarray, hot_sigma: float = 5.0, cold_sigma: float = 5.0, protect: float = 0.3, mosaic: bool = False) -> tuple[np.ndarray, int, int]:
    """A plane with hot and cold pixels replaced by the lower median of their eight neighbours (of their own
    colour in a mosaic), and how many of either. A hot pixel among risen neighbours is a star and stays."""
    step = 2 if mosaic else 1

    def around(a: np.ndarray, by: int) -> np.ndarray:
        wide, (h, w) = np.pad(a, by, mode="reflect"), a.shape
        return np.stack([wide[by + i : by + i + h, by + j : by + j + w] for i in (-by, 0, by) for j in (-by, 0, by) if i or j])

    middle = np.sort(around(image, step), 0)[3]
    rise = image - middle
    sample = np.abs(rise[::8, ::8])
    sigma = max(1.4826 * im.lower_median(sample[np.isfinite(sample)]), 1e-6)
    hot = (rise > hot_sigma * sigma) & (around(rise, 1).max(0) < protect * rise + sigma) if hot_sigma else np.zeros(image.shape, bool)
    cold = rise < -cold_sigma * sigma if cold_sigma else np.zeros(image.shape, bool)
    return np.where(hot | cold, middle, image), int(hot.sum()), int(cold.sum())


def prepare_frames(bands: DataFrame, band_rows: int, hot_sigma: float = 0.0, cold_sigma: float = 0.0, pattern: str | None = None) -> DataFrame:
    """Frames with bad pixels mended and, given a colour filter ``pattern``, three channels by variable gradients.
    A task holds one frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame, out = int(pdf["frame"].iloc[0]), []
        planes = [np.concatenate([array_of(r) for r in p.sort_values("row_start").itertuples(index=False)]) for _, p in pdf.groupby("c", sort=True)]
        if hot_sigma or cold_sigma:
            planes = [cosmetic(p, hot_sigma, cold_sigma, mosaic=pattern is not None)[0] for p in planes]
        if pattern and len(planes) == 1:
            planes = list(im.vng(planes[0], pattern))
        for c, plane in enumerate(planes):
            h, w = plane.shape
            out += [(frame, c, y // band_rows, y, min(band_rows, h - y), w, plane[y : y + band_rows].astype("<f4").tobytes()) for y in range(0, h, band_rows)]
        return pd.DataFrame(out, columns=["frame", "c", "band", "row_start", "n_rows", "width", "data"])

    return bands.groupBy("frame").applyInPandas(run, BANDS)


def normalise_bands(bands: DataFrame, reference: int) -> DataFrame:
    """Frames brought to the location and scale of the reference, channel by channel: (v - m) s_ref / s + m_ref with
    lower medians and scaled MADs of all samples there are."""

    def levels(frame: int, image: np.ndarray) -> pd.DataFrame:
        rows = []
        for c, plane in enumerate(image):
            v = plane[np.isfinite(plane)]
            m = im.lower_median(v) if len(v) else 0.0
            rows.append((frame, c, m, max(1.4826 * im.lower_median(np.abs(v - m)), 1e-9) if len(v) else 1.0))
        return pd.DataFrame(rows, columns=["frame", "c", "m", "s"])

    table = per_frame(bands, levels, "frame long, c int, m double, s double").checkpoint(eager=True)
    goal = table.filter(F.col("frame") == reference).select("c", F.col("m").alias("m0"), F.col("s").alias("s0"))
    scaled = bands.join(table.join(goal, "c"), ["frame", "c"])

    def run(frames):
        for pdf in frames:
            data = [((array_of(r) - r.m) * (r.s0 / r.s) + r.m0).astype("<f4").tobytes() for r in pdf.itertuples(index=False)]
            yield pdf[["frame", "c", "band", "row_start", "n_rows", "width"]].assign(data=data)

    return scaled.mapInPandas(run, BANDS)


def detect_stars(bands: DataFrame, sigma: float = 5.0) -> DataFrame:
    """Star catalogues of all frames, a star's id by brightness."""

    def make(frame: int, image: np.ndarray) -> pd.DataFrame:
        s = im.detect(luma_of(image), sigma)
        return pd.DataFrame({"frame": frame, "id": np.arange(len(s["x"])), **{k: s[k] for k in ("x", "y", "flux", "peak", "fwhm", "elongation", "theta")}})

    return per_frame(bands, make, STARS)


def align_frames(stars: DataFrame, reference: int) -> DataFrame:
    """(frame, matrix: nine numbers, matched): the similarity from each frame to the reference; frames that cannot
    be aligned have a null matrix. The reference's brightest stars go to every task (60 rows)."""
    top = stars.filter(F.col("frame") == reference).orderBy("id").limit(60).select("x", "y").toPandas().to_numpy()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf.sort_values("id")[["x", "y"]].to_numpy()
        try:
            m, n = im.align(xy, top)
        except ValueError:
            return pd.DataFrame([(int(pdf["frame"].iloc[0]), None, 0)], columns=["frame", "matrix", "matched"])
        return pd.DataFrame([(int(pdf["frame"].iloc[0]), m.ravel().tolist(), n)], columns=["frame", "matrix", "matched"])

    return stars.groupBy("frame").applyInPandas(run, "frame long, matrix array<double>, matched int")


def register(bands: DataFrame, alignments: DataFrame, height: int, width: int, band_rows: int = 256) -> DataFrame:
    """Frames on the reference's grid, NaN where they do not cover it."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["frame", "c", "band", "row_start", "n_rows", "width", "data"]
        if not len(left) or not len(right) or right["matrix"].iloc[0] is None:
            return pd.DataFrame([], columns=names)
        inv = np.linalg.inv(np.array(right["matrix"].iloc[0]).reshape(3, 3))
        yy, xx = np.mgrid[:height, :width]
        at = im.apply_matrix(inv, np.c_[xx.ravel(), yy.ravel()])
        sx, sy = at[:, 0].reshape(height, width), at[:, 1].reshape(height, width)
        out = []
        for c, part in left.groupby("c", sort=True):
            image = np.concatenate([array_of(r) for r in part.sort_values("row_start").itertuples(index=False)])
            got = image if np.allclose(inv, np.eye(3), atol=1e-12) and image.shape == (height, width) else im.warp(image, sx, sy)
            out += [(int(left["frame"].iloc[0]), int(c), y // band_rows, y, min(band_rows, height - y), width, got[y : y + band_rows].astype("<f4").tobytes()) for y in range(0, height, band_rows)]
        return pd.DataFrame(out, columns=names)

    return bands.groupBy("frame").cogroup(alignments.groupBy("frame")).applyInPandas(run, BANDS)
