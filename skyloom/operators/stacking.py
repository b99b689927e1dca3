"""The image stack: narrow passes over files, one exchange of pixels by tiles, small tables in between.

``analyse`` reads each file once and gives a row a frame with its stars; ``align`` works on these rows; ``register``
reads each file again and cuts the frame, brought to the common grid, into tiles. ``combine`` gathers a tile of all
frames in a task: that is the only exchange of pixels. What a frame needs there besides its pixels (weight, scale,
offset, coarse maps) comes as a small row a tile, so nothing grows with the frames in any task or on the driver.

Tiles may be stored with a border (``halo``), for steps that look at neighbours; results do not depend on their size.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as ge
from ..functions import images as im
from ..sources import frames as sf
from .images import FULL_SCALE, PEDESTAL, cosmetic, like, low_median, luma_of, sides

STAR = ("x", "y", "flux", "peak", "fwhm", "elongation", "theta")
ANALYSED = "path string, channels int, height int, width int, found int, fwhm double, sky double, noise double, added double, grid array<double>, counts array<int>, " + ", ".join(f"star_{c} array<double>" for c in STAR)
ALIGNED = "frame long, matrix array<double>, inverse array<double>, forward array<double>, matched int, refined int, rms double, overlap double, failure string"
#: A tile of a registered frame (c >= 0), or what is known of the frame as a whole (c = -1).
REGISTERED = "frame long, c int, ty int, tx int, y0 int, x0 int, h int, w int, data binary, location array<double>, sigma array<double>, flux array<array<double>>, block_median binary, block_sigma binary, block_share binary"
TERMS = "frame long, c int, ty int, tx int, weight double, offset double, scale double, base double, map_box array<int>, map_scale binary, map_offset binary, field_box array<int>, field binary"
COMBINED = "c int, ty int, tx int, y0 int, x0 int, h int, w int, frame long, data binary, coverage binary, rejection binary, n_low long, n_high long"
DRIZZLED = "oy int, ox int, y0 int, x0 int, h int, w int, c int, num binary, den binary"


@dataclasses.dataclass(frozen=True)
class Grid:
    """The common grid: its size, the place of its corner on the reference, and the tiles that it is cut into."""

    height: int
    width: int
    origin: tuple[int, int] = (0, 0)  # y, x
    side: int = 256
    halo: int = 0

    def tiles(self) -> list[tuple[int, int]]:
        return [(ty, tx) for ty in range(-(-self.height // self.side)) for tx in range(-(-self.width // self.side))]

    def box(self, ty: int, tx: int, halo: int = 0) -> tuple[int, int, int, int]:
        """y0, y1, x0, x1."""
        y, x = ty * self.side, tx * self.side
        return max(0, y - halo), min(self.height, y + self.side + halo), max(0, x - halo), min(self.width, x + self.side + halo)


@dataclasses.dataclass(frozen=True)
class Preparation:
    """What turns the content of a file into a light. Masters are images, with whether they are of unit range."""

    below: tuple[np.ndarray, bool] | None = None  # dark, or without one bias
    gain: np.ndarray | None = None
    pedestal: float = 0.0
    hot_sigma: float = 0.0
    cold_sigma: float = 0.0
    debayer: str = "auto"  # on, off, or by the header
    pattern: str = ""
    method: str = "vng"

    def colours(self, header: dict[str, str], channels: int) -> str | None:
        """The pattern of colour filters over a frame's pixels; None if it has none or is left as it is."""
        known = next((header[k].strip().upper() for k in ("BAYERPAT", "COLORTYP") if header.get(k, "").strip()), "")
        known = known if known in ("RGGB", "BGGR", "GRBG", "GBRG") else ""
        if channels != 1 or self.debayer == "off" or (self.debayer == "auto" and not known):
            return None
        if not (self.pattern or known):
            raise ValueError("colour filters without a pattern: state one")
        return self.pattern or known

    def light(self, path: str, raw: bytes, mosaic: bool = False) -> tuple[np.ndarray, dict[str, str], str | None, float] | None:
        """(image of (channels, height, width), header, pattern if it still is a mosaic, pedestal added); None
        for files without an image."""
        image, header = sf.parse(path, raw)
        if image is None:
            return None
        unit, added = bool(image.max(initial=0) <= 1 + 1e-6), self.pedestal
        for master in (self.below[0] if self.below else None, self.gain):
            if master is not None and master.shape[1:] != image.shape[1:]:
                raise ValueError(f"{path}: a frame of {image.shape[1:]} and a master of {master.shape[1:]}")
        if self.below is not None:
            image = image - like(*self.below, unit, len(image))
            added = added or (PEDESTAL / FULL_SCALE if unit else PEDESTAL)
        if self.gain is not None:
            image = image / like(self.gain, False, False, len(image))
        if self.below is not None or self.gain is not None or added:
            image = np.maximum(image + added, 0)
        pattern = self.colours(header, len(image))
        if self.hot_sigma or self.cold_sigma:
            image = np.stack([cosmetic(p, self.hot_sigma, self.cold_sigma, mosaic=pattern is not None)[0] for p in image])
        if pattern and not mosaic:
            image, pattern = (im.vng if self.method == "vng" else im.bilinear)(image[0], pattern), None
        return np.asarray(image, np.float32), header, pattern, float(added)


def over_files(files: DataFrame, make, schema: str) -> DataFrame:
    """``make`` (row of the file) -> list of rows, for each file by itself."""
    names = field_names(schema)

    def run(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                out = make(row)
                if out:
                    yield pd.DataFrame(out, columns=names)

    return files.mapInPandas(run, schema)


def field_names(schema: str) -> list[str]:
    """Column names of a schema without structs."""
    return [f.split()[0] for f in schema.split(", ")]


def analyse(files: DataFrame, how: Preparation, sigma: float = 5.0) -> DataFrame:
    """A row a file (path, content): its size, level, noise, stars and their widths over a grid of four by four."""

    def make(row: dict) -> list[tuple]:
        light = how.light(row["path"], row["content"])
        if light is None:
            return []
        image, _, _, added = light
        luma = luma_of(image)
        s = im.detect(luma, sigma)
        level, noise = im.robust(luma)
        grid, counts = star_grid(s, luma.shape)
        fwhm = float(np.median(s["fwhm"])) if len(s["x"]) else math.nan
        return [(row["path"], len(image), *luma.shape, s["total"], fwhm, level, noise, added, grid, counts, *(s[c].tolist() for c in STAR))]

    return over_files(files, make, ANALYSED)


def star_grid(stars: dict[str, np.ndarray], shape: tuple[int, int], cells: int = 4, least: int = 8) -> tuple[list[float], list[int]]:
    """Median widths of stars by cell of the sensor (NaN below ``least``) and their numbers, row by row."""
    at = [np.minimum((stars[c] * cells / n).astype(int), cells - 1) for c, n in (("y", shape[0]), ("x", shape[1]))]
    cell = at[0] * cells + at[1]
    counts = np.bincount(cell, minlength=cells * cells) if len(cell) else np.zeros(cells * cells, int)
    grid = [float(np.median(stars["fwhm"][cell == k])) if counts[k] >= least else math.nan for k in range(cells * cells)]
    return grid, counts.tolist()


# ------------------------------------------------------------ alignment


def align(frames: DataFrame, reference: dict, refine: bool = True, least_overlap: float = 0.0) -> DataFrame:
    """How each frame of ``frames`` (frame, height, width, star_x, star_y, arcsec: of a pixel, or null) lies on
    the reference (a row of the same, whose stars, 2,000 at most, go along with the task). Frames of another size or
    scale are searched in windows; with ``refine`` a cubic follows optical distortion. ``failure`` says why a frame
    has no place."""
    stars = np.c_[reference["star_x"], reference["star_y"]]
    shape, scale, first = (reference["height"], reference["width"]), reference["arcsec"], reference["frame"]

    def place(row: dict) -> tuple:
        if row["frame"] == first:
            return (first, np.eye(3).ravel().tolist(), None, None, len(stars), 0, None, 1.0, None)
        src, mine = np.c_[row["star_x"], row["star_y"]], (row["height"], row["width"])
        known = all(s is not None and s == s for s in (row["arcsec"], scale))
        hint = row["arcsec"] / scale if known else None
        mixed = mine != shape or (known and abs(hint - 1) > 0.01)
        try:
            matrix, votes = im.align_mixed(src, stars, mine, shape, hint) if mixed else im.align(src, stars)
        except ValueError as e:
            return (row["frame"], None, None, None, 0, 0, None, 0.0, f"alignment: {e}")
        fine = im.distortion(matrix, src, stars, (mine, shape) if mixed else None) if refine else None
        overlap = ge.overlap_fraction(matrix, mine, shape, forward=fine and fine["forward"])
        bent = (fine["inverse"].ravel().tolist(), fine["forward"].ravel().tolist(), votes, fine["stars"], fine["rms"]) if fine else (None, None, votes, 0, None)
        return (row["frame"], matrix.ravel().tolist(), *bent, overlap, f"covers {overlap:.0%} of the reference" if overlap < least_overlap else None)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([place(r) for r in pdf.to_dict("records")], columns=field_names(ALIGNED))

    return frames.select("frame", "height", "width", "star_x", "star_y", "arcsec").mapInPandas(run, ALIGNED)


def matrix_of(values) -> np.ndarray:
    return np.array(values, float).reshape(3, 3)


def cubic_of(values) -> np.ndarray | None:
    return None if values is None or not len(values) else np.array(values, float).reshape(2, 10)


# ------------------------------------------------------------ registration


def register(files: DataFrame, how: Preparation, grid: Grid, photometry: np.ndarray, radius: int, block: int = 128) -> DataFrame:
    """Tiles (REGISTERED) of each file (path, content, frame, matrix, inverse) on the grid, NaN where the frame does
    not reach, and a row on the whole frame: lower medians and scaled MADs of its channels, fluxes of the
    ``photometry`` stars (x, y on the grid) in luma and each channel, and the statistics of blocks."""

    def make(row: dict) -> list[tuple]:
        light = how.light(row["path"], row["content"])
        if light is None:
            return []
        image, matrix, poly = light[0], matrix_of(row["matrix"]), cubic_of(row["inverse"])
        placed = np.empty((len(image), grid.height, grid.width), np.float32)
        same = poly is None and np.allclose(matrix, np.eye(3), atol=1e-12) and grid.origin == (0, 0) and image.shape[1:] == placed.shape[1:]
        inverse, xs = np.linalg.inv(matrix), np.arange(grid.width) + grid.origin[1]
        step = 32
        for y in range(0, grid.height, step):  # a strip at a time bounds the memory of the taps
            if same:
                placed[:, y : y + step] = image[:, y : y + step]
                continue
            ys = np.arange(y, min(y + step, grid.height)) + grid.origin[0]
            at = im.mapped(inverse, poly, np.c_[np.tile(xs, len(ys)), np.repeat(ys, len(xs))])
            sx, sy = at[:, 0].reshape(len(ys), -1), at[:, 1].reshape(len(ys), -1)
            for c, plane in enumerate(image):
                placed[c, y : y + step] = im.warp(plane, sx, sy)
        frame, out = int(row["frame"]), []
        levels = [channel_level(p) for p in placed]
        flux = [aperture_fluxes(p, photometry, radius) for p in (luma_of(placed), *placed)]
        blocks = [block_statistics(p, block) for p in placed]
        packed = [np.stack(b).astype("<f4").tobytes() for b in zip(*blocks, strict=True)]
        out.append((frame, -1, 0, 0, 0, 0, *placed.shape[1:], None, [m for m, _ in levels], [s for _, s in levels], [f.tolist() for f in flux], *packed))
        for ty, tx in grid.tiles():
            y0, y1, x0, x1 = grid.box(ty, tx, grid.halo)
            out += [(frame, c, ty, tx, y0, x0, y1 - y0, x1 - x0, placed[c, y0:y1, x0:x1].astype("<f4").tobytes(), *[None] * 6) for c in range(len(placed))]
        return out

    return over_files(files, make, REGISTERED)


def channel_level(plane: np.ndarray) -> tuple[float, float]:
    v = plane[np.isfinite(plane)].astype(np.float64)
    if not len(v):
        return 0.0, 1.0
    m = im.lower_median(v)
    return m, max(1.4826 * im.lower_median(np.abs(v - m)), 1e-9)


def aperture_fluxes(plane: np.ndarray, stars: np.ndarray, radius: int) -> np.ndarray:
    """Sums within ``radius`` of each star (x, y) less the lower median of a ring of 1.5 to 3 radii; NaN where the
    aperture has a hole. Beyond an edge its pixels repeat."""
    if not len(stars):
        return np.zeros(0)
    off = np.arange(-3 * radius, 3 * radius + 1)
    far = np.hypot(off[:, None], off[None])
    x, y = (np.round(stars[:, k]).astype(int)[:, None, None] for k in (0, 1))
    cut = plane[np.clip(y + off[None, :, None], 0, plane.shape[0] - 1), np.clip(x + off[None, None], 0, plane.shape[1] - 1)].astype(np.float64)
    ring = np.sort(cut[:, (far > 1.5 * radius) & (far <= 3 * radius)], 1)
    n = np.isfinite(ring).sum(1)
    sky = np.where(n > 0, ring[np.arange(len(ring)), np.maximum(n - 1, 0) // 2], np.nan)
    return (cut[:, far <= radius] - sky[:, None]).sum(1)  # a hole is NaN and stays


def block_statistics(plane: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower median, scaled MAD and share of valid pixels of square blocks; those at the edge count as whole ones."""
    rows, cols = (-(-n // block) for n in plane.shape)
    wide = np.full((rows * block, cols * block), np.nan, np.float32)
    wide[: plane.shape[0], : plane.shape[1]] = plane
    x = wide.reshape(rows, block, cols, block).swapaxes(1, 2).reshape(rows * cols, -1)
    n = np.isfinite(x).sum(1)

    def lower(v: np.ndarray) -> np.ndarray:
        out = np.full(len(v), np.nan)
        for k in np.unique(n[n > 0]):  # few different numbers: most blocks are full
            out[n == k] = np.partition(v[n == k], (k - 1) // 2, axis=1)[:, (k - 1) // 2]
        return out

    m = lower(x)
    return m.reshape(rows, cols), (1.4826 * lower(np.abs(x - m[:, None]))).reshape(rows, cols), (n / block**2).reshape(rows, cols)


# ------------------------------------------------------------ what a frame brings besides pixels


def photometric_scale(frames: DataFrame, reference: dict, least: int = 12) -> DataFrame:
    """``frames`` (frame, exposure, location, sigma, flux) with flux_ratio, transparency (the ratio over that of
    exposures), measured (number of stars) and scale: what brings each channel to the reference's flux, from its stars
    or, without enough of them, from the ratio of noises."""
    ref_flux = [np.array(f, float) for f in reference["flux"]]
    ref_sigma, ref_exposure = reference["sigma"], reference["exposure"]

    def ratio(flux: np.ndarray, ref: np.ndarray) -> tuple[float, int]:
        ok = np.isfinite(flux) & np.isfinite(ref) & (flux > 0) & (ref > 0)
        return (float(np.median(flux[ok] / ref[ok])) if ok.sum() >= least else math.nan), int(ok.sum())

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                flux = [np.array(f, float) for f in r["flux"]]
                whole, n = ratio(flux[0], ref_flux[0])
                known = all(e is not None and e == e and e > 0 for e in (r["exposure"], ref_exposure))
                expected = round(r["exposure"], 2) / round(ref_exposure, 2) if known else 1.0
                scale = []
                for c, s in enumerate(r["sigma"]):
                    t = ratio(flux[c + 1], ref_flux[min(c + 1, len(ref_flux) - 1)])[0]
                    scale.append(1 / min(max(t, expected / 3), expected * 3) if t == t and t > 0 else ref_sigma[min(c, len(ref_sigma) - 1)] / max(s, 1e-12))
                out.append((r["frame"], whole, whole / expected, n, scale))
            yield pd.DataFrame(out, columns=["frame", "flux_ratio", "transparency", "measured", "scale"])

    got = frames.select("frame", "exposure", "sigma", "flux").mapInPandas(run, "frame long, flux_ratio double, transparency double, measured int, scale array<double>")
    return frames.join(got.replace(float("nan"), None, ["flux_ratio", "transparency"]), "frame")


def fitted_maps(stats: tuple[np.ndarray, np.ndarray, np.ndarray], ref: tuple[np.ndarray, np.ndarray, np.ndarray], scale: list[float] | None, least: float = 0.3, smooth: float = 1.0, limits: tuple[float, float] = (0.5, 2.0)) -> tuple[np.ndarray, np.ndarray]:
    """Coarse maps (channels, rows, columns) of scale and offset that bring the blocks of a frame to those of the
    reference: a constant scale, or without one the ratio of noises within limits. Blocks with too few pixels take the
    value of the nearest good one; then maps are smoothed."""
    scales, offsets = [], []
    for c, (m, s, share) in enumerate(zip(*stats, strict=True)):
        rm, rs, rshare = (r[min(c, len(r) - 1)] for r in ref)
        k = np.clip(rs / np.maximum(s, 1e-9), *limits) if scale is None else np.full(m.shape, scale[c])
        off = rm - k * m
        bad = (share < least) | (rshare < least) | ~np.isfinite(k) | ~np.isfinite(off)
        scales.append(im.fill_nearest(k, bad, smooth if scale is None else 0.0))
        offsets.append(im.fill_nearest(off, bad, smooth))
    return np.stack(scales), np.stack(offsets)


def coarse_weights(places: np.ndarray, size: int, nodes: int, corners: bool = False) -> np.ndarray:
    """(places, nodes) weights that interpolate a coarse map linearly, ends held: nodes lie in the middle of their
    blocks, or with ``corners`` from the first to the last pixel."""
    at = places * (nodes - 1) / max(size - 1, 1) if corners else np.clip((places + 0.5) * nodes / size - 0.5, 0, nodes - 1)
    k = np.minimum(np.floor(at).astype(int), nodes - 1)
    out = np.zeros((len(places), nodes))
    out[np.arange(len(places)), k] += 1 - (at - k)
    out[np.arange(len(places)), np.minimum(k + 1, nodes - 1)] += at - k
    return out


def cut_map(coarse: np.ndarray, box: tuple[int, int, int, int], grid: Grid, corners: bool = False) -> tuple[list[int], np.ndarray]:
    """The nodes of a coarse map (..., rows, columns) that the pixels of ``box`` need: where they begin, and they."""
    spans = []
    for (a, b), size, nodes in (((box[0], box[1]), grid.height, coarse.shape[-2]), ((box[2], box[3]), grid.width, coarse.shape[-1])):
        used = np.flatnonzero(coarse_weights(np.array([a, b - 1]), size, nodes, corners).any(0))
        spans.append((int(used[0]), int(used[-1]) + 1))
    (a, b), (c, d) = spans
    return [a, b - a, coarse.shape[-2], c, d - c, coarse.shape[-1]], coarse[..., a:b, c:d]


def at_pixels(box: list[int], nodes: np.ndarray, ys: np.ndarray, xs: np.ndarray, grid: Grid, corners: bool = False) -> np.ndarray:
    """A map cut by ``cut_map`` at rows ``ys`` and columns ``xs`` of the grid."""
    a, n, rows, c, m, cols = box
    down = coarse_weights(ys, grid.height, rows, corners)[:, a : a + n]
    across = coarse_weights(xs, grid.width, cols, corners)[:, c : c + m]
    return down @ nodes.reshape(n, m) @ across.T


def field_map(factors: list[float], matrix: np.ndarray, poly: np.ndarray | None, shape: tuple[int, int], grid: Grid, nodes: int = 64) -> np.ndarray:
    """A map over the grid of factors that belong to cells of the sensor (row by row)."""
    cells = int(round(math.sqrt(len(factors))))
    ys, xs = (np.linspace(0, n - 1, min(nodes, n)) for n in (grid.height, grid.width))
    on_reference = np.c_[np.tile(xs, len(ys)) + grid.origin[1], np.repeat(ys, len(xs)) + grid.origin[0]]
    at = im.mapped(np.linalg.inv(matrix), poly, on_reference)
    return ge.sample_grid(np.array(factors, float).reshape(cells, cells), at[:, 0], at[:, 1], *shape).reshape(len(ys), len(xs))


def terms(frames: DataFrame, grid: Grid, channels: int, base: list[float], reference_blocks: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, block: int = 128, flux_scaled: bool = True) -> DataFrame:
    """A row (TERMS) a frame, channel and tile of ``frames`` (frame, weight, location, scale, block_*, factors,
    matrix, inverse, height, width): (v - offset) scale + base of its samples, or with ``reference_blocks`` the part of
    its local maps, and with factors the part of its field of weights."""
    rows, cols = -(-grid.height // block), -(-grid.width // block)

    def run(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                out, maps, field = [], None, None
                if reference_blocks is not None:
                    stats = tuple(np.frombuffer(r[f"block_{k}"], "<f4").reshape(-1, rows, cols) for k in ("median", "sigma", "share"))
                    maps = fitted_maps(stats, reference_blocks, list(r["scale"]) if flux_scaled else None)
                if r["factors"] is not None and len(r["factors"]):
                    field = field_map(list(r["factors"]), matrix_of(r["matrix"]), cubic_of(r["inverse"]), (r["height"], r["width"]), grid)
                for ty, tx in grid.tiles():
                    box = grid.box(ty, tx, grid.halo)
                    part = cut_map(field, box, grid, corners=True) if field is not None else (None, None)
                    pair = [cut_map(m, grid.box(ty, tx, grid.halo + 1), grid) for m in maps] if maps is not None else None
                    for c in range(channels):
                        mine = min(c, len(r["location"]) - 1)
                        local = (pair[0][0], *(p[1][mine].astype("<f8").tobytes() for p in pair)) if pair else (None, None, None)
                        out.append((r["frame"], c, ty, tx, r["weight"], r["location"][mine], r["scale"][mine], base[min(c, len(base) - 1)], *local, part[0], part[1].astype("<f8").tobytes() if field is not None else None))
                yield pd.DataFrame(out, columns=field_names(TERMS))

    wanted = ["frame", "weight", "location", "scale", "block_median", "block_sigma", "block_share", "factors", "matrix", "inverse", "height", "width"]
    return frames.select(*wanted).mapInPandas(run, TERMS)


# ------------------------------------------------------------ combination


@dataclasses.dataclass(frozen=True)
class Combination:
    """How samples of a pixel become one."""

    method: str = "sigma"
    low: float = 3.0
    high: float = 3.0
    rounds: int = 5
    weighted: bool = True
    normalise: bool = True
    large_scale: bool = False
    large_box: int = 15
    large_density: float = 0.3
    large_grow: int = 7
    masks: bool = False

    def halo(self) -> int:
        return (self.large_box | 1) // 2 + self.large_grow if self.large_scale else 0


def trail(high: np.ndarray, box: int, density: float, grow: int) -> np.ndarray:
    """Where high rejections (..., rows, columns) are dense, their whole neighbourhood: within ``grow`` pixels of one
    in whose box more than ``density`` are rejected. Boxes end at the edge."""

    def box_sum(a: np.ndarray, reach: int) -> np.ndarray:
        for axis in (-2, -1):
            n = a.shape[axis]
            total = np.concatenate((np.zeros_like(np.take(a, [0], axis)), np.cumsum(a, axis)), axis)
            at = np.arange(n)
            a = np.take(total, np.minimum(at + reach + 1, n), axis) - np.take(total, np.maximum(at - reach, 0), axis)
        return a

    half = (box | 1) // 2
    share = box_sum(high.astype(np.int32), half) / box_sum(np.ones(high.shape[-2:], np.int32), half)
    return box_sum((share > density).astype(np.int32), grow) > 0


def combined(x: np.ndarray, how: Combination, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of each pixel of (frames, rows, columns) samples, NaN where not covered, and the masks of samples
    rejected below and above. ``w``: weights that fit the samples."""
    side = sides(x, how.method, how.low, how.high, how.rounds)
    below, above = side < 0, side > 0
    if how.large_scale:
        above = above | (trail(above, how.large_box, how.large_density, how.large_grow) & ~np.isnan(x))
    if how.method == "median":
        return np.nan_to_num(low_median(x)), below, above
    kept = np.where(below | above, np.nan, x)
    valid = ~np.isnan(kept)
    if w is not None:
        value = np.where(valid, kept * w, 0).sum(0) / np.maximum(np.where(valid, w, 0).sum(0), 1e-12)
    else:
        n = valid.sum(0)
        value = np.where(n > 0, np.where(valid, kept, 0).sum(0) / np.maximum(n, 1), low_median(x))
    return np.nan_to_num(value), below, above


def normalised(v: np.ndarray, t, ys: np.ndarray, xs: np.ndarray, grid: Grid) -> np.ndarray:
    """A frame's samples on the reference's level: by its local maps, or by its offset and scale."""
    if t.map_box is not None and len(t.map_box):
        scale, offset = (at_pixels(list(t.map_box), np.frombuffer(m, "<f8"), ys, xs, grid) for m in (t.map_scale, t.map_offset))
        return v * scale + offset
    return (v - t.offset) * t.scale + t.base


def combine(tiles: DataFrame, frame_terms: DataFrame, grid: Grid, how: Combination) -> DataFrame:
    """COMBINED tiles of all frames that have terms: values (float32), how many frames cover a pixel (uint16), which
    share was rejected (float32), without borders. With ``masks`` also a row a frame with the bits of its rejected
    samples. A task holds a tile of one channel over all frames."""
    names = field_names(COMBINED)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        by_frame = {t.frame: t for t in right.itertuples(index=False)}
        left = left[left["frame"].isin(by_frame.keys())].sort_values("frame")
        if not len(left):
            return pd.DataFrame([], columns=names)
        one = left.iloc[0]
        ys, xs = np.arange(one.y0, one.y0 + one.h), np.arange(one.x0, one.x0 + one.w)
        x = np.empty((len(left), one.h, one.w))
        w = np.ones((len(left), 1, 1)) if how.weighted else None
        fields = how.weighted and any(t.field is not None for t in by_frame.values())
        w = np.ones(x.shape) if fields else w
        for k, r in enumerate(left.itertuples(index=False)):
            t, v = by_frame[r.frame], np.frombuffer(r.data, "<f4").reshape(r.h, r.w)
            x[k] = normalised(v, t, ys, xs, grid) if how.normalise else v
            if w is not None:
                w[k] = t.weight * (at_pixels(list(t.field_box), np.frombuffer(t.field, "<f8"), ys, xs, grid, corners=True) if t.field is not None else 1.0)
        value, below, above = combined(x, how, w)
        y0, y1, x0, x1 = grid.box(int(one.ty), int(one.tx))
        core = np.s_[..., y0 - one.y0 : y1 - one.y0, x0 - one.x0 : x1 - one.x0]
        value, below, above, there = value[core], below[core], above[core], ~np.isnan(x[core])
        gone = below.sum(0, dtype=np.int64) + above.sum(0, dtype=np.int64)
        place = (one.c, one.ty, one.tx, y0, x0, y1 - y0, x1 - x0)
        share = gone / np.maximum(there.sum(0), 1)
        out = [(*place, None, value.astype("<f4").tobytes(), there.sum(0).astype("<u2").tobytes(), share.astype("<f4").tobytes(), int(below.sum()), int(above.sum()))]
        if how.masks:
            out += [(*place, int(f), np.packbits(m).tobytes(), None, None, 0, 0) for f, m in zip(left["frame"], below | above, strict=True)]
        return pd.DataFrame(out, columns=names).astype({"frame": "Int64"})

    return tiles.groupBy("c", "ty", "tx").cogroup(frame_terms.groupBy("c", "ty", "tx")).applyInPandas(run, COMBINED)


def master_blocks(master: DataFrame, grid: Grid, block: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block statistics of a combined image, from pieces of its tiles: coarse maps (channels, rows, columns)."""
    rows, cols = -(-grid.height // block), -(-grid.width // block)

    def cut(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                v, cover = np.frombuffer(r.data, "<f4").reshape(r.h, r.w), np.frombuffer(r.coverage, "<u2").reshape(r.h, r.w)
                v = np.where(cover > 0, v, np.nan).astype("<f4")
                for by in range(r.y0 // block, (r.y0 + r.h - 1) // block + 1):
                    for bx in range(r.x0 // block, (r.x0 + r.w - 1) // block + 1):
                        part = v[max(0, by * block - r.y0) : (by + 1) * block - r.y0, max(0, bx * block - r.x0) : (bx + 1) * block - r.x0]
                        out.append((r.c, by, bx, part.tobytes()))
            yield pd.DataFrame(out, columns=["c", "by", "bx", "part"])

    def stats(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate([np.frombuffer(p, "<f4") for p in pdf["part"]])
        v, one = v[np.isfinite(v)].astype(np.float64), pdf.iloc[0]
        m = im.lower_median(v)
        return pd.DataFrame([(one.c, one.by, one.bx, m, 1.4826 * im.lower_median(np.abs(v - m)), len(v) / block**2)], columns=["c", "by", "bx", "m", "s", "share"])

    pieces = master.filter("frame is null").select("c", "y0", "x0", "h", "w", "data", "coverage").mapInPandas(cut, "c int, by int, bx int, part binary")
    found = pieces.groupBy("c", "by", "bx").applyInPandas(stats, "c int, by int, bx int, m double, s double, share double").collect()  # a row a block of one image
    out = np.full((3, max((r["c"] for r in found), default=0) + 1, rows, cols), np.nan)
    for r in found:
        out[:, r["c"], r["by"], r["bx"]] = r["m"], r["s"], r["share"]
    return tuple(out)


# ------------------------------------------------------------ drizzle


@dataclasses.dataclass(frozen=True)
class Drop:
    """How pixels are dropped on the finer grid. A task holds a tile of it and ``chunk`` frames."""

    scale: float = 2.0
    pixfrac: float = 0.8
    kernel: str = "square"
    colours: bool = True  # straight from the sites of colour filters
    least: float = 0.05
    side: int = 512
    chunk: int = 64

    def points(self, footprint: float) -> list[tuple[float, float, float]]:
        return ge.drop_points(self.pixfrac, self.scale * (footprint if footprint > 1.01 else 1.0), self.kernel)

    def places(self, r: np.ndarray) -> np.ndarray:
        """Output pixels of places on the grid."""
        return np.floor(r * self.scale + 0.5 * (self.scale - 1) + 0.5).astype(np.int64)


def drizzle(files: DataFrame, how: Preparation, plan: DataFrame, frame_terms: DataFrame, masks: DataFrame | None, grid: Grid, drop: Drop) -> DataFrame:
    """DRIZZLED sums of the frames of ``plan`` (frame, matrix, forward) over tiles of the finer grid.

    A file is cut into pieces, and a piece goes to the tiles that it falls on; with it meet there the frame's terms and
    its masks of rejected samples. Groups are of ``chunk`` frames, and their sums are added up."""
    high, wide = ge.drizzle_shape(grid.height, grid.width, drop.scale)
    fine = Grid(high, wide, side=drop.side)
    pieces_of = "frame long, oy int, ox int, chunk long, y0 int, x0 int, h int, w int, n int, pattern string, data binary"

    def pieces(row: dict) -> list[tuple]:
        light = how.light(row["path"], row["content"], mosaic=drop.colours)
        if light is None:
            return []
        image, _, pattern, _ = light
        matrix, poly, out, step = matrix_of(row["matrix"]), cubic_of(row["forward"]), [], 128
        for y in range(0, image.shape[1], step):
            for x in range(0, image.shape[2], step):
                part = image[:, y : y + step, x : x + step]
                gy, gx = (np.linspace(a - 0.5, a + n - 0.5, 9) for a, n in ((y, part.shape[1]), (x, part.shape[2])))
                at = im.mapped(matrix, poly, np.c_[np.tile(gx, 9), np.repeat(gy, 9)]) - grid.origin[::-1]
                lo, hi = drop.places(at.min(0)) - 2, drop.places(at.max(0)) + 2
                for oy in range(max(0, lo[1]) // drop.side, min(high - 1, hi[1]) // drop.side + 1):
                    for ox in range(max(0, lo[0]) // drop.side, min(wide - 1, hi[0]) // drop.side + 1):
                        out.append((row["frame"], oy, ox, row["frame"] // drop.chunk, y, x, *part.shape[1:], len(part), pattern, part.astype("<f4").tobytes()))
        return out

    sent = over_files(files, pieces, pieces_of)
    about = beside_tiles(frame_terms, plan, masks, grid, fine, drop)

    def scatter(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = field_names(DRIZZLED)
        known = right[right["kind"] == "terms"]
        if not len(left) or not len(known):
            return pd.DataFrame([], columns=names)
        y0, y1, x0, x1 = fine.box(int(left["oy"].iloc[0]), int(left["ox"].iloc[0]))
        h, w = y1 - y0, x1 - x0
        num, den = {}, {}
        for frame, mine in left.groupby("frame", sort=True):
            t: dict[int, list] = {}
            for r in known[known["frame"] == frame].itertuples(index=False):
                t.setdefault(r.c, []).append(r)
            if not t:
                continue
            one = t[min(t)][0]
            matrix, poly = matrix_of(one.matrix), cubic_of(one.forward)
            gone = rejected_near(right[(right["kind"] == "mask") & (right["frame"] == frame)])
            points = drop.points(math.sqrt(abs(np.linalg.det(matrix[:2, :2]))))
            for r in mine.itertuples(index=False):
                image = np.frombuffer(r.data, "<f4").reshape(r.n, -1).astype(np.float64)
                ok = np.isfinite(image).all(0)
                ys, xs = np.repeat(np.arange(r.y0, r.y0 + r.h), r.w), np.tile(np.arange(r.x0, r.x0 + r.w), r.h)
                site = None
                if r.pattern is not None:
                    site = im.site_of(r.pattern, 2, 2)[ys % 2, xs % 2]
                for dy, dx, share in points:
                    at = im.mapped(matrix, poly, np.c_[xs + dx, ys + dy]) - grid.origin[::-1]
                    o = drop.places(at)
                    inside = ok & (o[:, 0] >= x0) & (o[:, 0] < x1) & (o[:, 1] >= y0) & (o[:, 1] < y1)
                    inside &= ~gone(at)
                    if not inside.any():
                        continue
                    cell = (o[inside, 1] - y0) * w + o[inside, 0] - x0
                    for c in range(3 if site is not None else r.n):
                        pick = site[inside] == c if site is not None else slice(None)
                        v = image[0 if site is not None else c, inside][pick]
                        v = level_at(v, t.get(c, t[min(t)]), at[inside][pick], grid)
                        k = one.weight * share
                        num[c] = num.get(c, 0) + np.bincount(cell[pick], v * k, h * w)
                        den[c] = den.get(c, 0) + np.bincount(cell[pick], minlength=h * w) * k
        oy, ox = left["oy"].iloc[0], left["ox"].iloc[0]
        return pd.DataFrame([(oy, ox, y0, x0, h, w, c, num[c].astype("<f8").tobytes(), den[c].astype("<f8").tobytes()) for c in sorted(num)], columns=names)

    parts = sent.groupBy("oy", "ox", "chunk").cogroup(about.groupBy("oy", "ox", "chunk")).applyInPandas(scatter, DRIZZLED)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[[0]].copy()
        for k in ("num", "den"):
            one[k] = [sum(np.frombuffer(b, "<f8") for b in pdf[k]).tobytes()]
        return one

    return parts.groupBy("oy", "ox", "c").applyInPandas(add, DRIZZLED)


def level_at(v: np.ndarray, rows: list, at: np.ndarray, grid: Grid) -> np.ndarray:
    """Samples at places (x, y) of the grid on the reference's level; ``rows``: the frame's terms by tile."""
    if rows[0].map_box is None:
        return (v - rows[0].offset) * rows[0].scale + rows[0].base
    out = v.copy()
    y, x = np.clip(at[:, 1], 0, grid.height - 1), np.clip(at[:, 0], 0, grid.width - 1)
    for r in rows:
        mine = np.flatnonzero((y // grid.side == r.y0 // grid.side) & (x // grid.side == r.x0 // grid.side))
        if len(mine):
            scale, offset = (points_of(list(r.map_box), np.frombuffer(m, "<f8"), y[mine], x[mine], grid) for m in (r.map_scale, r.map_offset))
            out[mine] = v[mine] * scale + offset
    return out


def points_of(box: list[int], nodes: np.ndarray, ys: np.ndarray, xs: np.ndarray, grid: Grid) -> np.ndarray:
    """A map cut by ``cut_map`` at single places."""
    a, n, rows, c, m, cols = box
    out, held = np.zeros(len(ys)), nodes.reshape(n, m)
    (ky, ty), (kx, tx) = ((np.floor(g).astype(int), g - np.floor(g)) for g in (np.clip((p + 0.5) * k / size - 0.5, 0, k - 1) for p, k, size in ((ys, rows, grid.height), (xs, cols, grid.width))))
    for i in (0, 1):
        for j in (0, 1):
            out += held[np.clip(ky + i - a, 0, n - 1), np.clip(kx + j - c, 0, m - 1)] * np.abs(1 - i - ty) * np.abs(1 - j - tx)
    return out


def rejected_near(masks: pd.DataFrame):
    """Whether the pixel of the grid nearest to places (x, y) is rejected, by the masks at hand of any channel."""
    if not len(masks):
        return lambda at: np.zeros(len(at), bool)
    y0, x0 = int(masks["y0"].min()), int(masks["x0"].min())
    y1, x1 = int((masks["y0"] + masks["h"]).max()), int((masks["x0"] + masks["w"]).max())
    gone = np.zeros((y1 - y0, x1 - x0), bool)
    for r in masks.itertuples(index=False):
        h, w = int(r.h), int(r.w)
        gone[int(r.y0) - y0 :, int(r.x0) - x0 :][:h, :w] |= np.unpackbits(np.frombuffer(r.bits, np.uint8), count=h * w).reshape(h, w).astype(bool)
    return lambda at: gone[np.clip(np.round(at[:, 1]).astype(int) - y0, 0, y1 - y0 - 1), np.clip(np.round(at[:, 0]).astype(int) - x0, 0, x1 - x0 - 1)]


def drizzled_weight_floor(sums: DataFrame, drop: Drop, grid: Grid, channels: int, sample: int = 500_000) -> float:
    """``least`` of the median weight, over every k-th pixel of all channels such that about ``sample`` are looked at."""
    high, wide = ge.drizzle_shape(grid.height, grid.width, drop.scale)
    step = max(1, channels * high * wide // sample)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                place = (r.c * high + np.arange(r.y0, r.y0 + r.h)[:, None]) * wide + np.arange(r.x0, r.x0 + r.w)
                yield pd.DataFrame({"den": np.frombuffer(r.den, "<f8")[place.ravel() % step == 0]})

    total = -(-channels * high * wide // step)
    seen = sums.select("c", "y0", "x0", "h", "w", "den").mapInPandas(run, "den double").filter("den > 0")
    n = seen.count()  # pixels that no frame touches weigh 0
    if 2 * n <= total:
        return 0.0
    share = (0.5 * (total - 1) - (total - n)) / max(n - 1, 1)
    return drop.least * float(seen.agg(F.expr(f"percentile(den, {min(max(share, 0.0), 1.0)!r})")).first()[0])


def drizzled_image(sums: DataFrame, floor: float) -> DataFrame:
    """DRIZZLED sums with ``data``: num / den in float32, 0 where the weight is below ``floor``."""

    def run(batches):
        for pdf in batches:
            data = []
            for num, den in zip(pdf["num"], pdf["den"], strict=True):
                a, b = np.frombuffer(num, "<f8"), np.frombuffer(den, "<f8")
                data.append(np.where((b >= floor) & (b > 0), a / np.maximum(b, 1e-12), 0).astype("<f4").tobytes())
            yield pdf.drop(columns="num").assign(data=data)

    return sums.mapInPandas(run, DRIZZLED.replace("num binary, ", "") + ", data binary")


BESIDE = "kind string, frame long, oy int, ox int, chunk long, c int, weight double, offset double, scale double, base double, map_box array<int>, map_scale binary, map_offset binary, matrix array<double>, forward array<double>, y0 int, x0 int, h int, w int, bits binary"


def beside_tiles(frame_terms: DataFrame, plan: DataFrame, masks: DataFrame | None, grid: Grid, fine: Grid, drop: Drop) -> DataFrame:
    """Terms and masks by the tiles of the finer grid that their own tiles touch. Of a frame's terms a fine tile gets
    those of the tile under its middle, whose maps are cut wide enough for it."""
    names = field_names(BESIDE)

    def reach(ty: int, tx: int) -> tuple[range, range]:
        y0, y1, x0, x1 = grid.box(ty, tx)
        lo, hi = drop.places(np.array([y0 - 1.0, x0 - 1.0])) - 1, drop.places(np.array([y1 + 0.0, x1 + 0.0])) + 1
        return tuple(range(max(0, a) // drop.side, min(n - 1, b) // drop.side + 1) for a, b, n in zip(lo, hi, (fine.height, fine.width), strict=True))

    def spread(kind: str):
        def run(batches):
            for pdf in batches:
                out = []
                for r in pdf.to_dict("records"):
                    down, across = reach(int(r["ty"]), int(r["tx"]))
                    for oy in down:
                        for ox in across:
                            row = dict.fromkeys(names) | {k: v for k, v in r.items() if k in names} | {"kind": kind, "oy": oy, "ox": ox, "chunk": r["frame"] // drop.chunk}
                            out.append([row[k] for k in names])
                yield pd.DataFrame(out, columns=names)

        return run

    joined = frame_terms.drop("field_box", "field").join(plan.select("frame", "matrix", "forward"), "frame")
    y0, x0 = F.col("ty") * grid.side, F.col("tx") * grid.side
    out = joined.withColumn("y0", y0).withColumn("x0", x0).withColumn("h", F.lit(grid.side)).withColumn("w", F.lit(grid.side)).mapInPandas(spread("terms"), BESIDE)
    if masks is None:
        return out
    return out.unionByName(masks.select("frame", "c", "ty", "tx", "y0", "x0", "h", "w", F.col("data").alias("bits")).mapInPandas(spread("mask"), BESIDE))
