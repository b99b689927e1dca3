"""A mosaic: images with world coordinates on one canvas, matched in brightness and blended without a seam.

A pass over files takes a tile's gradient out and brings it to the canvas in squares; squares meet once to compare what
tiles have in common, in blocks, and once to be blended. The brightness of all tiles comes from normal equations that
are summed by pairs of tiles in Spark; the driver sees a few numbers a pair and solves for four numbers a tile.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images as im
from ..functions import wcs
from ..operators.mosaic import edge_points, feather
from ..operators.stacking import Grid, over_files
from ..sources import frames as sf
from ..sources.stages import Stages, fingerprint, use_checkpoints
from .stack import _joined, _numbered, image_of

TILES = "path string, tile long, height int, width int, vx double, vy double, vz double, scale double, cards map<string,string>"
WARPED = "tile long, c int, ty int, tx int, y0 int, x0 int, h int, w int, data binary, weight binary"
SAMPLES = "c int, i long, j long, a double, b double, x double, y double"
BLENDED = "c int, ty int, tx int, y0 int, x0 int, h int, w int, data binary, coverage binary"


@dataclasses.dataclass(frozen=True)
class MosaicSettings:
    gradient: int = -1  # degree of the sky taken out of each tile; -1: chosen by tile, 0: none
    gradient_block: int = 64
    match_block: int = 32
    match_plane: bool = True
    feather: float = 60.0
    seam_width: float = 4.0
    blend: str = "seam"  # or feather, or hard
    side: int = 512
    most_pixels: int = 1_600_000_000


@dataclasses.dataclass
class Mosaic:
    tiles: DataFrame
    photometry: list[dict]
    image: DataFrame
    grid: Grid
    projection: wcs.Projection


def mosaic(spark: SparkSession, path: str, work: str, settings: MosaicSettings | None = None) -> Mosaic:
    """All images under ``path`` whose headers have world coordinates, on a north-up canvas."""
    s = settings or MosaicSettings()
    stages = Stages(spark, work, dataclasses.asdict(s), fingerprint(spark, [path]))
    use_checkpoints(spark)
    files = sf.files(spark, path).select("path", "content")
    tiles = stages.run("tiles", lambda: located(_numbered(sf.light_frames(spark, path)).withColumnRenamed("frame", "tile")))
    grid, canvas = plan_canvas(tiles, s)
    warped = stages.run("warped", lambda: warp_tiles(_joined(files, tiles.select("path", "tile", "cards")), canvas, grid, s))
    samples = stages.run("samples", lambda: common_blocks(warped, grid, s.match_block))
    solved = match_photometry(samples, [r["tile"] for r in tiles.select("tile").orderBy("tile").collect()], s.match_plane)
    image = stages.run("image", lambda: blend(warped, solved, grid, s))
    return Mosaic(tiles, solved, image, grid, canvas)


# ------------------------------------------------------------ canvas


def located(headers: DataFrame) -> DataFrame:
    """TILES of headers that have world coordinates: the sum of the directions of their border and their scale."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                header = dict(r["header"])
                p = wcs.projection_of(header)
                if p is None:
                    continue
                ra, dec = (np.radians(v) for v in p.to_sky(*edge_points(r["height"], r["width"])))
                way = (np.cos(dec) * np.cos(ra)).mean(), (np.cos(dec) * np.sin(ra)).mean(), np.sin(dec).mean()
                out.append((r["path"], r["tile"], r["height"], r["width"], *way, p.scale(), {k: str(v) for k, v in p.cards().items()}))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in TILES.split(", ")])

    return headers.select("path", "tile", "header", "height", "width").mapInPandas(run, TILES)


def plan_canvas(tiles: DataFrame, s: MosaicSettings) -> tuple[Grid, wcs.Projection]:
    """A north-up tangent canvas about the mean direction of all borders, on the finest scale: two aggregations."""
    mean = tiles.agg(*[F.avg(c).alias(c) for c in ("vx", "vy", "vz")], F.min("scale").alias("scale")).first()
    if mean["scale"] is None:
        raise ValueError("no image has world coordinates")
    centre = (math.degrees(math.atan2(mean["vy"], mean["vx"])) % 360, math.degrees(math.atan2(mean["vz"], math.hypot(mean["vx"], mean["vy"]))))
    step = mean["scale"] / 3600
    flat = wcs.Projection((0.0, 0.0), centre, ((-step, 0.0), (0.0, step)))
    # whole pixels of the first tile fall on whole pixels of the canvas, so that tiles of its grid stay sharp
    first = wcs.projection_of(dict(tiles.orderBy("tile").first()["cards"]))
    here = [float(v) - c for v, c in zip(flat.to_pixel(*first.to_sky(*first.crpix)), first.crpix, strict=True)]
    flat = flat.moved(*(v - math.floor(v) for v in here))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                x, y = flat.to_pixel(*wcs.projection_of(dict(r["cards"])).to_sky(*edge_points(r["height"], r["width"])))
                out.append((x.min(), y.min(), x.max(), y.max()))
            yield pd.DataFrame(out, columns=["x0", "y0", "x1", "y1"])

    b = tiles.select("cards", "height", "width").mapInPandas(run, "x0 double, y0 double, x1 double, y1 double").agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    x0, y0, x1, y1 = math.floor(b[0]), math.floor(b[1]), math.ceil(b[2]), math.ceil(b[3])
    if (x1 - x0 + 1) * (y1 - y0 + 1) > s.most_pixels:
        raise ValueError(f"a canvas of {x1 - x0 + 1} x {y1 - y0 + 1} pixels is too large")
    return Grid(y1 - y0 + 1, x1 - x0 + 1, side=s.side, halo=halo_of(s)), flat.moved(x0, y0)


def blur_widths(s: MosaicSettings) -> tuple[float, float]:
    return s.seam_width, max(4.0, s.feather / 2)


def halo_of(s: MosaicSettings) -> int:
    """Pixels around a square that its blending looks at."""
    return sum(math.ceil(4 * w) for w in blur_widths(s)) if s.blend == "seam" else 0


# ------------------------------------------------------------ tiles on the canvas


def without_gradient(image: np.ndarray, s: MosaicSettings) -> np.ndarray:
    """A plane less a smooth sky fitted to its block medians, whose own median stays; NaN is left out."""
    if s.gradient == 0:
        return image
    b = s.gradient_block
    rows, cols = (-(-n // b) for n in image.shape)
    wide = np.full((rows * b, cols * b), np.nan)
    wide[: image.shape[0], : image.shape[1]] = image
    cells = wide.reshape(rows, b, cols, b).swapaxes(1, 2).reshape(rows, cols, -1)
    share = np.isfinite(cells).mean(2)
    levels = np.full((rows, cols), np.nan)
    levels[share >= 0.5] = np.nanmedian(cells[share >= 0.5], 1)
    if not np.isfinite(levels).any():
        return image
    degree = s.gradient if s.gradient > 0 else im.gradient_degree(levels)
    model = im.gradient(levels, degree)
    down = im.spline_weights((np.arange(rows) + 0.5) * b - 0.5, np.arange(image.shape[0]))
    across = im.spline_weights((np.arange(cols) + 0.5) * b - 0.5, np.arange(image.shape[1]))
    smooth = down @ model @ across.T
    return image - smooth + np.nanmedian(model)


def warp_tiles(files: DataFrame, canvas: wcs.Projection, grid: Grid, s: MosaicSettings) -> DataFrame:
    """WARPED squares of each file (path, content, tile, cards): the tile on the canvas with the weights of its
    feathered border. Samples of 0 in all channels are no data. Squares come with the border that blending needs."""
    names = [f.split()[0] for f in WARPED.split(", ")]

    def make(row: dict) -> list[tuple]:
        image, _ = sf.parse(row["path"], row["content"])
        p = wcs.projection_of(dict(row["cards"]))
        image = np.where((image == 0).all(0)[None], np.nan, image)
        image = [without_gradient(plane, s) for plane in image]
        height, width = image[0].shape
        ex, ey = canvas.to_pixel(*p.to_sky(*edge_points(height, width)))
        x0, y0 = max(0, math.floor(ex.min()) - 1), max(0, math.floor(ey.min()) - 1)
        x1, y1 = min(grid.width, math.ceil(ex.max()) + 2), min(grid.height, math.ceil(ey.max()) + 2)
        placed, there = np.full((len(image), y1 - y0, x1 - x0), np.nan, np.float32), None
        for y in range(y0, y1, 32):
            ys, xs = np.arange(y, min(y + 32, y1)), np.arange(x0, x1)
            at = p.to_pixel(*canvas.to_sky(*(g.ravel() for g in np.meshgrid(xs, ys))))
            sx, sy = (a.reshape(len(ys), -1) for a in at)
            for c, plane in enumerate(image):
                hole = np.isnan(plane)
                got = im.warp(np.where(hole, 0, plane), sx, sy)
                if hole.any():  # no value within reach of a hole
                    got = np.where(im.warp(hole.astype(np.float32), sx, sy) > 1e-3, np.nan, got)
                placed[c, y - y0 : y - y0 + len(ys)] = got
        there = np.isfinite(placed).all(0)
        weight = np.where(there, np.maximum(feather(there, max(1, round(s.feather))), 1e-3), 0).astype(np.float32)
        out = []
        reach = grid.halo
        for ty in range(max(0, y0 - reach) // grid.side, min(grid.height - 1, y1 + reach) // grid.side + 1):
            for tx in range(max(0, x0 - reach) // grid.side, min(grid.width - 1, x1 + reach) // grid.side + 1):
                a, b, c0, d = grid.box(ty, tx, reach)
                a, b, c0, d = max(a, y0), min(b, y1), max(c0, x0), min(d, x1)
                if a >= b or c0 >= d or not there[a - y0 : b - y0, c0 - x0 : d - x0].any():
                    continue
                cut = np.s_[a - y0 : b - y0, c0 - x0 : d - x0]
                out += [(row["tile"], c, ty, tx, a, c0, b - a, d - c0, placed[c][cut].astype("<f4").tobytes(), weight[cut].tobytes()) for c in range(len(placed))]
        return out

    return over_files(files, make, WARPED)


def squares(pdf: pd.DataFrame, y0: int, y1: int, x0: int, x1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tiles in order, their samples and weights over a box; NaN and 0 where a tile does not reach."""
    pdf = pdf.sort_values("tile")
    v, w = np.full((len(pdf), y1 - y0, x1 - x0), np.nan), np.zeros((len(pdf), y1 - y0, x1 - x0))
    for k, r in enumerate(pdf.itertuples(index=False)):
        at = np.s_[k, r.y0 - y0 : r.y0 - y0 + r.h, r.x0 - x0 : r.x0 - x0 + r.w]
        v[at], w[at] = (np.frombuffer(m, "<f4").reshape(r.h, r.w) for m in (r.data, r.weight))
    w[np.isnan(v)] = 0
    return pdf["tile"].to_numpy(), v, w


# ------------------------------------------------------------ photometry


def common_blocks(warped: DataFrame, grid: Grid, block: int) -> DataFrame:
    """SAMPLES: medians of two tiles over the pixels that both have, in blocks of the canvas of which at least half is
    common; x and y of the block's middle in -1..1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, out = pdf.iloc[0], []
        y0, y1, x0, x1 = grid.box(int(one.ty), int(one.tx))
        core = pdf[(pdf["y0"] < y1) & (pdf["y0"] + pdf["h"] > y0) & (pdf["x0"] < x1) & (pdf["x0"] + pdf["w"] > x0)]
        if len(core) > 1:
            a, b, c, d = grid.box(int(one.ty), int(one.tx), grid.halo)
            ids, v, _ = squares(core, a, b, c, d)
            v = v[:, y0 - a : y1 - a, x0 - c : x1 - c]
            for y in range(0, y1 - y0, block):
                for x in range(0, x1 - x0, block):
                    part = v[:, y : y + block, x : x + block].reshape(len(ids), -1)
                    full = np.flatnonzero(np.isfinite(part).mean(1) >= 0.5)
                    for k, i in enumerate(full):
                        for j in full[k + 1 :]:
                            both = np.isfinite(part[i]) & np.isfinite(part[j])
                            if both.sum() >= 0.5 * block * block:
                                px, py = ((q + 0.5 * block) / n * 2 - 1 for q, n in ((x0 + x, grid.width), (y0 + y, grid.height)))
                                out.append((one.c, ids[i], ids[j], np.median(part[i][both]), np.median(part[j][both]), px, py))
        return pd.DataFrame(out, columns=["c", "i", "j", "a", "b", "x", "y"])

    return warped.groupBy("c", "ty", "tx").applyInPandas(run, SAMPLES)


def match_photometry(samples: DataFrame, tiles: list[int], plane: bool = True, rounds: int = 5, gain_prior: float = 1e-4, plane_prior: float = 1e-3) -> list[dict]:
    """For each tile and channel (tile, c, gain, offset, plane_x, plane_y) such that tiles agree where they overlap: a
    tile v becomes gain v + offset + plane_x x + plane_y y; the first tile stays, and gains and planes are drawn
    weakly to 1 and 0. Samples beyond three scaled MADs of the last round's residuals do not count.

    A round sums the parts of the normal equations by pair (the driver gets 36 numbers a pair), solves, and looks at
    the residuals' spread."""
    spark, per = samples.sparkSession, 4 if plane else 2
    level = {r["c"]: r["m"] for r in samples.groupBy("c").agg(F.median("a").alias("m")).collect()}
    level = {c: m if m and abs(m) > 1e-12 else 1.0 for c, m in level.items()}
    place = {t: k - 1 for k, t in enumerate(tiles)}  # the first is known
    if not level:
        return [dict(tile=t, c=0, gain=1.0, offset=0.0, plane_x=0.0, plane_y=0.0) for t in tiles]
    scale = F.coalesce(*[F.when(F.col("c") == c, F.lit(1.0 / m)) for c, m in level.items()])
    terms = ["1", "x", "y"] if plane else ["1"]
    rows = samples.select("c", "i", "j", (F.col("a") * scale).alias("a"), (F.col("b") * scale).alias("b"), "x", "y").withColumn("1", F.lit(1.0)).checkpoint(eager=True)
    u, v = ["a", *terms], ["b", *terms]
    products = [(p, q) for k, p in enumerate(u) for q in u[k:]] + [(p, q) for k, p in enumerate(v) for q in v[k:]] + [(p, q) for p in u for q in v]
    products = list(dict.fromkeys(products))
    kept, solved, limit = rows, {}, None
    for _ in range(rounds):
        sums = kept.groupBy("c", "i", "j").agg(F.count("*").alias("n"), *[F.sum(F.col(p) * F.col(q)).alias(f"{p}*{q}") for p, q in products]).collect()
        solved = {c: solve([r.asDict() for r in sums if r["c"] == c], place, u, v, per, gain_prior, plane_prior) for c in level}
        table = spark.createDataFrame([(c, t, *map(float, fit)) for c, fits in solved.items() for t, fit in zip(tiles, fits, strict=True)], "c int, t long, " + ", ".join(f"k{k} double" for k in range(per)))
        side = lambda name, values: sum((F.col(f"{name}_k{k}") * F.col(x) for k, x in enumerate(values)), F.lit(0.0))
        named = lambda key, name: F.broadcast(table.select("c", F.col("t").alias(key), *[F.col(f"k{k}").alias(f"{name}_k{k}") for k in range(per)]))  # noqa: E731  a row a tile
        off = rows.join(named("i", "p"), ["c", "i"]).join(named("j", "q"), ["c", "j"]).withColumn("res", side("p", u) - side("q", v))
        off = off.select(*rows.columns, "res").checkpoint(eager=True)
        middle = {r["c"]: r["m"] for r in off.groupBy("c").agg(F.median("res").alias("m")).collect()}
        about = F.coalesce(*[F.when(F.col("c") == c, F.lit(m)) for c, m in middle.items()])
        spread = {r["c"]: 1.4826 * r["s"] + 1e-9 for r in off.groupBy("c").agg(F.median(F.abs(F.col("res") - about)).alias("s")).collect()}
        if spread == limit:
            break
        limit = spread
        kept = off.filter(F.abs("res") < 3 * F.coalesce(*[F.when(F.col("c") == c, F.lit(s)) for c, s in spread.items()]))
    out = []
    for c, fits in solved.items():
        for t, fit in zip(tiles, fits, strict=True):
            fit = [*fit, 0.0, 0.0][:4]
            out.append(dict(tile=t, c=c, gain=float(np.clip(fit[0], 0.2, 5.0)), offset=float(fit[1]) * level[c], plane_x=float(fit[2]) * level[c], plane_y=float(fit[3]) * level[c]))
    return out


def solve(sums: list[dict], place: dict[int, int], u: list[str], v: list[str], per: int, gain_prior: float, plane_prior: float) -> list[np.ndarray]:
    """Coefficients of every tile from the summed products of its overlaps; tiles without overlap stay as they are."""
    n = len(place) - 1
    m, r, counts = np.zeros((n * per, n * per)), np.zeros(n * per), np.zeros(n + 1)
    first = np.array([1.0] + [0.0] * (per - 1))
    for s in sums:
        i, j = place[s["i"]], place[s["j"]]
        get = lambda p, q: s.get(f"{p}*{q}", s.get(f"{q}*{p}"))
        uu, vv = (np.array([[get(p, q) for q in w] for p in w], float) for w in (u, v))
        uv = np.array([[s[f"{p}*{q}"] for q in v] for p in u], float)
        for k, own, other, cross in ((i, uu, j, -uv), (j, vv, i, -uv.T)):
            if k < 0:
                continue
            at = slice(k * per, (k + 1) * per)
            m[at, at] += own
            counts[k] += s["n"]
            if other >= 0:
                m[at, other * per : (other + 1) * per] += cross
            else:  # the known tile moves to the other side
                r[at] -= cross @ first
    for k in range(n):
        weight = max(counts[k], 1.0)
        m[k * per, k * per] += gain_prior * weight
        r[k * per] += gain_prior * weight
        for p in range(2, per):
            m[k * per + p, k * per + p] += plane_prior * weight
        m[k * per + 1, k * per + 1] += 1e-12 * weight
    fit = np.linalg.lstsq(m, r, rcond=None)[0] if n else np.zeros(0)
    return [first if k < 0 else fit[k * per : (k + 1) * per] for k in place.values()]


# ------------------------------------------------------------ blending


def composite(ids: np.ndarray, v: np.ndarray, w: np.ndarray, s: MosaicSettings) -> np.ndarray:
    """One image of tiles (tiles, rows, columns) with weights: by weights, by the tile of most weight, or what is
    smooth by weights and the detail from one tile at each place, so that stars are never doubled."""
    there = w.sum(0) > 0
    wide = np.where(there, np.nansum(np.nan_to_num(v) * w, 0) / np.maximum(w.sum(0), 1e-6), 0)
    if s.blend == "feather":
        return wide
    best = w.argmax(0)  # the first of equals
    narrow_width, wide_width = blur_widths(s)
    if s.blend == "hard":
        return np.where(there, np.take_along_axis(np.nan_to_num(v), best[None], 0)[0], 0)
    total, hard = np.zeros(there.shape), np.zeros(there.shape)
    for k in range(len(ids)):
        share = im.gaussian(((best == k) & there).astype(float), narrow_width) * np.isfinite(v[k])
        total += share
        hard += np.nan_to_num(v[k]) * share
    hard = np.where(there, hard / np.maximum(total, 1e-6), 0)
    return np.where(there, hard + im.masked_blur(wide - hard, there, wide_width), 0)


def blend(warped: DataFrame, photometry: list[dict], grid: Grid, s: MosaicSettings) -> DataFrame:
    """BLENDED squares of the canvas and how many tiles cover each pixel. The photometry is a few numbers a tile."""
    known = {(p["tile"], p["c"]): p for p in photometry}
    same = dict(gain=1.0, offset=0.0, plane_x=0.0, plane_y=0.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        a, b, c, d = grid.box(int(one.ty), int(one.tx), grid.halo)
        ids, v, w = squares(pdf, a, b, c, d)
        x, y = (np.arange(c, d) + 0.5) / grid.width * 2 - 1, (np.arange(a, b) + 0.5) / grid.height * 2 - 1
        for k, t in enumerate(ids):
            p = known.get((t, one.c), same)
            v[k] = p["gain"] * v[k] + p["offset"] + p["plane_x"] * x[None] + p["plane_y"] * y[:, None]
        y0, y1, x0, x1 = grid.box(int(one.ty), int(one.tx))
        core = np.s_[y0 - a : y1 - a, x0 - c : x1 - c]
        image, cover = composite(ids, v, w, s)[core], (w > 0).sum(0)[core]
        row = (one.c, one.ty, one.tx, y0, x0, y1 - y0, x1 - x0, image.astype("<f4").tobytes(), cover.astype("<u2").tobytes())
        return pd.DataFrame([row], columns=[f.split()[0] for f in BLENDED.split(", ")])

    return warped.groupBy("c", "ty", "tx").applyInPandas(run, BLENDED)


def write_mosaic(out: Mosaic, path: str) -> dict:
    """The image and its coverage as files; the driver holds one image."""
    import os

    cards = {"MOSTILES": out.tiles.count()} | out.projection.cards()
    stem, suffix = os.path.splitext(path)
    sf.write_fits(path, image_of(out.image, "data", "<f4", out.grid.height, out.grid.width), cards)
    cover = image_of(out.image.filter("c = 0"), "coverage", "<u2", out.grid.height, out.grid.width)[0]
    sf.write_fits(f"{stem}_coverage{suffix}", cover.astype(np.float32), {"MAPTYPE": "coverage"} | out.projection.cards())
    return cards


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="skyloom-mosaic", description="Join images with world coordinates.")
    p.add_argument("tiles")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--work", required=True, help="folder of the stages, shared by all executors")
    for f in dataclasses.fields(MosaicSettings):
        name = f.name.replace("_", "-")
        if f.type == "bool":
            p.add_argument(f"--{name}", dest=f.name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            p.add_argument(f"--{name}", type={"str": str, "float": float, "int": int}[f.type], default=f.default)
    args = vars(p.parse_args(argv))
    tiles, output, work = args.pop("tiles"), args.pop("output"), args.pop("work")
    spark = SparkSession.builder.appName("skyloom-mosaic").getOrCreate()
    print(json.dumps({"output": output} | write_mosaic(mosaic(spark, tiles, work, MosaicSettings(**args)), output)))


if __name__ == "__main__":
    main()
