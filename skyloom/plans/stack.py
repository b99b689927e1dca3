"""The whole stack: frames in, a combined image with coverage out, every stage durable."""

from __future__ import annotations

import argparse
import dataclasses
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import deconvolution as de
from ..functions import geometry as ge
from ..functions import images as im
from ..operators import frames as fr
from ..operators import images as oi
from ..operators import reports as rp
from ..operators import restoration as rs
from ..operators import stacking as sk
from ..sources import frames as sf
from ..sources.stages import Stages, fingerprint, use_checkpoints


@dataclasses.dataclass(frozen=True)
class StackSettings:
    """What decides a result; a change of any makes all stages anew."""

    method: str = "sigma"
    low: float = 3.0
    high: float = 3.0
    rounds: int = 5
    weighting: str = "psfsnr"
    preset: str = "Balanced"
    filters: bool = True
    least_signal: float = 0.0  # of the exposure group's median PSF signal; 0: not asked
    least_stars: int = 3
    detect_sigma: float = 5.0
    tile: int = 0  # pixels of a side; 0: by the number of frames
    dark: str = ""
    bias: str = ""
    flat: str = ""
    pedestal: float = 0.0
    hot_sigma: float = 0.0
    cold_sigma: float = 0.0
    debayer: str = "auto"  # on, off, or by the header
    pattern: str = ""  # of the colour filters: RGGB, BGGR, GRBG or GBRG; else the header's
    debayer_method: str = "vng"
    refine: bool = True
    union: bool = False  # a grid that holds all frames
    normalise: bool = True
    local: bool = False  # local normalisation in a second pass, from three frames on
    block: int = 128
    large_scale: bool = False
    large_box: int = 15
    large_density: float = 0.3
    large_grow: int = 7
    drizzle: bool = False
    drizzle_scale: float = 2.0
    drizzle_pixfrac: float = 0.8
    drizzle_kernel: str = "square"
    sharpen: bool = False  # joint deconvolution of the sharpest frames
    sharpen_frames: int = 24
    sharpen_rounds: int = 15
    sharpen_kappa: float = 1.5
    sharpen_blend: float = 1.0  # share of the deconvolved image
    autocrop: float = 0.0  # share of the frames that must cover every pixel that is left


@dataclasses.dataclass
class Stacked:
    """Frames with what was measured and decided, tiles of the image, its grid, and the finer image if asked for."""

    frames: DataFrame
    master: DataFrame
    grid: sk.Grid
    reference: int
    report: DataFrame
    drizzled: DataFrame | None = None
    restored: DataFrame | None = None


#: Samples that a task of the combination holds, as eight-byte numbers with a few copies.
TASK_SAMPLES = 16_000_000
#: Settings that decide what a file becomes before it is placed.
PREPARING = ("dark", "bias", "flat", "pedestal", "hot_sigma", "cold_sigma", "debayer", "pattern", "debayer_method")
#: Rows of about 500 bytes that are sent to every task; more are joined.
BROADCAST_FRAMES = 100_000
#: Least share of a frame that must fall on the reference for a grid of all frames.
UNION_OVERLAP = 0.25


def tile_side(frames: int, halo: int = 0) -> int:
    """A side such that a tile of all frames, borders included, fits in a task."""
    return int(min(512, max(16, (TASK_SAMPLES / max(1, frames)) ** 0.5 - 2 * halo)))


def stack(spark: SparkSession, path: str | list[str], work: str, settings: StackSettings | None = None) -> Stacked:
    """All frames under ``path`` (a folder, or files) as one image. Pixels are exchanged once, between the passes over files and the
    combination (twice with local normalisation, whose goal is the image of the first pass)."""
    s = settings or StackSettings()
    if s.weighting not in fr.WEIGHT_MODES:
        raise ValueError(f"unknown weighting {s.weighting!r}")
    stages = Stages(spark, work, dataclasses.asdict(s), fingerprint(spark, [path] if isinstance(path, str) else list(path)))
    use_checkpoints(spark)
    lights = stages.run("lights", lambda: _numbered(sf.light_frames(spark, path)))  # a row a frame
    how, files = preparation(spark, s), sf.files(spark, path).select("path", "content")
    inputs = sf.listing(spark, path).join(lights.select("path", "frame"), "path")
    making = {k: getattr(s, k) for k in PREPARING} | {"masters": fingerprint(spark, [getattr(s, k) for k in ("dark", "bias", "flat") if getattr(s, k)])}
    analysed = stages.each("analysed", inputs, making | {"sigma": s.detect_sigma}, lambda todo: sk.analyse(_joined(files, todo), how, s.detect_sigma))
    table = measured(lights, analysed)
    judged = stages.run("judged", lambda: judge(table, s))
    usable = judged.filter("reason is null")
    chosen = rp.choose_reference(usable.select("frame", "fwhm", "noise", "stars", "light", "exposure", F.col("arcsec").alias("scale"))).first() or usable.orderBy("fwhm", "frame").first()
    if chosen is None:
        raise ValueError("no frame is left")
    reference = usable.filter(F.col("frame") == chosen["frame"]).first().asDict()
    first = reference["frame"]
    aligned = stages.run("aligned", lambda: sk.align(usable, reference, s.refine, UNION_OVERLAP if s.union else 0.0))
    placed = usable.join(aligned.filter("failure is null and matrix is not null"), "frame")
    combination = sk.Combination(s.method, s.low, s.high, s.rounds, s.weighting != "none", s.normalise or s.local, s.large_scale, s.large_box, s.large_density, s.large_grow, masks=s.drizzle)
    grid = common_grid(placed, reference, s, combination.halo())
    stars, radius = ge.photometry_stars({c: reference[f"star_{c}"] for c in ("x", "y", "peak")}, (reference["height"], reference["width"]), reference["fwhm"])
    plan = placed.select("path", "frame", "matrix", "inverse", "forward")
    same = inputs.filter(F.col("frame") == first).select("path", "size", "changed").first()
    placing = making | {"grid": dataclasses.asdict(grid), "reference": [str(v) for v in same], "refine": s.refine, "block": s.block, "sigma": s.detect_sigma}
    registered = stages.each("registered", inputs.join(placed.select("frame"), "frame", "left_semi"), placing, lambda todo: sk.register(_joined(files, plan.join(todo, "frame", "left_semi")), how, grid, stars - grid.origin[::-1], radius, s.block), by="frame")
    whole = registered.filter("c = -1").select("frame", "location", "sigma", "flux", "block_median", "block_sigma", "block_share").join(placed, "frame")
    own = whole.filter(F.col("frame") == first).first().asDict()
    weighed = stages.run("weighed", lambda: weigh(whole, own, s))
    kept = weighed.filter("reason is null")
    tiles, channels = registered.filter("c >= 0").select("frame", "c", "ty", "tx", "y0", "x0", "h", "w", "data"), len(own["location"])

    def combined(local: tuple | None, options: sk.Combination) -> DataFrame:
        return sk.combine(tiles, sk.terms(kept, grid, channels, own["location"], local, s.block), grid, options)

    local = None
    if s.local and kept.count() >= 3:
        plain = stages.run("first", lambda: combined(None, dataclasses.replace(combination, masks=False)))
        local = sk.master_blocks(plain, grid, s.block)
    made = stages.run("master", lambda: combined(local, combination))
    out = Stacked(weighed, made.filter("frame is null").drop("frame"), grid, first, rp.session_table(lights, judged, aligned, weighed))
    if s.drizzle:
        drop = sk.Drop(s.drizzle_scale, s.drizzle_pixfrac, s.drizzle_kernel, side=max(64, tile_side(128)))
        going = kept.select("path", "frame", "matrix", "forward")
        around = sk.terms(kept, grid, channels, own["location"], local, s.block)
        sums = stages.run("drizzled", lambda: sk.drizzle(_joined(files, going), how, going, around, made.filter("frame is not null"), grid, drop))
        n = sums.agg(F.max("c")).first()[0]
        out.drizzled = sk.drizzled_image(sums, sk.drizzled_weight_floor(sums, drop, grid, (n or 0) + 1))
    if s.sharpen:
        best = rp.sharpest(kept, s.sharpen_frames).join(lights.select("frame", "header"), "frame").select("frame", "fwhm", "location", "scale", fc.header_number("header", "EGAIN", "GAIN").alias("gain"), fc.header_number("header", "RDNOISE", "READNOIS", "RON").alias("read_noise"))
        chosen = {r["frame"]: r.asDict() for r in best.collect()}  # sharpen_frames rows
        assets = [r.asDict() for r in stages.run("kernels", lambda: rs.kernels(tiles, chosen, own["location"], grid)).collect()]
        out.restored = stages.run("restored", lambda: rs.restored(tiles, assets, chosen, own["location"], grid, de.Restoration(s.sharpen_rounds, s.sharpen_kappa)))
    return out


def restored_image(out: Stacked, s: StackSettings) -> np.ndarray:
    """The deconvolved image, blended with the plain one."""
    return im.blend_strength(master_image(out), image_of(out.restored, "data", "<f4", out.grid.height, out.grid.width), s.sharpen_blend)


def _numbered(headers: DataFrame) -> DataFrame:
    """Headers with ``frame``: the place of a file in the order of names."""
    return fr.numbered(headers, ["path"], "frame").withColumn("frame", F.col("frame") - 1)


def _joined(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Files with what is planned for them. Few plans go to all tasks, so that contents stay where they are read."""
    return files.join(F.broadcast(plan) if plan.count() <= BROADCAST_FRAMES else plan, "path")


def preparation(spark: SparkSession, s: StackSettings) -> sk.Preparation:
    """Calibration masters, one image each, are read by the driver and go along with the tasks."""
    held = {k: master_frame(spark, getattr(s, k)) for k in ("dark", "bias", "flat") if getattr(s, k)}
    gain = oi.flat_gain(held["flat"][0], held.get("bias")) if "flat" in held else None
    return sk.Preparation(held.get("dark") or held.get("bias"), None if gain is None else gain.astype(np.float32), s.pedestal, s.hot_sigma, s.cold_sigma, s.debayer, s.pattern, s.debayer_method)


def master_frame(spark: SparkSession, path: str) -> tuple[np.ndarray, bool]:
    """A calibration master and whether it is of unit range."""
    rows = sf.files(spark, path).select("path", "content").take(2)
    if len(rows) != 1:
        raise ValueError(f"{path}: a master is one file")
    image = sf.parse(rows[0]["path"], bytes(rows[0]["content"]))[0]
    if image is None:
        raise ValueError(f"{path}: no image")
    return image, bool(image.max() <= 1 + 1e-6)


def measured(lights: DataFrame, analysed: DataFrame) -> DataFrame:
    """Frames with their stars and what headers say."""
    told = lights.select("path", "frame", fc.header_number("header", "EXPTIME", "EXPOSURE").alias("exposure"), fc.pixel_scale("header").alias("arcsec"), fc.camera_label("header").alias("camera"))
    bright = F.expr("aggregate(slice(star_flux, 1, 30), 0D, (a, b) -> a + b)")
    return analysed.join(told, "path").withColumn("stars", F.col("found")).withColumn("light", bright)


def judge(table: DataFrame, s: StackSettings) -> DataFrame:
    few = F.when(F.col("found") < s.least_stars, F.concat(F.lit("only "), F.col("found").cast("string"), F.lit(" stars")))
    table = table.withColumn("reason", few)
    return fr.filter_frames(table, **fr.filter_preset(s.preset)) if s.filters else table


def common_grid(placed: DataFrame, reference: dict, s: StackSettings, halo: int) -> sk.Grid:
    """The reference's grid, or one that holds every frame: the driver sees the least and the greatest of boxes."""
    n = placed.count()
    side = s.tile or tile_side(n, halo)
    if not s.union:
        return sk.Grid(reference["height"], reference["width"], side=side, halo=halo)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([ge.footprint(sk.matrix_of(r.matrix), (r.height, r.width), sk.cubic_of(r.forward)) for r in pdf.itertuples(index=False)], columns=["y0", "x0", "y1", "x1"])

    boxes = placed.select("matrix", "forward", "height", "width").mapInPandas(run, "y0 int, x0 int, y1 int, x1 int")
    b = boxes.agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1")).first()
    return sk.Grid(b["y1"] - b["y0"] + 1, b["x1"] - b["x0"] + 1, (b["y0"], b["x0"]), side, halo)


def weigh(whole: DataFrame, reference: dict, s: StackSettings) -> DataFrame:
    """Frames with transparency, signal, weight and factors (weights over the sensor), and the reason if they go."""
    f = sk.photometric_scale(whole, reference).checkpoint(eager=True)  # a row a frame, looked at by every median below
    good = fr.filter_transparency(f, fr.PRESETS[s.preset][0] if s.filters else 0.0)
    signal = fr.relative_signal(good)
    kept = fr.filter_signal(signal, s.least_signal if s.filters else 0.0)
    base = float(np.mean(reference["location"])) - reference["added"]
    mean = lambda c: F.expr(f"aggregate({c}, 0D, (a, b) -> a + b) / size({c})")
    terms = kept.select("frame", "noise", "fwhm", F.col("flux_ratio").alias("transparency"), (F.col("sky") - F.col("added")).alias("sky"), mean("scale").alias("scale"), (F.lit(base) - mean("scale") * (mean("location") - F.col("added"))).alias("offset"))
    weights = fr.frame_weights(terms, s.weighting).select("frame", "weight")
    out = f.drop("reason").join(signal.select("frame", F.lit(True).alias("__clear"), "psfsw"), "frame", "left").join(weights, "frame", "left")
    gone = F.when(F.col("__clear").isNull(), "filter: transparency").when(F.col("weight").isNull(), "filter: signal")
    out = out.withColumn("reason", gone).drop("__clear")
    if s.weighting == "psfsnr+field":
        cells = out.filter("reason is null").select("frame", F.posexplode(F.arrays_zip("grid", "counts")).alias("k", "cell")).select("frame", F.floor(F.col("k") / 4).alias("row"), (F.col("k") % 4).alias("col"), F.col("cell.counts").alias("stars"), F.col("cell.grid").alias("fwhm"))
        fields = rp.field_factors(cells).groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "factor"))), lambda c: c["factor"]).alias("factors"))
        return out.join(fields, "frame", "left")
    return out.withColumn("factors", F.lit(None).cast("array<double>"))


# ------------------------------------------------------------ results


def image_of(tiles: DataFrame, column: str, kind: str, height: int, width: int) -> np.ndarray:
    """One image (channels, height, width) from tiles, a tile at a time."""
    planes: dict[int, np.ndarray] = {}
    for r in tiles.select("c", "y0", "x0", "h", "w", column).toLocalIterator():
        plane = planes.setdefault(r["c"], np.zeros((height, width), np.dtype(kind).newbyteorder("=")))
        plane[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.frombuffer(r[column], kind).reshape(r["h"], r["w"])
    return np.stack([planes[c] for c in sorted(planes)])


def master_image(out: Stacked) -> np.ndarray:
    """The combined image as one array (channels, height, width)."""
    return image_of(out.master, "data", "<f4", out.grid.height, out.grid.width)


def coverage_map(out: Stacked) -> np.ndarray:
    """How many frames cover each pixel (of the first channel)."""
    return image_of(out.master.filter("c = 0"), "coverage", "<u2", out.grid.height, out.grid.width)[0]


def rejection_map(out: Stacked) -> np.ndarray:
    """Which share of samples was rejected, as a mean of channels."""
    return image_of(out.master, "rejection", "<f4", out.grid.height, out.grid.width).mean(0)


def drizzled_array(out: Stacked, s: StackSettings, column: str = "data") -> np.ndarray:
    high, wide = ge.drizzle_shape(out.grid.height, out.grid.width, s.drizzle_scale)
    return image_of(out.drizzled, column, "<f4" if column == "data" else "<f8", high, wide)


def write_results(out: Stacked, path: str, s: StackSettings) -> dict:
    """The image with its maps beside it; what is written is one image each, which the driver holds."""
    import os

    image, cover, rejected = master_image(out), coverage_map(out), rejection_map(out)
    kept = out.frames.filter("reason is null")
    total = kept.agg(F.count("*").alias("n"), F.sum("exposure").alias("t"), (F.sum("weight") * F.sum("weight") / F.sum(F.col("weight") * F.col("weight"))).alias("e")).first()
    gone = out.master.agg(F.sum("n_low").alias("low"), F.sum("n_high").alias("high")).first()
    samples = max(1, int(cover.sum(dtype=np.int64)) * len(image))
    cards = {"NFRAMES": total["n"], "NEFF": round(total["e"] or 0.0, 2), "EXPTOTAL": total["t"] or 0.0, "STACKMTH": s.method, "REJFRAC": round(((gone["low"] or 0) + (gone["high"] or 0)) / samples, 6), "WEIGHTMD": s.weighting, "LOCNORM": s.local}
    box = ge.crop_box(cover, total["n"], s.autocrop) if s.autocrop > 0 else None
    if box is not None:
        y0, y1, x0, x1 = box
        image, cover, rejected = image[:, y0:y1, x0:x1], cover[y0:y1, x0:x1], rejected[y0:y1, x0:x1]
        cards |= {"CROPX0": x0, "CROPY0": y0, "CROPDPTH": s.autocrop}
    stem, suffix = os.path.splitext(path)
    out.report.orderBy("frame").toPandas().to_csv(f"{stem}.frames.csv", index=False)  # a row a frame
    sf.write_fits(path, image, cards)
    sf.write_fits(f"{stem}_coverage{suffix}", cover.astype(np.float32), {"MAPTYPE": "coverage"})
    sf.write_fits(f"{stem}_rejection{suffix}", rejected, {"MAPTYPE": "rejection"})
    if out.restored is not None:
        sharp = restored_image(out, s)
        sf.write_fits(f"{stem}_sharpened{suffix}", sharp if box is None else sharp[:, y0:y1, x0:x1], cards | {"MFBLEND": s.sharpen_blend, "MFKAPPA": s.sharpen_kappa})
    if out.drizzled is not None:
        fine = {"DRIZSCL": s.drizzle_scale, "DRIZKERN": s.drizzle_kernel, "DRIZPIX": s.drizzle_pixfrac}
        whole = [drizzled_array(out, s), drizzled_array(out, s, "den").mean(0).astype(np.float32)]
        if box is not None:
            y0, y1, x0, x1 = (round(v * s.drizzle_scale) for v in box)
            whole = [a[..., y0:y1, x0:x1] for a in whole]
        sf.write_fits(f"{stem}_drizzle{suffix}", whole[0], cards | fine)
        sf.write_fits(f"{stem}_drizzle_weight{suffix}", whole[1], {"MAPTYPE": "drizzle_weight"} | fine)
    return cards


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="skyloom", description="Combine frames into one image.")
    p.add_argument("lights")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--work", required=True, help="folder of the stages, shared by all executors")
    for f in dataclasses.fields(StackSettings):
        name = f.name.replace("_", "-")
        if f.type == "bool":
            p.add_argument(f"--{name}", dest=f.name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            p.add_argument(f"--{name}", type={"str": str, "float": float, "int": int}[f.type], default=f.default)
    args = vars(p.parse_args(argv))
    lights, output, work = args.pop("lights"), args.pop("output"), args.pop("work")
    spark = SparkSession.builder.appName("skyloom").getOrCreate()
    settings = StackSettings(**args)
    print(json.dumps({"output": output} | write_results(stack(spark, lights, work, settings), output, settings)))


if __name__ == "__main__":
    main()
