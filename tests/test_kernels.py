"""Kernels against plain re-implementations and planted cases."""

import collections
import math

import numpy as np
import pytest

from skyloom.functions import deconvolution as de
from skyloom.functions import images as im
from skyloom.functions.studentt import critical
from skyloom.operators import combine as co
from skyloom.operators import images as oi
from skyloom.sources import frames as fs


def test_published_critical_values():
    assert critical(53, 0.05) == pytest.approx(3.158, abs=2e-3)
    assert critical(44, 0.05) == pytest.approx(3.085, abs=2e-3)


def test_gesd_plants():
    v = np.random.default_rng(3).normal(100, 2, 40)
    v[[3, 9, 20]] = 400, 350, 20
    side = co.gesd_sides(v)
    assert side[3] == side[9] == 1 and side[20] == -1
    assert not co.gesd_sides(np.full(12, 5.0)).any()
    assert not co.gesd_sides(np.full(6, np.nan)).any()
    assert not co.gesd_sides(np.array([1.0, 2.0, 900.0])).any()


def slow_gesd(v, fraction=0.3, alpha=0.05, relax=1.5):
    k, alive = max(1, min(len(v) - 3, math.floor(len(v) * fraction))), [i for i in range(len(v)) if not math.isnan(v[i])]
    n, middle = len(alive), sorted(v[i] for i in alive)[(len(alive) - 1) // 2]
    gone, accepted = [], 0
    for i in range(1, min(k, n - 2) + 1):
        x = np.array([v[j] for j in alive])
        s = max(x.std(ddof=1), 1e-12)
        lo, hi = min(alive, key=lambda j: v[j]), max(alive, key=lambda j: v[j])
        below, above = (x.mean() - v[lo]) / s / relax, (v[hi] - x.mean()) / s
        j, r = (hi, above) if above >= below else (lo, below)
        alive.remove(j)
        gone.append(j)
        if r > critical(n - i, alpha):
            accepted = i
    return {j: -1 if v[j] < middle else 1 for j in gone[:accepted]}


def test_gesd_brute():
    r = np.random.default_rng(21)
    for _ in range(60):
        v = r.normal(1500, 100, r.integers(6, 50))
        v[r.integers(0, len(v), 3)] += r.choice([-900, 900, 0], 3)
        got = co.gesd_sides(v)
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == slow_gesd(v)


def test_gesd_of_many_cells():
    """A matrix gives what its columns give one by one; gaps, ties, equal samples and wild values."""
    r = np.random.default_rng(22)
    v = r.normal(100, 3, (24, 300)).round(1)
    v[r.random(v.shape) < 0.1] = np.nan
    v[r.integers(0, 24, 300), np.arange(300)] += r.choice([0, 60, -60, 4e4], 300)
    v[:, 5], v[:, 6], v[:21, 7] = 7.0, np.nan, np.nan
    got = co.gesd_sides(v)
    for k in range(300):
        assert np.array_equal(got[:, k], co.gesd_sides(v[:, k]))
        if np.count_nonzero(~np.isnan(v[:, k])) > 2:
            want = slow_gesd(v[:, k])
            assert collections.Counter(got[got[:, k] != 0, k].tolist()) == collections.Counter(want.values())
            assert sorted(v[got[:, k] != 0, k]) == sorted(v[j, k] for j in want)
    assert (got != 0).any(0).sum() > 100


def test_gesd_of_equal_deviates():
    """Where both ends deviate alike, the choice is that of the query's SQL: by its rounding."""
    import duckdb

    from skyloom.plans.catalog import ORACLES

    cells = [
        [-270, -234, 3, 5, 5, 9, 11, 15, 25, 35, 35, 36, 36, 37, 171],
        [-186, 4, 9, 10, 13, 15, 17, 18, 21, 22, 29, 30, 32, 35, 41, 43, 43, 48, 50, 162, 369],
    ]
    con = duckdb.connect()
    con.sql("create table lineitem (l_partkey bigint, l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double)")
    for cell, values in enumerate(cells):
        for k, v in enumerate(values):
            line, quantity = (5, -v / 6) if v < 0 else (6, v / 9) if v > 50 else (1, v)
            con.execute("insert into lineitem values (?, ?, ?, ?, 0)", [cell, k, line, quantity])
    want = {r[0]: r[3:] for r in con.sql(ORACLES["combine_gesd_tails"]).fetchall()}
    for cell, values in enumerate(cells):
        side = co.gesd_sides(np.array(values, float))
        assert ((side == -1).sum(), (side == 1).sum()) == want[cell] and any(want[cell])


@pytest.mark.parametrize("method", ["sigma", "winsorized", "percentile", "gesd", "median", "none"])
def test_both_forms_agree(spark, method):
    r = np.random.default_rng(5)
    x = r.normal(100, 2, (12, 6, 5))
    x[3, 2, 2], x[4, 1, 1], x[0, 0, 0] = 5000, -800, np.nan
    long = [(y * 5 + k, f, None if math.isnan(x[f, y, k]) else float(np.float32(x[f, y, k]))) for f in range(12) for y in range(6) for k in range(5)]
    df = spark.createDataFrame(long, "cell long, frame long, v double")
    options = {"low": 3.0, "high": 3.0} if method in ("sigma", "winsorized") else {"low": 0.5, "high": 0.5} if method == "percentile" else {}
    a = {r_["cell"]: r_ for r_ in co.combine(df, method, **options).collect()}
    bands = spark.createDataFrame([(f, 0, y // 3, y, 3, 5, bytes(x[f, y : y + 3].astype("<f4").tobytes())) for f in range(12) for y in (0, 3)], oi.BANDS)
    lo, hi = (3.0, 3.0) if method != "percentile" else (0.5, 0.5)
    for b in oi.stack_bands(bands, method, lo, hi).collect():
        got = np.frombuffer(b["data"], "<f4").reshape(3, 5)
        cells = [a[(b["row_start"] + y) * 5 + k] for y in range(3) for k in range(5)]
        assert np.allclose(got.ravel(), [c["value"] for c in cells], rtol=1e-5)
        assert b["n_low"] == sum(c["n_low"] for c in cells) and b["n_high"] == sum(c["n_high"] for c in cells)


def test_nothing_left(spark):
    df = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, None, 1.0), (2, 1, 4.0, 0.0)], "cell int, frame int, v double, w double")
    assert {r["cell"]: r["value"] for r in co.combine(df, "sigma").collect()} == {1: 0.0, 2: 4.0}
    assert {r["cell"]: r["value"] for r in co.combine(df, "sigma", weighted=True).collect()} == {1: 0.0, 2: 0.0}


def scene(stars, shape=(160, 200), fwhm=3.2, seed=0):
    r = np.random.default_rng(seed)
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    out = r.normal(50, 2, shape)
    for x, y, a in stars:
        out += a * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * (fwhm / 2.3548) ** 2))
    return out


def field(n=35, seed=1):
    r = np.random.default_rng(seed)
    return np.c_[r.uniform(12, 188, n), r.uniform(12, 148, n), r.uniform(400, 6000, n)]


def test_detect_align_warp():
    f = field()
    a = im.detect(scene(f))
    assert 25 <= len(a["x"]) <= 36 and abs(np.median(a["fwhm"]) - 3.2) < 0.8
    moved = f.copy()
    moved[:, 0] += 3.2
    moved[:, 1] -= 1.7
    image = scene(moved, seed=2)
    b = im.detect(image)
    m, votes = im.align(np.c_[b["x"], b["y"]], np.c_[a["x"], a["y"]])
    assert votes >= 15 and np.allclose(m[:2, 2], [-3.2, 1.7], atol=0.3)
    yy, xx = np.mgrid[:160, :200]
    at = im.apply_matrix(np.linalg.inv(m), np.c_[xx.ravel(), yy.ravel()])
    back = im.warp(image, at[:, 0].reshape(160, 200), at[:, 1].reshape(160, 200))
    assert np.isnan(back).any()
    ok = np.isfinite(back[20:140, 20:180])
    assert np.corrcoef(back[20:140, 20:180][ok], scene(f)[20:140, 20:180][ok])[0, 1] > 0.97


def test_components_by_flood():
    r = np.random.default_rng(4)
    mask = r.random((30, 40)) < 0.55
    got, seen, want = im.components(mask), {}, np.zeros(mask.shape, int)
    for y, x in np.argwhere(mask):
        if not want[y, x]:
            todo, n = [(y, x)], want.max() + 1
            want[y, x] = n
            while todo:
                a, b = todo.pop()
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < 30 and 0 <= d < 40 and mask[c, d] and not want[c, d]:
                        want[c, d] = n
                        todo.append((c, d))
    for a, b in zip(got.ravel(), want.ravel(), strict=True):
        assert seen.setdefault(b, a) == a
    assert (got > 0).sum() == mask.sum() and got.max() == want.max()


def test_rectangle_brute():
    r = np.random.default_rng(8)
    for _ in range(30):
        m = r.random((7, 9)) < 0.7
        box = im.largest_rectangle(m)
        best = max(((b - a) * (d - c) for a in range(7) for b in range(a + 1, 8) for c in range(9) for d in range(c + 1, 10) if m[a:b, c:d].all()), default=0)
        assert (0 if box is None else (box[1] - box[0]) * (box[3] - box[2])) == best
        assert box is None or m[box[0] : box[1], box[2] : box[3]].all()


def test_vng_flat_and_colour():
    yy, xx = np.mgrid[:20, :24]
    site = np.array([[0, 1], [1, 2]])[yy % 2, xx % 2]
    colour = np.array([900.0, 500.0, 200.0])
    out = im.vng(colour[site])
    assert np.allclose(out, colour[:, None, None], atol=1e-3)


def test_deconvolution_sharpens():
    truth = scene([(40, 40, 4000), (60, 52, 2500)], (96, 96), 1.6) - 50 + 60
    psf = im.gaussian_psf(15, 4.0)
    y = np.stack([np.maximum(im.correlate(truth, psf), 1) for _ in range(3)])
    x, n = de.restore(y, np.stack([psf] * 3), np.ones_like(y), np.full_like(y, 25.0))
    assert n >= 2 and np.abs(x - truth).mean() < np.abs(y[0] - truth).mean()


def test_wcs_round_trip():
    wcs = ((50.0, 60.0), (120.0, 35.0), ((-5e-4, 1e-5), (1e-5, 5e-4)))
    px, py = np.meshgrid(np.linspace(0, 100, 9), np.linspace(0, 120, 7))
    qx, qy = im.sky_to_tan(*im.tan_to_sky(px, py, *wcs), *wcs)
    assert np.allclose(qx, px, atol=1e-6) and np.allclose(qy, py, atol=1e-6)
    assert im.pixel_scale(wcs[2]) == pytest.approx(1.8, rel=1e-2)


def test_gradient():
    y, x = np.mgrid[:12, :16]
    blocks = 100 + 3.0 * x - 2.0 * y + np.random.default_rng(0).normal(0, 0.3, x.shape)
    blocks[4, 5], blocks[0, 0] = 900, np.nan
    assert im.gradient_degree(blocks) == 1
    assert np.nanmax(np.abs((im.gradient(blocks, 1) - (100 + 3.0 * x - 2.0 * y)))) < 1.0


def test_fits_and_xisf(spark, tmp_path):
    a = np.random.default_rng(1).normal(100, 5, (3, 20, 30)).astype(np.float32)
    fs.write_fits(str(tmp_path / "one.fits"), a, {"EXPTIME": 60.0, "FILTER": "L", "NAXIS1": 7})
    got, header = fs.parse(str(tmp_path / "one.fits"), (tmp_path / "one.fits").read_bytes())
    assert np.array_equal(got, a) and header["EXPTIME"] == "60.0" and header["FILTER"] == "L"
    xml = b'<?xml version="1.0"?><xisf xmlns="urn:xisf"><Image geometry="30:20:3" sampleFormat="Float32" location="attachment:4096:7200"><FITSKeyword name="GAIN" value="1.5" comment=""/></Image></xisf>'
    raw = (b"XISF0100" + len(xml).to_bytes(4, "little") + b"\0" * 4 + xml).ljust(4096, b"\0") + a.astype("<f4").tobytes()
    (tmp_path / "two.xisf").write_bytes(raw)
    heads = {r["path"].rsplit("/", 1)[1]: r for r in fs.read_headers(spark, str(tmp_path)).collect()}
    assert heads["two.xisf"]["header"]["GAIN"] == "1.5" and (heads["one.fits"]["channels"], heads["one.fits"]["height"], heads["one.fits"]["width"]) == (3, 20, 30)
    bands = fs.read_frames(spark, str(tmp_path), band_rows=8)
    assert bands.count() == 2 * 3 * 3
    assert fs.pixels(bands.filter("c = 1")).filter("y = 9 and x = 4").select("v").first()[0] == pytest.approx(float(a[1, 9, 4]))
    assert fs.read_headers(spark, str(tmp_path)).filter(fs.own_output()).count() == 1


@pytest.mark.parametrize("band", [4, 7, 24])
def test_stencil_is_the_same_for_any_bands(spark, band):
    image = np.random.default_rng(6).normal(0, 1, (24, 10))
    rows = [(1, 0, y // band, y, min(band, 24 - y), 10, bytes(image[y : y + band].astype("<f4").tobytes())) for y in range(0, 24, band)]
    out = oi.stencil(spark.createDataFrame(rows, oi.BANDS), lambda a: im.gaussian(a, 0.7), 3, (24 - 1) // band)
    got = np.concatenate([np.frombuffer(r["data"], "<f4").reshape(-1, 10) for r in out.orderBy("row_start").collect()])
    assert np.allclose(got, im.gaussian(image.astype(np.float32), 0.7), atol=1e-5)


def test_stages(spark, tmp_path):
    from skyloom.sources.stages import Stages

    calls = []

    def make():
        calls.append(1)
        return spark.range(5)

    folder = str(tmp_path / "w")
    assert Stages(spark, folder, {"a": 1}).run("one", make).count() == 5
    assert Stages(spark, folder, {"a": 1}).run("one", make).count() == 5 and len(calls) == 1
    assert Stages(spark, folder, {"a": 2}).run("one", make).count() == 5 and len(calls) == 2


def test_running_mean(spark, tmp_path):
    from skyloom.streaming.running import running_mean

    spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,cast(id as int)) ts, id % 2 cell, cast(id as double) v, 1.0D w from range(100)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, cell long, v double, w double").parquet(str(tmp_path / "in"))
    q = running_mean(stream).writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["value"] for r in spark.sql("select * from means where n > 0").groupBy("cell").agg({"value": "avg"}).withColumnRenamed("avg(value)", "value").collect())


def test_register_end_to_end(spark):
    f, shifts, rows = field(), [(0, 0), (3.2, -1.7), (-2.4, 2.9)], []
    for k, (dx, dy) in enumerate(shifts):
        moved = f + np.array([dx, dy, 0])
        image = scene(moved, seed=10 + k)
        rows += [(k, 0, y // 40, y, 40, 200, bytes(image[y : y + 40].astype("<f4").tobytes())) for y in range(0, 160, 40)]
    bands = spark.createDataFrame(rows, oi.BANDS)
    stars = oi.detect_stars(bands)
    al = oi.align_frames(stars, 0)
    got = {r["frame"]: r["matrix"] for r in al.collect()}
    assert abs(got[1][2] + 3.2) < 0.3 and abs(got[2][5] + 2.9) < 0.3
    out = oi.stack_bands(oi.register(bands, al, 160, 200, 40), "median").orderBy("row_start").collect()
    master = np.concatenate([np.frombuffer(r["data"], "<f4").reshape(-1, 200) for r in out])
    assert np.corrcoef(master[20:140, 20:180].ravel(), scene(f)[20:140, 20:180].ravel())[0, 1] > 0.97


def bands_of(spark, planes, rows=7):
    """Frames (frame, c, y, x) as bands."""
    out = [(f, c, y // rows, y, len(p[y : y + rows]), p.shape[1], bytes(p[y : y + rows].astype("<f4").tobytes())) for f, frame in enumerate(planes) for c, p in enumerate(frame) for y in range(0, p.shape[0], rows)]
    return spark.createDataFrame(out, oi.BANDS)


def planes_of(bands):
    found = {}
    for r in sorted(bands.collect(), key=lambda r: r["row_start"]):
        found.setdefault((r["frame"], r["c"]), []).append(np.frombuffer(r["data"], "<f4").reshape(r["n_rows"], r["width"]))
    return {k: np.concatenate(v) for k, v in found.items()}


def test_calibrate_bands(spark):
    """Counts and unit-range masters give the same; the bias stands in for a dark; a flat of one channel serves three."""
    r = np.random.default_rng(0)
    light = r.normal(3000, 5, (2, 3, 20, 12))
    dark, bias, flat = np.full((1, 1, 20, 12), 2800.0), np.full((1, 1, 20, 12), 100.0), r.uniform(20_000, 40_000, (1, 1, 20, 12))
    lights, one = bands_of(spark, light), lambda x, rows=20: bands_of(spark, x, rows)
    gain = (flat[0, 0] - 100) / np.sort((flat[0, 0] - 100).ravel())[(flat[0, 0].size - 1) // 2]
    got = planes_of(oi.calibrate_bands(lights, one(dark), one(bias), one(flat)))
    scaled = planes_of(oi.calibrate_bands(lights, one(dark / 65535), one(bias / 65535, 9), one(flat)))
    for k, p in got.items():
        want = np.maximum((light[k[0], k[1]] - 2800) / gain + 200, 0)
        assert np.allclose(p, want, rtol=1e-4, atol=0.05) and np.allclose(scaled[k], want, rtol=1e-4, atol=0.05)
    assert np.allclose(planes_of(oi.calibrate_bands(lights, bias=one(bias), pedestal=7.0))[0, 0], light[0, 0] - 93, atol=0.01)
    unit = bands_of(spark, light / 65535)
    assert np.allclose(planes_of(oi.calibrate_bands(unit, one(dark)))[1, 2], (light[1, 2] - 2600) / 65535, atol=1e-5)
    assert oi.calibrate_bands(lights.limit(0), one(dark)).collect() == []
    with pytest.raises(ValueError, match="channels"):
        oi.like(np.zeros((2, 3, 3)), False, False, 3)


def test_cosmetic_and_prepare(spark):
    image = np.random.default_rng(1).normal(500, 10, (40, 44))
    image[9, 9], image[20, 30] = 9000, 0
    image[30:33, 10:13] += 4000  # a star stays
    got, hot, cold = oi.cosmetic(image)
    assert abs(got[9, 9] - 500) < 60 and abs(got[20, 30] - 500) < 60 and hot >= 1 and cold >= 1 and got[31, 11] > 4000
    mosaic = np.tile([[100.0, 200.0], [200.0, 400.0]], (16, 16))
    mosaic[10, 10] = 60_000
    out = planes_of(oi.prepare_frames(bands_of(spark, [[mosaic]]), 9, hot_sigma=5.0, pattern="RGGB"))
    assert {k[1] for k in out} == {0, 1, 2} and np.allclose(out[0, 0], 100, atol=1) and np.allclose(out[0, 2], 400, atol=1)


def test_normalise_bands(spark):
    from skyloom.sources.stages import use_checkpoints

    use_checkpoints(spark)
    base = np.random.default_rng(2).normal(100, 5, (30, 20))
    other = base * 3 + 40
    other[0, 0] = np.nan
    out = planes_of(oi.normalise_bands(bands_of(spark, [[base], [other]]), 0))
    assert np.allclose(out[0, 0], base, atol=1e-3) and np.isnan(out[1, 0][0, 0]) and np.allclose(out[1, 0].ravel()[1:], base.ravel()[1:], atol=0.1)


def test_halo_rows_alone(spark):
    """Neighbours ship the rows that are asked for; results do not depend on the height of bands."""
    image = np.random.default_rng(3).normal(size=(31, 9))
    kernel = lambda a: im.gaussian(a, 0.8)
    whole = planes_of(oi.stencil(bands_of(spark, [[image]], 31), kernel, 4, 0))[0, 0]
    parts = bands_of(spark, [[image]], 8)
    assert np.allclose(planes_of(oi.stencil(parts, kernel, 4, 3))[0, 0][4:-4], whole[4:-4], atol=1e-5)
    assert {r["n_rows"] for r in oi.with_halo(parts, 2, 3).filter("band <> for_band").collect()} == {2}
