"""Mosaics: world coordinates, photometry and blending, on tiles of a known sky."""

import dataclasses

import numpy as np
import pytest

from skyloom.functions import wcs
from skyloom.plans import mosaic as mo
from skyloom.sources import frames as fs

STEP = 2 / 3600


def sky_projection(crpix, **more):
    return wcs.Projection((crpix[0] - 1, crpix[1] - 1), (37.9, 61.7), ((-STEP, 0.0), (0.0, STEP)), **more)


BENT = {(2, 0): (2e-5, -1e-5), (1, 1): (1e-5, 3e-5), (0, 2): (-2e-5, 1e-5), (3, 0): (4e-9, 0.0), (0, 3): (0.0, -5e-9)}


def test_round_trip_with_distortion():
    p = sky_projection((300.0, 200.0), forward=BENT)
    x, y = np.meshgrid(np.linspace(0, 599, 25), np.linspace(0, 419, 25))
    gx, gy = p.to_pixel(*p.to_sky(x, y))
    assert np.abs(gx - x).max() < 1e-6 and np.abs(gy - y).max() < 1e-6
    straight = dataclasses.replace(p, forward=None)
    assert np.abs(straight.to_sky(x, y)[0] - p.to_sky(x, y)[0]).max() > STEP  # it does bend
    whole = wcs.with_inverse(p, 420, 600)
    read = wcs.projection_of({k: str(v) for k, v in whole.cards().items()})
    assert np.allclose(read.to_sky(x, y), p.to_sky(x, y), atol=1e-10)
    # the fitted inverse alone is good to a hundredth of a pixel
    u, v = np.array(x - read.crpix[0]), np.array(y - read.crpix[1])
    du, dv = wcs.bend(read.forward, u, v)
    bu, bv = wcs.bend(read.back, u + du, v + dv)
    assert np.abs(du + bu).max() < 0.02 and np.abs(dv + bv).max() < 0.02


def test_forms_of_the_matrix_and_odd_headers():
    base = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": "10.5", "CRVAL2": "-20", "CRPIX1": "5", "CRPIX2": "6"}
    turned = wcs.projection_of(base | {"CDELT1": "-0.001", "CDELT2": "0.001", "CROTA2": "30"})
    c, s = np.cos(np.radians(30)), np.sin(np.radians(30))
    assert np.allclose(turned.cd, [[-0.001 * c, -0.001 * s], [-0.001 * s, 0.001 * c]])
    by_pc = wcs.projection_of(base | {"CDELT1": "-0.001", "CDELT2": "0.001", "PC1_1": str(c), "PC1_2": str(s), "PC2_1": str(-s), "PC2_2": str(c)})
    assert np.allclose(by_pc.cd, turned.cd)
    assert wcs.projection_of(base) is None and wcs.projection_of({}) is None
    assert wcs.projection_of(base | {"CD1_1": "0", "CD2_2": "0"}) is None
    assert wcs.projection_of(base | {"CD1_1": "nonsense", "CD2_2": "0.1"}) is None
    with pytest.raises(ValueError, match="SIN"):
        wcs.projection_of(base | {"CTYPE1": "RA---SIN"})
    far = turned.to_pixel(np.array([190.5]), np.array([20.0]))
    assert np.isnan(far[0]).all()


def make_sky(height=420, width=1000):
    r = np.random.default_rng(3)
    y, x = np.mgrid[:height, :width].astype(float)
    sky = 300 + 120 * np.exp(-(((x - 520) / 180) ** 2 + ((y - 200) / 90) ** 2))
    for sx, sy, a in zip(r.uniform(10, width - 10, 300), r.uniform(10, height - 10, 300), r.uniform(200, 8000, 300), strict=True):
        box = np.s_[int(max(0, sy - 12)) : int(sy + 13), int(max(0, sx - 12)) : int(sx + 13)]
        sky[box] += a * np.exp(-((x[box] - sx) ** 2 + (y[box] - sy) ** 2) / (2 * 1.4**2))
    return sky


@pytest.fixture(scope="module")
def two_tiles(tmp_path_factory):
    folder, r, sky = tmp_path_factory.mktemp("tiles"), np.random.default_rng(7), make_sky()
    y, x = np.mgrid[:420, :600].astype(float)
    a = sky[:, :600] + 0.03 * x + 0.02 * y + r.normal(0, 3, x.shape)
    b = 1.25 * sky[:, 400:] + 40 - 0.05 * x + 0.04 * y + r.normal(0, 3, x.shape)
    for name, data, left in (("a", a, 0), ("b", b, 400)):
        fs.write_fits(str(folder / f"tile_{name}.fits"), data, {"OBJECT": "made"} | sky_projection((500.0 - left, 200.0)).cards(), mark=False)
    fs.write_fits(str(folder / "z_unsolved.fits"), a, {"OBJECT": "no place"}, mark=False)
    return folder, sky


BASE = mo.MosaicSettings(gradient=1, gradient_block=32, feather=60.0, side=256)


def region_of(out, sky):
    x, y = out.projection.to_pixel(*sky_projection((500.0, 200.0)).to_sky(np.array([0.0]), np.array([0.0])))
    assert abs(x[0] - round(x[0])) < 0.3 and abs(y[0] - round(y[0])) < 0.3
    image = mo.image_of(out.image, "data", "<f4", out.grid.height, out.grid.width)[0]
    cover = mo.image_of(out.image, "coverage", "<u2", out.grid.height, out.grid.width)[0]
    x, y = int(round(x[0])), int(round(y[0]))
    cut = np.s_[max(0, y) : y + sky.shape[0], max(0, x) : x + sky.shape[1]]
    return image[cut], cover[cut]


def test_two_tiles_without_a_seam(spark, two_tiles, tmp_path):
    folder, sky = two_tiles
    out = mo.mosaic(spark, str(folder), str(tmp_path / "w"), BASE)
    assert out.tiles.count() == 2
    region, cover = region_of(out, sky)
    h, w = region.shape
    assert abs(h - sky.shape[0]) <= 2 and abs(w - sky.shape[1]) <= 2 and cover[20:-20, 20:-20].min() >= 1 and cover.max() == 2
    diff, faint = (region - sky[:h, :w])[30:-30, 30:-30], sky[:h, :w][30:-30, 30:-30] < 460
    assert np.std(diff[faint] - np.median(diff[faint])) < 8
    columns = np.array([np.median(diff[:, c : c + 20][faint[:, c : c + 20]]) for c in range(0, diff.shape[1] - 20, 20)])
    assert len(columns) > 20 and np.abs(np.diff(columns)).max() < 2
    gains = {p["tile"]: p["gain"] for p in out.photometry}
    assert gains[0] == 1 and gains[1] == pytest.approx(0.8, rel=0.05)
    cards = mo.write_mosaic(out, str(tmp_path / "m.fits"))
    data, header = fs.parse_fits((tmp_path / "m.fits").read_bytes())
    assert cards["MOSTILES"] == 2 and wcs.projection_of(header).scale() == pytest.approx(2.0, rel=1e-3) and data.shape == (out.grid.height, out.grid.width)


def test_squares_of_any_size_give_the_same(spark, two_tiles, tmp_path):
    folder, sky = two_tiles
    images = [mo.image_of(o.image, "data", "<f4", o.grid.height, o.grid.width) for o in (mo.mosaic(spark, str(folder), str(tmp_path / f"{side}"), dataclasses.replace(BASE, side=side)) for side in (128, 2048))]
    assert np.allclose(*images, atol=0.05)


def test_photometry_recovers_gain_offset_and_plane(spark):
    from skyloom.sources.stages import use_checkpoints

    use_checkpoints(spark)
    r = np.random.default_rng(4)
    truth = {0: (1, 0, 0, 0), 1: (1.25, 40, 6, -3), 2: (0.8, -15, -2, 5)}
    rows = []
    for i, j in ((0, 1), (1, 2), (0, 2)):
        for _ in range(150):
            v, x, y = r.uniform(200, 900), *r.uniform(-1, 1, 2).tolist()
            seen = [(v - truth[t][1] - truth[t][2] * x - truth[t][3] * y) / truth[t][0] + r.normal(0, 0.05) for t in (i, j)]
            rows.append((0, i, j, *map(float, seen), float(x), float(y)))
        rows += [(0, i, j, 500.0, 800.0, 0.0, 0.0)] * 9  # what only one of them saw
    got = {p["tile"]: p for p in mo.match_photometry(spark.createDataFrame(rows, mo.SAMPLES), [0, 1, 2, 9])}
    for t, (gain, offset, px, py) in truth.items():
        assert [got[t][k] for k in ("gain", "offset", "plane_x", "plane_y")] == pytest.approx([gain, offset, px, py], abs=0.8) and got[t]["gain"] == pytest.approx(gain, rel=2e-3)
    assert got[9]["gain"] == pytest.approx(1.0)  # without an overlap
    assert mo.match_photometry(spark.createDataFrame([], mo.SAMPLES), [3])[0]["gain"] == 1.0


def test_seam_keeps_detail_of_one_tile():
    s = dataclasses.replace(BASE, feather=20.0)
    v = np.stack([np.full((60, 80), 100.0), np.full((60, 80), 110.0)])
    v[0, :, 55:], v[1, :, :25] = np.nan, np.nan
    v[0, 30, 38], v[1, 30, 40] = 900, 900  # a star that the two place differently
    w = np.stack([mo.feather(np.isfinite(p), 20) for p in v])
    seam, soft = mo.composite(np.array([0, 1]), v, w, s), mo.composite(np.array([0, 1]), v, w, dataclasses.replace(s, blend="feather"))
    assert (soft[30, 36:43] > 300).sum() == 2 and np.abs(np.diff(seam[5])).max() < 2
    hard = mo.composite(np.array([0, 1]), v, w, dataclasses.replace(s, blend="hard"))
    assert set(np.unique(hard[5])) <= {100.0, 110.0}
