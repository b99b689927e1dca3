"""Batches: grouping keys and names against plain forms, and a run of several groups."""

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions import columns as fc
from skyloom.plans import batch
from skyloom.plans.stack import StackSettings
from skyloom.sources import frames as fs

from test_stacking import shifted_lights


def test_short_numbers(spark):
    values = [0.0, 1.0, 10.0, -2.5, 120.0, 0.001, 0.0001, 0.00001234, 1234567.0, 123456.0, 999999.7, 1e-7, 3.14159265, 1e21]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", fc.short_number(F.col("v")).alias("s")).collect()
    assert {r["k"]: r["s"] for r in rows} == {k: f"{v:g}" for k, v in enumerate(values)}


def test_group_values(spark):
    headers = [
        {"OBJECT": " M 31 ", "EXPTIME": "10.0", "GAIN": "100", "DATE-OBS": "2024-05-02T03:00:00.5Z", "NAXIS1": "8", "NAXIS2": "6", "DATE": "2020-01-01"},
        {"OBJECT": "", "DATE-OBS": "some time ago", "EXPTIME": "1.50e1"}, {"DATE": "2024-05-02T13:00:00"}, {"DATE-OBS": "", "DATE": "2024-01-01T01:00:00"},
    ]
    rows = spark.createDataFrame([(f"file:/a/night {k}/x.fits", h) for k, h in enumerate(headers)], "path string, header map<string,string>")
    keys = ("OBJECT", "exptime", "GAIN", "NIGHT", "FOLDER", "SIZE")
    got = [tuple(r[f"k{i}"] for i in range(6)) for r in batch.keyed(rows, keys).orderBy("path").collect()]
    assert got == [
        ("M 31", "10", "100", "2024-05-01", "night 0", "8x6"), ("UNKNOWN", "15", "UNKNOWN", "some time ", "night 1", "?x?"),
        ("UNKNOWN", "UNKNOWN", "UNKNOWN", "2024-05-02", "night 2", "?x?"), ("UNKNOWN", "UNKNOWN", "UNKNOWN", "2023-12-31", "night 3", "?x?"),
    ]


def test_names_do_not_meet(spark):
    """Different values with one slug, in either case, are different images; order is that of first appearance."""
    objects = ["M 31", "m_31", "M/31", "M31", "??", ""]
    rows = spark.createDataFrame([(f"f{k}", {"OBJECT": o}) for k, o in enumerate(objects)], "path string, header map<string,string>")
    out = batch.groups(batch.keyed(rows, ("OBJECT",)), ("OBJECT",)).orderBy("group_no").collect()
    assert [r["name"] for r in out] == ["M_31", "m_31_group2", "M31", "M31_group4", "group", "UNKNOWN"]
    assert len({r["name"].lower() for r in out}) == 6 and out[0]["label"] == "OBJECT=M 31"
    named = batch.groups(batch.keyed(rows, ("OBJECT",)), ("OBJECT",), "stack-{OBJECT}").orderBy("group_no").collect()
    assert named[0]["name"] == "stack-M_31"
    every = batch.groups(batch.keyed(rows, ()), ()).collect()
    assert [(r["frames"], r["name"], r["label"]) for r in every] == [(6, "group", "")]
    assert [r["line"] for r in batch.describe(batch.groups(batch.keyed(rows, ()), ())).collect()] == ["(all): 6 frame(s) -> group"]
    assert batch.groups(batch.keyed(rows.limit(0), ("OBJECT",)), ("OBJECT",)).count() == 0


def test_run_of_groups(spark, tmp_path):
    """Two groups become images of their own frames, a group of one is left out, a group without stars fails alone."""
    _, lights = shifted_lights([(0, 0), (3.2, -1.7), (-2.4, 2.9)])
    blank = [np.full((64, 64), 7.0)] * 2
    for folder, images, header in (("a", lights, {"OBJECT": "M 31", "FILTER": "L"}), ("b", blank, {"OBJECT": "dark sky", "FILTER": "L"}), ("c", [2 * x for x in lights], {"OBJECT": "M 31", "FILTER": "R"}), ("d", lights[:1], {"OBJECT": "M 33"})):
        (tmp_path / "in" / folder).mkdir(parents=True)
        for k, image in enumerate(images):
            fs.write_fits(str(tmp_path / "in" / folder / f"{k}.fits"), image, {"EXPTIME": 10.0} | header, mark=False)
    settings = StackSettings(method="none", weighting="none", filters=False)
    out = batch.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), f"file://{tmp_path}/work", settings)
    assert [(o.name, o.frames) for o in out] == [("M_31_L", 3), ("dark_sky_L", 2), ("M_31_R", 3), ("M_33_UNKNOWN", 1)]
    assert out[0].output and out[2].output and not out[1].output and out[1].error and out[3].error == "fewer than 2 frames"
    images = [fs.parse(o.output, open(o.output, "rb").read())[0] for o in (out[0], out[2])]
    assert images[0].shape == images[1].shape
    inner = np.s_[..., 20:-20, 20:-20]
    assert np.nanmedian(images[1][inner] / images[0][inner]) > 1.9
    assert abs(np.nanmedian(images[0][inner]) - 300) < 15
