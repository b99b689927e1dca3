"""Many stacks at once: frames are grouped by header keys, and every group becomes one image."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import frames as fr
from ..sources import frames as sf
from . import stack as st

KEYS = ("OBJECT", "FILTER")
LOG = logging.getLogger(__name__)


@dataclasses.dataclass(frozen=True)
class Outcome:
    """What became of a group: the written image, or why there is none."""

    name: str
    label: str
    frames: int
    output: str | None = None
    error: str | None = None


def keyed(frames: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``frames`` (path, header) with a column k0, k1, ... for each key."""
    return frames.select("*", *[fc.group_value(k.strip().upper()).alias(f"k{i}") for i, k in enumerate(keys)])


def groups(frames: DataFrame, keys: tuple[str, ...] = KEYS, template: str = "") -> DataFrame:
    """(k0, k1, ..., frames, group_no, label, name) of ``keyed`` frames, in order of first appearance by path. The label
    reads KEY=value; the name of the image comes from ``template``, with {KEY} for values, or from all values. Of groups
    that would have one name (upper and lower case are one) all but the first get their number behind it, so that no image
    is written twice."""
    names = [f"k{i}" for i in range(len(keys))]
    found = fr.group_frames(frames, names, "path")
    parts = [fc.file_part(F.col(c)) for c in names]
    name = F.lit(template) if template else F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "_") if parts else F.lit("")
    for k, part in zip(keys, parts, strict=True):
        name = F.replace(name, F.lit("{" + k.strip().upper() + "}"), part)
    name = F.coalesce(F.nullif(fc.file_part(name), F.lit("")), F.lit("group"))
    label = F.array_join(F.array(*[F.concat(F.lit(f"{k.strip().upper()}="), F.col(c)) for k, c in zip(keys, names, strict=True)]), ", ") if names else F.lit("")
    told = found.withColumn("label", label).withColumn("name", name)
    place = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("group_no"))
    return told.withColumn("name", F.when(place > 1, F.concat("name", F.lit("_group"), F.col("group_no").cast("string"))).otherwise(F.col("name")))


def describe(groups_: DataFrame) -> DataFrame:
    """(group_no, line): what would be made of the frames."""
    label = F.when(F.col("label") == "", "(all)").otherwise(F.col("label"))
    return groups_.select("group_no", F.format_string("%s: %d frame(s) -> %s", label, F.col("frames"), F.col("name")).alias("line"))


def run(spark: SparkSession, path: str | list[str], folder: str, work: str, settings: st.StackSettings | None = None, keys: tuple[str, ...] = KEYS, template: str = "", least: int = 2, recursive: bool = True) -> list[Outcome]:
    """Every group of ``least`` frames or more as an image in ``folder``, one after another: a stack is a distributed
    job of its own, with stages of its own under ``work``, so a run that is started again takes up where it ended.
    A group that fails does not stop the others. The driver holds a row a group and the paths of one group."""
    settings = settings or st.StackSettings()
    os.makedirs(folder, exist_ok=True)
    keys = tuple(k.strip().upper() for k in keys if k.strip())
    names = [f"k{i}" for i in range(len(keys))]
    frames = keyed(sf.light_frames(spark, path, recursive), keys).select("path", *names).persist()  # headers are read once
    out = []
    for g in groups(frames, keys, template).orderBy("group_no").collect():
        if g["frames"] < least:
            out.append(Outcome(g["name"], g["label"], g["frames"], error=f"fewer than {least} frames"))
            continue
        mine = frames
        for c in names:
            mine = mine.filter(F.col(c) == F.lit(g[c]))
        target = os.path.join(folder, f"{g['name']}.fits")
        try:
            made = st.stack(spark, [r["path"] for r in mine.select("path").orderBy("path").collect()], f"{work.rstrip('/')}/{g['name']}", settings)
            st.write_results(made, target, settings)
            out.append(Outcome(g["name"], g["label"], g["frames"], target))
        except Exception as e:  # the group's own trouble: told with the outcome
            LOG.exception("group %s", g["label"])
            out.append(Outcome(g["name"], g["label"], g["frames"], error=f"{type(e).__name__}: {e}"))
    frames.unpersist()
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="skyloom-batch", description="An image for every group of frames.")
    p.add_argument("lights", nargs="+")
    p.add_argument("-o", "--output", required=True, help="folder of the images")
    p.add_argument("--work", required=True, help="folder of the stages, shared by all executors")
    p.add_argument("--group-by", default=",".join(KEYS), help="header keys, or NIGHT, FOLDER, SIZE")
    p.add_argument("--name", default="", help="template of the images' names, as {OBJECT}_{NIGHT}")
    p.add_argument("--least", type=int, default=2)
    p.add_argument("--show", action="store_true", help="only tell the groups")
    p.add_argument("--settings", type=json.loads, default={}, help="settings of the stacks as JSON")
    a = p.parse_args(argv)
    spark, keys = SparkSession.builder.appName("skyloom-batch").getOrCreate(), tuple(k.strip() for k in a.group_by.split(",") if k.strip())
    if a.show:
        for r in describe(groups(keyed(sf.light_frames(spark, a.lights, True), keys), keys, a.name)).orderBy("group_no").collect():
            print(r["line"])
        return
    for one in run(spark, a.lights, a.output, a.work, st.StackSettings(**a.settings), keys, a.name, a.least):
        print(json.dumps(dataclasses.asdict(one)))


if __name__ == "__main__":
    main()
