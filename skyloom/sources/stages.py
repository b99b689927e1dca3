"""Durable stages: a result is written once with a manifest and read back while its inputs and settings hold."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of some hundred bytes that are sent to every task; more are joined.
BROADCAST_ITEMS = 100_000


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder that the cluster names; a temporary one only where none is set."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='skyloom-')}")


def digest(settings: dict) -> str:
    """SHA-256 of the settings as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def fingerprint(spark: SparkSession, paths: list[str]) -> list[dict]:
    """Path, size and modification time of input files, through Spark's own file systems."""
    if not paths:
        return []
    rows = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime").orderBy("path").collect()
    return [{"path": r["path"], "size": r["length"], "changed": r["modificationTime"].isoformat()} for r in rows]


class Stages:
    """Named stages under one folder: ``run`` writes a stage unless a manifest of the same settings and inputs
    says that it is there."""

    VERSION = 1

    def __init__(self, spark: SparkSession, folder: str, settings: dict, inputs: list[dict] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.key = {"version": self.VERSION, "settings": digest(settings), "inputs": digest({"files": inputs or []})}

    def _manifest(self, name: str) -> str:
        return f"{self.folder}/{name}.manifest"

    def done(self, name: str) -> bool:
        try:
            rows = self.spark.read.json(self._manifest(name)).collect()
        except Exception as e:  # noqa: BLE001  no manifest yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return False
            raise
        return bool(rows) and {k: rows[0][k] for k in self.key} == self.key

    def run(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self.done(name):
            make().write.mode("overwrite").parquet(path)
            row = self.key | {"stage": name, "written": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
            self.spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(self._manifest(name))
        return self.spark.read.parquet(path)

    def each(self, name: str, items: DataFrame, settings: dict, make: Callable[[DataFrame], DataFrame], by: str = "path") -> DataFrame:
        """What ``make`` gives for ``items`` (``by``, size, changed), made anew only for items that are new or
        changed, or whose rows are not all there. ``make`` gets the items to do, and its rows name theirs in ``by``.

        A part is written with a list of its items and how many rows each has; an item is done if a list holds it
        with the same size, time and settings and its part has that many rows. Rows of items that are gone or have
        changed stay in the folder and are not read."""
        folder = f"{self.folder}/{name}"
        sign = F.sha2(F.concat_ws("|", F.lit(digest(settings)), F.col(by).cast("string"), F.col("size").cast("string"), F.col("changed").cast("string")), 256)
        wanted = items.select(by, sign.alias("item")).checkpoint(eager=True)
        todo = wanted
        lists = self._read(f"{folder}/lists")
        if lists is not None and self._read(f"{folder}/rows") is not None:
            there = self._read(f"{folder}/rows").groupBy("item", "part").agg(F.count("*").alias("found"))
            done = lists.join(there, ["item", "part"], "left").filter(F.coalesce("found", F.lit(0)) == F.col("n"))
            todo = wanted.join(done.select("item"), "item", "left_anti").select(by, "item").checkpoint(eager=True)
        if lists is None or todo.limit(1).count():
            part = f"p{uuid.uuid4().hex}"
            rows = make(todo)
            rows.join(F.broadcast(todo) if todo.count() <= BROADCAST_ITEMS else todo, by).write.mode("overwrite").parquet(f"{folder}/rows/part={part}")
            counts = self.spark.read.parquet(f"{folder}/rows/part={part}").groupBy("item").agg(F.count("*").alias("n"))
            todo.join(counts, "item", "left").select("item", F.coalesce("n", F.lit(0)).alias("n"), F.lit(part).alias("part")).write.mode("append").parquet(f"{folder}/lists")
            lists = self._read(f"{folder}/lists")
        # an item that was done twice is read from one part
        newest = lists.groupBy("item").agg(F.max("part").alias("part")) if lists.count() == lists.select("item").distinct().count() else self._whole(lists, folder)
        rows = self._read(f"{folder}/rows").drop(by)
        live = wanted.join(newest, "item")
        return rows.join(F.broadcast(live) if live.count() <= BROADCAST_ITEMS else live, ["item", "part"]).drop("item", "part")

    def _whole(self, lists: DataFrame, folder: str) -> DataFrame:
        """The part from which each item is read: one that has all its rows."""
        there = self._read(f"{folder}/rows").groupBy("item", "part").agg(F.count("*").alias("found"))
        return lists.join(there, ["item", "part"], "left").filter(F.coalesce("found", F.lit(0)) == F.col("n")).groupBy("item").agg(F.max("part").alias("part"))

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
