"""Contract queries: the operators on the driver's tables, each with SQL that gives the same rows.

Adapters: ``samples`` (lineitem: a cell a part, a sample a line, whole-number values and weights, so that sums are
exact in any order), ``frames`` (orders), ``patches`` (embeddings as 8x8 images) and ``points`` (customers and
suppliers in a plane).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions.studentt import critical
from ..operators import combine as co
from ..operators import compare as cm
from ..operators import frames as fr
from ..operators import grids as gr
from ..operators import matching as ma
from ..operators import reports as re_
from ..operators import stacking as sk
from . import batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# ---------------------------------------------------------------- samples


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("cell"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame"), F.col("l_quantity").alias("v"), F.round(100 * (1 - F.col("l_discount"))).alias("w"))


S = "s AS MATERIALIZED (SELECT l_partkey AS cell, l_orderkey * 10 + l_linenumber AS frame, l_quantity AS v, round(100 * (1 - l_discount)) AS w, 0 AS side FROM lineitem)"


def sigma_sql(rounds: int, k: float, winsorize: bool = False) -> str:
    """CTEs r1..rN: a round each."""
    out, last = [S], "s"
    for n in range(1, rounds + 1):
        a = "CASE WHEN side = 0 THEN v END"
        if winsorize:
            out.append(f"c{n} AS MATERIALIZED (SELECT cell, quantile_disc({a}, 0.5) AS m FROM {last} GROUP BY cell)")
            out.append(f"d{n} AS MATERIALIZED (SELECT x.cell, any_value(m) AS m, 1.4826 * quantile_disc(abs({a} - m), 0.5) AS sd FROM {last} x JOIN c{n} USING (cell) GROUP BY x.cell)")
            prev = f"d{n}"
            for t in range(3):
                p = "least(greatest(v, m - 1.5 * sd), m + 1.5 * sd)"
                out.append(f"e{n}{t} AS MATERIALIZED (SELECT x.cell, avg(CASE WHEN side = 0 THEN {p} END) AS m2, any_value(m) AS m, any_value(sd) AS sd FROM {last} x JOIN {prev} USING (cell) GROUP BY x.cell)")
                out.append(f"f{n}{t} AS MATERIALIZED (SELECT x.cell, any_value(m2) AS m, 1.134 * sqrt(sum(CASE WHEN side = 0 THEN ({p} - m2) * ({p} - m2) END) / (greatest(count({a}), 2) - 1)) AS sd FROM {last} x JOIN e{n}{t} USING (cell) GROUP BY x.cell)")
                prev = f"f{n}{t}"
            out.append(f"r{n} AS MATERIALIZED (SELECT cell, frame, v, w, CASE WHEN side <> 0 THEN side WHEN v - m < -{k} * greatest(sd, 1e-12) THEN -1 WHEN v - m > {k} * greatest(sd, 1e-12) THEN 1 ELSE 0 END AS side FROM {last} JOIN {prev} USING (cell))")
        else:
            out.append(f"c{n} AS MATERIALIZED (SELECT cell, quantile_disc({a}, 0.5) AS m FROM {last} GROUP BY cell)")
            out.append(f"d{n} AS MATERIALIZED (SELECT x.cell, any_value(m) AS m, sqrt(sum(CASE WHEN side = 0 THEN (v - m) * (v - m) END) / (greatest(count({a}), 2) - 1)) AS sd FROM {last} x JOIN c{n} USING (cell) GROUP BY x.cell)")
            out.append(f"r{n} AS MATERIALIZED (SELECT cell, frame, v, w, CASE WHEN side <> 0 THEN side WHEN v - m < -{k} * greatest(sd, 1e-12) THEN -1 WHEN v - m > {k} * greatest(sd, 1e-12) THEN 1 ELSE 0 END AS side FROM {last} JOIN d{n} USING (cell))")
        last = f"r{n}"
    return "WITH " + ", ".join(out)


MEAN = "coalesce(avg(CASE WHEN side = 0 THEN v END), quantile_disc(v, 0.5), 0)"
WEIGHTED = "coalesce(sum(CASE WHEN side = 0 THEN v * w END), 0) / greatest(coalesce(sum(CASE WHEN side = 0 THEN w END), 0), 1e-12)"
COUNTS = "count(v) AS n_present, count(CASE WHEN side = -1 THEN 1 END) AS n_low, count(CASE WHEN side = 1 THEN 1 END) AS n_high"


def combined(c: DataFrame) -> DataFrame:
    return c.select("cell", r6("value").alias("value"), "n_present", "n_low", "n_high")


@query("combine_mean", f"WITH {S} SELECT cell, round({MEAN}, 6) AS value, {COUNTS} FROM s GROUP BY cell")
def combine_mean(spark, sf):
    return combined(co.combine(samples(spark, sf), "none"))


@query("combine_median", f"WITH {S} SELECT cell, round(quantile_disc(v, 0.5), 6) AS value, {COUNTS} FROM s GROUP BY cell")
def combine_median(spark, sf):
    return combined(co.combine(samples(spark, sf), "median"))


@query("combine_sigma", sigma_sql(3, 1.5) + f" SELECT cell, round({MEAN}, 6) AS value, {COUNTS} FROM r3 GROUP BY cell")
def combine_sigma(spark, sf):
    return combined(co.combine(samples(spark, sf), "sigma", low=1.5, high=1.5, rounds=3))


@query("combine_sigma_weighted", sigma_sql(3, 1.5) + f" SELECT cell, round({WEIGHTED}, 6) AS value, {COUNTS} FROM r3 GROUP BY cell")
def combine_sigma_weighted(spark, sf):
    return combined(co.combine(samples(spark, sf), "sigma", weighted=True, low=1.5, high=1.5, rounds=3))


@query("combine_winsorized", sigma_sql(2, 1.7, True) + f" SELECT cell, round({MEAN}, 6) AS value, {COUNTS} FROM r2 GROUP BY cell")
def combine_winsorized(spark, sf):
    return combined(co.combine(samples(spark, sf), "winsorized", low=1.7, high=1.7, rounds=2))


@query("combine_percentile", f"""WITH {S}, c AS (SELECT cell, quantile_disc(v, 0.5) AS m FROM s GROUP BY cell),
    r AS (SELECT cell, v, w, CASE WHEN (v - m) / greatest(abs(m), 1e-6) < -0.5 THEN -1 WHEN (v - m) / greatest(abs(m), 1e-6) > 0.5 THEN 1 ELSE 0 END AS side FROM s JOIN c USING (cell))
    SELECT cell, round({MEAN}, 6) AS value, {COUNTS} FROM r GROUP BY cell""")
def combine_percentile(spark, sf):
    return combined(co.combine(samples(spark, sf), "percentile", low=0.5, high=0.5))


def gesd_sql(v: str, fraction: float = 0.3, alpha: float = 0.05, relax: float = 1.5, most: int = 400) -> str:
    """The test as a recursion over sorted samples, with the critical values of up to ``most`` samples left."""
    limits = ", ".join(f"({m}, CAST({critical(m, alpha)!r} AS DOUBLE))" for m in range(2, most))
    return f"""WITH RECURSIVE s0 AS MATERIALIZED (SELECT l_partkey AS cell, l_orderkey * 10 + l_linenumber AS frame, CAST({v} AS DOUBLE) AS v FROM lineitem),
    limits(m, bound) AS (VALUES {limits}),
    cells AS (SELECT cell, list_sort(list(v)) AS x, len(list(v)) AS n, greatest(1, least(count(*) - 3, CAST(floor(count(*) * {fraction}) AS BIGINT))) AS most FROM s0 GROUP BY cell),
    walk AS (
        SELECT cell, x, n, CASE WHEN n < 4 THEN 0 ELSE least(most, n - 2) END AS rounds, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS low, CAST(0 AS BIGINT) AS cut, CAST(0 AS BIGINT) AS cut_low FROM cells
        UNION ALL
        SELECT cell, x, n, rounds, i + 1, now_low, CASE WHEN far > bound THEN i + 1 ELSE cut END, CASE WHEN far > bound THEN now_low ELSE cut_low END
        FROM (
            SELECT *, CASE WHEN over >= under THEN low ELSE low + 1 END AS now_low, greatest(over, under) AS far
            FROM (
                SELECT *, (x[n - i + low] - list_avg(x[low + 1:n - i + low])) / greatest(list_stddev_samp(x[low + 1:n - i + low]), 1e-12) AS over,
                    (list_avg(x[low + 1:n - i + low]) - x[low + 1]) / greatest(list_stddev_samp(x[low + 1:n - i + low]), 1e-12) / {relax} AS under
                FROM walk WHERE i < rounds) a) b
        JOIN limits ON m = n - i - 1),
    ends AS (SELECT cell, any_value(x)[(any_value(n) + 1) // 2] AS middle, any_value(n) AS n, arg_max(cut, i) AS cut, arg_max(cut_low, i) AS cut_low FROM walk GROUP BY cell),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v, frame) AS place FROM s0),
    r AS (SELECT cell, v, CASE WHEN place <= cut_low OR place > n - (cut - cut_low) THEN CASE WHEN v < middle THEN -1 ELSE 1 END ELSE 0 END AS side FROM ranked JOIN ends USING (cell))
    SELECT cell, round({MEAN}, 6) AS value, {COUNTS} FROM r GROUP BY cell"""


@query("combine_gesd", gesd_sql("l_quantity"))
def combine_gesd(spark, sf):
    return combined(co.combine(samples(spark, sf), "gesd"))


@query("combine_gesd_tails", gesd_sql("CASE WHEN l_linenumber = 6 THEN l_quantity * 9 WHEN l_linenumber = 5 AND l_quantity > 30 THEN -6 * l_quantity ELSE l_quantity END"))
def combine_gesd_tails(spark, sf):
    """Samples with wild values on both sides."""
    line, v = F.col("frame") % 10, F.col("v")
    return combined(co.combine(samples(spark, sf).withColumn("v", F.when(line == 6, v * 9).when((line == 5) & (v > 30), -6 * v).otherwise(v)), "gesd"))


@query("coverage_map", sigma_sql(2, 1.5) + " SELECT cell, count(v) AS coverage, round(count(CASE WHEN side <> 0 THEN 1 END) / count(v), 6) AS rejection FROM r2 GROUP BY cell")
def coverage_map(spark, sf):
    c = co.coverage(co.combine(samples(spark, sf), "sigma", low=1.5, high=1.5, rounds=2))
    return c.select("cell", "coverage", r6("rejection").alias("rejection"))


@query("effective_frames", f"WITH {S} SELECT cell, round(coalesce(sum(w) * sum(w) / nullif(sum(w * w), 0), 0), 6) AS n_eff FROM s GROUP BY cell")
def effective_frames(spark, sf):
    return co.effective_frames(samples(spark, sf), ["cell"]).select("cell", r6("n_eff").alias("n_eff"))


@query("estimate_norm", f"""WITH {S}, m AS (SELECT cell, quantile_disc(v, 0.5) AS location FROM s GROUP BY cell)
    SELECT cell, any_value(location) AS location, round(greatest(1.4826 * quantile_disc(abs(v - location), 0.5), 1e-9), 6) AS sigma FROM s JOIN m USING (cell) GROUP BY cell""")
def estimate_norm(spark, sf):
    return co.estimate_norm(samples(spark, sf), ["cell"]).select("cell", "location", r6("sigma").alias("sigma"))


@query("apply_norm", f"""WITH {S}, m AS (SELECT cell, quantile_disc(v, 0.5) AS o FROM s GROUP BY cell)
    SELECT s.cell, s.frame, round((v - o) * 2 + 25, 6) AS v FROM s JOIN m USING (cell)""")
def apply_norm(spark, sf):
    s = samples(spark, sf).withColumnRenamed("frame", "line").withColumn("frame", F.col("cell"))
    norms = co.estimate_norm(s, ["frame"]).select("frame", F.col("location").alias("offset"), F.lit(2.0).alias("scale"))
    return co.normalise(s, norms, 25.0).select("cell", F.col("line").alias("frame"), r6("v").alias("v"))


def noise_sql(rounds: int) -> str:
    out, last = ["n0 AS MATERIALIZED (SELECT event_type, value AS a FROM events)"], "n0"
    for k in range(1, rounds + 1):
        out.append(f"m{k} AS MATERIALIZED (SELECT event_type, median(a) AS m FROM {last} GROUP BY event_type)")
        out.append(f"d{k} AS MATERIALIZED (SELECT x.event_type, any_value(m) AS m, 1.4826 * median(abs(a - m)) AS sd FROM {last} x JOIN m{k} USING (event_type) GROUP BY x.event_type)")
        out.append(f"n{k} AS MATERIALIZED (SELECT event_type, CASE WHEN abs(a - m) <= 3.0 * sd THEN a END AS a FROM {last} JOIN d{k} USING (event_type))")
        last = f"n{k}"
    return f"WITH {', '.join(out)}, z AS (SELECT event_type, median(a) AS m FROM {last} GROUP BY event_type) SELECT event_type, round(1.4826 * median(abs(a - m)), 6) AS noise FROM {last} JOIN z USING (event_type) GROUP BY event_type"


@query("stack_noise", noise_sql(3))
def stack_noise(spark, sf):
    return co.clipped_noise(table(spark, sf, "events"), ["event_type"], "value").select("event_type", r6("noise").alias("noise"))


# ---------------------------------------------------------------- frames


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as frames: stars and sky from the price, FWHM and noise from keys, exposure from the priority."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("frame"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("stars"),
        (F.col("o_custkey") % 97 + 10).cast("double").alias("sky"),
        ((F.col("o_orderkey") % 50 + 20) / 10).alias("fwhm"),
        ((F.col("o_custkey") % 13 + 1) / 2).alias("noise"),
        F.when(F.substring("o_orderpriority", 1, 1) != "5", F.substring("o_orderpriority", 1, 1).cast("double") * 60).alias("exposure"),
        F.col("o_orderpriority").alias("camera"),
        F.when(F.col("o_orderstatus") == "F", True).otherwise(False).alias("excluded"),
        ((F.col("o_custkey") % 40 + 60) / 100).alias("transparency"),
        F.col("o_orderdate").alias("stamp"),
    )


FR = """f AS MATERIALIZED (SELECT o_orderkey AS frame, CAST(floor(o_totalprice / 100) AS BIGINT) AS stars, CAST(o_custkey % 97 + 10 AS DOUBLE) AS sky,
    (o_orderkey % 50 + 20) / 10.0::DOUBLE AS fwhm, (o_custkey % 13 + 1) / 2.0::DOUBLE AS noise, CASE WHEN substr(o_orderpriority, 1, 1) <> '5' THEN CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) * 60 END AS exposure,
    o_orderpriority AS camera, o_orderstatus = 'F' AS excluded, (o_custkey % 40 + 60) / 100.0::DOUBLE AS transparency, o_orderdate AS stamp FROM orders)"""


@query("filter_frames", f"""WITH {FR}, g AS (SELECT exposure, median(stars) AS ms, median(sky) AS mk FROM f GROUP BY exposure HAVING count(*) >= 3),
    t AS (SELECT median(fwhm) AS mf, median(stars) AS ts, median(sky) AS tk FROM f),
    c AS (SELECT frame, nullif(concat_ws('; ', CASE WHEN stars < 0.5 * coalesce(ms, ts) THEN 'stars' END, CASE WHEN coalesce(mk, tk) > 0 AND sky > 1.5 * coalesce(mk, tk) THEN 'sky' END, CASE WHEN fwhm > 1.25 * mf THEN 'fwhm' END), '') AS said
          FROM f LEFT JOIN g ON f.exposure IS NOT DISTINCT FROM g.exposure, t)
    SELECT frame, 'filter: ' || said AS reason FROM c""")
def filter_frames(spark, sf):
    return fr.filter_frames(frames(spark, sf), 0.5, 1.5, 1.25).select("frame", "reason")


@query("filter_presets", f"""WITH {FR}, p(preset, smin, kmax, wmax) AS (VALUES ('Lenient', 0.3, 3.0, 2.0), ('Balanced', 0.5, 2.0, 1.5), ('Selective', 0.7, 1.5, 1.25)),
    g AS (SELECT exposure, median(stars) AS ms, median(sky) AS mk FROM f GROUP BY exposure HAVING count(*) >= 3), t AS (SELECT median(fwhm) AS mf FROM f)
    SELECT preset, count(*) FILTER (WHERE NOT (stars < smin * ms OR (mk > 0 AND sky > kmax * mk) OR fwhm > wmax * mf)) AS kept
    FROM f LEFT JOIN g ON f.exposure IS NOT DISTINCT FROM g.exposure, t, p GROUP BY preset""")
def filter_presets(spark, sf):
    f, out = frames(spark, sf), None
    for name in fr.PRESETS:
        one = fr.filter_frames(f, **fr.filter_preset(name)).agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("kept")).select(F.lit(name).alias("preset"), "kept")
        out = one if out is None else out.unionByName(one)
    return out


@query("filter_transparency", f"""WITH {FR}, a AS (SELECT *, transparency / median(transparency) OVER () AS t FROM f), b AS (SELECT *, t / median(t) OVER (PARTITION BY camera) AS u FROM a)
    SELECT frame, round(u, 6) AS transparency FROM b WHERE u >= 0.9""")
def filter_transparency(spark, sf):
    return fr.filter_transparency(frames(spark, sf), 0.9).select("frame", r6("transparency").alias("transparency"))


@query("relative_signal", f"""WITH {FR}, a AS (SELECT frame, exposure, (transparency / noise) * (transparency / noise) AS raw FROM f)
    SELECT frame, round(raw / median(raw) OVER (PARTITION BY exposure), 6) AS psfsw FROM a""")
def relative_signal(spark, sf):
    return fr.relative_signal(frames(spark, sf), ratio="transparency").select("frame", r6("psfsw").alias("psfsw"))


WEIGHTS = {
    "noise": "power(rn / greatest(noise, 1e-9), 2)",
    "fwhm": "power(rf / greatest(fwhm, 0.5), 2)",
    "both": "power(rn / greatest(noise, 1e-9), 2) * power(rf / greatest(fwhm, 0.5), 2)",
    "psfsnr": "power(transparency * rn / greatest(noise, 1e-9), 2)",
    "psfsw": "transparency * transparency / (noise * sky) / (pi() * power(0.5 * sqrt(ln(10) / ln(2)) * fwhm, 2))",
}
for _mode, _sql in WEIGHTS.items():
    QUERIES[f"weights_{_mode}"] = lambda spark, sf, m=_mode: fr.frame_weights(frames(spark, sf), m).select("frame", r6("weight").alias("weight"))
    ORACLES[f"weights_{_mode}"] = f"""WITH {FR}, m AS (SELECT median(noise) AS rn, median(fwhm) AS rf FROM f), w AS (SELECT frame, {_sql} AS w FROM f, m), t AS (SELECT median(w) AS mw FROM w)
        SELECT frame, round(least(greatest(w / mw, 0.05), 20.0), 6) AS weight FROM w, t"""


@query("sharpness_factors", f"""WITH {FR}, a AS (SELECT frame, camera, CASE WHEN camera LIKE '1%' THEN 2.0 ELSE 1.0 END AS scale, fwhm FROM f), m AS (SELECT camera, scale, median(fwhm * scale) AS own FROM a GROUP BY ALL HAVING count(*) >= 3), b AS (SELECT min(own) AS best FROM m)
    SELECT frame, round(least(1.0, power(best / own, 2)), 6) AS factor FROM a JOIN m USING (camera, scale), b""")
def sharpness_factors(spark, sf):
    f = frames(spark, sf).withColumn("scale", F.when(F.col("camera").startswith("1"), 2.0).otherwise(1.0))
    return fr.sharpness_factors(f).select("frame", r6("factor").alias("factor"))


@query("rank_references", f"""WITH {FR}, u AS (SELECT * FROM f WHERE NOT excluded AND exposure IS NOT NULL), b AS (SELECT median(stars) AS ms, median(noise / sqrt(exposure)) AS mn FROM u),
    s AS (SELECT frame, CASE WHEN stars < 0.8 * ms THEN 1 ELSE 0 END AS tier, fwhm * (1 + 0.1 * (noise / sqrt(exposure)) / greatest(mn, 1e-9)) AS score FROM u, b),
    r AS (SELECT frame, row_number() OVER (ORDER BY tier, score, frame) AS rank FROM s)
    SELECT f.frame, r.rank FROM f LEFT JOIN r USING (frame) WHERE f.exposure IS NOT NULL""")
def rank_references(spark, sf):
    return fr.rank_references(frames(spark, sf).filter("exposure is not null")).select("frame", F.col("rank").cast("long").alias("rank"))


@query("group_frames", f"""WITH {FR}, g AS (SELECT coalesce(strftime(stamp - INTERVAL 12 HOURS, '%Y-%m-%d'), 'UNKNOWN') AS night, coalesce(camera, 'UNKNOWN') AS camera, count(*) AS frames, min(frame) AS o FROM f GROUP BY ALL)
    SELECT night, camera, frames, row_number() OVER (ORDER BY o, night, camera) AS group_no FROM g""")
def group_frames(spark, sf):
    f = frames(spark, sf).withColumn("night", fc.night("stamp"))
    return fr.group_frames(f, ["night", "camera"], "frame").select("night", "camera", "frames", F.col("group_no").cast("long").alias("group_no"))


@query("stratified_sample", """WITH z AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), q AS (SELECT p_brand, n, n * 60.0::DOUBLE / sum(n) OVER () AS share FROM z),
    r AS (SELECT *, greatest(floor(share), 1) AS q0, row_number() OVER (ORDER BY share - floor(share) DESC, p_brand) AS k FROM q),
    t AS (SELECT *, CAST(least(n, q0 + CASE WHEN k <= 60 - sum(q0) OVER () THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM r),
    i AS (SELECT p.p_partkey, p.p_brand, row_number() OVER (PARTITION BY p.p_brand ORDER BY p.p_partkey) - 1 AS i, t.n, t.quota FROM part p JOIN t USING (p_brand))
    SELECT p_partkey, p_brand FROM i WHERE EXISTS (SELECT 1 FROM range(0, quota) x(j) WHERE i = ((2 * j + 1) * n) // (2 * quota))""")
def stratified_sample(spark, sf):
    return fr.stratified_sample(table(spark, sf, "part"), "p_brand", "p_partkey", 60).select("p_partkey", "p_brand")


@query("exposure_groups", f"WITH {FR} SELECT round(exposure, 2) AS exposure, count(*) AS frames, median(fwhm) AS fwhm FROM f GROUP BY 1")
def exposure_groups(spark, sf):
    f = frames(spark, sf).withColumn("exposure", fc.exposure_key("exposure"))
    return f.groupBy("exposure").agg(F.count("*").alias("frames"), F.median("fwhm").alias("fwhm"))


@query("slugs", r"SELECT p_partkey, regexp_replace(regexp_replace(trim(p_name), '\s+', '_', 'g'), '[^0-9A-Za-z_\-]', '', 'g') AS slug FROM part")
def slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fc.slug("p_name").alias("slug"))


@query("header_values", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 0 THEN round(206.264806 * 3.8 / TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 3) END AS scale FROM events")
def header_values(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("h"))
    e = e.withColumn("h", F.map_concat("h", F.create_map(F.lit("XPIXSZ"), F.lit("3.8"), F.lit("FOCALLEN"), F.col("h")["k"])))
    return e.select("event_id", fc.header_number("h", "missing", "k").alias("k"), fc.pixel_scale("h").alias("scale"))


@query("sexagesimal", "SELECT s_suppkey, round((s_suppkey % 24 + (s_suppkey % 60) / 60.0 + (s_suppkey % 7) / 3600.0) * 15, 9) AS ra, round(-(s_suppkey % 89 + 1 + (s_suppkey % 60) / 60.0), 9) AS dec FROM supplier")
def sexagesimal(spark, sf):
    s = table(spark, sf, "supplier")
    n = F.col("s_suppkey")
    return s.select("s_suppkey", F.round(fc.sexagesimal(F.concat_ws(" ", (n % 24).cast("string"), (n % 60).cast("string"), (n % 7).cast("string")), True), 9).alias("ra"), F.round(fc.sexagesimal(F.concat(F.lit("-"), (n % 89 + 1).cast("string"), F.lit(":"), (n % 60).cast("string"))), 9).alias("dec"))


# ---------------------------------------------------------------- points


def points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation"), (F.col("c_custkey") % 50).cast("double").alias("x"), F.floor(F.col("c_acctbal") / 100).cast("double").alias("y"), F.col("c_acctbal").alias("flux"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("nation"), (F.col("s_suppkey") % 50).cast("double").alias("x"), F.floor(F.col("s_acctbal") / 100).cast("double").alias("y"))
    return c, s


PT = """c AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS nation, CAST(c_custkey % 50 AS DOUBLE) AS x, floor(c_acctbal / 100) AS y, c_acctbal AS flux FROM customer),
    s AS (SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS nation, CAST(s_suppkey % 50 AS DOUBLE) AS x, floor(s_acctbal / 100) AS y FROM supplier),
    p AS MATERIALIZED (SELECT c.nation, c.id AS l_id, s.id AS r_id, power(c.x - s.x, 2) + power(c.y - s.y, 2) AS d2 FROM c JOIN s ON c.nation = s.nation AND power(c.x - s.x, 2) + power(c.y - s.y, 2) < 225)"""


@query("points_within", f"WITH {PT} SELECT nation, l_id, r_id, d2 FROM p")
def points_within(spark, sf):
    return ma.within(*points(spark, sf), 15.0, "nation").withColumnRenamed("g", "nation")


@query("points_nearest", f"WITH {PT} SELECT nation, l_id, r_id, d2 FROM p QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY d2, r_id) = 1")
def points_nearest(spark, sf):
    return ma.nearest(*points(spark, sf), 15.0, "nation").withColumnRenamed("g", "nation")


@query("points_mutual", f"WITH {PT} SELECT nation, l_id, r_id, d2 FROM p QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY d2, r_id) = 1 AND row_number() OVER (PARTITION BY r_id ORDER BY d2, l_id) = 1")
def points_mutual(spark, sf):
    return ma.mutual_nearest(*points(spark, sf), 15.0, "nation").withColumnRenamed("g", "nation")


@query("points_greedy", f"""WITH RECURSIVE {PT}, o AS (SELECT nation, l_id, r_id, d2, row_number() OVER (PARTITION BY nation ORDER BY d2, l_id, r_id) AS k FROM p),
    walk AS (
        SELECT nation, k, l_id, r_id, d2, true AS take, [l_id] AS used_l, [r_id] AS used_r FROM o WHERE k = 1
        UNION ALL
        SELECT o.nation, o.k, o.l_id, o.r_id, o.d2, free, CASE WHEN free THEN list_append(used_l, o.l_id) ELSE used_l END, CASE WHEN free THEN list_append(used_r, o.r_id) ELSE used_r END
        FROM walk w JOIN o ON o.nation = w.nation AND o.k = w.k + 1, LATERAL (SELECT NOT list_contains(w.used_l, o.l_id) AND NOT list_contains(w.used_r, o.r_id) AS free) f)
    SELECT nation, l_id, r_id, round(d2, 6) AS d2 FROM walk WHERE take""")
def points_greedy(spark, sf):
    return ma.greedy_pairs(*points(spark, sf), 15.0, "nation").select(F.col("g").alias("nation"), "l_id", "r_id", r6("d2").alias("d2"))


@query("points_unmatched", f"WITH {PT} SELECT id, nation FROM c WHERE id NOT IN (SELECT l_id FROM p)")
def points_unmatched(spark, sf):
    return ma.unmatched(*points(spark, sf), 15.0, "nation").select("id", "nation")


@query("points_isolated", f"WITH {PT} SELECT a.id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.id <> b.id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) < 9)")
def points_isolated(spark, sf):
    return ma.isolated(points(spark, sf)[1], 3.0).select("id")


@query("points_brightest", f"WITH {PT} SELECT nation, id, flux FROM c QUALIFY row_number() OVER (PARTITION BY nation ORDER BY flux DESC, id) <= 5")
def points_brightest(spark, sf):
    return ma.brightest(points(spark, sf)[0], 5, "nation").select("nation", "id", "flux")


@query("transparency", """WITH f AS (SELECT l_suppkey AS frame, l_partkey AS id, sum(l_quantity) AS flux FROM lineitem GROUP BY ALL), r AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS ref FROM part)
    SELECT frame, round(CASE WHEN count(*) >= 12 THEN median(flux / ref) END, 6) AS transparency, count(*) AS stars FROM f JOIN r USING (id) WHERE flux > 0 AND ref > 0 GROUP BY frame""")
def transparency(spark, sf):
    f = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("frame"), F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("flux"))
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("flux"))
    return ma.transparency(f, r).select("frame", r6("transparency").alias("transparency"), "stars")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(n.alias("id"), (n * 937 % 9000).alias("x0"), (n * 613 % 7000).alias("y0")).select("id", "x0", "y0", (F.col("x0") + 900).alias("x1"), (F.col("y0") + 800).alias("y1"))


BX = "b AS (SELECT s_suppkey AS id, s_suppkey * 937 % 9000 AS x0, s_suppkey * 613 % 7000 AS y0, s_suppkey * 937 % 9000 + 900 AS x1, s_suppkey * 613 % 7000 + 800 AS y1 FROM supplier), e AS (SELECT a.id AS i, b.id AS j, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM b a JOIN b ON a.id < b.id WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) > 8 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 8)"


@query("tile_overlaps", f"WITH {BX} SELECT * FROM e")
def tile_overlaps(spark, sf):
    return ma.overlaps(boxes(spark, sf))


@query("tile_closure", f"""WITH RECURSIVE {BX}, u AS (SELECT i, j FROM e UNION SELECT j, i FROM e), t AS (SELECT i AS node, i AS root FROM u UNION SELECT u.j, t.root FROM t JOIN u ON u.i = t.node)
    SELECT node, min(root) AS root FROM t GROUP BY node""")
def tile_closure(spark, sf):
    return ma.tile_components(boxes(spark, sf))


# ---------------------------------------------------------------- patches


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 8x8 images of whole numbers."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("pos", "raw"))
    return e.select("frame", F.floor(F.col("pos") / 8).cast("long").alias("y"), (F.col("pos") % 8).cast("long").alias("x"), F.floor(F.col("raw").cast("double") * 1000).alias("v"))


PX = "p AS MATERIALIZED (SELECT vec_id AS frame, (i - 1) // 8 AS y, (i - 1) % 8 AS x, floor(CAST(embedding[i] AS DOUBLE) * 1000) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"
TAPS = "n AS MATERIALIZED (SELECT a.frame, a.y, a.x, a.v, dy, dx, b.v AS t FROM p a, (SELECT dy, dx FROM range(-1, 2) i(dy), range(-1, 2) j(dx)) o JOIN p b ON b.frame = a.frame AND b.y = CASE WHEN a.y + dy < 0 THEN 1 WHEN a.y + dy > 7 THEN 6 ELSE a.y + dy END AND b.x = CASE WHEN a.x + dx < 0 THEN 1 WHEN a.x + dx > 7 THEN 6 ELSE a.x + dx END)"


@query("block_stats", f"""WITH {PX}, m AS (SELECT frame, y // 4 AS by, x // 4 AS bx, quantile_disc(v, 0.5) AS location FROM p GROUP BY ALL)
    SELECT p.frame, m.by, m.bx, any_value(location) AS location, round(1.4826 * quantile_disc(abs(v - location), 0.5), 6) AS sigma, count(v) / count(*) AS fraction FROM p JOIN m ON m.frame = p.frame AND m.by = p.y // 4 AND m.bx = p.x // 4 GROUP BY p.frame, m.by, m.bx""")
def block_stats(spark, sf):
    return gr.block_stats(patches(spark, sf), 4).select("frame", "by", "bx", "location", r6("sigma").alias("sigma"), "fraction")


@query("block_medians", f"WITH {PX} SELECT frame, y // 4 AS by, x // 4 AS bx, median(v) AS median FROM p GROUP BY ALL")
def block_medians(spark, sf):
    return gr.block_medians(patches(spark, sf), 4)


@query("norm_maps", f"""WITH {PX}, m AS (SELECT frame, y // 4 AS by, x // 4 AS bx, quantile_disc(v, 0.5) AS location FROM p GROUP BY ALL), r AS (SELECT "by", bx, location AS ref FROM m WHERE frame = 0)
    SELECT frame, "by", bx, 2.0::DOUBLE AS scale, ref - 2.0 * location AS "offset" FROM m JOIN r USING ("by", bx)""")
def norm_maps(spark, sf):
    b = gr.block_stats(patches(spark, sf), 4)
    return gr.norm_maps(b, b.filter("frame = 0"), 2.0)


@query("bilinear_upsample", f"""WITH {PX}, q AS (SELECT y, x, least(greatest((y + 0.5) * 2 / 8 - 0.5, 0), 1) AS gy, least(greatest((x + 0.5) * 2 / 8 - 0.5, 0), 1) AS gx FROM range(0, 8) a(y), range(0, 8) b(x)),
    g AS (SELECT frame, y // 4 AS by, x // 4 AS bx, max(v) AS v FROM p GROUP BY ALL), c AS (SELECT frame, max(CASE WHEN "by" = 0 AND bx = 0 THEN v END) AS a, max(CASE WHEN "by" = 0 AND bx = 1 THEN v END) AS b, max(CASE WHEN "by" = 1 AND bx = 0 THEN v END) AS c, max(CASE WHEN "by" = 1 AND bx = 1 THEN v END) AS d FROM g GROUP BY frame)
    SELECT frame, y, x, round(a * (1 - gy) * (1 - gx) + b * (1 - gy) * gx + c * gy * (1 - gx) + d * gy * gx, 6) AS v FROM c, q""")
def bilinear_upsample(spark, sf):
    g = patches(spark, sf).groupBy("frame", F.floor(F.col("y") / 4).alias("by"), F.floor(F.col("x") / 4).alias("bx")).agg(F.max("v").alias("v"))
    return gr.bilinear_upsample(g, 8, 8, 2, 2).select("frame", "y", "x", r6("v").alias("v"))


@query("neighbour_stats", f"WITH {PX}, {TAPS} SELECT frame, y, x, v, list_sort(list(t))[4] AS median, max(t) AS most FROM n WHERE dy <> 0 OR dx <> 0 GROUP BY ALL")
def neighbour_stats(spark, sf):
    return gr.neighbour_stats(patches(spark, sf), 8, 8)


@query("hot_pixels", f"""WITH {PX}, {TAPS}, g AS (SELECT frame, y, x, v, list_sort(list(t))[4] AS m, max(t) AS h FROM n WHERE dy <> 0 OR dx <> 0 GROUP BY ALL)
    SELECT frame, y, x, CASE WHEN v - m > 100 AND h - m < 0.3 * (v - m) + 50 THEN m ELSE v END AS v, v - m > 100 AND h - m < 0.3 * (v - m) + 50 AS hot FROM g""")
def hot_pixels(spark, sf):
    p = patches(spark, sf)
    return gr.hot_pixels(p, 8, 8, p.select("frame").distinct().withColumn("sigma", F.lit(50.0)), 2.0)


def _mean(site: str) -> str:
    return f"sum(CASE WHEN {site} THEN t * k END) / sum(CASE WHEN {site} THEN k END)"


@query("debayer", f"""WITH {PX}, {TAPS}, k AS (SELECT *, (2 - abs(dy)) * (2 - abs(dx)) AS k, abs((y + dy) % 2) AS sy, abs((x + dx) % 2) AS sx FROM n)
    SELECT frame, y, x, round({_mean('sy = 0 AND sx = 0')}, 6) AS r, round({_mean('sy <> sx')}, 6) AS g, round({_mean('sy = 1 AND sx = 1')}, 6) AS b FROM k GROUP BY frame, y, x""")
def debayer(spark, sf):
    return gr.debayer_bilinear(patches(spark, sf), 8, 8, "RGGB").select("frame", "y", "x", r6("r").alias("r"), r6("g").alias("g"), r6("b").alias("b"))


@query("calibrate", f"WITH {PX}, d AS (SELECT y, x, v AS d FROM p WHERE frame = 0) SELECT frame, y, x, greatest(v - d + 200, 0) AS v FROM p JOIN d USING (y, x)")
def calibrate(spark, sf):
    p = patches(spark, sf)
    return gr.calibrate(p, dark=p.filter("frame = 0"), pedestal=200.0)


@query("luma", f"""WITH {PX} SELECT frame // 3 AS frame, y, x, round(CASE WHEN count(*) = 1 THEN max(v) ELSE sum(v * CASE frame % 3 WHEN 0 THEN 0.2126 WHEN 1 THEN 0.7152 ELSE 0.0722 END) END, 6) AS v FROM p GROUP BY ALL""")
def luma(spark, sf):
    p = patches(spark, sf).withColumn("c", F.col("frame") % 3).withColumn("frame", F.floor(F.col("frame") / 3))
    return gr.luma(p).select("frame", "y", "x", r6("v").alias("v"))


@query("drizzle", f"""WITH {PX}, s AS (SELECT CAST(floor((y + 0.5 + dy) * 2) AS BIGINT) AS oy, CAST(floor((x + 0.5 + dx) * 2) AS BIGINT) AS ox, v FROM p, (VALUES (-0.25), (0.25)) a(dy), (VALUES (-0.25), (0.25)) b(dx))
    SELECT oy, ox, round(sum(v * 0.25), 6) AS num, sum(0.25::DOUBLE) AS den FROM s GROUP BY oy, ox""")
def drizzle(spark, sf):
    drop = [(i, j, 0.25) for i in (-0.25, 0.25) for j in (-0.25, 0.25)]
    return gr.drizzle(patches(spark, sf).withColumn("w", F.lit(1.0)), 2.0, drop).select("oy", "ox", r6("num").alias("num"), "den")


@query("blend_weighted", f"WITH {PX} SELECT y, x, round(sum(v * (frame % 5 + 1)) / sum(frame % 5 + 1), 6) AS v, count(*) AS coverage FROM p GROUP BY y, x")
def blend_weighted(spark, sf):
    t = patches(spark, sf).withColumnRenamed("frame", "tile").withColumn("w", F.col("tile") % 5 + 1)
    return gr.blend(t).select("y", "x", r6("v").alias("v"), "coverage")


@query("blend_hard", f"WITH {PX} SELECT y, x, arg_max(v, (frame % 5 + 1) * 1000000 - frame) AS v, count(*) AS coverage FROM p GROUP BY y, x")
def blend_hard(spark, sf):
    return gr.blend(patches(spark, sf).withColumnRenamed("frame", "tile").withColumn("w", F.col("tile") % 5 + 1), hard=True)


@query("session_median", f"WITH {PX} SELECT y AS row, x AS col, median(v) AS fwhm FROM p GROUP BY y, x")
def session_median(spark, sf):
    return gr.session_median(patches(spark, sf).select("frame", F.col("y").alias("row"), F.col("x").alias("col"), F.col("v").alias("fwhm")))


@query("star_cells", """WITH s AS (SELECT l_suppkey AS frame, least(floor((l_orderkey % 100) * 4 / 100), 3) AS row, least(floor((l_partkey % 100) * 4 / 100), 3) AS col, l_quantity AS fwhm, 1 + l_discount AS elongation, l_tax * 10 AS theta FROM lineitem)
    SELECT frame, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, count(*) AS stars, CASE WHEN count(*) >= 8 THEN median(fwhm) END AS fwhm, CASE WHEN count(*) >= 8 THEN median(elongation) END AS elongation FROM s GROUP BY frame, row, col""")
def star_cells(spark, sf):
    l = table(spark, sf, "lineitem")
    s = l.select(F.col("l_suppkey").alias("frame"), (F.col("l_orderkey") % 100).alias("y"), (F.col("l_partkey") % 100).alias("x"), F.col("l_quantity").alias("fwhm"), (1 + F.col("l_discount")).alias("elongation"), (F.col("l_tax") * 10).alias("theta"))
    return gr.star_cells(s, 100, 100).select("frame", "row", "col", "stars", "fwhm", "elongation")


@query("dense_neighbourhood", f"""WITH {PX}, h AS (SELECT frame, y, x, CASE WHEN v > 100 THEN 1 ELSE 0 END AS hit FROM p),
    d AS (SELECT a.frame, a.y, a.x, a.hit, sum(b.hit) / count(*) > 0.3 AS dense FROM h a JOIN h b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
    SELECT a.frame, a.y, a.x, a.hit, bool_or(b.dense) AND a.hit = 0 AS extra FROM d a JOIN d b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.frame, a.y, a.x, a.hit""")
def dense_neighbourhood(spark, sf):
    h = patches(spark, sf).select("frame", "y", "x", F.when(F.col("v") > 100, 1).otherwise(0).alias("hit"))
    return co.dense_neighbourhood(h, 3, 0.3, 1)


@query("mapped_box", f"WITH {PX} SELECT frame, CAST(floor(min(v / 7)) AS BIGINT) AS x0, CAST(floor(min(v / 3)) AS BIGINT) AS y0, CAST(ceil(max(v / 7)) AS BIGINT) AS x1, CAST(ceil(max(v / 3)) AS BIGINT) AS y1 FROM p GROUP BY frame")
def mapped_box(spark, sf):
    return gr.mapped_box(patches(spark, sf).select("frame", (F.col("v") / 7).alias("x"), (F.col("v") / 3).alias("y")), ["frame"])


@query("lanczos_weights", "SELECT c_custkey, round(CASE WHEN abs(t) < 1e-8 THEN 1 WHEN abs(t) >= 3 THEN 0 ELSE sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) END, 6) AS w FROM (SELECT c_custkey, (c_custkey % 61 - 30) / 8.0::DOUBLE AS t FROM customer)")
def lanczos_weights(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", r6(F.when(F.col("c_custkey") % 61 == 30, 1.0).otherwise(fc.lanczos(F.when(F.col("c_custkey") % 61 == 30, 0.5).otherwise((F.col("c_custkey") % 61 - 30) / 8)))).alias("w"))


@query("durations", "SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s // 60 % 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS text FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS s FROM orders)")
def durations(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fc.duration_text(F.col("o_totalprice") / 10).alias("text"))


# ---------------------------------------------------------------- reports


@query("sharpest", f"WITH {FR} SELECT frame, fwhm FROM f ORDER BY fwhm, noise DESC, frame LIMIT 25")
def sharpest(spark, sf):
    return re_.sharpest(frames(spark, sf).withColumn("weight", F.col("noise")), 25).select("frame", "fwhm")


@query("choose_reference", f"""WITH {FR}, g AS (SELECT exposure, count(*) AS n FROM f GROUP BY exposure), m AS (SELECT exposure AS main FROM g ORDER BY coalesce(exposure, 0) * n DESC, exposure NULLS LAST LIMIT 1),
    u AS (SELECT f.* FROM f, m WHERE exposure = main), s AS (SELECT median(stars) AS ms, median(noise) AS mn FROM u), p AS (SELECT u.*, mn, stars / exposure AS light FROM u, s WHERE stars >= 0.8 * ms),
    t AS (SELECT quantile_cont(light, 0.9) AS top FROM p)
    SELECT frame, round(fwhm * (1 + 0.1 * noise / mn), 6) AS score FROM p, t WHERE light >= 0.9 * top ORDER BY fwhm * (1 + 0.1 * noise / mn), frame LIMIT 1""")
def choose_reference(spark, sf):
    f = frames(spark, sf).withColumn("light", F.col("stars").cast("double")).withColumn("scale", F.lit(1.0))
    return re_.choose_reference(f).select("frame", r6("score").alias("score"))


@query("flip_summary", f"WITH {FR} SELECT abs(frame % 360 - 180) > 90 AS flipped, count(*) AS frames, median(fwhm) AS fwhm, median(transparency) AS transparency FROM f GROUP BY 1")
def flip_summary(spark, sf):
    return re_.flip_summary(frames(spark, sf).withColumn("rotation", F.col("frame") % 360 - 180))


@query("regional_medians", """SELECT CAST(least(floor((l_orderkey % 100) * 4 / 100), 3) AS BIGINT) AS row, CAST(least(floor((l_partkey % 100) * 4 / 100), 3) AS BIGINT) AS col, count(*) AS n, median(l_quantity) AS median FROM lineitem GROUP BY 1, 2""")
def regional_medians(spark, sf):
    return re_.regional_medians(table(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).alias("y"), (F.col("l_partkey") % 100).alias("x"), F.col("l_quantity").alias("v")), 100, 100)


@query("field_factors", f"""WITH {PX}, v AS (SELECT frame, y AS row, x AS col, CASE WHEN v > 0 THEN v END AS fwhm, (y * 8 + x) AS stars FROM p), a AS (SELECT *, fwhm / median(fwhm) OVER (PARTITION BY frame) AS r FROM v),
    b AS (SELECT *, r / median(r) OVER (PARTITION BY row, col) AS q FROM a)
    SELECT frame, row, col, round(exp(ln(coalesce(CASE WHEN q IS NULL THEN 1.0 ELSE least(greatest(1 / (q * q), 0.5), 2.0) END, 1.0)) * stars / (stars + 16.0)), 6) AS factor FROM b""")
def field_factors(spark, sf):
    c = patches(spark, sf).select("frame", F.col("y").alias("row"), F.col("x").alias("col"), F.col("v").alias("fwhm"), (F.col("y") * 8 + F.col("x")).alias("stars"))
    return re_.field_factors(c).select("frame", "row", "col", r6("factor").alias("factor"))


@query("overlap_residuals", f"""WITH {PX}, b AS (SELECT frame // 2 AS i, frame // 2 + 1 AS j, y AS "by", x AS bx, max(CASE WHEN frame % 2 = 0 THEN v END) AS a, max(CASE WHEN frame % 2 = 1 THEN v END) AS b FROM p GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, a - b AS residual FROM b), m AS (SELECT *, abs(residual - median(residual) OVER (PARTITION BY i, j)) AS d FROM r), z AS (SELECT *, d / (1.4826 * median(d) OVER (PARTITION BY i, j) + 1e-9) AS z FROM m)
    SELECT i, j, "by", bx, residual, round(z, 6) AS z FROM z WHERE z >= 2.5 QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY z DESC, "by", bx) <= 8""")
def overlap_residuals(spark, sf):
    p = patches(spark, sf)
    b = p.groupBy(F.floor(F.col("frame") / 2).alias("i"), (F.floor(F.col("frame") / 2) + 1).alias("j"), F.col("y").alias("by"), F.col("x").alias("bx")).agg(F.max(F.when(F.col("frame") % 2 == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("frame") % 2 == 1, F.col("v"))).alias("b"))
    return re_.overlap_residuals(b, 2.5).select("i", "j", "by", "bx", "residual", r6("z").alias("z"))


@query("compare_catalogues", f"""WITH {PT}, n AS (SELECT l_id, r_id, nation FROM (SELECT c.nation, s.id AS l_id, c.id AS r_id, power(c.x - s.x, 2) + power(c.y - s.y, 2) AS d2 FROM c JOIN s ON c.nation = s.nation AND power(c.x - s.x, 2) + power(c.y - s.y, 2) < 225)
        QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY d2, r_id) = 1)
    SELECT nation, count(*) AS matched, round(median(CAST(r_id % 7 + 1 AS DOUBLE) / (l_id % 5 + 1)), 6) AS fwhm_ratio, CASE WHEN median(CAST(r_id % 7 + 1 AS DOUBLE) / (l_id % 5 + 1)) < 0.98 THEN 'sharper' WHEN median(CAST(r_id % 7 + 1 AS DOUBLE) / (l_id % 5 + 1)) > 1.02 THEN 'softer' ELSE 'alike' END AS verdict FROM n GROUP BY nation""")
def compare_catalogues(spark, sf):
    from ..operators import compare as cm

    c, s = points(spark, sf)
    star = lambda d, m: d.select("id", "nation", "x", "y", (F.col("id") % m + 1).cast("double").alias("fwhm"), F.lit(1.0).alias("flux"), F.lit(1.0).alias("elongation"))
    out = cm.compare(star(c, 7), star(s, 5), 15.0, "nation").withColumn("verdict", cm.verdict())
    return out.select(F.col("g").alias("nation"), "matched", r6("fwhm_ratio").alias("fwhm_ratio"), "verdict")


# ---------------------------------------------------------------- names, reports


@query("camera_labels", r"""WITH h AS (SELECT o_orderkey AS frame, CASE WHEN o_orderstatus <> 'P' THEN lower(trim(regexp_replace(' ' || o_orderpriority || '   CAM ', '\s+', ' ', 'g'))) END AS camera,
        CASE WHEN o_custkey % 3 > 0 THEN round(206.264806 * 3.8 / (o_custkey % 900 + 100), 3) END AS scale FROM orders)
    SELECT frame, coalesce(camera, 'unknown camera') || CASE WHEN scale > 0 THEN ', ' || regexp_replace(CAST(CAST(scale AS DOUBLE) AS VARCHAR), '\.0$', '') || '"/px' ELSE '' END AS label FROM h""")
def camera_labels(spark, sf):
    o = table(spark, sf, "orders")
    known, lens = F.col("o_orderstatus") != "P", F.col("o_custkey") % 3 > 0
    header = F.map_from_arrays(
        F.array(F.lit("INSTRUME"), F.lit("XPIXSZ"), F.lit("FOCALLEN")),
        F.array(F.when(known, F.concat(F.lit(" "), "o_orderpriority", F.lit("   CAM "))), F.lit("3.8"), F.when(lens, (F.col("o_custkey") % 900 + 100).cast("string"))),
    )
    return o.select(F.col("o_orderkey").alias("frame"), header.alias("h")).select("frame", fc.camera_label("h").alias("label"))


@query("batch_groups", r"""WITH k AS (SELECT o_orderkey, trim(o_orderpriority) AS priority, strftime(o_orderdate - INTERVAL 12 HOURS, '%Y-%m') AS month, CASE o_orderstatus WHEN 'P' THEN 'UNKNOWN' ELSE lower(o_orderstatus) || '.5' END AS filter FROM orders),
    g AS (SELECT priority, month, filter, count(*) AS frames, min(o_orderkey) AS first FROM k GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (ORDER BY first, priority, month, filter) AS group_no, regexp_replace(regexp_replace(priority, '\s+', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g') || '_' || filter AS name FROM g)
    SELECT group_no, frames, 'OBJECT=' || priority || ', DATE=' || month || ', FILTER=' || filter AS label, name || CASE WHEN row_number() OVER (PARTITION BY lower(name) ORDER BY group_no) > 1 THEN '_group' || group_no ELSE '' END AS name FROM n""")
def batch_groups(spark, sf):
    """Orders as files: their priority is the object, a month the date, the status the filter; names leave the date out."""
    header = F.create_map(F.lit("OBJECT"), F.col("o_orderpriority"), F.lit("DATE"), F.date_format(F.col("o_orderdate") - F.expr("INTERVAL 12 HOURS"), "yyyy-MM"), F.lit("FILTER"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lower("o_orderstatus"), F.lit(".5"))))
    files = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), header.alias("header"))
    keys = ("OBJECT", "DATE", "FILTER")
    return batch.groups(batch.keyed(files, keys), keys, "{OBJECT}_{FILTER}").select(F.col("group_no").cast("long").alias("group_no"), "frames", "label", "name")


@query("output_names", r"""SELECT p_partkey, regexp_replace(p_name, ' ', '.', 'g') AS path, regexp_replace(regexp_replace(p_name, ' ', '.', 'g') , '\.([^./]*)$', '') || '_test40' || regexp_extract(regexp_replace(p_name, ' ', '.', 'g'), '(\.[^./]*)$', 1) AS trial FROM part""")
def output_names(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.regexp_replace("p_name", " ", ".").alias("path"))
    return p.select("p_partkey", "path", fc.beside("path", F.lit("_test40")).alias("trial"))


@query("weighting_names", "SELECT event_id, CASE event_type WHEN 'click' THEN 'psfsnr' WHEN 'view' THEN 'psfsnr+fwhm' WHEN 'purchase' THEN 'psfsw' ELSE event_type END AS name FROM events")
def weighting_names(spark, sf):
    old = F.when(F.col("event_type") == "click", "psfsw").when(F.col("event_type") == "view", "psfsw+fwhm").when(F.col("event_type") == "purchase", "psfsw-pi").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", fc.current_weighting(old).alias("name"))


@query("byte_sizes", """SELECT o_orderkey, CASE WHEN b >= 1099511627776 THEN printf('%.1f TiB', b / 1099511627776.0) WHEN b >= 1073741824 THEN printf('%.1f GiB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MiB', b / 1048576.0)
        WHEN b >= 1024 THEN printf('%.1f KiB', b / 1024.0) ELSE printf('%.0f B', b::DOUBLE) END AS size
    FROM (SELECT o_orderkey, CAST((o_custkey * 2 + 1) * power(7, o_orderkey % 12) AS BIGINT) AS b FROM orders)""")
def byte_sizes(spark, sf):
    size = ((F.col("o_custkey") * 2 + 1) * F.pow(F.lit(7.0), F.col("o_orderkey") % 12)).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", fc.bytes_text(size).alias("size"))


@query("filter_signal", f"""WITH {FR}, a AS (SELECT frame, exposure, (transparency / noise) * (transparency / noise) AS raw FROM f),
    b AS (SELECT frame, raw / CASE WHEN count(raw) OVER (PARTITION BY round(exposure, 2)) >= 3 THEN median(raw) OVER (PARTITION BY round(exposure, 2)) END AS psfsw FROM a)
    SELECT frame, round(psfsw, 6) AS psfsw FROM b WHERE psfsw IS NULL OR psfsw >= 0.8""")
def filter_signal(spark, sf):
    f = fr.relative_signal(frames(spark, sf).withColumn("flux_ratio", F.col("transparency")))
    return fr.filter_signal(f, 0.8).select("frame", r6("psfsw").alias("psfsw"))


@query("signal_normalised", f"""WITH {FR} SELECT frame, round(CASE WHEN stars > 0 THEN power(transparency * stars, 2) / (transparency * noise * (transparency * sky + 5)) / (pi() * power(0.5 * {fc.TENTH_MAX!r} * fwhm, 2)) END, 6) AS signal FROM f""")
def signal_normalised(spark, sf):
    return frames(spark, sf).select("frame", r6(fc.psf_signal_normalised("stars", "fwhm", "noise", "sky", F.col("transparency"), F.lit(5.0))).alias("signal"))


@query("drizzle_image", f"""WITH {PX}, s AS (SELECT CAST(floor((y + 0.5 + dy) * 2) AS BIGINT) AS oy, CAST(floor((x + 0.5 + dx) * 2) AS BIGINT) AS ox, v, CASE WHEN y = 0 THEN 0.01 ELSE 1.0 END::DOUBLE * 0.25 AS k FROM p, (VALUES (-0.25), (0.25)) a(dy), (VALUES (-0.25), (0.25)) b(dx)),
    d AS (SELECT oy, ox, sum(v * k) AS num, sum(k) AS den FROM s GROUP BY oy, ox), t AS (SELECT median(den) * 0.1 AS t FROM d)
    SELECT oy, ox, round(CASE WHEN den >= t THEN num / den ELSE 0 END, 6) AS v FROM d, t""")
def drizzle_image(spark, sf):
    drop = [(i, j, 0.25) for i in (-0.25, 0.25) for j in (-0.25, 0.25)]
    sums = gr.drizzle(patches(spark, sf).withColumn("w", F.when(F.col("y") == 0, 0.01).otherwise(1.0)), 2.0, drop)
    return gr.drizzle_image(sums).select("oy", "ox", r6("v").alias("v"))


CELLS = """c AS MATERIALIZED (SELECT l_suppkey AS frame, l_orderkey % 4 AS row, l_partkey % 4 AS col, median(l_quantity) AS fwhm FROM lineitem GROUP BY 1, 2, 3)"""


@query("frame_scatter", f"""WITH {CELLS}, r AS (SELECT row, col, fwhm / median(fwhm) OVER (PARTITION BY frame) AS rel FROM c), e AS (SELECT stddev_pop(rel) AS s FROM r GROUP BY row, col)
    SELECT CASE WHEN (SELECT count(DISTINCT frame) FROM c) >= 3 THEN round(median(s), 6) END AS scatter FROM e""")
def frame_scatter(spark, sf):
    cells = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("frame"), (F.col("l_orderkey") % 4).alias("row"), (F.col("l_partkey") % 4).alias("col")).agg(F.median("l_quantity").alias("fwhm"))
    return gr.frame_scatter(cells).select(r6("scatter").alias("scatter"))


@query("sharpness_verdicts", f"""WITH {FR} SELECT frame, CASE WHEN fwhm / 4 < 0.98 THEN 'sharper' WHEN fwhm / 4 > 1.02 THEN 'softer' ELSE 'alike' END AS verdict FROM f""")
def sharpness_verdicts(spark, sf):
    return frames(spark, sf).withColumn("fwhm_ratio", F.col("fwhm") / 4).select("frame", cm.verdict().alias("verdict"))


@query("frame_report", f"WITH {FR} SELECT frame, stars, sky, round(fwhm, 3) AS fwhm, round(noise / 7, 4) AS noise, round(exposure, 2) AS exposure, round(transparency / 3, 4) AS transparency FROM f")
def frame_report(spark, sf):
    f = frames(spark, sf).select("frame", "stars", "sky", "fwhm", (F.col("noise") / 7).alias("noise"), "exposure", (F.col("transparency") / 3).alias("transparency"))
    return re_.frame_rows(f)


@query("gaussian_blur", f"""WITH {PX}, k AS (SELECT d, exp(-0.5 * power(d / 0.5, 2)) AS k FROM range(-2, 3) t(d))
    SELECT a.frame, a.y, a.x, round(sum(b.v * i.k * j.k) / sum(i.k * j.k), 6) AS v FROM p a, k i, k j, p b WHERE b.frame = a.frame AND b.y = a.y + i.d AND b.x = a.x + j.d GROUP BY ALL""")
def gaussian_blur(spark, sf):
    return gr.gaussian_blur(patches(spark, sf), 0.5).select("frame", "y", "x", r6("v").alias("v"))


@query("aperture_flux", f"""WITH {PX}, s AS (SELECT n_nationkey AS id, n_nationkey % 5 + 1 AS sx, n_nationkey // 5 + 1 AS sy FROM nation),
    j AS (SELECT frame, id, v, power(x - sx, 2) + power(y - sy, 2) AS q FROM p, s WHERE power(x - sx, 2) + power(y - sy, 2) <= 9)
    SELECT frame, id, CASE WHEN count(*) FILTER (WHERE q <= 1) = 5 THEN sum(v) FILTER (WHERE q <= 1) - 5 * quantile_disc(v, 0.5) FILTER (WHERE q > 2.25) END AS flux FROM j GROUP BY frame, id""")
def aperture_flux(spark, sf):
    stars = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 5 + 1.25).alias("x"), (F.floor(F.col("n_nationkey") / 5) + 1.25).alias("y"))
    return ma.aperture_flux(patches(spark, sf), stars, 1)


@query("photometry_stars", """WITH s AS (SELECT c_custkey AS id, c_custkey * 37 % 1000 AS x, c_custkey * 91 % 900 AS y, c_acctbal AS flux FROM customer)
    SELECT id, flux FROM s a WHERE x >= 26 AND x < 974 AND y >= 26 AND y < 874 AND flux < 9000 AND NOT EXISTS (SELECT 1 FROM s b WHERE a.id <> b.id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) < 256)
    ORDER BY flux DESC, id LIMIT 250""")
def photometry_stars(spark, sf):
    """The 250 brightest stars fit for photometry, as the operator does it."""
    c = table(spark, sf, "customer")
    stars = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("x"), (F.col("c_custkey") * 91 % 900).cast("double").alias("y"), F.col("c_acctbal").alias("flux"), F.col("c_acctbal").alias("peak"))
    return ma.photometry_stars(stars, 1000, 900, 3.0, saturation=9000.0).select("id", "flux")


@query("plane_fit", f"""WITH {CELLS}, g AS (SELECT frame, fwhm, (2 * col + 1) / 4.0::DOUBLE - 1 AS x, (2 * row + 1) / 4.0::DOUBLE - 1 AS y FROM c)
    SELECT frame, count(*) AS n, round(regr_intercept(fwhm, x * x + y * y), 6) AS level, round(regr_slope(fwhm, x), 6) AS tilt_x, round(regr_slope(fwhm, y), 6) AS tilt_y, round(regr_slope(fwhm, x * x + y * y), 6) AS curvature
    FROM g GROUP BY frame HAVING count(*) = 16""")
def plane_fit(spark, sf):
    """Planes of the frames whose cells are all known: there the terms of the plane are independent of each other."""
    cells = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("frame"), (F.col("l_orderkey") % 4).alias("row"), (F.col("l_partkey") % 4).alias("col")).agg(F.median("l_quantity").alias("fwhm"))
    fits = gr.fit_planes(cells).filter("n = 16")
    return fits.select("frame", "n", *[(r6(c) + F.lit(0.0)).alias(c) for c in ("level", "tilt_x", "tilt_y", "curvature")])


@query("tilt_verdicts", f"""WITH {FR}, t AS (SELECT frame, CASE WHEN frame % 11 > 0 THEN fwhm END AS level, noise - 3 AS tx, transparency - 0.8 AS ty, sky / 200 AS curve, exposure / 600 AS scatter FROM f),
    u AS (SELECT *, sqrt(tx * tx + ty * ty) / level AS tilt FROM t)
    SELECT frame, CASE WHEN level IS NULL THEN 'too few stars' WHEN scatter > 0 AND tilt < scatter THEN 'tilt is within the scatter of frames'
        WHEN tilt > 0.1 THEN 'tilted, soft towards the ' || CASE WHEN ty > 0 THEN 'bottom ' ELSE 'top ' END || CASE WHEN tx > 0 THEN 'right' ELSE 'left' END WHEN curve / level > 0.1 THEN 'curved field' ELSE 'even field' END AS verdict FROM u""")
def tilt_verdicts(spark, sf):
    level = F.when(F.col("frame") % 11 > 0, F.col("fwhm"))
    f = frames(spark, sf).select("frame", level.alias("level"), (F.col("noise") - 3).alias("tilt_x"), (F.col("transparency") - 0.8).alias("tilt_y"), (F.col("sky") / 200).alias("curvature"), (F.col("exposure") / 600).alias("scatter"))
    return f.select("frame", re_.tilt_verdict().alias("verdict"))


# ---------------------------------------------------------------- tiles of a stack


def patch_tiles(spark: SparkSession, sf: str, grid: sk.Grid) -> DataFrame:
    """Embeddings as frames of 8x8 pixels, one of three channels each, cut into tiles."""

    def run(batches):
        for pdf in batches:
            out = []
            for frame, c, raw in pdf.itertuples(index=False):
                image = np.floor(np.asarray(raw, np.float64).reshape(8, 8) * 1000)
                for ty, tx in grid.tiles():
                    y0, y1, x0, x1 = grid.box(ty, tx, grid.halo)
                    out.append((frame, c, ty, tx, y0, x0, y1 - y0, x1 - x0, image[y0:y1, x0:x1].astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["frame", "c", "ty", "tx", "y0", "x0", "h", "w", "data"])

    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).cast("int").alias("c"), "embedding")
    return e.mapInPandas(run, "frame long, c int, ty int, tx int, y0 int, x0 int, h int, w int, data binary")


def tile_terms(tiles: DataFrame, make) -> DataFrame:
    """Terms of tiles: ``make`` (frame, ty, tx) gives the columns after the tile's place."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(r.frame, r.c, r.ty, r.tx, *make(r.frame, r.ty, r.tx)) for r in pdf.itertuples(index=False)], columns=sk.field_names(sk.TERMS))

    return tiles.select("frame", "c", "ty", "tx").mapInPandas(run, sk.TERMS)


def tile_pixels(master: DataFrame) -> DataFrame:
    """(c, y, x, value, coverage, share) of combined tiles."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                y, x = np.mgrid[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w]
                columns = [np.frombuffer(b, k).astype(t) for b, k, t in ((r.data, "<f4", "f8"), (r.coverage, "<u2", "i8"), (r.rejection, "<f4", "f8"))]
                yield pd.DataFrame({"c": r.c, "y": y.ravel(), "x": x.ravel(), "value": columns[0], "coverage": columns[1], "share": columns[2]})

    return master.mapInPandas(run, "c long, y long, x long, value double, coverage long, share double")


@query("stack_tiles", f"""WITH {PX}, t AS MATERIALIZED (SELECT p.frame, label % 3 AS c, y, x, (v - frame % 7) * (1 + (frame % 3) * 0.5) + 10 AS v, 1 + frame % 4 AS w FROM p JOIN embeddings ON vec_id = frame),
    m AS (SELECT c, y, x, quantile_disc(v, 0.5) AS m FROM t GROUP BY ALL),
    s AS MATERIALIZED (SELECT t.*, CASE WHEN (v - m) / greatest(abs(m), 1e-6) < -4 THEN -1 WHEN (v - m) / greatest(abs(m), 1e-6) > 4 THEN 1 ELSE 0 END AS side FROM t JOIN m USING (c, y, x)),
    d AS MATERIALIZED (SELECT a.frame, a.y, a.x, avg(CASE WHEN b.side = 1 THEN 1.0 ELSE 0.0 END) > 0.3 AS dense FROM s a JOIN s b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
    g AS (SELECT a.frame, a.y, a.x, bool_or(b.dense) AS grown FROM d a JOIN d b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
    SELECT CAST(c AS BIGINT) AS c, y, x, CAST(CAST(coalesce(sum(v * w) FILTER (side = 0 AND NOT grown) / sum(w) FILTER (side = 0 AND NOT grown), 0) AS FLOAT) AS DOUBLE) AS value, count(*) AS coverage,
        CAST(CAST((count(*) FILTER (side = -1) + count(*) FILTER (side = 1 OR grown)) / count(*) AS FLOAT) AS DOUBLE) AS share
    FROM s JOIN g USING (frame, y, x) GROUP BY c, y, x""")
def stack_tiles(spark, sf):
    how = sk.Combination("percentile", 4.0, 4.0, large_scale=True, large_box=3, large_density=0.3, large_grow=1)
    grid = sk.Grid(8, 8, side=3, halo=how.halo())
    tiles = patch_tiles(spark, sf, grid)
    terms = tile_terms(tiles, lambda f, ty, tx: (1.0 + f % 4, float(f % 7), 1 + (f % 3) * 0.5, 10.0, None, None, None, None, None))
    return tile_pixels(sk.combine(tiles, terms, grid, how))


@query("stack_fields", f"""WITH {PX}, q AS (SELECT y, x, least(greatest((y + 0.5) * 2 / 8 - 0.5, 0), 1) AS gy, least(greatest((x + 0.5) * 2 / 8 - 0.5, 0), 1) AS gx, y / 7 AS fy, x / 7 AS fx FROM range(0, 8) a(y), range(0, 8) b(x)),
    n AS (SELECT frame, i, j, 1 + ((frame + i + 2 * j) % 5) * 0.25 AS s, (frame * 3 + i + 2 * j) % 11 AS o, 1 + (frame + 2 * i + j) % 3 AS f FROM (SELECT vec_id AS frame FROM embeddings), range(0, 2) a(i), range(0, 2) b(j)),
    k AS (SELECT frame, y, x, sum(s * abs(1 - i - gy) * abs(1 - j - gx)) AS s, sum(o * abs(1 - i - gy) * abs(1 - j - gx)) AS o, sum(f * abs(1 - i - fy) * abs(1 - j - fx)) AS f FROM n, q GROUP BY frame, y, x)
    SELECT CAST(label % 3 AS BIGINT) AS c, y, x, CAST(CAST(sum((v * s + o) * f * (1 + frame % 4)) / sum(f * (1 + frame % 4)) AS FLOAT) AS DOUBLE) AS value, count(*) AS coverage, 0.0::DOUBLE AS share
    FROM p JOIN k USING (frame, y, x) JOIN embeddings ON vec_id = frame GROUP BY ALL""")
def stack_fields(spark, sf):
    grid = sk.Grid(8, 8, side=3)

    def make(f, ty, tx):
        at = np.array([[(i, j) for j in (0, 1)] for i in (0, 1)])
        scale, offset, field = 1 + ((f + at[..., 0] + 2 * at[..., 1]) % 5) * 0.25, (f * 3.0 + at[..., 0] + 2 * at[..., 1]) % 11, 1.0 + (f + 2 * at[..., 0] + at[..., 1]) % 3
        box = grid.box(ty, tx)
        (place, s), (_, o) = sk.cut_map(scale, box, grid), sk.cut_map(offset, box, grid)
        there, w = sk.cut_map(field, box, grid, corners=True)
        return 1.0 + f % 4, 0.0, 1.0, 0.0, place, s.astype("<f8").tobytes(), o.astype("<f8").tobytes(), there, w.astype("<f8").tobytes()

    tiles = patch_tiles(spark, sf, grid)
    return tile_pixels(sk.combine(tiles, tile_terms(tiles, make), grid, sk.Combination("none")))
