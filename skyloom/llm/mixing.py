"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source of n documents with target weight w gets the repetition rate w * total / n. A document's number of
copies is the inverse of the Poisson distribution with that mean at a uniform value that a hash of seed and id
gives: no state, the same on every run, and the expected number of copies is exactly the rate. A rate beyond
PART_RATE is the sum of several smaller ones, each with a value of its own, so the table of cumulative
probabilities stays short. Copies are exploded and dealt to partitions by a second hash, in whose order each
partition is sorted: a global shuffle.

Defined results: a null source is a source of its own; without weights all sources weigh alike; weights are
shares among the sources that occur; a source with
no weight, or a weight of 0, gets no copies; a null id or text counts as an empty one; rows that share an id but
not the text are drawn apart, rows that share both get the same number of copies; columns of the input called
``copy``, ``rate`` or ``shuffle_key`` are replaced, all others are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

PART_RATE, BROADCAST_SOURCES = 32.0, 100_000
#: Terms of the cumulative distribution: beyond them lies less than 2**-52 for rates up to PART_RATE.
TERMS = 120


def uniform(*parts: Column) -> Column:
    """A value in [0, 1) of 52 bits from the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None, total: float | None, source_col: str) -> DataFrame:
    """(source key, rate of a part, parts, cumulative probabilities): a row a source."""
    found = F.col(f"`{source_col}`")
    sizes = docs.select(F.coalesce(found.cast("string"), F.lit("")).alias("source_key"), found.isNull().alias("source_null")).groupBy("source_key", "source_null").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            here = F.col("source_null") if name is None else ~F.col("source_null") & (F.col("source_key") == name)
            weight = F.when(here, float(value)).otherwise(weight)
    sizes = cut(sizes.withColumn("weight", weight))
    sums = sizes.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    goal = float(total if total is not None else sums["n"] or 0)
    rate = F.col("weight") / F.lit(float(sums["w"] or 1.0)) * F.lit(goal) / F.col("n")
    parts = F.greatest(F.lit(1), F.ceil(rate / PART_RATE)).cast("int")
    out = sizes.select("source_key", "source_null", rate.alias("rate"), parts.alias("parts")).withColumn("part_rate", F.col("rate") / F.col("parts"))
    first = F.exp(-F.col("part_rate"))
    table = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(first.alias("p"), first.alias("s"), F.array(first).alias("cdf")),
        lambda a, k: F.struct((a["p"] * F.col("part_rate") / k).alias("p"), (a["s"] + a["p"] * F.col("part_rate") / k).alias("s"), F.concat(a["cdf"], F.array(a["s"] + a["p"] * F.col("part_rate") / k)).alias("cdf")),
        lambda a: a["cdf"],
    )
    return out.withColumn("cdf", table).drop("part_rate")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with each row repeated by its count, in shuffled order, and the columns rate double, copy int
    (from 0) and shuffle_key string. ``total``: documents aimed at, by default as many as there are.

    Partitions are dealt by shuffle_key and the partition that a row comes from, so equal rows in great number
    do not meet in one."""
    table = cut(rates(docs, weights, total, source_col))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)  # else a plain join, whose skewed partitions adaptive execution splits
    docs = docs.drop("rate", "copy", "shuffle_key")
    names = docs.columns
    whole = lambda c: F.coalesce(F.col(f"d.`{c}`").cast("string"), F.lit(""))
    # the input's columns stay together in the struct d, so that no name of theirs meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("d"))
    rows = rows.withColumn("source_key", whole(source_col)).withColumn("source_null", F.col(f"d.`{source_col}`").isNull())
    rows = rows.withColumn("id_key", whole(id_col)).withColumn("text_key", F.md5(whole(text_col)) if text_col in names else F.lit(""))
    joined = rows.join(table, ["source_key", "source_null"])
    values = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: uniform(F.lit(str(seed)), F.col("id_key"), j.cast("string"), F.col("text_key")))
    copies = F.aggregate(values, F.lit(0), lambda a, u: a + F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    out = joined.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed} order"), "id_key", F.col("copy").cast("string"), "text_key")))
    out = out.select("d", "rate", "copy", "shuffle_key", F.spark_partition_id().alias("origin")).repartition("shuffle_key", "origin").sortWithinPartitions("shuffle_key")
    return out.select(*[F.col(f"d.`{c}`").alias(c) for c in names], "rate", "copy", "shuffle_key")
