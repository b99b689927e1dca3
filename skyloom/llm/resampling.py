"""Importance resampling towards a target: hashed features, array-scored weights, exact draws by score histogram.

Words are runs of ASCII digits, letters and all non-ASCII characters after lower-casing A-Z; features are runs of 1 to
``orders`` words joined by one space, counted with repeats and hashed by CRC-32 into ``buckets``. A bucket's gain is
the floored log ratio of its share in the target to that in the corpus (both smoothed by one), and a document's weight
is the sum of its gains, read from one dense array. A Gumbel draw seeded by the id is added, so that the highest
scores are a sample without replacement in proportion to the weights.

Ranks come from a histogram of the integer scores: suffix sums over it give how many documents stand above each score,
scores that still reach the quota survive, and only their documents are shuffled and numbered by id within a score.

Null or empty texts have no features and weigh 0. A null id is seeded as an empty text and comes last among ties; rows
that repeat an id and a score are ordered by their number of features. Empty tables give empty results; an empty
target makes every word less likely in proportion to its count. Columns other than id and text are left behind.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, cut, id_and_text, trimmed

#: Of lower-cased UTF-8.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS = 10_000
SCORED = "id {kind}, n_words long, n_features long, weight long, score long"


def codes(text: bytes, orders: int = 1, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words of a text and the bucket of each of its features."""
    words = WORD.findall(text.lower())  # bytes: A-Z only
    runs: Iterator[bytes] = iter(words)
    found = []
    for n in range(1, orders + 1):
        runs = iter(words) if n == 1 else map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))
        found.append(np.fromiter(map(zlib.crc32, runs), np.uint32, max(0, len(words) - n + 1)))
    return len(words), (np.concatenate(found) % buckets).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", orders: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. A task sends one row a bucket at most, and the driver
    receives their sums: ``buckets`` numbers."""
    bounded_batches(texts.sparkSession)

    @trimmed
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(codes(text.as_py(), orders, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch({"bucket": some, "n": total[some]})

    held = texts.filter(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary").alias("text"))
    out = np.zeros(buckets, np.int64)
    for r in held.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's smoothed share of each bucket over the corpus's."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(corpus, target, strict=True)], np.int64)


def gumbel(id_text: str, seed: str) -> int:
    """floor(1000 x) of a Gumbel draw x from the first 32 bits of SHA-256 of ``seed:id``."""
    h = int(hashlib.sha256(f"{seed}:{id_text}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = 1, seed: str = "2024") -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row, in one pass over the texts."""
    held = id_and_text(docs, id_col, text_col).withColumn("name", F.coalesce(F.col("id").cast("string"), F.lit("")))

    @trimmed
    def run(batches):
        for batch in batches:
            out = []
            for text, name in zip(batch.column("text"), batch.column("name"), strict=True):
                words, where = codes(text.as_py(), orders, len(table))
                weight = int(table[where].sum())
                out.append((words, len(where), weight, weight + gumbel(name.as_py(), seed)))
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns)], ["id", "n_words", "n_features", "weight", "score"])

    return held.mapInArrow(run, SCORED.format(kind=held.schema["id"].dataType.simpleString()))


def above_each_score(scores: DataFrame) -> DataFrame:
    """(score, n, above): the histogram of ``score`` and how many rows stand above each of its values.

    The histogram is dealt by ranges of scores; the driver sees one sum a range, and running sums within a range do
    the rest."""
    spark = scores.sparkSession
    dealt = cut(scores.groupBy("score").agg(F.count("*").alias("n")).repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()))
    before, held = [], 0
    for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row a partition
        before.append((r["part"], held))
        held += r["n"]
    offsets = spark.createDataFrame(before, "part int, before long")
    running = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(offsets), "part").select("score", "n", (F.col("before") + F.coalesce(F.sum("n").over(running), F.lit(0))).alias("above"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", orders: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """(``id_col``, n_features, weight, score, rank): every document, and the place of those drawn, which are
    ``percent`` of the documents with ``least_words`` words (rounded down); others have no rank."""
    table = gains(bucket_counts(docs, text_col, orders, buckets), bucket_counts(target, target_text, orders, buckets))
    rows = cut(scored(docs, table, id_col, text_col, orders, seed))
    fit = F.col("n_words") >= least_words
    quota = percent * rows.filter(fit).count() // 100
    alive = cut(above_each_score(rows.filter(fit)).filter(F.col("above") < quota))
    cutoff = alive.agg(F.min("score")).first()[0]
    within = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features")
    place = F.col("above") + F.row_number().over(within)
    if cutoff is None:
        out = rows.withColumn("rank", F.lit(None).cast("long"))
    else:
        reach = fit & (F.col("score") >= cutoff)
        ranked = rows.filter(reach).join(alive.select("score", "above"), "score").withColumn("rank", place)
        ranked = ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank"))).select(*rows.columns, "rank")
        out = ranked.unionByName(rows.filter(~reach).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that ``resample`` draws, whole. Ids must be unique: rows that share one all come if any does."""
    found = resample(docs, target, id_col, **options).filter("rank is not null").select(F.col(id_col).alias("__id")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["__id"]), "left_semi")
