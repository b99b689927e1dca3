"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each five-word shingle is hashed once; the top bits choose one of BINS bins and each bin keeps its least
hash. An empty bin j takes the value of the first non-empty bin among g(j, 1), g(j, 2), ..., a sequence of
hashes that is the same for all documents. Of each bin the BITS low-order bits are kept, so two unrelated
bins agree with probability 2**-BITS; likeness removes that bias.

Defined results: texts without words (null, empty, white space) have the fingerprint of zeros and a flag
byte, alike only among themselves; equal texts have equal fingerprints; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import blocks, id_and_text, new_folder
from .wordhash import HASH_BYTES, mix, shingles

BINS, BITS, SHINGLE = 256, 4, 5
EMPTY = np.uint64(2**64 - 1)


def densify(least: np.ndarray) -> None:
    """Fill empty bins of rows that have a full one, in place."""
    full = least != EMPTY
    row, bin_ = np.nonzero(~full & full.any(1, keepdims=True))
    step = 0
    while len(row):
        step += 1
        probe = (mix((bin_ + BINS * step).astype(np.uint64) + np.uint64(0x51ED2701)) >> np.uint64(32)).astype(np.int64) % BINS
        hit = full[row, probe]
        least[row[hit], bin_[hit]] = least[row[hit], probe[hit]]
        row, bin_ = row[~hit], bin_[~hit]


def fingerprints(texts: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """(texts, 1 + BINS * BITS / 8) bytes: a flag byte (1 for a text with words), then the packed bits."""
    h, off = shingles(texts, n)
    least = np.full((len(texts), BINS), EMPTY, np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    bins = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    np.minimum.at(least.reshape(-1), doc * BINS + bins, np.minimum(h, EMPTY - np.uint64(1)))
    densify(least)
    with np.errstate(over="ignore"):  # a value that fills several bins shows other bits in each
        low = (mix(least + np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) & np.uint64(2**BITS - 1)).astype(np.uint8)
    has = np.diff(off) > 0
    low[~has] = 0
    return np.concatenate((has[:, None].astype(np.uint8), low[:, 0::2] << 4 | low[:, 1::2]), 1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets behind two rows of fingerprints, 0 to 1."""
    x = a[:, 1:] ^ b[:, 1:]
    share = ((x & 0xF0 == 0).sum(1) + (x & 0x0F == 0).sum(1)) / BINS
    chance = 2.0**-BITS
    out = np.clip((share - chance) / (1 - chance), 0, 1)
    return np.where(a[:, 0] == b[:, 0], np.where(a[:, 0] == 0, 1.0, out), 0.0)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint binary) of every whole text; one narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for table in blocks(batches, HASH_BYTES):
            got = fingerprints(table.column("text").to_pylist())
            yield from pa.table([table.column("id").combine_chunks(), pa.array([r.tobytes() for r in got], pa.binary())], ["id", "fingerprint"]).to_batches()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"id {kind}, fingerprint binary").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: pa.Array, texts: list[str], following: str | None) -> pa.RecordBatch:
    """Results of ``texts`` but the last, or of all where ``following`` is the text after the last."""
    after = [*texts[1:], *([following] if following is not None else [])]
    texts_here = texts[: len(after)]
    raw = [t.encode() for t in texts]
    own = fingerprints([*raw, *([following.encode()] if following is not None else [])])
    made = [edited(a, b).encode() for a, b in zip(texts_here, after, strict=True)]
    new = fingerprints(made)
    n = len(texts_here)
    binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
    return pa.RecordBatch.from_arrays(
        [ids.slice(0, n), pa.array(list(map(len, texts_here)), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in made], pa.string()), binary(own[:n]), binary(new), pa.array(likeness(own[:n], new)), pa.array(likeness(own[:n], own[1 : n + 1])), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "edge", "text"],
    )


def _edge(ids: pa.Array, part: int, edge: int, text: str) -> pa.RecordBatch:
    cols = [ids, pa.nulls(1, pa.int64()), *[pa.nulls(1, t) for t in (pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())], pa.array([part], pa.int64()), pa.array([edge], pa.int32()), pa.array([text], pa.string())]
    return pa.RecordBatch.from_arrays(cols, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "edge", "text"])


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (see ``edited``; the following document is the
    next in descending id, after the last the first; ties in the order of a hash of the text, null ids last) with
    the likeness of the text's fingerprint to the edited one and to the following document's.

    One shuffle, by ranges of the id. A partition does all its documents but the last, whose successor is in
    another partition; these edges (two rows a partition) are joined in a small second step. The rows stand in a
    folder beside the checkpoints, which is left to whoever clears these."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part long, edge int, text string"

    def run(batches):
        part, held_id, held, first = TaskContext.get().partitionId(), None, None, True
        for table in blocks(batches, HASH_BYTES):
            ids = table.column("id").combine_chunks()
            texts = [b.decode("utf-8", "replace") for b in table.column("text").to_pylist()]
            if first:
                yield _edge(ids.slice(0, 1), part, 0, texts[0])
                first = False
            else:
                ids, texts = pa.concat_arrays([held_id, ids]), [held, *texts]
            if len(texts) > 1:
                yield _rows(ids, texts, None)
            held_id, held = ids.slice(len(texts) - 1, 1), texts[-1]
        if held is not None:
            yield _edge(held_id, part, 1, held)

    def close(frames):
        for batch in frames:
            for k, (text, following) in enumerate(zip(batch.column("text").to_pylist(), batch.column("following").to_pylist(), strict=True)):
                yield _rows(batch.column("id").slice(k, 1), [text], following)

    # rows that share an id, null ids above all, may be many: ranges divide them by text hash and origin
    order = [F.col("id").desc_nulls_last(), F.col("hash"), F.col("origin")]
    dealt = id_and_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text")).withColumn("origin", F.spark_partition_id())
    dealt = dealt.repartitionByRange(partitions, *order) if partitions else dealt.repartitionByRange(*order)
    folder = new_folder(spark, "edits")
    dealt.sortWithinPartitions(*order[:2], "text").select("id", "text").mapInArrow(run, schema).write.parquet(folder)
    done = spark.read.parquet(folder)
    edges = done.filter(F.col("edge").isNotNull()).select("id", "part", "edge", "text")  # two rows a partition
    firsts, lasts = edges.filter("edge = 0"), edges.filter("edge = 1")
    numbers = Window.orderBy("part")  # of partitions that are not empty: numbers alone
    ring = firsts.select("part", F.coalesce(F.lead("part").over(numbers), F.min("part").over(numbers)).alias("next"))
    pairs = lasts.join(ring, "part").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
    closed = pairs.select("id", "text", "following").mapInArrow(close, schema)
    out = done.filter(F.col("edge").isNull()).unionByName(closed)
    return out.drop("part", "edge", "text").withColumnRenamed("id", id_col)
