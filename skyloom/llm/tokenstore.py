"""Token ids in binary shards with a minimal perfect hash index.

Layout of a store, all in one folder:

* ``shard-NNNNN.ids``: the ids of the shard's documents end to end, little-endian and unsigned, of 16 bits
  where the vocabulary allows it and else of 32 (``dtype`` in the manifest), nothing else. Shards follow each other in ascending document key, and so do the documents in a shard.
* ``shard-NNNNN.mph``: the index, see ``HashIndex``: key -> slot in constant time, and per slot a 32-bit
  fingerprint of the key and the number of its first record, with the offset of every record in ids.
* ``shard-NNNNN.keys``: the document keys in order, as an Arrow file, to list a shard.
* ``manifest.json``: per shard its documents, ids, first and last key, in order: a lookup finds its shard by
  bisection.

A task writes under a name of its own and renames when whole, so a task that runs twice leaves one file.

Defined results: null and empty texts hold only the end id; rows with a null key come first and can be
listed but not looked up; rows that share a key follow each other in the order of a hash of their texts, over
several shards where they are many, and a lookup returns all of them; bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, id_and_text, kept, ragged_take
from .bpe import ChunkEncoder, load_bpe, text_array, tokenizer_path

MAGIC = b"SKYMPH01"
#: Documents a shard holds (a parameter of write_store), and the most shards a store has.
ROWS_PER_SHARD, MAX_SHARDS = 8192, 20_000
END_ID = 0
#: A space and then something else than white space.
SPACED = r"\A [^\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def filesystem(uri: str):
    """The file system and path of a folder; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:/") else f"file://{uri}")


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over integer keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class HashIndex:
    """Minimal perfect hash over distinct 64-bit keys: at each level the keys that hash alone keep their
    bit, the others go on to the next level; a key's slot is the rank of its bit."""

    LEVELS, LOAD = 40, 1.5

    def __init__(self, sizes, bits, fingerprints, first, offsets):
        self.sizes, self.bits, self.fingerprints, self.first, self.offsets = sizes, bits, fingerprints, first, offsets
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> HashIndex:
        sizes, planes, left = [], [], keys.astype(np.int64)
        for level in range(cls.LEVELS):
            if not len(left):
                break
            m = -(-max(64, int(cls.LOAD * len(left))) // 64) * 64
            at = (mixed(left, level + 1) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            planes.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        if len(left):
            raise ValueError(f"{len(left)} keys are left after {cls.LEVELS} levels; keys must be distinct")
        out = cls(np.array(sizes, "<i8"), np.concatenate(planes) if planes else np.zeros(0, "<u8"), None, None, offsets.astype("<i8"))
        slot = out.slots(keys)
        out.fingerprints, out.first = np.zeros(len(keys), "<u4"), np.zeros((len(keys), 2), "<i8")
        out.fingerprints[slot] = (mixed(keys, 0) >> np.uint64(32)).astype(np.uint32)
        out.first[slot] = first
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for a key that no level holds."""
        slot = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(open_):
                break
            at = (mixed(keys[open_], level + 1) % np.uint64(m)).astype(np.int64) + self.starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit], bit[hit]
            below = self.bits[w] & ((np.uint64(1) << b) - np.uint64(1))
            slot[open_[hit]] = self.ranks[w] + np.bitwise_count(below)
            open_ = open_[~hit]
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """(first record, records) of each key; (-1, 0) where the fingerprint differs."""
        keys = np.asarray(keys, np.int64)
        slot = self.slots(keys)
        out = np.tile(np.array([-1, 0], np.int64), (len(keys), 1))
        held = np.flatnonzero(slot >= 0)
        same = self.fingerprints[slot[held]] == (mixed(keys[held], 0) >> np.uint64(32)).astype(np.uint32)
        out[held[same]] = self.first[slot[held[same]]]
        return out

    def dump(self) -> bytes:
        head = struct.pack("<8sqqqq", MAGIC, len(self.sizes), len(self.bits), len(self.fingerprints), len(self.offsets))
        return head + b"".join(np.ascontiguousarray(x).tobytes() for x in (self.sizes.astype("<i8"), self.bits, self.fingerprints, self.first, self.offsets))

    @classmethod
    def load(cls, raw: bytes) -> HashIndex:
        magic, levels, words, keys, offsets = struct.unpack_from("<8sqqqq", raw)
        if magic != MAGIC:
            raise ValueError("not an index file")
        at, parts = 40, []
        for kind, n in (("<i8", levels), ("<u8", words), ("<u4", keys), ("<i8", 2 * keys), ("<i8", offsets)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += parts[-1].nbytes
        parts[3] = parts[3].reshape(-1, 2)
        return cls(*parts)


class LibraryEncoder(ChunkEncoder):
    """The tokenizers library, called once per distinct chunk: new chunks go to it in long strings, and the
    lengths of the tokens in bytes tell which ids are whose."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.piece_len = np.diff(load_bpe(path).piece_off)
        super().__init__([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])

    def whole(self, text: str) -> list[str]:
        return [text]

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # joined chunks stay apart only if each is a space and then something else than white space
        column = pa.array(chunks, pa.string())
        joins = np.asarray(pc.match_substring_regex(column, SPACED)).astype(bool)
        spaced = list(itertools.compress(chunks, joins.tolist()))
        out = [self.ids("".join(spaced[a : a + 1000])) for a in range(0, len(spaced), 1000)]
        flat = np.concatenate(out) if out else np.zeros(0, np.int32)
        sizes = np.asarray(pc.binary_length(column)).astype(np.int64)[joins]
        off = np.concatenate(([0], np.searchsorted(np.cumsum(self.piece_len[flat]), np.cumsum(sizes)) + 1))
        if joins.all():
            return flat, off
        got = [self.ids(chunks[k]) for k in np.flatnonzero(~joins).tolist()]
        order = np.argsort(np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins))))
        off = np.concatenate((off, off[-1] + np.cumsum([len(g) for g in got])))
        return ragged_take(np.concatenate((flat, *got)), off, order)

    def ids(self, text: str) -> np.ndarray:
        """The library's ids of a text; its fast form differs in leaving out the offsets of tokens."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)


@kept(2)
def load_library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def put(fs, path: str, write) -> None:
    """Write under a name of its own, then rename."""
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        write(out)
    try:
        fs.move(own, path)
    except OSError:  # some file systems do not rename onto a file
        fs.delete_file(path)
        fs.move(own, path)


def _write_shards(folder: str, path: str, end_id: int | None, dtype: str):
    def run(batches):
        fs, root = filesystem(folder)
        encoder = load_library(path)
        name = f"{root}/shard-{TaskContext.get().partitionId():05d}"
        own = f"{name}.ids.{uuid.uuid4().hex}"
        ids_column, keys, lens = [], [], []
        with fs.open_output_stream(own) as out:
            for table in blocks(batches, 4 << 20):
                ids, off = encoder.encode(text_array(table))
                if end_id is not None:
                    ids, off = np.insert(ids, off[1:], end_id), off + np.arange(len(off))
                out.write(ids.astype(dtype).tobytes())
                lens.append(np.diff(off))
                keys.append(table.column("key").combine_chunks())
                ids_column.append(table.column("id").combine_chunks())
        if not lens:
            fs.delete_file(own)
            return
        try:
            fs.move(own, f"{name}.ids")
        except OSError:
            fs.delete_file(f"{name}.ids")
            fs.move(own, f"{name}.ids")
        lens, column, key = np.concatenate(lens), pa.chunked_array(ids_column), pa.chunked_array(keys).combine_chunks()
        offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int64)
        held = np.flatnonzero(np.asarray(key.is_valid()))
        value = np.asarray(key.fill_null(0))[held]
        uniq, first, count = np.unique(value, return_index=True, return_counts=True)
        index = HashIndex.build(uniq, np.stack((held[first], count), 1).astype(np.int64), offsets)
        put(fs, f"{name}.mph", lambda f: f.write(index.dump()))
        batch = pa.table([column, pa.chunked_array([key])], ["id", "key"])

        def arrow(f):
            with pa.ipc.new_file(f, batch.schema) as w:
                w.write_table(batch)

        put(fs, f"{name}.keys", arrow)
        yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "docs": [len(lens)], "ids": [int(offsets[-1])], "first": [str(column[int(held[0])]) if len(held) else None], "last": [str(column[-1]) if len(held) else None]}, schema=pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("first", pa.string()), ("last", pa.string())]))

    return run


def write_store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = END_ID, rows_per_shard: int = ROWS_PER_SHARD) -> list[dict]:
    """Encode and write all of ``docs``; returns the manifest. One shuffle, by ranges of the key. Integer
    keys index themselves, others by their 64-bit hash, in the order of the key itself."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    path = path or tokenizer_path()
    dtype = "<u2" if max(len(load_bpe(path).piece_off) - 2, end_id or 0) < 1 << 16 else "<u4"
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    key = F.col("id").cast("long") if whole else F.when(F.col("id").isNotNull(), F.xxhash64("id"))
    n = docs.select(id_col).count()
    shards = max(1, min(MAX_SHARDS, -(-n // rows_per_shard)))
    # rows that share an id, null ids above all, may be many: ranges divide them by text hash and origin
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("origin")]
    dealt = id_and_text(docs, id_col, text_col).withColumn("key", key).withColumn("hash", F.xxhash64("text")).withColumn("origin", F.spark_partition_id())
    dealt = dealt.repartitionByRange(shards, *order).sortWithinPartitions(*order[:2], "text").select("id", "text", "key")
    rows = dealt.mapInArrow(_write_shards(folder, path, end_id, dtype), "shard long, docs long, ids long, first string, last string").collect()  # a row for each shard, MAX_SHARDS at most
    manifest = [r.asDict() for r in sorted(rows, key=lambda r: r["shard"])]
    start = 0
    for m in manifest:
        m["start"] = start
        start += m["ids"]
    put(fs, f"{root}/manifest.json", lambda f: f.write(json.dumps({"ordered": whole, "dtype": dtype, "shards": manifest}).encode()))
    return manifest


def read_shards(spark: SparkSession, folder: str, id_type: str = "bigint", digest: bool = False) -> DataFrame:
    """(id, start long: ids of all documents before it, n_tokens long, ids binary) of every document, each
    found through its shard's index; a shard is read by one task. With ``digest``, ids_crc32 long, the
    unsigned CRC-32 of the document's packed ids, stands instead of the ids."""
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        spec = json.loads(f.read())
    manifest, dtype = spec["shards"], np.dtype(spec["dtype"])
    name_, type_ = ("ids_crc32", "long") if digest else ("ids", "binary")

    def run(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                m = manifest[k]
                name = f"{root}/shard-{m['shard']:05d}"
                with fs.open_input_file(f"{name}.keys") as f:
                    table = pa.ipc.open_file(f).read_all()
                with fs.open_input_stream(f"{name}.mph") as f:
                    index = HashIndex.load(f.read())
                key = table.column("key").combine_chunks()
                valid, value = np.asarray(key.is_valid()), np.asarray(key.fill_null(0))
                found = index.find(value)
                seen: dict[int, int] = {}
                if (found[:, 1] > 1).any() or not valid.all():
                    row = np.empty(len(value), np.int64)
                    for i, (ok, v, f0) in enumerate(zip(valid.tolist(), value.tolist(), found[:, 0].tolist(), strict=True)):
                        row[i] = f0 + seen.get(v, 0) if ok else i
                        seen[v] = seen.get(v, 0) + ok
                else:
                    row = found[:, 0]
                with fs.open_input_file(f"{name}.ids") as f:
                    for a in range(0, len(row), 1000):
                        rows = row[a : a + 1000]
                        lo, hi = index.offsets[rows], index.offsets[rows + 1]
                        base = int(lo.min())
                        f.seek(base * dtype.itemsize)
                        raw = np.frombuffer(f.read((int(hi.max()) - base) * dtype.itemsize), dtype).astype("<u4").tobytes()
                        parts = [raw[(s - base) * 4 : (e - base) * 4] for s, e in zip(lo.tolist(), hi.tolist(), strict=True)]
                        yield from pa.table([table.column("id").slice(a, 1000), pa.array(lo + m["start"]), pa.array(hi - lo), pa.array(list(map(zlib.crc32, parts)), pa.int64()) if digest else pa.array(parts, pa.binary())], ["id", "start", "n_tokens", name_]).combine_chunks().to_batches()

    n = max(1, len(manifest))
    return spark.range(0, len(manifest), 1, n).mapInArrow(run, f"id {id_type}, start long, n_tokens long, {name_} {type_}")


class TokenStore:
    """Keyed access to a written store: ``get(key)`` finds a shard by bisection, hashes once and reads one range.
    Keys are integers, or strings in the order of their UTF-8 bytes."""

    def __init__(self, folder: str):
        self.fs, self.root = filesystem(folder)
        with self.fs.open_input_stream(f"{self.root}/manifest.json") as f:
            spec = json.loads(f.read())
        self.ordered, self.dtype, self.manifest = spec["ordered"], np.dtype(spec["dtype"]), [m for m in spec["shards"] if m["first"] is not None]
        self.firsts, self.lasts = ([self.place(m[end]) for m in self.manifest] for end in ("first", "last"))
        self.index = functools.lru_cache(maxsize=64)(self._index)

    def place(self, key: int | str) -> int | bytes:
        """What the order of the shards goes by."""
        return int(key) if self.ordered else str(key).encode("utf-8", "replace")

    def _index(self, shard: int) -> HashIndex:
        with self.fs.open_input_stream(f"{self.root}/shard-{shard:05d}.mph") as f:
            return HashIndex.load(f.read())

    def get(self, key: int | str) -> list[np.ndarray]:
        """The ids of every document with this key: none for a foreign key, but with probability 2**-32 a
        hash index takes a foreign key for one of its own."""
        place, out = self.place(key), []
        held = place if self.ordered else xxhash.xxh64_intdigest(place, seed=42)  # as Spark's xxhash64
        held = held - (1 << 64) if held >= 1 << 63 else held
        for k in range(bisect.bisect_left(self.lasts, place), bisect.bisect_right(self.firsts, place)):
            shard = self.manifest[k]["shard"]
            index = self.index(shard)
            row, count = index.find(np.array([held]))[0]
            if count:
                lo, hi = index.offsets[row], index.offsets[row + count]
                with self.fs.open_input_file(f"{self.root}/shard-{shard:05d}.ids") as f:
                    f.seek(int(lo) * self.dtype.itemsize)
                    ids = np.frombuffer(f.read(int(hi - lo) * self.dtype.itemsize), self.dtype)
                out += np.split(ids, (index.offsets[row + 1 : row + count] - lo).tolist())
        return out
