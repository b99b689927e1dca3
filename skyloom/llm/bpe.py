"""BPE encoding and decoding by a pair occurrence index.

Texts are split into pre-tokens; each distinct pre-token of a block is laid out once in flat symbol
arrays. An index maps every adjacent pair that has a merge rank to all its positions. Active ranks are
applied in ascending order: all positions of the lowest rank merge at once, neighbours get new pairs, and
only their lists change. Pre-tokens do not touch each other, so the lowest rank of the whole block is also
the lowest of each pre-token in which it occurs; the result equals merging pre-token by pre-token.

Defined results: null and empty texts give no ids and an empty decoded text; bytes that are no UTF-8 count as U+FFFD; a special token's string in a
text becomes its id; repeated rows are encoded row by row; extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Interner, binary_array, blocks, id_and_text, kept, ragged_take, readable

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between white space on both sides (or the end): only there can a split at spaces differ.
LOOSE_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
NONE = np.int32(2**31 - 1)
#: Chunks, and their characters, that a worker keeps between blocks.
CACHE_CHUNKS, CACHE_BYTES = 600_000, 48 << 20
#: Bytes of text whose new chunks are merged together, and of packed ids decoded together.
MERGE_BYTES, BLOCK_IDS = 10 << 20, 8 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class PairIndexBPE:
    """Vocabulary, merge ranks and decoding table of one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        shown = byte_symbols()
        back = {c: b for b, c in shown.items()}
        self.byte_id = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.twins = left == right
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        named = vocab | special
        pieces = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            known = token not in special and all(c in back for c in token)
            pieces[i] = bytes(back[c] for c in token) if known else token.encode()
        self.piece_off = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=self.piece_off[1:])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.pattern = regex.compile(PRETOKEN)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each of ``words`` as a ragged array."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        off = np.zeros(len(words) + 1, np.int64)
        if not n:
            return sym, off
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        full = lens > 0
        nxt[ends[full] - 1] = -1
        prv[(ends - lens)[full]] = -1
        rank_at = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(nxt >= 0)
        rank_at[inner] = self.ranks(sym[inner], sym[inner + 1])
        dead = np.zeros(n, bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enter the positions ``at`` under the ranks that they have now."""
            r = rank_at[at]
            known = r != NONE
            at, r = at[known], r[known]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for rank, s, e in zip(r[starts].tolist(), starts, [*starts[1:], len(r)], strict=True):
                if (lists := index.get(rank)) is None:
                    index[rank] = [at[s:e]]
                    heapq.heappush(active, rank)
                else:
                    lists.append(at[s:e])

        add(inner)
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            if self.twins[rank] and len(at) > 1:  # in a run of equal symbols every second pair merges, from the left
                k = np.arange(len(at))
                first = np.concatenate(([True], nxt[at[:-1]] != at[1:]))
                at = at[(k - np.maximum.accumulate(np.where(first, k, 0))) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.merged[rank]
            dead[gone] = True
            rank_at[gone] = NONE
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            rank_at[at[~has]] = NONE
            before = prv[at]
            touched = np.concatenate((at[has], before[before >= 0]))
            if len(touched):
                touched = np.unique(touched)
                rank_at[touched] = self.ranks(sym[touched], sym[nxt[touched]])
                add(touched)
        live = ~dead
        held = np.concatenate(([0], np.cumsum(live)))
        off[1:] = held[ends]
        return sym[live], off

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The text of each row of ids; bytes that are not UTF-8 become U+FFFD."""
        data, starts = ragged_take(self.piece_bytes, self.piece_off, ids)
        raw, cuts = data.tobytes(), starts[off].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@functools.lru_cache(maxsize=4)
def load_bpe(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


class ChunkEncoder:
    """Encodes texts, each distinct chunk (a stretch between single spaces) once: in byte-level vocabularies
    a space that does not lie between white space begins a pre-token, so chunks do not touch each other.

    A worker keeps the chunks between blocks and tasks. Beyond CACHE_CHUNKS or CACHE_BYTES it keeps the more
    frequent half; that changes no result."""

    def __init__(self, special: list[str]):
        self.special = sorted(special, key=len, reverse=True)
        self.clear()

    def clear(self) -> None:
        self.chunks, self.used = Interner(), np.zeros(0, np.int64)
        self.flat, self.off, self.held = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk, as a ragged array."""
        raise NotImplementedError

    def whole(self, text: str) -> list[str]:
        """Parts of a text that cannot be split at its spaces."""
        raise NotImplementedError

    def evict(self) -> None:
        keys = list(self.chunks)
        short = np.fromiter(((len(k) if isinstance(k, str) else len(k[0])) < 200 for k in keys), bool, len(keys))
        order = np.argsort(-self.used, kind="stable")
        kept = np.sort(order[(self.used[order] > 1) & short[order]][: CACHE_CHUNKS // 2])
        flat, off = ragged_take(self.flat, self.off, kept)
        used = self.used[kept] // 2
        self.clear()
        for k in kept.tolist():
            self.chunks[keys[k]]
        self.flat, self.off, self.used = flat, off, used

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a string array without nulls) end to end, and their offsets."""
        if len(self.chunks) > CACHE_CHUNKS or self.held > CACHE_BYTES:
            self.evict()
        number = self.chunks.__getitem__
        whole = np.asarray(pc.match_substring_regex(texts, LOOSE_SPACE)).astype(bool)
        for name in self.special:
            whole |= np.asarray(pc.match_substring(texts, name)).astype(bool)
        parts = pc.split_pattern(texts.filter(pa.array(~whole)) if whole.any() else texts, " ")
        off = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        off -= off[0]
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.asarray(coded.indices)
        chunk = np.fromiter(map(number, names), np.int64, len(names))[at] if len(at) else np.zeros(0, np.int64)
        # a tuple as key: no space before the chunk
        chunk[off[:-1]] = np.fromiter((number((names[k],)) for k in at[off[:-1]].tolist()), np.int64, len(off) - 1)
        if whole.any():
            rows = [[number((p,)) for p in self.whole(t)] for t in texts.filter(pa.array(whole)).to_pylist()]
            chunk = np.concatenate((chunk, np.array([c for r in rows for c in r], np.int64)))
            off = np.concatenate((off, off[-1] + np.cumsum([len(r) for r in rows], dtype=np.int64)))
            place = np.empty(len(texts), np.int64)
            place[np.concatenate((np.flatnonzero(~whole), np.flatnonzero(whole)))] = np.arange(len(texts))
            chunk, off = ragged_take(chunk, off, place)
        known = len(self.off) - 1
        if known < len(self.chunks):
            fresh = [" " + k if isinstance(k, str) else k[0] for k in itertools.islice(self.chunks, known, None)]
            flat, ends = self.learn(fresh)
            self.flat, self.off = np.concatenate((self.flat, flat)), np.concatenate((self.off, self.off[-1] + ends[1:]))
            self.held += sum(map(len, fresh))
        self.used = np.bincount(chunk, minlength=len(self.chunks)) + np.pad(self.used, (0, len(self.chunks) - len(self.used)))
        ids, starts = ragged_take(self.flat, self.off, chunk)
        return ids, starts[off]


class BlockEncoder(ChunkEncoder):
    """Merges the new chunks of a block together by the pair occurrence index."""

    def __init__(self, bpe: PairIndexBPE):
        self.bpe = bpe
        super().__init__(list(bpe.special))

    def whole(self, text: str) -> list[str]:
        if not self.special:
            return self.bpe.pattern.findall(text)
        parts = []
        for k, part in enumerate(re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)):
            parts += [part] if k % 2 else self.bpe.pattern.findall(part)
        return parts

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        find, special = self.bpe.pattern.findall, self.bpe.special
        pre = Interner()
        members: list[int] = []
        counts = np.empty(len(chunks), np.int64)
        for i, chunk in enumerate(chunks):
            parts = [chunk] if chunk in special else find(chunk)
            members += map(pre.__getitem__, parts)
            counts[i] = len(parts)
        flat, off = self.bpe.merge([b"" if w in special else w.encode() for w in pre])
        if named := [(i, special[w]) for w, i in pre.items() if w in special]:
            lens = np.diff(off)
            lens[[i for i, _ in named]] = 1
            flat = np.insert(flat, off[[i for i, _ in named]], [v for _, v in named])
            off = np.concatenate(([0], np.cumsum(lens)))
        ids, starts = ragged_take(flat, off, np.array(members, np.int64))
        return ids, np.concatenate(([0], starts[np.cumsum(counts)]))


@kept(2)
def block_encoder(path: str) -> BlockEncoder:
    return BlockEncoder(load_bpe(path))


def text_array(table: pa.Table) -> pa.Array:
    return readable(table.column("text").combine_chunks())


def _pass(path: str, decoded: bool):
    def run(batches):
        bpe = load_bpe(path)
        encoder = block_encoder(path)
        for table in blocks(batches, MERGE_BYTES):
            ids, off = encoder.encode(text_array(table))
            ids = ids.astype("<u4")
            columns = [table.column("id").combine_chunks(), pa.array(np.diff(off)), binary_array(ids, off * 4)]
            names = ["id", "n_tokens", "ids"]
            if decoded:
                columns.append(pa.array(bpe.decode(ids, off), pa.string()))
                names.append("decoded")
            yield from pa.table(columns, names).combine_chunks().to_batches(max_chunksize=2000)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """(id, n_tokens long, ids binary: little-endian unsigned 32-bit; with ``decoded`` also the text that
    decoding these ids gives). One narrow pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded
    out = id_and_text(docs, id_col, text_col).mapInArrow(_pass(path or tokenizer_path(), decoded), schema)
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text string) of packed ids; null ids give an empty text. Ids outside the vocabulary raise."""
    kind = tokens.schema[id_col].dataType.simpleString()
    path = path or tokenizer_path()

    def run(batches):
        bpe = load_bpe(path)
        for table in blocks(batches, BLOCK_IDS):
            packed = [b or b"" for b in table.column("text").to_pylist()]
            off = np.concatenate(([0], np.cumsum([len(b) // 4 for b in packed]))).astype(np.int64)
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
            yield from pa.table([table.column("id").combine_chunks(), pa.array(bpe.decode(ids, off), pa.string())], ["id", "text"]).to_batches(max_chunksize=2000)

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("text")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
