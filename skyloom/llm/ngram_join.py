"""Exact n-gram Jaccard self-join of documents by T-occurrence search (DivideSkip).

A document's set holds the hashes of its distinct n-word shingles. Two documents link when
100 * |intersection| >= percent * |union|. The join finds every link between different sets, but it reports
components, not pairs:

1. Equal sets fall into one class; its representative is the smallest id.
2. Shingles are put into one global order, rare ones first (frequencies are estimated on SAMPLE_DOCS
   documents; any order is exact, a good one is fast). A set of n shingles shows the first
   n - ceil(n * percent / 100) + 1 of them: two sets that link share one of these.
3. Sets that show the same shingle and have sizes that can link are candidates. A list of up to SHORT_LIST sets
   gives its pairs, gathered in blocks by their smaller id; longer lists (the groups of many near copies)
   give star edges, whose components are blocks. A block of more than BLOCK_DOCS is dealt as pairs of chunks,
   so that no task holds more than two chunks.
4. Within a block each set is a query against the inverted lists of the sets before it. The required number T
   of common shingles decides which lists are long: candidates come from merging the short ones, and the long
   ones are probed by binary search. A candidate that is already connected is not probed again.
5. The links that blocks report, a spanning forest of each, are closed transitively.

Hashes have 64 bits. Defined results: null, empty and blank texts have no shingle and are linked with nothing
(component: their own id); a null id is reported with a null component; rows that share an id are one document
with several texts; extra columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.frames import numbered
from ._common import binary_array, blocks, cut, id_and_text, trimmed
from .graph import components
from .wordhash import HASH_BYTES, mix, shingles, words

SAMPLE_DOCS, HOT_SAMPLES, SHORT_LIST, LIST_DOCS, BUCKETS, BLOCK_DOCS, BROADCAST_ROWS = 4000, 4, 64, 4096, 256, 1500, 1_000_000


class Order:
    """Frequency levels by which shingles are ordered: small tables over the top bits of hashes."""

    def __init__(self, word_rows, shingle_rows):
        self.word = np.zeros(1 << 18, np.uint8)
        self.hot = np.zeros(1 << 20, np.uint8)
        for table, shift, rows, base in ((self.word, 46, word_rows, 0), (self.hot, 44, shingle_rows, 100)):
            for h, c in rows:
                k = (h % 2**64) >> shift
                table[k] = max(table[k], base + min(25, int(math.log2(c)) + 1))

    def levels(self, texts: list[bytes], n: int, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        w, woff = words(texts, True)
        level = self.word[(w >> np.uint64(46)).astype(np.int64)].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(level)))
        outs, count = np.diff(off), np.diff(woff)
        first = np.arange(len(h)) - np.repeat(off[:-1] - woff[:-1], outs)
        last = np.minimum(first + n, np.repeat(woff[1:], outs))
        return np.maximum(np.minimum(total[last] - total[first], 99), self.hot[(h >> np.uint64(44)).astype(np.int64)])


def sets_of(texts: list[bytes], n: int, order: Order | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in the global order, and their offsets."""
    h, off = shingles(texts, n, lower=True)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(off))
    level = order.levels(texts, n, h, off).astype(np.uint64) if order is not None else np.zeros(len(h), np.uint64)
    packed = doc << np.uint64(48) | level << np.uint64(40) | h >> np.uint64(24)
    by = np.argsort(packed, kind="stable") if len(texts) < 1 << 16 else np.lexsort((h, level, doc))
    h, doc, packed = h[by], doc[by], packed[by]
    if len(h) and ((packed[1:] == packed[:-1]) & (h[1:] != h[:-1])).any():
        again = np.lexsort((h, packed))
        h, doc = h[again], doc[again]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1, dtype=np.uint64))


def digests(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums over each set."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))))
            out.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
    return out[0], out[1]


def shown(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles a set of n shows; 0 of an empty one."""
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


class Forest:
    """Union-find; the root of a tree is its smallest position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_block(sets: list[np.ndarray], chunk: np.ndarray | None, percent: int, forest: Forest) -> None:
    """Join in ``forest`` what links among ``sets``, which are in ascending order of size. ``chunk``: sets of
    the same chunk are not compared with each other (another task does that)."""
    size = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    owner = np.repeat(np.arange(m), size)
    tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(code, kind="stable")
    lists, list_off = owner[by], np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(tokens)))))
    length = np.diff(list_off)
    starts = np.concatenate(([0], np.cumsum(size)))
    for q in range(1, m):
        nq = int(size[q])
        lowest = int(np.searchsorted(size, -(-percent * nq // 100)))  # sets before it are too small
        if lowest >= q:
            continue
        mine = code[starts[q] : starts[q + 1]]
        mine = mine[np.argsort(length[mine], kind="stable")]
        need = -(-percent * (nq + int(size[lowest])) // (100 + percent))  # T: common shingles at least
        mine_len = length[mine]
        n_long = min(need - 1, int(need / (0.05 * math.log2(max(2, int(mine_len[-1]))) + 1)))
        short, long = mine[: nq - n_long], mine[nq - n_long :]
        short = short[length[short] > 1]
        if not len(short):
            continue
        lens = length[short]
        where = np.repeat(list_off[short] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        count = np.bincount(lists[where], minlength=m)[lowest:q]
        cand = np.flatnonzero(count >= max(1, need - n_long)) + lowest
        if chunk is not None:
            cand = cand[chunk[cand] != chunk[q]]
        if not len(cand):
            continue
        own = forest.root(q)
        roots = np.array([forest.root(int(c)) for c in cand.tolist()])
        cand, roots = cand[roots != own], roots[roots != own]
        # the best of each component first; the others only where that one does not link
        by = np.lexsort((-count[cand - lowest], roots))
        cand, roots = cand[by], roots[by]
        best = np.ones(len(cand), bool)
        best[1:] = roots[1:] != roots[:-1]
        for group in (best, ~best):
            some = cand[group]
            if group is not best and len(some):
                some = some[[forest.root(int(c)) != forest.root(q) for c in some.tolist()]]
            if not len(some):
                continue
            common = count[some - lowest].copy()
            some_sorted = np.argsort(some)
            some, common = some[some_sorted], common[some_sorted]
            for t in long.tolist():
                post = lists[list_off[t] : list_off[t + 1]]
                at = np.searchsorted(post, some)
                at[at == len(post)] = 0
                common += post[at] == some
            linked = some[100 * common >= percent * (nq + size[some] - common)]
            for c in linked.tolist():
                forest.join(c, q)


def _sampled(n: int):
    def run(batches):
        for table in blocks(batches, HASH_BYTES):
            texts = table.column("text").to_pylist()
            w, _ = words(texts, True)
            h, _ = sets_of(texts, n, None)
            for kind, x in ((0, w), (1, h)):
                keys, counts = np.unique(x, return_counts=True)
                yield from pa.table([pa.array(np.full(len(keys), kind)), pa.array(keys.view(np.int64)), pa.array(counts)], ["kind", "hash", "n"]).to_batches()

    return run


def estimate_order(rows: DataFrame, n: int) -> Order:
    total = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("order"), F.col("id").cast("string")), F.lit(1 << 24)) / F.lit(float(1 << 24))
    sample = rows.filter(draw < min(1.0, SAMPLE_DOCS / max(1, total))).mapInArrow(_sampled(n), "kind long, hash long, n long")
    got = sample.groupBy("kind", "hash").agg(F.sum("n").alias("n")).filter((F.col("n") >= HOT_SAMPLES))
    top = got.filter("kind = 0").orderBy(F.desc("n"), "hash").limit(60_000).unionByName(got.filter("kind = 1").orderBy(F.desc("n"), "hash").limit(200_000))
    kept = [(r["kind"], r["hash"], r["n"]) for r in top.toLocalIterator()]
    return Order([(h, c) for k, h, c in kept if k == 0], [(h, c) for k, h, c in kept if k == 1])


def _signatures(n: int, percent: int, order):
    def run(batches):
        for table in blocks(batches, HASH_BYTES):
            h, off = sets_of(table.column("text").to_pylist(), n, order.value)
            d1, d2 = digests(h, off)
            size = np.diff(off)
            lens = shown(size, percent)
            out = np.concatenate(([0], np.cumsum(lens)))
            where = np.repeat(off[:-1] - out[:-1], lens) + np.arange(out[-1])
            tokens = pa.ListArray.from_arrays(pa.array(out.astype(np.int32)), pa.array(h[where].view(np.int64)))
            cell = np.repeat(np.arange(len(size)), size) * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64)
            counts = np.minimum(np.bincount(cell, minlength=len(size) * BUCKETS), 255).astype(np.uint8)
            sketch = binary_array(counts, np.arange(len(size) + 1) * BUCKETS)
            yield from pa.table([table.column("id").combine_chunks(), pa.array(size), pa.array(d1), pa.array(d2), tokens, sketch], ["id", "n", "d1", "d2", "tokens", "sketch"]).to_batches(max_chunksize=4000)

    return run


def _candidates(percent: int):
    """Rows sorted by token, n, node, cut into runs of one token and of sizes that can link. Short runs give
    their pairs (star 0), of longer ones the rows (token, node, star 1) are kept."""

    def run(batches):
        token, n, node = (np.zeros(0, np.int64) for _ in range(3))
        pivot = False  # whether the run that is open is long already
        for batch in _and_end(batches):
            last = batch is None
            if not last:
                more = [np.asarray(batch.column(k)) for k in range(3)]
                token, n, node = (np.concatenate(x) for x in zip((token, n, node), more, strict=True))
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, len(token)))
            run_of = np.cumsum(new) - 1
            open_run = len(start) - 1 if not last else -1
            long = length > SHORT_LIST
            if pivot:
                long[0] = True
            out = []
            star = np.flatnonzero(long[run_of])
            if len(star):
                out.append(np.stack((token[star], node[star], np.ones(len(star), np.int64)), 1))
            ready = ~long
            if open_run >= 0:
                ready[open_run] = False
            at = np.flatnonzero(ready[run_of] & (length[run_of] > 1))
            for k in range(1, SHORT_LIST):
                at = at[at + k < len(token)]
                at = at[(run_of[at + k] == run_of[at]) & (100 * n[at] >= percent * n[np.minimum(at + k, len(n) - 1)])]
                if not len(at):
                    break
                pair = np.stack((np.minimum(node[at], node[at + k]), np.maximum(node[at], node[at + k]), np.zeros(len(at), np.int64)), 1)
                out.append(pair[pair[:, 0] != pair[:, 1]])
            if out and len(rows := np.unique(np.concatenate(out), axis=0)):
                for a in range(0, len(rows), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[a : a + 100_000, k]) for k in range(3)], ["a", "b", "star"])
            if open_run >= 0 and not long[open_run]:
                keep, pivot = start[open_run], False
            else:
                keep, pivot = len(token) - 1, open_run >= 0
            token, n, node = token[keep:], n[keep:], node[keep:]

    return run


def _bounded(percent: int):
    """Pairs (a, b, na, nb, sa, sb) whose sketches allow the required overlap; a full counter allows any."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS) for c in ("sa", "sb"))
            least = np.minimum(sa, sb)
            fine = (100 + percent) * least.sum(1, dtype=np.int64) >= percent * (na + nb)
            fine |= (least == 255).any(1)
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    return run


def _list_forests(percent: int):
    """Rows sorted by token, i, j, n, node with their sketches: per list (or pair of its chunks) a spanning forest
    of the pairs that pass the bound."""

    def forest_of(node: np.ndarray, n: np.ndarray, sketch: np.ndarray, chunk: np.ndarray | None) -> np.ndarray:
        forest = Forest(len(node))
        lowest = np.searchsorted(n, -(-percent * n // 100))
        for q in range(1, len(node)):
            w = slice(int(lowest[q]), q)
            least = np.minimum(sketch[w], sketch[q])
            fine = ((100 + percent) * least.sum(1, dtype=np.int64) >= percent * (n[w] + n[q])) | (least == 255).any(1)
            if chunk is not None:
                fine &= chunk[w] != chunk[q]
            for c in (np.flatnonzero(fine) + w.start).tolist():
                forest.join(c, q)
        root = np.array([forest.root(x) for x in range(len(node))], np.int64)
        edges = np.stack((node[root], node), 1)
        return edges[edges[:, 0] != edges[:, 1]]

    names = ("token", "i", "j", "node", "n", "sketch", "chunk")

    def run(batches):
        rows, key = [], None
        for batch in _and_end(batches):
            out = []
            for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True) if batch is not None else [(None,) * 3]:
                if r[:3] != key:
                    if len(rows) > 1:
                        _, i, j, node, n, sketch, chunk = zip(*rows, strict=True)
                        out.append(forest_of(np.array(node), np.array(n), np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, BUCKETS), np.array(chunk) if i[0] != j[0] else None))
                    rows, key = [], r[:3]
                rows.append(r)
            if out and len(edges := np.unique(np.concatenate(out), axis=0)):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return run


def _and_end(batches):
    yield from batches
    yield None


def _join_blocks(n: int, percent: int):
    """Rows sorted by block, star, i, j: one (block, star, i, j) is linked at a time."""

    def links(rows: list[tuple]) -> np.ndarray:
        parts, piece, held = [], [], 0
        for r in rows:  # hashed in pieces of bounded size, whatever the block holds
            piece.append(r[5])
            held += len(r[5])
            if held > HASH_BYTES:
                parts.append(sets_of(piece, n, None))
                piece, held = [], 0
        parts.append(sets_of(piece, n, None))
        h = np.concatenate([p for p, _ in parts])
        size = np.concatenate([np.diff(o) for _, o in parts])
        off = np.concatenate(([0], np.cumsum(size)))
        d1, d2 = digests(h, off)
        ids = np.array([r[4] for r in rows], np.int64)
        kept = [k for k in np.lexsort((ids, size)).tolist() if d1[k] == rows[k][6] and d2[k] == rows[k][7]]
        ids = ids[kept]
        sets = [h[off[k] : off[k + 1]] for k in kept]
        chunk = np.array([rows[k][8] for k in kept]) if rows[0][2] != rows[0][3] else None
        forest = Forest(len(kept))
        first: dict[int, int] = {}
        for k, i in enumerate(ids.tolist()):
            forest.join(first.setdefault(i, k), k)
        if len(sets) > 1:
            link_block(sets, chunk, percent, forest)
        root = np.array([forest.root(x) for x in range(len(kept))], np.int64)
        least = np.full(len(kept), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        edges = np.stack((least[root], ids), 1)
        return edges[edges[:, 0] != edges[:, 1]]

    names = ("block", "star", "i", "j", "id", "text", "d1", "d2", "chunk")

    def run(batches):
        rows, key = [], None
        for batch in _and_end(batches):
            out = []
            slices = [batch.slice(a, 500) for a in range(0, batch.num_rows, 500)] if batch is not None else []
            for r in itertools.chain((r for part in slices for r in zip(*(part.column(c).to_pylist() for c in names), strict=True)), [(None,) * 4] * (batch is None)):
                if r[:4] != key:
                    if len(rows) > 1:
                        out.append(links(rows))
                    rows, key = [], r[:4]
                rows.append(r)
            if out and len(edges := np.concatenate(out)):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return run


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles long, component_id: the smallest id reachable by links), a row a row. Ids that are no integers
    are numbered in their own order first and come back in the end."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        return _named(docs, id_col, text_col, n, percent)
    rows = id_and_text(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    order = spark.sparkContext.broadcast(estimate_order(rows, n))  # two tables of fixed size
    signed = cut(rows.mapInArrow(_signatures(n, percent, order), "id long, n long, d1 long, d2 long, tokens array<long>, sketch binary"))
    classes = signed.filter("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    classes = cut(classes)
    listed = classes.select(F.explode("tokens").alias("token"), "n", F.col("rep").alias("node")).repartition("token").sortWithinPartitions("token", "n", "node")
    found = cut(listed.mapInArrow(trimmed(_candidates(percent)), "a long, b long, star long").distinct())
    lists = found.filter("star = 1").select(F.col("a").alias("token"), F.col("b").alias("node"))
    lists = lists.join(lists.groupBy("token").agg(F.ceil(F.count("*") / LIST_DOCS).cast("int").alias("parts")), "token")
    lists = lists.join(classes.select(F.col("rep").alias("node"), "n", "sketch"), "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("token", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "n", "node", "sketch", "chunk")
    lists = lists.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "node")
    blocked = cut(components(lists.mapInArrow(trimmed(_list_forests(percent)), "a long, b long")).withColumnRenamed("root", "block"))
    other = lambda c: blocked.select(F.col("node").alias(c), F.col("block").alias(f"{c}_block"))
    pairs = found.filter("star = 0").join(other("a"), "a", "left").join(other("b"), "b", "left").filter("a_block is null or b_block is null or a_block <> b_block")
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    pairs = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(trimmed(_bounded(percent)), "a long, b long")
    pairs = pairs.select(F.col("a").alias("block"), F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("star", F.lit(0))
    member = cut(blocked.select("block", "node", F.lit(1).alias("star")).unionByName(pairs))
    sizes = member.groupBy("block", "star").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / BLOCK_DOCS).cast("int")
    member = member.join(sizes, ["block", "star"]).join(classes.select(F.col("rep").alias("node"), "d1", "d2"), "node")
    member = member.select(F.col("node").alias("id"), "block", "star", "d1", "d2", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("chunk"))
    member = cut(member)
    small = member.count() <= BROADCAST_ROWS  # else the texts are dealt by id
    texts = rows.join(F.broadcast(member) if small else member, "id")
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("block", "star", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "id", "text", "d1", "d2", "chunk")
    dealt = dealt.repartition("block", "star", "i", "j").sortWithinPartitions("block", "star", "i", "j")
    edges = dealt.mapInArrow(trimmed(_join_blocks(n, percent)), "a long, b long")
    labels = components(edges).select(F.col("node").alias("rep"), "root")
    roots = classes.select("d1", "d2", "rep").join(labels, "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("component"))
    out = signed.drop("tokens", "sketch").join(roots, ["d1", "d2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def _named(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    names = cut(numbered(docs.select(F.col(id_col).alias("name")).filter("name is not null").distinct(), ["name"], "id"))
    found = similar_components(docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(names, "name", "left"), "id", "text", n, percent)
    of = lambda c, name: names.select(F.col("id").alias(c), F.col("name").alias(name))
    out = found.join(of("id", "name"), "id", "left").join(of("component_id", "root"), "component_id", "left")
    return out.select(F.col("name").alias(id_col), "n_shingles", F.col("root").alias("component_id"))
