"""Conversation prefix trie by an LCP-aware external mergesort.

A conversation is a sequence of turns; two turns are the same if role and text are. Every distinct sequence of the
first d turns is a node. Turns travel as 16-byte digests (MD5) with the size of their text, so a conversation is a
short binary key whose order puts conversations with a common beginning side by side.

Equal conversations are one row before the sort. Keys are dealt to tasks by ranges; a task sorts each Arrow batch into
a run that carries the number of turns each key shares with the one before (LCP), and a loser tree merges the runs by
these numbers, so that shared turns are never compared again. A stack holds the path of open nodes; what a key no
longer shares is finished and leaves the stack with its totals.

A node whose conversations lie in several ranges is finished in parts. It must be an ancestor of the first or last
key of a task, so tasks mark those rows, and parts are summed afterwards with the double counts taken off again.

Turns are ordered by ``turn`` (null first), of equal ones by role and digest. Null role or text is empty; rows
without a conversation id belong to no conversation and are left out; repeated rows are turns of their own. Ids are
integers. An empty table gives no nodes. Other columns are left behind. The digests of one conversation (some 40 bytes
a turn) must fit in a row.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, cut, trimmed

#: Bytes of a turn's digest; member ids that are listed together; turns that one task sorts.
WIDTH, MEMBERS, TASK_TURNS = 16, 4096, 200_000
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PARTS = f"part int, side int, again boolean, leaf int, h binary, parent_h binary, bytes long, {NODES}"
EMPTY = hashlib.sha256().hexdigest()


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, digest, bytes): a row a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def spliced(turns: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """(conv_id, key, sizes): conversation c as the first h turns of conversation c - c % ``group`` and its own
    turns after its first h, with h = crc32(c as text) % (``most`` + 1). One shuffle, by group."""
    dealt = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).repartition("base")
    own = dealt.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "bytes"))).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, most))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    after = F.slice(F.col("own"), F.col("h") + 1, F.size("own"))
    whole = own.withColumn("head", head).withColumn("h", h).select("conv_id", F.when(F.col("head").isNull(), after).otherwise(F.concat(F.slice(F.col("head"), F.lit(1), F.col("h")), after)).alias("turns"))
    return keyed(whole)


def as_they_are(turns: DataFrame) -> DataFrame:
    """(conv_id, key, sizes) of the conversations themselves."""
    return keyed(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "bytes"))).alias("turns")))


def keyed(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """(key, sizes, n, conv_id, ends_sha256): equal conversations as one row with their number, smallest id and the
    SHA-256 of their ids in order. Ids are listed in spans of ``MEMBERS``, so that no row holds more; a task hashes
    the lists of a key one after the other and holds one of them."""
    span = F.floor(F.col("conv_id") / MEMBERS).alias("span")
    lists = conversations.groupBy("key", span).agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    lists = lists.select("key", "span", "sizes", "n", F.col("ids")[0].alias("conv_id"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("key", "sizes", "n", "conv_id", "ids")), strict=True)

    @trimmed
    def run(batches):
        out = []
        for key, group in itertools.groupby(rows(batches), lambda r: r[0]):
            total, least, sizes, sha = 0, None, None, hashlib.sha256()
            for _, sizes, n, conv_id, ids in group:
                sha.update((ids if least is None else f",{ids}").encode())
                least = conv_id if least is None else least
                total += n
            out.append((key, sizes, total, least, sha.hexdigest()))
            if len(out) == 1000:
                yield batch_of(out, SEQUENCES)
                out = []
        yield batch_of(out, SEQUENCES)

    return lists.repartition("key").sortWithinPartitions("key", "span").mapInArrow(run, "key binary, sizes array<long>, n long, conv_id long, ends_sha256 string")


SEQUENCES = pa.schema([("key", pa.binary()), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])


def batch_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# ------------------------------------------------------------ runs and their merge


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two keys have in common, of which ``known`` are not compared."""
    at, end = known * WIDTH, min(len(a), len(b))
    while at < end and a[at : at + WIDTH] == b[at : at + WIDTH]:
        at += WIDTH
    return at // WIDTH


def sorted_run(keys: list[bytes]) -> tuple[list[int], list[bytes], list[int]]:
    """Places, keys and LCPs of keys in order; an LCP tells how many turns a key shares with the one before."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    ranked = [keys[k] for k in order]
    return order, ranked, [0, *map(shared_turns, ranked, ranked[1:])]


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place, LCP with the key before) of all keys in order, by a tree of losers.

    Each head knows how many turns it shares with the last key given out. Of two heads the one that shares more comes
    first; only equal numbers need a comparison, which starts after the shared turns and tells the loser how many it
    shares with the winner."""
    n = len(runs)
    at, common, losers = [0] * n, [0] * n, [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        if at[a] == len(runs[a][0]):
            return b, a
        if at[b] == len(runs[b][0]):
            return a, b
        if common[a] != common[b]:
            return (a, b) if common[a] > common[b] else (b, a)
        x, y = runs[a][0][at[a]], runs[b][0][at[b]]
        m = shared_turns(x, y, common[a])
        win, lose = (a, b) if x[m * WIDTH : (m + 1) * WIDTH] <= y[m * WIDTH : (m + 1) * WIDTH] else (b, a)
        common[lose] = m
        return win, lose

    def enter(node: int) -> int:
        """The winner below a node of the tree, whose leaves n to 2n - 1 are the runs; the loser stays there."""
        if node >= n:
            return node - n
        winner, losers[node] = play(enter(2 * node), enter(2 * node + 1))
        return winner

    winner = enter(1) if n else 0
    while n and at[winner] < len(runs[winner][0]):
        yield winner, at[winner], common[winner]
        at[winner] += 1
        if at[winner] < len(runs[winner][0]):
            common[winner] = runs[winner][1][at[winner]]
        node = (winner + n) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


class OpenNode:
    """A node on the path from the root to the current key."""

    __slots__ = ("bytes", "children", "ends", "first", "least", "leaves", "n", "saved", "waiting")

    def __init__(self, size: int, first: bool):
        self.bytes, self.first, self.n, self.least, self.children, self.leaves, self.saved, self.ends = size, first, 0, None, 0, 0, 0, EMPTY
        self.waiting: list[list] = []  # rows of finished children, which lack the node's smallest id

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


def path_hashes(key: bytes) -> list[bytes]:
    """A name for every prefix of a key, from the root on."""
    out = [hashlib.md5(b"root").digest()]
    for k in range(0, len(key), WIDTH):
        out.append(hashlib.md5(out[-1] + key[k : k + WIDTH]).digest())
    return out


def finished_nodes(stream: Iterator[tuple[bytes, int, list[int], int, int, str]], part: int) -> Iterator[list]:
    """Rows of PARTS from (key, LCP, sizes, n, conv_id, ends_sha256) in the order of keys. Ancestors of the first key
    have side 0, of the last one side 1 (``again`` if they are both), others -1."""
    path: list[OpenNode] = []
    key, names = b"", []

    def close(sides: list[int], chain: list[bytes]) -> Iterator[list]:
        node, depth = path.pop(), len(path)
        leaf = int(not node.children)
        node.leaves += leaf
        node.saved += (node.n - 1) * node.bytes
        h, up = (chain[depth], chain[depth - 1] if depth else None) if sides else (None, None)
        for child in node.waiting:
            if sides:
                child[5] = h
            else:
                child[9] = node.least
            yield child
        row = [part, -1, False, leaf, h, up, node.bytes, node.least, depth, None, node.n, node.children, node.leaves, node.saved, node.ends]
        for k, side in enumerate(sides):
            yield [*row[:1], side, k > 0, *row[3:]]
        if path:
            above = path[-1]
            above.add(node.n, node.least)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            above.waiting += [] if sides else [row]

    for key_now, lcp, sizes, n, conv_id, ends in stream:
        begin = not names
        if begin:
            names = path_hashes(key_now)
        while len(path) > lcp + 1:
            yield from close([0] if path[-1].first else [], names)
        key = key_now
        for depth in range(len(path), len(key) // WIDTH + 1):
            path.append(OpenNode(sizes[depth - 1] if depth else 0, begin))
        path[-1].add(n, conv_id)
        path[-1].ends = ends
    last = path_hashes(key)
    while path:
        yield from close([0, 1] if path[-1].first else [1], last)


def node_parts(sequences: DataFrame, tasks: int) -> DataFrame:
    """Nodes, or their parts, of every range of keys."""
    names = [f.split()[0] for f in PARTS.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(name, kinds[f.split()[1]]) for name, f in zip(names, PARTS.split(", "), strict=True)])

    @trimmed
    def run(batches):
        held, runs = [], []
        for batch in batches:
            order, keys, lcps = sorted_run(batch.column("key").to_pylist())
            runs.append((keys, lcps))
            held.append(batch.select(["sizes", "n", "conv_id", "ends_sha256"]).take(pa.array(order)))

        def stream():
            for r, k, lcp in merged(runs):
                b = held[r]
                yield runs[r][0][k], lcp, *(b.column(c)[k].as_py() for c in range(4))

        out = []
        for row in finished_nodes(stream(), TaskContext.get().partitionId()):
            out.append(row)
            if len(out) == 1000:
                yield batch_of(out, schema)
                out = []
        yield batch_of(out, schema)

    return sequences.repartitionByRange(tasks, "key").mapInArrow(run, PARTS)


def joined_parts(parts: DataFrame) -> DataFrame:
    """Nodes from parts. A node in k ranges has been counted k times where once was due: each of its k parts took one
    conversation off its savings, its parent counts it k times, and a part that was a leaf is none."""
    spine = cut(parts.filter("side >= 0"))  # the paths to the ends of each range
    same = spine.filter("NOT again").groupBy("h").agg(
        F.count("*").alias("k"), F.max("bytes").alias("bytes"), F.max("depth").alias("depth"), F.max("parent_h").alias("parent_h"), F.min("conv_id").alias("conv_id"), F.sum("leaf").alias("leaf"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.coalesce(F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))), F.lit(EMPTY)).alias("ends_sha256"), F.min(F.struct("part", "side")).alias("home"),
    )
    same = cut(same)
    split = same.filter("k > 1")
    at_home = F.col("home") == F.struct("part", "side")
    chain = spine.select("h", "part", "side", "depth").join(split.select("h", "home", ((F.col("k") - 1) * F.col("bytes")).alias("more"), "leaf"), "h")
    below = Window.partitionBy("part", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    due = chain.select("h", F.sum(F.when(at_home, F.col("more")).otherwise(0)).over(below).alias("more"), F.sum(F.when(at_home, F.col("leaf")).otherwise(0)).over(below).alias("less"))
    due = due.groupBy("h").agg(F.sum("more").alias("more"), F.sum("less").alias("less"))
    twice = split.filter("parent_h is not null").groupBy(F.col("parent_h").alias("h")).agg(F.sum(F.col("k") - 1).alias("twice"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = same.join(due, "h", "left").join(twice, "h", "left").select(
        "h", "parent_h", "conv_id", "depth", "n_convs", (F.col("n_children") - zero("twice")).alias("n_children"), (F.col("n_leaves") - zero("less")).alias("n_leaves"), (F.col("saved_tokens") + zero("more")).alias("saved_tokens"), "ends_sha256",
    )
    whole = cut(whole)
    names = [f.split()[0] for f in NODES.split(", ")]
    upper = whole.join(whole.select(F.col("h").alias("parent_h"), F.col("conv_id").alias("parent_conv_id")), "parent_h", "left").select(*names)
    # a range's own copy of its marked nodes, so that the children of a node in all ranges meet many rows, not one
    near = spine.filter("NOT again").select("part", "h").join(whole.select("h", F.col("conv_id").alias("up")), "h").select("part", F.col("h").alias("parent_h"), "up")
    lower = parts.filter("side < 0").join(near, ["part", "parent_h"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).select(*names)
    return lower.unionByName(upper)


def trie(conversations: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """Nodes (NODES) of (conv_id, key, sizes). A node's text is turn ``depth`` of conversation ``conv_id``."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    sequences = cut(distinct_sequences(conversations))
    turns = sequences.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-turns // task_turns))
    return joined_parts(cut(node_parts(sequences, tasks)))
