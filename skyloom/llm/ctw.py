"""Language-model scoring by context-tree weighting over the bytes of whole texts.

A text is the symbols of its tokens: the bytes of a word (A-Z lower-cased) and a space, and one line feed at
the end of the text. The context of a symbol is the DEPTH bytes before it, across the ends of words; before a
text stand line feeds, which no word holds. A byte is decomposed into eight binary decisions; every context and
bit prefix has a Krichevsky-Trofimov estimate of its next bit, and the estimates of all depths are mixed with the
weights of context-tree weighting, P_w = (P_e + product of the children's P_w) / 2. In training the weights come
from all training texts; in scoring they stay as they are, and a path ends at the deepest context that the tree
holds.

There is a tree for each class of training documents (their language where one is given; languages of less than
1 / SHARE of the training documents have one tree together), and a text's probability is the mean of the trees'
probabilities of the whole text, weighted by the classes' shares of the training documents. A text's own class is
not used.

The statistics cover all training texts, and a tree keeps every cell, a context with its symbol. The trees stay
distributed: contexts that share their newest STEM bytes are one subtree, which one task grows; a subtree has
256 ** (DEPTH - STEM) contexts at most. The nodes above the subtrees, 256 ** (STEM - 1) contexts a class at
most, are grown from sums over the subtrees and go to every task. Each distinct cell is valued once.

Defined results: null and empty texts are the end token alone; with nothing to train on every bit has
probability 1/2 and the base is log10(0.1 / 0.1); repeated rows count each; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_array, blocks, bounded_batches, cut
from .langid import fold

DEPTH, STEM = 5, 3
#: Words that go to every task with their counts; all others come by a join.
HEAD_WORDS = 200_000
#: A task's distinct words are handed on, with their counts so far, beyond this many bytes.
HELD_BYTES = 32 << 20
#: Values of cells that go to every task, over all classes: those of the most frequent cells; others come by a join.
VALUE_CELLS = 8_000_000
#: Cells that a task works on at a time, and bytes of texts.
BLOCK_PAIRS, TEXT_BYTES = 300_000, 2 << 20
#: Bits of a cell without its leading 1, of a number of a text in a slice, and of a class.
CELL_BITS, TEXT_BITS, CLASS_BITS = 8 * (DEPTH + 1), 15, 7
#: Classes of at least this part of the training documents have a tree of their own.
SHARE = 100
HALF = float(np.log(0.5))


def lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; x > 0."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        shift += np.log(x)
        x = x + 1
    i = 1 / x
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + i / 12 - i**3 / 360 + i**5 / 1260 - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - float(np.log(np.pi))


def spell(words: list[bytes]) -> bytes:
    """The symbols of a text of these words, behind the DEPTH line feeds of its first context."""
    return b"\n" * DEPTH + b"".join(w + b" " for w in words) + b"\n"


#: A-Z to lower case, and all that ends a word to a space.
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")


def spelled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``spell`` gives for the lower-cased words of each text, end to end, and where each ends."""
    feeds = b"\n" * DEPTH
    raw = np.frombuffer(feeds + (b" \n" + feeds).join([t.translate(FOLDED) for t in texts]) + b" \n", np.uint8)
    gap = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(gap[1:] & (gap[:-1] | (raw[:-1] == 10)))  # the first space after a word
    data = raw[keep]
    return data, np.flatnonzero(data == 10)[DEPTH :: DEPTH + 1] + 1


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each spelled text, and the words of all, end to end."""
    at = np.flatnonzero(data == 32)  # the end of each word
    n = np.diff(np.searchsorted(at, ends), prepend=0)
    others = np.arange(len(at)) + np.repeat(DEPTH + (DEPTH + 1) * np.arange(len(ends)), n)  # symbols before it that are in no word
    return n, binary_array(data[(data != 32) & (data != 10)], np.concatenate(([0], at - others)))


def slices(data: np.ndarray, ends: np.ndarray):
    """(first text, number of cells of each text from it on, cells) of spelled texts, about TEXT_BYTES symbols at a
    time, however long a text is. A cell is the context behind a leading 1 bit (the newest byte lowest) and, in the
    lowest byte, the symbol."""
    if not len(ends):
        return
    padded = np.concatenate((np.zeros(8, np.uint8), data))
    symbol = data != 10
    symbol[ends - 1] = True  # the other line feeds only stand before a text
    starts = np.concatenate(([0], ends[:-1])) + DEPTH
    a = DEPTH
    while a < len(data):
        first = int(np.searchsorted(ends, a, "right"))
        b = min(a + TEXT_BYTES, int(ends[min(first + (1 << TEXT_BITS), len(ends)) - 1]))
        cell = np.ndarray((b - a,), ">i8", padded, a + 1, (1,)).astype(np.int64)  # the eight bytes that end at each symbol
        cell &= (1 << CELL_BITS) - 1
        cell |= 1 << CELL_BITS
        last = int(np.searchsorted(ends, b - 1, "right"))
        n = np.minimum(ends[first : last + 1], b) - np.maximum(starts[first : last + 1], a)
        yield first, np.maximum(n, 0), cell[symbol[a:b]]
        a = b


def cells(texts: list[bytes]):
    """(text, cell) arrays of texts that ``spell`` gave, slice by slice."""
    for first, n, cell in slices(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))):
        yield np.repeat(np.arange(first, first + len(n)), n), cell


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def parent(context: np.ndarray) -> np.ndarray:
    """Contexts without their oldest byte."""
    size = np.zeros(len(context), np.int64)
    for k in range(1, DEPTH + 1):
        size[context >= 1 << 8 * k] = k
    mask = (1 << 8 * np.maximum(size - 1, 0)) - 1
    return np.where(size > 0, context & mask | mask + 1, 0)


def depth_of(context: np.ndarray) -> np.ndarray:
    return sum((context >= 1 << 8 * k).astype(np.int64) for k in range(1, DEPTH + 1)) if len(context) else np.zeros(0, np.int64)


def binary(context: np.ndarray, sym: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node keys (context * 256 + bit prefix) of the eight decisions of symbols, with their zeros and ones."""
    keys, ones = [], []
    for b in range(8):
        keys.append(context << 8 | (256 + sym) >> (8 - b))
        ones.append((sym >> (7 - b) & 1) * count)
    n1 = np.concatenate(ones)
    return np.concatenate(keys), np.tile(count, 8) - n1, n1


class Level:
    """The nodes of one depth: keys, KT probability of a one, weight of the own estimate against the deeper ones."""

    def __init__(self, keys: np.ndarray, one: np.ndarray, own: np.ndarray):
        self.keys, self.one, self.own = keys, one, own


#: No nodes: keys, zeros, ones, ln of the weighted probability.
NO_KIDS = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0))


def grow(context: np.ndarray, sym: np.ndarray, count: np.ndarray, kids: tuple, deepest: int, least: int) -> tuple[dict[int, Level], tuple]:
    """Levels ``deepest`` to ``least`` of trees, from symbols counted at whole contexts and from ``kids``, nodes
    one level deeper under the keys of their parents; also the nodes of ``least`` in that form. A context of
    less than DEPTH bytes begins with a space, so nothing is deeper than it."""
    levels, at = {}, depth_of(context)
    for d in range(deepest, least - 1, -1):
        pick = at == d
        key, n0, n1 = binary(context[pick], sym[pick], count[pick].astype(np.float64))
        keys, inverse = np.unique(np.concatenate((key, kids[0])), return_inverse=True)
        n0 = np.bincount(inverse, np.concatenate((n0, kids[1])), len(keys))
        n1 = np.bincount(inverse, np.concatenate((n1, kids[2])), len(keys))
        under = inverse[len(key) :]
        has, deep = np.bincount(under, minlength=len(keys)) > 0, np.bincount(under, kids[3], len(keys))
        own = log_kt(n0, n1)
        weight = np.where(has, 1 / (1 + np.exp(np.clip(deep - own, -700, 700))), 1.0)
        levels[d] = Level(keys, (n1 + 0.5) / (n0 + n1 + 1), weight)
        kids = (parent(keys >> 8) << 8 | keys & 255, n0, n1, np.where(has, HALF + np.logaddexp(own, deep), own))
    return levels, kids


def path(levels: dict[int, Level], context: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """log10 probability of symbols after contexts; a path ends at the deepest node there is."""
    depth, chain = depth_of(context), [context]
    for _ in range(DEPTH):
        chain.append(parent(chain[-1]))
    # of each depth: the symbols that reach it and their ancestors there, shifted for a bit prefix
    reach = {}
    for d in range(DEPTH + 1):
        here = np.flatnonzero(depth >= d)
        reach[d] = here, np.stack(chain)[depth[here] - d, here] << 8
    out = np.zeros(len(context))
    for b in range(8):
        prefix, bit = (256 + sym) >> (8 - b), sym >> (7 - b) & 1
        p, open_ = np.full(len(context), 0.5), np.ones(len(context), bool)  # open: no deeper node has been found
        for d in range(DEPTH, -1, -1):
            level = levels.get(d)
            if level is None or not len(level.keys):
                continue
            here, above = reach[d]
            key = above | prefix[here]
            at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            hit = level.keys[at] == key
            here, at = here[hit], at[hit]
            own = np.where(bit[here] == 1, level.one[at], 1 - level.one[at])
            p[here] = np.where(open_[here], own, level.own[at] * own + (1 - level.own[at]) * p[here])
            open_[here] = False
        out += np.log10(p)
    return out


def _summed_words(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Each word once with the sum of its counts."""
    coded = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
    n = np.concatenate([c for _, c in parts])
    return coded.dictionary, np.bincount(coded.indices.to_numpy(), n, len(coded.dictionary)).astype(np.int64)


def _count_words(batches):
    """(word, n), n over the texts to learn from; counts of a task are summed before the shuffle."""
    held: list[tuple[pa.Array, np.ndarray]] = []

    def out():
        words, n = _summed_words(held)
        yield from pa.table([words, pa.array(n)], ["word", "n"]).to_batches(max_chunksize=50_000)

    for table in blocks(batches, TEXT_BYTES):
        texts, learn = table.column("text").to_pylist(), np.asarray(table.column("class")) >= 0
        n, words = tokens(*spelled(texts))
        # the end tokens of all texts as one more word
        part = [(words, np.repeat(learn, n)), (pa.array([b""], pa.binary()), np.array([learn.sum()]))]
        held.append(_summed_words(part))
        if sum(w.nbytes for w, _ in held) > HELD_BYTES:
            held[:] = [_summed_words(held)]
            if held[0][0].nbytes > HELD_BYTES // 2:
                yield from out()
                held.clear()
    if held:
        yield from out()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once with the sum of its counts."""
    key = np.concatenate([k for k, _ in parts])
    order = np.argsort(key)
    key, at = key[order], runs(key[order])
    return key[at], np.add.reduceat(np.concatenate([c for _, c in parts])[order], at) if len(at) else at


def _count_cells(batches):
    """(class, cell, n); counts of a task are summed before the shuffle."""
    raw: list[np.ndarray] = []  # cells behind their class, one for one
    held: list[tuple[np.ndarray, np.ndarray]] = []  # counted

    def count():
        key = np.concatenate(raw)
        raw.clear()
        key.sort()
        at = runs(key)
        held.append((key[at], np.diff(at, append=len(key))))

    def out():
        key, n = _merged(held)
        for a in range(0, len(key), 50_000):
            k = key[a : a + 50_000]
            kind, cell = (k >> CELL_BITS) - 1, k & (1 << CELL_BITS) - 1 | 1 << CELL_BITS
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(cell), pa.array(n[a : a + 50_000])], ["class", "cell", "n"])

    for table in blocks(batches, TEXT_BYTES):
        kind = np.asarray(table.column("class")).astype(np.int64) + 1
        for first, n, cell in slices(*spelled(table.column("text").to_pylist())):
            cell &= (1 << CELL_BITS) - 1
            cell |= np.repeat(kind[first : first + len(n)] << CELL_BITS, n)
            raw.append(cell)
            if sum(map(len, raw)) > 10 * BLOCK_PAIRS:
                count()
        if sum(len(key) for key, _ in held) > 20 * BLOCK_PAIRS:
            held[:] = [_merged(held)]
            if len(held[0][0]) > 10 * BLOCK_PAIRS:
                yield from out()
                held.clear()
    if raw:
        count()
    if held:
        yield from out()


def _whole_stems(batches):
    """(class, cell, n) as arrays, BLOCK_PAIRS rows or one stem at a time; rows come sorted by ``packed`` key."""
    held, size, limit = [], 0, BLOCK_PAIRS
    low = 8 * (DEPTH - STEM + 1) + CLASS_BITS  # bits below the stem

    def unpacked(key, n):
        old = 8 * (DEPTH - STEM)
        sym, older, stem = key >> CLASS_BITS & 255, key >> CLASS_BITS + 8 & (1 << old) - 1, key >> low
        return (key & (1 << CLASS_BITS) - 1) - 1, ((1 << old | older) << 8 * STEM | stem) << 8 | sym, n

    for batch in batches:
        held.append([np.asarray(batch.column(c)) for c in ("key", "n")])
        size += batch.num_rows
        if size > limit:
            key, n = (np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.searchsorted(key, key[-1] >> low << low))
            if last:
                yield unpacked(key[:last], n[:last])
            held = [[key[last:], n[last:]]]
            size = len(key) - last
            limit = max(BLOCK_PAIRS, 2 * size)
    if size:
        yield unpacked(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _subtree(block: tuple[np.ndarray, ...], k: int) -> tuple[dict[int, Level], tuple]:
    kind, cell, n = block
    pick = (kind == k) & (n > 0)
    return grow(cell[pick] >> 8, cell[pick] & 255, n[pick], NO_KIDS, DEPTH, STEM)


def _subtree_roots(batches):
    """What the nodes above the subtrees need of them: (class, key, n0, n1, total)."""
    for block in _whole_stems(batches):
        for k in np.unique(block[0][block[0] >= 0]).tolist():
            _, (key, *sums) = _subtree(block, k)
            keys, inverse = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k), pa.int32()), pa.array(keys), *[pa.array(np.bincount(inverse, x, len(keys)).astype(np.float64)) for x in sums]], ["class", "key", "n0", "n1", "total"])


def _pair_values(shared):
    def run(batches):
        tops = shared.value
        for block in _whole_stems(batches):
            at = runs(block[1])  # rows of a cell follow one another
            cell, n = block[1][at], np.add.reduceat(block[2], at)
            logs = np.stack([path(_subtree(block, k)[0] | top, cell >> 8, cell & 255) for k, top in enumerate(tops)], 1)
            for a in range(0, len(cell), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 50_000]), pa.array(n[a : a + 50_000]), _lists(logs[a : a + 50_000])], ["cell", "n", "logs"])

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel().astype(np.float64)))


def packed() -> F.Column:
    """Class, context and symbol as one number: from the top the stem, the older bytes, the symbol, the class."""
    old = 8 * (DEPTH - STEM)
    stem, older = F.col("context").bitwiseAND(F.lit((1 << 8 * STEM) - 1)), F.shiftright("context", 8 * STEM).bitwiseAND(F.lit((1 << old) - 1))
    upper = F.shiftleft(stem, old).bitwiseOR(older)
    return F.shiftleft(F.shiftleft(upper, 8).bitwiseOR(F.col("symbol")), CLASS_BITS).bitwiseOR((F.col("class") + 1).cast("long"))


def cell_values(counted: DataFrame, classes: int) -> DataFrame:
    """(cell, n, logs): the count of each cell and the log10 probability of its symbol after its context by each
    class's tree. ``counted``: (class int, context, symbol, n long); class -1 is scored but not learned from."""
    spark = counted.sparkSession
    summed = counted.select(packed().alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
    stem = F.shiftright("key", 8 * (DEPTH - STEM + 1) + CLASS_BITS)
    pairs = cut(summed.repartition(stem).sortWithinPartitions("key"))
    roots = pairs.mapInArrow(_subtree_roots, "class int, key long, n0 double, n1 double, total double").groupBy("class", "key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "total")]).toArrow()
    kind, *kids = (roots.column(c).to_numpy() for c in ("class", "key", "n0", "n1", "total"))
    none = np.zeros(0, np.int64)  # every context is DEPTH bytes long
    tops = [grow(none, none, none, tuple(c[kind == k] for c in kids), STEM - 1, 0)[0] for k in range(classes)]
    shared = spark.sparkContext.broadcast(tops)  # 256 ** (STEM - 1) contexts a class at most
    return cut(pairs.mapInArrow(_pair_values(shared), "cell long, n long, logs array<double>"))


def _cell_sums(data: np.ndarray, ends: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of each spelled text over the cells of ``keys``, and (text, cell, count) of its other cells, by text."""
    sums, others = np.zeros((len(ends), logs.shape[1])), [(np.zeros(0, np.int64),) * 3]
    for first, n, cell in slices(data, ends):
        # sorted with the text's number below the cell, a cell is looked up once and nothing is gathered at random
        cell <<= TEXT_BITS
        cell &= (1 << CELL_BITS + TEXT_BITS) - 1
        cell |= np.repeat(np.arange(len(n)), n)
        cell.sort()
        text = cell & (1 << TEXT_BITS) - 1
        at = runs(cell >> TEXT_BITS)
        each, often = cell[at] >> TEXT_BITS | 1 << CELL_BITS, np.diff(at, append=len(cell))
        row = np.searchsorted(keys, each, "right") - 1
        known = keys[row] == each
        for k in range(logs.shape[1]):
            sums[first : first + len(n), k] += np.bincount(text, np.repeat(np.where(known, logs[row, k], 0.0), often), len(n))
        rest = cell[np.repeat(~known, often)]
        at = runs(rest)
        rest, times = rest[at], np.diff(at, append=len(rest))
        order = np.argsort(rest & (1 << TEXT_BITS) - 1, kind="stable")
        others.append((first + (rest[order] & (1 << TEXT_BITS) - 1), rest[order] >> TEXT_BITS | 1 << CELL_BITS, times[order]))
    text, cell, times = (np.concatenate(c) for c in zip(*others, strict=True))  # slices follow one another, so sorted by text
    return sums, text, cell, times


def _score(shared):
    """Sums over the tokens and cells of each text that every task knows, and its others with their counts."""

    def run(batches):
        head, counts, keys, logs = shared.value  # words and their counts; cells and their values
        base = np.log10(counts + 0.1)
        for table in blocks(batches, TEXT_BYTES):
            n = table.num_rows
            data, ends = spelled(table.column("text").to_pylist())
            lens, words = tokens(data, ends)
            coded = words.dictionary_encode()
            names, number = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            names = pa.concat_arrays([names, pa.array([b""], pa.binary())])  # and the end token
            place = pc.fill_null(pc.index_in(names, value_set=head), -1).to_numpy().astype(np.int64)
            # a text's words, then the end token of each text
            word, doc = np.concatenate((number, np.full(n, len(names) - 1))), np.concatenate((np.repeat(np.arange(n), lens), np.arange(n)))
            inside = place[word] >= 0
            pair, times = np.unique(doc[~inside] * len(names) + word[~inside], return_counts=True)
            tail = pa.StructArray.from_arrays([names.take(pa.array(pair % len(names))), pa.array(times, pa.int64())], ["word", "k"])
            off = np.searchsorted(pair // len(names), np.arange(n + 1))
            doc, row = doc[inside], place[word[inside]]
            sums, text, cell, often = _cell_sums(data, ends, keys, logs)
            rest = pa.StructArray.from_arrays([pa.array(cell), pa.array(often, pa.int64())], ["cell", "k"])
            symbols = np.diff(ends, prepend=0) - DEPTH
            yield from pa.table(
                [table.column("id").combine_chunks(), pa.array(lens + 1), pa.array(symbols), pa.array(np.bincount(doc, counts[row] > 0, n).astype(np.int64)), pa.array(np.bincount(doc, base[row], n).astype(np.float64)), _lists(sums), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), tail), pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), rest)],
                ["id", "n_tokens", "n_symbols", "head_known", "head_log", "head_logs", "tail", "rest"],
            ).to_batches(max_chunksize=2000)

    return run


def head_count(words: DataFrame, most: int) -> float:
    """The least count that ``most`` words at most reach, to a sixteenth of a power of two; from a histogram."""
    level = F.floor(F.log2("n") * 16).cast("int")
    bars = sorted((r["level"], r["k"]) for r in words.filter("n > 0").groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect())  # 1,024 rows at most
    held, least = 0, float("inf")
    for at, k in reversed(bars):
        held += k
        if held > most:
            break
        least = 2 ** (at / 16) * (1 - 1e-12)
    return least


def score_documents(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang") -> DataFrame:
    """(row id, n_tokens, n_known, train_tokens long, base_score, score, bits_per_byte double) of every whole
    text; ``train`` is the condition on rows to learn from, ``class_col`` names their classes; bits_per_byte is
    the code length of the text over its bytes, a byte after each token included.

    Word counts of the whole corpus are exact. The most frequent words and cells, HEAD_WORDS and VALUE_CELLS at
    most, go to every task; the others come by joins with the few (document, word) and (document, cell) pairs
    that need them."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    named = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col else F.lit("")
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), train.alias("train"), named.alias("name"))
    sizes = cut(rows.filter("train").groupBy("name").agg(F.count("*").alias("n")))
    documents = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kinds = sizes.filter(F.col("n") * SHARE >= documents).orderBy(F.desc("n"), "name").collect()  # SHARE rows at most
    held = [r["n"] for r in kinds]
    if sum(held) < documents:
        held.append(documents - sum(held))
    classes = max(1, len(held))
    shares = [float(np.log10(n / documents)) for n in held] or [0.0]
    numbers = spark.createDataFrame([(r["name"], k) for k, r in enumerate(kinds)], "name string, number int")
    labelled = rows.join(F.broadcast(numbers), "name", "left").select(F.when(F.col("train"), F.coalesce("number", F.lit(len(kinds)))).otherwise(-1).alias("class"), "text")
    words = cut(labelled.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total, distinct = words.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    listed = words.filter(F.col("n") >= head_count(words, min(HEAD_WORDS, VALUE_CELLS))).toArrow()
    head = listed.column("word").combine_chunks()
    counted = labelled.mapInArrow(_count_cells, "class int, cell long, n long")
    values = cell_values(counted.select("class", F.shiftright("cell", 8).alias("context"), F.col("cell").bitwiseAND(F.lit(255)).alias("symbol"), "n"), classes)
    first = values.filter(F.col("n") >= head_count(values, VALUE_CELLS // classes)).select("cell", "logs").toArrow().combine_chunks()
    order = np.argsort(first.column("cell").to_numpy())
    keys = np.concatenate(([-1], first.column("cell").to_numpy()[order]))  # before all cells, none of them
    logs = np.concatenate((np.zeros((1, classes)), first.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)[order]))
    shared = spark.sparkContext.broadcast((head, listed.column("n").to_numpy(), keys, logs))  # HEAD_WORDS words and VALUE_CELLS values at most
    scored = rows.select("id", "text").mapInArrow(_score(shared), f"id {kind}, n_tokens long, n_symbols long, head_known long, head_log double, head_logs array<double>, tail array<struct<word binary, k long>>, rest array<struct<cell long, k long>>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.k").alias("k"))
    found = tail.join(words, "word").groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known"), F.sum(F.col("k") * F.log10(F.col("n") + F.lit(0.1))).alias("log"))
    rest = scored.select("row", F.explode("rest").alias("t")).select("row", F.col("t.cell").alias("cell"), F.col("t.k").alias("k"))
    sums = rest.join(values, "cell").groupBy("row").agg(*[F.sum(F.col("k") * F.col("logs")[k]).alias(f"s{k}") for k in range(classes)])
    out = scored.drop("tail", "rest").join(found, "row", "left").join(sums, "row", "left")
    base = F.col("head_log") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + 0.1 * (distinct + 1))))
    by_class = F.array(*[F.col("head_logs")[k] + F.coalesce(f"s{k}", F.lit(0.0)) + F.lit(shares[k]) for k in range(classes)])
    out = out.withColumn("by_class", by_class).withColumn("top", F.array_max("by_class"))
    more = F.aggregate("by_class", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), F.greatest(x - F.col("top"), F.lit(-300.0))))
    out = out.withColumn("score", F.col("top") + F.log10(more))
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_symbols")).alias("bits_per_byte"),
    )


def train_fold(id_col: str = "doc_id") -> F.Column:
    return fold(id_col, 10) != 0
