"""Toxicity: a logistic classifier over words and word stems with counterfactual regularisation.

Identity terms in the labelled sentences are swapped for terms of another group, and the squared change of
the score is penalised, so that the model does not learn to mark a neutral mention of a group.

Features are the presence of a word and of the first STEMS letters of longer words (inflected languages), known
by their CRC-32. Both classes weigh half of the loss, so 0.5 is the point where a text is as likely under either
class, however rare toxic texts are; an L1 term leaves out features that tell nothing.

Fitted on a bounded sample: MAX_ROWS labelled documents in expectation, chosen by a hash of the id, of which
toxic ones may fill half. All features that occur in MIN_DOCS documents of the sample are offered to the fit.

Defined results: null and empty texts get the score of the intercept; bytes that are no UTF-8 count as U+FFFD;
labels that are null are not learned from; several labels of a document count as toxic if one is; with no label,
none of one class, or no feature that tells the classes apart, every score is the share of toxic labels; extra
columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, bounded_batches, cut, trimmed

MAX_ROWS, MIN_DOCS, STEMS = 16_000, 2, (5, 7)
PENALTY, SPARSITY, ROUNDS, GROW, CACHE_WORDS = 1.0, 2e-4, 400, 400, 300_000
WORD = re.compile(r"[^\W\d_]+")
#: Terms that name groups of people, a group's terms in the order in which they are swapped.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("transgender", "cisgender"),
    ("immigrant", "native", "refugee", "citizen"),
    ("immigrants", "natives", "refugees", "citizens"),
    ("deaf", "blind", "disabled", "old", "young", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("schwule", "lesben", "heterosexuelle"),
    ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("immigrés", "réfugiés", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
    ("inmigrantes", "refugiados", "ciudadanos"),
)


def swaps() -> dict[str, str]:
    """Each term and the next of its group; of a term in several groups, the first group's."""
    out: dict[str, str] = {}
    for group in IDENTITY_TERMS:
        for k, term in enumerate(group):
            out.setdefault(term, group[(k + 1) % len(group)])
    return out


def word_features(word: str) -> tuple[int, ...]:
    marked = [f"={word}", *(f"^{word[:n]}" for n in STEMS if len(word) >= n)]
    return tuple(zlib.crc32(m.encode("utf-8", "replace")) for m in marked)


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


class ToxicityModel:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.hits: dict[str, tuple[int, ...]] = {}  # features with a weight of the words met so far

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "hits": {}}

    def total(self, text: str) -> float:
        hits, weights, found = self.hits, self.weights, set()
        for w in words_of(text):
            got = hits.get(w)
            if got is None:
                got = hits[w] = tuple(f for f in word_features(w) if f in weights)
            if got:
                found.update(got)
        return sum(map(weights.__getitem__, sorted(found)))

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.hits) > CACHE_WORDS:
            self.hits = {}
        z = np.fromiter(map(self.total, texts), np.float64, len(texts))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -60, 60)))


class Ragged:
    """A sparse matrix by entries (row, column, value); ``value`` None stands for ones."""

    def __init__(self, row: np.ndarray, col: np.ndarray, rows: int, cols: int, value: np.ndarray | None = None):
        self.row, self.col, self.rows, self.cols, self.value = row, col, rows, cols, value

    def dot(self, w: np.ndarray) -> np.ndarray:
        v = w[self.col]
        return np.bincount(self.row, v if self.value is None else v * self.value, self.rows)

    def back(self, r: np.ndarray) -> np.ndarray:
        v = r[self.row]
        return np.bincount(self.col, v if self.value is None else v * self.value, self.cols)

    def columns(self, chosen: np.ndarray) -> Ragged:
        """The columns for which ``chosen`` is true, numbered anew."""
        place, keep = np.cumsum(chosen) - 1, chosen[self.col]
        return Ragged(self.row[keep], place[self.col[keep]], self.rows, int(chosen.sum()), None if self.value is None else self.value[keep])


def slope(x: Ragged, moved: Ragged, y: np.ndarray, share: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Gradient of the weighted log loss and of the counterfactual penalty."""
    r = share * (1 / (1 + np.exp(-np.clip(x.dot(w) + b, -60, 60))) - y)
    g = x.back(r)
    if moved.rows:
        g = g + 2 * PENALTY / len(y) * moved.back(moved.dot(w))
    return g, float(r.sum())


def descend(x: Ragged, moved: Ragged, y: np.ndarray, share: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient steps with restarts (FISTA) from (w, b)."""
    u, ub, size = np.ones(len(w)), 1.0, 1.0
    for _ in range(10):  # the largest curvature, by power iteration
        r = 0.25 * share * (x.dot(u) + ub)
        u, ub = x.back(r) + (2 * PENALTY / len(y) * moved.back(moved.dot(u)) if moved.rows else 0.0), float(r.sum())
        size = float(np.sqrt(u @ u + ub * ub)) or 1.0
        u, ub = u / size, ub / size
    step, t = 1 / (1.05 * size), 1.0
    at, at_b = w, b
    for _ in range(ROUNDS):
        g, gb = slope(x, moved, y, share, at, at_b)
        new, new_b = at - step * g, at_b - step * gb
        new = np.sign(new) * np.maximum(np.abs(new) - step * SPARSITY, 0)
        move = new - w
        if (at - new) @ move > 0:
            t, at, at_b = 1.0, new, new_b
        else:
            later = (1 + np.sqrt(1 + 4 * t * t)) / 2
            at, at_b, t = new + (t - 1) / later * move, new_b + (t - 1) / later * (new_b - b), later
        done = max(np.abs(move).max(initial=0), abs(new_b - b)) < 3e-4
        w, b = new, new_b
        if done:
            break
    return w, b


def train_matrix(x: Ragged, moved: Ragged, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept. ``moved``: for each row that names a group, its features less those of the row with
    the terms swapped. Works on the features whose slope exceeds SPARSITY, and looks at all until none is left."""
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b, open_ = np.zeros(x.cols), 0.0, np.zeros(x.cols, bool)
    while True:
        g, _ = slope(x, moved, y, share, w, b)
        wanted = np.where(open_, 0.0, np.abs(g))
        more = wanted > 1.02 * SPARSITY
        if not more.any():
            return w, b
        open_[np.argsort(-wanted, kind="stable")[: min(GROW, int(more.sum()))]] = True
        inner, b = descend(x.columns(open_), moved.columns(open_), y, share, w[open_], b)
        w = np.zeros(x.cols)
        w[open_] = inner


def matrices(ids: list[np.ndarray], swapped: list[np.ndarray]) -> tuple[np.ndarray, Ragged, Ragged]:
    """Features in MIN_DOCS rows (all of swapped rows besides), the rows' matrix, and that of what a swap changes."""
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    kinds, n = np.unique(flat, return_counts=True)
    kept = kinds[n >= MIN_DOCS]
    col = np.full(len(flat), -1, np.int32)
    for k in range(0, len(flat) if len(kept) else 0, 1 << 20):
        part = flat[k : k + (1 << 20)]
        at = np.minimum(np.searchsorted(kept, part), len(kept) - 1)
        col[k : k + (1 << 20)] = np.where(kept[at] == part, at, -1)
    x = Ragged(np.repeat(np.arange(len(ids), dtype=np.int32), lens)[col >= 0], col[col >= 0], len(ids), len(kept))
    row, where, value, rows = [], [], [], 0
    for a, b in zip(ids, swapped, strict=True):
        if len(b):
            for sign, some in ((1.0, np.setdiff1d(a, b)), (-1.0, np.setdiff1d(b, a))):
                at = np.minimum(np.searchsorted(kept, some), max(len(kept) - 1, 0))
                at = at[kept[at] == some] if len(kept) else at[:0]
                row.append(np.full(len(at), rows))
                where.append(at)
                value.append(np.full(len(at), sign))
            rows += 1
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return kept, x, Ragged(join(row, np.int64), join(where, np.int64), rows, len(kept), join(value, np.float64))


def ragged_rows(lists: pa.ListArray) -> list[np.ndarray]:
    flat, off = np.asarray(lists.values).view(np.uint32), np.asarray(lists.offsets)
    return [flat[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """``labels``: the rows that may be learned from."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    total, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    if not total or not toxic or toxic == total:
        share = min(max((toxic or 0) / total if total else 0.0, 1e-6), 1 - 1e-6)
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("id").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    most = max(MAX_ROWS // 2, MAX_ROWS - (total - toxic))
    rate = F.when(F.col("y") == 1, min(1.0, most / toxic)).otherwise(min(1.0, max(MAX_ROWS // 2, MAX_ROWS - toxic) / (total - toxic)))
    picked = rows.groupBy("id").agg(F.max("y").alias("y")).filter(draw < rate)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    bounded_batches(docs.sparkSession)
    terms = swaps()

    def bags(batches):
        cache: dict[str, tuple[int, ...]] = {}

        def features(words):
            found: set[int] = set()
            for w in words:
                got = cache.get(w)
                if got is None:
                    got = cache[w] = word_features(w)
                found.update(got)
            return sorted(found)

        for batch in batches:
            ids, swapped = [], []
            packed = lambda found: np.array(found, np.uint32).view(np.int32)
            for text in batch.column("text").to_pylist():
                words = words_of(text.decode("utf-8", "replace"))
                ids.append(packed(features(words)))
                swapped.append(packed(features({terms.get(w, w) for w in words}) if words & terms.keys() else []))
            if len(cache) > CACHE_WORDS:
                cache.clear()
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("place"), pa.array(ids, kind), pa.array(swapped, kind)], ["y", "place", "ids", "swapped"])

    # the labels drawn are MAX_ROWS rows: small enough to broadcast, and to fit on one machine
    sample = texts.join(F.broadcast(picked), "id").select("y", F.xxhash64("id", "text").alias("place"), "text").mapInArrow(bags, "y int, place long, ids array<int>, swapped array<int>")
    got = cut(sample).toArrow()
    y = np.asarray(got.column("y").combine_chunks()).astype(np.float64)
    n1, n = y.sum(), len(y)
    if not n1 or n1 == n:
        return ToxicityModel({}, float(np.log(max(n1, 0.5) / max(n - n1, 0.5))))
    order = np.argsort(np.asarray(got.column("place").combine_chunks()), kind="stable")  # the same sums on every run
    ids, swapped = (ragged_rows(got.column(c).combine_chunks()) for c in ("ids", "swapped"))
    del got
    kept, x, moved = matrices([ids[k] for k in order], [swapped[k] for k in order])
    del ids, swapped
    w, b = train_matrix(x, moved, y[order])
    if not w.any():  # nothing tells the classes apart
        b = np.log(toxic / (total - toxic))
    return ToxicityModel({int(f): float(v) for f, v in zip(kept, w, strict=True) if v}, float(b))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds nothing but (id, score double): one narrow pass over whole texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the weights that the sample of MAX_ROWS gives

    bounded_batches(docs.sparkSession)

    def run(batches):
        for table in blocks(batches, 8 << 20):
            got = shared.value.score([b.decode("utf-8", "replace") for b in table.column("text").to_pylist()])
            yield from pa.table([table.column("id").combine_chunks(), pa.array(got)], ["id", "score"]).to_batches()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def accept(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents that the model does not call toxic (score below 0.5), all columns as they were."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        at = names.index(text_col)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                got = shared.value.score([(t or b"").decode("utf-8", "replace") for t in part.column(at).cast(pa.binary()).to_pylist()])
                yield part.filter(pa.array(got < 0.5))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(trimmed(run), docs.schema)
