"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word backs off: its five-letter n-grams
(with word ends marked) score if any of them is known, otherwise its four-letter ones, and so on down to
single letters. A text's score is the sum over its words.

The model is fitted on a bounded sample: DOCS_PER_LANG documents of each language in expectation, chosen by
a hash of the id, and keeps every word and n-gram of them, by 64-bit hashes.

Defined results: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; bytes that
are no UTF-8 count as U+FFFD; with nothing to learn from every text is ``und``; ties go to the language first in
alphabetical order; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Interner, blocks, bounded_batches

DOCS_PER_LANG, ORDERS = 3000, (5, 4, 3, 2, 1)
SMOOTH = 0.5
LETTERS = regex.compile(r"\p{L}+")
CACHE_TOKENS = 400_000
STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def fold(id_col: str, n: int):
    """crc32 of the id as text modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(n))


def gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    off = np.concatenate(([0], np.cumsum(np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))))
    return codes, off


def gram_hashes(codes: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram that lies within a word, and the word's number."""
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for k in range(n):
            h += codes[k : len(codes) - n + 1 + k] * STEP[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    word = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = word[: len(h)] == word[n - 1 :]
    return h[inside], word[: len(h)][inside]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))


class LangModel:
    """``tables``: of words (0) and of n-grams of each order n, ascending hashes and their counts a language."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.tables = {n: (keys, self.scores(counts)) for n, (keys, counts) in tables.items()}

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros((0, len(self.langs)), np.float32)
        c = counts + SMOOTH
        logs = np.log(c / c.sum(0))
        return (logs - logs.mean(1, keepdims=True)).astype(np.float32)  # what all languages share tells nothing

    def backoff(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        left = np.arange(len(words))
        for n in ORDERS:
            if not len(left) or n not in self.tables:
                continue
            keys, table = self.tables[n]
            if not len(keys):
                continue
            h, word = gram_hashes(*gram_codes([words[i] for i in left.tolist()]), n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            for k in range(len(self.langs)):
                out[left, k] += np.bincount(word[hit], table[at[hit], k], len(left)).astype(np.float32) / n
            found = np.bincount(word[hit], minlength=len(left)) > 0
            left = left[~found]
        return out

    def score_words(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        unseen = np.arange(len(words))
        keys, table = self.tables.get(0, (np.zeros(0, np.uint64), out))
        if len(keys):
            h = word_hashes(words)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[at] == h
            out[known] = table[at[known]]
            unseen = np.flatnonzero(~known)
        if len(unseen):
            out[unseen] = self.backoff([words[i] for i in unseen.tolist()])
        return out


class Predictor:
    """Scores texts; each distinct token (a run between white space, lower-cased) is scored once."""

    def __init__(self, model: LangModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.tokens = Interner()
        self.table = np.zeros((0, len(self.model.langs) + 1), np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if len(self.tokens) > CACHE_TOKENS:
            self.clear()
        number = self.tokens.__getitem__
        rows = []
        for text in texts:
            parts = text.lower().split()
            rows.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        fresh = list(self.tokens)[len(self.table) :]
        if fresh:
            words = Interner()
            owner, member = [], []
            for i, token in enumerate(fresh):
                for w in LETTERS.findall(token):
                    owner.append(i)
                    member.append(words[w])
            scores = self.model.score_words(list(words))
            more = np.zeros((len(fresh), self.table.shape[1]), np.float32)
            for k in range(scores.shape[1]):
                more[:, k] = np.bincount(owner, scores[member, k], len(fresh)) if owner else 0
            more[:, -1] = np.bincount(owner, minlength=len(fresh)) if owner else 0
            self.table = np.concatenate((self.table, more))
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        total = np.zeros((len(rows), self.table.shape[1]), np.float64)
        if lens.sum():
            full = np.flatnonzero(lens)
            starts = np.concatenate(([0], np.cumsum(lens[full])[:-1]))
            total[full] = np.add.reduceat(self.table[np.concatenate(rows)], starts, 0, dtype=np.float64)
        sums, letters = total[:, :-1], total[:, -1] > 0
        if not sums.shape[1]:
            return ["und"] * len(texts), [0.0] * len(texts)
        top = sums.argmax(1)
        score = 1 / np.exp(np.maximum(sums - sums.max(1, keepdims=True), -700)).sum(1)
        return [self.model.langs[t] if ok else "und" for t, ok in zip(top.tolist(), letters.tolist(), strict=True)], np.where(letters, score, 0.0).tolist()


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """``train``: the rows that may be learned from."""
    rows = train.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return LangModel([], {})
    bounded_batches(train.sparkSession)
    share = F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(min(1.0, DOCS_PER_LANG / sizes[l])))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("id").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter((draw < share[F.col("lang")]) & F.col("text").isNotNull())

    def features(batches):
        place = {lang: k for k, lang in enumerate(langs)}
        words = Interner()
        number = words.__getitem__
        seen: list[tuple[np.ndarray, np.ndarray]] = []  # words' numbers * languages + language, and counts
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = LETTERS.findall(text.decode("utf-8", "replace").lower())
                ids, n = np.unique(np.fromiter(map(number, found), np.int64, len(found)), return_counts=True)
                seen.append((ids * len(langs) + place[lang], n))
            seen = [tally(seen)]
        if not words:
            return
        at, n = tally(seen)
        table = np.zeros((len(words), len(langs)), np.int64)
        table.reshape(-1)[at] = n
        names = list(words)
        codes, off = gram_codes(names)
        for kind in (0, *ORDERS):
            h, word = (word_hashes(names), np.arange(len(names))) if kind == 0 else gram_hashes(codes, off, kind)
            keys, inverse = np.unique(h, return_inverse=True)
            sums = np.stack([np.bincount(inverse, table[word, k], len(keys)) for k in range(len(langs))], 1).astype(np.int64)
            for a in range(0, len(keys), 20_000):
                part, some = keys[a : a + 20_000].view(np.int64), sums[a : a + 20_000]
                counts = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(langs), pa.int32()), pa.array(some.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind)), pa.array(part), counts], ["kind", "hash", "counts"])

    got = sample.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(features, "kind long, hash long, counts array<long>")
    sums = [F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(len(langs))]
    table = got.groupBy("kind", "hash").agg(*sums).toArrow()  # the words and n-grams of the sample
    kind, keys = np.asarray(table.column("kind")), np.asarray(table.column("hash")).view(np.uint64)
    counts = np.stack([np.asarray(table.column(f"c{k}")) for k in range(len(langs))], 1).astype(np.float64)
    tables = {}
    for n in (0, *ORDERS):
        mine = np.flatnonzero(kind == n)
        mine = mine[np.argsort(keys[mine])]
        tables[n] = keys[mine], counts[mine]
    return LangModel(langs, tables)


def tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and their counts, summed."""
    at, inverse = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
    return at, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(at)).astype(np.int64)


def predict(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; one narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words and n-grams of the sample

    bounded_batches(docs.sparkSession)

    def run(batches):
        predictor = Predictor(shared.value)
        for table in blocks(batches, 8 << 20):
            lang, score = predictor.predict([b.decode("utf-8", "replace") for b in table.column("text").to_pylist()])
            yield from pa.table([table.column("id").combine_chunks(), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"]).to_batches()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
