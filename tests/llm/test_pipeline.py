"""The pipeline's stages on small tables: each does its work on its whole input, and survives odd rows."""

import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from skyloom.llm import bpe, mixing, pii, toxicity
from tests.llm.test_operators import SF, plain_components

STAGE = dict(cp.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_join", "pii", "mixing", "bpe"]


def test_toxicity_stage(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learned = labels.filter(F.udf(lambda i: zlib.crc32(str(i).encode()) % 5 != 0, "boolean")("doc_id"))
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, learned)).collect()}
    out = STAGE["toxicity"](spark, docs, SF)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i, s in score.items() if s < 0.5}


def test_join_stage(spark, docs):
    out = STAGE["ngram_join"](spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = plain_components(texts, 5, 80)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, (_, root) in want.items() if root == i)


def test_pii_stage(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in STAGE["pii"](spark, docs, SF).collect():
        assert r["n_chars"] == len(r["text"])
        if not pii.base_spans(texts[r["doc_id"]]) and "token" not in texts[r["doc_id"]]:
            assert len(r["text"]) >= 0.9 * len(texts[r["doc_id"]])
        assert not [s for s in pii.base_spans(r["text"]) if s[0] in (0, 1)]


def test_pii_stage_memory(spark, docs, monkeypatch):
    """However long the rows of a batch, a megabyte of text is looked at together, and the encoder that an earlier
    pass keeps in the worker is freed; no row and no text is left out."""
    caught, seen, find = [], [], pii.Finder.find
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run) or self)
    monkeypatch.setattr(pii.Finder, "find", lambda self, texts: seen.append(sum(len(t.as_py().encode()) for t in texts)) or find(self, texts))
    pii.redact(docs.select("doc_id", "text"))
    bpe.block_encoder(bpe.tokenizer_path())
    texts = [f"{k} mail é{k}@b.org " + "wörd " * 40_000 for k in range(20)] + [None, "", "a@b.org", "w" * (2 << 20), None]
    out = pa.Table.from_batches(caught[0](iter([pa.RecordBatch.from_pydict({"doc_id": range(25), "text": texts})])))
    assert max(seen) == 2 << 20 and sorted(seen)[-2] <= 1 << 20 and sum(seen) == sum(len((t or "").encode()) for t in texts)
    want = [t and t.replace("a@b.org", "[email]").replace(f"{k}@b.org", "[email]") for k, t in enumerate(texts)]
    assert out.column("doc_id").to_pylist() == list(range(25)) and out.column("text").to_pylist() == want
    assert not bpe.block_encoder.cache_info().currsize


def test_mixing_stage(spark, docs):
    out = STAGE["mixing"](spark, docs, SF)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix(docs).select(*docs.columns).collect()))


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "mail me at a@b.org now", "en", None, 5), (3, "mail me at a@b.org now", "en", None, 5), (None, "no id", "de", "b", 5), (4, "w " * 40_000, "en", "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copy", F.lit(1)).withColumn("rate", F.lit(2.0))
    for data in (df, df.limit(0)):
        out = data
        for name, stage in cp.STAGES:
            out = stage(spark, out, SF)
            if name != "bpe":
                assert set(out.columns) <= set(df.columns)
        out.collect()
    assert STAGE["ngram_join"](spark, df, SF).filter("doc_id = 3").count() == 1


def test_run(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "n_tokens", "ids"]


def test_join_stage_keeps_different_texts_of_an_id(spark):
    near = " ".join(f"word{k}" for k in range(60))
    rows = [(1, "the first text of an id that is given twice over"), (1, "another quite different text under that same id here"), (2, near), (3, near + " more"), (3, "what else is said under the id of a copy stays too"), (None, near), (None, "without an id but with words of its own to keep"), (5, near), (5, near), (6, None), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'a' as source", "length(text) as n_chars")
    got = sorted(((r["doc_id"], r["text"]) for r in STAGE["ngram_join"](spark, df, SF).collect()), key=repr)
    assert got == sorted([rows[0], rows[1], rows[2], rows[4], rows[6], rows[9], rows[11]], key=repr)
