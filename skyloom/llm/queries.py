"""The opN queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, hostgraph, langid, minhash, mixing, ngram_join, outliers, pii, prefixtrie, resampling, tokenstore, toxicity
from ._common import new_folder
from .langid import fold


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(_docs(spark, sf_dir), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = langid.fit(docs.filter(fold("doc_id", 5) != 0))
    return langid.predict(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ctw.score_documents(_docs(spark, sf_dir), ctw.train_fold())
    return out.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources to equal weight, as many documents as there are."""
    return mixing.mix(_docs(spark, sf_dir))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _docs(spark, sf_dir), new_folder(spark, "tokens")
    tokenstore.write_store(docs, folder)
    out = tokenstore.read_shards(spark, folder, docs.schema["doc_id"].dataType.simpleString(), digest=True)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.edit_probe(_docs(spark, sf_dir))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(_docs(spark, sf_dir))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op9_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outliers.judge(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_docs(spark, sf_dir), n=4, percent=85)


#: The production rules of op11: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op11_host_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostgraph.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixtrie.turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefixtrie.trie(prefixtrie.spliced(turns))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_langid": op2_langid,
    "op3_ctw": op3_ctw,
    "op4_mixing": op4_mixing,
    "op5_token_store": op5_token_store,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_pii": op8_pii,
    "op9_outliers": op9_outliers,
    "op10_ngram_join": op10_ngram_join,
    "op11_host_graph": op11_host_graph,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_resampling": op13_resampling,
}


def _crc32(value: str) -> str:
    """CRC-32 of a text in SQL, with the table ``tab`` of ``_TAB``."""
    raw = f"encode({value})"
    octets = f"list_transform(range(1, octet_length({raw}) + 1), lambda i: ('0x' || substr(hex({raw}), CAST(2 * i - 1 AS INTEGER), 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])))"


_TAB = "tabs AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))) AS tab)"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
ORACLE_SQL: dict[str, str] = {
    "op4_mixing": """
        WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        sums AS (SELECT count(*) AS w, sum(n) AS n FROM sizes),
        rates AS (
            SELECT s.source, CAST(1.0 AS DOUBLE) / CAST(t.w AS DOUBLE) * CAST(t.n AS DOUBLE) / s.n AS rate FROM sizes s, sums t),
        parted AS (SELECT source, rate, greatest(1, CAST(ceil(rate / 32.0) AS INTEGER)) AS parts FROM rates),
        cdf AS (
            SELECT source, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS s, rate / parts AS l FROM parted
            UNION ALL
            SELECT source, k + 1, p * l / (k + 1), s + p * l / (k + 1), l FROM cdf WHERE k < 120),
        drawn AS (
            SELECT d.*, r.rate, j.j,
                CAST(('0x' || substr(md5('1:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || j.j || ':' || md5(coalesce(d.text, ''))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
            FROM documents d JOIN parted r ON d.source IS NOT DISTINCT FROM r.source, LATERAL (SELECT unnest(range(1, r.parts + 1)) AS j) j),
        counted AS (
            SELECT w.doc_id, w.text, w.lang, w.source, w.n_chars, w.rate, w.j, count(c.k) AS c
            FROM drawn w LEFT JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND c.s <= w.u GROUP BY ALL),
        copies AS (SELECT doc_id, text, lang, source, n_chars, rate, CAST(sum(c) AS BIGINT) AS copies FROM counted GROUP BY ALL)
        SELECT doc_id, text, lang, source, n_chars, rate, CAST(copy AS INTEGER) AS copy,
            md5('1 order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy || ':' || md5(coalesce(text, ''))) AS shuffle_key
        FROM copies, LATERAL (SELECT unnest(range(0, copies)) AS copy)
    """,
    "op10_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS words FROM documents),
        sh AS MATERIALIZED (
            SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 3], ' ')) AS s
            FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i) WHERE len(words) > 0),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        met AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS MATERIALIZED (
            SELECT i, j FROM met JOIN sizes x ON x.doc_id = i JOIN sizes y ON y.doc_id = j WHERE 100 * c >= 85 * (x.n + y.n - c)),
        both_ways AS MATERIALIZED (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
        reach AS (SELECT doc_id AS i, doc_id AS j FROM documents UNION SELECT r.i, b.j FROM reach r JOIN both_ways b ON b.i = r.j),
        least AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
        FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON least.i = d.doc_id
    """,
    "op11_host_graph": f"""
        WITH RECURSIVE rules(verdict, host, path) AS (VALUES {_RULE_ROWS}),
        rest AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (
            SELECT row_number() OVER () AS k, page_id, html, {_LOWERED.format("regexp_extract(r, '^([^/?#]*)', 1)")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        fits AS (
            SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
            FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY k),
        judged AS MATERIALIZED (SELECT p.*, rule, verdict FROM parts p LEFT JOIN fits USING (k)),
        seen AS (
            SELECT DISTINCT k, host AS src, unnest(regexp_extract_all({_LOWERED.format("html")}, 'href\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\\s<>]+)', 1)) AS dst FROM judged WHERE host <> ''),
        links AS (SELECT src, dst, count(*) AS n FROM seen WHERE src <> dst GROUP BY ALL),
        edges AS (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
        shares AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM edges),
        seeds AS (SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM judged WHERE verdict IS NOT NULL GROUP BY ALL),
        start AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS seed FROM seeds),
        hosts AS MATERIALIZED (
            SELECT kind, host, max(seed) AS seed, max(o) AS o
            FROM (SELECT kind, host, seed, 0 AS o FROM start UNION ALL SELECT kind, src, 0, 1 FROM shares UNION ALL SELECT kind, dst, 0, 0 FROM shares) GROUP BY ALL),
        walk AS (
            SELECT kind, host, seed AS rank, 0 AS i FROM hosts
            UNION ALL
            SELECT h.kind, h.host, (0.15 + 0.85 * coalesce(max(idle), 0)) * h.seed + 0.85 * coalesce(sum(v.sent), 0), i + 1
            FROM (
                SELECT w.kind, w.i, s.dst, w.rank * s.share AS sent, sum(CASE WHEN s.dst IS NULL THEN w.rank ELSE 0 END) OVER (PARTITION BY w.kind) AS idle
                FROM walk w LEFT JOIN shares s ON s.kind = w.kind AND s.src = w.host WHERE w.i < 50) v
            JOIN hosts h ON h.kind = v.kind AND (v.dst = h.host OR v.dst IS NULL)
            GROUP BY h.kind, h.host, h.seed, i),
        evidence AS (
            SELECT host, sum(CASE kind WHEN 'trust' THEN rank ELSE 0 END) AS trust, sum(CASE kind WHEN 'distrust' THEN rank ELSE 0 END) AS distrust
            FROM walk WHERE i = (SELECT max(i) FROM walk) GROUP BY host)
        SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
        FROM judged j LEFT JOIN evidence USING (host)
    """,
    "op12_prefix_trie": f"""
        WITH {_TAB},
        t AS (
            SELECT conv_id, coalesce(role, '') AS role, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                octet_length(encode(coalesce(text, ''))) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
        placed AS MATERIALIZED (SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS p FROM t),
        convs AS MATERIALIZED (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), tabs),
        spliced AS (
            SELECT c.conv_id, 0 AS own, p, digest, bytes FROM convs c JOIN placed b ON b.conv_id = c.conv_id - c.conv_id % 5 AND b.p <= c.h
            UNION ALL
            SELECT c.conv_id, 1, p, digest, bytes FROM convs c JOIN placed b ON b.conv_id = c.conv_id AND b.p > c.h),
        seqs AS MATERIALIZED (
            SELECT c.conv_id, coalesce(list(digest ORDER BY own, p) FILTER (digest IS NOT NULL), []) AS turns, coalesce(list(bytes ORDER BY own, p) FILTER (digest IS NOT NULL), []) AS sizes
            FROM convs c LEFT JOIN spliced USING (conv_id) GROUP BY c.conv_id),
        steps AS MATERIALIZED (
            SELECT conv_id, d, array_to_string(turns[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(turns[1:d - 1], '') END AS above, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes, d = len(turns) AS ends
            FROM seqs, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
        nodes AS MATERIALIZED (
            SELECT node, any_value(above) AS above, any_value(d) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
                coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS members FROM steps GROUP BY node),
        kids AS MATERIALIZED (SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
        sums AS (
            SELECT a.node, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
            FROM nodes n LEFT JOIN kids k ON k.node = n.node, LATERAL (SELECT unnest(range(0, n.depth + 1)) AS d) x JOIN nodes a ON a.node = substr(n.node, 1, 32 * x.d) GROUP BY a.node)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
            CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.members) AS ends_sha256
        FROM nodes n LEFT JOIN nodes p ON p.node = n.above LEFT JOIN kids k ON k.node = n.node JOIN sums s ON s.node = n.node
    """,
    "op13_resampling": f"""
        WITH {_TAB},
        w AS MATERIALIZED (
            SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all({_LOWERED.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS words FROM documents),
        a AS MATERIALIZED (SELECT k, unnest(words) AS word FROM w),
        b AS MATERIALIZED (SELECT unnest(regexp_extract_all({_LOWERED.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
        coded AS MATERIALIZED (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM a UNION SELECT word FROM b), tabs),
        sa AS (SELECT bucket, count(*) AS n FROM a JOIN coded USING (word) GROUP BY bucket),
        sb AS (SELECT bucket, count(*) AS n FROM b JOIN coded USING (word) GROUP BY bucket),
        gains AS MATERIALIZED (
            SELECT bucket, CAST(floor(1000 * ln(((coalesce(sb.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM a) + 10000)) / ((coalesce(sa.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS gain
            FROM (SELECT DISTINCT bucket FROM coded) LEFT JOIN sa USING (bucket) LEFT JOIN sb USING (bucket)),
        sums AS (SELECT k, sum(gain) AS weight FROM a JOIN coded USING (word) JOIN gains USING (bucket) GROUP BY k),
        scores AS (
            SELECT w.k, doc_id, len(words) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS g
            FROM w LEFT JOIN sums USING (k)),
        placed AS (SELECT k, row_number() OVER (ORDER BY weight + g DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + g AS score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scores LEFT JOIN placed USING (k)
    """,
}
