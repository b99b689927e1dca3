"""Host graph, conversation trie and resampling: against brute force, against SQL, and on odd tables."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import hostgraph, prefixtrie, queries, resampling


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def by_sql(name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(f"{table}_pd", df.toPandas())
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM {table}_pd")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def clashing(df, *names):
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])


# ------------------------------------------------------------ host graph


PAGES = "page_id long, url string, html string"


def web(seed=3, hosts=40, pages=400):
    r = random.Random(seed)
    names = [f"h{k}.{r.choice(['com', 'net', 'org', 'example.org'])}" for k in range(hosts)]
    link = lambda: r.choice(['<a href="http://{}/x">', "<a class=b HREF='//{}?q'>", "<a href=https://{}>", '<a href="/local">{}</a>']).format(r.choice([r.choice(names), r.choice(names).upper(), names[0]]))
    rows = [(k, f"http{r.choice(['', 's'])}://{r.choice([names[0], r.choice(names)])}/{r.choice(['en', 'de', 'fr', 'es', 'en/1'])}/{k}{r.choice(['', '?a=1', '#t', '/'])}", "".join(link() for _ in range(r.randint(0, 5)))) for k in range(pages)]
    return [*rows, (None, None, None), (7, "no scheme", "<a href='http://h1.com'>"), (7, "no scheme", "<a href='http://h1.com'>"), (900, "x://", None), (901, "http://Ärger.COM?x", ""), (902, "a://com/de/\nb://h.org/", "")]


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def brute_verdicts(rows, rules, rounds=50):
    judged = []
    for page, url, html in rows:
        host, path = split_url(url)
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged.append((page, host, path, html or "", *(max(fit)[1:] if fit else (None, None))))
    links = collections.Counter()
    for _, host, _, html, _, _ in judged:
        for other in {m.lower() for m in re.findall(r"""(?i)href=["']?(?:https?:)?//([^/?#"'\s<>]+)""", html)} - {host}:
            links[host, other] += 1 if host else 0
    ranks = {}
    for kind, verdict, turned in (("trust", "allow", False), ("distrust", "block", True)):
        seed = collections.Counter(j[1] for j in judged if j[5] == verdict)
        edges = {((b, a) if turned else (a, b)): n for (a, b), n in links.items() if n}
        nodes = sorted({*seed, *(x for e in edges for x in e)})
        at = {h: k for k, h in enumerate(nodes)}
        m, v = np.zeros((len(nodes), len(nodes))), np.zeros(len(nodes))
        for (a, b), n in edges.items():
            m[at[b], at[a]] += n
        for h, n in seed.items():
            v[at[h]] = n / sum(seed.values())
        out = m.sum(0)
        m = m / np.where(out > 0, out, 1)
        x = v.copy()
        for _ in range(rounds):
            x = 0.15 * v + 0.85 * (m @ x + v * x[out == 0].sum())
        ranks[kind] = dict(zip(nodes, x, strict=True))
    shares = {h: (ranks["trust"].get(h, 0.0), ranks["distrust"].get(h, 0.0)) for h in {*ranks["trust"], *ranks["distrust"]}}
    return judged, shares


def test_link_graph_equals_brute_force_and_sql(spark, tmp_path):
    rows = web()
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    judged, shares = brute_verdicts(rows, queries.URL_RULES)
    found = hostgraph.host_evidence(pages.select("html", *[c.alias(n) for c, n in zip(hostgraph.host_and_path(), ("host", "path"), strict=True)]).withColumn("verdict", hostgraph.matched(queries.URL_RULES)["verdict"])).collect()
    assert {r["host"] for r in found} == set(shares)
    for r in found:
        assert (r["trust"], r["distrust"]) == pytest.approx(shares[r["host"]], abs=1e-9)
    blocked = {h for h, (t, d) in shares.items() if d > 0.5 * (t + d)}
    assert blocked and len(blocked) < len(shares)
    assert min(abs(d - 0.5 * (t + d)) for t, d in shares.values()) > 1e-7
    expected = [(p, h, path, rule, verdict or ("block" if h in blocked else "allow")) for p, h, path, _, rule, verdict in judged]
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op11_host_graph(spark, str(tmp_path))
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(expected, key=repr)
    names, sql = by_sql("op11_host_graph", pages=pages)
    place = [names.index(c) for c in ("page_id", "host", "path", "rule", "verdict")]
    clean = lambda r: (None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:])
    assert sorted((clean(tuple(r[k] for k in place)) for r in sql), key=repr) == sorted(expected, key=repr)


def test_unlinked_hosts_follow_their_own_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/1", ""), (2, "http://a.com/en/1", ""), (3, "http://b.com/fr/1", ""), (4, "http://b.com/en/1", None), (5, "http://c.net/en", "")], PAGES)
    got = dict(rows_of(hostgraph.judge(pages, queries.URL_RULES), "page_id", "verdict"))
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_distrust_goes_back_along_links_and_trust_forward(spark):
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://farm.net/x", '<a href="http://bad.com/de/1">'), (3, "http://good.org/x", '<a href="http://friend.net/">'), (4, "http://friend.net/x", ""), (5, "http://far.net/", '<a href="//farm.net/x">')]
    got = dict(rows_of(hostgraph.judge(spark.createDataFrame(rows, PAGES), queries.URL_RULES, rounds=6), "page_id", "verdict"))
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block"}


def test_odd_pages(spark):
    empty = spark.createDataFrame([], PAGES)
    assert hostgraph.judge(empty, queries.URL_RULES, rounds=3).count() == 0
    pages = spark.createDataFrame(web(), PAGES)
    plain = rows_of(hostgraph.judge(pages, queries.URL_RULES, rounds=3), "page_id", "host", "path", "rule", "verdict")
    extra = clashing(pages, "id", "host", "path", "rule", "verdict", "m", "rank", "kind", "seed", "share", "src", "dst", "n", "by_links")
    assert rows_of(hostgraph.judge(extra, queries.URL_RULES, rounds=3), "page_id", "host", "path", "rule", "verdict") == plain
    assert {r["verdict"] for r in hostgraph.judge(pages, [], rounds=3).collect()} == {"allow"}  # no rules, no seeds
    long = spark.createDataFrame([(1, "http://a.org/" + "x" * 200_000, "<a href='http://b.net/'>" * 20_000)], PAGES)
    assert [r["verdict"] for r in hostgraph.judge(long, queries.URL_RULES, rounds=3).collect()] == ["allow"]


# ------------------------------------------------------------ conversation trie


TURNS = "conv_id long, turn long, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def chats(seed, n=120, kinds=3):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue  # a missing base
        for t in range(r.choice([0, 1, 2, 3, 6, 12])):
            rows.append((c, r.choice([t, t, t, None, 0]), r.choice(["user", "assistant", None, ""]), r.choice(["é" * r.randint(0, kinds), "same", None, "a b"])))
    rows += [(c, t, "user", "a very common start") for c in range(200, 240) for t in range(r.choice([2, 2, 3]))]
    rows += rows[:20] + [(None, 1, "user", "nobody's")]
    r.shuffle(rows)
    return rows


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    members = collections.defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = [(t[1], t[3]) for t in sorted(own.get(c - c % 5, []))[:h] + sorted(own[c])[h:]]
        whole[c] = tuple(seq)
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if whole[c] == p).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force_over_many_ranges(spark, seed):
    rows = chats(seed)
    whole = prefixtrie.spliced(prefixtrie.turns_of(spark.createDataFrame(rows, TURNS).repartition(7)))
    assert rows_of(prefixtrie.trie(whole, task_turns=8), *NODE) == brute_trie(rows)  # ranges of a few conversations
    assert rows_of(prefixtrie.trie(whole), *NODE) == brute_trie(rows)


def test_trie_equals_sql(spark, tmp_path):
    chat = spark.createDataFrame(chats(5), TURNS)
    chat.write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(queries.op12_prefix_trie(spark, str(tmp_path)), *NODE)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(queries.ORACLE_SQL["op12_prefix_trie"])
    names = [d[0] for d in found.description]
    assert sorted((tuple(r[names.index(c)] for c in NODE) for r in found.fetchall()), key=repr) == got


def test_members_of_a_hot_conversation_are_hashed_in_spans(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "MEMBERS", 16)
    rows = [(c, 0, "user", "x") for c in range(300)] + [(1000, 0, "user", "x"), (1000, 1, "user", "y")]
    got = rows_of(prefixtrie.trie(prefixtrie.as_they_are(prefixtrie.turns_of(spark.createDataFrame(rows, TURNS)))), *NODE)
    ids = hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()
    none = hashlib.sha256().hexdigest()
    assert got == sorted([(0, 0, None, 301, 1, 1, 300, none), (0, 1, 0, 301, 1, 1, 300, ids), (1000, 2, 0, 1, 0, 1, 0, hashlib.sha256(b"1000").hexdigest())], key=repr)


def test_merge_gives_order_and_shared_turns():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 5, 17):
        runs, every = [], []
        for _ in range(n):
            keys = [b"".join(bytes([r.randint(0, 2)]) * 16 for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 30))]
            runs.append(prefixtrie.sorted_run(keys)[1:])
            every += keys
        got = [(runs[a][0][k], lcp) for a, k, lcp in prefixtrie.merged(runs)]
        assert [k for k, _ in got] == sorted(every)
        assert all(lcp == prefixtrie.shared_turns(before, key) for (before, _), (key, lcp) in zip(got, got[1:], strict=False))


def test_odd_conversations(spark):
    assert prefixtrie.trie(prefixtrie.spliced(prefixtrie.turns_of(spark.createDataFrame([], TURNS)))).count() == 0
    rows = [(3, 0, "user", "é" * 100_000)] + [(4, t, "user", "t") for t in range(3000)]
    chat = clashing(spark.createDataFrame(rows, TURNS), "base", "own", "h", "head", "key", "sizes", "n", "part", "side", "digest", "bytes", "span", "ids", "depth")
    got = rows_of(prefixtrie.trie(prefixtrie.as_they_are(prefixtrie.turns_of(chat))), "depth", "n_leaves")
    assert len(got) == 3002 and (0, 2) in got and (3000, 1) in got


# ------------------------------------------------------------ resampling


DOCS = "doc_id long, text string"


def texts(seed, n=300):
    r = random.Random(seed)
    word = lambda: r.choice(["an", "Er", "tion", "sch", "eau", "é", "x1", "日本", "end"]) + r.choice(["", "", str(r.randint(0, 99))])
    rows = [(k, r.choice([" ", "-", "\n", ". "]).join(word() for _ in range(r.randint(0, 60)))) for k in range(n)]
    return [*rows, *rows[:9], (5, "another text of the same id " * 9), (None, "no id " * 30), (None, "no id " * 30), (n, None), (n + 1, ""), (n + 2, "x" * 60_000), (n + 3, " ".join(word() for _ in range(30_000)))]


def brute_resample(docs, target, orders=1, buckets=10_000, least=20, percent=10, seed="2024"):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    def feats(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, orders + 1) for k in range(len(w) - n + 1)]

    a, b = (collections.Counter(f for t in ts for f in feats(t)) for ts in ([t for _, t in docs], target))
    s, t = sum(a.values()), sum(b.values())
    gain = functools.cache(lambda k: math.floor(1000 * math.log((b[k] + 1) * (s + buckets) / ((a[k] + 1) * (t + buckets)))))
    out = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = feats(text)
        w = sum(map(gain, f))
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("orders", "percent", "least"), [(1, 10, 20), (2, 35, 5), (1, 100, 0), (1, 0, 20)])
def test_resampling_equals_brute_force(spark, orders, percent, least):
    docs, target = texts(1), [t for _, t in texts(2, 40)]
    got = resampling.resample(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame([(t,) for t in target], "text string"), orders=orders, percent=percent, least_words=least)
    assert rows_of(got, "doc_id", "n_features", "weight", "score", "rank") == brute_resample(docs, target, orders, percent=percent, least=least)


def test_resampling_equals_sql(spark, tmp_path):
    docs = spark.createDataFrame(texts(4), DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for _, t in texts(2, 40)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = con.execute(queries.ORACLE_SQL["op13_resampling"])
    names = [d[0] for d in found.description]
    assert sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr) == rows_of(queries.op13_resampling(spark, str(tmp_path)), *columns)


def test_scores_that_tie_are_ranked_by_id_over_ranges(spark):
    scores = spark.createDataFrame([(k % 37 - 18,) for k in range(2000)], "score long").repartition(5)
    held = {r["score"]: (r["n"], r["above"]) for r in resampling.above_each_score(scores).collect()}
    count = collections.Counter(k % 37 - 18 for k in range(2000))
    assert held == {s: (n, sum(m for t, m in count.items() if t > s)) for s, n in count.items()}
    same = spark.createDataFrame([(k, "a " * 30) for k in range(40, 0, -1)], DOCS)
    got = resampling.resample(same, same).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]


def test_odd_tables_of_resampling(spark):
    empty = spark.createDataFrame([], DOCS)
    target = spark.createDataFrame([("a b c",)], "text string")
    assert resampling.resample(empty, target).count() == 0
    docs = spark.createDataFrame(texts(3), DOCS)
    assert rows_of(resampling.resample(docs, empty), "doc_id", "n_features", "weight", "score", "rank") == brute_resample(texts(3), [])
    extra = clashing(docs, "id", "name", "score", "weight", "rank", "n_words", "n_features", "above", "part", "bucket", "n")
    assert rows_of(resampling.resample(extra, target), "doc_id", "rank") == rows_of(resampling.resample(docs, target), "doc_id", "rank")
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert resampling.resample(named, target).schema["doc_id"].dataType.simpleString() == "string"
    taken = resampling.drawn(docs.filter("doc_id > 10"), target)
    ranks = resampling.resample(docs.filter("doc_id > 10"), target).filter("rank is not null")
    assert taken.columns == docs.columns and taken.count() == ranks.count()
