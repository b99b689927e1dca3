"""Quality rules and robust multivariate outliers, in DataFrame operations only.

Rules count words, symbols, repeated lines and repeated five-word windows of each whole text. Then, per
language and source, the minimum covariance determinant of the transformed statistics (log words, log word
length, log share of symbols, log share of repeated lines) is sought by concentration steps: mean and covariance
of the half of the rows that lie nearest under the last estimate. They start from three robust scatters (absolute
deviations from medians; hyperbolic tangents and spatial signs of the standardised statistics), and of the three
ends the one of least determinant is taken. Distances are scaled so that half of a group lies within the median
of a chi-square variable; a row is rejected beyond CUTOFF, its 0.999 quantile.

All steps are aggregations with partial sums. Halves are found by histograms (BIN wide), not by sorting, so that
a group of any size is no task's burden. Standard deviations are FLOORS at least, so that a statistic that is
constant in most of a group does not reject every other value.

Defined results: null, empty and blank texts have no words and fail the base rule; null languages and sources
are groups of their own; repeated rows count each; extra columns are not read. A group of fewer than POOL_ROWS
rows that pass the base rule is judged by the estimate of all rows of its language, a language of fewer by that of
the whole corpus, which is used however small it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

STEPS, BIN, POOL_ROWS, BROADCAST_GROUPS = 4, 0.02, 50, 100_000
#: Standard deviations at least, of each statistic.
FLOORS = (0.9, 0.12, 0.25, 0.5)
#: The median and the 0.999 quantile of a chi-square variable with four degrees of freedom.
CHI_HALF, CUTOFF = 3.3567, 18.467
DIM = len(FLOORS)
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r"


def stripped_of(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, g0, g1, ...: groups, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long,
    base_failed boolean), a row a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = text
    for c in BLANKS:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(spaced, " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(stripped_of(x, " " + BLANKS)) > 0)
    one = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"g{k}") for k, c in enumerate(by)], text.alias("text"), words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    windows = F.when(n > 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("words", i, 5)))).otherwise(F.array().cast("array<bigint>"))
    two = one.select(
        "id",
        *[f"g{k}" for k in range(len(by))],
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(stripped_of(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # windows that occur twice, by place: sorted with their places, equal neighbours stand together
    placed = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    three = two.withColumn("placed", placed).drop("windows")
    hash_at = lambda k: F.get(F.col("placed"), k)["h"]
    twice = F.transform("placed", lambda x, k: F.when(F.coalesce((x["h"] == hash_at(k - 1)) | (x["h"] == hash_at(k + 1)), (x["h"] == hash_at(k - 1)), (x["h"] == hash_at(k + 1)), F.lit(False)), x["i"]))
    four = three.withColumn("starts", F.array_sort(F.filter(twice, lambda i: i.isNotNull()))).drop("placed")
    covered = F.aggregate(F.transform("starts", lambda i, k: F.least(F.lit(5), F.coalesce(F.get(F.col("starts"), k + 1) - i, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    five = four.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")
    return five.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def vector() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log(n), F.log(chars / n), F.log1p(100 * F.col("n_symbols") / chars), F.log1p(100 * F.col("n_dup_lines") / n)]


def half_point(rows: DataFrame, keys: list[str], bin_: Column) -> DataFrame:
    """(keys, bin): the least bin up to which at least half of a group's rows lie."""
    counts = rows.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    sums = counts.withColumn("up_to", F.sum("c").over(w.orderBy("bin"))).withColumn("all", F.sum("c").over(w))
    return sums.filter(2 * F.col("up_to") >= F.col("all")).groupBy(*keys).agg(F.min("bin").alias("bin"))


def wide(points: DataFrame, keys: list[str], name: str, scale: float) -> DataFrame:
    """The half points of all dimensions (column d) as columns."""
    cols = [F.max(F.when(F.col("d") == k, (F.col("bin") + 0.5) * BIN * scale)).alias(f"{name}{k}") for k in range(DIM)]
    return points.groupBy(*keys).agg(*cols)


def cholesky(c: list[list[Column]]) -> list[list[Column]]:
    low: list[list[Column]] = [[None] * DIM for _ in range(DIM)]
    for i in range(DIM):
        for j in range(i + 1):
            rest = c[i][j]
            for k in range(j):
                rest = rest - low[i][k] * low[j][k]
            low[i][j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / low[j][j]
    return low


def matrix() -> list[list[Column]]:
    return [[F.col(f"c{max(i, j)}{min(i, j)}") for j in range(DIM)] for i in range(DIM)]


def squared(v: list[Column], m: list[Column], low: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance, by forward substitution in the Cholesky factor."""
    y: list[Column] = []
    for i in range(DIM):
        rest = v[i] - m[i]
        for k in range(i):
            rest = rest - low[i][k] * y[k]
        y.append(rest / low[i][i])
    return sum((x * x for x in y[1:]), y[0] * y[0])


def small(table: DataFrame) -> DataFrame:
    """``table`` for a join: broadcast up to BROADCAST_GROUPS rows, else a plain join, whose skewed partitions
    adaptive execution splits."""
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def factored(estimate: DataFrame) -> DataFrame:
    """``estimate`` with the Cholesky factor l00.. in the place of the covariance: worked out once a group."""
    low = cholesky(matrix())
    keep = [c for c in estimate.columns if not (c[0] == "c" and c[1:].isdigit())]
    return estimate.select(*keep, *[low[i][j].alias(f"l{i}{j}") for i in range(DIM) for j in range(i + 1)])


def distances(rows: DataFrame, estimate: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with d2 under the factored estimate of their group."""
    v = [F.col(f"v{k}") for k in range(DIM)]
    m = [F.col(f"m{k}") for k in range(DIM)]
    low = [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(DIM)]
    names = [x for x in estimate.columns if x not in (*keys, "start")]
    return rows.join(small(estimate), keys, how).withColumn("d2", squared(v, m, low)).drop(*names)


def covariance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m0.., c00..): mean and covariance; variances are those of FLOORS at least."""
    v = [F.col(f"v{k}") for k in range(DIM)]
    sums = [F.avg(v[k]).alias(f"m{k}") for k in range(DIM)]
    sums += [F.covar_pop(v[i], v[j]).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)]
    return floored(rows.groupBy(*keys).agg(*sums))


def floored(estimate: DataFrame) -> DataFrame:
    return estimate.withColumns({f"c{i}{i}": F.greatest(F.col(f"c{i}{i}"), F.lit(FLOORS[i] ** 2)) for i in range(DIM)})


def starts(good: DataFrame, middle: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, m0.., c00..): three scatters about the medians (columns m and s of ``middle``)."""
    z = [(F.col(f"v{k}") - F.col(f"m{k}")) / F.greatest(F.col(f"s{k}"), F.lit(FLOORS[k])) for k in range(DIM)]
    norm = F.greatest(F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0])), F.lit(1e-9))
    sides = {1: [F.tanh(x) for x in z], 2: [x / norm for x in z]}
    joined = good.join(small(middle), keys)
    sums = [F.avg(t[i] * t[j]).alias(f"a{s}{i}{j}") for s, t in sides.items() for i in range(DIM) for j in range(i + 1)]
    moments = joined.groupBy(*keys).agg(*sums).join(small(middle), keys)
    spread = [F.greatest(F.col(f"s{k}"), F.lit(FLOORS[k])) for k in range(DIM)]
    each = []
    for s in range(3):
        c = [((F.lit(float(i == j)) if s == 0 else F.col(f"a{s}{i}{j}")) * spread[i] * spread[j]).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)]
        each.append(F.struct(F.lit(s).alias("start"), *c))
    wide = moments.select(*keys, *[f"m{k}" for k in range(DIM)], F.explode(F.array(*each)).alias("e"))
    return wide.select(*keys, "e.start", *[f"m{k}" for k in range(DIM)], *[f"e.c{i}{j}" for i in range(DIM) for j in range(i + 1)])


def pools(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, pool): the pool that judges the rows of each group, and (keys, pool): all pools that are used and
    that the rows of a group belong to. A pool is a group, or all groups that have the first keys in common."""
    sizes = cut(rows.groupBy(*keys).agg(F.sum((~F.col("base_failed")).cast("long")).alias("rows")))
    name = lambda k: F.to_json(F.array(F.lit(str(k)), *keys[:k]))
    known, pool = sizes, name(0)
    for k in range(1, len(keys) + 1):
        known = known.join(small(sizes.groupBy(*keys[:k]).agg(F.sum("rows").alias(f"rows{k}"))), keys[:k])
        pool = F.when(F.col(f"rows{k}") >= POOL_ROWS, name(k)).otherwise(pool)
    groups = cut(known.select(*keys, pool.alias("pool")))
    every = sizes.select(*keys, F.explode(F.array(*[name(k) for k in range(len(keys) + 1)])).alias("pool"))
    return groups, cut(every.join(small(groups.select("pool").distinct()), "pool", "left_semi"))


def verdicts(stats: DataFrame) -> DataFrame:
    """``stats`` (see ``statistics``) with d2 double and kept boolean."""
    groups = sorted(c for c in stats.columns if c[0] == "g" and c[1:].isdigit())
    # nulls are groups of their own
    keys = [f"k{g[1:]}" for g in groups]
    rows = stats
    for g, k in zip(groups, keys, strict=True):
        rows = rows.withColumn(k, F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")))
    for k, v in enumerate(vector()):
        rows = rows.withColumn(f"v{k}", v)
    rows = cut(rows)
    groups, members = pools(rows, keys)
    good = rows.filter(~F.col("base_failed")).join(small(members), keys).select("pool", *[f"v{k}" for k in range(DIM)])
    rows, keys = rows.join(small(groups), keys).drop(*keys), ["pool"]
    long = good.select(*keys, F.posexplode(F.array(*[f"v{k}" for k in range(DIM)])).alias("d", "v"))
    middle = cut(wide(half_point(long, [*keys, "d"], F.floor(F.col("v") / BIN)), keys, "m", 1.0))
    near = good.join(small(middle), keys)
    off = near.select(*keys, F.posexplode(F.array(*[F.abs(F.col(f"v{k}") - F.col(f"m{k}")) for k in range(DIM)])).alias("d", "v"))
    spread = wide(half_point(off, [*keys, "d"], F.floor(F.col("v") / BIN)), keys, "s", 1.4826)
    middle = cut(middle.join(spread, keys))
    level = lambda: F.floor(F.log1p("d2") / BIN)
    estimate, ways = cut(factored(starts(good, middle, keys))), [*keys, "start"]
    for _ in range(STEPS):
        measured = distances(good, estimate, keys)  # a row for each start
        limit = cut(half_point(measured, ways, level()))
        estimate = cut(factored(covariance(measured.join(small(limit), ways).filter(level() <= F.col("bin")), ways)))
    size = F.col("l00") * F.col("l11") * F.col("l22") * F.col("l33")
    least = Window.partitionBy(*keys).orderBy(size, "start")
    estimate = cut(estimate.withColumn("place", F.row_number().over(least)).filter("place = 1").drop("place", "start"))
    limit = half_point(distances(good, estimate, keys), keys, level())
    ratio = F.greatest(F.lit(1.0), F.expm1((F.col("bin") + 1) * BIN) / CHI_HALF)
    # a floor is no spread that was measured, so it is not scaled: d2 is divided as a whole
    factor = cut(limit.select(*keys, ratio.alias("ratio")))
    out = distances(rows, estimate, keys, "left").join(small(factor), keys, "left").withColumn("d2", F.col("d2") / F.col("ratio"))
    reject = F.coalesce(F.col("d2") > CUTOFF, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~reject).drop("ratio", *keys, *[f"v{k}" for k in range(DIM)])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, statistics, base_failed, d2, kept) of every whole text."""
    return verdicts(statistics(docs, id_col, text_col, by)).withColumnRenamed("id", id_col)
