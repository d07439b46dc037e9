"""Quality rules: plain text statistics, and robust multivariate outliers of each language and source.

Base statistics come from array and string functions on each whole text. Documents with too few words or too many
repeated words fail at once. For the others, four transformed statistics (mean word length, symbols, repeated
lines, repeated words, each per word with a shrinkage that spares short texts) form a vector. Each (lang, source)
group gets a minimum-covariance-determinant estimate of centre and scatter: from each of STARTS starts (medians and
spreads; and the rows of a bucket of row hashes, some 32 of them) concentration steps take the share of rows nearest to
the centre and estimate anew, for each as long as its determinant falls; of the starts the one of least determinant is
kept, and a last step reweights. A document is rejected when its squared Mahalanobis distance is over `cutoff`. A
group under `least` rows is judged by the estimate of its language over all sources, and where that has under `least`
rows too, by that of all documents: every document that passes the base rules has a distance.

All of it is DataFrame expressions. A concentration step is one aggregation over a narrow written table (partial
sums before the shuffle) and one over counts of distance levels: the share of nearest rows is read off a histogram of
the logarithm of the distance with 1/32 octave steps, which has a bounded number of levels for a group whatever its
rows. Tables of a row for each group meet the rows by a broadcast where they are counted to be under FEW rows, and
else are dealt out PARTS times, so that the rows of one group go to as many tasks: a group with a third of all rows
costs no more than others.

Null texts have no words and fail the base rules; null lang or source is a group of its own; repeated rows are
judged alike; an empty table gives no rows; other columns pass through `judge` untouched, but for those named as a
result, which are replaced. Columns that begin with `__q_` are its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: Least standard deviation of each statistic, so that a group of constant values has a scatter.
FLOORS = (0.04, 0.5, 0.5, 0.06)
P = len(FLOORS)
#: Median and 97.5 % point of the chi-squared distribution with P = 4 degrees of freedom.
CHI2_MEDIAN, CHI2_975 = 3.357, 11.143
SHRINK = 50.0
#: Estimates that are started for each group.
STARTS = 3
#: Most rows of a table that is broadcast (some 200 bytes each), and how often a longer one is dealt out.
FEW, PARTS = 50_000, 16
_STATS = [f"__q_x{j}" for j in range(P)]
_KEYS = ["__q_lang", "__q_source"]
_RUNS = [*_KEYS, "__q_start"]
#: Stands for all languages or sources; own values are empty or begin with "=".
POOLED = "*"


def _pairs(array: str, gap: int, then) -> Column:  # noqa: ANN001
    """`then` of each element and the one `gap` places on."""
    n = F.greatest(F.size(array) - gap, F.lit(0))
    return F.zip_with(F.slice(F.col(array), F.lit(1), n), F.slice(F.col(array), F.lit(gap + 1), n), then)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (columns so named are replaced)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = df.select("*", body.alias("__q_text")).withColumn("__q_words", F.array_remove(F.split("__q_text", WORD_GAP), ""))
    out = out.withColumns({"__q_h1": F.transform("__q_words", lambda w: F.xxhash64(w)), "n_words": F.size("__q_words").cast("long"), "word_chars": F.length(F.array_join("__q_words", "")).cast("long"), "n_symbols": F.length(F.regexp_replace("__q_text", SYMBOLS, "")).cast("long"), "__q_lines": F.filter(F.split("__q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    out = out.withColumn("n_dup_lines", (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long")).drop("__q_words", "__q_lines", "__q_text")
    for gap in (1, 2, 4):  # hashes of 2, 4 and 8 words in a row
        out = out.withColumn(f"__q_h{2 * gap}", _pairs(f"__q_h{gap}", gap, lambda a, b: F.xxhash64(a, b))).drop(f"__q_h{gap}")
    # Windows in the order of their hashes, only where one occurs twice; neighbours of one hash give the repeated places.
    twice = F.size("__q_h8") > F.size(F.array_distinct("__q_h8"))
    out = out.withColumn("__q_sorted", F.when(twice, F.sort_array(F.transform("__q_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__q_h8")
    places = F.flatten(F.filter(_pairs("__q_sorted", 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
    out = out.withColumn("__q_places", F.when(F.col("__q_sorted").isNotNull(), F.sort_array(F.array_distinct(places)))).drop("__q_sorted")
    steps = _pairs("__q_places", 1, lambda a, b: F.least(F.lit(8), b - a))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(8), lambda a, b: a + b), F.lit(0)).cast("long")).drop("__q_places")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _with(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined to a written table of a few rows for each key, without dealing the rows of a key to one task."""
    if small.count() <= FEW:
        return rows.join(F.broadcast(small), keys, how)
    hashed = [f.name for f in rows.schema if f.name not in keys and "map<" not in f.dataType.simpleString()]
    part = F.pmod(F.xxhash64(*hashed), F.lit(PARTS)).cast("int")
    dealt = small.withColumn("__q_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("__q_part", part).join(dealt, [*keys, "__q_part"], how).drop("__q_part")


def _judges(base: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """For each group the pool that judges it, and for each pool that judges any the groups in it; both with the pool's mean word length."""
    sums = lambda c: [F.sum(x).alias(x) for x in c]
    counts = ["__q_rows", "__q_chars", "__q_count"]
    passing = base.where(~F.col("base_failed")).groupBy(_KEYS)
    groups = written(passing.agg(F.count("*").alias("__q_rows"), F.sum("word_chars").alias("__q_chars"), F.sum("n_words").alias("__q_count")))
    named = lambda df, mark: df.select(*[c for c in df.columns if c not in counts], *[F.col(c).alias(c + mark) for c in counts])
    langs, every = groups.groupBy("__q_lang").agg(*sums(counts)), groups.agg(*sums(counts))
    mean = lambda mark="": (F.col("__q_chars" + mark) / F.col("__q_count" + mark)).alias("__q_mean")
    both = groups.join(named(langs, "_l"), "__q_lang").join(F.broadcast(named(every, "_a")))  # one row for all
    own, lang = F.col("__q_rows") >= least, F.col("__q_rows_l") >= least
    pool = lambda first, second, third: F.when(own, first).when(lang, second).otherwise(third)
    judged = both.select(*_KEYS, pool(F.col("__q_lang"), F.col("__q_lang"), F.lit(POOLED)).alias("__q_pool_lang"), pool(F.col("__q_source"), F.lit(POOLED), F.lit(POOLED)).alias("__q_pool_source"), pool(mean(), mean("_l"), mean("_a")).alias("__q_mean"))
    judged = written(judged)
    in_lang = groups.select(_KEYS).join(judged.where((F.col("__q_pool_lang") != POOLED) & (F.col("__q_pool_source") == POOLED)).select("__q_lang", "__q_pool_lang", "__q_pool_source", "__q_mean").distinct(), "__q_lang")
    in_all = groups.select(_KEYS).join(F.broadcast(judged.where(F.col("__q_pool_lang") == POOLED).select("__q_pool_lang", "__q_pool_source", "__q_mean").distinct()))  # one row, or none
    members = judged.where(F.col("__q_pool_source") != POOLED).unionByName(in_lang).unionByName(in_all)
    return judged, written(members)


def _vectors(df: DataFrame, pools: DataFrame, how: str) -> DataFrame:
    """The transformed statistics for each pool of a row; the mean word length of short texts is drawn to that of the pool."""
    n = F.col("n_words") + SHRINK
    rate = lambda c: F.log(1 + 100 * F.col(c) / n)
    x = [F.log((F.col("word_chars") + SHRINK * F.coalesce("__q_mean", F.lit(5.0))) / n), rate("n_symbols"), rate("n_dup_lines"), F.col("n_repeat_words") / n]
    rest = [c for c in df.columns if c not in _KEYS]
    return _with(df, pools, _KEYS, how).select(*[F.col(f"`{c}`") for c in rest], F.col("__q_pool_lang").alias("__q_lang"), F.col("__q_pool_source").alias("__q_source"), *[c.alias(name) for c, name in zip(x, _STATS)])


def _level_at(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """For each key the least `level` up to which at least that share of its rows `n` lies."""
    so_far, all_of = Window.partitionBy(*keys).orderBy("level"), Window.partitionBy(*keys)
    ranked = counts.select(*keys, "level", F.sum("n").over(so_far).alias("__q_c"), F.sum("n").over(all_of).alias("__q_n"))
    return ranked.where(F.col("__q_c") >= share * F.col("__q_n")).groupBy(*keys).agg(F.min("level").alias("level"))


def _median_start(rows: DataFrame) -> DataFrame:
    """Centre and diagonal scatter from medians and median deviations on a grid of 1/256."""
    each = rows.select(*_KEYS, F.posexplode(F.array(*_STATS)).alias("j", "x"))
    grid = lambda c: F.floor(c * 256 + 0.5)
    count = lambda d: d.groupBy(*_KEYS, "j", "level").agg(F.count("*").alias("n"))
    counts = count(each.withColumn("level", grid(F.col("x"))))
    middle = _level_at(counts, [*_KEYS, "j"], 0.5).withColumnRenamed("level", "mid")
    apart = counts.join(middle, [*_KEYS, "j"]).groupBy(*_KEYS, "j", F.abs(F.col("level") - F.col("mid")).alias("level")).agg(F.sum("n").alias("n"))
    spread = _level_at(apart, [*_KEYS, "j"], 0.5).withColumnRenamed("level", "mad")
    both = middle.join(spread, [*_KEYS, "j"])
    at = lambda c, j: F.max(F.when(F.col("j") == j, F.col(c) / 256))
    found = both.groupBy(_KEYS).agg(*[at("mid", j).alias(f"__q_m{j}") for j in range(P)], *[at("mad", j).alias(f"__q_d{j}") for j in range(P)])
    low = [F.lit(0.0) if i != j else F.sqrt(F.pow(1.4826 * F.col(f"__q_d{i}"), 2) + FLOORS[i] ** 2) for i in range(P) for j in range(i + 1)]
    return found.select(*_KEYS, F.lit(0).alias("__q_start"), *[f"__q_m{j}" for j in range(P)], *[c.alias(f"__q_l{i}{j}") for c, (i, j) in zip(low, _lower())])


def _bucket_starts(rows: DataFrame) -> DataFrame:
    """Estimates of the rows of one bucket of hashes, some 32 of a group, for each further start."""
    sizes = written(rows.groupBy(_KEYS).agg(F.ceil(F.count("*") / 32).alias("__q_buckets")))
    placed = _with(rows, sizes, _KEYS).withColumn("__q_start", F.pmod(F.xxhash64(*_STATS), "__q_buckets") + 1)
    return _estimate(placed.where(F.col("__q_start") < STARTS).withColumn("__q_start", F.col("__q_start").cast("int")), _RUNS)


def _lower() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _estimate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and Cholesky factor of the covariance (with the floors) for each key."""
    products = [F.sum(F.col(f"__q_x{i}") * F.col(f"__q_x{j}")).alias(f"__q_s{i}{j}") for i, j in _lower()]
    out = rows.groupBy(keys).agg(F.count("*").alias("__q_n"), *[F.avg(x).alias(f"__q_m{j}") for j, x in enumerate(_STATS)], *products)
    for i, j in _lower():
        own = F.col(f"__q_s{i}{j}") / F.col("__q_n") - F.col(f"__q_m{i}") * F.col(f"__q_m{j}")
        if i == j:
            own = F.greatest(own, F.lit(0.0)) + FLOORS[i] ** 2
        rest = reduce(lambda a, b: a - b, [F.col(f"__q_l{i}{k}") * F.col(f"__q_l{j}{k}") for k in range(j)], own)
        out = out.withColumn(f"__q_l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"__q_l{j}{j}"))
    return out.select(*keys, *[f"__q_m{j}" for j in range(P)], *[f"__q_l{i}{j}" for i, j in _lower()])


def _distances(rows: DataFrame, fit: DataFrame, how: str = "inner") -> DataFrame:
    """rows, for each estimate of their group, with the squared Mahalanobis distance __q_d and its level __q_level."""
    kept = [*rows.columns, *[c for c in fit.columns if c == "__q_start"]]
    out = _with(rows, fit, _KEYS, how)
    for i in range(P):
        own = F.col(f"__q_x{i}") - F.col(f"__q_m{i}")
        out = out.withColumn(f"__q_y{i}", reduce(lambda a, b: a - b, [F.col(f"__q_l{i}{k}") * F.col(f"__q_y{k}") for k in range(i)], own) / F.col(f"__q_l{i}{i}"))
    d = reduce(lambda a, b: a + b, [F.col(f"__q_y{i}") * F.col(f"__q_y{i}") for i in range(P)])
    out = out.withColumn("__q_d", d).select(*[F.col(f"`{c}`") for c in kept], "__q_d")
    return out.withColumn("__q_level", F.floor(32 * F.log2(F.col("__q_d") + 1e-6)))


def _nearest(rows: DataFrame, share: float, keys: list[str]) -> DataFrame:
    """For each key the distance level that holds the share of nearest rows."""
    counts = rows.groupBy(*keys, F.col("__q_level").alias("level")).agg(F.count("*").alias("n"))
    return _level_at(counts, keys, share).withColumnRenamed("level", "__q_top")


def _volume() -> Column:
    """The logarithm of the scatter's determinant."""
    return reduce(lambda a, b: a + b, [2 * F.log(F.col(f"__q_l{j}{j}")) for j in range(P)])


def _concentrated(rows: DataFrame, starts: DataFrame, share: float, settled: float) -> DataFrame:
    """For each group the estimate of least determinant of those of its nearest share of rows, from all starts.

    Each is taken anew until its log determinant falls by less than `settled`. A step that does not lower it is not
    taken, so each run ends: the determinant has a floor. Only runs that still move are joined again.
    """
    names, done, fit, first = starts.columns, [], starts, True
    while True:
        near = _distances(rows, fit.select(names))
        inside = _with(near, written(_nearest(near, share, _RUNS)), _RUNS).where(F.col("__q_level") <= F.col("__q_top"))
        new = _estimate(inside, _RUNS).withColumn("__q_volume", _volume())
        if first:  # a start is no estimate of a share of rows; its determinant says nothing
            fit, first = written(new), False
            continue
        old = fit.select(*_RUNS, F.struct(*names, "__q_volume").alias("__q_old"))
        both = written(new.join(old, _RUNS).withColumn("__q_moves", F.col("__q_volume") < F.col("__q_old.__q_volume") - settled))
        done.append(both.where(~F.col("__q_moves")).select("__q_old.*"))
        fit = both.where("__q_moves").select(*names, "__q_volume")
        if fit.isEmpty():
            every = reduce(lambda a, b: a.unionByName(b), done)
            order = Window.partitionBy(*_KEYS).orderBy("__q_volume", "__q_start")
            return written(every.withColumn("__q_at", F.row_number().over(order)).where("__q_at = 1").select([c for c in names if c != "__q_start"]))


def judge(df: DataFrame, share: float = 0.6, settled: float = 1e-4, cutoff: float = 20.0, least: int = 40, lang: str = "lang", source: str = "source", text: str = "text", drop_text: bool = False) -> DataFrame:
    """df (without its text, if so asked) with the base statistics, base_failed, distance (null: failed the base rules) and kept."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    clash = {c: c + "_" * max(map(len, df.columns)) for c in df.columns if c.startswith("__q_")}  # longer than any column
    if clash:
        kept = {v.replace("__q_", "__k_", 1): k for k, v in clash.items()}
        names = {k: kept_as for kept_as, k in kept.items()}
        lang, source, text = (names.get(c, c) for c in (lang, source, text))
        return judge(df.withColumnsRenamed(names), share, settled, cutoff, least, lang, source, text, drop_text).withColumnsRenamed(kept)
    base = statistics(df, text).withColumns({"__q_lang": mark(lang), "__q_source": mark(source)})
    base = base.drop(text) if drop_text else base
    return _verdict(written(base), share, settled, cutoff, least)


def _fitted(rows: DataFrame, share: float, settled: float) -> DataFrame:
    """The reweighted estimate of each group of rows."""
    starts = written(_median_start(rows).unionByName(_bucket_starts(rows)))
    fit = _concentrated(rows, starts, share, settled)
    # The scale that makes the median distance that of a normal sample, then the estimate of all rows within its 97.5 % point.
    scale = _nearest(_distances(rows, fit), 0.5, _KEYS).select(*_KEYS, F.greatest(F.pow(F.lit(2.0), (F.col("__q_top") + 1) / 32) / CHI2_MEDIAN, F.lit(0.05)).alias("__q_scale"))
    inside = _with(_distances(rows, fit), written(scale), _KEYS).where(F.col("__q_d") <= F.greatest(F.col("__q_scale"), F.lit(1.0)) * CHI2_975)
    return written(_estimate(inside, _KEYS))


def _verdict(base: DataFrame, share: float, settled: float, cutoff: float, least: int) -> DataFrame:
    judged, members = _judges(base, least)
    counted = [*_KEYS, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = written(_vectors(base.where(~F.col("base_failed")).select(counted), members, "inner").select(*_KEYS, *_STATS))
    fit = _fitted(rows, share, settled)
    # Left joins, so that no row is lost: a group of failed rows only has no estimate.
    out = _distances(_vectors(base, judged, "left"), fit, "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), F.col("__q_d")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))
    return out.drop(*_KEYS, *_STATS, "__q_d", "__q_level")
