"""Quality rules: robust multivariate outliers by minimum covariance determinants for each language and source.

Every text gives a vector of transformed statistics. For each group of ``lang`` and ``source`` the minimum covariance
determinant looks for the ``share`` of the rows whose covariance matrix has the least determinant: from two starts (medians
with deviations from them, and plain means with covariances) it takes, again and again, the rows nearest to the last
estimate. The start that ends at the lower determinant counts; its estimate is made consistent, once reweighted, and gives
each row's squared Mahalanobis distance. A row is kept if that is at most ``cutoff``.

DataFrame functions only. A step is an aggregation of sums for each group, whatever its size; the nearest rows are those up to a
step of a histogram of distances (``BINS`` steps for each doubling), so nothing is sorted or sampled, and a group that holds a third
of all rows is summed on all machines. Groups of fewer than ``least`` rows are pooled for each language, and small pools
into one; if that has too few rows too, all of it is kept.

Nulls and odd rows: a null text has no words and fails the base rules; a null language or source is a value of its own; a
statistic that hardly varies in a group counts with a least standard deviation (``FLOORS``); repeated rows are judged each by
itself; extra columns come along, save those with names of the result. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, words

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
#: The statistics: logarithms of words, of characters a word, of symbols in 1000 characters, and of doubled lines and repeated words in 100; and
#: the standard deviations that are added to the estimated ones.
NAMES = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats")
FLOORS = (0.25, 0.05, 0.5, 0.5, 0.5)
#: Share of a group in the minimum determinant; rows that a group needs; steps of concentration; histogram steps for a doubling of the distance.
SHARE, LEAST, STEPS, BINS = 0.75, 100, 6, 32
#: Share of normal rows that the reweighted estimate takes.
WEIGHTED = 0.975
#: Largest squared distance that is kept: what one row in 2000 exceeds if the five statistics are normal. It lies below what ``FLOORS`` alone leave
#: of the largest deviation of any one statistic (37 for repeated words, 85 for doubled lines), so that each can reject a row.
CUTOFF = 22.1



def chi_square(x: float, of: int) -> float:
    """The chance that a chi-square variable of 5 or 7 degrees of freedom is at most ``x``."""
    tail = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    return math.erf(math.sqrt(x / 2)) - tail * (1 + x / 3 + (x * x / 15 if of == 7 else 0))


def bound_of(share: float) -> float:
    """The squared distance that holds ``share`` of five normal variables."""
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, 5) < share else (low, middle)
    return high


def factor_of(share: float) -> float:
    """What makes the covariance of the nearest ``share`` of normal rows consistent."""
    return share / chi_square(bound_of(share), 7)


PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [c for c in docs.columns if c != "text"]
    full_lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(F.size("_words") >= REPEAT_WINDOW, F.transform(F.sequence(F.lit(1), F.size("_words") - REPEAT_WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, REPEAT_WINDOW)))).otherwise(F.array().cast("array<long>"))
    rows = docs.select(
        *own,
        words(F.col("text")).alias("_words"),
        F.length(F.translate(text, "\t\n\x0b\x0c\r ", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        full_lines.alias("_lines"),
    )
    rows = rows.select(*own, "word_chars", "n_symbols", F.size("_words").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), windows.alias("_windows"))
    # Most texts repeat no window; the others' windows are sorted, and neighbours compared.
    several = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_sorted", F.when(several, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.drop("_windows")
    at = lambda k: F.get(F.col("_sorted"), k)["h"]
    same = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda k: F.coalesce(at(k) == at(k - 1), F.lit(False)) | F.coalesce(at(k) == at(k + 1), F.lit(False)))
    rows = rows.withColumn("_places", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.transform(same, lambda k: F.get(F.col("_sorted"), k)["i"])))).drop("_sorted")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_places", start, lambda acc, p: F.struct((acc["n"] + p + REPEAT_WINDOW - F.greatest(acc["end"], p)).alias("n"), (p + REPEAT_WINDOW).alias("end")), lambda acc: acc["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    share = lambda part, of, scale: F.log1p(scale * F.col(part) / F.greatest(F.col(of), F.lit(1)))
    columns = [F.log1p("n_words"), F.log(F.col("word_chars") / F.greatest("n_words", F.lit(1))), share("n_symbols", "word_chars", 1000.0), share("n_dup_lines", "n_lines", 100.0), share("n_repeat_words", "n_words", 100.0)]
    return [c.cast("double").alias(n) for c, n in zip(columns, NAMES, strict=True)]


def _pooled(rows: DataFrame, least: int) -> DataFrame:
    """Adds ``_group``: language and source, or the pool of the language's small sources, or that of small pools; null if even that is too small."""
    key = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")).alias(f"_{c}") for c in ("lang", "source")]
    rows = rows.select("*", *key)
    sizes = rows.groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("_group", F.when(F.col("n") >= least, F.struct("_lang", "_source")).otherwise(F.struct("_lang", F.lit("*").alias("_source"))))
    for pool in (F.struct(F.lit("*").alias("_lang"), F.lit("*").alias("_source")), F.lit(None)):
        total = F.sum("n").over(Window.partitionBy("_group"))
        sizes = sizes.withColumn("total", total).withColumn("_group", F.when(F.col("total") >= least, F.col("_group")).otherwise(pool)).drop("total")
    return rows.join(sizes.drop("n"), ["_lang", "_source"], "left").drop("_lang", "_source")


def _moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean and covariance of the statistics for each of ``keys``, the latter as a Cholesky factor; and the log determinant."""
    sums = [F.count("*").alias("n"), *(F.avg(x).alias(f"m_{i}") for i, x in enumerate(NAMES)), *(F.covar_pop(NAMES[i], NAMES[j]).alias(f"c_{i}_{j}") for i, j in PAIRS)]
    found = rows.groupBy(*keys).agg(*sums)
    for i, j in PAIRS:
        rest = F.col(f"c_{i}_{j}") * factor + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        found = found.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    log_det = reduce(lambda a, b: a + b, (F.log(F.col(f"l_{i}_{i}")) for i in range(len(NAMES))))
    return found.withColumn("log_det", log_det).select(*keys, "n", "log_det", *(f"m_{i}" for i in range(len(NAMES))), *(f"l_{i}_{j}" for i, j in PAIRS))


ESTIMATE = [*(f"m_{i}" for i in range(len(NAMES))), *(f"l_{i}_{j}" for i, j in PAIRS)]


def _distances(rows: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance to the estimate of the row's ``keys``; null without one."""
    joined = rows.join(estimates.select(*keys, *ESTIMATE), keys, "left")
    for i, x in enumerate(NAMES):
        rest = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"_y{k}")
        joined = joined.withColumn(f"_y{i}", rest / F.col(f"l_{i}_{i}"))
    d2 = reduce(lambda a, b: a + b, (F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(len(NAMES))))
    return joined.withColumn("d2", d2).drop(*ESTIMATE, *(f"_y{i}" for i in range(len(NAMES))))


def _medians(rows: DataFrame) -> DataFrame:
    """Median and deviation from it of each statistic in each group, from histograms with steps of 1/64, as an estimate without covariances."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.floor(F.col(x) * 64).alias("bin")) for i, x in enumerate(NAMES))))
    counts = stored(rows.select("_group", values.alias("v")).groupBy("_group", "v.dim", "v.bin").agg(F.count("*").alias("n")), "counts")

    def middle(table: DataFrame, at: str) -> DataFrame:
        order = Window.partitionBy("_group", "dim").orderBy(at)
        below, total = F.sum("n").over(order), F.sum("n").over(Window.partitionBy("_group", "dim"))
        placed = table.withColumn("below", below).withColumn("total", total)
        return placed.where(2 * F.col("below") >= F.col("total")).groupBy("_group", "dim").agg(F.min(at).alias("middle"))

    medians = middle(counts, "bin")
    away = counts.join(medians, ["_group", "dim"]).select("_group", "dim", "n", "middle", F.abs(F.col("bin") - F.col("middle")).alias("away"))
    spread = middle(away.groupBy("_group", "dim", "away").agg(F.sum("n").alias("n")), "away").withColumnRenamed("middle", "spread")
    each = medians.join(spread, ["_group", "dim"])
    pick = lambda i, x: F.max(F.when(F.col("dim") == i, x))
    zero = [F.lit(0.0).alias(f"l_{i}_{j}") for i, j in PAIRS if i != j]
    floors = F.array(*map(F.lit, FLOORS))
    deviation = F.sqrt(F.pow(1.4826 * F.col("spread") / 64, F.lit(2)) + F.pow(F.get(floors, F.col("dim")), F.lit(2)))
    found = each.groupBy("_group").agg(*(pick(i, (F.col("middle") + 0.5) / 64).alias(f"m_{i}") for i in range(len(NAMES))), *(pick(i, deviation).alias(f"l_{i}_{i}") for i in range(len(NAMES))))
    return found.select("_group", *(f"m_{i}" for i in range(len(NAMES))), *zero, *(f"l_{i}_{i}" for i in range(len(NAMES))))


def _nearest(placed: DataFrame, share: float) -> DataFrame:
    """For each group and start, the rows up to the histogram step of the distance that holds the wanted share."""
    step = F.floor(F.log2(F.col("d2") + 1e-9) * BINS)
    placed = placed.withColumn("_step", step)
    keys = ["_group", "start"]
    # One row for each group, start and step; written, and so is the bound of each, so that large groups are split in the join.
    counts = stored(placed.groupBy(*keys, "_step").agg(F.count("*").alias("n")), "distances")
    below, total = F.sum("n").over(Window.partitionBy(*keys).orderBy("_step")), F.sum("n").over(Window.partitionBy(*keys))
    bounds = counts.withColumn("below", below).withColumn("total", total).where(F.col("below") >= share * F.col("total")).groupBy(*keys).agg(F.min("_step").alias("_bound"))
    return placed.join(stored(bounds, "bounds"), keys).where(F.col("_step") <= F.col("_bound"))


def robust_estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Reweighted minimum covariance determinant estimates of each ``_group`` of ``rows`` (_group and the statistics)."""
    keys = ["_group", "start"]
    columns = [*keys, *ESTIMATE]
    first = _medians(rows).withColumn("start", F.lit(0)).select(*columns)
    plain = _moments(rows, ["_group"], 1.0).withColumn("start", F.lit(1)).select(*columns)
    estimates = stored(first.unionByName(plain), "estimates")
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(steps):
        near = _nearest(_distances(both, estimates, keys), share)
        estimates = stored(_moments(near, keys, factor_of(share)), "estimates")
    best = estimates.groupBy("_group").agg(F.min_by(F.struct(*ESTIMATE), F.struct("log_det", "start")).alias("e")).select("_group", "e.*")
    inside = _distances(rows, best, ["_group"]).where(F.col("d2") <= bound_of(WEIGHTED))
    return stored(_moments(inside, ["_group"], factor_of(WEIGHTED)), "estimates")


MADE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept")


def judge_quality(docs: DataFrame, share: float = SHARE, least: int = LEAST, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` (text, lang, source and others) without text, with the statistics, base_failed, d2 and kept."""
    # A row's own columns travel in one struct, so that their names can't clash with those of the work.
    own = F.struct(*(c for c in docs.columns if c != "text" and c not in MADE)).alias("_own")
    rows = statistics(docs.select("text", own)).withColumn("base_failed", base_failed())
    rows = stored(rows.select("*", *vector()), "statistics")
    fit = _pooled(rows.where("NOT base_failed").select("_own.lang", "_own.source", *NAMES), least).where("_group IS NOT NULL")
    fit = stored(fit.select("_group", *NAMES), "vectors")
    estimates = robust_estimates(fit, share)
    groups = _pooled(rows.where("NOT base_failed").select("*", "_own.lang", "_own.source"), least).drop("lang", "source")
    failed = rows.where("base_failed").withColumn("_group", F.lit(None).cast(groups.schema["_group"].dataType))
    judged = _distances(groups.unionByName(failed), estimates, ["_group"])
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return judged.withColumn("kept", kept).select("_own.*", *MADE)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 6).alias("d2"))
