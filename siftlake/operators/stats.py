"""Truth metrics and robust statistics of runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: 97.5 % points of Student's t for 1 to 30 degrees of freedom; 1.96 beyond.
T_975 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)


def precision_recall(judged: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of ``judged`` (truth and found, booleans) for each of the keys."""
    count = lambda c: F.count_if(c)
    found = judged.groupBy(*keys).agg(count(F.col("truth") & F.col("found")).alias("tp"), count(~F.col("truth") & F.col("found")).alias("fp"), count(F.col("truth") & ~F.col("found")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    found = found.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return found.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def median_and_spread(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Median and median absolute deviation of the value for each of the keys."""
    medians = rows.groupBy(*keys).agg(F.median(value).alias("median"))
    return rows.join(medians, list(keys)).groupBy(*keys, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"), F.count("*").alias("n"))


def paired_ratio(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Mean of a / b with its 95 % interval for each of the keys."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(a) / F.col(b)).alias("mean"), F.stddev_samp(F.col(a) / F.col(b)).alias("sd"))
    t = F.coalesce(F.get(F.array(*map(F.lit, T_975)), (F.col("n") - 2).cast("int")), F.lit(1.96))
    half = t * F.col("sd") / F.sqrt("n")
    return found.where("n > 1").select(*keys, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def floor_by_detector(scored: DataFrame, bins: int = 20) -> DataFrame:
    """The lowest confidence bin from which on at least nine tenths of a detector's findings are true. ``scored``: detector_id, confidence, truth."""
    rows = scored.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)))
    counts = rows.groupBy("detector_id", "bin").agg(F.count_if("truth").alias("good"), F.count("*").alias("n"))
    above = Window.partitionBy("detector_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("good").over(above) / F.sum("n").over(above)
    return counts.withColumn("share", share).where("share >= 0.9").groupBy("detector_id").agg((F.min("bin") / bins).alias("floor"))


def events_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts for each of the keys, for all prefixes of them, and in all."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"))


def quantiles(rows: DataFrame, value: str, shares: tuple[float, ...], *keys: str) -> DataFrame:
    """Quantiles of the value for each of the keys, by linear interpolation between ranks."""
    return rows.groupBy(*keys).agg(*(F.percentile(value, F.lit(q)).alias(f"q{round(q * 100)}") for q in shares))


def modified_z(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Adds ``z``: 0.6745 times the distance from the median, in median absolute deviations (null if these are zero), and ``outlier``: it is beyond 3.5."""
    spread = median_and_spread(rows, value, *keys).select(*keys, "median", "mad")
    z = F.when(F.col("mad") > 0, 0.6745 * (F.col(value) - F.col("median")) / F.col("mad"))
    return rows.join(spread, list(keys)).withColumn("z", z).withColumn("outlier", F.coalesce(F.abs("z") > 3.5, F.lit(False))).drop("median", "mad")


def cliffs_delta(rows: DataFrame, value: str, group: str, a, b, *keys: str) -> DataFrame:
    """Cliff's delta of the values of group ``a`` against those of ``b``: how much more often the former is larger than smaller, over all pairs.

    By counts of distinct values and running sums, so no pair is made: n log n in the number of distinct values.
    """
    counts = rows.groupBy(*keys, value).agg(F.count_if(F.col(group) == a).alias("n_a"), F.count_if(F.col(group) == b).alias("n_b"))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n_b").over(before), F.lit(0))
    total = Window.partitionBy(*keys)
    wins = counts.withColumn("more", F.col("n_a") * below).withColumn("less", F.col("n_a") * (F.sum("n_b").over(total) - below - F.col("n_b")))
    found = wins.groupBy(*keys).agg(F.sum("more").alias("more"), F.sum("less").alias("less"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    return found.where("n_a > 0 AND n_b > 0").select(*keys, ((F.col("more") - F.col("less")) / (F.col("n_a") * F.col("n_b"))).alias("delta"), "n_a", "n_b")


def bootstrap_mean(rows: DataFrame, value: str, ident: str, *keys: str, rounds: int = 200) -> DataFrame:
    """Mean of the value with the 2.5 % and 97.5 % quantiles of its bootstrap distribution, for each of the keys.

    Each row counts a number of times in each round that follows a Poisson distribution with mean 1 and comes from a hash of its ``ident``, so that the rounds are sums
    in one pass over the rows, and the same on any number of machines.
    """
    share = lambda k: F.pmod(F.xxhash64(F.col(ident).cast("string"), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    bounds, p, total = [], math.exp(-1), 0.0
    for n in range(1, 9):
        total += p
        bounds.append(total)
        p /= n
    times = lambda k: sum((F.when(share(k) >= b, 1).otherwise(0) for b in bounds[1:]), F.when(share(k) >= bounds[0], 1).otherwise(0))
    each = rows.select(*keys, F.col(value).cast("double").alias("_v"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda k: F.struct(k.alias("round"), times(k).alias("times")))).alias("b"))
    means = each.groupBy(*keys, "b.round").agg((F.sum(F.col("_v") * F.col("b.times")) / F.nullif(F.sum("b.times"), F.lit(0))).alias("m"), F.avg("_v").alias("mean"))
    return means.groupBy(*keys).agg(F.first("mean").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def against_truth(found: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """Labelled records and findings of the same place (``keys``), paired if one's value holds the other's: keys, label, found_value, true_value.

    ``found``: keys, value; ``truth``: keys, label, value. Line ends and escaped quotes don't count. A finding that overlaps several records counts for each.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\([nrt\"'])", ""), r"[\r\n]", "")
    f = found.select(*keys, F.col("value").alias("found_value")).withColumn("_f", plain(F.col("found_value")))
    t = truth.select(*keys, "label", F.col("value").alias("true_value")).withColumn("_t", plain(F.col("true_value")))
    both = f.join(t, list(keys)).where(F.contains("_f", "_t") | F.contains("_t", "_f"))
    return both.select(*keys, "label", "found_value", "true_value")
