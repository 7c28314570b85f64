"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums of token counts, exact cuts.

1. Each row gets a key, the digest of ``seed``, its id and its text, and a running number that tells apart rows whose keys tie. Ids, sizes, keys and
   numbers are written, so that what follows sees the same numbers whatever executors are lost.
2. The rows are dealt by ranges of (source, key, size, number) and sorted. A range is a bounded slice of the order, so a source, or an id
   that repeats, may hold any share of the rows. Tasks add up their sizes, source by source, and write them with their range's number.
3. A table with one row for each range and source adds up to the sums before each range, and to the sources' sizes.
4. Budgets are found by sharing out: targets go by weight, and no target is above ``most`` times its source's size; what is above goes to the others by
   weight. Sorted by cap / weight, the sources at their cap come first, and running sums say where they end; again as prefix sums over ranges.
5. A source whose budget is e times its size and a rest takes all rows e times, and once more those whose sizes before them lie within the rest.
   The row at the cut is taken in part, so that the words taken are the target, rounded down.

Nothing is collected but a few totals of all sources. Rows meet the sums of their range by (range, source): Spark broadcasts that table where it is small, and else
shuffles by a key that has a range's rows at most.

Nulls, ties and odd rows: a null or blank text has size 0 and is taken 0 times; a null source is one of the sources, the last; rows that share key and size
are ordered by number, which changes nothing in what is taken but which of the equals. A source of size 0 has target 0. ``doc_id`` may be null or repeat. Own columns
stay unless they have the names that are added. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table, words

#: Weights of the sources in their order, repeating; a source's target over its size, at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Rows in a range, about, and rows that are worth a range of their own.
RANGE_ROWS, LEAST_ROWS = 500_000, 1000
SUMS = "decimal(38,0)"


def prefix_sums(rows: DataFrame, order: list[Column], values: list[str], by: str | None = None, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Running sums over an order, without a window over all rows.

    Gives ``rows`` (written) with _range and, for each of ``values`` v, _within_v (the sum of v over earlier rows of the range that have the same ``by``), and
    the ranges: _range, ``by``, and _first_v (the sum over earlier ranges) and _sum_v. ``order`` has to begin with ``by`` if there is one.
    """
    n = rows.count()
    ranges = max(1, math.ceil(n / range_rows), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
    names, group = rows.columns, [by] if by else []
    schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.LongType()), *(T.StructField(f"_within_{v}", T.LongType()) for v in values)])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        this, last, carried = TaskContext.get().partitionId(), None, [0] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.zeros(1, np.int64)
            if by:
                codes = np.asarray(batch.column(names.index(by)).dictionary_encode(null_encoding="encode").indices)
                starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                first = (batch.column(names.index(by))[0].as_py(),)
                carried = carried if first == last else [0] * len(values)
                last = (batch.column(names.index(by))[batch.num_rows - 1].as_py(),)
            sizes, columns = np.diff(np.append(starts, batch.num_rows)), []
            for k, v in enumerate(values):
                amounts = np.asarray(batch.column(names.index(v)).fill_null(0)).astype(np.int64)
                before = np.cumsum(amounts) - amounts
                base = before[starts].copy()
                base[0] = -carried[k]  # the group may have begun in the batch before
                before -= np.repeat(base, sizes)
                carried[k] = int(before[-1] + amounts[-1])
                columns.append(pa.array(before))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, this)), *columns], schema.names)

    placed = stored(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(running, schema), "ranges")
    sums = stored(placed.groupBy("_range", *group).agg(*(F.sum(F.col(v).cast(SUMS)).alias(f"_sum_{v}") for v in values)), "sums")
    # One row for each range (and group): what the window sorts is bounded by the number of ranges.
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return placed, sums.withColumns({f"_first_{v}": F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0).cast(SUMS)) for v in values})


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``sources`` (source, source_size) with target: shares of the whole by weight, none above ``most`` times its source's size."""
    in_order = F.col("source").asc_nulls_last()
    numbered, ranges = prefix_sums(sources.withColumn("_one", F.lit(1)), [in_order], ["_one"], range_rows=range_rows)
    place = F.col("_within__one") + F.col("_first__one")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (place % len(weights) + 1).cast("int")).cast("long")
    weighed = stored(numbered.join(ranges, "_range").select("source", "source_size", weight.alias("_weight"), (F.col("source_size") * most).alias("_cap")), "weights")
    total, all_weights = weighed.agg(F.sum(F.col("source_size").cast(SUMS)), F.sum("_weight")).first()
    if not total:
        return weighed.select("source", "source_size", F.lit(0.0).alias("target"))
    # In order of cap / weight, a source is full if its part of what is left exceeds its cap.
    placed, ranges = prefix_sums(weighed, [F.col("_cap") / F.col("_weight"), in_order], ["_cap", "_weight"], range_rows=range_rows)
    left, rest = F.lit(total) - F.col("_within__cap") - F.col("_first__cap"), F.lit(all_weights) - F.col("_within__weight") - F.col("_first__weight")
    full = F.col("_cap").cast("decimal(20,0)") * rest.cast("decimal(17,0)") < left.cast("decimal(34,0)") * F.col("_weight").cast("decimal(3,0)")
    judged = stored(placed.join(ranges, "_range").select("source", "source_size", "_weight", "_cap", full.alias("_full")), "full")
    capped, open_weights = judged.agg(F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0).cast(SUMS)), F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_weight")))).first()
    share = F.col("_weight").cast("double") * float(total - capped) / float(open_weights or 1)
    return judged.select("source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, own: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` (doc_id, text, source and others; ``own``: names of those that come along, else all) with what a mix takes of each row.

    Adds size (words), source_size, target (its source's), key (the order of a source's rows), epochs (how often the row is taken whole), rest (words that
    are taken once more, from the text's start) and taken (words in all).
    """
    added = ("size", "source_size", "target", "key", "epochs", "rest", "taken")
    own = [c for c in own or docs.columns if c not in added and not c.startswith("_mix_")]
    key = F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))).cast("binary")), F.lit(16))
    rows = docs.select(F.struct(*own).alias("_mix_own"), F.col("source").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("key"))
    rows = stored(rows.withColumn("_mix_row", F.monotonically_increasing_id()), "mix")
    placed, ranges = prefix_sums(rows, [F.col("source").asc_nulls_last(), F.col("key"), F.col("size"), F.col("_mix_row")], ["size"], "source", range_rows)
    sources = stored(ranges.groupBy("source").agg(F.sum("_sum_size").cast("long").alias("source_size")), "sources")
    budgets = targets(sources, weights, most, range_rows).withColumn("_budget", F.floor("target"))
    budgets = budgets.withColumnsRenamed({"source": "_source"})
    known = stored(ranges.join(budgets, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("_range").alias("_at"), "_source", "_first_size", "source_size", "target", "_budget"), "budgets")
    joined = placed.join(known, (F.col("_range") == F.col("_at")) & F.col("source").eqNullSafe(F.col("_source")))
    whole = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(0)
    left = F.col("_budget") - whole * F.col("source_size") - F.col("_first_size").cast("long") - F.col("_within_size")
    found = joined.select("_mix_own", "size", "source_size", "target", "key", F.when(F.col("size") > 0, whole).otherwise(0).alias("epochs"), F.greatest(F.lit(0).cast("long"), F.least(left, F.col("size"))).alias("rest"))
    return found.select(*(F.col("_mix_own").getField(c).alias(c) for c in own), "size", "source_size", "target", "key", "epochs", "rest", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"))


def samples(mixed: DataFrame, text: str = "text") -> DataFrame:
    """A row for each time that the mix takes a text: its own columns, epoch (from 0), n_words, the text (cut after n_words in the last epoch), and order, by which
    sorting deals the epochs' rows at random."""
    epochs = F.when(F.col("rest") > 0, F.col("epochs") + 1).otherwise(F.col("epochs"))
    rows = mixed.where(epochs > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)))
    last = F.col("epoch") == F.col("epochs")
    cut = F.when(last & (F.col("rest") < F.col("size")), F.concat_ws(" ", F.slice(words(F.col(text)), F.lit(1), F.col("rest").cast("int")))).otherwise(F.col(text))
    return rows.withColumns({"n_words": F.when(last, F.col("rest")).otherwise(F.col("size")), text: cut, "order": F.md5(F.concat_ws(":", F.col("epoch"), F.col("key")).cast("binary"))})


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs", "rest")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
  left(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 16) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER w, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * source_size * weights < (total - caps) * weight AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE
    ELSE weight::DOUBLE * (total - sum(CASE WHEN is_full THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM f),
b AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, greatest(0, least(floor(target)::BIGINT - whole * source_size - before, size))::BIGINT AS rest FROM b)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN whole ELSE 0 END * size + rest)::BIGINT AS taken, (CASE WHEN size > 0 THEN whole ELSE 0 END)::BIGINT AS epochs, rest FROM e
"""
