"""Findings together: dedup scopes, winners among detectors, correlation, baselines, increments and access targets.

A finding has doc_id, k, detector_id, service, severity_rank, credential_hash, path, line, offset and confidence.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup(findings: DataFrame, scope: str, locations: bool = False) -> DataFrame:
    """One row for each (detector, credential) and, in scope ``file``, path: its first location, and how many other lines there are. Scope ``none`` keeps all.

    ``locations``: also the other lines themselves, as distinct (path, line) in the order of their offsets, ``additional``.
    """
    if scope == "none":
        return findings
    keys = ["detector_id", "credential_hash"] + (["path"] if scope == "file" else [])
    place = F.struct("offset", "path", "line")
    found = findings.groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("n_matches"), F.count_distinct("path", "line").alias("n_places"), F.max("confidence").alias("confidence"))
    rest = [] if scope == "file" else [F.col("first.path").alias("path")]
    if locations:
        each = findings.groupBy(*keys, F.col("path").alias("_path"), "line").agg(F.min("offset").alias("_at"))
        every = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_at"), F.col("_path").alias("path"), "line"))).alias("_all"))
        own = F.struct(F.col("first.path").alias("path"), F.col("first.line").alias("line"))
        others = F.filter(F.transform("_all", lambda x: F.struct(x["path"].alias("path"), x["line"].alias("line"))), lambda x: ~x.eqNullSafe(own))
        matched = [found[k].eqNullSafe(every[k]) for k in keys]
        found = found.join(every, matched).select(*(found[k] for k in keys), "first", "n_matches", "n_places", "confidence", "_all").withColumn("_others", others)
        rest = [*rest, F.col("_others").alias("additional")]
    return found.select(*keys, *rest, F.col("first.line").alias("line"), F.col("first.offset").alias("offset"), "n_matches", (F.col("n_places") - 1).alias("n_additional"), "confidence")


def near_once(findings: DataFrame, within_lines: int) -> DataFrame:
    """Findings without those that stand at most so many lines behind one of the same detector, value and path: overlapping windows see a value twice."""
    order = Window.partitionBy("path", *KEY).orderBy("line", "offset", "doc_id")
    return findings.withColumn("_before", F.lag("line").over(order)).where(F.col("_before").isNull() | (F.col("line") - F.col("_before") > within_lines)).drop("_before")


def winners(findings: DataFrame) -> DataFrame:
    """One finding for each credential and path: a named detector before entropy, then confidence, severity and id; the losers' ids as a list."""
    order = Window.partitionBy("credential_hash", "path").orderBy(F.col("detector_id").startswith("entropy"), F.desc("confidence"), F.desc("severity_rank"), "detector_id", "offset", "doc_id")
    ranked = findings.withColumn("_n", F.row_number().over(order))
    first = F.max(F.when(F.col("_n") == 1, F.struct("detector_id", "confidence", "severity_rank", "line")))
    losers = F.array_join(F.array_sort(F.collect_set(F.when(F.col("_n") > 1, F.col("detector_id")))), ",")
    return ranked.groupBy("credential_hash", "path").agg(first.alias("w"), losers.alias("losers")).select("credential_hash", "path", "w.*", "losers")


def coalesced(spans: DataFrame, *keys: str) -> DataFrame:
    """Overlapping and touching spans (start, end) of the same keys as one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    once = spans.groupBy(*keys, "start", "end").agg(F.count("*").alias("_n"))  # so that no two rows tie
    islands = once.withColumn("_new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_n").alias("n_spans")).drop("_island")


def value_reuse(findings: DataFrame, bonus: float = 0.15, ceiling: float = 1.0) -> DataFrame:
    """Credentials in two paths or more: number of paths, the service (``multiple`` if they differ), and the strongest score with a bonus."""
    found = findings.groupBy("credential_hash").agg(F.count_distinct("path").alias("n_paths"), F.when(F.min("service") == F.max("service"), F.min("service")).otherwise("multiple").alias("service"), F.max("confidence").alias("best"), F.max("severity_rank").alias("severity_rank"))
    return found.where("n_paths >= 2").select("credential_hash", "n_paths", "service", "severity_rank", F.least(F.lit(ceiling), F.col("best") + bonus).alias("confidence"))


def composites(findings: DataFrame, required: tuple[str, str], bonus: float = 0.30) -> DataFrame:
    """Folders where both detectors fire, each in one file, and not in the same: the halves of a credential that was split."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rows = findings.where(F.col("detector_id").isin(*required)).withColumn("folder", folder)
    files = lambda d: F.collect_set(F.when(F.col("detector_id") == d, F.col("path")))
    found = rows.groupBy("folder").agg(files(required[0]).alias("a"), files(required[1]).alias("b"), F.max("confidence").alias("best"))
    single = (F.size("a") == 1) & (F.size("b") == 1) & ~F.arrays_overlap("a", "b")
    ident = F.concat(F.lit(f"composite:{'+'.join(required)}@"), F.col("folder"))
    return found.where(single).select(ident.alias("composite_id"), F.get("a", F.lit(0)).alias("first_path"), F.get("b", F.lit(0)).alias("second_path"), F.least(F.lit(1.0), F.col("best") + bonus).alias("confidence"))


@dataclass(frozen=True)
class Composite:
    """A credential in several parts, as data: detectors that have to fire and those that may, within one ``folder`` or one ``file``."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    scope: str = "folder"
    bonus: float = 0.30
    optional_bonus: float = 0.05


def correlated(findings: DataFrame, policies: tuple[Composite, ...]) -> DataFrame:
    """Places where all required parts of a policy are found: policy, place, mask (bits of the parts that are there, required ones first), parts (detector_id to the value's hash and
    path) and confidence (that of the strongest part, and what the policy adds for its parts; 1 at most).

    A part that has two values or more in a place says nothing sure: if it is a required one, the place is silent; an optional one doesn't count. All policies are one
    aggregation with partial sums: bits by or, and a part's least and greatest value. Nulls: a finding without path or hash takes no part.
    """
    widest = max((len(p.required) + len(p.optional) for p in policies), default=0)
    if not widest or any(p.scope not in ("folder", "file") or not p.required for p in policies):
        raise ValueError("a policy needs required parts, and folder or file as scope")
    places = {"file": F.col("path"), "folder": F.regexp_replace("path", "/[^/]*$", "")}
    takes = [F.when(F.col("detector_id") == d, F.struct(F.lit(p.name).alias("policy"), F.lit(k).alias("part"), places[p.scope].alias("place"))) for p in policies for k, d in enumerate((*p.required, *p.optional))]
    rows = findings.where("path IS NOT NULL AND credential_hash IS NOT NULL").select("detector_id", "credential_hash", "path", "confidence", F.explode(F.array_compact(F.array(*takes))).alias("t")).select("*", "t.*")
    value = F.struct("credential_hash", "path", "detector_id")
    here = lambda k: F.when(F.col("part") == k, value)
    each = [x for k in range(widest) for x in (F.min(here(k)).alias(f"_low{k}"), F.max(F.when(F.col("part") == k, F.col("credential_hash"))).alias(f"_high{k}"))]
    found = rows.groupBy("policy", "place").agg(F.max("confidence").alias("best"), *each)
    sure = [F.coalesce(F.col(f"_low{k}.credential_hash") == F.col(f"_high{k}"), F.lit(False)) for k in range(widest)]
    by_policy = lambda what: F.element_at(F.create_map(*(x for p in policies for x in (F.lit(p.name), F.lit(what(p))))), F.col("policy"))
    found = found.withColumn("mask", reduce(add, (F.when(s, 1 << k).otherwise(0) for k, s in enumerate(sure))))
    needed = by_policy(lambda p: (1 << len(p.required)) - 1)
    more = F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not(needed)))
    parts = F.map_from_entries(F.array_compact(F.array(*(F.when(s, F.struct(F.col(f"_low{k}.detector_id"), F.struct(F.col(f"_low{k}.credential_hash"), F.col(f"_low{k}.path")))) for k, s in enumerate(sure)))))
    confidence = F.least(F.lit(1.0), F.col("best") + by_policy(lambda p: p.bonus) + more * by_policy(lambda p: p.optional_bonus))
    return found.where(F.col("mask").bitwiseAND(needed) == needed).select("policy", "place", "mask", parts.alias("parts"), confidence.alias("confidence"))


KEY = ["detector_id", "credential_hash"]


def not_in_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose detector and credential the baseline doesn't have, whatever their path and line."""
    return findings.join(baseline.select(*KEY).distinct(), KEY, "left_anti")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """detector_id, credential_hash and state: new, removed or unchanged."""
    old, new = before.select(*KEY).distinct().withColumn("_old", F.lit(True)), after.select(*KEY).distinct().withColumn("_new", F.lit(True))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").otherwise("unchanged")
    return old.join(new, KEY, "full").select(*KEY, state.alias("state"))


def changed(chunks: DataFrame, seen: DataFrame, spec_hash: str) -> DataFrame:
    """Chunks whose content wasn't scanned with the same detectors yet. ``seen``: path, base_offset, content_hash, spec_hash."""
    rows = chunks.withColumn("content_hash", F.sha2("text", 256)).withColumn("spec_hash", F.lit(spec_hash))
    return rows.join(seen, ["path", "base_offset", "content_hash", "spec_hash"], "left_anti")


def nearest_targets(findings: DataFrame, targets: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """The address nearest to each finding of the same document: decoded from the same value first, then on the same line, then by lines; 0.85 for each 25 lines between, four
    times at most.

    ``targets``: doc_id, target, line; ``decoded``: doc_id, k, target, for addresses inside a finding's own value. A target that is itself a reported credential is left out.
    Findings and targets of a document stand in one order, and each finding looks to the last target before it and the first behind it: no pairs are made.
    """
    free = targets.join(findings.select(F.col("credential_hash").alias("_h")).distinct(), F.sha2("target", 256) == F.col("_h"), "left_anti")
    own = findings.select("doc_id", "line", F.lit(1).alias("_kind"), "k", "confidence", F.lit(None).cast("string").alias("target"))
    both = own.unionByName(free.select("doc_id", F.col("line"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("confidence"), "target"))
    here = F.when(F.col("_kind") == 0, F.struct("line", "target"))
    # Targets of a line come before its findings in the one order, and behind them in the other.
    above = Window.partitionBy("doc_id").orderBy("line", "_kind", F.desc("target")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("doc_id").orderBy("line", F.desc("_kind"), "target").rowsBetween(0, Window.unboundedFollowing)
    placed = both.withColumn("_up", F.last(here, ignorenulls=True).over(above)).withColumn("_down", F.first(here, ignorenulls=True).over(below)).where("_kind = 1")
    options = F.filter(F.array("_up", "_down"), lambda t: t.isNotNull())
    ranked = F.array_min(F.transform(options, lambda t: F.struct(F.abs(F.col("line") - t["line"]).alias("distance"), t["line"].alias("line"), t["target"].alias("target"))))
    rows = placed.withColumn("_best", ranked)
    if decoded is not None:
        inner = decoded.groupBy("doc_id", "k").agg(F.min("target").alias("_inner"))
        rows = rows.join(inner, ["doc_id", "k"], "left")
    else:
        rows = rows.withColumn("_inner", F.lit(None).cast("string"))
    relation = F.when(F.col("_inner").isNotNull(), "decoded").when(F.col("_best.distance") == 0, "same_line").otherwise("same_file")
    distance = F.when(F.col("_inner").isNotNull(), F.lit(0).cast("long")).otherwise(F.col("_best.distance"))
    found = rows.where("_inner IS NOT NULL OR _best IS NOT NULL").select("doc_id", "k", F.coalesce("_inner", "_best.target").alias("target"), relation.alias("relation"), distance.alias("distance"), "confidence")
    return found.withColumn("confidence", F.col("confidence") * F.pow(F.lit(0.85), F.least(F.lit(4), F.floor(F.col("distance") / 25))))


def union_unique(real: DataFrame, decoded: DataFrame, *keys: str) -> DataFrame:
    """All rows once by their keys; those of ``real`` win."""
    both = real.withColumn("_from", F.lit(0)).unionByName(decoded.withColumn("_from", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy("_from", *[c for c in real.columns if c not in keys])
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").withColumn("decoded", F.col("_from") == 1).drop("_n", "_from")
