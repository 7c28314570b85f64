"""Streams over the ``events`` table, and the change log of watched paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.storage import shared_path

from . import composed, machines

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The table as a stream of its files."""
    return spark.readStream.schema(EVENTS).parquet(f"{folder}/events.parquet*")


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of values for each window and type; events later than ``late`` are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events without a longer pause than ``gap``: start, and number of events."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), "n")


def first_seen(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each user and type once while the watermark remembers them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])


#: What two events of one path make together, by (before, after); any pair that isn't here makes the later one.
FOLDS = {("remove", "create"): "create", ("create", "modify"): "create", ("remove", "modify"): "create"}


def change_events(events: DataFrame) -> DataFrame:
    """Events as a change log: root, path, kind, seq and ts."""
    kind = F.when(F.col("event_type").isin("view", "purchase"), "modify").when(F.col("event_type") == "error", "remove").otherwise("create")
    return events.select(F.pmod("user_id", F.lit(8)).alias("root"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"), F.col("event_id").alias("seq"), "ts")


def folded(kinds: Column) -> Column:
    """One kind for the kinds of a path in their order."""

    def step(before: Column, after: Column) -> Column:
        found = F.when(before.isNull(), after)
        for (a, b), kind in FOLDS.items():
            found = found.when((before == a) & (after == b), kind)
        return found.otherwise(after)

    return F.aggregate(kinds, F.lit(None).cast("string"), step)


def coalesced(changes: DataFrame, size: str = "10 minutes") -> DataFrame:
    """One change for each path and window: the fold of its kinds by sequence."""
    found = changes.withWatermark("ts", "2 hours").groupBy(F.window("ts", size), "root", "path").agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("all"))
    return found.select("root", "path", F.col("window.start").alias("start"), folded(F.transform("all", lambda x: x["kind"])).alias("kind"), F.size("all").alias("n_events"))


def root_states(changes: DataFrame, most_pending: int = 8192) -> DataFrame:
    """Per root and batch: its state and how many changes it has seen. More changes at once than ``most_pending`` make it degraded, to be reconciled; none is dropped."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (0, 0)
        pending = 0
        for frame in frames:
            pending += len(frame)
            last = max(last, int(frame["seq"].max()))
        state.update((seen + pending, last))
        yield pd.DataFrame([(key[0], "degraded" if pending > most_pending else "dirty", seen + pending, last)], columns=["root", "state", "n_seen", "last_seq"])

    return changes.groupBy("root").applyInPandasWithState(update, "root long, state string, n_seen long, last_seq long", "n_seen long, last_seq long", "update", "NoTimeout")


def run(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now, and read its last result back. The output of a batch that is run again replaces the earlier one."""
    spark, out = stream.sparkSession, shared_path(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}" if mode != "complete" else f"{out}/last")

    stream.writeStream.outputMode(mode).option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


#: Kinds of a change log. A reconcile says that a root was listed anew, a barrier that all before it has been seen.
KINDS = ("create", "modify", "remove", "rename", "reconcile", "barrier")
#: States of a root: what each kind of change, or an outcome, leads to from it. What isn't here leaves it as it is; stopped is the end.
STATES: dict[str, dict[str, str]] = {
    "indexing": {"barrier": "current", "overflow": "degraded", "error": "blocked", "stop": "stopped"},
    "current": {"create": "dirty", "modify": "dirty", "remove": "dirty", "rename": "dirty", "overflow": "degraded", "error": "blocked", "policy": "stale-policy", "stop": "stopped"},
    "dirty": {"barrier": "current", "overflow": "degraded", "error": "blocked", "policy": "stale-policy", "stop": "stopped"},
    "degraded": {"reconcile": "indexing", "error": "blocked", "stop": "stopped"},
    "blocked": {"reconcile": "indexing", "stop": "stopped"},
    "stale-policy": {"reconcile": "indexing", "stop": "stopped"},
    "stopped": {},
}


def final_states(changes: DataFrame) -> DataFrame:
    """State of each root after all its changes (root, kind, seq) in their order, begun at indexing. Changes compose, so a root's history is spread, see ``composed``."""
    names = list(STATES)
    steps = {kind: [names.index(to.get(kind, s)) for s, to in STATES.items()] for to in STATES.values() for kind in to}
    stay = list(range(len(names)))

    def element(columns: dict) -> np.ndarray:
        coded = columns["kind"].dictionary_encode(null_encoding="encode")
        table = np.array([steps.get(k, stay) for k in coded.dictionary.to_pylist()], float).reshape(-1, len(names))
        return table[np.asarray(coded.indices)]

    found = composed.composed(changes, "root", "seq", ["kind"], element, composed.then)
    state = F.get(F.array(*map(F.lit, names)), F.get("element", F.lit(names.index("indexing"))).cast("int"))
    return found.select("root", state.alias("state"), F.col("last").alias("last_seq"))


def root_machine(changes: DataFrame) -> DataFrame:
    """The same as a stream: root, state and last_seq after each batch, see ``machines``."""
    return machines.root_machine(changes, STATES)


def replayed(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The paths that are there after a snapshot (root, path, seq) and the changes (root, path, kind, seq) that are newer than it: subscribed first, listed then, replayed by sequence."""
    newer = changes.join(snapshot.groupBy("root").agg(F.max("seq").alias("_at")), "root", "left").where("_at IS NULL OR seq > _at")
    last = newer.where(F.col("kind").isin("create", "modify", "remove")).groupBy("root", "path").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("_seq"))
    both = snapshot.select("root", "path", "seq").join(last, ["root", "path"], "full")
    return both.where("kind IS NULL OR kind <> 'remove'").select("root", "path", F.greatest(F.coalesce("_seq", F.lit(0)), F.coalesce("seq", F.lit(0))).alias("seq"))


def fragment_stream(fragments: DataFrame, near: int = 100, hold: str = "1 hour") -> DataFrame:
    """Fragments of values (path, prefix, line, value, ts) joined with those of the same path and prefix that came before and are near, over batches.

    A self join of the stream with a bound on time: what is older than ``hold`` is forgotten. The join is on stretches of lines, too, so that a fragment meets those near it and not all of its
    path and prefix: an own one stands in its stretch, the other one in each stretch that is near it (at most two, as a stretch is four times as long as ``near``).
    """
    stretch = lambda line: F.floor(line / (4 * near))
    own = fragments.withColumn("_at", stretch(F.col("line"))).withWatermark("ts", hold)
    places = F.array_distinct(F.array(stretch(F.col("line") - near + 1), stretch(F.col("line") + near - 1)))
    other = fragments.select(F.col("path").alias("path_b"), F.col("prefix").alias("prefix_b"), F.col("line").alias("line_b"), F.col("value").alias("value_b"), F.col("ts").alias("ts_b"), F.explode(places).alias("_at_b")).withWatermark("ts_b", hold)
    same = (F.col("path") == F.col("path_b")) & (F.col("prefix") == F.col("prefix_b")) & (F.col("_at") == F.col("_at_b")) & (F.abs(F.col("line") - F.col("line_b")) < near) & (F.col("line") != F.col("line_b"))
    in_time = (F.col("ts_b") <= F.col("ts") + F.expr(f"INTERVAL {hold}")) & (F.col("ts_b") >= F.col("ts") - F.expr(f"INTERVAL {hold}"))
    return own.join(other, same & in_time).select("path", "prefix", "line", "line_b", F.concat("value", "value_b").alias("joined"))


def rate_limits(answers: DataFrame, start: float = 0.5, longest: float = 8.0, most_errors: int = 50) -> DataFrame:
    """The pause before requests of each service after its answers (service, seq, status) in order: doubled by 429 up to the longest, and half of what is above the start given back by others.

    ``pressed``: the service has had over ``most_errors`` errors without a success between. Answers compose (a pause is a linear function with a bound, a count one with
    resets), so a service's history is spread, see ``composed``.
    """
    def element(columns: dict) -> np.ndarray:
        status = np.asarray(columns["status"].fill_null(0))
        limited = status == 429
        failed = limited | (status >= 500)
        pause = np.column_stack([np.where(limited, 2.0, 0.5), np.where(limited, 0.0, start / 2), np.full(len(status), longest)])
        return np.column_stack([pause, ~failed, failed])

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.column_stack([composed.clamped(a[:, :3], b[:, :3], start), composed.counted(a[:, 3:], b[:, 3:])])

    found = composed.composed(answers, "service", "seq", ["status"], element, join)
    x = lambda k: F.get("element", F.lit(k))
    pause = F.least(x(2), x(0) * start + x(1))
    return found.select("service", F.round(pause, 6).alias("pause"), (x(4) > most_errors).alias("pressed"), "n")


def split_readable(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON (``value``) as rows of the schema, and those that can't be read, so that a stream goes on: (rows, malformed with the reason)."""
    parsed = rows.withColumn("_r", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    return parsed.where(~bad).select("_r.*").drop("_corrupt"), parsed.where(bad).select("value", F.lit("malformed").alias("reason"))


#: What loading the state of incremental scans can say; all but ``loaded`` mean that everything is scanned.
LOADED = ("missing", "loaded", "schema_mismatch", "spec_changed", "invalid_hash")


def load_state(states: DataFrame, roots: DataFrame, version: int, spec_hash: str) -> DataFrame:
    """root and status for ``roots``: whether its state (root, schema_version, spec_hash, content_hash) can be used with these detectors."""
    rows = roots.select("root").distinct().join(states, "root", "left")
    status = F.when(F.col("schema_version").isNull(), "missing").when(F.col("schema_version") != version, "schema_mismatch").when(F.col("spec_hash") != spec_hash, "spec_changed").when(~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "invalid_hash").otherwise("loaded")
    return rows.select("root", status.alias("status"))
