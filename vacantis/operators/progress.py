"""State of ingest tasks from their progress events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantis import fixed_values as fixed

FINISHED = ["completed", "error"]
COUNTERS = ["processed_jobs", "total_jobs", "saved_jobs"]


def states_with_position(events: DataFrame) -> DataFrame:
    """Last state per (task, source) by time and event id, with the places of its first and last event."""
    position = F.struct("ts", "event_id")
    state = F.struct("status", *COUNTERS, "message")
    return (
        events.groupBy("task_id", "source")
        .agg(F.max_by(state, position).alias("state"), F.min(position).alias("started"), F.max(position).alias("last"))
        .select("task_id", "source", "started", "last", "state.*")
    )


def latest_states(events: DataFrame) -> DataFrame:
    """Last state per (task, source) by time and event id, with the time of its first event."""
    return states_with_position(events).drop("last")


def merged_states(states: DataFrame) -> DataFrame:
    """States of several batches in one: the same as those of all their events."""
    state = F.struct("status", *COUNTERS, "message")
    return (
        states.groupBy("task_id", "source")
        .agg(F.max_by(state, "last").alias("state"), F.min("started").alias("started"), F.max("last").alias("last"))
        .select("task_id", "source", "started", "last", "state.*")
    )


def still_needed(states: DataFrame, forget: str | None) -> DataFrame:
    """Without the states of tasks that ended, with all their sources, ``forget`` before the newest event."""
    if forget is None:
        return states
    newest = states.agg(F.max("last.ts").alias("newest"))
    ended = (
        states.groupBy("task_id")
        .agg(F.every(F.col("status").isin(FINISHED)).alias("ended"), F.max("last.ts").alias("ts"))
        .where(F.col("ended") & (F.col("ts") < newest.scalar() - F.expr(f"INTERVAL {forget}")))
    )
    return states.join(ended.select("task_id"), "task_id", "left_anti")


def with_declared(states: DataFrame, declared: DataFrame | None) -> DataFrame:
    """States of all sources of a task: declared (task_id, source) without events are ``queued``."""
    if declared is None:
        return states
    silent = declared.select("task_id", "source").distinct().join(states, ["task_id", "source"], "left_anti")
    zero = {c: F.lit(0) for c in COUNTERS} | {"status": F.lit("queued"), "message": F.lit(fixed.SOURCE_QUEUED)}
    return states.unionByName(silent.withColumns(zero), allowMissingColumns=True)


def _share(part: Column, whole: Column) -> Column:
    return F.bround(part / whole * 100.0, 2)


def _source_share() -> Column:
    """Percentage per (task, source): completed is 100, a failed empty source too."""
    total = F.col("total_jobs")
    return (
        F.when(F.col("status") == "completed", F.lit(100.0))
        .when(total > 0, _share(F.col("processed_jobs"), total))
        .when(F.col("status") == "error", F.lit(100.0))
        .otherwise(F.lit(0.0))
    )


def source_progress_of(states: DataFrame) -> DataFrame:
    return states.withColumn("progress_pct", _source_share()).drop("started")


def source_progress(events: DataFrame) -> DataFrame:
    return source_progress_of(latest_states(events))


def task_progress_of(states: DataFrame, *more: Column) -> DataFrame:
    """Totals, share and overall status per task; the current source is the running one
    that started first. ``more`` are further aggregates over the sources of a task."""
    finished = F.col("status").isin(FINISHED)
    running = F.when(F.col("status") == "running", F.struct("started", "source"))
    tasks = states.groupBy("task_id").agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.count("*").alias("total_sources"),
        F.count_if(finished).alias("completed_sources"),
        F.min(running)["source"].alias("current_source"),
        F.count_if(F.col("status") == "error").alias("_errors"),
        F.count_if(F.col("status") == "queued").alias("_queued"),
        *more,
    )
    done, total = F.col("completed_sources"), F.col("total_sources")
    return tasks.withColumns({
        "progress_pct": F.when(
            F.col("total_jobs") > 0, _share(F.col("processed_jobs"), F.col("total_jobs"))
        ).otherwise(_share(done, total)),
        "status": F.when(F.col("_queued") == total, "queued")
        .when(done < total, "running")
        .when(F.col("_errors") > 0, "completed_with_errors")
        .otherwise("completed"),
    }).drop("_errors", "_queued")


def ingest_progress(events: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Progress of tasks; ``declared`` names the sources that each was started with."""
    return task_progress_of(with_declared(latest_states(events), declared))


STATUS = [
    "task_id", "status", "message", "queued_sources", "total_sources", "completed_sources", "current_source",
    *COUNTERS, "progress_pct", "started_at", "updated_at", "sources",
]


def task_status_of(states: DataFrame) -> DataFrame:
    """One row per task in the shape of STATUS, from ``states_with_position`` (and ``with_declared``).

    ``sources`` maps each source, by name, to its own state; ``queued_sources`` are their names. The message names
    the source of the task's last event. Times are those of its first and last event, NULL where it has none.
    A task's lists are as long as it has sources.
    """
    state = F.struct("status", *COUNTERS, _source_share().alias("progress_pct"), "message")
    tasks = task_progress_of(
        states,
        F.array_sort(F.collect_list(F.struct("source", state.alias("state")))).alias("entries"),
        F.max(F.when(F.col("last").isNotNull(), F.struct("last", "source"))).alias("newest"),
        F.min("started.ts").alias("started_at"),
    )
    return tasks.withColumns({
        "message": F.when(F.col("newest").isNull(), F.lit(fixed.TASK_QUEUED))
        .otherwise(F.concat(F.lit(fixed.TASK_RUNNING), F.col("newest.source"))),
        "queued_sources": F.col("entries.source"),
        "updated_at": F.col("newest.last.ts"),
        "sources": F.map_from_entries("entries"),
    }).select(*STATUS)


def task_status(events: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Status of tasks with that of each of their sources; ``declared`` as for ``ingest_progress``."""
    return task_status_of(with_declared(states_with_position(events), declared))
