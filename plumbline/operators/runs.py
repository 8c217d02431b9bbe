"""State of processing runs from their event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordering import measured, with_next, with_position

FAILURES = ("FAILED", "FAIL")
WARNINGS = ("WARNING", "COMPLETE_WITH_WARNINGS")


def run_status(events: DataFrame, key: str = "run_id", order: Sequence[str] = ("ts_s", "seq")) -> DataFrame:
    """Current state and status per run from stage ends, as plain aggregates that combine on the map side.

    A warning stays until a failure follows; a success after a failure clears it; a failed last stage makes the
    run's state FAILED.
    """
    at = F.struct(*order)
    trouble = F.col("status").isin(*FAILURES, *WARNINGS)
    sums = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("transitions"),
        F.max_by("state", at).alias("_state"),
        F.max_by("status", at).alias("_status"),
        F.max_by(F.when(trouble, F.col("status")), F.when(trouble, at)).alias("_trouble"),
        F.count_if(F.col("status").isin(*FAILURES)).alias("failed_stages"),
        F.count_if(F.col("status").isin(*WARNINGS)).alias("warning_stages"),
    )
    failed = F.col("_status").isin(*FAILURES)
    warned = F.coalesce(F.col("_trouble").isin(*WARNINGS), F.lit(False))
    return sums.select(
        key, "transitions", F.when(failed, "FAILED").otherwise(F.col("_state")).alias("current_state"),
        F.when(failed, "FAIL").when(warned, "WARNING").when(F.col("_status").isin("SUCCESS", "PASS"), "PASS")
        .otherwise("RUNNING").alias("run_status"),
        "failed_stages", "warning_stages",
    )


def stage_durations(
    events: DataFrame, key: str = "run_id", order: Sequence[str] = ("ts_s", "seq"), hot_rows: float | None = None
) -> DataFrame:
    """Each transition with the seconds until the next one of its run."""
    stepped = with_next(events, [key], [F.col(c) for c in order], ["ts_s"], hot_rows=hot_rows)
    return stepped.withColumn("duration_s", F.col("next_ts_s") - F.col("ts_s")).drop("next_ts_s")


def paired_stages(
    events: DataFrame, key: str = "run_id", order: Sequence[str] = ("ts_s", "seq"), hot_rows: float | None = None
) -> DataFrame:
    """Stage starts with their ends; a stage without an end is RUNNING. Events carry ``phase`` START or END.

    Stages may overlap, and a stage may start again inside itself: like brackets, an end closes the latest start of its
    stage that is still open. The depth of an event (starts less ends of its stage before it) follows from its ranks among
    all events and among those of its phase, and a start's end is the next event of its depth. Ends without a start close
    nothing; events of other phases are ignored.
    """
    known = events.filter(F.col("phase").isin("START", "END"))
    hot = measured(known, [key]) if hot_rows is None else hot_rows
    columns = [F.col(c) for c in order]
    ranked = with_position(known, [key], columns, "pos", hot)
    ranked = with_position(ranked, [key, "state"], columns, "_all", hot)
    ranked = with_position(ranked, [key, "state", "phase"], columns, "_same", hot)
    depth = F.when(F.col("phase") == "START", 2 * F.col("_same") - 1 - F.col("_all")).otherwise(F.col("_all") - 2 * F.col("_same"))
    leveled = ranked.withColumn("_depth", depth)
    stepped = with_next(leveled, [key, "state", "_depth"], columns, ["ts_s", "status", "phase"], "_at", hot)
    done = F.coalesce(F.col("next_phase") == "END", F.lit(False))
    return stepped.filter("phase = 'START'").select(
        key, "pos", "state", F.col("ts_s").alias("started_at"),
        F.when(done, F.col("next_ts_s")).alias("completed_at"),
        F.when(done, F.col("next_status")).otherwise("RUNNING").alias("status"),
    )


def report_status(stages: DataFrame, key: str = "run_id") -> DataFrame:
    """COMPLETE, COMPLETE_WITH_WARNINGS or FAILED per run: the worst stage decides."""
    rank = F.when(F.col("status").isin(*FAILURES), 2).when(F.col("status").isin(*WARNINGS), 1).otherwise(0)
    worst = stages.groupBy(key).agg(F.max(rank).alias("_rank"))
    names = F.when(F.col("_rank") == 2, "FAILED").when(F.col("_rank") == 1, "COMPLETE_WITH_WARNINGS").otherwise("COMPLETE")
    return worst.select(key, names.alias("report_status"))


def run_report(metrics: DataFrame, key: str = "run_id") -> DataFrame:
    """Stage metrics ``(key, stage, metric, value)`` as one nested map per run; a run has a fixed set of metrics."""
    per_stage = metrics.groupBy(key, "stage").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics")
    )
    return per_stage.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.to_json("metrics").alias("m"))))).alias("sections")
    )
