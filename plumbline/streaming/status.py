"""Live state of processing runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators.runs import run_status


def status_stream(events: DataFrame) -> DataFrame:
    """Current state per run, updated with every event; written in update mode as a change log by run.

    The batch operator is made of aggregates only, so the same plan serves the stream; its state is one row per run.
    """
    return run_status(events)
