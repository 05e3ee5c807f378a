"""Grading of arriving results: an extension beside the batch path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import grading
from ..plans.protocol import Protocol


def first_arrivals(rows: DataFrame, key: str, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once; repeats later than `delay` after the first count as new, so the state stays bounded."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def grade_stream(rows: DataFrame, protocol: Protocol, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Grades each micro-batch with the rule stages and hands it to `sink` with its number, which makes a rerun recognisable."""

    def run(batch: DataFrame, number: int) -> None:
        sink(grading.grade(grading.with_context(batch), protocol), number)

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
