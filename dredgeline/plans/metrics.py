"""Rows and other measures of a job's stages, taken on the way and kept as a table.

A stage is observed where its rows pass, by the action that runs the job anyhow: nothing is read or counted
again. Streams report through a listener, a row for every micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "stage string, measure string, value double"
STREAM_SCHEMA = "query string, batch long, stage string, measure string, value double"


def _measures(more: dict[str, Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in more.items())]


class StageMetrics:
    """Measures of the stages of batch jobs."""

    def __init__(self) -> None:
        self._stages: list[tuple[str, Observation]] = []

    def stage(self, df: DataFrame, name: str, **more: Column) -> DataFrame:
        """``df``, observed: its rows, and ``more`` aggregates by their names."""
        seen = Observation(name)
        self._stages.append((name, seen))
        return df.observe(seen, *_measures(more))

    def table(self, spark: SparkSession) -> DataFrame:
        """What the stages measured. An action over them must have run: this waits for it."""
        rows = [(name, k, float(v)) for name, seen in self._stages for k, v in seen.get.items() if v is not None]
        return spark.createDataFrame(rows, SCHEMA)


def observed(df: DataFrame, name: str, **more: Column) -> DataFrame:
    """A stage of a stream, to be reported to :class:`StreamMetrics`."""
    return df.observe(name, *_measures(more))


class StreamMetrics(StreamingQueryListener):
    """Measures of every micro-batch. Add it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, str, str, float]] = []
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for stage, row in p.observedMetrics.items():
            self.rows += [(p.name or str(p.id), p.batchId, stage, k, float(v)) for k, v in row.asDict().items() if v is not None]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, STREAM_SCHEMA)
