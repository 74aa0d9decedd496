"""Extension points for models, and job metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from threading import Condition
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Backend(Protocol):
    """A model worker.  It is made once per partition and closed at its end."""

    name: str

    def is_available(self) -> bool: ...

    def analyse(self, texts: pd.Series) -> pd.Series: ...

    def cleanup(self) -> None: ...


def enrich(rows: DataFrame, prompt: str, answer: str, make: Callable[[], Backend] | None, default: str) -> DataFrame:
    """Add ``answer`` from a model that reads ``prompt``; without a model it is the ``default`` column."""
    if make is None:
        return rows.withColumn(answer, F.col(default))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        try:
            ready = backend.is_available()
            for batch in batches:
                texts = backend.analyse(batch[prompt]) if ready else batch[default]
                yield batch.assign(**{answer: texts})
        finally:
            backend.cleanup()

    return rows.mapInPandas(work, rows.withColumn(answer, F.lit("")).schema)


def observed(rows: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, Observation]:
    """Count the rows that pass while a job runs, and take other figures of them."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in figures.items()]), seen


METRICS = "job string, step bigint, metric string, value double, at timestamp"


def record(spark: SparkSession, path: str, job: str, figures: dict, step: int = 0) -> None:
    """Append figures of a job to the table of metrics; those without a value are left out."""
    now = datetime.now(UTC).replace(tzinfo=None)
    rows = [(job, step, k, float(v), now) for k, v in figures.items() if v is not None]
    if rows:
        spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("append").parquet(path)


class Progress(StreamingQueryListener):
    """Keeps what streams report while they run: input rows, rows of state and observed figures per micro-batch.

    Listeners are told on a thread of their own; ``finished`` waits until the end of a query was told.
    """

    def __init__(self):
        self.reports: list[tuple[str, int, dict]] = []
        self._ended: set[str] = set()
        self._news = Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        figures = {"input_rows": p.numInputRows, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}
        for row in p.observedMetrics.values():
            figures |= row.asDict()
        with self._news:
            self.reports.append((str(p.id), p.batchId, figures))

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def finished(self, query: StreamingQuery, seconds: float = 60) -> list[tuple[int, dict]]:
        """All reports of a query that has stopped: micro-batch and figures."""
        query.awaitTermination()
        with self._news:
            if not self._news.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError(f"no end of query {query.id} was reported within {seconds} s")
            return [(batch, figures) for ident, batch, figures in self.reports if ident == str(query.id)]


def cancel(spark: SparkSession, group: str) -> None:
    """Stop the jobs of a group set with ``setJobGroup``."""
    spark.sparkContext.cancelJobGroup(group)
