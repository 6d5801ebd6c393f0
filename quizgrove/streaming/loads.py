"""A load that can be paused, resumed and stopped (C9). Its state is kept beside its data, so that it holds across sessions.

States are ``running``, ``paused`` (by hand, or because the error budget is spent) and ``stopped``, which is final.
Each change of state is a small record of its own; the newest one holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quizgrove.session import finished_numbers
from quizgrove.streaming import feeds

RUNNING, PAUSED, STOPPED = "running", "paused", "stopped"
STATES = "state string, reason string, changed_at timestamp"


class LoadStateError(RuntimeError):
    """What was asked for is not possible in the load's state."""


@dataclass
class Load:
    """A change feed loaded into ``root``. ``source`` makes the stream anew at each start."""

    spark: SparkSession
    root: str
    source: Callable[[], DataFrame]
    work: Callable[[DataFrame, int], None]
    query: StreamingQuery | None = None

    def history(self) -> DataFrame:
        """All states with their number, from the first on."""
        paths = [f"{self.root}/states/step={n}" for n in finished_numbers(self.spark, f"{self.root}/states/step=")]
        schema = f"{STATES}, step long"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.root}/states").schema(schema).parquet(*paths)

    def state(self) -> str | None:
        """The newest state; None before the first start."""
        numbers = finished_numbers(self.spark, f"{self.root}/states/step=")
        return self.spark.read.schema(STATES).parquet(f"{self.root}/states/step={numbers[-1]}").first()["state"] if numbers else None

    def _note(self, state: str, reason: str | None) -> None:
        numbers = finished_numbers(self.spark, f"{self.root}/states/step=")
        row = self.spark.createDataFrame([(state, reason)], "state string, reason string").withColumn("changed_at", F.current_timestamp())
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/states/step={numbers[-1] + 1 if numbers else 0}")

    def run(self, seconds: int | None = None) -> None:
        """Starts the load, or resumes it after the last finished batch.

        Without ``seconds`` it loads all that is there and returns. A load whose error budget is spent is paused, with the
        reason; resuming it with a larger budget goes on with the batch that was refused.
        """
        if self.state() == STOPPED:
            raise LoadStateError("a stopped load can't be started again")
        if self.query is not None and self.query.isActive:
            raise LoadStateError("the load is running")
        if self.state() != RUNNING:
            self._note(RUNNING, None)
        self.query = feeds.start(self.source(), self.work, f"{self.root}/checkpoint", seconds)
        if seconds is None:
            self.wait()

    def wait(self) -> None:
        """Until the load has ended by itself."""
        try:
            self.query.awaitTermination()
        except StreamingQueryException as error:
            mark = f"{feeds.BudgetError.__name__}: "
            if mark not in str(error):
                raise
            self._note(PAUSED, str(error).split(mark, 1)[1].splitlines()[0].strip())

    def pause(self, reason: str = "by hand") -> None:
        """Ends after the batch in hand, to be resumed."""
        self._end(PAUSED, reason)

    def stop(self, reason: str = "by hand") -> None:
        """Ends for good."""
        self._end(STOPPED, reason)

    def _end(self, state: str, reason: str) -> None:
        if self.state() in (None, STOPPED):
            raise LoadStateError(f"a load that is {self.state() or 'not started'} can't be {state}")
        if self.query is not None and self.query.isActive:
            self.query.stop()
        self._note(state, reason)

    def totals(self) -> DataFrame:
        """One row for the whole load, as ``feeds.load_totals`` adds it up."""
        return feeds.load_totals(feeds.load_progress(self.spark, f"{self.root}/copy"))
