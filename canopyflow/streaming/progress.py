"""Progress counters of batch and streaming runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# fixed values: phase names
PHASES = ("cenas_encontradas", "processando", "classificando", "concluido", "erro")


def count_series(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Count rows and failures while they pass by, without another job."""
    seen = Observation(name)
    counted = df.observe(seen, F.count(F.lit(1)).alias("done"),
                         F.count_if(F.col("status") != "ok").alias("failed"))
    return counted, seen


class ProgressLog(StreamingQueryListener):
    """Phases of a streaming query with the rows handled so far."""

    def __init__(self) -> None:
        self.entries: list[dict] = []
        self._done = 0

    def onQueryStarted(self, event) -> None:
        self.entries.append({"phase": PHASES[0], "done": 0})

    def onQueryProgress(self, event) -> None:
        self._done += event.progress.numInputRows
        self.entries.append({"phase": PHASES[1], "done": self._done})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        failed = event.exception is not None
        self.entries.append({"phase": PHASES[4] if failed else PHASES[3], "done": self._done,
                             "message": event.exception})
