"""Numbers gathered while a query runs, in batch and in streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def outcomes(judged: DataFrame, name: str = "outcomes") -> tuple[DataFrame, Observation]:
    """Judged rows as they are, with how many were accepted and rejected seen on the way."""
    seen = Observation(name)
    return judged.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected")), seen


class Progress(StreamingQueryListener):
    """Calls ``report(name, numbers)`` after every micro-batch with rows in, rows a second and the batch's milliseconds."""

    def __init__(self, report: Callable[[str, dict[str, float]], None]) -> None:
        self.report = report

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        self.report(p.name or str(p.id), {"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "milliseconds": p.batchDuration})

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        pass
