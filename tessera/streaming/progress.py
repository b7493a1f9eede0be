"""Progress of streaming builds: what each trigger read, and the counters that the plan observes on the way."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Name of the counters in a trigger's observed metrics.
COUNTERS = "build"


def counted(stream: DataFrame, tokens: Column | None = None, **more: Column) -> DataFrame:
    """stream that counts its rows (and tokens, and further sums) in each trigger, in the same pass."""
    sums = [F.count(F.lit(1)).alias("texts"), *([F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")] if tokens is not None else []), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in more.items())]
    return stream.observe(COUNTERS, *sums)


class Progress(StreamingQueryListener):
    """Adds up what the triggers of the session's queries count, by query id, and reports each time another `every` of `unit` has been passed."""

    def __init__(self, every: int = 10_000_000, unit: str = "tokens", report: Callable[[dict], None] | None = None):
        self.every, self.unit, self.report = every, unit, report or (lambda x: print(json.dumps(x), flush=True))
        self.totals: dict[str, dict[str, int]] = {}
        self.triggers: dict[str, list[dict]] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.totals.setdefault(str(event.id), {})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        query, row = str(p.id), p.observedMetrics.get(COUNTERS)
        counts = row.asDict() if row is not None else {}
        total = self.totals.setdefault(query, {})
        before = total.get(self.unit, 0)
        for name, n in {"rows": p.numInputRows, **counts}.items():
            total[name] = total.get(name, 0) + n
        self.triggers.setdefault(query, []).append({"trigger": p.batchId, "rows": p.numInputRows, "seconds": p.durationMs.get("triggerExecution", 0) / 1000, **counts})
        if total.get(self.unit, 0) // self.every > before // self.every:
            self.report({"query": query, "trigger": p.batchId, **total})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception


def watch(spark: SparkSession, **options) -> Progress:
    """A Progress that listens to the session's queries, until spark.streams.removeListener(it)."""
    out = Progress(**options)
    spark.streams.addListener(out)
    return out
