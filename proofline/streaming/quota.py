"""Quota meter as keyed state: one state per user and month, closed by an event-time timer.

State lives in the session's state store (RocksDB), so a micro-batch reads and writes only the users it names. A month is
closed, and its state removed, once the watermark passes its end. Uses older than the watermark are late: they are not
metered and go to the side table. Spark would drop them in front of a stateful operator; the meter therefore gets the
time as a plain number and compares it with the watermark itself.

Verdicts and late uses are written by the file sink, which takes every micro-batch exactly once, also after a restart.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

VERDICTS = "event_id bigint, user_id bigint, month string, cost int, accepted boolean, late boolean"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COLUMNS = [c.split()[0] for c in VERDICTS.split(", ")]


class QuotaMeter(StatefulProcessor):
    """Verdicts of one user and month.

    Within a micro-batch uses count by time and event id. Of the uses of one cost only the earliest ``left // cost`` can
    be accepted, so that many candidates are held and every other use is rejected as it passes: memory is bounded by the
    quota, however many uses a user has. An event that was judged before, in this batch or an earlier one, has no further
    verdict. A use without cost is accepted.
    """

    def __init__(self, quotas: dict[str, int]):
        self.quotas = quotas

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "used bigint")
        self.judged = handle.getMapState("judged", "event_id bigint", "accepted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, stored = timerValues.getCurrentWatermarkInMs(), self.used.exists()
        used = int(self.used.get()[0]) if stored else 0
        waiting: dict[tuple[int, int], list] = {}  # by cost and quota: the earliest uses, the latest of them on top
        held: set[int] = set()
        ends = None

        def verdict(event: int, cost: int, accepted: bool | None, late: bool = False) -> tuple:
            if not late:
                self.judged.updateValue((event,), (accepted,))
            return event, key[0], key[1], cost, accepted, late

        for chunk in rows:
            out = []
            for event, ms, plan, cost, end in zip(*(chunk[c].tolist() for c in ("event_id", "ms", "plan_id", "cost", "ends"))):
                event = int(event)
                if event in held or self.judged.containsKey((event,)):
                    continue
                if ms < watermark or ms < 0:
                    out.append(verdict(event, cost, None, late=True))
                    continue
                ends, quota = int(end), self.quotas.get(plan, 0)
                if cost <= 0:
                    out.append(verdict(event, cost, True))
                    continue
                heap = waiting.setdefault((cost, quota), [])
                heapq.heappush(heap, (-ms, -event))
                held.add(event)
                if len(heap) > max(0, quota - used) // cost:
                    _, last = heapq.heappop(heap)
                    held.remove(-last)
                    out.append(verdict(-last, cost, False))
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)
        out = []
        for ms, event, cost, quota in sorted((-m, -e, cost, quota) for (cost, quota), heap in waiting.items() for m, e in heap):
            fits = used + cost <= quota
            used += cost if fits else 0
            out.append(verdict(event, cost, fits))
        if ends is not None:
            if not stored:
                self.handle.registerTimer(ends)
            self.used.update((used,))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        self.judged.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """The store that keyed state needs, for the start of one query."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def metered(uses: DataFrame, quotas: dict[str, int], delay: str = "1 day") -> DataFrame:
    """Verdicts over a stream of ``event_id, ts, user_id, plan_id, month, cost``, as in :data:`VERDICTS`.

    ``delay`` is how far uses may lag behind the latest one. Late uses, and those without a time, have ``late`` set and
    no verdict. Unknown plans have no quota.
    """
    month = F.trunc("ts", "MM")
    ends = F.unix_millis(F.add_months(month, 1).cast("timestamp"))
    timed = uses.withWatermark("ts", delay).select("event_id", "user_id", "month", "plan_id", F.col("cost").cast("int").alias("cost"),
                                                   F.coalesce(F.unix_millis("ts"), F.lit(-1)).alias("ms"), F.coalesce(ends, F.lit(-1)).alias("ends"))
    return timed.groupBy("user_id", "month").transformWithStateInPandas(QuotaMeter(quotas), VERDICTS, "Append", "eventtime")


def quota_meter(uses: DataFrame, root: str, quotas: dict[str, int], delay: str = "1 day") -> StreamingQuery:
    """Meters what has arrived; a later call with the same ``root`` goes on from there.

    ``root/uses`` holds the verdicts and, in its partition ``late=true``, the side table of late uses.
    """
    with state_store(uses.sparkSession):
        return (metered(uses, quotas, delay).writeStream.format("parquet").partitionBy("late").option("path", f"{root}/uses")
                .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())


def verdicts(spark: SparkSession, root: str) -> DataFrame:
    """All uses seen so far, late ones included."""
    return spark.read.schema(VERDICTS).parquet(f"{root}/uses")
