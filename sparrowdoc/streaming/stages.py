"""The order of a request's stages, held by a state machine for each request.

Events (req_id, at, stage) wait in state until the watermark has passed them, so that they are judged in the order of their
times however late they come (within the watermark's delay; later ones are dropped by Spark). A request that says nothing
for ``timeout`` after its last accepted stage ends with an event ``timeout``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import STAGES

ENDS = ("done", "error")
OUT = "req_id string, at timestamp, stage string, verdict string"


def judge(position: int, ended: bool, stage: str) -> str:
    """accepted, repeated, out_of_order, after_end, or unknown. ``position``: of the last accepted stage, -1 before the first.

    Stages may be left out but not go back, but that a retry may begin anywhere again from retrieving on.
    """
    if stage not in STAGES:
        return "unknown"
    if ended:
        return "after_end"
    at = STAGES.index(stage)
    if at == position:
        return "repeated"
    again = position == STAGES.index("retrying") and at >= STAGES.index("retrieving")
    return "accepted" if at > position or again else "out_of_order"


class _Machine(StatefulProcessor):
    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.request = handle.getValueState("request", "position int, last long, ended boolean")
        self.waiting = handle.getListState("waiting", "at long, stage string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for batch in rows:
            if len(batch):
                times = batch["at"].to_numpy("datetime64[ms]").astype("int64").tolist()
                self.waiting.appendList(list(zip(times, batch["stage"], strict=True)))  # one call to the store, not one for each event
                latest = max(times) if latest is None else max(latest, *times)
        if latest is not None:
            self.handle.registerTimer(latest)  # one for a batch: by then all that came before it may be judged
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        position, last, ended = self.request.get() or (-1, None, False)
        held = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in held if r[0] <= now), key=lambda r: (r[0], STAGES.index(r[1]) if r[1] in STAGES else -1))
        out = []
        for at, stage in due:
            verdict = judge(position, ended, stage)
            if verdict == "accepted":
                position, last, ended = STAGES.index(stage), at, stage in ENDS
            out.append((at, stage, verdict))
        rest = [r for r in held if r[0] > now]
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if not ended and last is not None:
            limit = last + self.timeout_ms
            silent = all(at > limit for at, _ in rest)
            if silent and max(now, timerValues.getCurrentWatermarkInMs()) >= limit:
                ended = True
                out.append((limit, "timeout", "accepted"))
            elif due:
                self.handle.registerTimer(limit)
        self.request.update((position, last, ended))
        if out:
            yield pd.DataFrame({"req_id": key[0], "at": pd.to_datetime([r[0] for r in out], unit="ms"), "stage": [r[1] for r in out], "verdict": [r[2] for r in out]})

    def close(self) -> None:
        pass


def ordered(events: DataFrame, *, late: str = "10 minutes", timeout: int = 60) -> DataFrame:
    """(req_id, at, stage, verdict) of every event of a stream (req_id, at, stage), and timeouts after ``timeout`` seconds."""
    state_store(events.sparkSession)
    rows = events.select(F.col("req_id").cast("string").alias("req_id"), "at", "stage").withWatermark("at", late)
    return rows.groupBy("req_id").transformWithStateInPandas(_Machine(timeout * 1000), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def state_store(spark: SparkSession) -> None:
    """State with timers and lists needs the store on RocksDB; a store that the session names stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
