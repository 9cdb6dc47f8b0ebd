"""The state machine of a request's stages, over events that come late, twice and out of order."""

import datetime as dt

import pytest

from sparrowdoc.streaming import stages

DAY = dt.datetime(2026, 1, 1)


def test_judge():
    say = lambda *s: [v for v in walk(s)]

    def walk(said):
        position, ended = -1, False
        for s in said:
            v = stages.judge(position, ended, s)
            if v == "accepted":
                position, ended = stages.STAGES.index(s), s in stages.ENDS
            yield v

    assert say("planning", "retrieving", "drafting", "done", "drafting") == ["accepted"] * 4 + ["after_end"]
    assert say("planning", "planning", "verifying", "hyde", "what") == ["accepted", "repeated", "accepted", "out_of_order", "unknown"]
    assert say("verifying", "retrying", "planning", "retrieving", "error", "done") == ["accepted", "accepted", "out_of_order", "accepted", "accepted", "after_end"]


@pytest.mark.parametrize("name", ["a"])
def test_stream_of_stages(spark, tmp_path, name):
    at = lambda s: DAY + dt.timedelta(seconds=s)

    def land(n, rows):
        spark.createDataFrame([(r, at(s), g) for r, s, g in rows], "req_id string, at timestamp, stage string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def drain():
        stream = spark.readStream.schema("req_id string, at timestamp, stage string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = stages.ordered(stream, late="60 seconds", timeout=30)
        out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.req_id, round((r["at"] - DAY).total_seconds()), r.stage, r.verdict) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    # x's drafting comes before its retrieving, which is earlier: no fault; its planning comes twice
    land(1, [("x", 0, "planning"), ("x", 20, "drafting"), ("y", 5, "planning"), ("x", 1, "planning")])
    land(2, [("x", 10, "retrieving"), ("x", 25, "done"), ("x", 26, "verifying"), ("y", 10, "verifying"), ("y", 12, "hyde")])
    land(3, [("z", 300, "planning")])
    first = drain()
    x = [("x", 0, "planning", "accepted"), ("x", 1, "planning", "repeated"), ("x", 10, "retrieving", "accepted"), ("x", 20, "drafting", "accepted"), ("x", 25, "done", "accepted"), ("x", 26, "verifying", "after_end")]
    y = [("y", 5, "planning", "accepted"), ("y", 10, "verifying", "accepted"), ("y", 12, "hyde", "out_of_order"), ("y", 40, "timeout", "accepted")]
    assert first == x + y
    # z goes on where the last run stopped; an event from before the watermark is dropped
    land(4, [("z", 310, "done"), ("x", 30, "done")])
    land(5, [("w", 900, "planning")])
    assert drain() == x + y + [("z", 300, "planning", "accepted"), ("z", 310, "done", "accepted")]


def test_events_enter_the_state_in_one_call():
    """Each event was a call to the state store of its own."""
    import pandas as pd

    calls = []

    class Handle:
        def __getattr__(self, name):
            return lambda *a: calls.append((name, *a)) if name.startswith(("append", "register")) else self

    machine = stages._Machine(1000)
    machine.init(Handle())
    batch = pd.DataFrame({"at": pd.to_datetime([3_000_001, 1_000_000, 2_000_000], unit="us"), "stage": ["done", "planning", None]})
    assert list(machine.handleInputRows(("r",), iter([batch, batch[:0], batch[1:]]), None)) == []
    assert calls == [("appendList", [(3000, "done"), (1000, "planning"), (2000, None)]), ("appendList", [(1000, "planning"), (2000, None)]), ("registerTimer", 3000)]
