"""The job log as a stream: the same state machine, kept by job, with event-time deadlines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedimenta.config import TERMINAL
from sedimenta.operators.jobs import next_state

OUTPUT = "job string, sequence long, command string, state string, outcome string"
STATE = "state string, sequence long"


def job_states(commands: DataFrame, late: str = "1 hour", deadline_ms: int | None = None) -> DataFrame:
    """Each command of a stream (job, ts, event_id, command) with the state after it and its outcome.

    Commands of a job in one batch are taken in the order of ts and event_id. With
    `deadline_ms`, a job that hasn't ended that long after its last command is told to fail
    if queued, and to cancel if running, once the watermark has passed.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, sequence = held.get if held.exists else (None, 0)
        out = []

        def apply(command: str) -> None:
            nonlocal state, sequence
            state, outcome = next_state(state, command)
            sequence += outcome == "applied"
            out.append((key[0], sequence, command, state, outcome))

        if held.hasTimedOut:
            if state in ("queued", "running"):
                apply("fail" if state == "queued" else "cancel")
            held.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            for command in rows["command"]:
                apply(command)
            held.update((state, sequence))
            if deadline_ms and state not in TERMINAL:
                due = int(rows["ts"].max().timestamp() * 1000) + deadline_ms
                held.setTimeoutTimestamp(max(due, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job", "sequence", "command", "state", "outcome"])

    timeout = GroupStateTimeout.EventTimeTimeout if deadline_ms else GroupStateTimeout.NoTimeout
    return commands.withWatermark("ts", late).groupBy("job").applyInPandasWithState(fold, OUTPUT, STATE, "append", timeout)


def accepted_once(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of requests without replays: the first of each owner and key within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["owner", "idempotency_key"])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes all that is available to Parquet and stops; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
