"""A job queue with leases over an append-only feed of events: delivery, acknowledgement, redelivery after a visibility timeout, and a dead letter after three tries.

State is per job and lives in the state store, so attempts are counted by the queue itself and survive restarts; timers bring a job back whose worker fell
silent. A job that is done or dead is remembered for a while, so that a repeated submission is not run again.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The processor also starts on the driver, in a worker that shipped files do not reach; so it travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ATTEMPTS = 3
VISIBLE_AGAIN_S = 900  # how long a worker has before its job is delivered again
REMEMBERED_S = 4 * 86_400  # how long a job that is done or dead is known
LEASED, DONE, DEAD = "leased", "done", "dead"
OUTPUT = "job_id string, action string, attempt int, at timestamp, visible_again timestamp, payload string"

State = tuple[str, int, int, str | None]  # status, attempts, when its timer is due (ms), payload


def _deliver(attempts: int, now: int, lease_ms: int, payload: str | None) -> tuple[State, tuple | None]:
    """The next delivery, or the dead letter where all have been used."""
    if attempts >= ATTEMPTS:
        return (DEAD, attempts, now + REMEMBERED_S * 1000, payload), (DEAD, attempts, now, None)
    due = now + lease_ms
    return (LEASED, attempts + 1, due, payload), ("deliver", attempts + 1, now, due)


def on_event(state: State | None, event: str, now: int, payload: str | None, lease_ms: int) -> tuple[State | None, tuple | None]:
    """State and output (action, attempt, at, visible again) after an event.

    ``submit`` delivers a job that is not known and is ignored for one that is; ``ack`` ends a leased job, even after its lease; ``nack`` gives it back at once;
    ``extend`` starts its lease anew. Events of jobs that are not leased change nothing, nor do unknown events.
    """
    if state is None:
        return _deliver(0, now, lease_ms, payload) if event == "submit" else (None, None)
    status, attempts, _, held = state
    if status != LEASED:
        return state, None
    if event == "ack":
        return (DONE, attempts, now + REMEMBERED_S * 1000, held), (DONE, attempts, now, None)
    if event == "nack":
        return _deliver(attempts, now, lease_ms, held)
    return ((LEASED, attempts, now + lease_ms, held), None) if event == "extend" else (state, None)


def on_timer(state: State | None, due: int, lease_ms: int) -> tuple[State | None, tuple | None]:
    """State and output when a timer is due: redelivery or the dead letter of a lapsed lease, or the end of a remembered job. Timers set for an earlier lease do nothing."""
    if state is None or state[2] != due:
        return state, None
    return _deliver(state[1], due, lease_ms, state[3]) if state[0] == LEASED else (None, None)


class LeaseProcessor(StatefulProcessor):
    """Rows job_id, event, at, payload of one job; within a batch in order of time."""

    def __init__(self, lease_s: float):
        self.lease_ms = int(lease_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "status string, attempts int, due long, payload string")

    def _held(self) -> State | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def _settle(self, before: State | None, after: State | None) -> None:
        if before is not None and (after is None or after[2] != before[2]):
            self.handle.deleteTimer(before[2])
        if after is None:
            self.state.clear()
        elif after != before:
            self.state.update(after)
            if before is None or after[2] != before[2]:
                self.handle.registerTimer(after[2])

    @staticmethod
    def _row(key, found: tuple, payload: str | None) -> Row:
        time = lambda ms: None if ms is None else datetime.fromtimestamp(ms / 1000, timezone.utc)
        action, attempt, at, due = found
        return Row(job_id=key[0], action=action, attempt=attempt, at=time(at), visible_again=time(due), payload=payload)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = now = self._held()
        for r in sorted(rows, key=lambda r: (r.ms, r.event)):
            now, found = on_event(now, r.event, r.ms, r.payload, self.lease_ms)
            if found:
                yield self._row(key, found, now[3])
        self._settle(before, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self._held()
        now, found = on_timer(before, expiredTimerInfo.getExpiryTimeInMs(), self.lease_ms)
        if now != before:
            self._settle(before, now)
        if found:
            yield self._row(key, found, now[3])

    def close(self) -> None:
        pass


def deliveries(events: DataFrame, lease_s: float = VISIBLE_AGAIN_S, late: str = "0 seconds") -> DataFrame:
    """Stream of events (job_id, event, at, payload) to deliveries, completions and dead letters. Needs the RocksDB state store.

    Time is that of the events: a lease lapses when the feed has moved on past it by ``late``. Rows without a job or a time are left out.
    """
    timed = events.filter("job_id is not null and at is not null").select(F.col("job_id").cast("string").alias("job_id"), "event", F.col("at").cast("timestamp").alias("at"), "payload")
    timed = timed.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    return timed.groupBy("job_id").transformWithState(LeaseProcessor(lease_s), OUTPUT, "append", "EventTime")


def work(delivered: DataFrame, handle: Callable[[DataFrame], DataFrame], results: str, checkpoint: str) -> StreamingQuery:
    """Run ``handle`` on each micro-batch of deliveries (job_id, attempt, payload in; job_id, status out) and write its rows, and dead letters, under the batch's number.

    A batch that is retried overwrites its own folder. What ``handle`` returns is written beside the attempt; the caller feeds it back to the queue as acknowledgements.
    """

    def run(batch: DataFrame, number: int) -> None:
        done = handle(batch.filter("action = 'deliver'").select("job_id", "attempt", "payload")).select("job_id", "status")
        ended = batch.filter("action <> 'deliver'").select("job_id", F.col("action").alias("status"), "attempt", "at")
        tried = batch.filter("action = 'deliver'").select("job_id", "attempt", "at").join(done, "job_id").select("job_id", "status", "attempt", "at")
        tried.unionByName(ended).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return delivered.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
