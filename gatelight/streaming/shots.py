"""Shot detection over a live stream of frame correlations, with state per clip."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The processor also starts on the driver, in a worker that shipped files do not reach; so it travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WARMUP, WARMUP_THRESHOLD, CEILING, DROP, HISTORY, MIN_SHOT = 8, 0.70, 0.92, 0.10, 60, 3


def advance(state: tuple[int, int, list[float]], value: float | None) -> tuple[tuple[int, int, list[float]], bool]:
    """One frame: (shot, frames in it, its recent correlations) and whether this frame opens a new shot."""
    shot, frames, seen = state
    threshold = WARMUP_THRESHOLD if len(seen) < WARMUP else min(CEILING, median(seen) - DROP)
    cut = value is not None and value < threshold and frames >= MIN_SHOT
    if cut:
        return (shot + 1, 1, []), True
    return (shot, frames + 1, seen if value is None else [*seen, value][-HISTORY:]), False


class ShotProcessor(StatefulProcessor):
    """Rows clip_id, i, value in order of i within a batch; earlier frames that arrive in a later batch continue from the state as it is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("shot", "shot int, frames int, seen array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (0, 0, [])
        now, out = (held[0], held[1], list(held[2])), []
        for r in pd.concat(list(rows)).sort_values("i").itertuples():
            now, cut = advance(now, None if pd.isna(r.value) else float(r.value))
            out.append((key[0], int(r.i), now[0], cut))
        self.state.update(now)
        yield pd.DataFrame(out, columns=["clip_id", "i", "shot_id", "is_cut"])

    def close(self) -> None:
        pass


def shot_stream(frames: DataFrame) -> DataFrame:
    """Stream of (clip_id, i, value) to (clip_id, i, shot_id, is_cut). Needs the RocksDB state store."""
    return frames.groupBy("clip_id").transformWithStateInPandas(ShotProcessor(), "clip_id long, i int, shot_id int, is_cut boolean", "append", "none")
