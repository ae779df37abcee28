"""Steady segments over a stream of registered pairs (X-05), each emitted once, as soon as it can't change."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import segments

#: open: the run of overlapping steady bins that may go on; kept: the closed one, long enough, that may still be combined with the next.
STATE = "next_pair long, open_start long, open_end long, kept_start long, kept_end long, seg_idx long, frames_number long, fps double"
WAITING = "is_steady boolean"


class _Segments(StatefulProcessor):
    def __init__(self, key: str, frames: int, min_seconds: float, wait_ms: int | None):
        self.key, self.frames, self.min_seconds, self.wait_ms = key, frames, min_seconds, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getMapState("waiting", "pair_idx long", WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._load()
        for row in rows:
            if row["pair_idx"] >= state["next_pair"]:  # a replayed pair changes nothing
                self.waiting.updateValue((row["pair_idx"],), (bool(row["is_steady"]),))
                state |= {"frames_number": row["frames_number"], "fps": row["fps"]}
        found = self._advance(key, state, False)
        if self.wait_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state["next_pair"] <= self._last(state):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield from found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What is still missing isn't waited for: the video ends with the pairs that came."""
        state = self._load()
        if state["frames_number"] is not None:
            yield from self._advance(key, state, True)

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        names = [x.split()[0] for x in STATE.split(", ")]
        found = self.state.get() if self.state.exists() else None
        return dict(zip(names, found or (0, None, None, None, None, 0, None, None), strict=True))

    def _last(self, state: dict) -> int:
        """The number of a video's last pair; before any row, none."""
        return -1 if state["frames_number"] is None else -(-state["frames_number"] // self.frames) - 2

    def _advance(self, key, state: dict, all_came: bool) -> list[Row]:
        """Takes pairs in order as far as they have come, and keeps the new state."""
        out: list[Row] = []
        last, size = self._last(state), self.frames
        while state["next_pair"] <= last:
            pair = state["next_pair"]
            if self.waiting.containsKey((pair,)):
                is_steady = self.waiting.getValue((pair,))[0]
                self.waiting.removeKey((pair,))
            elif all_came:
                is_steady = False
            else:
                break
            state["next_pair"] += 1
            if is_steady:
                start, end = pair * size, state["frames_number"] - 1 if pair == last else (pair + 2) * size - 1
                if state["open_end"] is not None and state["open_end"] > start:
                    state["open_end"] = end
                else:
                    self._shut(key, state, out)
                    state |= {"open_start": start, "open_end": end}
            elif state["open_end"] is not None and state["open_end"] <= (pair + 1) * size:
                self._shut(key, state, out)  # no later bin overlaps it
            reached = state["open_start"] if state["open_start"] is not None else (pair + 1) * size
            if state["kept_end"] is not None and reached > state["kept_end"] + 1:
                self._emit(key, state, out)
        if state["next_pair"] > last >= 0:
            self._shut(key, state, out)
            self._emit(key, state, out)
            state["open_start"] = state["open_end"] = None
        self.state.update(tuple(state.values()))
        return out

    def _shut(self, key, state: dict, out: list[Row]) -> None:
        """The open run is whole: it is dropped, combined with the kept one, or kept in its place."""
        start, end = state["open_start"], state["open_end"]
        state["open_start"] = state["open_end"] = None
        if end is None or not state["fps"] or (end - start) / state["fps"] < self.min_seconds:
            return
        if state["kept_end"] is not None and state["kept_end"] + 1 == start:
            state["kept_end"] = end
        else:
            self._emit(key, state, out)
            state |= {"kept_start": start, "kept_end": end}

    def _emit(self, key, state: dict, out: list[Row]) -> None:
        if state["kept_end"] is not None:
            out.append(Row(**{self.key: key[0], "start": state["kept_start"], "end": state["kept_end"], "seg_idx": state["seg_idx"]}))
            state |= {"kept_start": None, "kept_end": None, "seg_idx": state["seg_idx"] + 1}


def steady_segments(
    pairs: DataFrame, videos: DataFrame, frames: int = 20, max_shift: float = 2.0, min_confidence: float = 0.2, min_seconds: float = 5.0, key: str = "video", wait_ms: int | None = None
) -> DataFrame:
    """X-05 over a stream of pairs (key, pair_idx, dx, dy, confidence): rows (key, start, end, seg_idx), as the batch form gives them.

    videos is a static table (key, frames_number, fps). Pairs may come in any
    order, in any micro-batches, and more than once: those ahead of a missing
    one wait in the state. The state of a video is its open run, one kept
    segment and the waiting pairs. With wait_ms, a video that gets no pair for
    so long ends with those that came. Needs the RocksDB state store.
    """
    steady = F.coalesce(segments.steady(F.col("dx"), F.col("dy"), F.col("confidence"), max_shift, min_confidence), F.lit(False))
    told = pairs.select(key, F.col("pair_idx").cast("long").alias("pair_idx"), steady.alias("is_steady"))
    sizes = videos.select(key, F.col("frames_number").cast("long").alias("frames_number"), F.col("fps").cast("double").alias("fps"))
    told = told.join(sizes, key)
    schema = StructType.fromDDL(f"`{key}` {pairs.schema[key].dataType.simpleString()}, start long, end long, seg_idx long")
    mode = "None" if wait_ms is None else "ProcessingTime"
    return told.groupBy(key).transformWithState(_Segments(key, frames, min_seconds, wait_ms), schema, "Append", mode)
