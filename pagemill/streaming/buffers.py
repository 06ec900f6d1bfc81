"""Stateful parts: log ring buffer, job slots with a timeout, undo stacks.

Jobs are keyed by their own id and every result is kept until its reader takes it; the single
overwritten slot of the original is a flaw that is not carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values.
LINES, CHARS, DROPPED_PART, UNDO = 2000, 50_000, 4, 60
TIMEOUT_S = {"formula": 60, "text": 90, "mixed": 180}


def ring(held: list[str], new: list[str], lines: int = LINES) -> list[str]:
    """The last `lines` entries."""
    return (held + new)[-lines:]


def drained(held: str, new: str, chars: int = CHARS) -> str:
    """A character buffer after an addition: if that would be too long, the oldest quarter of what is held goes first."""
    if len(held) + len(new) > chars:
        held = held[len(held) // DROPPED_PART :]
    return held + new


def _keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = list(state.get[0]) if state.exists else []
    n = state.get[1] if state.exists else 0
    new: list[str] = []
    for b in batches:
        new += b.sort_values("line_no")["line"].fillna("").tolist()
    held, n = ring(held, new), n + len(new)
    state.update((held, n))
    yield pd.DataFrame({"session_id": [key[0]], "kept": [len(held)], "seen": [n], "first": [held[0] if held else None], "last": [held[-1] if held else None]})


def log_ring(lines: DataFrame) -> DataFrame:
    """A stream of (session_id, line_no, line) as updates (session_id, kept, seen, first, last) of each session's ring buffer."""
    return lines.select("session_id", "line_no", "line").groupBy("session_id").applyInPandasWithState(
        _keep, "session_id bigint, kept int, seen bigint, first string, last string", "held array<string>, seen bigint", "update", GroupStateTimeout.NoTimeout
    )


def _job(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        kind = state.get[0]
        state.remove()
        yield pd.DataFrame({"job_id": [key[0]], "status": ["timeout"], "result": [None], "kind": [kind]})
        return
    kind, result = None, None
    for b in batches:
        for k, r in zip(b["kind"], b["result"]):
            kind = k if k is not None else kind
            result = r if r is not None else result
    if kind is None and state.exists:
        kind = state.get[0]
    if result is not None:
        if state.exists:
            state.remove()
        yield pd.DataFrame({"job_id": [key[0]], "status": ["done"], "result": [result], "kind": [kind]})
    else:
        state.update((kind,))
        state.setTimeoutDuration(TIMEOUT_S.get(kind, max(TIMEOUT_S.values())) * 1000)


def job_results(events: DataFrame) -> DataFrame:
    """A stream of (job_id, kind, result) - kind at the start of a job, result at its end - as (job_id, status, result, kind).

    A job without a result within the time of its kind times out; a result after that is a job of its own.
    """
    return events.select("job_id", "kind", "result").groupBy("job_id").applyInPandasWithState(
        _job, "job_id string, status string, result string, kind string", "kind string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def once(events: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """Each job_id once, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(["job_id"])


def _undone(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, undo, redo = None, 0, 0
        started = False
        for b in batches:
            out = []
            for canvas, op in zip(b["canvas"].tolist(), b["op"]):
                if not started or canvas != now:
                    if started:
                        out.append((now, undo, redo))
                    started, now, undo, redo = True, canvas, 0, 0
                if op == "draw":
                    undo, redo = min(undo + 1, limit), 0
                elif op == "undo" and undo:
                    undo, redo = undo - 1, redo + 1
                elif op == "redo" and redo:
                    undo, redo = min(undo + 1, limit), redo - 1
            yield pd.DataFrame(out, columns=["canvas", "undo", "redo"])
        if started:
            yield pd.DataFrame([(now, undo, redo)], columns=["canvas", "undo", "redo"])

    return run


def undo_state(ops: DataFrame, limit: int = UNDO) -> DataFrame:
    """(canvas, undo, redo): sizes of both stacks after a log of (canvas, seq, op) with op draw, undo or redo.

    A drawing empties the redo stack and the undo stack keeps `limit` entries. Logs pass through sorted, one operation after
    the other, and only the two sizes are held; rows with a null canvas have none.
    """
    canvas = ops.schema["canvas"].dataType.simpleString()
    logs = ops.where("canvas is not null").select("canvas", "seq", "op").repartition("canvas").sortWithinPartitions("canvas", "seq").select("canvas", "op")
    return logs.mapInPandas(_undone(limit), f"canvas {canvas}, undo int, redo int")
