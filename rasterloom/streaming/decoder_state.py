"""State that a video decoder carries from frame to frame, as a stateful stream.

For each stream key: the three reference frames, the saved probability tables and the segment map.
Frames count in order of arrival; within a micro-batch in order of (ts, frame_id).
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ordered import carried

COLUMNS = "stream_id long, ts timestamp, frame_id long, key boolean, copy_alt int, copy_golden int, new_last boolean, new_golden boolean, new_alt boolean, keep_probabilities boolean, segment long"
OUTPUT = "stream_id long, frame_id long, last long, golden long, alt long, used long, saved long, segment long"
STATE = "last long, golden long, alt long, saved long, segment long"
EMPTY = (None, None, None, 0, 0)


def advance(state: tuple, f) -> tuple[tuple, int]:
    """The state after a frame, and the probability tables it used (a number stands for them)."""
    last, golden, alt, saved, segment = state
    new_alt = {1: last, 2: golden}.get(f.copy_alt, alt)
    new_golden = {1: last, 2: new_alt}.get(f.copy_golden, golden)
    golden, alt = f.frame_id if f.new_golden else new_golden, f.frame_id if f.new_alt else new_alt
    last = f.frame_id if f.new_last else last
    start = 0 if f.key else saved
    used = start * 31 % 1_000_003 + f.frame_id
    if f.key:
        segment = 0
    elif not pd.isna(f.segment):
        segment = int(f.segment)
    return (last, golden, alt, used if f.keep_probabilities else start, segment), used


def follow(frames: DataFrame) -> DataFrame:
    """Each frame with the references, tables and segment after it; frames may be a stream or a table of COLUMNS.

    A table's streams run through sorted rows with one state held; of a stream a micro-batch's frames of one key are held.
    """
    if not frames.isStreaming:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        frame_of = namedtuple("Frame", names)

        def one(state: tuple, row: tuple) -> tuple[tuple, tuple]:
            f = frame_of._make(row)
            state, used = advance(state, f)
            return state, (f.stream_id, f.frame_id, *state[:3], used, *state[3:])

        return carried(frames.select(names), ["stream_id"], ["ts", "frame_id"], EMPTY, one, OUTPUT)

    def batch(state: tuple, pdf: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        out = []
        for f in pdf.sort_values(["ts", "frame_id"]).itertuples():
            state, used = advance(state, f)
            out.append((f.stream_id, f.frame_id, *state[:3], used, *state[3:]))
        return state, out

    names = [c.split()[0] for c in OUTPUT.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names})
    def step(key: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else EMPTY
        state, out = batch(state, pd.concat(list(pdfs)))
        held.update(state)
        yield frame(out)

    return frames.groupBy("stream_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
