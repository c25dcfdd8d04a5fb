"""The gap-aware segmenter as a stateful stream.

Frames may arrive late or out of order within ``delay``: a video's frames are held until the watermark
has passed them, then taken in order of their index. State is bounded by one
segment and the frames inside the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "video_id long, run_id long, segment_id int, t int, frame_idx long"
STATE = "held array<long>, valid array<boolean>, stamps array<long>, buffer array<long>, runs long, segment int"


def fold(frames: list[tuple[int, bool]], buffer: list[int], runs: int, segment: int, size: int, overlap: int) -> tuple[list[tuple[int, int, list[int]]], list[int], int, int]:
    """Take frames in order: (segments as (run, number, frames), buffer, runs, number of the next segment). An invalid frame empties the buffer."""
    made = []
    for index, valid in frames:
        if not valid:
            buffer, runs, segment = [], runs + 1, 0
            continue
        buffer = [*buffer, index]
        if len(buffer) == size:
            made.append((runs, segment, buffer))
            buffer, segment = buffer[size - overlap :], segment + 1
    return made, buffer, runs, segment


def stream_segments(frames: DataFrame, size: int = 128, overlap: int = 32, delay: str = "10 seconds") -> DataFrame:
    """``(video_id long, frame_idx long, ts timestamp, valid boolean)`` as a stream to rows of OUTPUT, as the batch segmenter gives them.

    run_id counts the invalid frames before a segment. Frames later than the watermark are dropped by it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, valid, stamps, buffer, runs, segment = (list(x) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in state.get) if state.exists else ([], [], [], [], 0, 0)
        waiting = list(zip(map(int, held), map(bool, valid), map(int, stamps)))
        for batch in batches:
            waiting += list(zip(batch["frame_idx"].astype(int), batch["valid"].fillna(False).astype(bool), batch["ts"].astype("int64") // 10**3))
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sorted(x for x in waiting if x[2] <= mark)
        waiting = [x for x in waiting if x[2] > mark]
        made, buffer, runs, segment = fold([(i, v) for i, v, _ in ready], [int(x) for x in buffer], int(runs), int(segment), size, overlap)
        state.update(([x[0] for x in waiting], [x[1] for x in waiting], [x[2] for x in waiting], buffer, runs, segment))
        if waiting:
            state.setTimeoutTimestamp(max(min(x[2] for x in waiting) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        for run, number, own in made:
            yield pd.DataFrame({"video_id": key[0], "run_id": run, "segment_id": number, "t": range(len(own)), "frame_idx": own})

    timed = frames.withWatermark("ts", delay)
    return timed.groupBy("video_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
