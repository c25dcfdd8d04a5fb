"""Running results of each video's region as a stream: what a list for each key would hold after every segment.

A key's outputs wait in list state until the watermark has passed them, are taken in order of run and segment, and get their place among all
outputs of their key. So the result doesn't depend on how a stream was cut into batches. Only the waiting outputs and two sums are
state; a key that has had nothing for ``idle`` after its last output gives that state up.

Every call on state is a message to the executor, so keys share their calls: a bucket of keys by hash is one group of the stream, whose outputs
wait as Arrow blocks. A task holds one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "video_id long, region string, run_id long, segment_id int, so_far long, snr double, mean_snr double"
KEY = ["video_id", "region"]
FIELDS = ["run_id", "segment_id", "stamp", "snr"]
WAITING = pa.schema([("video_id", pa.int64()), ("region", pa.string()), ("run_id", pa.int64()), ("segment_id", pa.int32()), ("stamp", pa.int64()), ("snr", pa.float64())])
TOTALS = pa.schema([("video_id", pa.int64()), ("region", pa.string()), ("taken", pa.int64()), ("total", pa.float64()), ("last", pa.int64()), ("fresh", pa.bool_())])


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start in this block keep their state in RocksDB, which list state and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    table, sink = pa.Table.from_pandas(rows, schema, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blocks: list[bytes], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(pa.py_buffer(bytes(b))).read_all() for b in blocks]
    return pa.concat_tables([schema.empty_table(), *tables]).to_pandas()


def taken(held: pd.DataFrame, totals: pd.DataFrame, mark: int, idle_ms: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """What the watermark has passed, with places and means; what waits on; and the totals of keys, without those that are idle."""
    late = held["stamp"] > mark
    ready, rest = held[~late].sort_values([*KEY, *FIELDS], kind="stable", ignore_index=True), held[late]
    stamps, snr = ready["stamp"].to_numpy(), ready["snr"].to_numpy(copy=True)
    starts = np.flatnonzero((ready[KEY] != ready[KEY].shift()).any(axis=1).to_numpy())
    sizes = np.diff(np.append(starts, len(ready)))
    now = ready.loc[starts, KEY].merge(totals, how="left", on=KEY)
    known = now["taken"].notna().to_numpy()
    came, total, last = (np.where(known, now[c], 0).astype(t) for c, t in (("taken", np.int64), ("total", float), ("last", np.int64)))
    snr[starts] += total
    for a, n in zip(starts, sizes):
        np.cumsum(snr[a : a + n], out=snr[a : a + n])
    so_far = np.arange(len(ready)) + np.repeat(came - starts, sizes)
    made = ready[[*KEY, "run_id", "segment_id"]].assign(so_far=so_far, snr=ready["snr"], mean_snr=snr / (so_far + 1))
    if len(starts):
        now = now[KEY].assign(taken=came + sizes, total=snr[starts + sizes - 1], last=np.maximum(last, np.maximum.reduceat(stamps, starts)), fresh=True)
        totals = pd.concat([totals.assign(fresh=False), now]).drop_duplicates(KEY, keep="last")
    else:
        totals = totals.assign(fresh=False)
    waits = pd.MultiIndex.from_frame(totals[KEY]).isin(pd.MultiIndex.from_frame(rest[KEY]))
    return made, rest, totals[waits | totals["fresh"].to_numpy(bool) | (totals["last"] + idle_ms > mark).to_numpy()]


class RunningLists(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.totals = handle.getValueState("totals", "rows binary")

    def _ring(self, at: int | None) -> None:
        """The bucket's one timer."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def _take(self, mark: int) -> Iterator[pd.DataFrame]:
        """Give out what the watermark has passed; what waits, and the totals, stay as state with one timer."""
        held = _unpacked([r[0] for r in self.waiting.get()] if self.waiting.exists() else [], WAITING)
        totals = _unpacked([self.totals.get()[0]] if self.totals.exists() else [], TOTALS)
        made, rest, totals = taken(held, totals, mark, self.idle_ms)
        self.waiting.clear()
        if len(rest):
            self.waiting.put([(_packed(rest, WAITING),)])
        if len(totals):
            self.totals.update((_packed(totals, TOTALS),))
        else:
            self.totals.clear()
        # a timer at the present watermark would never ring
        due = [rest["stamp"].min()] * bool(len(rest)) + [totals["last"].min() + self.idle_ms] * bool(len(totals))
        self._ring(max(int(min(due)), mark + 1) if due else None)
        if len(made):
            yield made

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, least = timerValues.getCurrentWatermarkInMs(), None
        for batch in rows:
            batch = batch.assign(stamp=batch["ts"].astype("datetime64[us]").astype("int64") // 1000, snr=batch["snr"].astype(float))
            self.waiting.appendValue((_packed(batch[[*KEY, *FIELDS]], WAITING),))
            least = int(batch["stamp"].min()) if least is None else min(least, int(batch["stamp"].min()))
        if least is not None and least <= mark:
            yield from self._take(mark)
        elif least is not None and not any(t <= least for t in list(self.handle.listTimers())):
            self._ring(least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_running(outputs: DataFrame, delay: str = "10 seconds", idle_ms: int = 3_600_000, buckets: int = 256) -> DataFrame:
    """``(video_id long, region string, run_id long, segment_id int, snr double, ts timestamp)`` as a stream to rows of OUTPUT, in append mode.

    so_far is how many outputs of the key came before, mean_snr the mean up to this one. Outputs later than the watermark are dropped by it; a null
    snr counts as NaN. A key that returns after ``idle_ms`` begins anew. A task holds what waits in one of ``buckets``; a checkpoint goes with its number.
    """
    timed = outputs.withWatermark("ts", delay).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)))
    return timed.groupBy("bucket").transformWithStateInPandas(RunningLists(idle_ms), OUTPUT, "Append", "EventTime")
