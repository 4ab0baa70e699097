"""Bouts of a feed whose events arrive in any order within a delay, with state that ends.

Videos are dealt out to buckets by a hash, and a bucket's state is one: many videos have few events each, and a call of the
state for each of them would take longer than the work. A bucket's events wait in state, in slots of time, until the
watermark has passed a slot's end: then no event of the slot is missing but late ones, and the events of each video are put
into bouts in the order of their start. So bouts do not depend on how the feed is cut into files and batches. A timer at the
end of a slot works it off and drops it; one behind the end of a bout and the gap closes the bout. What is kept is the events
behind the watermark and the bouts that are open, and nothing once both are gone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Of all rows that stream_bouts puts out: an event of a bout, an event that came too late, a bout that has ended.
EVENT, LATE, CLOSED = "event", "late", "closed"
SCHEMA = "kind string, video string, event_idx long, bout_id string, n_events long, start_sec double, end_sec double"
#: Rows from which on slots are put into bouts, those before together.
ROWS = 50_000
#: Where state is kept in folders of the checkpoint, as this operator needs it.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BoutProcessor(StatefulProcessor):
    """State of a bucket: `pending` has the events of each slot in parts, as they came; `bouts` the first start, end and events
    of the open bouts, one a video at most."""

    def __init__(self, gap: float, slot: float) -> None:
        self.gap, self.slot = gap, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState(
            "pending", "slot long, part long", "video array<string>, idx array<long>, start array<double>, end array<double>"
        )
        self.bouts = handle.getValueState(
            "bouts", "video array<string>, first array<double>, end array<double>, n array<long>"
        )

    def _timer(self, slot: int) -> int:
        """The millisecond from which on nothing of the slot and of those before it is missing."""
        return math.ceil((slot + 1) * self.slot * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        passed, parts = timerValues.getCurrentWatermarkInMs(), {}
        for slot, number in self.pending.keys():
            parts[slot] = max(parts.get(slot, 0), number + 1)
        for part in rows:  # a part at a time: a bucket's rows of a batch needn't fit in memory
            part = part[part["start_sec"].notna()]
            end = part["start_sec"] + part["duration_sec"].fillna(0.0)
            slot = (part["start_sec"] // self.slot).astype("int64")
            late = slot.map({n: self._timer(int(n)) <= passed for n in slot.unique()}).astype(bool)
            yield frame(LATE, part["video"][late], idx=part["event_idx"][late], start=part["start_sec"][late], end=end[late])
            fresh = part.assign(end_sec=end, slot=slot)[~late]
            for number, own in fresh.groupby("slot"):
                number = int(number)
                names = ["video", "event_idx", "start_sec", "end_sec"]
                self.pending.updateValue((number, parts.get(number, 0)), tuple(own[c].tolist() for c in names))
                parts[number] = parts.get(number, 0) + 1
                self.handle.registerTimer(self._timer(number))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        # All slots that the watermark has passed: the first of their timers works them off, the others find nothing.
        due = [k for k in sorted(self.pending.keys()) if self._timer(k[0]) <= passed]
        if not due and not self.bouts.exists():
            return
        had = self.bouts.get() if self.bouts.exists() else ((), (), (), ())
        bouts = pd.DataFrame({c: list(had[i]) for i, c in enumerate(("video", "first", "end", "n"))})
        bouts = bouts.astype({"video": "object", "first": "float64", "end": "float64", "n": "int64"})
        got = []
        for place, k in enumerate(due):
            got.append(self.pending.getValue(k))
            self.pending.removeKey(k)
            last_part = place + 1 == len(due) or due[place + 1][0] != k[0]
            if place + 1 < len(due) and not (last_part and sum(len(g[0]) for g in got) >= ROWS):
                continue  # short slots go together
            rows = pd.DataFrame({c: [x for g in got for x in g[i]] for i, c in enumerate(("video", "idx", "start", "end"))})
            rows, got = rows.astype({"video": "object", "start": "float64", "end": "float64"}), []
            events, closed, bouts = run_on(rows, bouts, self.gap)
            yield frame(EVENT, events["video"], events["first"], events["idx"], start=events["start"], end=events["end"])
            yield frame(CLOSED, closed["video"], closed["first"], n=closed["n"], start=closed["first"], end=closed["end"])
        if len(bouts):
            last = ((bouts["end"] + self.gap) // self.slot).astype("int64")  # events up to its end may still be of the bout
            over = last.map({n: self._timer(int(n)) <= passed for n in last.unique()}).astype(bool)
            done, bouts = bouts[over], bouts[~over]
            yield frame(CLOSED, done["video"], done["first"], n=done["n"], start=done["first"], end=done["end"])
            for number in last[~over].unique():
                self.handle.registerTimer(self._timer(int(number)))
        if len(bouts):
            self.bouts.update(tuple(bouts[c].tolist() for c in ("video", "first", "end", "n")))
        elif self.bouts.exists():
            self.bouts.clear()

    def close(self) -> None:
        pass


def run_on(rows: pd.DataFrame, bouts: pd.DataFrame, gap: float) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """Rows (video, idx, start, end) with the first start of their bout, the bouts that they show to be over, and those open
    then; bouts: those open before (video, first, end, n), one a video at most."""
    code = pd.factorize(pd.concat([rows["video"], bouts["video"]]), use_na_sentinel=False)[0]
    rows = rows.assign(code=code[: len(rows)]).sort_values(["code", "start", "idx"], ignore_index=True)
    bouts = bouts.assign(code=code[len(rows) :])
    known = bouts.set_index("code")
    begins = rows["code"] != rows["code"].shift()
    before = rows["end"].shift().where(~begins, rows["code"].map(known["end"]))
    new = before.isna() | (rows["start"] - before > gap)
    old = begins & ~new  # goes on with the video's open bout
    group = (begins | new).cumsum()
    first = rows["start"].where(~old, rows["code"].map(known["first"])).groupby(group).transform("first")
    rows = rows.assign(first=first, more=rows["code"].map(known["n"]).where(old, 0))
    found = rows.groupby(group, sort=True).agg(
        video=("video", lambda v: v.iloc[0]), code=("code", "first"), first=("first", "first"), end=("end", "last"), n=("code", "size"), more=("more", "first")
    )
    found["n"] = found["n"] + found.pop("more").astype("int64")
    open_ = ~found["code"].duplicated(keep="last")
    met = bouts["code"].isin(rows["code"])
    ended = bouts["code"].isin(rows["code"][begins & new])
    names = ["video", "first", "end", "n"]
    closed = pd.concat([bouts[ended][names], found[~open_][names]], ignore_index=True)
    return rows, closed, pd.concat([bouts[~met][names], found[open_][names]], ignore_index=True)


def bout_name(video: str | None, first: float) -> str | None:
    """A bout is named by the millisecond of its first start: a number would need state for ever."""
    return None if pd.isna(video) else f"{video}__bout_{round(first * 1000)}"


def frame(
    kind: str, video: pd.Series, first: pd.Series | None = None, idx: pd.Series | None = None, n: pd.Series | None = None,
    *, start: pd.Series, end: pd.Series
) -> pd.DataFrame:
    """Rows of a kind, in the columns of SCHEMA; first: the first start of the bout."""
    nothing = [None] * len(video)
    names = nothing if first is None else [bout_name(v, f) for v, f in zip(video, first)]
    plain = lambda values: pd.Series(values, dtype="object")
    return pd.DataFrame({
        "kind": plain([kind] * len(video)), "video": plain(list(video)),
        "event_idx": pd.array(nothing if idx is None else list(idx), "Int64"), "bout_id": plain(names),
        "n_events": pd.array(nothing if n is None else list(n), "Int64"),
        "start_sec": start.to_numpy("float64"), "end_sec": end.to_numpy("float64"),
    })


def stream_bouts(events: DataFrame, gap: float, delay: str = "0 seconds", slot: float = 60.0, buckets: int = 128) -> DataFrame:
    """Bouts of events (event_idx, video, start_sec, duration_sec), whose starts are the event time in seconds. Columns of
    SCHEMA, of three kinds:

    * `event`: an event and its bout: it begins no more than `gap` behind the end of the event before it in the video (of
      equal starts, the smaller event_idx is before), whose duration counts as 0 where it is null;
    * `late`: an event of a slot that the watermark has passed, i.e. that is more than `delay` behind the latest start of
      earlier batches. It joins no bout and changes none;
    * `closed`: a bout that has ended, with its events, first start and last end.

    Events come out once the watermark passes their slot (of `slot` seconds). Rows without a start have no place and go.
    Videos are dealt out to `buckets`, which a feed keeps as long as its checkpoint. The session's state store must be PROVIDER.
    """
    at = F.timestamp_micros((F.col("start_sec") * 1_000_000).cast("long"))
    # The time itself is left out behind the watermark: Spark would drop late rows before the operator sees them.
    rows = events.withColumn("_time", at).withWatermark("_time", delay).select(
        F.pmod(F.xxhash64("video"), F.lit(buckets)).alias("_bucket"), "event_idx", "video", "start_sec", "duration_sec"
    )
    return rows.groupBy("_bucket").transformWithStateInPandas(BoutProcessor(gap, slot), SCHEMA, "append", "eventTime")


def split_kinds(out: DataFrame) -> dict[str, DataFrame]:
    """The rows of stream_bouts by kind, with the columns that the kind has."""
    return {
        EVENT: out.where(F.col("kind") == EVENT).select("video", "event_idx", "bout_id", "start_sec", "end_sec"),
        LATE: out.where(F.col("kind") == LATE).select("video", "event_idx", "start_sec", "end_sec"),
        CLOSED: out.where(F.col("kind") == CLOSED).select("video", "bout_id", "n_events", "start_sec", "end_sec"),
    }


def write_bouts(stream: DataFrame, path: str, checkpoint: str, **trigger: object) -> object:
    """Starts a query that writes the rows as Parquet in a folder per kind: late rows and closed bouts beside the events."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)  # a query keeps what was set when it began
    try:
        writer = stream.writeStream.format("parquet").partitionBy("kind").option("path", path).option(
            "checkpointLocation", checkpoint
        )
        return writer.outputMode("append").trigger(**trigger).start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
