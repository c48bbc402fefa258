"""Sessions on a stream: what ``operators.session`` computes in batch, kept as state per bucket of sessions.

Events may come in any order within the watermark. They wait in their bucket's
state until the watermark has passed them, and are then taken in the order of
their time, so the stream gives what the batch form gives for the same events.
Events behind the watermark are dropped by Spark, which counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session_id long, ts timestamp, event_id long, epoch long, file_name string, results long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets that sessions are dealt out to; one bucket's sessions and waiting events are in a task at once.
BUCKETS = 128

_ID = [("session_id", pa.int64()), ("nobody", pa.bool_())]  # nobody: the session is null
_WAITING = pa.schema([*_ID, ("ts", pa.int64()), ("event_id", pa.int64()), *((c, pa.string()) for c in ("action", "file_name", "kind", "payload"))])
_SESSIONS = pa.schema([*_ID, ("epoch", pa.int64()), ("file_name", pa.string()), ("has_file", pa.bool_())])
_RESULTS = pa.schema([*_ID, ("kind", pa.string()), ("payload", pa.string())])
_OUT = ["session_id", "ts", "event_id", "epoch", "file_name", "results", "nobody"]


def _packed(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(frame[schema.names], schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(parts: list[bytes], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(x).read_all() for x in parts]
    return (pa.concat_tables(tables) if tables else schema.empty_table()).to_pandas()


def taken(sessions: pd.DataFrame, results: pd.DataFrame, events: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """What sessions hold after each of the events, taken in the order of their time: a row per event, the sessions and their results after all.

    All sessions of a bucket are worked on at once. A session's last upload or
    removal before an event is found by a running maximum of places, epochs and
    numbers of results by running sums.
    """
    code = pd.concat([x[["session_id", "nobody"]] for x in (sessions, events, results)]).groupby(["session_id", "nobody"], sort=False).ngroup().to_numpy()
    h, c, r = np.split(code, [len(sessions), len(sessions) + len(events)])
    n, order = int(code.max()) + 1, np.lexsort((events["event_id"], events["ts"], c))
    events, c = events.iloc[order].reset_index(drop=True), c[order]
    epoch0, has0, name0 = np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, None, object)
    epoch0[h], has0[h], name0[h] = sessions["epoch"], sessions["has_file"], sessions["file_name"]
    at = np.arange(len(c))
    start = np.maximum.accumulate(np.where(np.diff(c, prepend=-1) != 0, at, 0))

    upload, removal = (events["action"] == "upload").to_numpy(), (events["action"] == "remove").to_numpy()
    names = events["file_name"].to_numpy(object)
    same = pd.factorize(np.concatenate([name0, names]), use_na_sentinel=False)[0]
    last = np.maximum.accumulate(np.where(upload | removal, at, -1))
    before = np.append(-1, last[:-1])

    def file(place: np.ndarray, there: np.ndarray, held: np.ndarray) -> np.ndarray:
        return np.where(place >= start, there[place], held[c])

    new = upload & ~(file(before, upload, has0) & (same[n:] == file(before, same[n:], same[:n])))
    total = np.cumsum(new)
    epoch = epoch0[c] + total - (total - new)[start]
    has, name = file(last, upload, has0), file(last, names, name0)
    name = np.where(has, name, None)

    # Of a kind of results in an epoch, events that show it or clear it after one that did not.
    kinds, own = pd.factorize(np.concatenate([results["kind"].to_numpy(object), events["kind"].to_numpy(object)]), use_na_sentinel=False)
    slot, held = c * len(own) + kinds[len(results) :], r * len(own) + kinds[: len(results)]
    some = np.flatnonzero(events["action"].isin(["result", "clear"]).to_numpy())
    some = some[np.lexsort((some, epoch[some], slot[some]))]
    shows = (events["action"] == "result").to_numpy()[some].astype(np.int64)
    fresh = np.append(True, (np.diff(slot[some]) != 0) | (np.diff(epoch[some]) != 0))[: len(some)]
    there = np.where(fresh, (epoch[some] == epoch0[c[some]]) & np.isin(slot[some], held), np.append(0, shows)[: len(some)])
    step = np.zeros(len(c), np.int64)
    step[some] = shows - there
    total = np.cumsum(step)
    begun = np.maximum.accumulate(np.where(new, at, start))
    count = total - (total - step)[begun] + np.where(epoch == epoch0[c], np.bincount(r, minlength=n)[c], 0)

    out = events[["session_id", "nobody", "event_id"]].assign(ts=pd.Series(events["ts"].to_numpy("datetime64[us]")), epoch=epoch, file_name=name, results=count)[_OUT]
    final = np.flatnonzero(np.append(c[1:] != c[:-1], True))
    now = epoch0.copy()
    now[c[final]] = epoch[final]
    ends = some[np.append(fresh[1:], True)[: len(some)]]
    ends = ends[epoch[ends] == now[c[ends]]]
    kept = results[(now[r] == epoch0[r]) & ~np.isin(held, slot[ends])]
    gained = events.iloc[ends[(events["action"].iloc[ends] == "result").to_numpy()]]
    touched = events.iloc[final][["session_id", "nobody"]].assign(epoch=epoch[final], file_name=name[final], has_file=has[final].astype(bool))
    rest = sessions[~np.isin(h, c[final])]
    return out, pd.concat([rest, touched])[_SESSIONS.names], pd.concat([kept, gained])[_RESULTS.names]


class SessionProcessor(StatefulProcessor):
    """State per bucket: what its sessions hold as one value, and the events that wait as a list of Arrow streams.

    Neither an event nor a session asks the state store for anything by itself.
    One timer per bucket stands at its first waiting event.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "sessions binary, results binary")
        self.timer = handle.getValueState("timer", "at long")
        self.waiting = handle.getListState("waiting", "events binary")

    def _holds(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        found = self.held.get()
        return tuple(_unpacked([bytes(x)] if x is not None else [], schema) for x, schema in zip(found or (None, None), (_SESSIONS, _RESULTS)))

    def _hold(self, sessions: pd.DataFrame, results: pd.DataFrame) -> None:
        self.held.update((_packed(sessions, _SESSIONS), _packed(results, _RESULTS)))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        sessions, results = self._holds()  # a bucket may come in several parts
        own = initialState[["session_id", "nobody", "results"]].explode("results").dropna(subset="results")
        own = own.assign(kind=[x["kind"] for x in own["results"]], payload=[x["payload"] for x in own["results"]])
        self._hold(pd.concat([sessions, initialState[_SESSIONS.names]]), pd.concat([results, own[_RESULTS.names]]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:  # one batch of a key at a time
            batch = batch.assign(ts=batch["ts"].astype("datetime64[us]").astype("int64"))
            self.waiting.appendList([(_packed(batch, _WAITING),)])
            first = min(x for x in (first, int(batch["ts"].min())) if x is not None)
        self._wake(-(-first // 1000))
        yield pd.DataFrame([], columns=_OUT)

    def _wake(self, at: int) -> None:
        """Wake at this millisecond, unless an earlier timer stands."""
        found = self.timer.get()
        if found is not None and found[0] <= at:
            return
        if found is not None:
            self.handle.deleteTimer(found[0])
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = _unpacked([bytes(x[0]) for x in self.waiting.get()], _WAITING)
        ready = events["ts"] <= passed
        self.timer.clear()
        self.waiting.clear()
        if not ready.all():
            left = events[~ready]
            self.waiting.put([(_packed(left, _WAITING),)])
            self._wake(-(-int(left["ts"].min()) // 1000))
        out = pd.DataFrame([], columns=_OUT)
        if ready.any():
            out, *held = taken(*self._holds(), events[ready])
            self._hold(*held)
        yield out

    def close(self) -> None:
        pass


def follow(events: DataFrame, late: str = "10 minutes", before: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A row per event: the session's epoch, file and number of results after it, once the watermark has passed the event.

    ``late`` is how far an event may come behind the latest one; ``before`` is
    what ``operators.session.state`` has found in earlier events. Sessions are
    dealt out to ``buckets`` of state, a number that a stream keeps for good.
    Needs the RocksDB state store (``ROCKS``).
    """

    def dealt(df: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")
        return df.withColumns({"bucket": bucket, "nobody": F.isnull("session_id"), "session_id": F.coalesce("session_id", F.lit(0).cast("long"))})

    grouped = dealt(events.withWatermark("ts", late)).groupBy("bucket")
    found = grouped.transformWithStateInPandas(SessionProcessor(), f"{OUTPUT}, nobody boolean", "Append", "EventTime", dealt(before).groupBy("bucket") if before is not None else None)
    return found.select(F.when(~F.col("nobody"), F.col("session_id")).alias("session_id"), "ts", "event_id", "epoch", "file_name", "results")


def active_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Visits: events of a session with no pause of ``gap``, once the watermark has passed them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    visits = timed.groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count("*").alias("events"))
    return visits.select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
