"""The lease state machine over a stream of events, keyed state in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import LEASE_STALE_S
from ..operators.leases import Lease, fold

_OUT = "key long, event_id long, ts double, kind string, owner string, accepted boolean, reclaimed boolean, holder string, now_generation long, renewed_at double, active boolean"
_STATE = "owner string, generation long, renewed_at double, active boolean"
_COLUMNS = ["accepted", "reclaimed", "holder", "now_generation", "renewed_at", "active"]


def _step(pdf: pd.DataFrame, lease: Lease, stale: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["ts", "event_id"])
    gens = [None if pd.isna(g) else int(g) for g in pdf["generation"]]
    rows = list(fold(zip(pdf["kind"], pdf["owner"], gens, pdf["ts"], strict=True), stale, lease))
    return pd.concat([pdf[["key", "event_id", "ts", "kind", "owner"]], pd.DataFrame(rows, columns=_COLUMNS, index=pdf.index)], axis=1)


def lease_stream(events: DataFrame, stale: float = LEASE_STALE_S) -> DataFrame:
    """``operators.leases.replay`` over a stream (key long, ...): within a batch events are ordered by time.

    A key's state is four values, whatever its history.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lease = Lease(*state.get) if state.exists else Lease()
        yield _step(pd.concat(list(batches)), lease, stale)
        state.update((lease.owner, lease.generation, lease.renewed_at, lease.active))

    return events.select("key", "event_id", "ts", "kind", "owner", F.col("generation").cast("long").alias("generation")).groupBy("key").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


class LeaseProcessor(StatefulProcessor):
    """The same over ``transformWithStateInPandas`` (RocksDB state store)."""

    def __init__(self, stale: float = LEASE_STALE_S):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lease", _STATE)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        lease = Lease(*self.state.get()) if self.state.exists() else Lease()
        yield _step(pd.concat(list(rows)), lease, self.stale)
        self.state.update((lease.owner, lease.generation, lease.renewed_at, lease.active))

    def close(self) -> None:
        pass


class SilenceProcessor(StatefulProcessor):
    """The first moment at which a key was silent for half its time to live, told by a timer: no later event is needed.

    State is the last renewal and whether its loss has been told; one timer a key.
    """

    def __init__(self, stale: float = LEASE_STALE_S):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("renewal", "ts double, told boolean")

    def _due(self, ts: float) -> float:
        return ts + self.stale / 2

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        last, told = self.state.get() if self.state.exists() else (None, False)
        if last is not None and not told:
            self.handle.deleteTimer(int(self._due(last) * 1000))
        lost = None
        for ts in sorted(t for pdf in rows for t in pdf["ts"]):
            if last is not None and not told and ts - last >= self.stale / 2:
                lost, told = self._due(last), True
            last = ts if last is None else max(last, ts)
        self.state.update((last, told))
        if not told:
            self.handle.registerTimer(int(self._due(last) * 1000))
        if lost is not None:
            yield pd.DataFrame({"key": [key[0]], "lost_at": [lost]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        last, told = self.state.get()
        if not told:
            self.state.update((last, True))
            yield pd.DataFrame({"key": [key[0]], "lost_at": [self._due(last)]})

    def close(self) -> None:
        pass


def silence_stream(renewals: DataFrame, stale: float = LEASE_STALE_S, late: str = "0 seconds") -> DataFrame:
    """key, lost_at of a stream of renewals (key long, ts in epoch seconds), by event time: ``operators.leases.lost_by_silence`` up to the watermark.

    Renewals older than the watermark (by late, and at the epoch itself) don't count. Needs the
    RocksDB state store.
    """
    timed = renewals.select("key", "ts", F.timestamp_seconds("ts").alias("at")).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(SilenceProcessor(stale), "key long, lost_at double", "Append", "EventTime")


def sessions(events: DataFrame, gap_seconds: int = LEASE_STALE_S, late: str = "1 hour") -> DataFrame:
    """key, start, end, events: gap sessions of a stream (key, at timestamp), with a watermark."""
    s = events.withWatermark("at", late).groupBy("key", F.session_window("at", f"{gap_seconds} seconds").alias("s"))
    return s.agg(F.count(F.lit(1)).alias("events")).select("key", "s.start", "s.end", "events")
