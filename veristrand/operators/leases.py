"""Fenced, expiring leases over an event log.

Events: key, ts (epoch seconds), event_id (ties), kind (claim, renew, release), owner,
generation (of renewals and releases). The state after each event depends on the one
before, so a key's events are folded in order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HEARTBEAT_S, LEASE_STALE_S


@dataclass
class Lease:
    """State of one key; generation 0 has never been claimed."""

    owner: str | None = None
    generation: int = 0
    renewed_at: float = 0.0
    active: bool = False

    def fresh(self, now: float, stale: float) -> bool:
        return self.active and now - self.renewed_at < stale

    def holds(self, owner: str, generation: int | None) -> bool:
        return self.active and self.owner == owner and self.generation == generation

    def apply(self, kind: str, owner: str, generation: int | None, now: float, stale: float) -> tuple[bool, bool]:
        """(accepted, reclaimed). A refused claim leaves the lease as it is."""
        if kind == "claim":
            if self.fresh(now, stale):
                return False, False
            reclaimed = self.active
            self.owner, self.generation, self.renewed_at, self.active = owner, self.generation + 1, now, True
            return True, reclaimed
        if not self.holds(owner, generation) or kind == "renew" and not self.fresh(now, stale):
            return False, False
        if kind == "renew":
            self.renewed_at = now
        else:
            self.active = False
        return True, False


def fold(events: Iterable[tuple], stale: float, lease: Lease | None = None) -> Iterator[tuple]:
    """(kind, owner, generation, ts) in order -> the state after each, with accepted and reclaimed."""
    if stale <= 0:
        raise ValueError("a lease needs a positive time to live")
    lease = lease or Lease()
    for kind, owner, generation, ts in events:
        accepted, reclaimed = lease.apply(kind, owner, generation, ts, stale)
        yield accepted, reclaimed, lease.owner, lease.generation, lease.renewed_at, lease.active


_STATE = ["accepted", "reclaimed", "holder", "now_generation", "renewed_at", "active"]


def replay(events: DataFrame, stale: float = LEASE_STALE_S) -> DataFrame:
    """events with accepted, reclaimed and the state after each; rows with a null key take no part.

    A key's events pass in order with its lease at hand, so a task holds one batch of events
    and one lease, however many events a key has.
    """
    if stale <= 0:
        raise ValueError("a lease needs a positive time to live")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, lease = None, Lease()
        for pdf in batches:
            out: list[tuple] = []
            keys = pdf["key"].tolist()
            gens = [None if pd.isna(g) else int(g) for g in pdf["generation"]]
            rows = list(zip(pdf["kind"], pdf["owner"], gens, pdf["ts"], strict=True))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != current:
                    current, lease = keys[at], Lease()
                out += fold(rows[at:end], stale, lease)
                at = end
            yield pd.concat([pdf[["key", "event_id", "ts", "kind", "owner"]], pd.DataFrame(out, columns=_STATE, index=pdf.index)], axis=1)

    kind = events.schema["key"].dataType.simpleString()
    schema = f"key {kind}, event_id long, ts double, kind string, owner string, accepted boolean, reclaimed boolean, holder string, now_generation long, renewed_at double, active boolean"
    rows = events.where("key is not null").select("key", "event_id", "ts", "kind", "owner", F.col("generation").cast("long").alias("generation"))
    return rows.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(run, schema)


def generations(events: DataFrame, stale: float = LEASE_STALE_S) -> DataFrame:
    """key, generations: where every event renews, a gap of stale seconds or more starts a new one."""
    before = F.lag("ts").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    new = F.when(before.isNull() | (F.col("ts") - before >= stale), 1).otherwise(0)
    return events.withColumn("new", new).groupBy("key").agg(F.sum("new").alias("generations"))


def is_current(owner: Column, generation: Column, now: Column, stale: float = LEASE_STALE_S) -> Column:
    """Whether a lease row (owner_id, generation, renewed_at, active) is held by owner and generation, and fresh."""
    return F.col("active") & (F.col("owner_id") == owner) & (F.col("generation") == generation) & (now - F.col("renewed_at") < stale)


def fenced_writes(writes: DataFrame, log: DataFrame, stale: float = LEASE_STALE_S) -> DataFrame:
    """writes (key, write_id, ts, owner, generation) with ``accepted``.

    log: states over time, as ``replay`` gives them. A write counts if the last state up to
    its time is active, its owner's and generation's, and fresh. One union ordered by time
    carries the state to the writes; nothing is paired.
    """
    state = F.struct("holder", "now_generation", "renewed_at", "active").alias("state")
    none = F.lit(None).cast("struct<holder:string,now_generation:bigint,renewed_at:double,active:boolean>").alias("state")
    a = log.select("key", "ts", F.lit(0).alias("side"), F.col("event_id").alias("id"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("long").alias("generation"), state)
    b = writes.select("key", "ts", F.lit(1).alias("side"), F.col("write_id").alias("id"), "owner", F.col("generation").cast("long").alias("generation"), none)
    run = Window.partitionBy("key").orderBy("ts", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("s", F.last("state", ignorenulls=True).over(run)).where("side = 1")
    ok = F.col("s.active") & (F.col("s.holder") == F.col("owner")) & (F.col("s.now_generation") == F.col("generation")) & (F.col("ts") - F.col("s.renewed_at") < stale)
    return met.select("key", F.col("id").alias("write_id"), "ts", "owner", "generation", F.coalesce(ok, F.lit(False)).alias("accepted"))


def in_progress(leases: DataFrame, now: float) -> DataFrame:
    """Leases active and renewed within two heartbeats of now."""
    return leases.where(F.col("active") & (F.col("renewed_at") >= now - 2 * HEARTBEAT_S))


def lost_by_silence(renewals: DataFrame, stale: float = LEASE_STALE_S, until: float | None = None) -> DataFrame:
    """key, lost_at: the first moment when half the time to live had passed without a renewal.

    Silence after a key's last renewal counts up to until, where that is given.
    """
    after = F.lead("ts").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    gap = renewals.withColumn("after", after if until is None else F.coalesce(after, F.lit(float(until)))).where(F.col("after") - F.col("ts") >= stale / 2)
    return gap.groupBy("key").agg(F.min(F.col("ts") + stale / 2).alias("lost_at"))
