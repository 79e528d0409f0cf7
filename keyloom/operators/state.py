"""Latest state per key, liveness, and reads as of a version or a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.model import KEY

#: Seconds that a tombstone is kept before it may be dropped.
GRACE_S = 86_400


def latest_per_key(changes: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Last write wins by (ts_us, version): one row per key, tombstones included.

    max_by merges partial results before the shuffle, so a hot key sends one row per task."""
    rest = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct("ts_us", "version")).alias("last")
    return changes.groupBy(*keys).agg(last).select(*keys, "last.*").select(*changes.columns)


def is_live(now_us: int | Column) -> Column:
    """Not a tombstone, and not expired: the expiry instant itself is expired."""
    now = now_us if isinstance(now_us, Column) else F.lit(now_us).cast("long")
    return (F.col("op") == "PUT") & (F.col("expiry_us").isNull() | (F.col("expiry_us") > now))


def live(state: DataFrame, now_us: int) -> DataFrame:
    return state.where(is_live(now_us))


def as_of_version(changes: DataFrame, version: int) -> DataFrame:
    return latest_per_key(changes.where(F.col("version") <= version))


def as_of_time(changes: DataFrame, ts_us: int) -> DataFrame:
    return latest_per_key(changes.where(F.col("ts_us") <= ts_us))


def validity(changes: DataFrame) -> DataFrame:
    """Each change with the time until which it was the latest (null: still is)."""
    order = Window.partitionBy(*KEY).orderBy("ts_us", "version")
    return changes.withColumn("until_us", F.lead("ts_us").over(order))


def ttl_remaining(now_us: int, absent: int = -2) -> Column:
    """Whole seconds until expiry; -1 never expires, absent for a dead row."""
    left = F.floor((F.col("expiry_us") - F.lit(now_us)) / 1_000_000).cast("int")
    return F.when(~is_live(now_us), absent).when(F.col("expiry_us").isNull(), -1).otherwise(left)


def expire(state: DataFrame, now_us: int) -> DataFrame:
    """Tombstones for the rows that expired by now."""
    due = state.where((F.col("op") == "PUT") & (F.col("expiry_us") <= now_us))
    return due.select(
        *(
            {"op": F.lit("DEL"), "ts_us": F.lit(now_us).cast("long"), "value": F.lit(None).cast("string"), "expiry_us": F.lit(None).cast("long")}
            .get(c, F.col(c)).alias(c) for c in state.columns
        )
    )


def reap(state: DataFrame, now_us: int, grace_s: int = GRACE_S) -> DataFrame:
    """The state without tombstones older than the grace period."""
    return state.where((F.col("op") != "DEL") | (F.col("ts_us") + grace_s * 1_000_000 > now_us))


def compact(snapshot: DataFrame, changes: DataFrame, now_us: int) -> DataFrame:
    """The state after more changes, reaped: what a checkpoint writes."""
    return reap(latest_per_key(snapshot.unionByName(changes)), now_us)
