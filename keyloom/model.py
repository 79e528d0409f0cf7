"""Data model: an append-only change log and the keyspace state derived from it.

Keys are typed columns (ns, key), not encoded strings. A change has a version (the total order of writes),
a time in microseconds, an operation (PUT or DEL), a value, and the absolute time at which it expires
(null: never). The state has one row per (ns, key), its latest change, tombstones included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGELOG = "version long, ts_us long, op string, ns string, key string, value string, expiry_us long, schema_version short"
KEY = ["ns", "key"]


def keys_of(requests: DataFrame, live: DataFrame) -> list[str]:
    """The columns by which requests meet live rows: (ns, key), or key where neither has namespaces.

    Equal keys of two namespaces are two keys, so requests on a frame with namespaces must name theirs."""
    if "ns" in live.columns and "ns" not in requests.columns:
        raise ValueError("requests on a keyspace with namespaces need a column ns")
    return KEY if "ns" in live.columns else ["key"]


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def expiry(ts_us: Column, ttl_s: Column) -> Column:
    """Absolute expiry of a TTL in seconds; a TTL of zero or less never expires."""
    return F.when(ttl_s > 0, ts_us + ttl_s.cast("long") * 1_000_000)


def changelog(
    rows: DataFrame, *, version: Column, ts_us: Column, ns: Column, key: Column, value: Column, op: Column | None = None, ttl_s: Column | None = None
) -> DataFrame:
    """A change log from rows of any table."""
    return rows.select(
        version.cast("long").alias("version"),
        ts_us.cast("long").alias("ts_us"),
        (F.lit("PUT") if op is None else op).alias("op"),
        ns.cast("string").alias("ns"),
        key.cast("string").alias("key"),
        value.cast("string").alias("value"),
        (F.lit(None).cast("long") if ttl_s is None else expiry(ts_us, ttl_s)).alias("expiry_us"),
        F.lit(1).cast("short").alias("schema_version"),
    )
