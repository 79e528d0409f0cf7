"""Write verbs as functions from requests and state to change rows, which the change log is appended with.

Requests carry pos, their order; a verb's changes get the versions from `version` on in that order. Answers
(counts, errors of single requests) are rows too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.model import CHANGELOG, KEY, expiry
from keyloom.operators.state import latest_per_key

#: Requests that one task numbers at most.
CHUNK = 65_536


def _numbered(requests: DataFrame, version: int) -> DataFrame:
    """requests with gapless versions in order of pos, counted in chunks of positions."""
    chunked = requests.withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    sizes = chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))  # a row per CHUNK requests
    offsets = sizes.select("chunk", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("chunk").orderBy("pos"))
    return chunked.withColumn("nth", nth).join(offsets, "chunk").withColumn("version", F.lit(version - 1) + F.col("before") + F.col("nth"))


def _changes(rows: DataFrame, ts_us: int, op: str, value: Column, ttl_s: Column) -> DataFrame:
    at = F.lit(ts_us).cast("long")
    return rows.select(
        F.col("version").cast("long").alias("version"), at.alias("ts_us"), F.lit(op).alias("op"), "ns", "key", value.cast("string").alias("value"),
        expiry(at, ttl_s).alias("expiry_us"), F.lit(1).cast("short").alias("schema_version"),
    )


def _named(requests: DataFrame) -> DataFrame:
    return requests if "ns" in requests.columns else requests.withColumn("ns", F.lit(""))


def put(requests: DataFrame, ts_us: int, version: int) -> DataFrame:
    """Change rows of requests (pos, [ns,] key, value[, ttl_s]); without ns they are of the default
    namespace "". A TTL of zero or less, or none, never expires. An empty key is no key: its request is left out."""
    ttl = F.col("ttl_s") if "ttl_s" in requests.columns else F.lit(0)
    rows = _numbered(_named(requests).where("key is not null and key != ''"), version)
    return _changes(rows, ts_us, "PUT", F.col("value"), ttl)


def delete(requests: DataFrame, live: DataFrame, ts_us: int, version: int) -> tuple[DataFrame, DataFrame]:
    """(tombstones, answers) of requests (pos, [ns,] key): a tombstone per key asked for, live or not, and
    (pos, ns, key, deleted), of which the first request of a live key is true."""
    asked = _named(requests)
    first = asked.groupBy(*KEY).agg(F.min("pos").alias("pos"))
    gone = _changes(_numbered(first, version), ts_us, "DEL", F.lit(None), F.lit(0))
    have = live.select(*KEY, F.lit(True).alias("have"))
    hit = first.join(have, KEY, "left_semi").select(*KEY, "pos", F.lit(True).alias("hit"))
    answers = asked.join(hit, [*KEY, "pos"], "left").select("pos", *KEY, F.coalesce("hit", F.lit(False)).alias("deleted"))
    return gone, answers


def apply(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after changes: last write wins."""
    return latest_per_key(state.unionByName(changes.select(*(c.split()[0] for c in CHANGELOG.split(", ")))))


def garbage(state: DataFrame, changes: DataFrame, now_us: int, young_us: int = 30_000_000) -> DataFrame:
    """(version, ts_us, ns, key) of values that no key holds any more, coldest first: the order in which a
    collector takes them. Those written within young_us are left for a later pass."""
    old = changes.where((F.col("op") == "PUT") & (F.col("ts_us") <= now_us - young_us))
    held = state.where("op = 'PUT'").select(*KEY, "version")
    return old.select("version", "ts_us", *KEY).join(held, [*KEY, "version"], "left_anti").orderBy("ts_us", "version")
