"""Backups, point-in-time restore, JSON lines, WAL text and archive metadata.

Paths are given to Spark's readers and writers, so any file system that Spark knows will do."""

from __future__ import annotations

import re
import zlib
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from keyloom.model import CHANGELOG
from keyloom.operators.placement import cold_handle
from keyloom.operators.state import GRACE_S, latest_per_key, reap

ARCHIVE = (
    "disk_idx int, seq long, first_version long, last_version long, first_unix_ns long, last_unix_ns long, created_unix_ns long, "
    "entries int, size_bytes long, crc32c string"
)


def full_backup(state: DataFrame, path: str) -> None:
    """Sorted by key within range partitions, so that later range reads skip row groups."""
    state.repartitionByRange("ns", "key").sortWithinPartitions("ns", "key").write.mode("errorifexists").parquet(path)


def changes_after(changes: DataFrame, version: int) -> DataFrame:
    """What an incremental backup holds."""
    return changes.where(F.col("version") > version)


def restore(chain: list[DataFrame]) -> DataFrame:
    """The state after a full backup and its increments, in any order: writes are ordered by themselves."""
    union = chain[0]
    for part in chain[1:]:
        union = union.unionByName(part)
    return latest_per_key(union)


def parse_target(text: str) -> tuple[str, int]:
    """("version", n) for version:n, ("ts_us", n) for an RFC 3339 time; anything else is an error."""
    if m := re.fullmatch(r"version:(\d+)", text):
        if int(m[1]) == 0:
            raise ValueError("version 0 is no target")
        return "version", int(m[1])
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", text):
        raise ValueError(f"no target: {text!r}")
    return "ts_us", round(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() * 1_000_000)


def restore_to(base: DataFrame, base_version: int, changes: DataFrame, target: str, preserve_ttl: bool = True) -> DataFrame:
    """The state at a target: the base backup and the later changes up to it.

    A version target at or before the base is an error. preserve_ttl=False makes restored keys immortal."""
    column, limit = parse_target(target)
    if column == "version" and limit <= base_version:
        raise ValueError("the target lies before the base backup")
    later = changes.where((F.col("version") > base_version) & (F.col(column) <= limit))
    out = latest_per_key(base.unionByName(later))
    return out if preserve_ttl else out.withColumn("expiry_us", F.lit(None).cast("long"))


def checkpoint(state: DataFrame, changes: DataFrame, path: str, now_us: int, grace_s: int = GRACE_S) -> None:
    """Write the compacted state; changes up to its greatest version may then be dropped."""
    reap(latest_per_key(state.unionByName(changes)), now_us, grace_s).write.mode("errorifexists").parquet(path)


def export_rows(live: DataFrame, prefix: str = "") -> DataFrame:
    return live.where(F.col("key").startswith(prefix)).select(F.col("key").alias("k"), F.base64(F.col("value").cast("binary")).alias("v"))


def write_jsonl(live: DataFrame, path: str, prefix: str = "") -> None:
    export_rows(live, prefix).write.mode("errorifexists").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of exported lines; a broken line is an error."""
    rows = spark.read.schema("k string, v string").option("mode", "FAILFAST").json(path)
    return rows.select(F.col("k").alias("key"), F.unbase64("v").cast("string").alias("value"))


def migrate(source: DataFrame, prefix: str = "") -> DataFrame:
    """The live rows that a copy by prefix takes."""
    return source.where(F.col("key").startswith(prefix))


def wal_lines(changes: DataFrame) -> DataFrame:
    """(value) log lines of changes, one record each: ts_ns|tombstone|key|value length|checksum|version. The
    checksum is CRC-32 of the value's bytes; keys with a bar or a line feed have no place in such a log."""
    value = F.coalesce(F.col("value"), F.lit(""))
    fields = [F.col("ts_us") * 1000, F.when(F.col("op") == "DEL", 1).otherwise(0), F.col("key"), F.octet_length(value), F.crc32(value.cast("binary")), F.col("version")]
    return changes.where(~F.col("key").rlike(r"[|\n]")).select(F.concat_ws("|", *(f.cast("string") for f in fields)).alias("value"))


def parse_wal(lines: DataFrame) -> DataFrame:
    """Records ts_ns|tombstone|key|value length|crc|version[|offset[|packed]] of log lines (value); a torn
    line, which has fewer fields or no numbers in them, is left out."""
    part = F.split("value", r"\|")
    rows = lines.select(part.alias("p")).where(F.size("p").between(6, 8))
    number = lambda i: F.get("p", F.lit(i)).try_cast("long")
    out = rows.select(
        number(0).alias("ts_ns"), (F.get("p", F.lit(1)).isin("1", "true")).alias("tombstone"), F.get("p", F.lit(2)).alias("key"),
        number(3).alias("value_length"), number(4).alias("crc"), number(5).alias("version"),
    )
    return out.where("ts_ns is not null and version is not null and value_length is not null")


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    return parse_wal(spark.read.text(path))


def check_values(records: DataFrame, values: DataFrame) -> DataFrame:
    """(version, key, fault) of log records whose value is missing, has another length or another checksum.
    values: (version, value). Tombstones have no value to check."""
    joined = records.where("not tombstone").join(values.select("version", F.struct("value").alias("v")), "version", "left")
    data = F.coalesce(F.col("v.value"), F.lit("")).cast("binary")
    fault = (
        F.when(F.col("v").isNull(), "missing")
        .when(F.octet_length(data) != F.col("value_length"), "length")
        .when(F.crc32(data) != F.col("crc"), "checksum")
    )
    return joined.select("version", "key", fault.alias("fault")).where("fault is not null")


def segments(changes: DataFrame, size: int) -> DataFrame:
    """Archive metadata of changes cut into segments of `size` versions each."""
    seq = F.expr(f"version div {size}")
    value = F.coalesce(F.col("value"), F.lit(""))
    out = changes.groupBy(seq.alias("seq")).agg(
        F.min("version").alias("first_version"), F.max("version").alias("last_version"), (F.min("ts_us") * 1000).alias("first_unix_ns"),
        (F.max("ts_us") * 1000).alias("last_unix_ns"), F.count(F.lit(1)).cast("int").alias("entries"), F.sum(F.octet_length(value)).alias("size_bytes"),
    )
    return out.select(
        (F.col("seq") % 4).cast("int").alias("disk_idx"), "seq", "first_version", "last_version", "first_unix_ns", "last_unix_ns",
        F.col("last_unix_ns").alias("created_unix_ns"), "entries", "size_bytes", F.lit(None).cast("string").alias("crc32c"),
    )


def listing(segments: DataFrame) -> DataFrame:
    """Archive segments in order of disk and sequence."""
    return segments.orderBy("disk_idx", "seq")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return listing(spark.read.schema(ARCHIVE).json(path))


def segments_for(segments: DataFrame, base_version: int, target_version: int) -> DataFrame:
    """The segments that a restore must read."""
    return segments.where((F.col("last_version") > base_version) & (F.col("first_version") <= target_version))


#: A backup's manifest: its kind (full or incremental), the version it starts after and the last it holds.
MANIFEST = "id string, kind string, base_version long, max_version long, rows long, path string"


def write_backup(changes: DataFrame, path: str, backup_id: str, base_version: int | None = None) -> None:
    """A full backup (base_version None) of a state, or an increment of the changes after a version, below
    path, with a line in the manifest table there."""
    spark, kind = changes.sparkSession, "full" if base_version is None else "incremental"
    rows = changes if base_version is None else changes_after(changes, base_version)
    full_backup(rows, f"{path}/{backup_id}")
    held = spark.read.schema(CHANGELOG).parquet(f"{path}/{backup_id}")
    line = held.agg(
        F.lit(backup_id).alias("id"), F.lit(kind).alias("kind"), F.lit(base_version or 0).cast("long").alias("base_version"),
        F.coalesce(F.max("version"), F.lit(base_version or 0)).cast("long").alias("max_version"), F.count(F.lit(1)).alias("rows"), F.lit(f"{path}/{backup_id}").alias("path"),
    )
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest").orderBy("base_version", "max_version")


def restore_backups(spark: SparkSession, path: str) -> DataFrame:
    """The state after the newest full backup below path and the increments that continue it; a gap in the
    chain is an error."""
    lines = manifest(spark, path).collect()  # a line per backup
    full = max((x for x in lines if x.kind == "full"), key=lambda x: x.max_version, default=None)
    if full is None:
        raise ValueError("no full backup")
    chain, reached = [full], full.max_version
    for x in lines:
        if x.kind == "incremental" and x.max_version > reached:
            if x.base_version > reached:
                raise ValueError(f"the chain breaks between versions {reached} and {x.base_version}")
            chain.append(x)
            reached = x.max_version
    return restore([spark.read.schema(CHANGELOG).parquet(x.path) for x in chain])


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGELOG).parquet(path)


def split_tiers(state: DataFrame, now_us: int, idle_us: int = 300_000_000) -> tuple[DataFrame, DataFrame]:
    """(hot, cold): rows written within the idle time, and the rest."""
    cold = F.col("ts_us") < now_us - idle_us
    return state.where(~cold), state.where(cold)


def demote(state: DataFrame, now_us: int, idle_us: int = 300_000_000, per_pass: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(hot, cold) after one pass that moves at most per_pass idle rows, the coldest first. A cold row
    (handle, ns, key, value, ts_us) is what the tier keeps; a hot row of it has its handle as value."""
    idle = state.where((F.col("op") == "PUT") & (F.col("ts_us") < now_us - idle_us)).orderBy("ts_us", "ns", "key").limit(per_pass)
    cold = idle.select(cold_handle(F.col("key"), F.coalesce("value", F.lit(""))).alias("handle"), "ns", "key", "value", "ts_us")
    moved = F.broadcast(cold.select("ns", "key", "handle"))  # per_pass rows at most
    hot = state.join(moved, ["ns", "key"], "left")
    return hot.withColumn("value", F.coalesce("handle", "value")).withColumn("cold", F.col("handle").isNotNull()).drop("handle"), cold


def fetch(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """(ns, key, value) of demoted state: cold values by their handles."""
    by_handle = cold.select(F.col("handle").alias("value"), "ns", "key", F.lit(True).alias("cold"), F.struct(F.col("value")).alias("kept"))
    joined = hot.join(by_handle, ["value", "ns", "key", "cold"], "left")
    return joined.select("ns", "key", F.when(F.col("cold"), F.col("kept.value")).otherwise(F.col("value")).alias("value"))


#: Values of fewer bytes are stored as they are; a stored value starts with a byte that names its form.
COMPRESS_FROM = 256


@F.pandas_udf(BinaryType())
def compress(data: pd.Series) -> pd.Series:
    """1 and the deflated bytes where that is smaller, else 0 and the bytes."""

    def one(blob):
        if blob is None:
            return None
        blob = bytes(blob)
        packed = zlib.compress(blob, 6) if len(blob) >= COMPRESS_FROM else blob
        return b"\x01" + packed if len(packed) < len(blob) else b"\x00" + blob

    return data.map(one)


@F.pandas_udf(BinaryType())
def decompress(data: pd.Series) -> pd.Series:
    def one(blob):
        if blob is None:
            return None
        form, rest = bytes(blob[:1]), bytes(blob[1:])
        if form not in (b"\x00", b"\x01"):
            raise ValueError(f"unknown form {form!r}")
        return zlib.decompress(rest) if form == b"\x01" else rest

    return data.map(one)


def migrate_schema(rows: DataFrame, steps: dict[int, object], target: int) -> DataFrame:
    """Values brought from their schema_version to target by one Column function per version; a version
    without its step is an error."""
    for version in range(1, target):
        due = F.col("schema_version") == version
        step = steps.get(version)
        new = step(F.col("value")) if step else F.raise_error(F.lit(f"no step from version {version}")).cast("string")
        rows = rows.withColumn("value", F.when(due, new).otherwise(F.col("value")))
        rows = rows.withColumn("schema_version", F.when(due, F.lit(version + 1)).otherwise(F.col("schema_version")).cast("short"))
    return rows
