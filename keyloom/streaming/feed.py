"""Change feeds, in batch and as streams, and state kept from them."""

from __future__ import annotations

import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from keyloom.model import CHANGELOG
from keyloom.operators.ordered import stream_fold
from keyloom.operators.state import latest_per_key


def changes_since(state: DataFrame, since_us: int, limit: int, now_us: int, after: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of the latest changes from since_us on, tombstones as DEL, in order of time, namespace and key;
    and one row (next_us, next_ns, next_key, more): the page's last place, and whether there is a next page.

    The next page is that of since_us = next_us and after = (next_ns, next_key), so changes of one instant
    that do not fit a page are neither lost nor repeated."""
    fresh = (F.col("op") == "DEL") | F.col("expiry_us").isNull() | (F.col("expiry_us") > now_us)
    due = F.col("ts_us") >= since_us
    if after is not None:
        beyond = (F.col("ns") > after[0]) | (F.col("ns") == after[0]) & (F.col("key") > after[1])
        due = (F.col("ts_us") > since_us) | (F.col("ts_us") == since_us) & beyond
    rows = state.where(due & fresh).orderBy("ts_us", "ns", "key")
    rows = rows.select("op", "ns", "key", "value", "ts_us")
    page = rows.limit(limit)
    more = rows.limit(limit + 1).agg(F.count(F.lit(1)).alias("n")).select((F.col("n") > limit).alias("more"))
    last = page.agg(F.max(F.struct("ts_us", "ns", "key")).alias("l"))
    last = last.select(F.col("l.ts_us").alias("next_us"), F.col("l.ns").alias("next_ns"), F.col("l.key").alias("next_key"))
    return page, last.crossJoin(more)  # two single rows


def subscribe(spark: SparkSession, path: str, prefix: str = "", files_per_trigger: int = 16) -> DataFrame:
    """A stream of changes that arrive as Parquet files below path, by key prefix."""
    stream = spark.readStream.schema(CHANGELOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.where(F.col("key").startswith(prefix))


class Replica:
    """A state that a stream keeps by last write wins; replays change nothing.

    Each micro-batch is reduced to its latest change per key and merged into a new snapshot directory,
    named by the batch, so a batch that runs again after a failure writes the same result. Rows whose key
    is null cannot be applied and go to the dead letters."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _snapshots(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def state(self, before: int | None = None) -> DataFrame | None:
        done = [n for n in self._snapshots() if before is None or n < before]
        return self.spark.read.schema(CHANGELOG).parquet(f"{self.path}/batch={done[-1]}") if done else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        good = batch.where("key is not null")
        old = self.state(before=batch_id)
        merged = latest_per_key(good if old is None else old.unionByName(good))
        merged.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        batch.where("key is null").write.mode("overwrite").json(f"{self.path}-dead-letters/batch={batch_id}")
        self._drop(batch_id)

    def _drop(self, batch_id: int) -> None:
        """Remove snapshots that no batch reads again: all but this one and the one before it."""
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for n in [n for n in self._snapshots() if n < batch_id][:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={n}"), True)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Apply all that has arrived, then stop."""
        query = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def _bucket(tokens: float, last: float | None, times, rate: float, burst: float):
    out = []
    for at in times:
        tokens = burst if last is None else min(burst, tokens + max(0.0, at - last) / 1e6 * rate)
        last = at if last is None else max(last, at)
        ok = tokens >= 1
        tokens -= ok
        out.append(ok)
    return tokens, last, out


def token_bucket(writes: DataFrame, rate: float, burst: float | None = None) -> DataFrame:
    """(ns, version, admitted) of writes (ns, version, ts_us) in order: tokens refill at rate per second up
    to burst (rate if not given), start full, and each admitted write takes one."""
    most = burst or rate

    def step(state, row):
        tokens, last, (ok,) = _bucket(*state, [row["ts_us"]], rate, most)
        return (tokens, last), (row["ns"], row["version"], bool(ok))

    rows = writes.select("ns", "version", "ts_us")
    return stream_fold(rows, "ns", ["ts_us", "version"], lambda: (most, None), step, "ns string, version long, admitted boolean")


def stream_token_bucket(stream: DataFrame, rate: float, burst: float | None = None) -> DataFrame:
    """token_bucket over a stream; tokens are kept per namespace between micro-batches."""
    most = burst or rate

    def run(key, batches, state: GroupState):
        tokens, last = state.get if state.exists else (most, None)
        pdf = pd.concat(list(batches)).sort_values(["ts_us", "version"])
        tokens, last, ok = _bucket(tokens, last, pdf["ts_us"], rate, most)
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({"ns": key[0], "version": pdf["version"].to_numpy(), "admitted": ok})

    return stream.select("ns", "version", "ts_us").groupBy("ns").applyInPandasWithState(
        run, "ns string, version long, admitted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout
    )


def stream_counters(stream: DataFrame) -> DataFrame:
    """(key, value) of counters from a stream of (key, delta) in order of version; results stay within 64 bits."""

    def run(key, batches, state: GroupState):
        value = state.get[0] if state.exists else 0
        for delta in pd.concat(list(batches)).sort_values("version")["delta"]:
            value = min(2**63 - 1, max(-(2**63), value + int(delta)))
        state.update((value,))
        yield pd.DataFrame({"key": [key[0]], "value": [value]})

    return stream.select("key", "version", "delta").groupBy("key").applyInPandasWithState(
        run, "key string, value long", "value long", "update", GroupStateTimeout.NoTimeout
    )


def audit(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append each change that has arrived as a JSON line (time, verb, namespace, key) below path, then stop.
    What the stream has read is kept in the checkpoint, so a line is written once."""
    lines = stream.select("ts_us", F.when(F.col("op") == "DEL", "DEL").otherwise("PUT").alias("verb"), "ns", "key", "version")
    query = lines.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ship(batch: DataFrame, send, attempts: int = 5, wait_s: float = 0.1) -> DataFrame:
    """Send a batch by partitions of send(rows), each tried `attempts` times with waits that double; the rows
    of a partition that could not be sent are returned as dead letters, with the last error."""
    schema = StructType([*batch.schema.fields, StructField("error", StringType())])

    def run(batches):
        for part in batches:
            error = None
            for attempt in range(attempts):
                try:
                    send(part.to_pylist())
                    error = None
                    break
                except Exception as e:  # noqa: BLE001  (what a sink raises is its own matter; it ends in the dead letters)
                    error = f"{type(e).__name__}: {e}"
                    if attempt + 1 < attempts:
                        time.sleep(wait_s * 2**attempt)
            if error is not None:
                columns = [*part.columns, pa.array([error] * part.num_rows, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "error"])

    return batch.mapInArrow(run, schema)


def expire_stream(stream: DataFrame) -> DataFrame:
    """(ns, key, expiry_us, version) of keys whose last write expired by event time: the stream's watermark
    moves with ts_us, and a timer per key fires when it passes the key's expiry. A later write or deletion
    of a key moves or stops its timer."""

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            (version, at) = state.get
            state.remove()
            yield pd.DataFrame({"ns": [key[0]], "key": [key[1]], "expiry_us": [at], "version": [version]})
            return
        version, at = state.get if state.exists else (-1, None)
        for row in pd.concat(list(batches)).sort_values("version").itertuples(index=False):
            if row.version > version:
                version, at = int(row.version), None if row.op == "DEL" or pd.isna(row.expiry_us) else int(row.expiry_us)
        if at is None:
            state.update((version, None))
        else:
            state.update((version, at))
            state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs() + 1))

    timed = stream.select("ns", "key", "version", "op", "expiry_us", F.timestamp_micros("ts_us").alias("at")).withWatermark("at", "0 seconds")
    return timed.groupBy("ns", "key").applyInPandasWithState(
        run, "ns string, key string, expiry_us long, version long", "version long, at long", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_sets(stream: DataFrame) -> DataFrame:
    """(key, member, present) of sets from a stream of (key, member, op SADD|SREM, version): a member's last
    operation counts, so the state is one row per member and no set is held together."""

    def run(key, batches, state: GroupState):
        version, present = state.get if state.exists else (-1, False)
        for row in pd.concat(list(batches)).sort_values("version").itertuples(index=False):
            if row.version > version:
                version, present = int(row.version), row.op == "SADD"
        state.update((version, present))
        yield pd.DataFrame({"key": [key[0]], "member": [key[1]], "present": [present]})

    return stream.select("key", "member", "op", "version").groupBy("key", "member").applyInPandasWithState(
        run, "key string, member string, present boolean", "version long, present boolean", "update", GroupStateTimeout.NoTimeout
    )


def stream_lists(stream: DataFrame) -> DataFrame:
    """(key, seq, value) of pushes from a stream of (key, op LPUSH|RPUSH, value, version): the state of a
    list is its two ends, and its items are rows that leave with the batch."""

    def run(key, batches, state: GroupState):
        head, tail = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values("version")
        seqs = []
        for op in rows["op"]:
            seqs.append(head if op == "LPUSH" else tail)
            head, tail = (head - 1, tail) if op == "LPUSH" else (head, tail + 1)
        state.update((head, tail))
        yield pd.DataFrame({"key": key[0], "seq": pd.Series(seqs, dtype="int64"), "value": rows["value"].to_numpy()})

    return stream.select("key", "op", "value", "version").groupBy("key").applyInPandasWithState(
        run, "key string, seq long, value string", "head long, tail long", "append", GroupStateTimeout.NoTimeout
    )
