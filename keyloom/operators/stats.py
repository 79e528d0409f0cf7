"""Statistics of operations, disks, replicas and namespaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.bind import position
from keyloom.operators.ordered import stream_fold

#: Replicas at most, as a power of two: their acks travel as one array.
ACK_BITS = 16
#: Bits of a version that tell the writes of one range apart.
RANGE_BITS = 16
#: The percentiles of a latency report.
PERCENTILES = (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))


def percentiles(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank percentiles sorted[int((n - 1) * p)] and the maximum, per group.

    Equal values are counted before they meet, so a group costs its distinct values, not its rows."""
    counted = samples.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * F.lit(p)), F.col(value)))
    return placed.groupBy(by).agg(F.max("n").alias("n"), *(at(p).alias(name) for name, p in PERCENTILES), F.max(value).alias("max"))


def throughput(samples: DataFrame, by: str, failed: Column, elapsed_s: float) -> DataFrame:
    done = F.count_if(~failed)
    return samples.groupBy(by).agg(
        (done / F.lit(elapsed_s)).alias("ops_per_s"), (F.count_if(failed) * 100 / F.count(F.lit(1))).alias("error_pct")
    )


def rates(samples: DataFrame, by: str, ts_us: str, value: str) -> DataFrame:
    """(by, ts, rate): change of a counter per second since the sample before; none for the first."""
    order = Window.partitionBy(by).orderBy(ts_us, value)
    seconds = (F.col(ts_us) - F.lag(ts_us).over(order)) / 1e6
    rate = F.when(seconds > 0, (F.col(value) - F.lag(value).over(order)) / seconds)
    return samples.select(by, ts_us, rate.alias("rate")).where("rate is not null")


def ewma(samples: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """new = old - (old >> 3) + (x >> 3) from 0, in order; the fold is sequential by nature and streamed."""
    kind = samples.schema[by].dataType.simpleString()
    rows = samples.select(F.col(by).alias("_by"), F.col(order).alias("_at"), F.col(value).cast("long").alias("_x"))

    def step(s, row):
        return s - (s >> 3) + (row["_x"] >> 3), None

    return stream_fold(rows, "_by", ["_at", "_x"], lambda: 0, step, f"{by} {kind}, ewma long", lambda key, s: (key, s))


def slow_disks(disks: DataFrame, factor: float = 5.0) -> DataFrame:
    """(disk_idx, latency, slow): write plus read latency against the upper median; with fewer than two
    disks or no positive median none is slow. There are as many rows as disks."""
    latency = disks.select("disk_idx", (F.col("write_ewma_s") + F.col("read_ewma_s")).alias("latency"))
    sorted_ = F.sort_array(F.collect_list("latency"))
    median = latency.agg(F.get(sorted_, F.floor(F.count(F.lit(1)) / 2).cast("int")).alias("median"), F.count(F.lit(1)).alias("n"))
    flag = (F.col("n") >= 2) & (F.col("median") > 0) & (F.col("latency") >= factor * F.col("median"))
    one = F.lit(1).alias("one")
    return latency.select("*", one).join(F.broadcast(median.select("*", one)), "one").select("disk_idx", "latency", flag.alias("slow"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


def watermark(replicas: DataFrame) -> DataFrame:
    """The least of the replicas' greatest watermarks; the largest number without replicas."""
    per = replicas.groupBy("replica").agg(F.max("watermark_us").alias("w"))
    return per.agg(F.coalesce(F.min("w"), F.lit(2**63 - 1)).alias("watermark_us"))


def quorum(ops: DataFrame, acks: DataFrame, factor: int) -> DataFrame:
    """(seq, acked, committed): the replicas that have each op, the writer included, against a majority.

    acks: last_ack per replica, a few rows that are summed up as one sorted array."""
    sorted_ = _sorted_acks(acks)
    joined = ops.select("seq", F.lit(1).alias("one")).join(F.broadcast(sorted_), "one")
    acked = F.size("acks") - position(F.col("acks"), F.col("seq")) + 1
    return joined.select("seq", acked.cast("long").alias("acked"), (acked >= factor // 2 + 1).alias("committed"))


def _sorted_acks(acks: DataFrame) -> DataFrame:
    """One row (acks, one): the replicas' last acks, sorted; more than 2 ** ACK_BITS replicas are an error."""
    out = acks.agg(F.array_sort(F.collect_list("last_ack")).alias("acks"))
    many = F.raise_error(F.lit("too many replicas")).cast("array<bigint>")
    return out.select(F.when(F.size("acks") > 2**ACK_BITS, many).otherwise(F.col("acks")).alias("acks"), F.lit(1).alias("one"))


def anti_entropy(ops: DataFrame, replicas: DataFrame) -> DataFrame:
    """(replica, seq): what each replica still lacks, its result being all of these pairs. The replicas
    travel as one sorted array, and an op meets only those that lack it."""
    many = F.raise_error(F.lit("too many replicas")).cast("array<struct<last_ack:bigint,replica:bigint>>")
    packed = replicas.agg(F.array_sort(F.collect_list(F.struct(F.col("last_ack").cast("long").alias("last_ack"), F.col("replica").cast("long").alias("replica")))).alias("rs"))
    packed = packed.select(F.when(F.size("rs") > 2**ACK_BITS, many).otherwise(F.col("rs")).alias("rs"), F.lit(1).alias("one"))
    joined = ops.select("seq", F.lit(1).alias("one")).join(F.broadcast(packed), "one")
    behind = position(F.col("rs"), F.col("seq"), lambda r, seq: r["last_ack"] < seq)
    return joined.select("seq", F.explode(F.slice("rs", F.lit(1), behind)).alias("r")).select("r.replica", "seq")


def replica_lag(ops: DataFrame, replicas: DataFrame) -> DataFrame:
    """(replica, ops_behind, bytes_behind) of the replicas that lack something: ops are summed by how many
    replicas lack them, and a replica's share is a running sum over those few sums."""
    joined = ops.select("seq", "size", F.lit(1).alias("one")).join(F.broadcast(_sorted_acks(replicas)), "one")
    behind = position(F.col("acks"), F.col("seq"))
    sums = joined.groupBy(behind.alias("behind")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).where("behind > 0")
    # The replica of rank r, from the one furthest behind on, lacks the ops that r or more replicas lack.
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("last_ack", "replica"))  # 2 ** ACK_BITS rows at most
    ranked = replicas.select("replica", "last_ack").withColumn("rank", rank)
    upto = Window.partitionBy(F.lit(1)).orderBy(F.desc("at"))
    both = ranked.select(F.col("rank").alias("at"), "replica", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("b")).unionByName(
        sums.select(F.col("behind").alias("at"), F.lit(None).cast("long").alias("replica"), "n", F.col("b").cast("long").alias("b"))
    )
    summed = both.select("replica", F.sum("n").over(upto).alias("ops_behind"), F.sum("b").over(upto).alias("bytes_behind"))
    return summed.where("replica is not null and ops_behind > 0")


def quota_snapshot(live: DataFrame, limits: DataFrame) -> DataFrame:
    """(ns, max_keys, keys, full) of every namespace with a limit."""
    have = live.groupBy("ns").agg(F.count(F.lit(1)).alias("have"))
    joined = limits.join(have, "ns", "left").withColumn("keys", F.coalesce("have", F.lit(0)))
    return joined.select("ns", "max_keys", "keys", ((F.col("max_keys") > 0) & (F.col("keys") >= F.col("max_keys"))).alias("full"))


def admit_new_keys(writes: DataFrame, max_keys: int) -> DataFrame:
    """(ns, key, admitted): a namespace's first max_keys distinct keys in order of version are admitted.

    Keys are reduced to their first write; a namespace's keys are then counted in two steps, by ranges of
    versions and within the range that the limit falls into, so no task orders a whole namespace."""
    first = writes.groupBy("ns", "key").agg(F.min("version").alias("version"))
    ranges = first.groupBy("ns", F.shiftright("version", RANGE_BITS).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("ns").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranges.select("ns", "r", "n", (upto - F.col("n")).alias("before"))
    joined = first.withColumn("r", F.shiftright("version", RANGE_BITS)).join(placed, ["ns", "r"])
    nth = F.row_number().over(Window.partitionBy("ns", "r").orderBy("version")) + F.col("before")
    return joined.select("ns", "key", (nth <= max_keys).alias("admitted"))


def archive_stats(segments: DataFrame) -> DataFrame:
    return segments.agg(
        F.count(F.lit(1)).alias("segments"), F.max("last_version").alias("max_version"), F.min("first_unix_ns").alias("first_unix_ns"),
        F.max("last_unix_ns").alias("last_unix_ns"), F.sum("entries").alias("entries"), F.sum("size_bytes").alias("size_bytes"),
    )


def histogram_quantile(buckets: DataFrame, by: str, q: float) -> DataFrame:
    """A quantile from cumulative buckets (by, le, count), interpolated within its bucket."""
    order = Window.partitionBy(by).orderBy("le")
    rows = buckets.select(
        by, "le", "count", F.coalesce(F.lag("le").over(order), F.lit(0.0)).alias("low"), F.coalesce(F.lag("count").over(order), F.lit(0)).alias("below"),
        F.max("count").over(Window.partitionBy(by)).alias("total"),
    )
    rank = F.lit(q) * F.col("total")
    hit = rows.where((F.col("count") >= rank) & (F.col("below") < rank))
    value = F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("below")) / (F.col("count") - F.col("below"))
    return hit.select(by, value.alias("value"))


def segment_garbage(segments: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(segment, ratio, collect): dead against total bytes."""
    ratio = F.when(F.col("total_bytes") > 0, F.col("dead_bytes") / F.col("total_bytes")).otherwise(0.0)
    return segments.select("segment", ratio.alias("ratio"), (ratio >= threshold).alias("collect"))


def snapshot(state: DataFrame, now_us: int) -> DataFrame:
    """One row of counters over the whole state."""
    live = (F.col("op") == "PUT") & (F.col("expiry_us").isNull() | (F.col("expiry_us") > now_us))
    return state.agg(
        F.count_if(live).alias("live_keys"), F.count_if(F.col("op") == "DEL").alias("tombstones"),
        F.count_if((F.col("op") == "PUT") & ~live).alias("expired"), F.count_if(live & F.col("expiry_us").isNotNull()).alias("with_ttl"),
        F.sum(F.when(live, F.octet_length("value")).otherwise(0)).alias("live_bytes"), F.max("version").alias("max_version"),
    )
