"""Compare-and-swap, counters, set-if-absent and guarded batches, applied set at a time.

Requests carry pos, their order. Counter folds are split into chunks of positions: adding and clamping to
64 bits composes associatively, so a hot key is folded by many tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.model import keys_of

MIN, MAX = -(2**63), 2**63 - 1
#: Positions that one task folds for a key.
CHUNK = 4096

_D = "decimal(38,0)"


def _compose(a: Column, b: Column) -> Column:
    """x -> min(max(x + s, lo), hi) after another of the kind."""
    clamp = lambda v: F.least(F.greatest(v, b["lo"]), b["hi"])
    add = lambda v: (v + b["s"]).cast(_D)
    return F.struct(add(a["s"]).alias("s"), clamp(add(a["lo"])).alias("lo"), clamp(add(a["hi"])).alias("hi"))


def _fold(steps: Column) -> Column:
    # The first step keeps any 64-bit number as it is.
    start = F.struct(F.lit(0).cast(_D).alias("s"), F.lit(MIN).cast(_D).alias("lo"), F.lit(MAX).cast(_D).alias("hi"))
    return F.aggregate(F.array_sort(steps), start, lambda a, x: _compose(a, x["f"]))


def increment(requests: DataFrame, live: DataFrame) -> DataFrame:
    """([ns,] key, value) after requests (pos, [ns,] key, delta) in order of pos on live counters; missing
    counts from 0 and results stay within 64 bits. A value that is no integer is null, as is its result.

    Where the start and the absolute deltas of a key add up to less than 64 bits, no step can reach a
    bound and the result is a plain sum. Only requests on other keys are folded in order."""
    by = keys_of(requests, live)
    size = F.when(F.col("delta") > MIN, F.abs("delta"))
    sums = requests.groupBy(*by).agg(F.try_sum("delta").alias("s"), F.try_sum(size).alias("a"), F.min("delta").alias("least"))
    start = live.select(*by, F.struct(integer(F.col("value")).alias("v")).alias("old"))
    old = F.when(F.col("old").isNull(), F.lit(0).cast("long")).otherwise(F.col("old.v"))
    joined = sums.join(start, by, "left").select(*by, "s", "a", "least", F.col("old").isNotNull().alias("there"), old.alias("v"))
    reach = F.try_add(F.when(F.col("v") > MIN, F.abs("v")), F.col("a"))
    near = F.col("v").isNotNull() & (reach.isNull() | (F.col("least") == MIN))
    plain = joined.where(~near).select(*by, (F.col("v") + F.col("s")).alias("value"))
    return plain.unionByName(_folded(requests, joined.where(near).select(*by, "v"), by))


def _folded(requests: DataFrame, start: DataFrame, by: list[str]) -> DataFrame:
    """increment for the keys of start ([ns,] key, v), step by step."""
    one = F.struct(F.col("delta").cast(_D).alias("s"), F.lit(MIN).cast(_D).alias("lo"), F.lit(MAX).cast(_D).alias("hi"))
    step = requests.join(start, by, "left_semi").select(*by, "pos", F.floor(F.col("pos") / CHUNK).alias("chunk"), one.alias("f"))
    chunks = step.groupBy(*by, "chunk").agg(_fold(F.collect_list(F.struct("pos", "f"))).alias("f"))
    folded = chunks.groupBy(*by).agg(_fold(F.collect_list(F.struct("chunk", "f"))).alias("f"))
    value = F.least(F.greatest((F.col("v").cast(_D) + F.col("f.s")).cast(_D), F.col("f.lo")), F.col("f.hi")).cast("long")
    return folded.join(start, by).select(*by, value.alias("value"))


def decrement(requests: DataFrame, live: DataFrame) -> DataFrame:
    """increment by the negated delta; the least number negates to itself."""
    negated = F.when(F.col("delta") == MIN, F.lit(MIN)).otherwise(-F.col("delta"))
    return increment(requests.withColumn("delta", negated), live)


def integer(value: Column) -> Column:
    """The 64-bit integer that a text spells, else null."""
    return F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("long"))


def set_if_absent(requests: DataFrame, live: DataFrame) -> DataFrame:
    """The (pos, [ns,] key, value) that are created: the first request of each key that is not live."""
    by = keys_of(requests, live)
    first = requests.groupBy(*by).agg(F.min_by(F.struct("pos", "value"), "pos").alias("r")).select("r.pos", *by, "r.value")
    return first.join(live.select(*by), by, "left_anti").select("pos", *by, "value")


def compare_and_swap(requests: DataFrame, live: DataFrame) -> DataFrame:
    """(pos, [ns,] key, result, value) for requests (pos, [ns,] key, expected, new): SUCCESS, MISMATCH or
    KEY_NOT_FOUND, and the key's value after it. Requests on one key see each other in order of pos.

    A chain of swaps is sequential by nature. The requests of a key are sorted next to each other and
    streamed with one value kept, so a hot key costs time in one task but no memory."""
    by = keys_of(requests, live)
    named = [F.col(c).cast("string").alias(c) for c in by]
    asked = requests.select(F.col("pos").cast("long").alias("pos"), *named, F.col("expected").cast("string").alias("expected"), F.col("new").cast("string").alias("new"))
    joined = asked.join(live.select(*named, F.col("value").cast("string").alias("value")), by, "left")
    dealt = joined.repartition(*by).sortWithinPartitions(*by, "pos")

    def swap(batches):
        last, value = None, None
        for batch in batches:
            rows = batch.to_pydict()
            result, values = [], []
            for key, expected, new, old in zip(zip(*(rows[c] for c in by)), rows["expected"], rows["new"], rows["value"]):
                if key != last:
                    last, value = key, old
                if value is None:
                    result.append("KEY_NOT_FOUND")
                elif value == expected:
                    value = new
                    result.append("SUCCESS")
                else:
                    result.append("MISMATCH")
                values.append(value)
            columns = [batch.column("pos"), *(batch.column(c) for c in by), pa.array(result, pa.string()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["pos", *by, "result", "value"])

    return dealt.mapInArrow(swap, f"pos long, {', '.join(f'{c} string' for c in by)}, result string, value string")


def key_version(live: DataFrame, keys: DataFrame) -> DataFrame:
    """([ns,] key, version): the write time of a live key, 0 of any other."""
    by = keys_of(keys, live)
    return keys.join(live.select(*by, "ts_us"), by, "left").select(*by, F.coalesce("ts_us", F.lit(0)).alias("version"))


def commit(ops: DataFrame, live: DataFrame) -> DataFrame:
    """(txn_id, status, op, [ns,] key, value) of transactions over the same state, each judged by itself.

    ops: (txn_id, pos, op SET|SETIF|DEL, [ns,] key, value, expected_version). If any guard of a transaction
    names another version than the key's, it conflicts and writes nothing. Else all its puts apply in
    order and then its deletes: one change per key, a delete winning over puts."""
    by = keys_of(ops, live)
    versions = live.select(*by, F.col("ts_us").alias("now_version"))
    judged = ops.join(versions, by, "left").withColumn("now_version", F.coalesce("now_version", F.lit(0)))
    bad = (F.col("op") == "SETIF") & (F.col("expected_version") != F.col("now_version"))
    conflicts = judged.groupBy("txn_id").agg(F.max(F.coalesce(bad, F.lit(False)).cast("int")).alias("conflict"))
    net = ops.groupBy("txn_id", *by).agg(F.max_by(F.struct("op", "value"), F.struct((F.col("op") == "DEL").cast("int").alias("d"), "pos")).alias("c"))
    done = net.join(conflicts, "txn_id")
    writes = done.where("conflict = 0").select(
        "txn_id", F.lit("COMMITTED").alias("status"), F.when(F.col("c.op") == "DEL", "DEL").otherwise("PUT").alias("op"), *by,
        F.when(F.col("c.op") != "DEL", F.col("c.value")).alias("value"),
    )
    refused = conflicts.where("conflict = 1").select(
        "txn_id", F.lit("CONFLICT").alias("status"), *(F.lit(None).cast("string").alias(c) for c in ("op", *by, "value"))
    )
    return writes.unionByName(refused)
