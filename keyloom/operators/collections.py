"""Hashes, lists and sets as rows: (key, field, value, op, expiry_us, ts_us), (key, seq, value) and (key, member).

A hash field is live as a key is: deleted and expired fields are not read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.model import expiry
from keyloom.operators.ordered import running
from keyloom.operators.state import is_live, ttl_remaining


def hget(fields: DataFrame, key: str, field: str, now_us: int) -> DataFrame:
    return fields.where((F.col("key") == key) & (F.col("field") == field) & is_live(now_us)).select("value")


def hgetall(fields: DataFrame, key: str, now_us: int) -> DataFrame:
    return fields.where((F.col("key") == key) & is_live(now_us)).select("field", "value").orderBy("field")


def hash_maps(fields: DataFrame, now_us: int) -> DataFrame:
    """One map per hash, as a client holds it; a hash that outgrows a row is read by hgetall."""
    entries = F.collect_list(F.struct("field", "value"))
    return fields.where(is_live(now_us)).groupBy("key").agg(F.map_from_entries(entries).alias("fields"))


def hkeys(fields: DataFrame, key: str, now_us: int) -> DataFrame:
    return hgetall(fields, key, now_us).select("field")


def hlen(fields: DataFrame, now_us: int) -> DataFrame:
    return fields.where(is_live(now_us)).groupBy("key").agg(F.count(F.lit(1)).alias("fields"))


def hset(fields: DataFrame, written: DataFrame, now_us: int) -> tuple[DataFrame, DataFrame]:
    """The fields after written (pos, key, field, value[, ttl_s]), and (key, created): how many of the fields
    written were not live. Of several writes of a field the last by pos counts."""
    ttl = F.col("ttl_s") if "ttl_s" in written.columns else F.lit(0)
    last = written.withColumn("ttl_s", ttl).groupBy("key", "field").agg(F.max_by(F.struct("value", "ttl_s"), "pos").alias("w"))
    at = F.lit(now_us).cast("long")
    new = last.select("key", "field", F.col("w.value").alias("value"), F.lit("PUT").alias("op"), expiry(at, F.col("w.ttl_s")).alias("expiry_us"), at.alias("ts_us"))
    have = fields.where(is_live(now_us)).select("key", "field", F.lit(1).alias("have"))
    created = new.join(have, ["key", "field"], "left").groupBy("key").agg(F.count_if(F.col("have").isNull()).alias("created"))
    return fields.join(new.select("key", "field"), ["key", "field"], "left_anti").unionByName(new), created


def hdel(fields: DataFrame, gone: DataFrame, now_us: int) -> tuple[DataFrame, DataFrame]:
    """The fields after gone (key, field) are deleted, as tombstones, and (key, deleted): how many were live."""
    mark = gone.select("key", "field").distinct().withColumn("gone", F.lit(True))
    joined = fields.join(mark, ["key", "field"], "left").withColumn("hit", F.coalesce(F.col("gone") & is_live(now_us), F.lit(False)))
    deleted = joined.groupBy("key").agg(F.count_if("hit").alias("deleted"))
    value, op = F.when(~F.col("hit"), F.col("value")), F.when(F.col("hit"), "DEL").otherwise(F.col("op"))
    at = F.when(F.col("hit"), F.lit(now_us).cast("long")).otherwise(F.col("ts_us"))
    return joined.withColumns({"value": value, "op": op, "ts_us": at}).select(*fields.columns), deleted


def httl(fields: DataFrame, now_us: int) -> DataFrame:
    """(key, field, ttl): -2 absent or expired, -1 never expires, else whole seconds."""
    return fields.select("key", "field", ttl_remaining(now_us, absent=-2).alias("ttl"))


def hexpire(fields: DataFrame, key: str, field: str, ttl_s: int, now_us: int) -> DataFrame:
    """The rewritten field with its new expiry; no row if it is not live, which the verb answers with an error."""
    row = fields.where((F.col("key") == key) & (F.col("field") == field)).where(is_live(now_us))
    new = F.lit(now_us + ttl_s * 1_000_000 if ttl_s > 0 else None).cast("long")
    return row.withColumn("expiry_us", new).withColumn("ts_us", F.lit(now_us).cast("long"))


def pushes(events: DataFrame) -> DataFrame:
    """(key, seq, value) of lists from (version, key, op LPUSH|RPUSH, value): heads go down, tails up."""
    counts = {"left": (F.col("op") == "LPUSH").cast("long"), "right": (F.col("op") == "RPUSH").cast("long")}
    counted = running(events.select("key", "version", "op", "value"), ["key"], "version", counts)
    return counted.select("key", F.when(F.col("op") == "LPUSH", -F.col("left")).otherwise(F.col("right") - 1).alias("seq"), "value")


def _deque(pdf: pd.DataFrame) -> pd.DataFrame:
    items: dict[int, str] = {}
    head, tail = -1, 0
    for op, value in pdf.sort_values("version")[["op", "value"]].itertuples(index=False):
        if op == "LPUSH":
            items[head] = value
            head -= 1
        elif op == "RPUSH":
            items[tail] = value
            tail += 1
        elif tail - head > 1 and op == "LPOP":
            head += 1
            items.pop(head, None)
        elif tail - head > 1 and op == "RPOP":
            tail -= 1
            items.pop(tail, None)
    order = sorted(items)
    texts = {"key": [pdf["key"].iloc[0]] * len(order), "value": [items[s] for s in order]}
    return pd.DataFrame({"seq": pd.Series(order, dtype="int64")} | {k: pd.Series(v, dtype=object) for k, v in texts.items()})[["key", "seq", "value"]]


def lists(events: DataFrame) -> DataFrame:
    """(key, seq, value) after pushes and pops. Keys without pops need no sequential fold."""
    popped = events.where(F.col("op").isin("LPOP", "RPOP")).select("key").distinct()
    plain = pushes(events.join(popped, "key", "left_anti").select("version", "key", "op", "value"))
    folded = events.join(popped, "key", "left_semi").select("version", "key", "op", "value")
    return plain.unionByName(folded.groupBy("key").applyInPandas(_deque, "key string, seq long, value string"))


def lrange(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """(key, pos, value) of each list between two inclusive positions, negative ones from the end."""
    at = running(rows.select("key", "seq", "value"), ["key"], "seq", {"pos": F.lit(1)}, {"n": F.lit(1)}).withColumn("pos", F.col("pos") - 1)
    low = F.greatest(F.lit(0), F.lit(start) + (F.col("n") if start < 0 else F.lit(0)))
    high = F.lit(stop) + (F.col("n") if stop < 0 else F.lit(0))
    return at.where((F.col("pos") >= low) & (F.col("pos") <= high)).select("key", F.col("pos").cast("long").alias("pos"), "value")


def llen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("length"))


def smembers(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("key") == key).select("member").distinct().orderBy("member")


def scard(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.countDistinct("member").alias("members"))


def sismember(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, member, is_member) for every asked (key, member)."""
    have = rows.select("key", "member").distinct().withColumn("have", F.lit(True))
    return asked.join(have, ["key", "member"], "left").select("key", "member", F.coalesce("have", F.lit(False)).alias("is_member"))


def sadd(rows: DataFrame, added: DataFrame) -> DataFrame:
    """(pos, key, member, changed) for added (pos, key, member): the first add of a new member changes."""
    have = rows.select("key", "member").distinct().withColumn("have", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("key", "member").orderBy("pos"))
    joined = added.withColumn("nth", nth).join(have, ["key", "member"], "left")
    return joined.select("pos", "key", "member", (F.col("have").isNull() & (F.col("nth") == 1)).alias("changed"))


def srem(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """The set rows that stay."""
    return rows.join(removed.select("key", "member").distinct(), ["key", "member"], "left_anti")
