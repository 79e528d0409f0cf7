"""Shards, hash rings and replica choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from keyloom.functions.bind import position

#: Low 13 bits of the 64-bit FNV-1a offset and prime, which are closed under its steps.
SHARDS, _OFFSET, _PRIME = 8192, 0x2325, 0x1B3


def shard_id(key: Column) -> Column:
    """FNV-1a of the key's bytes, low 13 bits."""
    digits = F.hex(key.cast("binary"))
    at = F.sequence(F.lit(1), F.octet_length(key))
    step = lambda h, i: ((h.bitwiseXOR(F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))) * _PRIME).bitwiseAND(SHARDS - 1)
    return F.when(F.octet_length(key) == 0, _OFFSET & (SHARDS - 1)).otherwise(F.aggregate(at, F.lit(_OFFSET & (SHARDS - 1)), step))


def disk(shard: Column, disks: int) -> Column:
    return shard % disks


def _byte_columns(data: pd.Series):
    """(rows, bytes) for each place: the rows that have a byte there, and their bytes as an array."""
    blobs = [b"" if x is None else x.encode() if isinstance(x, str) else bytes(x) for x in data]
    size = np.array([len(b) for b in blobs], np.int64)
    raw, start = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum(size) - size
    rows = np.argsort(-size, kind="stable")
    ends = -size[rows]
    for i in range(int(size.max(initial=0))):
        mine = rows[: np.searchsorted(ends, -i)]  # sizes above i
        yield mine, raw[start[mine] + i]


#: Offset and prime of 64-bit FNV-1a, and the multipliers of the finaliser.
_FNV_OFFSET, _FNV_PRIME, _MIX_1, _MIX_2 = 0xCBF29CE484222325, 0x100000001B3, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


@F.pandas_udf(LongType())
def _ring_bits(key: pd.Series) -> pd.Series:
    h = np.full(len(key), _FNV_OFFSET, np.uint64)
    for rows, byte in _byte_columns(key):
        h[rows] = (h[rows] ^ byte) * np.uint64(_FNV_PRIME)
    for factor in (_MIX_1, _MIX_2):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return pd.Series((h ^ (h >> np.uint64(33))).view(np.int64))


def ring_hash(key) -> Column:
    """FNV-1a with a 64-bit finaliser, as an unsigned number."""
    bits = _ring_bits(key).cast("decimal(20,0)")
    return F.when(bits < 0, bits + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(bits).cast("decimal(20,0)")


#: Ring points at most, as a power of two: the ring travels as one sorted array.
RING_BITS = 20


def owner(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """keys (key, h) with the node of the first ring point at or after h, around the end to the first.

    ring (h, node) has some points per node; it travels as one sorted array that each key searches by
    halving. More than 2 ** RING_BITS points are an error."""
    points = ring.agg(F.array_sort(F.collect_list(F.struct("h", "node"))).alias("ring"))
    many = F.raise_error(F.lit("too many ring points")).cast(points.schema["ring"].dataType)
    points = points.select(F.when(F.size("ring") > 2**RING_BITS, many).otherwise(F.col("ring")).alias("ring"), F.lit(1).alias("one"))
    joined = keys.select("key", F.col("h").alias("at"), F.lit(1).alias("one")).join(F.broadcast(points), "one")
    after = position(F.col("ring"), F.col("at"), lambda p, at: p["h"] < at)
    return joined.select("key", F.get("ring", (after % F.size("ring")).cast("int"))["node"].alias("node"))


def misplaced(keys: DataFrame, ring: DataFrame, node: str) -> DataFrame:
    """Keys that another node owns: what a rebalance ships."""
    return owner(keys, ring).where(F.col("node") != node)


def replicas(nodes: list[tuple[str, str]], first: int, n: int) -> list[str]:
    """n nodes of (node, rack) from position first: one of each new rack in turn, then any others."""
    ring = [nodes[(first + i) % len(nodes)] for i in range(len(nodes))]
    chosen: list[str] = []
    racks: set[str] = set()
    for node, rack in ring:
        if rack not in racks and len(chosen) < n:
            racks.add(rack)
            chosen.append(node)
    return chosen + [node for node, _ in ring if node not in chosen][: n - len(chosen)]


def replica_map(shards: DataFrame, nodes: list[tuple[str, str]], n: int) -> DataFrame:
    """(shard, replicas) of shards (shard): primaries go round the nodes, and the others of each shard are
    picked rack by rack from its primary on. There are as many picks as nodes; shards look theirs up."""
    picks = [replicas(nodes, i, n) for i in range(len(nodes))]
    literal = F.array(*(F.array(*map(F.lit, p)) for p in picks))
    return shards.select("shard", F.get(literal, F.col("shard").cast("int") % len(nodes)).alias("replicas"))


@F.pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32 with the Castagnoli polynomial."""
    c = np.full(len(data), 0xFFFFFFFF, np.uint32)
    for rows, byte in _byte_columns(data):
        c[rows] = _CRC[(c[rows] ^ byte) & np.uint32(0xFF)] ^ (c[rows] >> np.uint32(8))
    return pd.Series((c ^ np.uint32(0xFFFFFFFF)).astype(np.int64))


def _crc_table() -> np.ndarray:
    """Fixed value: the polynomial, bits reversed."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table


_CRC = _crc_table()


def cold_handle(key: Column, value: Column) -> Column:
    """The handle under which a cold tier keeps a value: eight hex digits of the checksum of key and value."""
    return F.lower(F.lpad(F.hex(crc32c(F.concat(key.cast("binary"), value.cast("binary")))), 8, "0"))


#: Bloom filter: bits of a shard's filter per expected key, and hashes per key.
BLOOM_BITS, BLOOM_HASHES = 10, 7


def _bloom_places(key: Column, bits: int) -> Column:
    """A key's places, by double hashing."""
    h1, h2 = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits - 1)) + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(BLOOM_HASHES - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(bits))))


def bloom_build(keys: DataFrame, expected: int, shards: int = 64) -> DataFrame:
    """(shard, bit) rows of the set bits of Bloom filters for keys (key) dealt to shards, each with room for
    its part of the expected keys. Bits are rows, so a filter of any size is never in one place."""
    bits = max(64, -(-expected * BLOOM_BITS // shards))
    shard = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(shards))
    return keys.select(shard.alias("shard"), F.explode(_bloom_places(F.col("key"), bits)).alias("bit")).distinct()


def bloom_probe(keys: DataFrame, filters: DataFrame, expected: int, shards: int = 64) -> DataFrame:
    """(key, maybe) of the distinct keys: no key that was built in is missed; about one in a hundred others passes."""
    bits = max(64, -(-expected * BLOOM_BITS // shards))
    asked = keys.select("key").distinct().withColumn("shard", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(shards)))
    places = asked.select("key", "shard", F.explode(_bloom_places(F.col("key"), bits)).alias("bit"))
    hit = places.join(filters.withColumn("set", F.lit(True)), ["shard", "bit"], "left")
    return hit.groupBy("key").agg(F.bool_and(F.col("set").isNotNull()).alias("maybe"))
