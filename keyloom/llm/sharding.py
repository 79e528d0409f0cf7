"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash within their stratum, ranked, and ordered over all strata by
fractional rank (2 * rank - 1) / (2 * stratum size). Any run of that order holds every stratum in
proportion, so cutting it into equal runs gives shards that match the mixture.

Ranks are exact without a global sort or a window over a whole stratum: the first hash digits deal a
stratum into buckets, bucket counts give offsets, and only rows of one bucket meet in a window. The
second ranking deals rows by the leading part of the fraction, in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of each ranking: 16 ** 3, the values of three hash digits.
BUCKETS = 4096


def interleave(
    rows: DataFrame, n_shards: int = 16, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source"
) -> DataFrame:
    """Deal rows into n_shards shards of one law: counts at most one apart, each with the mixture.

    Returns (id, stratum, size, text_crc32, stratum_rows, stratum_rank, position, shard, slot). Texts
    are not shuffled, only their size and checksum. A null text has size 1 and checksum 0, a null
    stratum is a stratum of its own, null ids come first among equal hashes, and equal rows take
    places next to each other; an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = rows.select(
        F.col(id_col).alias("id"),
        F.col(stratum_col).alias("stratum"),
        F.when(F.col(stratum_col).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(stratum_col).cast("string"))).alias("s"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("h"),
    ).withColumn("b", F.substring("h", 1, 3))
    order = [F.col(c).asc_nulls_first() for c in ("h", "id", "text_crc32", "size")]

    counts = base.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    by_stratum = Window.partitionBy("s")
    offsets = counts.select(
        "s",
        "b",
        (F.sum("n").over(by_stratum.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(by_stratum).alias("stratum_rows"),
    )
    ranked = (
        base.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy(*order)).cast("long"))
        .join(offsets, ["s", "b"])
        .withColumn("stratum_rank", F.col("r") + F.col("before"))
        .withColumn("k", F.expr(f"({BUCKETS} * (2 * stratum_rank - 1)) div (2 * stratum_rows)"))
    )

    # Where each bucket starts: BUCKETS counts at most, whatever the number of strata.
    one = Window.partitionBy(F.lit(1))
    starts = ranked.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(
        "k",
        F.coalesce(F.sum("n").over(one.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("n").over(one).alias("total"),
    )
    fraction = (2 * F.col("stratum_rank") - 1) / (2 * F.col("stratum_rows"))
    local = F.row_number().over(Window.partitionBy("k").orderBy(fraction, F.col("s"), *order))
    placed = (
        ranked.withColumn("at", local.cast("long"))
        .join(F.broadcast(starts), "k")  # BUCKETS rows at any input size
        .withColumn("position", F.col("start") + F.col("at") - 1)
        .withColumn("shard", F.expr(f"(position * {n_shards}) div total"))
    )
    return placed.select(
        "id", "stratum", "size", "text_crc32", "stratum_rows", "stratum_rank", "position",
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"position - (shard * total + {n_shards - 1}) div {n_shards}").alias("slot"),
    )
