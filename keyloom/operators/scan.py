"""Point, multi, range, cursor and prefix reads over live rows. A limit of zero or less is no limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.model import keys_of

#: Key lists of at most this many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_KEYS = 100_000


def limited(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n) if n > 0 else df


def get(live: DataFrame, ns: str, key: str) -> DataFrame:
    return live.where((F.col("ns") == ns) & (F.col("key") == key)).select("ns", "key", "value")


def mget(live: DataFrame, keys: DataFrame, n_keys: int | None = None) -> DataFrame:
    """(pos, [ns,] key, found, value) for every requested (pos, [ns,] key), duplicates kept, in request order.

    A list known to be short is broadcast and read off in one pass of the keyspace; then it is joined
    back to the requests. An unknown or long list is a shuffled left join."""
    by = keys_of(keys, live)
    values = live.select(*by, "value")
    if n_keys is not None and n_keys <= BROADCAST_KEYS:
        values = values.join(F.broadcast(keys.select(*by).distinct()), by, "left_semi")
    joined = keys.join(values.select(*by, F.struct("value").alias("hit")), by, "left")
    return joined.select("pos", *by, F.col("hit").isNotNull().alias("found"), F.col("hit.value").alias("value")).orderBy("pos")


def between(key: Column, start: str, end: str) -> Column:
    """start <= key < end; the empty string leaves a side open."""
    out = F.lit(True)
    if start:
        out = out & (key >= start)
    if end:
        out = out & (key < end)
    return out


def range_scan(live: DataFrame, start: str = "", end: str = "", limit: int = 0, reverse: bool = False, ns: str | None = None) -> DataFrame:
    rows = live if ns is None else live.where(F.col("ns") == ns)
    rows = rows.where(between(F.col("key"), start, end)).select("key", "value")
    return limited(rows.orderBy(F.col("key").desc() if reverse else F.col("key").asc()), limit)


def scan_cursor(live: DataFrame, cursor: str, limit: int, ns: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of keys after the cursor, and its next cursor: that of the last key of a full page, else "".

    Within a namespace a cursor is a key. Over all of them it is cursor_of(ns, key), and pages are in
    order of namespace and key, so equal keys of two namespaces are two places."""
    if ns is not None:
        rows, order = live.where((F.col("ns") == ns) & (F.col("key") > cursor)), ["key"]
    else:
        rows, order = live, ["ns", "key"]
        if cursor:
            at_ns, at_key = (unescape_text(x) for x in cursor.split("/", 1))
            rows = live.where((F.col("ns") > at_ns) | (F.col("ns") == at_ns) & (F.col("key") > at_key))
    page = limited(rows.select("ns", "key", "value").orderBy(*order), limit)
    full = F.lit(limit > 0) & (F.count(F.lit(1)) == limit)
    last = F.max("key") if ns is not None else F.max_by(cursor_of(F.col("ns"), F.col("key")), F.struct("ns", "key"))
    return page, page.agg(F.when(full, last).otherwise("").alias("next_cursor"))


def escape(value: Column) -> Column:
    """A value as shown within a path of several."""
    return F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def unescape_text(text: str) -> str:
    return text.replace("%2F", "/").replace("%25", "%")


def cursor_of(ns: Column, key: Column) -> Column:
    return F.concat(escape(ns), F.lit("/"), escape(key))


def ns_scan(live: DataFrame, ns: str, prefix: str = "", limit: int = 0) -> DataFrame:
    rows = live.where((F.col("ns") == ns) & F.col("key").startswith(prefix)).select("key", "value")
    return limited(rows.orderBy("key"), limit)


def keys(live: DataFrame, prefix: str = "") -> DataFrame:
    return live.where(F.col("key").startswith(prefix)).select("key")


def namespaces(live: DataFrame) -> DataFrame:
    return live.where(F.col("ns").isNotNull()).groupBy("ns").agg(F.count(F.lit(1)).alias("keys"))


def drop_namespace(live: DataFrame, ns: str, ts_us: int, version: int) -> DataFrame:
    """Tombstones for every live key of a namespace; their count is the verb's answer."""
    return live.where((F.col("ns") == ns) & (F.col("key") != "")).select(
        F.lit(version).cast("long").alias("version"), F.lit(ts_us).cast("long").alias("ts_us"), F.lit("DEL").alias("op"), "ns", "key",
        F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("expiry_us"), "schema_version",
    )
