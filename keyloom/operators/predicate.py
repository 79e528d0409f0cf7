"""Field-predicate queries over a namespace, and stored predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.fields import compare, field_value
from keyloom.model import keys_of
from keyloom.operators.scan import limited

#: name -> condition on (key, value); registering a name again replaces it.
_PREDICATES: dict[str, Callable[[Column, Column], Column]] = {}


def register(name: str, condition: Callable[[Column, Column], Column]) -> None:
    _PREDICATES[name] = condition


def stored(name: str) -> Callable[[Column, Column], Column]:
    if name not in _PREDICATES:
        raise KeyError(f"no predicate {name!r}")
    return _PREDICATES[name]


def query_ns(live: DataFrame, ns: str, field: str, op: str, operand: str, limit: int = 0) -> DataFrame:
    """(key, value) of a namespace's rows whose field compares so; rows without the field never do."""
    rows = live.where(F.col("ns") == ns).where(compare(field_value(F.col("value"), field), op, operand))
    return limited(rows.select("key", "value").orderBy("key"), limit)


def predicate_scan(live: DataFrame, name: str, prefix: str = "", limit: int = 0) -> DataFrame:
    rows = live.where(F.col("key").startswith(prefix) & stored(name)(F.col("key"), F.col("value")))
    return limited(rows.select("key").orderBy("key"), limit)


def predicate_filter(live: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """(pos, [ns,] key, matches) for every requested key in order; a missing key does not match."""
    by = keys_of(keys, live)
    hit = live.select(*by, stored(name)(F.col("key"), F.col("value")).alias("ok"))
    joined = keys.join(hit, by, "left")
    return joined.select("pos", *by, F.coalesce("ok", F.lit(False)).alias("matches")).orderBy("pos")
