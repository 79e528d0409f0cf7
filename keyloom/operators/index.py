"""Secondary indexes as derived rows (rule, field_value, ns, key), and their catalog."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.fields import compare, field_value
from keyloom.operators.scan import escape, limited  # noqa: F401  (index keys are shown escaped)


class Catalog:
    """Named field indexes. A name holds one field; creating the same again changes nothing."""

    def __init__(self):
        self.fields: dict[str, str] = {}
        self.rules: dict[str, Callable[[Column], Column]] = {}

    def create(self, name: str, field: str) -> None:
        if not name or re.search(r"[/ \x00]", name):
            raise ValueError(f"index name {name!r} has a slash, a blank or a NUL, or is empty")
        if self.fields.get(name, field) != field or name in self.rules:
            raise ValueError(f"index {name!r} is on another field")
        self.fields[name] = field

    def register(self, name: str, extract: Callable[[Column], Column]) -> None:
        """A rule of any number of values per row: extract gives an array<string> of a value."""
        self.rules[name] = extract

    def drop(self, name: str) -> None:
        self.fields.pop(name, None)
        self.rules.pop(name, None)

    def list(self) -> list[tuple[str, str]]:
        return sorted(self.fields.items())

    def entries(self, live: DataFrame) -> DataFrame:
        """The index rows of all rules over live rows, in one pass of the table."""
        value = F.col("value")
        pairs = [F.struct(F.lit(n).alias("rule"), field_value(value, f).alias("field_value")) for n, f in self.fields.items()]
        found = F.array(*pairs) if pairs else F.array().cast("array<struct<rule:string,field_value:string>>")
        for n, extract in self.rules.items():
            found = F.concat(found, F.transform(extract(value), _entry(n)))
        rows = live.select("ns", "key", F.explode(found).alias("e")).where("e.field_value is not null")
        return rows.select("e.rule", "e.field_value", "ns", "key").distinct()


def _entry(rule: str):
    return lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("field_value"))


def lookup(index: DataFrame, rule: str, value: str, limit: int = 0) -> DataFrame:
    rows = index.where((F.col("rule") == rule) & (F.col("field_value") == value))
    return limited(rows.select("ns", "key").orderBy("ns", "key"), limit)


def query_by_index(live: DataFrame, index: DataFrame, rule: str, field: str, ns: str, value: str, limit: int = 0) -> DataFrame:
    """(key, value) through the index, verified against the rows: an index may lag behind them."""
    hits = index.where((F.col("rule") == rule) & (F.col("field_value") == value) & (F.col("ns") == ns)).select("ns", "key")
    rows = live.where(F.col("ns") == ns).join(hits, ["ns", "key"], "left_semi")
    rows = rows.where(compare(field_value(F.col("value"), field), "=", value))
    return limited(rows.select("key", "value").orderBy("key"), limit)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, rule, field_value, ns, key): entries to add and to remove between two index states."""
    cols = ["rule", "field_value", "ns", "key"]
    both = old.select(*cols, F.lit(-1).alias("d")).unionByName(new.select(*cols, F.lit(1).alias("d")))
    net = both.groupBy(*cols).agg(F.sum("d").alias("d")).where("d != 0")
    return net.select(F.when(F.col("d") > 0, "add").otherwise("remove").alias("change"), *cols)


def kept(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rule, field_value, ns, key): the entries that an update leaves as they are."""
    cols = ["rule", "field_value", "ns", "key"]
    return old.select(*cols).intersect(new.select(*cols))


def cardinality(index: DataFrame) -> DataFrame:
    return index.groupBy("rule").agg(F.countDistinct("field_value").alias("values"), F.count(F.lit(1)).alias("entries"))
