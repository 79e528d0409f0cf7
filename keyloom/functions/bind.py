"""Evaluating an expression once, and searching sorted arrays, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row. Without it an expression that a body names several
    times is inlined that often, and generated code grows past what the compiler takes."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def position(items: Column, x: Column, before: Callable[[Column, Column], Column] = lambda a, b: a < b) -> Column:
    """How many leading items of a sorted array come before x, by as many halvings as its size needs."""
    step = lambda at, _: F.when(
        at["low"] < at["high"],
        let(F.shiftright(at["low"] + at["high"], 1), lambda m: F.when(before(F.get(items, m), x), F.struct((m + 1).alias("low"), at["high"].alias("high")))
            .otherwise(F.struct(at["low"].alias("low"), m.alias("high")))),
    ).otherwise(at)
    start = F.struct(F.lit(0).alias("low"), F.size(items).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.log2(F.size(items) + 1)).cast("int")), start, step, lambda at: at["low"])
