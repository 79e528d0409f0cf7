"""Running counts and folds along the order of a key's rows, without gathering a key in one place.

Running counts are taken in two steps, within ranges of order values and over the ranges' totals, so a hot
key is the work of many tasks. A fold that is sequential by nature streams a key's sorted rows through one
task with only its state held."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of an order value that tell the rows of one range apart.
RANGE_BITS = 16


def running(rows: DataFrame, by: list[str], order: str, counts: dict[str, Column], totals: dict[str, Column] | None = None) -> DataFrame:
    """rows with, per name of counts, the sum of its long column up to and with each row, in order of an
    integer column; per name of totals, the sum over all rows of the key."""
    totals = totals or {}
    ranged = rows.withColumns({f"_{n}": c.cast("long") for n, c in (counts | totals).items()} | {"_range": F.shiftright(F.col(order).cast("long"), RANGE_BITS)})
    sums = ranged.groupBy(*by, "_range").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in counts | totals))
    along = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sums.select(
        *by, "_range", *(F.coalesce(F.sum(f"_{n}").over(along), F.lit(0)).alias(f"_{n}_before") for n in counts),
        *(F.sum(f"_{n}").over(whole).alias(n) for n in totals),
    )
    within = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({n: F.sum(f"_{n}").over(within) for n in counts}).join(offsets, [*by, "_range"])
    return out.withColumns({n: F.col(n) + F.col(f"_{n}_before") for n in counts}).select(*rows.columns, *counts, *totals)


def stream_fold(rows: DataFrame, by: str, order: list[str], start: Callable[[], object], step: Callable, schema: str, last: Callable | None = None) -> DataFrame:
    """step(state, row) -> (state, output tuple or None) over each key's rows in order; last(key, state) gives
    a tuple at a key's end. Output tuples follow the schema, whose first column is the key."""
    columns = rows.columns
    fields = [f.strip().rsplit(" ", 1)[0] for f in schema.split(",")]
    dealt = rows.repartition(by).sortWithinPartitions(by, *order)
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches):
        key, state, begun = None, None, False
        for batch in batches:
            out = []
            for values in zip(*(batch.column(c).to_pylist() for c in columns)):
                row = dict(zip(columns, values))
                if not begun or row[by] != key:
                    if begun and last:
                        out.append(last(key, state))
                    key, state, begun = row[by], start(), True
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield _batch(out)
        if begun and last:
            yield _batch([last(key, state)])

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(v, arrow.field(n).type) for n, v in zip(fields, zip(*out))], fields)

    return dealt.mapInArrow(run, schema)
