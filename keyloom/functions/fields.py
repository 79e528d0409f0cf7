"""Fields of schemaless values, and comparisons between them, as Column expressions.

A value that is one JSON object has its top-level scalar fields: strings as they are, numbers in plain
decimal notation, booleans as true or false; objects, arrays and null are absent, and of repeated names
the last counts. Any other value is read as name=value pairs between commas, semicolons and blanks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.bind import let

OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "contains")
UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NAMED = r"(?i)^[+-]?(inf|infinity|nan)$"


def number(x: Column) -> Column:
    """The double a text spells by strict rules (no blanks or type suffixes), else null."""
    lower = F.lower(x)
    special = F.when(lower.contains("nan"), F.lit(float("nan"))).when(lower.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(x.rlike(_NUMBER), x.try_cast("double")).when(x.rlike(_NAMED), special)


def plain(x: Column) -> Column:
    """A double in plain decimal notation without an exponent or trailing zeros."""
    whole = F.abs(x) < F.lit(1e37)
    integral = (x % 1) == 0
    as_integer = x.try_cast("decimal(38,0)").cast("string")
    fraction = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
    text = x.cast("string")
    return F.when(whole & integral, as_integer).when(text.contains("E"), fraction).otherwise(text)


def human_bytes(n: Column, largest: str = "PiB") -> Column:
    """1536 as 1.5 KiB: the largest binary unit up to the named one that leaves a number of 1 or more, one
    decimal, cut, from KiB on."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(UNITS[: UNITS.index(largest) + 1], 1):
        tenths = (F.floor(n * 10 / 1024**power) / 10).cast("decimal(20,1)").cast("string")
        out = F.when(n >= 1024**power, F.concat(tenths, F.lit(f" {unit}"))).otherwise(out)
    return out


def human_seconds(s: Column) -> Column:
    """90061 as 1d 1h: the two largest units of a whole number of seconds."""
    d, h, m = (F.floor(s / n) for n in (86400, 3600, 60))
    pair = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(f"{x} "), b.cast("string"), F.lit(y))
    return (
        F.when(s >= 86400, pair(d, "d", h % 24, "h")).when(s >= 3600, pair(h, "h", m % 60, "m"))
        .when(s >= 60, pair(m, "m", F.floor(s) % 60, "s")).otherwise(F.concat(F.floor(s).cast("string"), F.lit("s")))
    )


def field_value(value: Column, field: str) -> Column:
    """The text of a field, or null where it is absent. Needs spark.sql.variant.allowDuplicateKeys for
    the last of repeated names to count; without it such objects have no fields."""
    path = f"$['{field}']" if "'" not in field else f'$["{field}"]'
    none = F.lit(None).cast("string")

    def from_json(part: Column) -> Column:
        kind = F.schema_of_variant(part)
        of_kind = lambda k: (
            F.when(k.isin("STRING", "BOOLEAN"), F.try_variant_get(part, "$", "string"))
            .when(k.startswith("OBJECT") | k.startswith("ARRAY"), none)
            .otherwise(let(F.try_variant_get(part, "$", "double"), plain))
        )
        return F.when(part.isNull() | F.is_variant_null(part), none).otherwise(let(kind, of_kind))

    pair = F.nullif(F.regexp_extract(value, rf"(?:^|[,; ]){re.escape(field)}=([^,; ]*)", 1), F.lit(""))
    of = lambda parsed: F.when(parsed.isNotNull(), let(F.try_variant_get(parsed, path, "variant"), from_json)).otherwise(pair)
    text = F.trim(value)
    return let(F.try_parse_json(F.when(text.startswith("{") & text.endswith("}"), text)), of)


def compare(left: Column, op: str, right: str) -> Column:
    """left op right; ordering is numeric only if both sides are numbers, else bytewise. NaN compares as
    equal in order, so >= and <= hold and > and < do not."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    literal = F.lit(right)
    if op == "=":
        return left == literal
    if op == "!=":
        return left != literal
    if op == "contains":
        return left.contains(literal)
    order = {
        ">": lambda x, y: x > y, "<": lambda x, y: x < y, ">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y,
    }[op]
    b = number(literal)
    numeric = lambda a: F.when(F.isnan(a) | F.isnan(b), F.lit(op in (">=", "<="))).otherwise(order(a, b))
    of = lambda x: let(number(x), lambda a: F.when(a.isNotNull() & b.isNotNull(), numeric(a)).otherwise(order(x, literal)))
    return let(left, of)
