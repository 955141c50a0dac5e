"""From a table with any headers to the canonical columns: matched headers, each value through its column's parser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import headers, scalars
from ..sources.ledger import INTERNAL, SCHEMA

#: Columns that a statement's table can give.
COLUMNS = [f for f in SCHEMA if f.name not in INTERNAL]
PARSERS: dict[type, Callable[[Column], Column]] = {T.DateType: scalars.parse_date, T.DecimalType: scalars.parse_decimal, T.IntegerType: scalars.parse_integer}


def parsed(name: str, c: Column) -> Column:
    """A raw value as the column ``name`` holds it; null for '', '-' and what can't be read."""
    kind = SCHEMA[name].dataType
    t = scalars.strip(c.cast("string"))
    t = F.when(~t.isin("", "-"), t)
    if name == "time":
        return scalars.parse_time(t)
    return PARSERS.get(type(kind), lambda x: x)(t).try_cast(kind)


def standardise(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All canonical columns, and those of ``keep``, from a table of raw texts.

    A header like "A / B" gives either column, "A and B" both; "debit / credit" and headers that match nothing are left out. Where
    two headers match one column the later value that can be read counts. A column that no header matches is null.
    """
    found: dict[str, list[Column]] = {f.name: [] for f in COLUMNS}
    for raw in df.columns:
        names = () if raw in keep else headers.resolve(raw) or ()
        c = F.col(f"`{raw}`").cast("string")
        if len(names) == 2:
            if set(names) == {"debit", "credit"}:
                continue
            values = (headers.split_union if "/" in raw else headers.split_composite)(c, *names)
        else:
            values = (c,)
        for name, v in zip(names, values, strict=True):
            if name in found:
                found[name].append(parsed(name, v))
    one = lambda f: F.coalesce(*reversed(found[f.name])) if found[f.name] else F.lit(None).cast(f.dataType)
    return df.select(*(F.col(f"`{c}`") for c in keep), *(one(f).alias(f.name) for f in COLUMNS if f.name not in keep))
