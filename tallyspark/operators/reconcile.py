"""Column typing and running-balance reconciliation, as windows over a file and one chain of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_float, parse_date, to_float


def close(a: Column, b: Column) -> Column:
    """Equal up to 1e-9 of the larger; a zero equals only a zero."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))


def comma_to_dot(rows: DataFrame, column: str, by: str = "file") -> DataFrame:
    """Where all dotted values of a file's column have L decimals, a last comma L digits before the end is a dot."""
    c, w = F.col(column), Window.partitionBy(by)
    decimals = F.when(c.contains("."), F.length(F.substring_index(c, ".", -1)))
    lens = F.collect_set(decimals).over(w)
    out = rows.withColumn("len_", F.when(F.size(lens) == 1, lens[0]))
    after = F.length(F.substring_index(c, ",", -1))
    fixed = F.concat(F.expr(f"left(`{column}`, length(`{column}`) - len_ - 1)"), F.lit("."), F.substring_index(c, ",", -1))
    hit = F.col("len_").isNotNull() & ~c.contains(".") & c.contains(",") & (after == F.col("len_"))
    return out.withColumn(column, F.when(hit, fixed).otherwise(c)).drop("len_")


def amounts(rows: DataFrame, columns: list[str], debit: str | None = None, by: str = "file") -> DataFrame:
    """Amount columns as doubles, blanks as 0.0; a debit column of a file with several values, all negative, is turned."""
    for c in columns:
        rows = rows.withColumn(c, F.when(F.trim(F.col(c)) == "", 0.0).otherwise(to_float(F.col(c))))
    if debit:
        w = Window.partitionBy(by)
        d = F.col(debit)
        turn = (F.count(F.when(d != 0, 1)).over(w) > 1) & (F.count(F.when(d > 0, 1)).over(w) == 0)
        rows = rows.withColumn("turn_", turn).withColumn(debit, F.when(F.col("turn_"), F.abs(d)).otherwise(d)).drop("turn_")
    return rows


def digits(v: Column) -> Column:
    """The digits of |v| as Python prints it, up to six decimals, without the point."""
    text = F.regexp_replace(F.abs(v).cast("decimal(38,6)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    return F.replace(text, F.lit("."), F.lit(""))


def variations(v: Column) -> Column:
    """v and every number of its sign that its digits make with the point elsewhere, in rising order; 0 alone for 0."""
    d, sign = digits(v), F.when(v < 0, -1.0).otherwise(1.0)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d) - 1, F.lit(1))), lambda i: F.concat(F.substring(d, F.lit(1), i), F.lit("."), F.substring(d, i + 1, F.lit(99))).cast("double") * sign)
    return F.array_sort(F.array_distinct(F.concat(F.array(v), F.when((F.length(d) > 1) & (v != 0), cut).otherwise(F.array().cast("array<double>")))))


def has_date(cells: Column) -> Column:
    """Whether any cell is a date with a year and not a number: what ``reconcile`` takes as ``dated``. False for null or no cells."""
    return F.coalesce(F.exists(cells, lambda x: F.coalesce(~is_float(x) & parse_date(x).isNotNull(), F.lit(False))), F.lit(False))


def reconcile(rows: DataFrame, dated: Column | None = None) -> DataFrame:
    """Repairs amounts by the running balance. Needs file, row_idx, credit, debit, balance, opening_balance (doubles).

    Rows without an amount or with both leave first and don't move the balance. Each row is checked against the balance printed
    before it, repaired or not, so the check needs no loop. repair_kind: ok, sign, shift, swap, unreconciled; rows of
    kind opening (the opening balance as a first row) and undated (with ``dated`` given and false) go.
    passed_validation is false for unreconciled.
    """
    c, d, b = F.col("credit"), F.col("debit"), F.col("balance")
    left = rows.where(~((c == 0) & (d == 0)) & ~((c > 0) & (d > 0)))
    w = Window.partitionBy("file").orderBy("row_idx")
    left = left.withColumn("before_", F.coalesce(F.lag("balance").over(w), F.col("opening_balance")))
    p = F.col("before_")
    triple = lambda x, y, z: F.struct(x.alias("c"), y.alias("d"), z.alias("b"))
    fits = lambda t: close(t["b"], p + t["c"] - t["d"])
    ok = close(b, p + c - d)
    sign = F.lit(None)
    for i in range(7, 0, -1):
        pick = lambda v, bit, i=i: v if i & bit else F.when(v <= 0, -v).otherwise(v)
        t = triple(pick(c, 1), pick(d, 2), pick(b, 4))
        sign = F.when(fits(t), t).otherwise(sign)
    sign = F.when((c < 0) | (d < 0) | (b < 0), sign)
    tries = F.flatten(F.transform(variations(c), lambda x: F.flatten(F.transform(variations(d), lambda y: F.transform(variations(b), lambda z: triple(x, y, z))))))
    left = left.withColumn("ok_", ok).withColumn("sign_", F.when(~F.col("ok_"), sign))
    # the product of variations is only built for rows that need it
    left = left.withColumn("shift_", F.when(~F.col("ok_") & F.col("sign_").isNull(), F.array_min(F.filter(tries, fits))))
    swap = close(b, p + d - c)
    first = F.col("row_idx") == 0
    kind = (
        F.when(F.col("ok_"), "ok").when(F.col("sign_").isNotNull(), "sign").when(F.col("shift_").isNotNull(), "shift").when(swap, "swap")
        .when(first & close(b, F.col("opening_balance")), "opening").when(F.lit(False) if dated is None else ~dated, "undated").otherwise("unreconciled")
    )
    left = left.withColumn("repair_kind", kind)
    fixed = F.coalesce(F.when(F.col("repair_kind") == "sign", F.col("sign_")), F.when(F.col("repair_kind") == "shift", F.col("shift_")), F.when(F.col("repair_kind") == "swap", triple(d, c, b)), triple(c, d, b))
    out = left.withColumn("t_", fixed).withColumn("passed_validation", F.col("repair_kind") != "unreconciled")
    out = out.withColumns({"credit": F.col("t_.c"), "debit": F.col("t_.d"), "balance": F.col("t_.b")})
    return out.where("repair_kind not in ('opening', 'undated')").drop("before_", "ok_", "sign_", "shift_", "t_")


def standardised(rows: DataFrame) -> DataFrame:
    """Rows with a date, negative debits turned, and ``seq``: their place in the file by date, time and row."""
    w = Window.partitionBy("file").orderBy(F.asc_nulls_first("date"), F.asc_nulls_first("time"), "row_idx")
    return rows.withColumn("seq", F.row_number().over(w)).where("date is not null").withColumn("debit", F.abs("debit"))


def blank_as_null(c: Column) -> Column:
    """'' and '-' count as missing."""
    return F.when(~F.trim(c).isin("", "-"), c)
