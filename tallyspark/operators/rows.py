"""Row repair before standardisation: cells of raw tables, validity, page stitching. Columns file, page, row_idx, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_float, strip, to_float


def no_null_cells(cells: Column) -> Column:
    return ~F.exists(cells, lambda x: x.isNull())


def clean_cell(x: Column) -> Column:
    """Trimmed, <br> as line breaks, and of several dots in a number only the last kept."""
    t = F.regexp_replace(strip(x), r"<br( ?/)?>", "\n")
    return F.when(t.rlike(r"^[0-9,.]*$"), F.regexp_replace(t, r"\.(?=.*\.)", "")).otherwise(t)


def rejoin_escaped(cells: Column) -> Column:
    """A cell that ends in a backslash takes in its right neighbour."""
    last = lambda a: F.element_at(a, -1)
    return F.aggregate(
        cells,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) > 0) & F.endswith(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.lit("\\")), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.regexp_replace(F.try_element_at(acc, F.lit(-1)), r"\\+$", ""), x)))).otherwise(F.concat(acc, F.array(x))),
    )


def trim_trailing(cells: Column, n: int) -> Column:
    """Empty cells at the right end go while there are more than n."""
    filled = F.array_max(F.transform(cells, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return F.when(F.size(cells) > n, F.slice(cells, 1, F.greatest(F.lit(n), F.coalesce(filled, F.lit(0))))).otherwise(cells)


def repaired(cells: Column, n: int) -> Column:
    """clean_cell on every cell; rejoining and trimming only where the number of cells is wrong."""
    c = F.transform(cells, clean_cell)
    return F.when(F.size(c) == n, c).otherwise(trim_trailing(rejoin_escaped(c), n))


def strip_suffix(balance: Column) -> Column:
    """'1,000.00 CR' as '1,000.00 ' where that makes it a number."""
    kept = F.regexp_replace(balance, r"[^0-9,. +\-]", "")
    return F.when(~is_float(balance) & is_float(kept), kept).otherwise(balance)


def after_header(rows: DataFrame, headers: list[str], table: list[str]) -> DataFrame:
    """Rows of a table after its first row that equals the headers; all rows where none does. Adds header_found."""
    w = Window.partitionBy(*table)
    same = F.col("cells") == F.array(*map(F.lit, headers))
    out = rows.withColumn("hdr_", F.min(F.when(same, F.col("row_idx"))).over(w))
    return out.where("hdr_ is null or row_idx > hdr_").withColumn("header_found", F.col("hdr_").isNotNull()).drop("hdr_")


def valid_row(cells: Column, n: int, credit: Column, debit: Column, balance: Column) -> Column:
    """Whether a row can be a transaction or a continuation of one."""
    number = lambda c: (strip(c) == "") | is_float(c)
    empty = lambda c: strip(c) == ""
    value = lambda c: F.coalesce(to_float(c), F.lit(0.0))
    return (
        (F.size(cells) == n)
        & F.exists(cells, lambda x: x.rlike("[A-Za-z0-9]"))
        & number(credit) & number(debit) & number(balance)
        & ~((value(credit) != 0) & (value(debit) != 0))
        & ~(empty(credit) & empty(debit) & ~empty(balance))
        & ~(~empty(credit) & ~empty(debit) & empty(balance))
    )


def stitch_pages(rows: DataFrame, continues: Column) -> DataFrame:
    """Joins a page's first row, where it is a continuation, onto the last row of the page before.

    Within a run of pages that are one continuation row only, every second merges: page i merges iff the number of
    directly preceding such pages (the first page apart) is even. ``page_index`` numbers the pages with rows from 1, before
    any is merged away. Of two parts that are joined both are trimmed.
    """
    file = Window.partitionBy("file")
    numbered = rows.withColumn("page_index", F.dense_rank().over(file.orderBy("page")) - 1)
    page = Window.partitionBy("file", "page")
    numbered = numbered.withColumn("n_", F.count("*").over(page)).withColumn("r_", F.row_number().over(page.orderBy("row_idx"))).withColumn("c_", continues)
    heads = numbered.where("r_ = 1").select("file", "page_index", F.col("cells").alias("head_"), F.col("c_").alias("hc_"), ((F.col("n_") == 1) & F.col("c_") & (F.col("page_index") >= 1)).alias("only_"))
    order = file.orderBy("page_index")
    heads = heads.withColumn("break_", F.max(F.when(~F.col("only_"), F.col("page_index"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    run = F.col("page_index") - 1 - F.coalesce(F.col("break_"), F.lit(0))
    heads = heads.withColumn("merge_", F.col("hc_") & (F.col("page_index") >= 1) & (run % 2 == 0))
    heads = heads.withColumn("next_", F.lead(F.when(F.col("merge_"), F.col("head_"))).over(order))
    out = numbered.join(heads.select("file", "page_index", "merge_", "next_"), ["file", "page_index"])
    joined = F.zip_with("cells", "next_", lambda a, b: F.when(F.coalesce(b, F.lit("")) == "", F.coalesce(a, F.lit(""))).otherwise(F.concat(strip(F.coalesce(a, F.lit(""))), F.lit(" "), strip(b))))
    out = out.withColumn("cells", F.when((F.col("r_") == F.col("n_")) & F.col("next_").isNotNull(), joined).otherwise(F.col("cells")))
    return out.where(~(F.col("merge_") & (F.col("r_") == 1))).drop("n_", "r_", "c_", "merge_", "next_").withColumn("page_index", F.col("page_index") + 1)
