"""The audit questions over ``transactions`` and the table's profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Domain settings: weekend days by 0 = Sunday, the window around the end of the fiscal year, the band below a reporting limit.
DOMAIN = {"weekend": [5, 6], "year_end": ("06-25", "07-05"), "band": (900_000, 999_999), "currency": "BDT"}


def amount() -> Column:
    return F.greatest(F.coalesce("debit", F.lit(0)), F.coalesce("credit", F.lit(0))).cast("double").alias("amount")


def direction() -> Column:
    return F.when(F.coalesce("credit", F.lit(0)) > 0, "credit").otherwise("debit").alias("direction")


ENTRY = ("bank_name", "account_no", "date", "description")


def date_range(t: DataFrame) -> DataFrame:
    return t.agg(F.min("date").alias("earliest"), F.max("date").alias("latest"))


def per_account(t: DataFrame) -> DataFrame:
    return t.groupBy("bank_name", "account_no").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bank_name", "account_no")


def largest(t: DataFrame, n: int = 5) -> DataFrame:
    return t.select("bank_name", "account_no", "date", amount(), direction()).orderBy(F.desc("amount"), "bank_name", "account_no", "date", "direction").limit(n)


def on_weekend(t: DataFrame, days: list[int] | None = None) -> DataFrame:
    return t.where((F.dayofweek("date") - 1).isin(days or DOMAIN["weekend"])).select(*ENTRY, amount(), direction())


def at_month_end(t: DataFrame) -> DataFrame:
    return t.where(F.col("date") == F.last_day("date")).select(*ENTRY, amount(), direction())


def around_year_end(t: DataFrame, window: tuple[str, str] | None = None) -> DataFrame:
    return t.where(F.date_format("date", "MM-dd").between(*(window or DOMAIN["year_end"]))).select(*ENTRY, amount(), direction()).orderBy("date", "bank_name", "account_no")


def in_and_out(t: DataFrame, days: int = 1) -> DataFrame:
    """A credit followed within ``days`` by an equal debit of the account: an equi-join with a range on the date."""
    a = t.where("credit > 0").select("bank_name", "account_no", F.col("credit").alias("amount"), "date")
    b = t.where("debit > 0").select("bank_name", "account_no", F.col("debit").alias("amount"), F.col("date").alias("out_"))
    hit = a.join(b, ["bank_name", "account_no", "amount"]).where(F.col("out_").between(F.col("date"), F.date_add("date", days)))
    return hit.select("bank_name", "account_no", F.col("amount").cast("double").alias("amount"), "date").orderBy(F.desc("amount"), "account_no", "date")


def backdated(t: DataFrame) -> DataFrame:
    days = F.datediff("date", "value_date").alias("days_backdated")
    return t.where("value_date is not null and value_date < date").select("bank_name", "account_no", "date", "value_date", days, amount(), direction()).orderBy(F.desc("days_backdated"))


def structuring(t: DataFrame, word: str = "cash deposit", band: tuple[int, int] | None = None) -> DataFrame:
    hit = t.where(F.col("credit").between(*(band or DOMAIN["band"])) & F.col("search_text").contains(word))
    return hit.select(*ENTRY, F.col("credit").cast("double").alias("amount")).orderBy(F.desc("amount"))


def duplicate_debits(t: DataFrame) -> DataFrame:
    g = t.where("debit > 0").groupBy(*ENTRY, "debit").agg(F.count("*").alias("occurrences")).where("occurrences > 1")
    return g.select(*ENTRY, F.col("debit").cast("double").alias("amount"), "occurrences").orderBy(F.desc("occurrences"), F.desc("amount"))


def real_text(c: Column, sentinels: list[str]) -> Column:
    """Neither null nor one of the words that stand for it."""
    return c.isNotNull() & ~F.trim(c).isin(sentinels)


def whole_word(c: Column, word: str) -> Column:
    """Whether the text holds the word with no letter, digit or underscore beside it, in any script."""
    return c.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])")


def profile(t: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_null, n_distinct, min_value, max_value): exact; every column counts its distinct values on its own,
    so no row is expanded once for each column. Least and greatest only for numbers and dates."""
    out = None
    for c in columns:
        ranged = t.schema[c].dataType.typeName() not in ("string", "boolean")
        end = lambda f, c=c, ranged=ranged: f(F.col(c)).cast("string") if ranged else F.lit(None).cast("string")
        one = t.agg(F.count(F.when(F.col(c).isNull(), 1)).alias("n_null"), F.countDistinct(c).alias("n_distinct"), end(F.min).alias("min_value"), end(F.max).alias("max_value")).select(F.lit(c).alias("column_name"), "*")
        out = one if out is None else out.unionAll(one)
    return out


def few_values(t: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """(column_name, value_list): the values of the columns with fewer than ``most`` of them, '(Empty)' for none."""
    out = None
    for c in columns:
        some = t.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct().limit(most)
        one = some.agg(F.array_sort(F.collect_list("v")).alias("v")).where(F.size("v") < most).select(F.lit(c).alias("column_name"), F.when(F.size("v") == 0, "(Empty)").otherwise(F.array_join("v", ", ")).alias("value_list"))
        out = one if out is None else out.unionAll(one)
    return out
