"""The ``transactions`` table: its schema, the view derived from the star tables, and its sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import search_text

_text = ["trans_type", "cheque", "description"]
SCHEMA = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in _text]
    + [T.StructField("debit", T.DecimalType(15, 2)), T.StructField("credit", T.DecimalType(15, 2)), T.StructField("bank_name", T.StringType()), T.StructField("page", T.IntegerType())]
    + [T.StructField("account_no", T.StringType()), T.StructField("passed_validation", T.BooleanType()), T.StructField("serial", T.IntegerType()), T.StructField("time", T.StringType()), T.StructField("value_date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in ("reference", "batch_number", "tracer_number", "instrument_number", "trans_code", "branch_code", "branch_name", "search_text")]
)
#: Columns that questions are never answered with.
INTERNAL = ["id", "file_name", "page", "passed_validation", "search_text"]
#: Words that stand for a missing value in text columns.
SENTINELS = ["None", "nan", "null", ""]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger over lineitem, orders, supplier and nation; the dimensions' joins are left to the optimizer."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    bank = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = line.join(bank, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    amount = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_extendedprice") * 10).otherwise(F.col("l_quantity") * 1000)
    side = lambda s: F.when(F.col("l_linestatus") == s, amount).otherwise(0.0).cast("decimal(15,2)")
    out = rows.select(
        F.col("n_name").alias("bank_name"),
        F.col("l_suppkey").cast("string").alias("account_no"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("o_orderdate").cast("date").alias("value_date"),
        F.when(F.col("l_returnflag") == "R", "CASH DEPOSIT").when(F.col("l_returnflag") == "A", "CHEQUE CLEARING").otherwise("Transfer").alias("description"),
        side("O").alias("credit"),
        side("F").alias("debit"),
    )
    return out.withColumn("search_text", search_text(description=F.col("description"), bank_name=F.col("bank_name"), account_no=F.col("account_no")))


#: The same for DuckDB; a query's SQL goes on after it.
LEDGER_SQL = """
WITH transactions AS (
    SELECT *, lower(strip_accents(description || '  ' || bank_name || '  ' || account_no || '       ')) AS search_text FROM (
        SELECT n_name AS bank_name, CAST(l_suppkey AS VARCHAR) AS account_no, CAST(l_shipdate AS DATE) AS date, CAST(o_orderdate AS DATE) AS value_date,
            CASE l_returnflag WHEN 'R' THEN 'CASH DEPOSIT' WHEN 'A' THEN 'CHEQUE CLEARING' ELSE 'Transfer' END AS description,
            CAST(CASE WHEN l_linestatus = 'O' THEN amount ELSE 0 END AS DECIMAL(15,2)) AS credit,
            CAST(CASE WHEN l_linestatus = 'F' THEN amount ELSE 0 END AS DECIMAL(15,2)) AS debit
        FROM (SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice * 10 ELSE l_quantity * 1000 END AS amount FROM lineitem)
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey
    )
)
"""


def create_table(spark: SparkSession, name: str = "transactions") -> None:
    """The table of SCHEMA, if it doesn't exist."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in SCHEMA)}) USING parquet")


def not_yet_ingested(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of files of which the table holds no row yet."""
    return new.join(known.select("file_name").distinct(), "file_name", "left_anti")


def canonical(df: DataFrame, sentinel: str | None = None) -> DataFrame:
    """``df`` with all columns of SCHEMA: missing ones null, an id from file, page and serial, the search text.

    With ``sentinel`` missing texts of columns that ``df`` has become that word.
    """
    have = {c: F.col(c) for c in df.columns}
    if sentinel is not None:
        have |= {f.name: F.coalesce(have[f.name], F.lit(sentinel)) for f in SCHEMA if f.name in have and isinstance(f.dataType, T.StringType)}
    have.setdefault("id", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), 256))
    have["search_text"] = search_text(**{c: x for c, x in have.items() if c not in ("id", "search_text")})
    return df.select(*(have[f.name].cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA))


def append(df: DataFrame, path: str, sentinel: str | None = None) -> None:
    """Appends rows of new files to the Parquet table at ``path``; an empty batch writes nothing."""
    rows = canonical(df, sentinel)
    if not rows.isEmpty():
        rows.write.mode("append").parquet(path)


def combine(frames: list[DataFrame], names: list[str]) -> DataFrame:
    """Union by name of several tables with stripped headers, missing columns null, and a column "File Name"."""
    if not frames:
        raise ValueError("nothing to combine")
    out = None
    for df, name in zip(frames, names, strict=True):
        df = df.toDF(*(c.strip() for c in df.columns)).withColumn("File Name", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the PDFs of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")


def ocr_rows(spark: SparkSession, path: str) -> DataFrame:
    """(table_idx, row_idx, cells) of the tables in a layout service's JSON: pages[0].items of type table."""
    schema = "pages array<struct<items:array<struct<type:string,rows:array<array<string>>>>>>"
    items = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(F.col("pages")[0]["items"]).alias("i")).where("i.type = 'table'")
    return items.select(F.monotonically_increasing_id().alias("table_idx"), F.posexplode("i.rows").alias("row_idx", "cells"))


def route_pages(pages: DataFrame) -> DataFrame:
    """Adds tier: 2 where the grid extraction gave neither rows nor a header. Columns n_rows, header_found."""
    return pages.withColumn("tier", F.when((F.coalesce(F.col("n_rows"), F.lit(0)) == 0) & ~F.coalesce(F.col("header_found"), F.lit(False)), 2).otherwise(1))


def scanned(pages: DataFrame) -> DataFrame:
    """Adds scanned: an image covers the whole page, or the page has no text. Columns image_ratio, text."""
    close = F.abs(F.col("image_ratio") - 1) <= 1e-9 * F.greatest(F.abs(F.col("image_ratio")), F.lit(1.0))
    return pages.withColumn("scanned", F.coalesce(close, F.lit(False)) | (F.trim(F.coalesce(F.col("text"), F.lit(""))) == ""))


def write_corpus(chunks: DataFrame, path: str) -> None:
    """The chunk corpus as CSV: chunk_id, text_description, image_filename, query."""
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in chunks.columns else F.lit("").alias(c) for c in ("chunk_id", "text_description", "image_filename", "query")]
    chunks.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("chunk_id string, text_description string, image_filename string, query string").csv(path)
    return df.fillna("", ["text_description"])


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The question set: one JSON array, numbered from 1 in the file's order (a multi-line file is one task's)."""
    return spark.read.option("multiLine", True).json(path).withColumn("q_num", (F.monotonically_increasing_id() + 1).cast("int"))


def answer(df: DataFrame) -> DataFrame:
    """An answer without the columns that are never shown."""
    return df.drop(*(c for c in df.columns if c.lower() in INTERNAL))


def attach_metadata(rows: DataFrame, meta: DataFrame, by: str = "file") -> DataFrame:
    """Rows with what is known of their file: each metadata column fills a missing or null one of the rows; ``meta`` has one row
    for each file, and rows of a file without one stay."""
    names = [c for c in meta.columns if c != by]
    known = meta.select(by, *(F.col(c).alias(f"meta_{c}") for c in names))
    out = rows.join(known, by, "left")
    for c in names:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"meta_{c}")) if c in rows.columns else F.col(f"meta_{c}"))
    return out.drop(*(f"meta_{c}" for c in names))


def any_header(tables: list[tuple[list[str] | None, DataFrame]]) -> tuple[list[str] | None, DataFrame]:
    """The rows (cells) of several tables in one, table_idx telling them apart, and the first header that any of them has."""
    if not tables:
        raise ValueError("no tables")
    header = next((h for h, _ in tables if h), None)
    out = None
    for i, (_, rows) in enumerate(tables):
        rows = rows.withColumn("table_idx", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return header, out


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """A question's result as write_results left it; None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept at ``path``; where there is none, or it is empty or can't be read, ``make`` gives it and it is kept."""
    try:
        df = spark.read.parquet(path)
        if not df.isEmpty():
            return df
    except (PySparkException, Py4JJavaError):  # any table that can't be read is made again
        pass
    made = make()
    made.write.mode("overwrite").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """A question's result; an empty one keeps its schema."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def write_evaluation(df: DataFrame, path: str) -> None:
    """Evaluation rows, replacing only the solutions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("solution").parquet(path)
