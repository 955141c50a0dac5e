"""Chunking: word tokens, fixed-size chunks with overlap, page-bounded greedy packing of CSV rows, preprocessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Common English function words.
STOPWORDS = "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()


def tokens(c: Column) -> Column:
    """The default tokenizer: white-space words. Deterministic and additive; swap in another where a vocabulary is at hand."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def preprocess(c: Column) -> Column:
    """Lower-case alphanumeric words without stopwords; repeats stay."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda x: (x != "") & ~F.array_contains(F.array(*map(F.lit, STOPWORDS)), x))


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 0) -> DataFrame:
    """(key, chunk_index, n_tokens, chunk): runs of ``size`` tokens; with overlap each starts with the last tokens of the one before."""
    t = df.select(key, tokens(F.col(text)).alias("t_")).where(F.size("t_") > 0)
    out = t.select(key, "t_", F.explode(F.sequence(F.lit(0), F.ceil(F.size("t_") / size).cast("int") - 1)).alias("chunk_index"))
    start = F.greatest(F.col("chunk_index") * size - overlap, F.lit(0))
    part = F.slice("t_", start + 1, F.col("chunk_index") * size + size - start)
    return out.select(key, "chunk_index", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("chunk"))


def csv_line(cells: Column) -> Column:
    """Cells as one CSV line: quoted only where a comma, quote or line break asks for it."""
    q = F.transform(cells, lambda x: F.when(F.coalesce(x, F.lit("")).rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit(""))))
    return F.array_join(q, ",")


def pack_rows(rows: DataFrame, header: Column, group: list[str], order: list[str], line: str = "line", limit: int = 512) -> DataFrame:
    """(group, chunk_index, n_rows, n_tokens, body): rows of a page in order, packed while header and rows stay within the limit.

    A row over the limit is a chunk of its own; nothing overlaps. A page's rows fold in one pass over its sorted array;
    a page is what a task must hold.
    """
    h = token_count(header)
    page = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, token_count(F.col(line)).alias("n_"), F.col(line).alias("l_")))).alias("rows_"), F.first(h).alias("h_"), F.first(header).alias("head_"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("of"))

    def step(s: Column, x: Column) -> Column:
        full = (s["used"] > 0) & (F.col("h_") + s["used"] + x["n_"] > limit)
        chunk = F.when(full | (s["chunk"] == 0), s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(full, x["n_"]).otherwise(s["used"] + x["n_"]).alias("used"), F.concat(s["of"], F.array(chunk)).alias("of"))

    placed = page.withColumn("of_", F.aggregate("rows_", start, step, lambda s: s["of"]))
    each = placed.select(*group, "h_", "head_", F.posexplode(F.arrays_zip("rows_", "of_")).alias("pos_", "x_"))
    packed = each.groupBy(*group, F.col("x_.of_").alias("chunk_index")).agg(F.count("*").alias("n_rows"), (F.first("h_") + F.sum("x_.rows_.n_")).alias("n_tokens"), F.first("head_").alias("head_"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos_", F.col("x_.rows_.l_").alias("l")))), lambda v: v["l"]), "\n").alias("body_"))
    return packed.select(*group, "chunk_index", "n_rows", "n_tokens", F.concat_ws("\n", "head_", "body_").alias("body"))


def corpus_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("image_filename").alias("pages"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct(F.when(F.col("query") != "", F.col("query"))).alias("queries"))


def statement_chunks(df: DataFrame, limit: int = 512) -> DataFrame:
    """The chunk corpus (chunk_id, text_description, image_filename, query) of the rows of many statements.

    A statement is a file ("File Name" or file_name), a page "Page" or page; without them all is one file or page 1. Columns that
    are null in a whole file leave its header. Rows go by Serial, serial, Date and date, those that there are, nulls first, and
    by their line. Ids count chunks of a page from 1.
    """
    pick = lambda names, other: next((F.col(f"`{c}`") for c in names if c in df.columns), F.lit(other))
    file = F.coalesce(pick(("File Name", "file_name"), "unknown_statement.pdf"), F.lit("unknown_statement.pdf"))
    named = "File Name" if "File Name" in df.columns else "file_name"
    fields = [c for c in df.columns if c != named]
    order = [c for c in ("Serial", "serial", "Date", "date") if c in fields]
    page = F.coalesce(pick(("Page", "page"), "1").cast("string"), F.lit(""))
    rows = df.select(
        file.alias("file_"), page.alias("page_"), *(F.col(f"`{c}`").alias(f"by{i}_") for i, c in enumerate(order)),
        F.array(*(F.col(f"`{c}`").cast("string") for c in fields)).alias("cells_"),
    )
    used = rows.groupBy("file_").agg(F.array(*(F.count(F.col("cells_")[i]) > 0 for i in range(len(fields)))).alias("used_"))
    rows = rows.join(used, "file_")
    kept = lambda a: F.filter(a, lambda _, i: F.get("used_", i))
    rows = rows.withColumn("line_", csv_line(kept(F.col("cells_")))).withColumn("header_", csv_line(kept(F.array(*map(F.lit, fields)))))
    packed = pack_rows(rows, F.col("header_"), ["file_", "page_"], [*(f"by{i}_" for i in range(len(order)))], line="line_", limit=limit)
    stem = F.regexp_replace(F.regexp_replace("file_", r"^.*/", ""), r"(?<=.)\.[^.]+$", "")
    at = F.concat(stem, F.lit("_page_"), F.col("page_"))
    return packed.select(
        F.concat(at, F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("body").alias("text_description"),
        F.concat(at, F.lit(".png")).alias("image_filename"), F.lit("").alias("query"),
    )
