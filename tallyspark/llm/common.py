"""Shared helpers of the training-data operators: shared storage, hashing and null-safe text."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch where the session has Spark's default of 10,000: texts can be long, and a batch lies in memory
#: several times, in the executor and in the worker.
BATCH_ROWS = 512
#: Pieces and bits a piece of the map in ``maybe_listed``: 2^26 bits, 8 MiB, whatever the number of keys.
PIECES, PIECE_BITS = 2048, 32_768


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where the session names none (tests on local mode) a temporary folder of this machine is set instead;
    on one machine it is shared by definition.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tallyspark-")
        atexit.register(shutil.rmtree, own, True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Folders of intermediate tables that this process has written.
_LEFT: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: its lineage ends at files every executor sees.

    Results are lazy and may read these tables at any later time, so they stay until ``sweep`` or the driver's end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT.add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, *paths: str) -> None:
    """Deletes the intermediate tables at ``paths``, by default all that this process has written: what still reads them fails."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths or tuple(_LEFT):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _LEFT.discard(path)


@atexit.register
def _sweep_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _LEFT else None
    if spark and spark.sparkContext._jsc:
        sweep(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where a column of ``df`` has the same (Spark compares them without regard to case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def python_rows(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str | T.StructType) -> DataFrame:
    """mapInPandas in batches of few rows, whose integer column key_ passes nulls through unharmed (pandas would turn it
    to floats), and whose worker gives freed memory back when its task ends, since workers live on between tasks."""
    conf = rows.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def safe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def held() -> Iterator[pd.DataFrame]:
            for b in batches:
                if "key_" in b and b["key_"].dtype.kind == "f":
                    b["key_"] = b["key_"].astype("Int64")
                yield b

        try:
            yield from run(held())
        finally:
            trim_memory()

    return rows.mapInPandas(safe, schema)


def trim_memory() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def maybe_listed(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows whose key may be in ``keys`` (its column of the same name), and rows whose key is not.

    So that a join with a list of keys moves the texts of few other documents, the keys are hashed to a map of 2^26
    bits, 8 MiB at most, that goes to all tasks. Rows that meet no bit pass by without a shuffle; a list that fills the map
    only makes more rows go the long way.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(PIECES * PIECE_BITS))
    piece, bit, bits, at = fresh(docs, "piece_", "bit_", "bits_", "at_")
    set_ = keys.select(place(key).alias(at)).distinct().select(F.floor(F.col(at) / PIECE_BITS).cast("int").alias(piece), (F.col(at) % PIECE_BITS).alias(bit))
    pieces = set_.repartition(partitions(docs.sparkSession), piece).groupBy(piece).agg(F.bitmap_construct_agg(bit).alias(bits))
    pieces = written(pieces, "bits")
    near = docs.withColumn(at, place(key)).withColumn(piece, F.floor(F.col(at) / PIECE_BITS).cast("int")).join(F.broadcast(pieces), piece, "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), ((F.col(at) % PIECE_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return near.where(hit).select(*names), near.where(~hit).select(*names)


def without(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in ``keys``; rows with a null key stay."""
    may, clear = maybe_listed(docs, keys, key)
    (gone,) = fresh(docs, "gone_")
    listed = keys.select(F.col(key).alias(gone)).distinct().hint("merge")
    return may.join(listed, may[key] == F.col(gone), "left_anti").unionByName(clear)
