"""BPE encoding and decoding with a bounded-lookahead streaming transducer and an incremental decoder.

``bpe.lookahead`` computes from the merge list how many bytes right of a token settle it at most; ``bpe.Transducer`` emits
tokens as soon as they are stable, which is mostly sooner, and holds no more than that. Every text, long or short, goes through
``bpe.Encoder.stream`` in chunks; ids are hashed and decoded as they come out and not kept. Narrow maps only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import python_rows


def decode(v: bpe.Vocabulary, ids: list[int], portion: int = 4096) -> Iterator[str]:
    """The text of ids, portion by portion."""
    d = bpe.Decoder(v)
    for i in range(0, len(ids), portion):
        yield d.feed(ids[i : i + portion])
    yield d.finish()


def encode_column(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): every whole text's ids; null texts give an empty array. One row out for one in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = bpe.Encoder(path)
        for b in batches:
            yield pd.DataFrame({"key_": b["key_"], "ids": [[i for ids, _ in encode.stream(x) for i in ids] for x in b["text_"]]})

    schema = T.StructType([T.StructField("key_", docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    return python_rows(rows, run, schema).withColumnRenamed("key_", key)


def decode_column(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the text of every row's ids; null or empty arrays give ''. Unknown ids raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = bpe.vocabulary(path)
        for b in batches:
            yield pd.DataFrame({"key_": b["key_"], "text": ["" if x is None else "".join(decode(v, list(x))) for x in b["ids_"]]})

    schema = T.StructType([T.StructField("key_", encoded.schema[key].dataType), T.StructField("text", T.StringType())])
    rows = encoded.select(F.col(key).alias("key_"), F.col(ids).alias("ids_"))
    return python_rows(rows, run, schema).withColumnRenamed("key_", key)


def codec_digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) from encoding every whole text and decoding its ids again.

    Null texts count as empty (0 tokens, digests of ''); repeated rows and null keys give one row each. Of a very long text
    no more than a window is in work besides the text itself. Other columns of ``docs``, whatever their names, play no part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = bpe.Encoder(path)
        for b in batches:
            yield pd.DataFrame([digest(encode, x) for x in b["text_"]], columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(key_=b["key_"].to_numpy())[["key_", "n_tokens", "ids_sha256", "decoded_sha256"]]

    schema = T.StructType([T.StructField("key_", docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    return python_rows(rows, run, schema).withColumnRenamed("key_", key)


def digest(encode: bpe.Encoder, text: str) -> tuple[int, str, str]:
    """(number of ids, SHA-256 of their decimal list, SHA-256 of the decoded text), each portion hashed and decoded as it comes."""
    n, listed, decoded, d = 0, hashlib.sha256(), hashlib.sha256(), bpe.Decoder(encode.v)
    for ids, digits in encode.stream(text):
        listed.update((f",{digits}" if n else digits).encode())
        decoded.update(d.feed(ids).encode("utf-8"))
        n += len(ids)
    decoded.update(d.finish().encode("utf-8"))
    return n, listed.hexdigest(), decoded.hexdigest()
