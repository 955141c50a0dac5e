"""Token counts of whole texts by heap-and-linked-list byte-pair merging; no identifiers are made.

The count of a word is its bytes minus its merges. Words repeat, so a worker remembers counts of short words
(bounded); a text's count is the sum over its words, plus one for each special string, as the tokenizers library's
default treats them. A narrow map: no shuffle, nothing broadcast, a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import python_rows


def counter(path: str):
    """text -> number of its tokens."""
    v = bpe.vocabulary(path)
    memo = bpe.Memo(lambda raw: v.merge(raw, symbols=False))

    def count(text: str) -> int:
        return sum(1 if special >= 0 else sum(map(memo.__getitem__, words)) for special, words in bpe.pieces(v, text))

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of ``docs``; other columns play no part.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null keys stay as they are, one row out for one
    in; an empty table gives an empty table. Very long texts are counted whole, in memory linear in the longest word.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for b in batches:
            yield b.assign(n_tokens=[count(x) for x in b.pop("text_")])

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key_", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key_"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text_"))
    return python_rows(rows, run, schema).select(F.col("key_").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
