"""Vector best-fit packing of token sequences.

Items are pieces of documents with a demand vector (tokens, 1 document, tokens squared as attention cost); a sequence
has a capacity for each. Pieces are placed longest first; each goes to the open sequence that fits under every
constraint and has the best score: the greatest weighted dot product of demand and residual, or the least norm of what
would be left. Since the demand follows from the length alone, all pieces of one length are one kind of at most
``capacity`` kinds, and sequences with equal residuals are one class, held as intervals of sequence numbers. So the plan
is solved exactly as over single pieces from a histogram of lengths, whose size doesn't grow with the corpus; what comes
out are intervals "the pieces of length s with ranks a to b go to sequences x onward at offset o", at most a few for each
length and class, no matter how many pieces there are. Pieces then get their rank within their length and look their
interval up.

Ranks are taken within (length, bucket of the key's hash) and shifted by the counts of the earlier buckets, so no
single length, however common, meets in one task.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import partitions, python_rows, written

PIECES = "key_ long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be shorter, all others are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's ids and an end id, cut into pieces: (key_, piece, start, length, ids_crc32)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = bpe.encoder(path, "<u4"), end_id.to_bytes(4, "little")
        for b in batches:
            out = []
            for k, x in zip(b["key_"], b["text_"], strict=True):
                ids = encode(x) + end
                out += [(k, p, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            yield pd.DataFrame(out, columns=["key_", "piece", "start", "length", "ids_crc32"]).astype({"key_": "Int64"})

    rows = docs.select(F.col(key).cast("long").alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    return python_rows(rows, run, PIECES)


def plan(histogram: dict[int, int], capacity: int, max_docs: int, max_attention: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, past the last rank, first sequence, offset) of counts by length.

    A class is (tokens left, documents left, attention left) -> intervals [first sequence, count].
    rule "norm": least weighted norm of the residual shares after placing; "dot": greatest weighted dot product of the
    demand and the residual shares, ties to the least residual tokens. Both take an exact fill of the tokens first.

    The number of intervals is bounded by the lengths, not by the pieces: a step takes a whole interval, which only
    changes its class, or ends a length, which splits one interval and has opened at most one.
    """
    caps, (wt, wd, wa) = (capacity, max_docs, max_attention), weights
    classes: dict[tuple[int, int, int], list[list[int]]] = {}
    out, bins = [], 0

    def score(c: tuple[int, int, int], s: int) -> tuple:
        t, d, a = c
        if rule == "dot":
            return (t != s, -(wt * s * t / caps[0] ** 2 + wd * d / caps[1] ** 2 + wa * s * s * a / caps[2] ** 2), t, d, a)
        return (t != s, wt * ((t - s) / caps[0]) ** 2 + wd * ((d - 1) / caps[1]) ** 2 + wa * ((a - s * s) / caps[2]) ** 2, t, d, a)

    for s in sorted(histogram, reverse=True):
        left, rank = histogram[s], 0
        if not (0 < s <= capacity and s * s <= max_attention and max_docs >= 1):
            raise ValueError(f"a piece of {s} tokens fits into no sequence")
        fits = [(score(c, s), c) for c in classes if c[0] >= s and c[1] >= 1 and c[2] >= s * s]
        heapq.heapify(fits)
        while left:
            while fits and fits[0][1] not in classes:
                heapq.heappop(fits)
            if fits:
                c = fits[0][1]
            else:
                c, n = caps, math.ceil(left / max(1, min(capacity // s, max_docs, max_attention // (s * s))))
                classes.setdefault(c, []).append([bins, n])
                bins += n
                heapq.heappush(fits, (score(c, s), c))
            spans = classes[c]
            x, n = spans[-1]
            take = min(n, left)
            out.append((s, rank, rank + take, x, capacity - c[0]))
            left, rank = left - take, rank + take
            if take == n:
                spans.pop()
            else:
                spans[-1] = [x + take, n - take]
            if not spans:
                del classes[c]
            new = (c[0] - s, c[1] - 1, c[2] - s * s)
            if new[0] and new[1] and new[2]:
                if new not in classes and new[0] >= s and new[2] >= s * s:
                    heapq.heappush(fits, (score(new, s), new))
                classes.setdefault(new, []).append([x, take])
    return out


def pack(pieces: DataFrame, capacity: int, max_docs: int | None = None, max_attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """``pieces`` (key_, piece, length and whatever else) with sequence_id and offset.

    All three capacities are kept for every sequence; without max_docs or max_attention they are what the tokens allow. Every piece, repeated rows too, is placed once; an empty
    table gives an empty one. The driver gets counts by length: at most ``capacity`` rows.
    """
    spark = pieces.sparkSession
    docs, attention = max_docs or capacity, max_attention or capacity * capacity
    buckets = max(16, 2 * partitions(spark))
    # equal rows are told apart by their place, so that repeats of one row are spread over the buckets as well
    held = pieces.withColumn("row_", F.monotonically_increasing_id())
    held = written(held.withColumn("bucket_", F.pmod(F.xxhash64("key_", "piece", "row_"), F.lit(buckets)).cast("int")), "pieces")
    counts = held.groupBy("length", "bucket_").agg(F.count("*").alias("n_"))
    counts = written(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n_").alias("n")).collect()}
    found = np.array(plan(histogram, capacity, docs, attention, rule, weights), dtype=np.int64).reshape(-1, 5)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    sent = spark.sparkContext.broadcast(found)  # bounded by the lengths and classes, not by the corpus; see plan()

    before = Window.partitionBy("length").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("shift_"))
    within = Window.partitionBy("length", "bucket_").orderBy("key_", "piece", "row_")
    ranked = held.withColumn("rank_", F.row_number().over(within) - 1).join(shift, ["length", "bucket_"])
    ranked = ranked.withColumn("rank_", F.col("rank_") + F.col("shift_")).drop("shift_", "bucket_", "row_")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, base = sent.value, np.int64(1) << 40
        at = p[:, 0] * base + p[:, 1]
        for b in batches:
            s, r = b["length"].to_numpy(np.int64), b.pop("rank_").to_numpy(np.int64)
            i = np.searchsorted(at, s * base + r, side="right") - 1
            yield b.assign(sequence_id=p[i, 3] + r - p[i, 1], offset=p[i, 4])

    names = [f for f in ranked.schema.fields if f.name != "rank_"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", sequence_id long, offset long"
    return python_rows(ranked, place, schema)


#: Documents that a sequence of pack_documents holds at most. Attention may cost what one full piece costs.
MAX_DOCS = 256


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS, **limits) -> DataFrame:
    """Packs all documents: (key, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    A null text counts as empty: a piece of the end id alone. Null keys and repeated rows are packed like any others.
    Very long texts are cut into pieces and packed whole. Other columns of ``docs``, whatever their names, play no part.
    """
    out = pack(token_pieces(docs, path, capacity, end_id, key, text), capacity, max_docs, **limits)
    return out.select(F.col("key_").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
