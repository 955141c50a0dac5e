"""Line dedup by pairwise alignment: rare shared lines find overlapping documents, patience diff aligns them.

A line is known by the 64-bit hash of its trimmed text; blank lines play no part. What counts are common blocks: runs of
successive lines that stand in the same succession in an earlier document (one of a smaller key) and have at least
``block_words`` words. Every line of such a block goes from the later document.

First, lines that no other document holds are left out, with one aggregation; the rest of a document is its skeleton, a
small part of it. Lines of at least ``min_words`` words that at most ``RARE`` documents hold are rare: every two
documents that share one are a pair, at most RARE - 1 earlier partners for each line. Patience diff aligns the pair's
skeletons: it takes the lines unique in both, keeps the longest run of them in equal order, grows blocks of equal
lines from these, and starts again between two blocks. Blocks are judged for each pair by itself.

What alignment can't see, blocks of lines that many documents hold, that stand several times in one document, or that
come in another order, is found exactly: the shortest stretches of ``block_words`` words that start or end at each line
of a skeleton are known by a hash, and one that a smaller key holds too is a common block. Every line of a common block is in such a stretch. So
the result is the common blocks with any earlier document, no matter how common; in groups of copies stretches are
compared with their smallest key and never with each other. What moves are hashes; texts move only where a
document loses lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, maybe_listed, python_rows, written

MIN_WORDS, BLOCK_WORDS = 4, 20
#: Most documents that hold a rare line. Commoner ones are found by stretches.
RARE = 8


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], rising in both; an explicit stack instead of recursion."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if nb[x] == 1 and na.get(x) == 1}
        both = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if x in where]
        if not both:
            continue
        # longest rising run of the positions in b, by piles
        tops, pile, back = [], [], [-1] * len(both)
        for n, (_, j) in enumerate(both):
            p = bisect_left(tops, j)
            tops[p : p + 1], pile[p : p + 1] = [j], [n]
            back[n] = pile[p - 1] if p else -1
        n, chain = pile[-1], []
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        i0, j0 = a0, b0
        for i, j in reversed(chain):
            todo.append((i0, i, j0, j))
            out.append((i, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(out)


def line_hashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key_, text_hash_, x_): hash h, number of words w and place i of a document's lines that aren't blank."""
    trimmed = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.trim(x))
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key_"), F.xxhash64(F.col(text)).alias("text_hash_"), trimmed.alias("l_"))
    size = lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, " +")))
    lines = F.transform("l_", lambda x, i: F.struct(F.xxhash64(x).alias("h"), size(x).alias("w"), i.alias("i")))
    return rows.select("key_", "text_hash_", F.filter(lines, lambda x: x["w"] > 0).alias("x_"))


#: Multiplier of the stretches' hashes and its inverse, modulo 2^64.
BASE = 0x9E3779B97F4A7C13
BACK = pow(BASE, -1, 1 << 64)


def powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def stretches(at: np.ndarray, hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash) of the shortest stretches of ``least`` words that start or end at each line; ``at`` are the
    lines' places, and a stretch has no gap in them. First and last are indices."""
    n = len(at)
    upto = np.concatenate([[0], np.cumsum(words)])
    gap = np.concatenate([[True], np.diff(at) != 1])
    begin = np.maximum.accumulate(np.where(gap, np.arange(n), 0))  # of the run that a line is in
    stop = np.append(np.flatnonzero(gap), n)[np.cumsum(gap)]  # past its end
    end = np.searchsorted(upto, upto[:-1] + least)  # past the last line of the stretch that starts here
    first = np.searchsorted(upto, upto[1:] - least, side="right") - 1  # of the stretch that ends here
    a, b = np.flatnonzero(end <= stop), np.flatnonzero((first >= begin) & (upto[1:] >= least))
    both = np.unique(np.concatenate([np.stack([a, end[a] - 1], 1), np.stack([first[b], b], 1)]), axis=0)
    first, last = both[:, 0], both[:, 1]
    x = hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(BASE, n), dtype=np.uint64)])
        h = (total[last + 1] - total[first]) * powers(BACK, n)[first] + (last - first).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return first, last, h.view(np.int64)


def common_blocks(a: list[int], a_at: list[int], b: list[int], b_at: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) indices in b of the aligned runs without a gap on either side that have ``least`` words."""
    out, run, total = [], None, 0
    for i, j in [*patience(a, b), (-1, -1)]:
        if run and i >= 0 and a_at[i] == a_at[run[2]] + 1 and b_at[j] == b_at[run[1]] + 1:
            run, total = (run[0], j, i), total + words[j]
            continue
        if run and total >= least:
            out.append(run[:2])
        run, total = (j, j, i), words[j] if i >= 0 else 0
    return out


def merged(spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """(first line, number of lines) of what lies outside the spans (first, last), and the number of lines inside."""
    left, at, gone = [], 0, 0
    for s, e in sorted(spans):
        if e < at:
            continue
        if s > at:
            left.append((at + 1, s - at))
        gone += e + 1 - max(s, at)
        at = e + 1
    return [*left, (at + 1, (1 << 31) - 1 - at)], gone


def line_marks(docs: DataFrame, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, rare: int = RARE, key: str = "doc_id", text: str = "text", everywhere: bool = True) -> DataFrame:
    """(key_, text_hash_, left_ array<struct<first, n>>, gone_) for the documents that lose a line: the stretches of lines,
    counted from 1, that stay, and how many go. Without ``everywhere`` only by alignment of pairs with a rare line."""
    held = written(line_hashes(docs, key, text).distinct(), "lines")
    lines = held.select("key_", F.explode(F.array_distinct(F.transform("x_", lambda x: x["h"]))).alias("h"))
    shared = lines.groupBy("h").agg(F.count("*").alias("n"), F.min("key_").alias("lo_"), F.max("key_").alias("hi_")).where("lo_ < hi_").select("h", "n")
    each = held.select("key_", "text_hash_", F.posexplode("x_").alias("at", "x_")).select("key_", "text_hash_", "at", "x_.*")
    each = written(each.join(written(shared, "shared"), "h"), "places")
    own = F.sort_array(F.collect_list(F.struct("at", "h", "w", "i")))
    skeleton = written(each.groupBy("key_", "text_hash_").agg(own.alias("x_")), "skeletons")
    skeleton = skeleton.select("key_", "text_hash_", *(F.col(f"x_.{c}").alias(c) for c in ("at", "h", "w", "i")))

    holders = each.where((F.col("n") <= rare) & (F.col("w") >= min_words)).groupBy("h").agg(F.sort_array(F.collect_set("key_")).alias("k_"))
    two = F.flatten(F.transform("k_", lambda x, i: F.transform(F.slice("k_", i + 2, rare), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = written(holders.select(F.explode(two).alias("p_")).select("p_.*").distinct(), "pairs")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, ah, aa, bh, ba, w, i in zip(*(b[c] for c in ("key_", "text_hash_", "ah", "aa", "h", "at", "w", "i")), strict=True):
                out += [(k, t, i[s], i[e]) for s, e in common_blocks(ah.tolist(), aa.tolist(), bh.tolist(), ba.tolist(), w.tolist(), block_words)]
            yield pd.DataFrame(out, columns=["key_", "text_hash_", "s", "e"])

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(*stretches(at, h, w, block_words), i) for at, h, w, i in zip(b["at"], b["h"], b["w"], b["i"], strict=True)]
            n = [len(x[0]) for x in found]
            if sum(n):
                yield pd.DataFrame({"key_": np.repeat(b["key_"].to_numpy(), n), "text_hash_": np.repeat(b["text_hash_"].to_numpy(), n), "s": np.concatenate([i[x] for x, _, _, i in found]), "e": np.concatenate([i[y] for _, y, _, i in found]), "stretch_": np.concatenate([h for _, _, h, _ in found])})

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [merged([(x["s"], x["e"]) for x in spans]) for spans in b["spans_"]]
            yield b[["key_", "text_hash_"]].assign(left_=[[{"first": f, "n": n} for f, n in left] for left, _ in out], gone_=[n for _, n in out])

    sides = pairs.join(skeleton.select(F.col("key_").alias("a"), F.col("h").alias("ah"), F.col("at").alias("aa")), "a").join(skeleton.withColumnRenamed("key_", "b"), "b")
    spans = python_rows(sides.select(F.col("b").alias("key_"), "text_hash_", "ah", "aa", "h", "at", "w", "i"), align, "key_ long, text_hash_ long, s int, e int")
    spans = written(spans, "aligned")
    if everywhere:
        all_ = written(python_rows(skeleton, starts, "key_ long, text_hash_ long, s int, e int, stretch_ long"), "stretches")
        owner = all_.groupBy("stretch_").agg(F.min("key_").alias("owner_"), F.max("key_").alias("last_")).where("owner_ < last_").select("stretch_", "owner_")
        spans = spans.union(all_.join(written(owner, "owners"), "stretch_").where("key_ > owner_").select("key_", "text_hash_", "s", "e"))
    gone = spans.groupBy("key_", "text_hash_").agg(F.collect_set(F.struct("s", "e")).alias("spans_"))
    return python_rows(gone, choose, "key_ long, text_hash_ long, left_ array<struct<first: int, n: int>>, gone_ int")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, key: str = "doc_id", text: str = "text", dropped: str = "lines_dropped", everywhere: bool = True, rare: int = RARE) -> DataFrame:
    """``docs`` without the lines of common blocks with earlier documents; all columns stay, and ``dropped`` counts lines
    (a column of that name is replaced).

    A block goes with its line breaks and the blank lines within it. Of equal blocks the document of the smallest key keeps its
    own; a repeat within one document stays. Rows with a null key or text, empty texts and an empty table stay as they
    are; a document of which every line goes is left with an empty text; rows of one key aren't held against each
    other, and equal rows share one fate. A very long text is a task's largest row: its hashes take 20 bytes a line. Values of
    other columns, such as a number of characters, aren't adjusted.
    """
    columns = [c for c in docs.columns if c.lower() != dropped.lower()]
    marks = written(line_marks(docs, min_words, block_words, rare, key, text, everywhere), "marks")
    k, t, left, gone = fresh(docs, "key_", "text_hash_", "left_", "gone_")
    marks = marks.toDF(k, t, left, gone)
    may, clear = maybe_listed(docs, marks.select(F.col(k).alias(key)), key)
    out = may.join(marks.hint("merge"), (may[key].cast("long") == F.col(k)) & (F.xxhash64(may[text]) == F.col(t)), "left")
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    stays = F.array_join(F.flatten(F.transform(F.col(left), lambda x: F.slice(lines, x["first"], x["n"]))), "\n")
    names = [F.when(F.col(left).isNull(), F.col(f"`{text}`")).otherwise(stays).alias(text) if c == text else F.col(f"`{c}`") for c in columns]
    out = out.select(*names, F.coalesce(F.col(gone), F.lit(0)).alias(dropped))
    return out.unionByName(clear.select(*(F.col(f"`{c}`") for c in columns), F.lit(0).alias(dropped)))
