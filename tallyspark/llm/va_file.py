"""Exact top-k by inner product with vector-approximation files.

Vectors are turned to integers, floor(scale * x). A block of rows keeps, next to the exact vectors, its approximation
file: four bits for the cell of every component, two components a byte, an eighth of the exact vectors' size. For a
query, a table of 256 entries for every byte holds the greatest product that the two cells allow; summing table entries
bounds the inner product of every row from above. Exact rows are then decoded and multiplied in the order of their
bounds, a portion at a time, until the kth best exact score is above the next bound. So nothing is missed, and most
exact vectors are never read.

Queries and rows meet block by block: every block of rows with every block of queries. Both block sizes are fixed, so a
task holds one of each however large the tables are; each task hands on k rows a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann import of_one_length, usable
from .common import partitions, written

ROW_BLOCK, QUERY_BLOCK, CELLS = 16_384, 16_384, 16
#: Integers below this are exact in double precision.
EXACT = 2.0**53
LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64))


class Approximation:
    """Cells of a block's components: lower corners lo + cell * width on a grid of each dimension."""

    def __init__(self, v: np.ndarray):
        self.lo, hi = v.min(0), v.max(0)
        self.width = np.maximum(1.0, np.ceil((hi - self.lo + 1) / CELLS))
        cells = np.minimum((v - self.lo) // self.width, CELLS - 1).astype(np.uint8)
        cells = np.pad(cells, ((0, 0), (0, cells.shape[1] % 2)))
        self.packed = np.ascontiguousarray((cells[:, 0::2] << 4 | cells[:, 1::2]).T)  # a row for every two dimensions

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(pairs of dimensions, 256): the greatest sum of two products that the cells allow. Of integral values it is exact."""
        corner = self.lo[:, None] + self.width[:, None] * np.arange(CELLS)
        each = np.maximum(q[:, None] * corner, q[:, None] * (corner + self.width[:, None] - 1))
        each = np.pad(each, ((0, len(each) % 2), (0, 0)))
        return (each[0::2, :, None] + each[1::2, None, :]).reshape(-1, 256)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of all rows with q, a little raised to cover rounding."""
        total = np.zeros(self.packed.shape[1])
        most = 0.0
        for table, bytes_ in zip(self.tables(q), self.packed, strict=True):
            total += table.take(bytes_)
            most += np.abs(table).max()
        return total + most * 1e-12


def scores(v: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact integer inner products: in doubles where all sums are exact there, else in Python's integers, clipped to 64 bits."""
    if np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * len(q) < EXACT:
        return (v @ q).astype(np.int64).tolist()
    whole = [int(x) for x in q]
    return [max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in v]


def block_top(ids: np.ndarray, read, approximation: Approximation, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row id, score) of the k best rows of a block for each query, ties to the smaller id.

    ids: distinct. ``read`` gives the exact integers of the rows at some places; q: integral doubles.
    """
    out = []
    for me, y in zip(query_ids.tolist(), q, strict=True):
        bound = approximation.bounds(y)
        best: list[tuple[int, int]] = []  # (-score, id)
        at, m = 0, min(len(ids), max(64, 4 * k))
        order = None
        while at < len(ids):
            # the next portion in the order of bounds: the first by selection, later ones from the sorted rest
            if order is None:
                part = np.argpartition(-bound, m - 1)[:m] if m < len(ids) else np.arange(len(ids))
                part = part[np.argsort(-bound[part], kind="stable")]
            else:
                part = order[at : at + m]
            if len(best) >= k and bound[part[0]] < -best[k - 1][0]:
                break
            own = part[ids[part] != me]
            best = sorted(best + [(-s, i) for s, i in zip(scores(read(own), y), ids[own].tolist(), strict=True)])[:k]
            at, m = at + m, 2 * m
            if order is None and at < len(ids):
                rest = np.ones(len(ids), bool)
                rest[part] = False
                if len(best) >= k:  # rows under the kth score are out for good
                    rest &= bound >= -best[k - 1][0]
                rest = np.flatnonzero(rest)
                order = np.concatenate([part, rest[np.argsort(-bound[rest], kind="stable")]])
            if order is not None and at >= len(order):
                break
        out += [(me, i, -s) for s, i in best]
    return out


def exact_top(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by ``every`` the k rows of other keys with
    the greatest integer inner product, ties to the smaller key; fewer where there are fewer.

    Null vectors and those with null or non-finite components take no part; zero vectors do; of vectors of several
    lengths those of the commonest do. Rows of one key are one
    candidate, with the greatest of their scores, and one query, the same way. Scores outside 64 bits are clipped to them.
    Other columns of ``vectors``, whatever their names, play no part. An empty table gives an empty one.
    """
    rows = written(usable(vectors, key, vector, zero=False), "vectors")
    rows, dim = of_one_length(rows)
    asks = rows.where(F.col("id_") % every == 0)
    total, asked = rows.count(), asks.count()
    width = np.dtype("f4" if rows.schema["v_"].dataType.simpleString() == "array<float>" else "f8")
    spread = partitions(vectors.sparkSession)
    n_rows = max(1, -(-total // row_block), min(spread, -(-total // 2048)))
    n_asks = max(1, -(-asked // query_block))
    # rows of one key are told apart, so that those of a common key are spread over the blocks
    block = lambda n, salt: F.pmod(F.xxhash64("id_", "v_", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = rows.withColumn("row_", block(n_rows, 1)).withColumn("ask_", each(n_asks))
    wanted = asks.withColumn("ask_", block(n_asks, 2)).withColumn("row_", each(n_rows))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple[int, int], int] = {}
        if len(a) and len(b):
            load = lambda p: (p["id_"].to_numpy(np.int64), np.array(p["v_"].tolist(), width).reshape(len(p), dim))
            (ids, x), (qs, y) = load(a), load(b)
            # rows that repeat a key go in passes of distinct keys
            turn = a.groupby("id_").cumcount().to_numpy()
            for t in range(turn.max() + 1):
                mine = x[turn == t]
                cells = Approximation(integers(mine, scale))
                for i, j, s in block_top(ids[turn == t], lambda at, mine=mine: integers(mine[at], scale), cells, qs, integers(y, scale), k):
                    out[i, j] = max(s, out.get((i, j), s))
        return pd.DataFrame([(i, j, s) for (i, j), s in out.items()], columns=["query_id", "vec_id", "score"]).astype("int64")

    met = there.groupBy("row_", "ask_").cogroup(wanted.groupBy("row_", "ask_")).applyInPandas(meet, "query_id long, vec_id long, score long")
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
