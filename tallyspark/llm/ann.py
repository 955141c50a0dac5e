"""Approximate nearest neighbours: a forest of random-projection trees searched through one shared priority queue.

The trees are fitted on a bounded sample; every vector is then sent down every tree, and carries its leaves. A query
takes the leaves of all trees in one order: by the sum of its distances to the hyperplanes that part it from the leaf.
It takes those up to ``reach``; all vectors of these leaves are measured exactly in double precision, each once,
however many trees hold it. How far that must be depends on the data, so it is measured: for a fixed number of trial
queries the true neighbours are found by brute force in one scan, the least priority that any tree gives to each is
looked up, and ``reach`` becomes the least value that takes in the share ``RECALL``. Equal vectors are one point that keeps its
k + 1 smallest ids (no answer can need more), so a vector that a third of the rows share is one row.

Vectors and queries meet in blocks. A block holds vectors that lie together in the first tree, and each vector is in
one block; blocks of both sides are of bounded size, and each pair of blocks hands on k + 1 rows a query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, python_rows, written

TREES, LEAF, SAMPLE = 8, 16, 32_768
#: Queries on which the reach is set, and the recall that it must have on them.
TRIALS, RECALL = 128, 0.96
ROW_BLOCK, QUERY_BLOCK = 16_384, 8_192


@dataclass
class Forest:
    """Per tree: a full binary tree of fitted hyperplanes, then ``extra`` levels of one random direction a level each,
    at the projection of the fitted leaf's centre. The size is bounded by the sample; the number of leaves is not.
    """

    depth: int
    extra: int
    planes: np.ndarray  # trees, 2^depth - 1, dim
    cuts: np.ndarray  # trees, 2^depth - 1
    more: np.ndarray  # trees, extra, dim
    more_cuts: np.ndarray  # trees, 2^depth, extra

    @staticmethod
    def fit(sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        n, dim = sample.shape
        levels = max(0, math.ceil(math.log2(max(1, total / leaf))))
        depth = min(levels, max(0, int(math.log2(max(1, n / 16)))))
        extra = levels - depth
        planes, cuts = np.zeros((trees, 2**depth - 1, dim), np.float32), np.zeros((trees, 2**depth - 1), np.float32)
        more = rng.normal(size=(trees, extra, dim)).astype(np.float32)
        more_cuts = np.zeros((trees, 2**depth, extra), np.float32)
        for t in range(trees):
            held = [np.arange(n)]
            for level in range(depth):
                below = []
                for i, ids in enumerate(held):
                    node = 2**level - 1 + i
                    way = rng.normal(size=dim)
                    if len(ids) > 1:
                        a, b = sample[rng.choice(ids, 2, replace=False)].astype(np.float64)
                        way = a - b if (a != b).any() else way
                    way = (way / np.linalg.norm(way)).astype(np.float32)
                    at = sample[ids] @ way
                    cut = np.float32(np.median(at)) if len(ids) else np.float32(0)
                    planes[t, node], cuts[t, node] = way, cut
                    below += [ids[at < cut], ids[at >= cut]]
                held = below
            for i, ids in enumerate(held):
                more_cuts[t, i] = (more[t] @ sample[ids].mean(0)) if len(ids) else 0
        return Forest(depth, extra, planes, cuts, more, more_cuts)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of x in every tree: (rows, trees)."""
        out = np.empty((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            i = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + i
                i = 2 * i + (np.einsum("nd,nd->n", x, self.planes[t, node]) >= self.cuts[t, node])
            leaf = i
            for e in range(self.extra):
                leaf = 2 * leaf + (x @ self.more[t, e] >= self.more_cuts[t, i, e])
            out[:, t] = leaf
        return out

    def margins(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of q at all nodes: (trees, nodes), and at the levels below, by fitted leaf: (trees, leaves, levels)."""
        at = self.planes @ q - self.cuts if self.depth else np.zeros((len(self.planes), 0), np.float32)
        return at.astype(np.float64), ((self.more @ q)[:, None, :] - self.more_cuts).astype(np.float64)

    def probe(self, q: np.ndarray, reach: float) -> Iterator[tuple[float, int, int]]:
        """(priority, tree, leaf) in the order of the queue that all trees share, up to ``reach``."""
        at, extra = self.margins(q)
        levels = self.depth + self.extra
        heap = [(0.0, t, 0, 0) for t in range(len(self.planes))]
        while heap and heap[0][0] <= reach:
            far, t, level, i = heapq.heappop(heap)
            while level < levels:
                m = at[t, 2**level - 1 + i] if level < self.depth else extra[t, i >> (level - self.depth), level - self.depth]
                side = m >= 0
                level += 1
                heapq.heappush(heap, (far + abs(float(m)), t, level, 2 * i + (not side)))
                i = 2 * i + side
            yield far, t, i

    def priorities(self, q: np.ndarray, leaves: np.ndarray, reach: float = math.inf) -> np.ndarray:
        """The least priority that any tree's queue gives to the leaf of each row of ``leaves`` (rows, trees).

        The same sums as ``probe`` makes, for many leaves at once; those beyond ``reach`` may come out as anything greater.
        """
        at, extra = self.margins(q)
        best = np.full(len(leaves), np.inf)
        for t in range(len(self.planes)):
            far = np.zeros(1)
            for level in range(self.depth):
                m = at[t, 2**level - 1 : 2 ** (level + 1) - 1]
                down = np.empty(2 * len(far))
                down[0::2], down[1::2] = far + np.maximum(m, 0), far + np.maximum(-m, 0)
                far = down
            node = leaves[:, t] >> self.extra
            p = far[node]
            if self.extra:
                near = np.flatnonzero(p <= reach)
                m = extra[t, node[near]]
                bit = (leaves[near, t][:, None] >> np.arange(self.extra - 1, -1, -1)) & 1
                p[near] += np.maximum(np.where(bit, -m, m), 0).sum(1)
            np.minimum(best, p, out=best)
        return best


def usable(vectors: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """(id_, v_) of the rows that take part: a key, a vector without null or non-finite components, and with ``zero``
    set none that is all zero. v_ is array<float> or array<double>."""
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector).cast(kind)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id_"), v.alias("v_")).where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(v) > 0) & fine)
    return rows.where(F.exists("v_", lambda x: x != 0)) if zero else rows


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The vectors of the commonest length (of equally common ones the greatest), and that length; others can't be compared
    with them. An empty table has length 0."""
    most = rows.groupBy(F.size("v_").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return (rows.where(F.size("v_") == most["n"]), most["n"]) if most else (rows, 0)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to q, in double precision."""
    return np.sqrt(((x - q) ** 2).sum(1))


def nearest_rows(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k rows nearest to q, ties to smaller ids."""
    d = distances(x, q)
    keep = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    keep = keep[np.lexsort((ids[keep], d[keep]))[:k]]
    return ids[keep], d[keep]


def calibrated(points: DataFrame, forest: Forest, k: int, trials: int = TRIALS, recall: float = RECALL) -> float:
    """The least reach that finds the share ``recall`` of the true k nearest points of ``trials`` points.

    One scan: the trial vectors are broadcast (their number is fixed), each task keeps the k nearest of its rows.
    """
    spark = points.sparkSession
    some = points.orderBy(F.xxhash64("p_", F.lit(1)), "p_").limit(trials).select("p_", "v_").toPandas()
    q = np.array(some["v_"].tolist(), np.float64)
    sent = spark.sparkContext.broadcast((some["p_"].to_numpy(), q))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, asked = sent.value
        best: list[list[tuple[float, int, bytes]]] = [[] for _ in own]
        for b in batches:
            if not len(b):
                continue
            x, ids = np.array(b["v_"].tolist(), np.float64), b["p_"].to_numpy()
            for n, (i, y) in enumerate(zip(own, asked, strict=True)):
                d = np.where(ids == i, np.inf, distances(x, y))
                near = np.argpartition(d, min(k, len(d) - 1))[:k]
                best[n] = sorted(best[n] + [(d[j], int(ids[j]), x[j].tobytes()) for j in near if np.isfinite(d[j])])[:k]
        yield pd.DataFrame([(n, *row) for n, rows in enumerate(best) for row in rows], columns=["n", "d", "p", "x"]).astype({"n": "int64", "p": "int64"})

    near = python_rows(points.select("p_", "v_"), scan, "n long, d double, p long, x binary")
    true = near.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy("d", "p"))).where(F.col("r") <= k).select("n", "x").toPandas()
    far = [forest.priorities(q[n].astype(np.float32), forest.leaves(np.stack([np.frombuffer(x) for x in rows["x"]]).astype(np.float32))) for n, rows in true.groupby("n")]
    far = np.sort(np.concatenate(far)) if far else np.empty(0)
    return float(far[math.ceil(recall * len(far)) - 1]) if len(far) else math.inf


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf: int = LEAF, reach: float | None = None, sample: int = SAMPLE, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by ``every`` the k nearest found others.

    score is the Euclidean distance in double precision, ties go to the smaller key. Null vectors, zero vectors and
    those with null or non-finite components take no part, as queries or answers; of vectors of several lengths those
    of the commonest do. Rows repeated whole count once; with
    k or fewer others all that the probed leaves hold are returned. Other columns of ``vectors``, whatever their names, play no
    part. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows, dim = of_one_length(usable(vectors, key, vector, zero=True))
    width = np.dtype("f4" if rows.schema["v_"].dataType.simpleString() == "array<float>" else "f8")
    by_id = Window.partitionBy("v_").orderBy("id_")
    # row_number() <= k + 1 is cut to the first k + 1 of each vector before the shuffle as well
    few = rows.distinct().withColumn("n_", F.row_number().over(by_id)).where(F.col("n_") <= k + 1)
    points = few.groupBy("v_").agg(F.sort_array(F.collect_list("id_")).alias("ids_"))
    points = written(points.withColumn("p_", F.element_at("ids_", 1)), "points")
    total = points.count()
    share = min(1.0, 4.0 * sample / max(1, total))
    fitted = points.where(F.pmod(F.xxhash64("p_"), F.lit(1 << 20)) <= share * (1 << 20)).orderBy(F.xxhash64("p_"), "p_").limit(sample).select("v_").toPandas()
    model = Forest.fit(np.array(fitted["v_"].tolist(), np.float32).reshape(-1, max(dim, 1)), total, trees, leaf)
    reach = calibrated(points, model, k) if reach is None else reach
    forest = spark.sparkContext.broadcast(model)

    asks = rows.where(F.col("id_") % every == 0).distinct()
    asked = written(asks.join(points.select("v_", "p_"), "v_").select("id_", "p_"), "asked")
    asking = written(points.join(asked.select("p_").distinct(), "p_", "left_semi").select("p_", "v_"), "asking")
    n_rows = max(1, -(-total // row_block), min(partitions(spark), -(-total // 2048)))
    n_asks = max(1, -(-asking.count() // query_block))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.array(b["v_"].tolist(), width)
            f = forest.value
            at = f.leaves(x.astype(np.float32))
            block = at[:, 0] * n_rows >> (f.depth + f.extra)
            yield pd.DataFrame({"block": block.astype(np.int32), "p": b["p_"], "x": [r.tobytes() for r in x], "at": [r.tobytes() for r in at]})

    def measure(there: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(there) or not len(wanted):
            return pd.DataFrame({"q": [], "p": [], "d": []}).astype({"q": "int64", "p": "int64"})
        x = np.frombuffer(b"".join(there["x"]), width).reshape(len(there), dim).astype(np.float64)
        at = np.frombuffer(b"".join(there["at"]), np.int64).reshape(len(there), trees)
        ids, out = there["p"].to_numpy(np.int64), []
        for a, y in zip(wanted["q"], wanted["y"], strict=True):
            y = np.array(y, width)
            near = np.flatnonzero(forest.value.priorities(y.astype(np.float32), at, reach) <= reach)
            if len(near):
                found, d = nearest_rows(x[near], ids[near], y.astype(np.float64), k + 1)
                out.append(pd.DataFrame({"q": a, "p": found, "d": d}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "p": [], "d": []}).astype({"q": "int64", "p": "int64"})

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = python_rows(points.select("p_", "v_"), spread, "block int, p long, x binary, at binary").withColumn("ask", each(n_asks))
    wanted = asking.select(F.pmod(F.xxhash64("p_"), F.lit(n_asks)).cast("int").alias("ask"), F.col("p_").alias("q"), F.col("v_").alias("y")).withColumn("block", each(n_rows))
    found = placed.groupBy("block", "ask").cogroup(wanted.groupBy("block", "ask")).applyInPandas(measure, "q long, p long, d double")
    best = Window.partitionBy("q").orderBy("d", "p")
    found = written(found.withColumn("r_", F.row_number().over(best)).where(F.col("r_") <= k + 1).drop("r_"), "found")
    listed = found.join(points.select(F.col("p_").alias("p"), "ids_"), "p").select("q", "d", F.explode("ids_").alias("vec_id"))
    listed = listed.withColumn("r_", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("r_") <= k + 1)
    answers = asked.join(written(listed, "answers"), F.col("p_") == F.col("q")).where("id_ <> vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("id_").orderBy("d", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id_").alias("query_id"), "rank", "vec_id", F.col("d").alias("score"))
