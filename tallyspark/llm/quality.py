"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

One pass turns every whole text into about thirty statistics (shares of kinds of characters, shapes of words, lines
and sentences, repetition). On the labelled rows the statistics are standardised and mapped by D random cosines, whose
inner products approximate a Gaussian kernel; partitions sum Z'Z and Z'y, D+1 squared numbers each, and the driver
solves the ridge system. Scores of folds that a solution hasn't seen are then calibrated by pooling adjacent
violators, which gives chances of label 1.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_rows, without, written

D, WIDTH, RIDGE, FOLDS, SEED = 384, 1.0 / 64, 1.0, 3, 20240607
#: Most labelled rows that the model is fitted on: those of least key hash. A parameter of fit().
MOST_LABELLED = 500_000
#: Tasks that sum Z'Z; each sends the driver one matrix a fold.
SUM_TASKS = 12

# Byte classes of UTF-8 text.
_CLASS = np.full(256, 7, np.int64)  # 7: other punctuation
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[128:] = 4
_CLASS[[44, 46, 59, 58, 39, 45]] = 5  # , . ; : ' -
_CLASS[[33, 63]] = 6  # ! ?
_SIGNS = [33, 35, 36, 37, 38, 42, 64, 124, 60, 62, 123, 95]  # ! # $ % & * @ | < > { _


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, linear in its length; nothing but the text goes in."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=count, minlength=8) / n
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    often = Counter(words)
    lines = [x for x in text.split("\n") if x]
    m = max(1, len(lines))
    sizes = np.array([len(x) for x in lines] or [0])
    ends = sum(x[-1] in ".!?…\"”»" for x in lines)
    upper = sum(map(str.isupper, words))
    plain = sum(map(str.isalpha, words))
    title = sum(map(str.istitle, words))
    pairs = Counter(zip(words, words[1:], strict=False))
    p = max(1, len(words) - 1)
    share = np.array(list(often.values()) or [1]) / w
    byte = count[count > 0] / n
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), *kinds.tolist(),
        *(count[s] / n for s in _SIGNS),
        float(lengths.mean()), float(lengths.std()), math.log1p(float(lengths.max())),
        upper / w, plain / w, title / w, len(often) / w, float(share.max()), -float((share * np.log(share)).sum()),
        sum(c for c in pairs.values() if c > 1) / p, max(pairs.values(), default=1) / p,
        len(set(lines)) / m, max(Counter(lines).values(), default=1) / m, math.log1p(float(sizes.mean())), float(sizes.std() / (1 + sizes.mean())), ends / m,
        len(words) / max(1, text.count(".")) / 50, -float((byte * np.log(byte)).sum()) if len(byte) else 0.0,
    ]


N_STATS = len(statistics(""))


def held_out(key) -> bool:
    return key is not None and zlib.crc32(str(int(key)).encode()) % 3 == 1


def document_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key_, stats_ array<float>) for every row, from its whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key_": b["key_"], "stats_": [np.array(statistics(x), np.float32) for x in b["text_"]]})

    return python_rows(docs.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("text_")), run, "key_ long, stats_ array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.w + self.phase) * math.sqrt(2 / self.w.shape[1])
        return np.hstack([z, x / math.sqrt(x.shape[1]), np.ones((len(x), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(np.nan_to_num(stats.astype(np.float64))) @ self.beta
        return np.clip(np.interp(raw, self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the rising step fit of y over x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of w*y, sum of w, least x, greatest x
    for a, b, c in zip(x[order], y[order], weight[order], strict=True):
        blocks.append([b * c, c, a, a])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, w, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], hi]
    knots, levels = [], []
    for s, w, lo, hi in blocks:
        knots += [lo] if lo == hi else [lo, hi]
        levels += [s / w] * (1 if lo == hi else 2)
    return np.array(knots), np.array(levels)


def fit(labelled: DataFrame, width: float = WIDTH, most: int = MOST_LABELLED) -> Model | None:
    """The model of ``labelled`` (key_, stats_ array<float>, label_ 0/1); None without rows of both labels.

    Summed over partitions: first counts, sums and squares, then for each fold Z'Z and Z'y. The driver gets
    SUM_TASKS * FOLDS matrices of under (D + N_STATS + 1)^2 numbers and, for calibration, out-of-fold scores counted on a grid of 4,096
    cells; none of it grows with the rows.
    """
    labelled = labelled.where("label_ in (0, 1) and key_ is not null").withColumn("order_", F.xxhash64("key_"))
    if labelled.count() > most:
        labelled = labelled.orderBy("order_", "key_").limit(most)
    rows = written(labelled.repartition(SUM_TASKS, "order_", "key_"), "labelled")
    rng = np.random.default_rng(SEED)
    w, phase = rng.normal(0, math.sqrt(2 * width), (N_STATS, D)), rng.uniform(0, 2 * math.pi, D)
    matrix = lambda b: np.nan_to_num(np.stack(b["stats_"]).astype(np.float64))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, N_STATS + 1))
        for b in batches:
            if len(b):
                x, y = matrix(b), b["label_"].to_numpy(float)
                total += np.stack([np.append(x.sum(0), y.sum()), np.append((x * x).sum(0), len(y))])
        yield pd.DataFrame({"sums": [total.ravel()]})

    parts = np.array([r["sums"] for r in rows.mapInPandas(moments, "sums array<double>").collect()])
    sums = parts.sum(0).reshape(2, -1)
    n, ones = sums[1, -1], sums[0, -1]
    if not 0 < ones < n:
        return None
    mean = sums[0, :-1] / n
    scale = np.sqrt(np.maximum(sums[1, :-1] / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), w, phase, np.zeros(D + N_STATS + 1), np.zeros(1), np.zeros(1))
    size, share = D + N_STATS + 1, ones / n
    balance = (0.5 / (1 - share), 0.5 / share)  # both labels weigh alike in the ridge fit; calibration undoes it

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, v = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for b in batches:
            for fold, part in b.groupby(b["order_"] % FOLDS):
                z, y = model.features(matrix(part)), part["label_"].to_numpy(float)
                g = np.where(y > 0.5, balance[1], balance[0])[:, None] * z
                a[fold] += g.T @ z
                v[fold] += g.T @ y
        for fold in range(FOLDS):
            yield pd.DataFrame({"fold": [fold], "a": [a[fold].tobytes()], "v": [v[fold].tobytes()]})

    a, v = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
    for r in rows.mapInPandas(normal, "fold int, a binary, v binary").toLocalIterator():
        a[r["fold"]] += np.frombuffer(r["a"]).reshape(size, size)
        v[r["fold"]] += np.frombuffer(r["v"])
    ridge = RIDGE * np.eye(size)
    ridge[-1, -1] = 1e-6
    solve = lambda keep: np.linalg.solve(sum(a[f] for f in keep) + ridge, sum(v[f] for f in keep))
    model.beta = solve(range(FOLDS))
    apart = np.stack([solve([f for f in range(FOLDS) if f != out]) if FOLDS > 1 else model.beta for out in range(FOLDS)])

    def unseen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                raw = (model.features(matrix(b)) * apart[(b["order_"] % FOLDS).to_numpy()]).sum(1)
                yield pd.DataFrame({"cell": np.clip(np.floor((raw + 0.5) * 2048), 0, 4095).astype(np.int64), "label": b["label_"].to_numpy(np.int64)})

    cells = rows.mapInPandas(unseen, "cell long, label long").groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("cell").collect()
    c, k, o = (np.array([r[i] for r in cells], dtype=float) for i in ("cell", "n", "ones"))
    model.knots, model.levels = isotonic((c + 0.5) / 2048 - 0.5, o / k, k)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learns: Callable[[object], bool] | None = None) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``; other columns play no part.

    The model is fitted on rows whose key has a 0/1 label in ``labels`` and isn't held out: crc32 of the key as text
    mod 3 is 1. Null and empty texts are scored like any other, from the statistics of ''. Rows with a null key are
    scored and not held out; repeated rows get equal scores; of several labels of one key each counts. Without labels
    of both kinds every score is 0.5 and predicted is 1. An empty table gives an empty one.
    """
    stats = written(document_statistics(docs, key, text), "statistics")
    apart = F.coalesce(F.pmod(F.crc32(F.col("key_").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    known = labels.select(F.col(key).cast("long").alias("key_"), F.col(label).cast("int").alias("label_"))
    model = fit(stats.where(~apart).join(known, "key_"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = sent.value
                x = np.stack(b.pop("stats_"))
                yield b.assign(score=m.score(x) if m else np.full(len(x), 0.5))

    out = python_rows(stats.select("key_", apart.alias("held_out"), "stats_"), run, "key_ long, held_out boolean, score double")
    return out.select(F.col("key_").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all columns stay. Rows with a null key stay."""
    bad = written(quality_scores(docs, labels, key=key, **how).where("predicted = 0").select(key).distinct(), "rejected")
    return without(docs, bad, key)
