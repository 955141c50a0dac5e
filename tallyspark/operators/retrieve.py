"""Exact retrieval by inner product over unit vectors, page roll-ups, context assembly and ranking metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunk import preprocess

#: Queries that one pass over the corpus scores; more are taken in several passes.
QUERY_BLOCK = 4096
#: Queries and rows of which a task holds the scores at a time: 4 MiB.
TILE = (256, 2048)


def normalised(v: Column) -> Column:
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: F.try_divide(x, norm))


def view(corpus: DataFrame, kind: str = "text", encode: Callable[[Column], Column] | None = None) -> DataFrame:
    """The chunk corpus as a retriever reads it: (chunk_id, text), (chunk_id, tokens), or (chunk_id, embedding) by ``encode``."""
    text = F.col("text_description")
    if kind in ("text", "raw"):
        return corpus.select("chunk_id", text.alias("text"))
    if kind in ("tokens", "bm25"):
        return corpus.select("chunk_id", preprocess(text).alias("tokens"))
    if kind != "dense":
        raise ValueError(f"no view of kind {kind}")
    if encode is None:
        raise ValueError("the dense view needs encode")
    return corpus.select("chunk_id", encode(text).alias("embedding"))


def unit(v: pd.Series) -> np.ndarray:
    m = np.array(v.tolist(), np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def best_rows(batches: Iterator[pd.DataFrame], ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """(q_, k_, score): a task's k best rows (k_, v_) of each query. It holds them and one tile of scores, whatever the rows
    and queries are; a row that isn't among a query's k best so far is dropped by its score alone."""
    held = [(np.zeros(0, np.int64), None, np.zeros(0)) for _ in range(0, len(ids), TILE[0])]  # of each tile's queries: query, key, score
    least = np.full(len(ids), -np.inf)  # the k-th best score so far
    for p in batches:
        for at in range(0, len(p), TILE[1]):
            piece = p[at : at + TILE[1]]
            u, keys = unit(piece["v_"]).T, piece["k_"].to_numpy()
            for t, (query, key, score) in enumerate(held):
                lo = t * TILE[0]
                bound = least[lo : lo + TILE[0]]
                s = q[lo : lo + TILE[0]] @ u
                keep = ~(s < (bound - 1e-11)[:, None])  # more than rounding changes; NaN stays
                if keep.sum() > 4 * k * len(s) and s.shape[1] > k:
                    with np.errstate(invalid="ignore"):
                        keep &= ~(s < (np.partition(s, -k, axis=1)[:, -k] - 1e-11)[:, None])  # NaN sorts last, as the greatest
                i, j = np.nonzero(keep)
                if not len(i):
                    continue
                query, key, score = np.concatenate([query, i]), keys[j] if key is None else np.concatenate([key, keys[j]]), np.concatenate([score, np.round(s[i, j], 12)])
                order = np.lexsort((key, np.where(np.isnan(score), -np.inf, -score), query))
                query, key, score = query[order], key[order], score[order]
                nth = np.arange(len(query)) - np.searchsorted(query, query)
                last = nth == k - 1
                bound[query[last]] = np.where(np.isnan(score[last]), np.inf, score[last])
                held[t] = query[nth < k], key[nth < k], score[nth < k]
    for t, (query, key, score) in enumerate(held):
        if len(query):
            yield pd.DataFrame({"q_": ids[t * TILE[0] + query], "k_": key, "score": score})


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 3, key: str = "vec_id", qid: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(qid, rank, key, score): the k greatest inner products of unit vectors, ties to the smaller key; score rounded to 6.

    Ranks go by the score to 12 digits, which leaves out what the order of a sum changes.

    A block of at most QUERY_BLOCK queries goes to the tasks as one matrix; each task keeps k rows a query, so what is
    shuffled is k rows a query and task. Scores are held for a tile of queries and rows at a time. Null vectors take no part.
    """
    spark = corpus.sparkSession
    width = corpus.schema[key].dataType.simpleString()
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(key).alias("k_"), F.col(vector).alias("v_"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(qid).alias("q_"), F.col(vector).alias("v_"))
    n = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for b in range(n):
        part = asked.where(F.pmod(F.xxhash64("q_"), F.lit(n)) == b).toPandas()
        if not len(part):
            continue
        sent = spark.sparkContext.broadcast((part["q_"].to_numpy(), unit(part["v_"])))
        one = rows.mapInPandas(lambda batches, sent=sent: best_rows(batches, *sent.value, k), f"q_ {queries.schema[qid].dataType.simpleString()}, k_ {width}, score double")
        out = one if out is None else out.unionAll(one)
    if out is None:
        return spark.createDataFrame([], f"{qid} long, rank int, {key} {width}, score double")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("q_").orderBy(F.desc("score"), "k_"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q_").alias(qid), "rank", F.col("k_").alias(key), F.round("score", 6).alias("score"))


def page_of(image: Column) -> Column:
    """The page of an image file's name: up to the first dot."""
    return F.split_part(image, F.lit("."), F.lit(1))


def page_scores(scores: DataFrame, how: str = "max", qid: str = "query_id", page: str = "page", digits: int | None = 5) -> DataFrame:
    mean = lambda c: F.sum(c).cast("double") / F.count(c)
    f = {"max": F.max, "mean": mean, "sum": F.sum}[how]("score")
    return scores.where(F.col(page).isNotNull()).groupBy(qid, page).agg((f if digits is None else F.round(f, digits)).alias("score"))


def context(found: DataFrame, text: str = "text", qid: str = "query_id") -> DataFrame:
    """(qid, context): the found chunks in order of rank, each under its heading."""
    part = F.concat(F.lit("--- Chunk "), F.col("rank").cast("string"), F.lit(" ---\n"), F.col(text))
    return found.groupBy(qid).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))


def instruct(task: str, query: Column) -> Column:
    return F.format_string("Instruct: %s\nQuery: %s", F.lit(task), query)


def ir_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(metric, k, value): means over the judged queries of nDCG, P, Recall and AP at k, RR and Rprec (k = 0).

    ``run`` (query_id, doc_id, score), ``qrels`` (query_id, doc_id, rel). Ties go to the smaller document.
    """
    good = qrels.where("rel > 0")
    n_rel = good.groupBy("query_id").agg(F.count("*").alias("n_rel"), F.sort_array(F.collect_list(F.col("rel").cast("double")), asc=False).alias("ideal"))
    return _metrics(_ranked(run).join(good, ["query_id", "doc_id"]), n_rel, ks)


def ir_metrics_by_label(run: DataFrame, queries: DataFrame, docs: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``ir_metrics`` where all documents (doc_id, label) of a query's label (query_id, label) are relevant, once each: they are counted by
    label, and the pairs, which grow with the square of the documents, aren't made."""
    sizes = docs.groupBy("label").agg(F.count("*").alias("n"))
    n_rel = queries.join(sizes, "label").groupBy("query_id").agg(F.sum("n").alias("n_rel"))
    n_rel = n_rel.withColumn("ideal", F.array_repeat(F.lit(1.0), F.least("n_rel", F.lit(max(ks))).cast("int")))
    found = _ranked(run).join(queries, "query_id").join(docs, ["doc_id", "label"]).withColumn("rel", F.lit(1))
    return _metrics(found, n_rel, ks)


def _ranked(run: DataFrame) -> DataFrame:
    return run.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def _metrics(found: DataFrame, n_rel: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """From the relevant ones among the ranked rows (query_id, r, rel), and each judged query's (query_id, n_rel, ideal)."""
    ranked = found.withColumn("hits", F.row_number().over(Window.partitionBy("query_id").orderBy("r")))
    dcg = lambda k: F.sum(F.when(F.col("r") <= k, F.col("rel") / F.log2(F.col("r") + 1)))
    hit = lambda k: F.sum(F.when(F.col("r") <= k, 1.0))
    ap = lambda k: F.sum(F.when(F.col("r") <= k, F.col("hits") / F.col("r")))
    per = ranked.join(n_rel.select("query_id", "n_rel"), "query_id").groupBy("query_id").agg(
        F.min("r").alias("first"), F.sum(F.when(F.col("r") <= F.col("n_rel"), 1.0)).alias("rp"), *(f(k).alias(f"{n}{k}") for k in ks for n, f in (("d", dcg), ("h", hit), ("a", ap)))
    )
    all_ = n_rel.join(per, "query_id", "left")
    ideal = lambda k: F.aggregate(F.transform(F.slice("ideal", 1, k), lambda x, i: x / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    means = [("RR", 0, zero(1.0 / F.col("first"))), ("Rprec", 0, zero(F.col("rp") / F.col("n_rel")))]
    for k in ks:
        means += [("nDCG", k, zero(F.col(f"d{k}") / ideal(k))), ("P", k, zero(F.col(f"h{k}") / k)), ("R", k, zero(F.col(f"h{k}") / F.col("n_rel"))), ("AP", k, zero(F.col(f"a{k}") / F.col("n_rel")))]
    one = all_.agg(*(F.round(F.avg(c), 6).alias(f"m{i}") for i, (_, _, c) in enumerate(means)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.lit(k).alias("k"), F.col(f"m{i}").alias("value")) for i, (n, k, _) in enumerate(means)))).alias("x")).select("x.*")
