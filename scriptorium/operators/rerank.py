"""Steps after retrieval: rerank, diversify, collapse, highlight, preview.

They work on the bounded candidate list of each query (at most the candidate
pool), so a group is small whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import preview
from scriptorium.operators.headline import snippets as highlight  # noqa: F401
from scriptorium.operators.ranking import top_k
from scriptorium.operators.vector import unit_rows


def mmr_order(query: np.ndarray, docs: np.ndarray, lambda_: float) -> list[int]:
    """Greedy maximal marginal relevance (Carbonell and Goldstein, 1998).

    Returns positions in their new order; the order stays as it is when
    ``lambda_`` is not strictly between 0 and 1, with fewer than two documents,
    or for a zero query.
    """
    n = len(docs)
    if not 0.0 < lambda_ < 1.0 or n <= 1 or not np.any(query):
        return list(range(n))
    docs = unit_rows(docs)
    relevance = docs @ (query / np.linalg.norm(query))
    picked = [int(np.argmax(relevance))]
    nearest = docs @ docs[picked[0]]
    open_ = np.ones(n, dtype=bool)
    open_[picked[0]] = False
    while open_.any():
        value = np.where(open_, lambda_ * relevance - (1.0 - lambda_) * nearest, -np.inf)
        best = int(np.argmax(value))
        picked.append(best)
        open_[best] = False
        nearest = np.maximum(nearest, docs @ docs[best])
    return picked


def diversify(hits: DataFrame, queries: DataFrame, vectors: DataFrame, lambda_: float) -> DataFrame:
    """Re-rank the candidates of each query for relevance and diversity.

    A query with a candidate that has no vector keeps its order.
    """
    if not 0.0 < lambda_ < 1.0:
        return hits
    keyed = hits.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left").join(
        queries.select("query_id", "query_embedding"), "query_id", "left"
    )
    columns = [f.name for f in hits.schema.fields]

    def reorder(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        query = group["query_embedding"].iloc[0]
        if query is not None and all(v is not None and len(v) == len(query) for v in group["embedding"]):
            docs = np.vstack([np.asarray(v, dtype=np.float64) for v in group["embedding"]])
            group = group.iloc[mmr_order(np.asarray(query, dtype=np.float64), docs, lambda_)]
        return group[columns].assign(rank=np.arange(1, len(group) + 1, dtype=np.int32))

    # A group is one query's candidates, at most the candidate pool.
    return keyed.groupBy("query_id").applyInPandas(reorder, hits.schema)


def rerank(
    hits: DataFrame,
    queries: DataFrame,
    score_pairs: Callable[[list[str], list[str]], list[float]],
    top: int | None = None,
) -> DataFrame:
    """Order the candidates by a pair scorer; its logits become probabilities.

    ``score_pairs(queries, passages)`` runs batch-wise on the executors.
    """
    pairs = hits.join(queries.select("query_id", F.col("query").alias("asked")), "query_id")
    schema = T.StructType([f for f in pairs.schema.fields if f.name != "asked"] + [T.StructField("logit", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            logits = score_pairs(batch["asked"].tolist(), batch["content"].fillna("").tolist())
            yield batch.drop(columns="asked").assign(logit=np.asarray(logits, dtype=float))

    scored = pairs.mapInPandas(score, schema).withColumnRenamed("rank", "found")
    ranked = top_k(scored, ["query_id"], [F.col("logit").desc(), F.col("found")], top or 2**31 - 1)
    probability = F.round(1.0 / (1.0 + F.exp(-F.col("logit"))), 4)
    return ranked.withColumn("rerank_score", probability).drop("logit", "found")


def collapse_by_document(hits: DataFrame) -> DataFrame:
    """Keep the best hit of each document; hits without a path go."""
    kept = top_k(
        hits.filter(F.col("file_path").isNotNull()).withColumnRenamed("rank", "found"),
        ["query_id", "file_path"],
        [F.col("found")],
        1,
        "first",
    )
    return top_k(kept.drop("first"), ["query_id"], [F.col("found")], 2**31 - 1).drop("found")


def truncate(hits: DataFrame, limit: int) -> DataFrame:
    return hits.filter(F.col("rank") <= limit)


def format_hits(hits: DataFrame, chars: int = 200) -> DataFrame:
    """The shape callers see: a preview of the content and a short score."""
    highlight = F.col("highlight") if "highlight" in hits.columns else F.lit(None).cast("string")
    return hits.select(
        "query_id",
        "rank",
        "file_path",
        "title",
        preview(F.col("content"), chars).alias("content_preview"),
        F.round("score", 4).alias("score"),
        F.when(highlight != "", highlight).alias("highlight"),
    )
