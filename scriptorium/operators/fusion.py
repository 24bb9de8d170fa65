"""Hybrid search: reciprocal-rank fusion, and the linear blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import EngineConfig
from scriptorium.operators import blockmax
from scriptorium.operators.blockmax import BlockIndex
from scriptorium.operators.index import TextIndex, with_chunk_id
from scriptorium.operators.keyword import attach_chunks, bounded_queries, keyword_search, ts_rank_scores
from scriptorium.operators.ranking import SCORE_DIGITS, score_order, top_k
from scriptorium.operators.vector import cosine, nearest_scores

DEFAULTS = EngineConfig()
# Over-fetch of each arm, and the blend (fixed values).
ARM_FACTOR, ARM_FLOOR = 4, 20
TEXT_SHARE, VECTOR_SHARE, MAX_DISTANCE = 0.4, 0.6, 0.8


def fuse_ranks(keyword: DataFrame, semantic: DataFrame, k: int, rrf_k: int = 60, columns: tuple[str, ...] = ()) -> DataFrame:
    """Merge two ranked frames of (query_id, key, rank) by the sum of 1/(rrf_k + rank).

    A key that occurs twice in one list counts with its last rank.  Equal sums
    are ordered by the greater key.  ``columns`` come along from the keyword
    list when it has the key; each list is evaluated once.
    """
    carried = ["query_id", "key", "rank", *columns]
    both = keyword.select(*carried, F.lit(0).alias("arm")).unionByName(semantic.select(*carried, F.lit(1).alias("arm")))

    def share(arm: int) -> Column:
        return F.coalesce(1.0 / (rrf_k + F.max(F.when(F.col("arm") == arm, F.col("rank")))), F.lit(0.0))

    place = F.struct("arm", -F.col("rank"))
    merged = both.groupBy("query_id", "key").agg(
        (share(0) + share(1)).alias("score"), *[F.min_by(c, place).alias(c) for c in columns]
    )
    return top_k(merged, ["query_id"], [F.col("score").desc(), F.col("key").desc()], k)


def _with_key(hits: DataFrame) -> DataFrame:
    place = F.lpad(F.col("chunk_index").cast("string"), 10, "0")
    return hits.withColumn("key", F.concat_ws(":", "file_path", place))


def hybrid_rrf(
    index: TextIndex | BlockIndex,
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    config: EngineConfig = DEFAULTS,
) -> DataFrame:
    """Keyword and vector arm, fused by rank.

    A hit is its chunk.  Both arms are cut after the category of the query has
    filtered them.  From a block index pairs of query and chunk are not shuffled.
    """
    arm = max(k * ARM_FACTOR, ARM_FLOOR)
    queries, small = bounded_queries(queries, 2 * arm, config)
    if isinstance(index, BlockIndex):
        found = blockmax.search(index, queries, arm, config).select("query_id", "chunk_id", "score", "rank")
        keyword = attach_chunks(found, chunks, small)
    else:
        keyword = keyword_search(index, queries, chunks, arm, config)
    nearest = nearest_scores(queries, vectors, arm, config, within_category=True)
    if "bucket" in vectors.columns:
        places = with_chunk_id(vectors).select("chunk_id", "bucket")
        nearest = places.join(F.broadcast(nearest) if small else nearest, "chunk_id")
    semantic = attach_chunks(nearest.withColumnRenamed("rank", "fetched"), chunks, small)
    semantic = top_k(semantic, ["query_id"], [F.col("fetched")], arm).drop("fetched")
    columns = ("chunk_id", "file_path", "chunk_index", "title", "content", "category")
    return fuse_ranks(_with_key(keyword), _with_key(semantic), k, config.rrf_k, columns).drop("key")


def hybrid_linear(
    index: TextIndex | BlockIndex,
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    config: EngineConfig = DEFAULTS,
) -> DataFrame:
    """0.4 text rank + 0.6 cosine, over text matches and near vectors.

    From a block index every shard blends the scores of its own chunks, whose vectors come to
    it, and pairs of query and chunk are not shuffled.  From a row-wise index: outside the text
    matches the blend only falls with the cosine, so the ``k`` nearest vectors are enough to
    find every hit of the result.
    """
    queries, small = bounded_queries(queries, k, config)
    if isinstance(index, BlockIndex):
        blend = blockmax.Blend(TEXT_SHARE, VECTOR_SHARE, MAX_DISTANCE)
        found = blockmax.search(index, queries, k, config, "ts_rank", vectors=vectors, blend=blend)
        return attach_chunks(found.select("query_id", "chunk_id", "score", "rank"), chunks, small)
    stored = with_chunk_id(vectors).select("chunk_id", "embedding")
    text = ts_rank_scores(index, queries, chunks, config).drop("bucket").withColumnRenamed("score", "text_score")
    asked = queries.select("query_id", "query_embedding")
    pairs = text.join(stored, "chunk_id", "left").join(F.broadcast(asked) if small else asked, "query_id")
    # Only pairs with a stored vector carry the query's vector to the cosine.
    asked_vector = F.when(F.col("embedding").isNotNull(), F.col("query_embedding"))
    by_text = pairs.select("query_id", "chunk_id", "text_score", cosine(asked_vector, F.col("embedding")).alias("cos"))
    near = nearest_scores(queries, vectors, k, config, within_category=True).filter(1.0 - F.col("score") < MAX_DISTANCE)
    by_vector = near.select("query_id", "chunk_id", F.lit(0.0).alias("text_score"), F.col("score").alias("cos"))
    both = by_text.unionByName(by_vector).groupBy("query_id", "chunk_id").agg(
        F.max("text_score").alias("text_score"), F.max(F.round("cos", SCORE_DIGITS)).alias("cos")
    )
    blend = F.when(
        F.col("cos").isNotNull(), TEXT_SHARE * F.col("text_score") + VECTOR_SHARE * F.col("cos")
    ).otherwise(F.col("text_score"))
    scored = both.select("query_id", "chunk_id", F.round(blend, SCORE_DIGITS).alias("score"))
    return attach_chunks(top_k(scored, ["query_id"], score_order(), k), chunks, small)
