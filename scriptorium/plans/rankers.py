"""A caller's own ranking as a table function of SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# What a ranker is given of each hit, and what comes back of it.
FIELDS = ("query_id", "rank", "file_path", "chunk_index", "category", "score")
Ranker = Callable[[list[dict]], Iterable[dict]]


def register_ranker(spark: SparkSession, name: str, rank: Ranker, id_type: str = "bigint") -> None:
    """Make ``rank`` callable in SQL as ``name(TABLE(hits) PARTITION BY query_id ORDER BY rank)``.

    ``rank`` gets the hits of one query, best first, as mappings of FIELDS, and returns those
    it keeps in its own order.  A query's hits are its bounded candidate list, so holding
    them is safe; queries are ranked side by side.
    """

    class Rerank:
        def __init__(self) -> None:
            self.hits: list[dict] = []

        def eval(self, row) -> None:
            self.hits.append({field: row[field] for field in FIELDS})

        def terminate(self):
            for place, hit in enumerate(rank(self.hits), 1):
                yield hit["query_id"], place, hit["file_path"], hit["chunk_index"], hit["category"], hit["score"]

    returned = f"query_id {id_type}, rank bigint, file_path string, chunk_index int, category string, score double"
    spark.udtf.register(name, udtf(Rerank, returnType=returned))


def one_of_each_category(hits: list[dict]) -> list[dict]:
    """The best hit of every category first, then every category's second, and so on."""
    seen: dict = {}
    turns = []
    for place, hit in enumerate(hits):
        turn = seen.get(hit["category"], 0)
        seen[hit["category"]] = turn + 1
        turns.append((turn, place))
    return [hits[place] for _, place in sorted(turns)]
