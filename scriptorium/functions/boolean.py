"""The query language of the English ranker: quotes, ``or`` and a leading minus.

A query is alternatives joined by ``or``; an alternative is literals that all have to hold.
A literal is a word or a quoted phrase, negated by a minus before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import Analyzer

# A quoted stretch (the last may lack its closing quote) or a run without blanks.
LITERAL = r'-?"[^"]*"?|\S+'


def or_query(query: Column) -> Column:
    """The words of a query as alternatives; one word, or none, stays as it is."""
    words = F.array_remove(F.split(query, r"\s+"), "")
    return F.when(F.size(words) <= 1, query).otherwise(F.array_join(words, " or "))


def literals(query: Column) -> Column:
    """Array of (alternative, negated, body) in order; blanks and lone marks give no terms later."""
    tokens = F.regexp_extract_all(query, F.lit(LITERAL), 0)

    def is_or(token: Column) -> Column:
        return F.lower(token) == "or"

    numbered = F.transform(
        tokens,
        lambda t, i: F.struct(
            F.size(F.filter(F.slice(tokens, F.lit(1), i), is_or)).alias("alternative"),
            t.startswith("-").alias("negated"),
            F.when(~is_or(t), F.regexp_replace(t, '^-', "")).alias("body"),
        ),
    )
    return F.filter(numbered, lambda x: x["body"].isNotNull())


def query_literals(queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(query_id, wanted, alternative, negated, phrase, terms, qtf): one row per distinct literal.

    A literal whose words are all stop words says nothing and is left out, and so is an
    alternative without literals.
    """
    split = queries.select("query_id", "wanted", F.explode(literals(F.col("query"))).alias("l")).select("query_id", "wanted", "l.*")
    analysed = split.select("query_id", "wanted", "alternative", "negated", analyzer.terms(F.col("body")).alias("terms"))
    phrase = F.array_join("terms", " ").alias("phrase")
    counted = analysed.filter(F.size("terms") > 0).groupBy("query_id", "wanted", "alternative", "negated", phrase)
    return counted.agg(F.count(F.lit(1)).alias("qtf")).withColumn("terms", F.split("phrase", " "))
