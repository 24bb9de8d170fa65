"""The registered queries of this folder, over whole tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import (
    exact,
    fingerprints,
    huffman,
    language,
    lines,
    mixing,
    packing,
    quality,
    secrets,
    simhash,
    spelling,
    tokens,
    whitening,
)
from scriptorium.llm.common import documents, held_out

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir), radius=3, width=3, blocking="masks")
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_fingerprints(documents(spark, sf_dir))
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.hex_of(F.col("packed")).alias("fingerprint"),
        fingerprints.hex_of(F.col("edited_packed")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(documents(spark, sf_dir))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir)).drop("text_key")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(plain) AS text_sha256
FROM (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS plain
  FROM documents
)
WINDOW g AS (PARTITION BY plain)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_units(documents(spark, sf_dir), unit="sentence", min_words=5)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), limit=512)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("text_key")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[F.size(secrets.of_kinds(spans, (kind,))).cast("long").alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.written_out(secrets.of_kinds(spans, secrets.BASE_KINDS)), 256).alias("base_sha256"),
        secrets.written_out(spans).alias("spans"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, documents(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), window=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(documents(spark, sf_dir, "embeddings"), components=4)


def op13_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.written_tokens(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_output": op13_token_output,
}
ORACLES: dict[str, str] = {"op4_exact_dedup": OP4_SQL}
