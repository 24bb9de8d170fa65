"""Exact deduplication: sorted digest runs, merged as a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import lower_ascii, same, text_of, written

# log2 of the runs that one round merges into one.
FAN_IN_BITS = 4
KEY = ("sha", "n_bytes", "proof")


def digest_rows(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text_key, sha, n_bytes, proof), written: one row per document.

    ``sha`` is SHA-256 of the text with A-Z lower-cased.  Length and a second,
    unrelated hash of the same bytes stand beside it as proof: only rows that
    agree in all three count as equal, at every level.  ``uid`` numbers the rows,
    its high bits the partition that they came from; it is fixed by the write.
    """
    text = text_of(docs)
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        docs["doc_id"].cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        lower_ascii(text).alias("plain"),
    )
    return written(
        rows.select(
            "uid",
            "doc_id",
            "text_key",
            F.unhex(F.sha2("plain", 256)).alias("sha"),
            F.octet_length("plain").cast("long").alias("n_bytes"),
            F.xxhash64("plain").alias("proof"),
        ),
        "digests",
    )


def merge_runs(rows: DataFrame, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """(sha, n_bytes, proof, keep, group_size) with one row per distinct text.

    A run is what one partition holds of each text: its largest (doc_id, uid) and
    its row count.  In every round 2^fan_in_bits neighbouring runs meet and are
    merged, text by text.  A text's rows are added up before each exchange, and a
    round is dealt by run and digest, so neither a run nor a text that many rows
    share becomes one task's load.
    """
    run = F.shiftright("uid", 33)
    last = rows.agg(F.max(run)).first()[0]
    if last is None:
        last = 0
    merged = rows.select(run.alias("run"), *KEY, F.struct("doc_id", "uid").alias("keep"), F.lit(1).cast("long").alias("group_size"))
    while True:
        merged = (
            merged.withColumn("run", F.shiftright("run", fan_in_bits))
            .groupBy("run", *KEY)
            .agg(F.max("keep").alias("keep"), F.sum("group_size").alias("group_size"))
            .sortWithinPartitions("run", *KEY)
        )
        last >>= fan_in_bits
        if last == 0:
            return merged.drop("run")


def exact_groups(docs: DataFrame, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """(doc_id, text_key, keep_id, group_size, kept, text_sha256): one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest doc_id stays; rows that repeat that
    doc_id too are one tie, of which exactly one stays.  A null doc_id is smaller
    than any number.  An empty table gives an empty result.
    """
    rows = digest_rows(docs)
    groups = merge_runs(rows, fan_in_bits).select(*[F.col(c).alias(f"of_{c}") for c in KEY], "keep", "group_size")
    met = rows.join(groups, [rows[c] == groups[f"of_{c}"] for c in KEY])
    return met.select(
        "doc_id",
        "text_key",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("keep.uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_unique(docs: DataFrame, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """The documents, all columns, with one row of each distinct text."""
    groups = written(exact_groups(docs, fan_in_bits).select("doc_id", "text_key", "kept"), "exact")
    kept = groups.where("kept").select("doc_id", "text_key")
    match = same(docs["doc_id"].cast("long"), kept["doc_id"]) & (F.xxhash64(text_of(docs)) == kept["text_key"])
    out = docs.join(kept, match, "left_semi")
    # Rows that repeat doc_id and text alike pass the join together: part them, where there are any.
    ties = groups.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("kept AND n > 1")
    if ties.isEmpty():
        return out
    ties = ties.select("doc_id", "text_key")
    among = same(out["doc_id"].cast("long"), ties["doc_id"]) & (F.xxhash64(text_of(out)) == ties["text_key"])
    # Null and empty texts are equal here too.
    tied = out.join(ties, among, "left_semi").withColumn("_text", text_of(out)).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return out.join(ties, among, "left_anti").union(tied)
