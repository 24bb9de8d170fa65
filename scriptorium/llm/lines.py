"""Substring deduplication by hashing text units: sentences, lines or paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from scriptorium.llm.common import same, small_batches, text_of

# Where one unit ends and the next begins.
BREAKS = {"sentence": r"\n+|(?<=[.!?])\x20+", "line": r"\n+", "paragraph": r"\n[ \t]*\n\s*"}
MIN_WORDS = 5
HALF = (1 << 64) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def unit_spans(text: str, unit: str = "sentence", min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int]]:
    """(start, end, digest): the units of a text with at least ``min_words`` words.

    Offsets are code points.  The digest is of the unit with A-Z lower-cased and
    each run of ASCII white space as one space.
    """
    at = 0
    for start, end in [*(m.span() for m in re.finditer(BREAKS[unit], text)), (len(text), len(text))]:
        words = text[at:start].encode("utf-8", "surrogatepass").lower().split()
        if len(words) >= min_words:
            yield at, start, xxh3_128_intdigest(b" ".join(words))
        at = end


def units(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, d1, d2): one row per unit, with its 128-bit digest in two halves."""
    rows = small_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")))
    names = ["doc_id", "start", "end", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (doc_id, start, end, _signed(digest >> 64), _signed(digest & HALF))
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                for start, end, digest in unit_spans(text.as_py(), unit, min_words)
            ]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return rows.mapInArrow(run, "doc_id long, start long, end long, d1 long, d2 long")


def repeated_units(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, first_doc_id, first_start): every unit to remove.

    Units are equal when their digests are.  The earliest occurrence by (doc_id,
    start) stays; all others are rows here, with the offsets of the original text
    and those of the occurrence that stays.  A null doc_id ranks last.  Rows that
    repeat doc_id and text are one document; null text counts as empty; units of
    fewer than ``min_words`` words always stay.  An empty table gives no rows.
    """
    found = units(docs, unit, min_words)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    # Partial sums meet in the exchange: a unit that many documents share is few rows there.
    firsts = (
        found.groupBy("d1", "d2")
        .agg(F.count("*").alias("n"), F.min(rank).alias("first"))
        .where("n > 1")
        .select(F.col("d1").alias("f1"), F.col("d2").alias("f2"), "first")
    )
    met = found.join(firsts, (F.col("d1") == F.col("f1")) & (F.col("d2") == F.col("f2")))
    is_first = same(F.col("doc_id"), F.col("first.doc_id")) & (F.col("start") == F.col("first.start"))
    return met.where(~is_first).select(
        "doc_id", "start", "end", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")
    )


def remove_repeats(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, removed): the texts without their repeated units, and the spans taken out.

    ``removed`` are (start, end) of the original text in order.  Breaks between
    units stay.  Documents are told apart by doc_id.
    """
    spans = repeated_units(docs, unit, min_words).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))
    spans = spans.withColumnRenamed("doc_id", "of")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    met = rows.join(spans, same(rows["doc_id"], spans["of"]), "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start:long,end:long>>")))
    gap_starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("removed", lambda r: r.getField("end")))
    gap_ends = F.concat(F.transform("removed", lambda r: r.getField("start")), F.array(F.char_length("text").cast("long")))
    kept = F.zip_with(
        gap_starts, gap_ends, lambda a, b: F.substr(F.col("text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    )
    return met.select("doc_id", F.array_join(kept, "").alias("text"), "removed")
