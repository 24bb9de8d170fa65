"""Document fingerprints: one-permutation MinHash, densified, packed to low-order bits.

Everything here is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import same, text_of, written

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
PACKED_BITS = 8
PER_WORD = 64 // PACKED_BITS
# Direct probes for an empty bin before the exhaustive one.
PROBES = 8
SPACE = " \t\n\x0b\f\r"
SPACES = "[ \\t-\\r]+"


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def with_fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with the packed fingerprint of column ``text`` as array<long> ``to``.

    Every shingle of five words (A-Z and other letters lower-cased; the whole
    sequence if there are fewer) is hashed once.  The top bits of a hash choose its
    bin, and each bin keeps its smallest hash.  An empty bin takes the value of
    another one: it tries bins in an order that depends on its own number alone,
    so that two documents with the same filled bins borrow alike.  The first
    attempts are single probes; if all fail, the filled bin that comes first in
    a random order of the bins is taken.  Of each bin the low ``PACKED_BITS`` bits
    are kept.  A text without words has a null fingerprint.

    Each step is a column of its own and used more than once, so the optimiser
    keeps the steps apart instead of repeating one inside a lambda.
    """
    words, hashes, least, bins, slots, filled = (f"{to}_{x}" for x in ("words", "hashes", "least", "bins", "slots", "filled"))
    kept = list(df.columns)
    bare = F.trim(F.lower(F.col(text)), F.lit(SPACE))
    out = df.withColumn(words, F.when(bare != "", F.split(bare, SPACES)))
    out = out.select(*kept, words).withColumn(
        hashes,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))),
                lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(SHINGLE)]),
            )
        ),
    )
    out = out.select(*kept, F.when(F.col(words).isNotNull(), F.col(hashes)).alias(hashes))
    out = out.withColumn(
        least, F.filter(F.col(hashes), lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(F.col(hashes), i - 1))))
    ).select(*kept, least)
    out = out.withColumn(bins, F.transform(F.col(least), _bin))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))
    out = out.withColumn(
        slots,
        F.when(
            F.size(bins) > 0,
            F.transform(numbers, lambda j: F.get(F.col(least), (F.array_position(F.col(bins), j) - 1).cast("int"))),
        ),
    )

    def fill(value: Column, j: Column) -> Column:
        probes = [F.get(F.col(slots), F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        ranked = F.transform(F.col(least), lambda h: F.struct(F.xxhash64(j.cast("long"), _bin(h)).alias("at"), h.alias("h")))
        return F.coalesce(value, *probes, F.array_min(ranked).getField("h"))

    out = out.select(*kept, least, slots).withColumn(filled, F.transform(F.col(slots), fill)).select(*kept, filled)

    def pack(word: int) -> Column:
        low = (1 << PACKED_BITS) - 1
        parts = [
            F.shiftleft(F.get(F.col(filled), F.lit(word * PER_WORD + k)).bitwiseAND(low), PACKED_BITS * k)
            for k in range(PER_WORD)
        ]
        total = parts[0]
        for part in parts[1:]:
            total = total.bitwiseOR(part)
        return total

    packed = F.when(F.col(filled).isNotNull(), F.array(*[pack(w) for w in range(BINS // PER_WORD)]))
    return out.select(*kept, packed.alias(to))


def hex_of(packed: Column) -> Column:
    """The packed fingerprint as hex digits; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1.

    Unequal bins agree in their low bits by chance in 2^-bits of the cases; the
    estimate is corrected for it.  Two texts without words are alike (1), one
    without and one with words are not (0).
    """
    low = (1 << PACKED_BITS) - 1

    def agreeing(word: Column) -> Column:
        parts = [
            F.when(F.shiftrightunsigned(word, PACKED_BITS * k).bitwiseAND(low) == 0, 1).otherwise(0) for k in range(PER_WORD)
        ]
        return sum(parts[1:], parts[0])

    xored = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    equal = F.aggregate(xored, F.lit(0), lambda n, w: n + agreeing(w))
    chance = 2.0**-PACKED_BITS
    estimate = F.greatest(F.lit(0.0), (equal / float(BINS) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(estimate)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): the packed fingerprint of every whole text."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return with_fingerprint(rows, "text", "fingerprint").drop("text")


def successors(rows: DataFrame) -> DataFrame:
    """(id, next_id, copies, need), written: for each distinct doc_id the next one.

    ``rows`` is (doc_id, n_chars).  Ids are dealt by range, so that successors are
    neighbours inside a partition; only the first id of each partition crosses.
    The last id is followed by the first; null comes before all numbers.
    """
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("copies"), F.max(F.floor(F.col("n_chars") / 2)).alias("need"))
    dealt = ids.repartitionByRange("doc_id").select("doc_id", "copies", "need", F.spark_partition_id().alias("part"))
    dealt = written(dealt.withColumn("id", F.struct("doc_id")), "ids")
    # One row for each partition: its number bounds this table.
    firsts = dealt.groupBy("part").agg(F.min("id").alias("first"))
    everywhere = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(everywhere), F.min("first").over(whole)).alias("following"))
    within = Window.partitionBy("part").orderBy("doc_id")
    chained = dealt.withColumn("inside", F.lead("id").over(within)).join(firsts, "part")
    follower = F.coalesce("inside", "following").getField("doc_id")
    return written(chained.select(F.col("doc_id").alias("id"), follower.alias("next_id"), "copies", "need"), "successors")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and the document that follows it.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's.  Columns: doc_id, n_chars,
    edited_sha256, packed, edited_packed, near_edited, near_next.

    Null text counts as empty.  Rows that repeat a doc_id have one place in the
    order: the next document of all of them is the next doc_id's smallest text.
    A single document follows itself.  An empty table gives an empty result.
    """
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    after = successors(rows.select("doc_id", F.char_length("text").alias("n_chars")))
    heads = rows.join(after, same(rows["doc_id"], after["next_id"])).select(
        F.col("id").alias("of"),
        F.col("next_id"),
        F.xxhash64("text").alias("next_key"),
        F.expr("left(text, CAST(need AS INT))").alias("head"),
        "text",
    )
    repeated = after.where("copies > 1")
    if repeated.isEmpty():
        heads = heads.drop("text")
    else:
        first = F.min(F.struct("text", "next_key", "head")).alias("first")
        heads = heads.groupBy("of", "next_id").agg(first).select("of", "next_id", "first.next_key", "first.head")
    met = rows.join(heads, same(rows["doc_id"], heads["of"]))
    n = F.char_length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - CAST(floor(char_length(text) / 2) AS INT))"), F.expr("left(head, cut)"))
    met = met.withColumn("cut", cut).withColumn("edited", edited).withColumn("n_chars", n.cast("long"))
    met = met.select("doc_id", "n_chars", F.xxhash64("text").alias("text_key"), "next_id", "next_key", "text", "edited")
    met = met.withColumn("edited_sha256", F.sha2("edited", 256))
    prints = with_fingerprint(with_fingerprint(met, "text", "packed").drop("text"), "edited", "edited_packed").drop("edited")
    prints = written(prints.withColumn("near_edited", likeness(F.col("packed"), F.col("edited_packed"))), "fingerprints")
    following = prints.select(
        F.col("doc_id").alias("that_id"), F.col("text_key").alias("that_key"), F.col("packed").alias("next_packed")
    )
    if not repeated.isEmpty():
        following = following.dropDuplicates(["that_id", "that_key"])
    paired = prints.join(following, same(prints["next_id"], following["that_id"]) & (prints["next_key"] == following["that_key"]))
    return paired.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "packed",
        "edited_packed",
        "near_edited",
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
