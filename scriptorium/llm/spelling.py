"""Spelling variants: word counts of a corpus, and words one letter apart by bit-sliced position sets.

For every (position, letter) a bitset holds the words of a block that have the letter
there.  A query word runs through its letters once; each step updates, for 64 words at
a time, the set that agrees so far and the sets that have used up their one error by a
replaced, a deleted (read one position back) or an inserted letter (one position on).
Blocks are words that share their first or their last half, one of which any two words
with one error between them have in common.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import small_batches, text_of, written

MIN_CHARS = 5
MIN_COUNT = 3
# One run in so many loses a letter, chosen by a checksum of the document and the run.
NOISE = 97
# A form occurs at least so many times as often as its variant.
DOMINANCE = 2
# Words of one block that one comparison holds on either side.
BLOCK_LIMIT = 4096
# Entries (query x 64 words) updated at a time, positions whose sets are built at a time.
ENTRIES = 1 << 17
POSITIONS = 64
# Words whose sets are built side by side.
LANES = 1 << 15
# Checksums of words up to so many bytes are joined with their document's by table.
TABLE_BYTES = 64
ROOT_ROUNDS = 64

LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
ASCII_LETTER = np.array([97 <= b <= 122 for b in range(256)])
# UTF-8 writes U+00C0 to U+00FF as this byte and one more.
LATIN_LEAD = 0xC3


def _byte_table() -> np.ndarray:
    """The checksum's step over a zero byte, by the low byte of its state."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


ZERO_BYTE = _byte_table()


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(runs, text of each): the maximal letter runs of texts that lie side by side in UTF-8."""
    low = LOWER[data]
    lead = low == LATIN_LEAD
    letter = ASCII_LETTER[low] | lead
    letter[1:] |= lead[:-1]
    fresh = np.zeros(len(low) + 1, bool)
    fresh[offsets[:-1]] = True
    begins = letter & fresh[:-1]
    begins[1:] |= letter[1:] & ~letter[:-1]
    at = np.flatnonzero(begins)
    kept = low[letter]
    starts = np.append(np.cumsum(letter)[at] - 1, len(kept)).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(kept))])
    return runs, np.searchsorted(offsets, at, side="right") - 1


def _checksums(prefix: np.ndarray, text: np.ndarray, code: np.ndarray, words: list[bytes]) -> np.ndarray:
    """CRC-32 of each run behind its document's prefix: two checksums are joined by moving
    the first over the length of the second."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    own = np.fromiter(map(crc32, words), np.uint32, len(words))
    moved = np.empty((min(int(length.max(initial=0)), TABLE_BYTES) + 1, len(prefix)), np.uint32)
    moved[0] = prefix
    for n in range(1, len(moved)):
        moved[n] = ZERO_BYTE[moved[n - 1] & 0xFF] ^ (moved[n - 1] >> 8)
    short = length[code] <= TABLE_BYTES
    out = np.empty(len(code), np.uint32)
    out[short] = moved[length[code[short]], text[short]] ^ own[code[short]]
    for i in np.flatnonzero(~short):
        out[i] = crc32(words[code[i]], int(prefix[text[i]]))
    return out


def _counted(doc_ids: list, column: pa.Array, min_chars: int) -> tuple[pa.Array, pa.Array]:
    """(words, counts) of one batch of texts."""
    column = column.cast(pa.large_string())
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]] if data_buffer else np.empty(0, np.uint8)
    runs, text = letter_runs(data, offsets - offsets[0])
    if not len(runs):
        return pa.array([], pa.string()), pa.array([], pa.int64())
    coded = runs.dictionary_encode()
    code, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    prefix = np.array([crc32(f"{'' if i is None else i}:".encode()) for i in doc_ids], np.uint32)
    check = _checksums(prefix, text, code, words)
    hit = check % NOISE == 0
    count = np.bincount(code[~hit], minlength=len(words))
    plain = coded.dictionary.cast(pa.large_string())
    chars = pc.utf8_length(plain).to_numpy()
    keep = (chars >= min_chars) & (count > 0)
    cut: Counter = Counter()
    for i, h in zip(code[hit].tolist(), check[hit].tolist(), strict=True):
        if chars[i] > min_chars:
            at, word = h % int(chars[i]), words[i].decode()
            cut[word[:at] + word[at + 1 :]] += 1
    found = pa.concat_arrays([plain.filter(pa.array(keep)).cast(pa.string()), pa.array(list(cut), pa.string())])
    return found, pa.array(np.concatenate([count[keep], np.fromiter(cut.values(), np.int64, len(cut))]), pa.int64())


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts and how often they occur.

    A word is a maximal run of ASCII letters and U+00C0 to U+00FF with A-Z lower-cased;
    where NOISE divides the checksum of ``<doc_id>:<run>``, the run loses the letter that
    the checksum points at.  Words of under ``min_chars`` code points or ``min_count``
    occurrences are left out.  Null text has no words, a null doc_id is written as
    nothing, repeated rows count each, an empty table has no words.  Words are counted
    within a batch before they leave Python, and within a task before the shuffle.
    """
    rows = small_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = _counted(batch.column("doc_id").to_pylist(), batch.column("text"), min_chars)
            yield pa.RecordBatch.from_arrays([words, counts], ["word", "n"])

    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _blocks(words: DataFrame, limit: int) -> DataFrame:
    """(longest, side, members): blocks of words that share half of a word of ``longest`` letters.

    A word is in the blocks of its own length and of the next, by its beginning (side 0)
    and by its end (side 1).  A block over ``limit`` is cut into parts by hash, and every
    two parts meet in a row of their own: members with role 0 ask, with role 1 are asked,
    with role 2 do both.  Members are in order of falling count, then of code points.
    """
    size = F.char_length("word")

    def keys(longest: Column) -> list[Column]:
        half = F.floor(longest / 2).cast("int")
        start, end = F.substring("word", F.lit(1), half), F.right(F.col("word"), half)
        return [F.struct(longest.alias("longest"), F.lit(side).alias("side"), key.alias("key")) for side, key in ((0, start), (1, end))]

    rows = words.select("word", "n", F.explode(F.array(*keys(size), *keys(size + 1))).alias("k")).select("k.*", "word", "n")
    held = rows.groupBy("longest", "side", "key").agg(
        F.count("*").alias("held"), F.max(F.char_length("word") == F.col("longest")).alias("full")
    )
    held = held.where("held > 1 AND full").select(
        F.col("longest").alias("l"), F.col("side").alias("s"), F.col("key").alias("k"), F.ceil(F.col("held") / limit).cast("int").alias("parts")
    )
    sized = rows.join(held, (F.col("longest") == F.col("l")) & (F.col("side") == F.col("s")) & (F.col("key") == F.col("k")))
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    both = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(2).alias("role")))
    asks = F.transform(others, lambda o: F.struct(part.alias("p"), o.alias("q"), F.lit(0).alias("role")))
    asked = F.transform(others, lambda o: F.struct(o.alias("p"), part.alias("q"), F.lit(1).alias("role")))
    dealt = sized.withColumn("deal", F.explode(F.when(F.col("parts") == 1, both).otherwise(F.concat(asks, asked))))
    member = F.struct((-F.col("n")).alias("order"), "word", F.col("deal.role").alias("role"))
    return (
        dealt.groupBy("longest", "side", "key", "deal.p", "deal.q")
        .agg(F.sort_array(F.collect_list(member)).alias("members"))
        .select("longest", "side", "members")
    )


class PositionIndex:
    """Bitsets of words by (position, letter), built for a range of positions at a time."""

    def __init__(self, letters: np.ndarray, words: int, longest: int):
        self.codes, self.words, self.longest = letters, words, longest
        self.start = self.end = 0
        self.sets = np.empty((0, 0, 0), np.uint64)
        self.alphabet = int(letters.max(initial=0)) + 1

    def at(self, position: int, letter: np.ndarray, word: np.ndarray) -> np.ndarray:
        """For each entry the words that have its letter at ``position``."""
        if not 0 <= position < self.longest:
            return np.zeros(len(word), np.uint64)
        if not self.start <= position < self.end:
            # One position back stays, for the sets that are one letter behind.
            self.start, self.end = max(0, position - 2), min(self.longest, position + POSITIONS)
            self.sets = np.empty((self.end - self.start, self.alphabet, self.words), np.uint64)
            for i in range(self.start, self.end):
                has = self.codes[:, i] == np.arange(self.alphabet, dtype=self.codes.dtype)[:, None]
                self.sets[i - self.start] = np.packbits(has, axis=1, bitorder="little").view("<u8")
        return self.sets[position - self.start, letter, word]


def _one_error(index: PositionIndex, codes, valid, full, half, side, query, word, long_query):
    """(query, word, bits): the words with one error to each entry's query.

    Queries of the full length look for a replaced letter among their equals and a missing
    one among the words a letter shorter; those look for an inserted one among the full.
    In blocks by the end (side 1), words that also share the first half are left out:
    their block by the beginning has them.
    """
    agree = valid[word]
    replaced, shorter, longer = (np.zeros(len(word), np.uint64) for _ in range(3))
    twice = np.where(side[query], agree, np.uint64(0)) if half == 0 else np.zeros(len(word), np.uint64)
    last = index.longest if long_query else index.longest - 1
    for i in range(last):
        letter = codes[query, i]
        here = index.at(i, letter, word)
        if long_query:
            shorter = (shorter & index.at(i - 1, letter, word)) | agree
            replaced = (replaced & here) | (agree & ~here)
        else:
            longer = (longer | agree) & index.at(i + 1, letter, word)
        agree = agree & here
        if i + 1 == half:
            twice = np.where(side[query], agree, np.uint64(0))
        if i % 3 == 2:
            alive = (agree | replaced | shorter | longer) != 0
            if np.count_nonzero(alive) < 0.6 * len(alive):
                query, word, agree, twice = query[alive], word[alive], agree[alive], twice[alive]
                replaced, shorter, longer = replaced[alive], shorter[alive], longer[alive]
                if not len(query):
                    break
    if long_query:
        near = (replaced & full[word]) | (shorter & valid[word] & ~full[word])
    else:
        near = (longer | agree) & full[word]
    near &= ~twice
    found = near != 0
    return query[found], word[found], near[found]


def _near_in(longest: int, sides: list[int], blocks: list[tuple[list, list, list]]) -> Iterator[tuple]:
    """(word, n_near, best_n, best) of every asking word of equal-length blocks, given as
    (orders, words, roles)."""
    half = longest // 2
    lanes = [[i for i, role in enumerate(roles) if role] for _, _, roles in blocks]
    sizes = np.array([-(-len(x) // 64) for x in lanes])
    first = np.concatenate([[0], np.cumsum(sizes)])
    total = int(first[-1])
    asked = np.concatenate([np.arange(len(x)) + at * 64 for x, at in zip(lanes, first, strict=False)]).astype(np.int64)
    asked_words = [block[1][i] for block, x in zip(blocks, lanes, strict=True) for i in x]
    asks = [[i for i, role in enumerate(roles) if role != 1] for _, _, roles in blocks]
    query_words = [block[1][i] for block, x in zip(blocks, asks, strict=True) for i in x]
    of_block = np.repeat(np.arange(len(blocks)), [len(x) for x in asks])

    def letters(words: list[str]) -> np.ndarray:
        flat = np.frombuffer("".join(w.ljust(longest, "\0") for w in words).encode("utf-32-le"), "<u4")
        return flat.reshape(-1, longest)

    held, asking = letters(asked_words), letters(query_words)
    alphabet = np.unique(np.concatenate([[0], held.ravel()]))
    dtype = np.uint8 if len(alphabet) < 256 else np.uint16
    codes = np.zeros((total * 64, longest), dtype)
    codes[asked] = np.searchsorted(alphabet, held)
    # A letter that no word of the blocks has is the alphabet's unused end.
    spot = np.minimum(np.searchsorted(alphabet, asking), len(alphabet) - 1)
    mine = np.where((alphabet[spot] == asking) & (asking > 0), spot, len(alphabet)).astype(np.int64)
    index = PositionIndex(codes, total, longest)
    index.alphabet = len(alphabet) + 1
    filled, whole = np.zeros(total * 64, bool), np.zeros(total * 64, bool)
    filled[asked] = True
    whole[asked] = held[:, longest - 1] > 0
    valid, full = (np.packbits(x, bitorder="little").view("<u8") for x in (filled, whole))
    side = np.array(sides, bool)[of_block]
    count = np.zeros(len(query_words), np.int64)
    best = np.full(len(query_words), total * 64, np.int64)
    is_long = asking[:, longest - 1] > 0
    for long_query in (True, False):
        chosen = np.flatnonzero(is_long == long_query)
        width = sizes[of_block[chosen]]
        query = np.repeat(chosen, width)
        step = np.arange(len(query)) - np.repeat(np.cumsum(width) - width, width)
        word = np.repeat(first[:-1][of_block[chosen]], width) + step
        for at in range(0, len(query), ENTRIES):
            q, w, bits = _one_error(index, mine, valid, full, half, side, query[at : at + ENTRIES], word[at : at + ENTRIES], long_query)
            np.add.at(count, q, np.bitwise_count(bits).astype(np.int64))
            # Words are in order of preference, so the lowest bit is the best.
            np.minimum.at(best, q, w * 64 + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64))
    order = np.zeros(total * 64, np.int64)
    order[asked] = [block[0][i] for block, x in zip(blocks, lanes, strict=True) for i in x]
    place = np.full(total * 64 + 1, -1)
    place[asked] = np.arange(len(asked))
    for i in np.flatnonzero(count).tolist():
        yield query_words[i], int(count[i]), -int(order[best[i]]), asked_words[place[best[i]]]


def near_words(words: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a near word.

    Near are two words that differ by exactly one inserted, deleted or replaced code
    point.  ``best`` is the near word of largest n, of equal ones the first in
    code-point order.  Pairs stay bits: a block gives one row for each of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest, side = batch.column("longest").to_pylist(), batch.column("side").to_pylist()
            members = batch.column("members")
            offsets = members.offsets.to_pylist()
            orders, words, roles = (members.values.field(f).to_pylist() for f in ("order", "word", "role"))
            out: list[tuple] = []
            group: list[int] = []
            for i in [*sorted(range(len(longest)), key=longest.__getitem__), None]:
                full = sum(offsets[j + 1] - offsets[j] for j in group) >= LANES if group else False
                if group and (i is None or full or longest[i] != longest[group[0]]):
                    blocks = [tuple(x[offsets[j] : offsets[j + 1]] for x in (orders, words, roles)) for j in group]
                    out.extend(_near_in(longest[group[0]], [side[j] for j in group], blocks))
                    group = []
                if i is not None:
                    group.append(i)
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "n_near", "best_n", "best"])

    blocks = small_batches(_blocks(words, limit))
    found = blocks.mapInArrow(run, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("order"), "best")).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", (-F.col("first.order")).alias("best_n"), F.col("first.best").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words (word, form) that have a form: where the forms lead to.

    Every round doubles the steps that a pointer spans, so the rounds are the logarithm
    of the longest chain; a chain ends, since counts rise along it.
    """
    current = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROOT_ROUNDS):
        ahead = current.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = written(current.join(ahead, current["root"] == ahead["at"], "left").select("word", "root", "next"), "roots")
        if moved.where("next IS NOT NULL").isEmpty():
            return current
        current = moved.select("word", F.coalesce("next", "root").alias("root"))
    raise RuntimeError(f"roots did not settle in {ROOT_ROUNDS} rounds")


def spelling_variants(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, dominance: int = DOMINANCE, limit: int = BLOCK_LIMIT
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of ``vocabulary``.

    ``form`` is the near word of largest n (ties: the first in code-point order) if it
    occurs at least ``dominance`` times as often as the word, else null; ``form_n`` its
    n.  ``root`` is where the forms lead, the word itself without one.  ``n_near`` counts
    the near words.  Blocks over ``limit`` are compared part by part, with the same result.
    """
    if dominance < 2:
        raise ValueError("dominance below 2 lets forms lead in circles")
    words = written(vocabulary(docs, min_chars, min_count), "vocabulary")
    near = near_words(words, limit).withColumnRenamed("word", "of")
    led = F.col("best_n") >= dominance * F.col("n")
    found = words.join(near, words["word"] == near["of"], "left").select(
        "word",
        F.when(led, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(led, F.col("best_n")).alias("form_n"),
    )
    found = written(found, "forms")
    ends = roots(found.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    return found.join(ends, found["word"] == ends["of"], "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
