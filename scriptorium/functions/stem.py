"""Porter's suffix-stripping algorithm (M. F. Porter, 1980) and its column form."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Suffix rules of the published algorithm (fixed values).
STEP2 = {
    "ational": "ate",
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "izer": "ize",
    "bli": "ble",
    "alli": "al",
    "entli": "ent",
    "eli": "e",
    "ousli": "ous",
    "ization": "ize",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "iveness": "ive",
    "fulness": "ful",
    "ousness": "ous",
    "aliti": "al",
    "iviti": "ive",
    "biliti": "ble",
    "logi": "log",
}
STEP3 = {
    "icate": "ic",
    "ative": "",
    "alize": "al",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
}
STEP4 = (
    "al",
    "ance",
    "ence",
    "er",
    "ic",
    "able",
    "ible",
    "ant",
    "ement",
    "ment",
    "ent",
    "ion",
    "ou",
    "ism",
    "ate",
    "iti",
    "ous",
    "ive",
    "ize",
)
ENDS2, ENDS3 = tuple(STEP2), tuple(STEP3)
# Tokens outside these lengths are kept as they are (fixed values).
MIN_LEN, MAX_LEN = 3, 64


def _shape(word: str) -> str:
    """One letter per character: ``v`` for a vowel, ``c`` for a consonant."""
    out = []
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _has_vowel(word: str) -> bool:
    return "v" in _shape(word)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _ends_cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes: tuple[str, ...]) -> str | None:
    # Few words end in any of them, which one look tells.
    if not word.endswith(suffixes):
        return None
    return max((s for s in suffixes if word.endswith(s)), key=len)


def _plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if not _has_vowel(base):
                return word
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _double_consonant(base) and base[-1] not in "lsz":
                return base[:-1]
            if _measure(base) == 1 and _ends_cvc(base):
                return base + "e"
            return base
    return word


def _replace(word: str, rules: dict[str, str], suffixes: tuple[str, ...]) -> str:
    suffix = _longest(word, suffixes)
    if suffix is None:
        return word
    base = word[: -len(suffix)]
    return base + rules[suffix] if _measure(base) > 0 else word


def _drop(word: str) -> str:
    suffix = _longest(word, STEP4)
    if suffix is None:
        return word
    base = word[: -len(suffix)]
    if _measure(base) <= 1 or (suffix == "ion" and not base.endswith(("s", "t"))):
        return word
    return base


def _final(word: str) -> str:
    if word.endswith("e"):
        base = word[:-1]
        m = _measure(base)
        if m > 1 or (m == 1 and not _ends_cvc(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=1 << 18)
def stem_word(word: str) -> str:
    if not MIN_LEN <= len(word) <= MAX_LEN:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, STEP2, ENDS2)
    word = _replace(word, STEP3, ENDS3)
    return _final(_drop(word))


def stems(distinct: pa.Array) -> pa.Array:
    return pa.array([stem_word(w) for w in distinct.to_pylist()], pa.string())


@arrow_udf(T.ArrayType(T.StringType()))
def _stem_arrays(words: pa.Array) -> pa.Array:
    # Only the distinct words of a batch reach Python; the rest is Arrow.
    flat = words.flatten().dictionary_encode()
    taken = stems(flat.dictionary).take(flat.indices)
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
    return pa.ListArray.from_arrays(offsets, taken)


def stem_all(words: Column) -> Column:
    """Stem every word of a non-null array column."""
    return _stem_arrays(words)


COUNTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("term", T.StringType()),
            T.StructField("tf_title", T.LongType()),
            T.StructField("tf_content", T.LongType()),
        ]
    )
)


def _count_terms(words: pa.Array, n_title: pa.Array, stem: bool) -> pa.Array:
    lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    flat = words.flatten().dictionary_encode()
    names = flat.dictionary
    codes = flat.indices.to_numpy().astype(np.int64)
    if stem:
        # Different words may share a stem, so encode the stems once more.
        found = stems(names).dictionary_encode()
        names = found.dictionary
        codes = found.indices.to_numpy().astype(np.int64)[codes]
    rows = np.repeat(np.arange(len(lengths)), lengths)
    position = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    titled = position < np.repeat(n_title.to_numpy(), lengths)
    keys, inverse = np.unique(rows * max(len(names), 1) + codes, return_inverse=True)
    tf_title = np.bincount(inverse, weights=titled, minlength=len(keys)).astype(np.int64)
    tf_all = np.bincount(inverse, minlength=len(keys)).astype(np.int64)
    per_row = np.bincount(keys // max(len(names), 1), minlength=len(lengths))
    offsets = pa.array(np.concatenate(([0], np.cumsum(per_row))), pa.int32())
    fields = [
        names.take(pa.array(keys % max(len(names), 1))),
        pa.array(tf_title),
        pa.array(tf_all - tf_title),
    ]
    entries = pa.StructArray.from_arrays(fields, names=["term", "tf_title", "tf_content"])
    return pa.ListArray.from_arrays(offsets, entries)


@arrow_udf(COUNTS)
def _count_stems(words: pa.Array, n_title: pa.Array) -> pa.Array:
    return _count_terms(words, n_title, True)


@arrow_udf(COUNTS)
def _count_words(words: pa.Array, n_title: pa.Array) -> pa.Array:
    return _count_terms(words, n_title, False)


def term_counts(words: Column, n_title: Column, stem: bool) -> Column:
    """Per row: every distinct term with its count before and after ``n_title``."""
    return (_count_stems if stem else _count_words)(words, n_title)
