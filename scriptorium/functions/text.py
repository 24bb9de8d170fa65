"""Text expressions: folding, tokens, hashes, previews, token estimates."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.stem import stem_all

# Characters deleted from query words before matching (fixed values).
QUERY_SPECIALS = r'["*()\-+^:]'
# Everything that is neither letter, digit nor private-use separates tokens.
SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"

# The stop words of the "english" analyzer (fixed values).
ENGLISH_STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now""".split()
)


def _diacritics() -> tuple[str, str]:
    """Latin letters that decompose into one base letter and marks, and those bases."""
    marked, base = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            marked.append(chr(code))
            base.append(parts[0])
    return "".join(marked), "".join(base)


_MARKED, _BASE = _diacritics()


def fold(text: Column) -> Column:
    """Lower-case and strip diacritics."""
    return F.translate(F.lower(text), _MARKED, _BASE)


@dataclass(frozen=True)
class Analyzer:
    """How text becomes index terms."""

    stem: bool = True
    stop_words: tuple[str, ...] = ()

    def all_words(self, text: Column) -> Column:
        """The words with the stop words among them."""
        return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), SEPARATORS), "")

    def words(self, text: Column) -> Column:
        words = self.all_words(text)
        if self.stop_words:
            words = F.filter(words, lambda w: ~w.isin(list(self.stop_words)))
        return words

    def normal(self, words: Column) -> Column:
        return stem_all(words) if self.stem else words

    def terms(self, text: Column) -> Column:
        return self.normal(self.words(text))


PORTER = Analyzer(stem=True)
PLAIN = Analyzer(stem=False)
ENGLISH = Analyzer(stem=True, stop_words=ENGLISH_STOP_WORDS)


def query_words(query: Column) -> Column:
    """Whitespace words of a query with the special characters deleted."""
    words = F.split(F.regexp_replace(query, QUERY_SPECIALS, ""), r"\s+")
    return F.array_remove(words, "")


def chunk_id(file_path: Column, chunk_index: Column) -> Column:
    """A 16-byte key: at 10^11 chunks a 64-bit hash would already collide."""
    return F.unhex(F.md5(F.concat_ws("#", chunk_index.cast("string"), file_path)))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 16)


def preview(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """Four characters per token, at least one, zero for no text."""
    size = F.length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(size / 4))).cast("long")


def parse_tags(raw: Column) -> Column:
    """Comma list, optionally in brackets; quotes stripped, blanks dropped."""
    body = F.regexp_replace(F.trim(raw), r"^\[(.*)\]$", "$1")
    kept = F.filter(F.split(body, ","), lambda t: F.trim(t) != "")
    return F.transform(kept, lambda t: F.regexp_replace(F.trim(t), r"""^["']+|["']+$""", ""))


def first_h1(markdown: Column) -> Column:
    found = F.trim(F.regexp_extract(markdown, r"(?m)^# ([^\n]+)$", 1))
    return F.when(found != "", found)


def file_stem(path: Column) -> Column:
    """Last path part without its suffix (a leading dot is not a suffix)."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?<=.)(\.[^.]+)$", 1))


def contextual_header(file_path: Column, title: Column) -> Column:
    """The header put before a chunk when it is embedded."""
    section = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("Section: "), title))
    return F.concat(F.concat_ws(" | ", F.concat(F.lit("Document: "), file_path), section), F.lit("\n\n"))


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored regex; ``*`` also crosses ``/``."""
    import re

    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i:end].replace("\\", "\\\\")
            out.append("[^" + body[1:] + "]" if body.startswith("!") else "[" + body + "]")
            i = end + 1
        else:
            out.append(re.escape(ch))
    return "(?s)^" + "".join(out) + "$"


def matches_globs(path: Column, include: str | None, exclude: str | None) -> Column:
    """Comma-separated include and exclude globs; an exclude match wins."""

    def any_of(patterns: str) -> Column:
        found = F.lit(False)
        for part in patterns.split(","):
            if part.strip():
                found = found | path.rlike(glob_regex(part.strip()))
        return found

    keep = F.lit(True)
    if exclude:
        keep = keep & ~any_of(exclude)
    if include:
        keep = keep & any_of(include)
    return keep
