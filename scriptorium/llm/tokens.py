"""Token counts: batched encoding inside Arrow functions."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import small_batches, text_of

# Characters of text in one call of the tokenizer and in one slice of a long text, bytes of
# text that are looked up together, and what a worker remembers: pieces, each of at most so
# many characters.
BATCH_CHARS = 1 << 18
BATCH_BYTES = 1 << 21
JOINED = 200
SLICE_CHARS = 1 << 20
MEMO_PIECES = 600_000
MEMO_CHARS = 64

# Where a single space stands between two characters that are not white space, the
# byte-level pre-tokenizer always starts a new token with that space, so texts may be
# cut there.  Next to other white space it may not.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """A long text in parts of about ``size`` characters, cut where the tokens allow it."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


# What a piece may be taken apart into without the tokenizer: runs of letters, runs of
# punctuation and single line ends between them.  The byte-level pre-tokenizer cuts there too.
# An apostrophe is left out, since it may begin a token with the letters after it.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def atoms(tokenizer) -> tuple[re.Pattern, re.Pattern] | None:
    """A pattern for pieces that can be taken apart, after their letters, and one for the atoms.

    Nothing that may belong to an added token is taken apart.  None where a tokenizer
    has another pre-tokenizer or changes texts before it.
    """
    own = json.loads(tokenizer.to_str())
    before = own["pre_tokenizer"] or {}
    if own["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
        return None
    added = [token["content"] for token in own["added_tokens"]]
    marks = re.escape("".join(c for c in _MARKS if not any(c in token for token in added)))
    some = rf"([{_LETTERS}]+)((?:[{marks}]++(?:\n?[{_LETTERS}]++)?|\n[{_LETTERS}]++)*+)"
    if any(re.fullmatch(rf"[{_LETTERS}{marks}\s]*", token) for token in added):
        return None
    return re.compile(some), re.compile(rf"[{_LETTERS}]+|[{marks}]+|\n")


def safe(piece: str) -> bool:
    """Whether the spaces around a piece between two spaces are safe cuts."""
    return piece != "" and not piece[0].isspace() and not piece[-1].isspace()


class PieceEncoder:
    """Encodes texts piece by piece, each distinct piece once while it is remembered.

    A piece stands between two safe cuts; the ids of a text are those of its pieces
    in order, as little-endian unsigned 32-bit numbers.  ``spaced`` remembers pieces
    that follow a space, ``bare`` such that do not.  Both memories are bounded and
    change no result.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.atoms = atoms(self.tokenizer)
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.breaks = np.array([self.tokenizer.id_to_token(i) == "\u010a" for i in range(size)])

    def _tokenize(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Batches are balanced by characters, so that a call's memory is bounded."""
        batch: list[str] = []
        size = 0
        for text in [*texts, None]:
            if batch and (text is None or size + len(text) > BATCH_CHARS):
                for found in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                    yield np.array(found.ids, dtype="<u4")
                batch, size = [], 0
            if text is not None:
                batch.append(text)
                size += len(text)

    def _ids(self, wanted: list[str], mark: str) -> dict[str, bytes]:
        """The ids of pieces, each after a space (mark " ") or after nothing (mark "\n").

        Pieces without white space are laid side by side into lines, which are safe to
        cut again where they were joined: there a token begins with a space, or is a
        line end, and nowhere else.
        """
        begins, skip = (self.opens, 0) if mark == " " else (self.breaks, 4)
        plain = [piece for piece in wanted if piece.isalpha() or safe(piece) and " " not in piece and "\n" not in piece]
        found: dict[str, bytes] = {}
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, ids in zip(groups, self._tokenize([mark + mark.join(group) for group in groups]), strict=True):
            starts = (4 * np.flatnonzero(begins[ids])).tolist()
            if len(starts) == len(group):
                data = ids.tobytes()
                found.update((piece, data[start + skip : end]) for piece, start, end in zip(group, starts, [*starts[1:], len(data)], strict=True))
        rest = [piece for piece in wanted if piece not in found]
        lead = " " if mark == " " else ""
        found.update(zip(rest, (ids.tobytes() for ids in self._tokenize([lead + piece for piece in rest])), strict=True))
        return found

    def _learn(self, memo: dict[str, bytes], wanted: list[str], mark: str) -> dict[str, bytes]:
        """``_ids`` of what is not remembered; short pieces are, if their spaces are safe cuts."""
        found = self._ids(wanted, mark)
        memo.update(found)
        for piece in found:
            if len(piece) > MEMO_CHARS or mark == " " and not piece.isalpha() and not safe(piece):
                del memo[piece]
        return found

    def _after_space(self, wanted: set[str]) -> dict[str, bytes]:
        """The ids of pieces that follow a space and are not remembered; what can be taken apart is."""
        if not self.atoms:
            return self._learn(self.spaced, list(wanted), " ")
        known, apart, whole = self.spaced, [], []
        for piece in wanted:
            if piece.isalpha() or not (match := self.atoms[0].fullmatch(piece)):
                whole.append(piece)
            else:
                apart.append((piece, *match.groups()))
        heads = {head for _, head, _ in apart if head not in known}
        found = self._learn(known, list(heads.union(whole)), " ")
        tails = self._tails({tail for _, _, tail in apart})
        for piece, head, tail in apart:
            found[piece] = (found[head] if head in found else known[head]) + tails[tail]
        return found

    def _tails(self, wanted: set[str]) -> dict[str, bytes]:
        """The ids of what follows the first letters of a piece that can be taken apart."""
        found = {tail: self.atoms[1].findall(tail) for tail in wanted}
        bare = self._before({atom for atoms in found.values() for atom in atoms})
        return {tail: b"".join(map(bare.__getitem__, atoms)) for tail, atoms in found.items()}

    def _before(self, wanted: set[str]) -> dict[str, bytes]:
        """The ids of pieces that follow nothing, or what does not join them."""
        known = self.bare
        found = {piece: known[piece] for piece in wanted if piece in known}
        found.update(self._learn(known, [piece for piece in wanted if piece not in found], "\n"))
        return found

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text of a column.

        Texts are cut at all spaces; each distinct piece of the column is looked up once and
        Arrow lays the ids side by side.  A text with a space that is no safe cut is cut at
        its safe cuts alone.
        """
        if len(self.spaced) + len(self.bare) > MEMO_PIECES:
            self.spaced, self.bare = {}, {}
        cut = pc.split_pattern(texts, " ")
        begin, end = cut.offsets.to_numpy()[:-1], cut.offsets.to_numpy()[1:]
        coded = cut.values.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [distinct[code] for code in codes[begin].tolist()]
        # The first piece of a text follows no space.
        codes[begin] = len(distinct) + np.arange(len(begin))
        inner = np.zeros(len(distinct), bool)
        inner[codes[codes < len(distinct)]] = True
        found = list(map(self.spaced.get, distinct))
        missing = [i for i, ids in enumerate(found) if ids is None and inner[i]]
        odd = [i for i in missing if not distinct[i].isalpha() and not safe(distinct[i])]
        spoiled = self._spoiled(codes, begin, end, odd, heads, distinct)
        rough = {row: [piece if i == 0 else piece[1:] for i, piece in enumerate(_CUT.split(texts[row].as_py()))] for row in spoiled}
        new = {distinct[i] for i in missing}.union(*(rest for _, *rest in rough.values())).difference(self.spaced)
        new = self._after_space(new)
        for i in missing:
            found[i] = new[distinct[i]]
        bare = self._before({head for row, head in enumerate(heads) if row not in rough}.union(first for first, *_ in rough.values()))
        found += [b"" if row in rough else bare[head] for row, head in enumerate(heads)]
        laid = pa.array(found, pa.large_binary()).take(pa.array(codes))
        _, offsets, data = laid.buffers()
        offsets = np.frombuffer(offsets, np.int64)
        data = memoryview(data) if data else b""
        for row, (a, b) in enumerate(zip(offsets[begin].tolist(), offsets[end].tolist(), strict=True)):
            if row in rough:
                first, *rest = rough[row]
                yield bare[first] + b"".join(new[piece] if piece in new else self.spaced[piece] for piece in rest)
            else:
                yield bytes(data[a:b])

    @staticmethod
    def _spoiled(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, odd: list[int], heads: list[str], distinct: list[str]) -> list[int]:
        """The rows that have a space which is no safe cut."""
        bad = np.zeros(len(distinct) + len(heads), bool)
        bad[odd] = True
        bad[len(distinct) :] = [head[-1:].isspace() for head in heads]
        at = bad[codes]
        for row in np.flatnonzero(at[end - 1]).tolist():
            # No space follows the last piece.
            code = int(codes[end[row] - 1])
            at[end[row] - 1] = code < len(distinct) and not distinct[code][:1].strip()
        return np.flatnonzero(np.logical_or.reduceat(at, begin)).tolist() if at.any() else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text; long texts are encoded in slices."""
        return [b"".join(ids for part in slices(text) for ids in self.encode_column(pa.array([part], pa.large_string()))) for text in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and tokenizer file."""
    return PieceEncoder(path)


def encoded(encoder: PieceEncoder, column: pa.Array) -> Iterator[bytes]:
    """The ids of every text of a column, in batches balanced by size."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, done + BATCH_BYTES, "right")))
        if to == at + 1:
            yield from encoder.encode([column[at].as_py()])
        else:
            yield from encoder.encode_column(column.slice(at, to - at))
        at, done = to, int(ends[to - 1])


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of ``docs``, whole texts.

    Counts are those of the tokenizer file without begin, end or added special
    tokens; special strings inside a text are what the library takes them for.
    Null text counts as empty and has no tokens.  Repeated rows are counted each.
    """
    path = tokenizer or default_tokenizer()
    text = text_of(docs)
    rows = small_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts = pa.array([len(ids) // 4 for ids in encoded(own, batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
