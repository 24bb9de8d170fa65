"""Secret scans: all rules in one deterministic automaton, run over the bytes once."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import small_batches, text_of

# The kinds in their order, the pattern of each, the characters a match needs.
# A match that is too short is dropped after matching: it still bars others from its place.
# Eight digits begin a hex run here only because shorter ones can never be kept.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
BASE_KINDS = ("assign", "access", "hex")
RULES = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{8,}",
    # Added kinds.
    "forge": r"gh[pousr]_[A-Za-z0-9]+",
    "chat": r"xox[abprs]-[A-Za-z0-9-]+",
    "private_key": r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
}
LEAST = {"access": 20, "hex": 24, "forge": 40, "chat": 15}
SPANS = "array<struct<kind:string,start:long,end:long>>"

Bytes = frozenset  # a set of byte values


class _Automaton:
    """A non-deterministic automaton: edges[state] = [(bytes or None, state)]."""

    def __init__(self):
        self.edges: list[list[tuple[Bytes | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def add(self, tokens: Iterable, start: int, any_case: bool = False) -> int:
        """Lay a parsed pattern from ``start``; returns its last state."""
        for kind, value in tokens:
            if kind in (sre.LITERAL, sre.IN):
                to = self.state()
                self.edges[start].append((_byte_set(kind, value, any_case), to))
                start = to
            elif kind is sre.SUBPATTERN:
                start = self.add(value[3], start, any_case or bool(value[1] & re.IGNORECASE))
            elif kind is sre.BRANCH:
                to = self.state()
                for branch in value[1]:
                    self.edges[self.add(branch, start, any_case)].append((None, to))
                start = to
            elif kind is sre.MAX_REPEAT:
                least, most, body = value
                for _ in range(least):
                    start = self.add(body, start, any_case)
                if most is sre.MAXREPEAT:
                    loop = self.state()
                    self.edges[start].append((None, loop))
                    self.edges[self.add(body, loop, any_case)].append((None, loop))
                    start = loop
                else:
                    to = self.state()
                    self.edges[start].append((None, to))
                    for _ in range(most - least):
                        start = self.add(body, start, any_case)
                        self.edges[start].append((None, to))
                    start = to
            else:
                raise ValueError(f"unsupported part of a rule: {kind}")
        return start

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for label, to in self.edges[todo.pop()]:
                if label is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def reversed(self) -> _Automaton:
        other = _Automaton()
        other.edges = [[] for _ in self.edges]
        for state, out in enumerate(self.edges):
            for label, to in out:
                other.edges[to].append((label, state))
        return other


def _byte_set(kind, value, any_case: bool) -> Bytes:
    found: set[int] = set()
    for part, what in [(kind, value)] if kind is sre.LITERAL else value:
        if part is sre.LITERAL:
            found.add(what)
        elif part is sre.RANGE:
            found.update(range(what[0], what[1] + 1))
        else:
            raise ValueError(f"unsupported part of a rule: {part}")
    if max(found) > 127:
        raise ValueError("rules are ASCII")
    return Bytes({ord(x) for c in found for x in (chr(c).lower(), chr(c).upper())} if any_case else found)


class Dfa:
    """Subset construction, then minimisation, into one flat transition array.

    ``classes`` maps a byte to its class; ``table[state + class]`` is the next state,
    states being multiples of the number of classes, sorted so that accepting ones
    are last (``first_accept`` on).  ``accepts[state // n_classes]`` is a bit mask of
    the rules that end there.
    """

    def __init__(self, nfa: _Automaton, start: int, ends: dict[int, int]):
        labels = {label for out in nfa.edges for label, _ in out if label is not None}
        signature = [tuple(byte in label for label in labels) for byte in range(256)]
        numbers = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.classes = bytes(numbers[s] for s in signature)
        self.n_classes = len(numbers)
        sample = [self.classes.index(c) for c in range(self.n_classes)]
        first = nfa.closure([start])
        states, rows = {first: 0}, []
        todo = [first]
        for subset in todo:
            row = []
            for byte in sample:
                moved = nfa.closure({to for state in subset for label, to in nfa.edges[state] if label is not None and byte in label})
                if moved not in states:
                    states[moved] = len(states)
                    todo.append(moved)
                row.append(states[moved])
            rows.append(row)
        accepts = np.array([sum(1 << ends[s] for s in subset if s in ends) for subset in states])
        dead = np.array([not subset for subset in states])
        self._minimise(np.array(rows), accepts, dead)

    def _minimise(self, rows: np.ndarray, accepts: np.ndarray, dead: np.ndarray) -> None:
        # Classes of states split until their members' moves agree.
        _, part = np.unique(accepts, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([part, part[rows]]), axis=0, return_inverse=True)
            if finer.max() == part.max():
                break
            part = finer
        keep = np.unique(part, return_index=True)[1]
        order = np.argsort(accepts[keep], kind="stable")
        number = np.empty(len(keep), np.int64)
        number[order] = np.arange(len(keep))
        kept = keep[order]
        self.start = int(number[part[0]]) * self.n_classes
        self.table = (number[part[rows[kept]]] * self.n_classes).ravel().tolist()
        self.accepts = accepts[kept].tolist()
        self.first_accept = int(np.searchsorted(accepts[kept], 1)) * self.n_classes
        gone = np.flatnonzero(dead)
        self.dead = int(number[part[gone[0]]]) * self.n_classes if len(gone) else -1


class Scanner:
    """Finds the spans of every rule, leftmost and non-overlapping per rule."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.kinds = [kind for kind, _ in rules]
        both = _Automaton()
        start = both.state()
        both.edges[start].append((Bytes(range(256)), start))  # a match may begin anywhere
        ends = {}
        self.back = []
        for i, (_, pattern) in enumerate(rules):
            ends[both.add(sre_parser.parse(pattern), start)] = i
            one = _Automaton()
            head = one.state()
            tail = one.add(sre_parser.parse(pattern), head)
            self.back.append(Dfa(one.reversed(), tail, {head: 0}))
        self.dfa = Dfa(both, start, ends)

    def _start(self, rule: int, data: bytes, end: int, least: int) -> int:
        """The leftmost start of a match of ``rule`` ending at ``end``; -1 if none from ``least`` on."""
        dfa, found = self.back[rule], -1
        state = dfa.start
        for at in range(end - 1, least - 1, -1):
            state = dfa.table[state + dfa.classes[data[at]]]
            if state >= dfa.first_accept:
                found = at
            elif state == dfa.dead:
                break
        return found

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by rule and place.

        The automaton reads each byte once and says which rules have a match ending
        there.  A rule's match goes on while its ends are adjacent; where they stop,
        its start is found backwards, not before the end of the match before it.
        """
        dfa = self.dfa
        table, accepting, size = dfa.table, dfa.first_accept, dfa.n_classes
        hits: dict[int, list[int]] = {}
        state = dfa.start
        for at, c in enumerate(data.translate(dfa.classes)):
            state = table[state + c]
            if state >= accepting:
                hits.setdefault(dfa.accepts[state // size], []).append(at + 1)
        found = []
        for rule in range(len(self.kinds)):
            ends = sorted(e for mask, places in hits.items() if mask >> rule & 1 for e in places)
            before = 0
            for end, after in itertools.zip_longest(ends, ends[1:]):
                if after == end + 1:
                    continue
                start = self._start(rule, data, end, before)
                if start >= 0:
                    found.append((rule, start, end))
                    before = end
        return found


@lru_cache(maxsize=4)
def scanner(rules: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(rules)


_VALUE = re.compile(ASSIGN.encode())


def _long_enough(kind: str, match: bytes) -> bool:
    if kind == "assign":
        return len(_VALUE.fullmatch(match)[1]) >= ASSIGN_LEAST
    return len(match) >= LEAST.get(kind, 0)


def find_spans(text: str, rules: tuple[tuple[str, str], ...] = tuple(RULES.items())) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    data = text.encode("utf-8", "surrogatepass")
    machine = scanner(rules)
    spans = machine.scan(data)
    spans = [
        (rule, start, end)
        for rule, start, end in spans
        if _long_enough(machine.kinds[rule], data[start:end])
    ]
    if len(data) != len(text) and spans:
        places = sorted({p for _, start, end in spans for p in (start, end)})
        points, at, n = {}, 0, 0
        for p in places:
            n += len(data[at:p].decode("utf-8", "surrogatepass"))
            points[p], at = n, p
        spans = [(rule, points[start], points[end]) for rule, start, end in spans]
    return [(machine.kinds[rule], start, end) for rule, start, end in sorted(spans, key=lambda x: (x[1], x[0], x[2]))]


def scan_secrets(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, spans): every span of every rule, one row per row of ``docs``, whole texts.

    Spans are in code points, end exclusive, by start and then kind as listed.
    Matches that are too short for their kind are dropped after matching.  Null text counts as empty and has no spans; repeated rows are
    scanned each; an empty table gives an empty result.
    """
    chosen = tuple((rules or RULES).items())
    rows = small_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text.as_py(), chosen)]
                for text in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s.getField("kind").isin(*kinds))


def written_out(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start").cast("string"), s.getField("end").cast("string"))
    return F.array_join(F.transform(spans, one), ",")
