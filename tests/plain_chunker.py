"""A plain chunker in memory, against which the chunking expressions are tested."""

import re
from bisect import bisect_right
from itertools import groupby

MIN_SECTION = 20
DEEPEST_LEVEL = 4
DEFAULT_MAX = 4000
HEADINGS = {n: re.compile(rf"^{'#' * n} (.+)$", re.MULTILINE) for n in range(1, DEEPEST_LEVEL + 1)}
# From an opening mark to the next line that begins with the same mark, or the end.
FENCED = re.compile(r"^(?:```.*?(?:^`{3,}|\Z)|~~~.*?(?:^~{3,}|\Z))", re.MULTILINE | re.DOTALL)


def fenced_ranges(text: str) -> list[tuple[int, int]]:
    """Code fences; one that is never closed runs to the end."""
    return [m.span() for m in FENCED.finditer(text)]


def table_ranges(text: str) -> list[tuple[int, int]]:
    """Runs of lines that start and end with a pipe."""
    rows, at = [], 0
    for line in text.split("\n"):
        bare = line.strip()
        rows.append((at, bare.startswith("|") and bare.endswith("|")))
        at += len(line) + 1
    ranges = []
    runs = [(is_table, [r[0] for r in run]) for is_table, run in groupby(rows, key=lambda r: r[1])]
    for i, (is_table, starts) in enumerate(runs):
        if is_table:
            ranges.append((starts[0], runs[i + 1][1][0] if i + 1 < len(runs) else len(text)))
    return ranges


def protected_ranges(text: str) -> list[tuple[int, int]]:
    return sorted(fenced_ranges(text) + table_ranges(text))


def split_points(text: str) -> list[int]:
    """Blank lines outside fences and tables."""
    merged: list[list[int]] = []
    for start, end in protected_ranges(text):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    starts = [m[0] for m in merged]

    def free(at: int) -> bool:
        i = bisect_right(starts, at) - 1
        return i < 0 or at >= merged[i][1]

    return [m.start() for m in re.finditer("\n\n", text) if free(m.start())]


def pack_paragraphs(text: str, max_size: int) -> list[str]:
    """Paragraphs packed greedily; a piece without split point stays whole."""
    if len(text) <= max_size:
        return [text]
    cuts = [0, *[p + 2 for p in split_points(text)], len(text)]
    if len(cuts) == 2:
        return [text]
    packed, begin = [], 0
    for start, end in zip(cuts, cuts[1:]):
        if start > begin and end - begin > max_size:
            packed.append(text[begin:start])
            begin = start
    packed.append(text[begin:])
    return [p.strip() for p in packed if p.strip()] or [text]


def _sections(text: str, level: int) -> list[tuple[str, str]]:
    marks = list(HEADINGS[level].finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    parts = [(m.group(1).strip(), text[m.start() : end].strip()) for m, end in zip(marks, ends)]
    return parts


def _continued(title: str, parts: list[str]) :
    for i, part in enumerate(parts):
        yield (title if i == 0 else f"{title} (cont.)"), part


def _fit(title: str, body: str, level: int, max_size: int) :
    """(title, content, section) pieces of one section."""
    if len(body) <= max_size:
        yield title, body, title
        return
    below = _sections(body, level + 1) if level < DEEPEST_LEVEL else []
    if not below:
        for name, part in _continued(title, pack_paragraphs(body, max_size)):
            yield name, part, title
    for sub_title, sub_body in below:
        if len(sub_body) >= MIN_SECTION:
            yield from _fit(sub_title, sub_body, level + 1, max_size)


def chunk_markdown(text: str, path: str, max_size: int = DEFAULT_MAX, keep_preamble: bool = False) -> list[dict]:
    """Chunks by second-level heading, deeper headings, then paragraphs.

    Text before the first heading of a level is dropped unless
    ``keep_preamble`` asks for it.
    """
    first = HEADINGS[1].search(text)
    doc_title = first.group(1).strip() if first else _stem(path)
    sections = _sections(text, 2)
    whole = text.strip()
    if not sections:
        parts = _continued(doc_title, pack_paragraphs(whole, max_size))
        return [{"title": t, "content": c, "section_path": doc_title} for t, c in parts]
    out = []
    if keep_preamble:
        before = text[: HEADINGS[2].search(text).start()].strip()
        parts = _continued(doc_title, pack_paragraphs(before, max_size)) if len(before) >= MIN_SECTION else ()
        out += [{"title": t, "content": c, "section_path": doc_title} for t, c in parts]
    for title, body in sections:
        if len(body) >= MIN_SECTION:
            for name, part, section in _fit(title, body, 2, max_size):
                out.append({"title": name, "content": part, "section_path": f"{doc_title} > {section}"})
    return out or [{"title": doc_title, "content": whole, "section_path": doc_title}]


def _stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return name[:dot] if 0 < dot < len(name) - 1 else name


