"""Hamming neighbours of 64-bit fingerprints, compared as vertical bit planes.

Fingerprints of a block are transposed: word ``w`` of plane ``b`` holds bit ``b``
of 64 fingerprints.  One XOR then gives one bit of difference for 64 pairs, and
the differences are added by carry-save adders into counters that are sliced in
the same way.  A counter starts at ``2^width - 1 - radius``, so the carry out of
its top is set exactly when a pair has exceeded the radius.  A (query, word)
entry whose 64 pairs have all exceeded it is abandoned.
"""

from __future__ import annotations

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)
# Entries (query x word) compared at a time: bounds the memory of one step.
ENTRIES = 1 << 16
STRIDE = 8
# Pairs whose sketches are compared at a time.
PAIRS = 1 << 16


def _planes(values: np.ndarray) -> np.ndarray:
    """(64, words): the transposed bits of values, whose number is a multiple of 64."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return packed.view("<u8")


def _within(planes, values, valid, query, word, radius):
    """The pairs of the entries (query, word) that differ in at most ``radius`` bits."""
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    count = [np.full(len(query), FULL if start >> k & 1 else 0, np.uint64) for k in range(width)]
    over = ~valid[word]
    mine = values[query]

    def add(level: int, carry: np.ndarray) -> None:
        for k in range(level, width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        np.bitwise_or(over, carry, out=over)

    def difference(bit: int) -> np.ndarray:
        return planes[bit][word] ^ (np.uint64(0) - ((mine >> np.uint64(bit)) & ONE))

    for bit in range(0, 64, 2):
        x, y = difference(bit), difference(bit + 1)
        if width:
            half = count[0] ^ x
            carry = (count[0] & x) | (half & y)
            count[0] = half ^ y
            add(1, carry)
        else:
            over |= x | y
        if bit % STRIDE == STRIDE - 2:
            alive = np.flatnonzero(over != FULL)
            if not len(alive):
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if len(alive) < 0.7 * len(over):
                query, word, over, mine = query[alive], word[alive], over[alive], mine[alive]
                count = [c[alive] for c in count]
    near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    entry, lane = np.nonzero(near)
    return query[entry], word[entry] * 64 + lane


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable position of each of n positions."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def linked(
    blocks: list[np.ndarray],
    radius: int,
    nodes: list[np.ndarray] | None = None,
    sketches: list[np.ndarray] | None = None,
    agree: int = 0,
):
    """Edges (member, smallest member linked to it inside the block), over all blocks.

    Each block is compared with itself only.  The edges span the components of
    the block, so a block of n members yields fewer than n edges.  Members are their
    values, each once, or the numbers in ``nodes``, whose values may be equal.  ``sketches``
    has a row of bytes for each member: a pair then also has to agree in ``agree`` of them.
    """
    values = [np.asarray(b, dtype=np.int64).view(np.uint64) for b in blocks]
    if nodes is None:
        order = [np.unique(v, return_index=True)[1] for v in values]
    else:
        order = [np.argsort(n, kind="stable") for n in nodes]
    chosen = [i for i, found in enumerate(order) if len(found) > 1]
    blocks = [values[i][order[i]] for i in chosen]
    names = iter(blocks if nodes is None else [nodes[i][order[i]] for i in chosen])
    marks = None if sketches is None else iter([sketches[i][order[i]] for i in chosen])
    none = np.empty(0, np.int64)
    if not blocks:
        return none, none
    left, right = [none], [none]
    group: list[np.ndarray] = []
    size = 0
    for block in [*blocks, None]:
        cost = 0 if block is None else len(block) * -(-len(block) // 64)
        if group and (block is None or size + cost > ENTRIES):
            own = None if marks is None else [next(marks) for _ in group]
            a, b = _linked_group(group, radius, [next(names) for _ in group], own, agree)
            left.append(a)
            right.append(b)
            group, size = [], 0
        if block is not None:
            group.append(block)
            size += cost
    return np.concatenate(left), np.concatenate(right)


def _linked_group(blocks: list[np.ndarray], radius: int, nodes: list[np.ndarray], sketches: list[np.ndarray] | None, agree: int):
    words = np.array([-(-len(b) // 64) for b in blocks])
    first = np.concatenate([[0], np.cumsum(words)])
    values = np.zeros(first[-1] * 64, np.uint64)
    names = np.zeros(first[-1] * 64, np.int64)
    valid = np.zeros(first[-1] * 64, bool)
    for block, own, at in zip(blocks, nodes, first, strict=False):
        values[at * 64 : at * 64 + len(block)] = block
        names[at * 64 : at * 64 + len(block)] = own.astype(np.int64)
        valid[at * 64 : at * 64 + len(block)] = True
    if sketches is not None:
        marks = np.zeros((len(values), sketches[0].shape[1]), np.uint8)
        for sketch, at in zip(sketches, first, strict=False):
            marks[at * 64 : at * 64 + len(sketch)] = sketch
    planes = _planes(values)
    lanes = np.packbits(valid, bitorder="little").view("<u8")
    members = np.flatnonzero(valid)
    of_block = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    here = words[of_block]
    query = np.repeat(members, here)
    steps = np.arange(len(query)) - np.repeat(np.concatenate([[0], np.cumsum(here)[:-1]]), here)
    word = np.repeat(first[:-1][of_block], here) + steps
    keep = word >= query // 64  # the other half of the pairs is the same
    query, word = query[keep], word[keep]
    root = np.arange(len(values))
    for at in range(0, len(query), ENTRIES):
        a, b = _within(planes, values, lanes, query[at : at + ENTRIES], word[at : at + ENTRIES], radius)
        if sketches is not None:
            kept = [(marks[a[i : i + PAIRS]] == marks[b[i : i + PAIRS]]).sum(1) >= agree for i in range(0, len(a), PAIRS)]
            kept = np.concatenate(kept) if kept else np.empty(0, bool)
            a, b = a[kept], b[kept]
        a, b = np.concatenate([a, np.arange(len(root))]), np.concatenate([b, root])
        root = _roots(len(root), a[a != b], b[a != b])
    child = np.flatnonzero(root != np.arange(len(root)))
    return names[child], names[root[child]]
