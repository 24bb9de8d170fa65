"""Walks over lists of numbers as bytes: what they reach and what they exchange."""

import re

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.operators import graph, walks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def random_links(seed: int, paths: int, links: int):
    rng = np.random.default_rng(seed)
    ends = zip(rng.integers(0, paths, links), rng.integers(0, paths, links), rng.integers(0, 3, links))
    return sorted({(f"n{a}", f"n{b}", f"t{k}") for a, b, k in ends})


def brute_by_type(edges, start, depth):
    found, seen, ahead = {}, {start}, {start}
    for hop in range(1, depth + 1):
        steps = {(t, k) for a, b, k in edges for s, t in ((a, b), (b, a)) if s in ahead and t != start}
        for step in steps:
            found.setdefault(step, hop)
        ahead = {t for t, _ in steps} - seen
        seen |= ahead
    return found


def test_numbers_as_bytes():
    lists = [[0], [5, 127, 128], [2**62 - 1], [3, 70_000, 2**40], [16_383, 16_384]]
    values, firsts = np.concatenate(lists), np.cumsum([0, 1, 3, 1, 3])
    plain, grown = walks.to_bytes(values, firsts), walks.to_bytes(walks.gaps(values, firsts), firsts)
    for at, n in ((0, 5), (1, 3), (4, 1), (2, 0)):
        want = [x for part in lists[at : at + n] for x in part]
        for found, counts in (walks.from_bytes(plain.slice(at, n)), walks.growing(grown.slice(at, n))):
            assert found.tolist() == want and counts.tolist() == [len(x) for x in lists[at : at + n]]
    assert walks.to_bytes(np.arange(100), np.array([0])).nbytes < 120


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_sightings_do_not_depend_on_the_cut_of_batches(monkeypatch, size):
    monkeypatch.setattr(walks, "BLOCK", 4)
    # Start, part, code, paths; kinds are two, codes 2 and 3 differ in the direction only.
    steps = [(1, -1, -1, [], "a"), (1, 0, -1, [3, 9], None), (1, 0, 0, [3, 8], None), (1, 0, 2, [1, 7, 8], None), (1, 0, 3, [2, 7], None)]
    steps += [(1, 0, 3, [9, 11], None), (1, 0, 4, [0, 2], None), (2, -1, -1, [], "b"), (3, -1, -1, [], "c"), (3, 0, 1, [1, 2], None)]
    firsts = np.cumsum([len(s[3]) for s in steps]) - [len(s[3]) for s in steps]
    values = np.array([x for s in steps for x in s[3]])
    keep = [len(s[3]) > 0 for s in steps]
    packed = iter(walks.to_bytes(walks.gaps(values, firsts[keep]), firsts[keep]).to_pylist())
    far = pa.array([next(packed) if k else b"" for k in keep], pa.binary())
    columns = [pa.array([s[i] for s in steps], pa.int64()) for i in range(3)]
    rows = pa.RecordBatch.from_arrays([*columns, far, pa.array([s[4] for s in steps])], ["start", "part", "code", "far", "name"])

    def found(**options):
        out = []
        for b in walks.first_sightings(**options)(rows.slice(i, size) for i in range(0, len(steps), size)):
            ids, counts = walks.growing(b["far"])
            assert (ids // 4 == np.repeat(b["block"].to_numpy(), counts)).all()
            names, kinds = (np.repeat(b[c].to_pylist(), counts).tolist() for c in ("name", "kind"))
            out += zip(names, walks.from_bytes(b["place"])[0].tolist(), ids.tolist(), kinds, strict=True)
        return sorted(out)

    want = [("a", 3, 8, 0), ("a", 4, 2, 1), ("a", 5, 7, 0), ("a", 6, 11, 1), ("a", 7, 0, 0), ("c", 1, 1, 1), ("c", 2, 2, 1)]
    assert found(kinds=2) == want
    assert found(kinds=2, limit=4) == [x for x in want if x[1] <= 4]
    assert [x[2] for x in found() if x[0] == "a"] == [0, 2, 7, 8, 11]


def test_walks_by_type_match_a_plain_walk(spark):
    edges = random_links(11, 40, 90)
    links = spark.createDataFrame([*edges, *edges[:5], ("n1", None, "t0"), ("n1", "n1", "t1")], "source_path string, target_path string, relation_type string")
    starts = spark.createDataFrame([("n1",), ("n2",), ("n1",), ("missing",), (None,)], "path string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for depth in (1, 2, 3):
            rows = graph.related_by_type(links, starts, depth).collect()
            for start in ("n1", "n2", "missing"):
                got = [((r.related_path, r.relation_type), r.hops) for r in rows if r.path == start]
                assert sorted(got) == sorted(brute_by_type([*edges, ("n1", "n1", "t1")], start, depth).items())
            assert {r.path for r in rows} <= {"n1", "n2"}
        whole = graph.related(links, starts, 3)
        want = sorted(map(str, whole.filter("position <= 7").collect()))
        assert sorted(map(str, graph.related(links, starts, 3, limit=7).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("walk", [graph.related, graph.related_by_type])
def test_what_walks_reach_is_not_exchanged_by_row_for_its_names(spark, walk):
    """After the exchange by start only lists are exchanged, by block of paths."""
    links = spark.createDataFrame(random_links(5, 30, 200), "source_path string, target_path string, relation_type string")
    starts = spark.createDataFrame([("n1",), ("n2",)], "path string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        above = plan(walk(links, starts, 2)).split("Exchange hashpartitioning(start#")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\w+)#", above) == [("block", "share")]
    assert "Exchange hashpartitioning(path#" not in above


def test_pairs_are_dealt_out_once_for_both_branches(spark):
    links = spark.createDataFrame(random_links(5, 30, 200), "source_path string, target_path string, relation_type string")
    starts = spark.createDataFrame([("n1",)], "path string")
    seen = graph.numbered(links, starts, None, one_kind=True)
    rows = [(r.near, r.kind, x) for r in seen.lists.collect() for x in walks.growing(pa.array([r.far], pa.binary()))[0].tolist()]
    ids = {r.name: r.id for r in seen.paths.collect()}
    assert sorted(ids, key=ids.get) == sorted(ids) and sorted(ids.values()) == list(range(len(ids)))
    want = {}
    for a, b, k in random_links(5, 30, 200):
        for near, far, out in ((a, b, 1), (b, a, 0)) if a != b else ((a, b, 1),):
            key = ids[near], ids[far]
            want[key] = min(want.get(key, 99), int(k[1]) * 2 + out)
    assert sorted(rows) == sorted((near, kind, far) for (near, far), kind in want.items())
