"""The link graph: neighbours, bounded traversal, topology, co-change edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import walks
from scriptorium.operators.ranking import top_k
from scriptorium.operators.usage import head_chunks, with_heads
from scriptorium.session import small_batches, written

# Result limits (fixed values).
HUB_LIMIT = 10
CO_CHANGE_MIN, CO_CHANGE_MAX = 2, 20
HISTORY_PREFIX = "git-history/"


def adjacency(links: DataFrame, relation_type: str | None = None) -> DataFrame:
    """Both directions of every edge as (path, related_path, relation_type, direction).

    This turns the "source or target equals" condition into an equi-join.
    """
    if relation_type:
        links = links.filter(F.col("relation_type") == relation_type)
    outgoing = links.select(
        F.col("source_path").alias("path"),
        F.col("target_path").alias("related_path"),
        "relation_type",
        F.lit("outgoing").alias("direction"),
    )
    incoming = links.filter(F.col("source_path") != F.col("target_path")).select(
        F.col("target_path").alias("path"),
        F.col("source_path").alias("related_path"),
        "relation_type",
        F.lit("incoming").alias("direction"),
    )
    return outgoing.unionByName(incoming)


def with_titles(rows: DataFrame, chunks: DataFrame, path: str = "related_path") -> DataFrame:
    heads = head_chunks(chunks).select(F.col("file_path").alias(path), "title", "category")
    return rows.join(heads, path, "left")


def related_one_hop(
    links: DataFrame, starts: DataFrame, relation_type: str | None = None, chunks: DataFrame | None = None
) -> DataFrame:
    """Every edge at each start, one row per edge and without a limit."""
    rows = adjacency(links, relation_type).join(starts.select("path").distinct(), "path")
    return rows if chunks is None else with_titles(rows, chunks)


# Neighbours in one row of a list; a path with more has several rows.
LIST_SIZE = 1024


class Numbered(NamedTuple):
    """A link table in numbers, which sort as the paths and relation types do."""

    paths: DataFrame  # id without gaps, name
    types: DataFrame  # type, relation_type
    starts: DataFrame  # start, name
    lists: DataFrame  # near, kind, far: the neighbours over links of one kind, as bytes
    kinds: int


def numbered_paths(names: DataFrame) -> DataFrame:
    """(id, name): the place of each name in their order."""
    # Ids grow with the partitions of a sorted table; writing it fixes them.
    placed = written(names.orderBy("name").withColumn("id", F.monotonically_increasing_id()), "paths")
    part = F.shiftright("id", 33).alias("part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.col("id").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(F.broadcast(written(before, "parts")), "part").select((F.col("before") + within).alias("id"), "name")


def numbered(links: DataFrame, starts: DataFrame, relation_type: str | None, one_kind: bool) -> Numbered:
    """Number the paths and gather the neighbours of each in lists.

    A kind is twice the number of the relation type, plus one for outgoing links.
    ``one_kind`` keeps only the least kind of each pair of paths; otherwise the
    direction is left out and each pair counts once per type.  A pair goes to its
    lesser path first, where links both ways become one.
    """
    small_batches(links.sparkSession)
    if relation_type:
        links = links.filter(F.col("relation_type") == relation_type)
    origin = starts.select(F.col("path").alias("name")).distinct()
    names = links.select(F.explode(F.array("source_path", "target_path")).alias("name")).union(origin).distinct()
    paths = numbered_paths(names)
    order = Window.orderBy("relation_type")
    types = links.select("relation_type").distinct().withColumn("type", F.row_number().over(order).cast("long") - 1)
    types = written(types, "types")
    outgoing = (F.col("source_path") <= F.col("target_path")).cast("long")
    # Seen from the other end, a link has the other direction.
    kinds = [F.col("type") * 2 + outgoing, F.col("type") * 2 + 1 - outgoing] if one_kind else [F.col("type")] * 2
    pairs = (
        links.filter("source_path is not null and target_path is not null")
        .join(F.broadcast(types), "relation_type")
        .select(
            F.least("source_path", "target_path").alias("low_name"),
            F.greatest("source_path", "target_path").alias("high_name"),
            (_long(0) if one_kind else F.col("type")).alias("part"),
            kinds[0].alias("low_kind"),
            kinds[1].alias("high_kind"),
        )
        .mapInArrow(walks.merge_pairs, walks.PAIRS)
        .repartition("low_name")
    )
    # Sorting by pair also serves the join that follows; a map of all pairs would take more memory.
    pair = Window.partitionBy("low_name", "high_name", "part").orderBy("kinds")
    least = F.min(F.col("kinds") % walks.KINDS).over(pair.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pairs = pairs.withColumns({"n": F.row_number().over(pair), "high_kind": least}).filter("n = 1")
    both = F.col("kinds") - F.col("kinds") % walks.KINDS + F.col("high_kind")
    low = paths.select(F.col("id").alias("low"), F.col("name").alias("low_name"))
    high = paths.select(F.col("id").alias("high"), F.col("name").alias("high_name"))
    ends = pairs.select("low_name", "high_name", both.alias("kinds")).join(low, "low_name").drop("low_name").join(high, "high_name")
    # The pairs of a greater path are in one task by now; only lesser paths are dealt out again.
    kind = F.shiftright("kinds", 31), F.col("kinds") % walks.KINDS
    of_high = ends.select(F.col("high").alias("near"), kind[1].alias("kind"), F.col("low").alias("far"))
    of_high = of_high.filter(~F.col("near").eqNullSafe(F.col("far")))
    of_low = ends.select(F.col("low").alias("near"), kind[0].alias("kind"), F.col("high").alias("far")).repartition("near")
    edges = of_high.union(of_low).sortWithinPartitions("near", "kind", "far")
    lists = written(edges.mapInArrow(walks.pack_lists(LIST_SIZE), walks.LISTS), "neighbours")
    begins = written(paths.join(origin, "name", "left_semi").select(F.col("id").alias("start"), "name"), "starts")
    return Numbered(paths, types, begins, lists, 2 * types.count())


def step(
    graph: Numbered, ahead: DataFrame, known: list[DataFrame], part: Column, code: Column, kinds: int | None = None, limit: int | None = None
) -> DataFrame:
    """What the lists of the paths ``ahead`` reach first; see ``walks.first_sightings``."""
    steps = ahead.join(graph.lists, F.col("path") == F.col("near")).select("start", part.alias("part"), code.alias("code"), "far")
    return sightings(graph, [steps, *known], kinds, limit)


def sightings(graph: Numbered, rows: list[DataFrame], kinds: int | None = None, limit: int | None = None) -> DataFrame:
    """A level is exchanged here, once, by start and as lists."""
    own = graph.starts.select("start", _long(-1).alias("part"), _long(-1).alias("code"), F.lit("").cast("binary").alias("far"), "name")
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [own, *rows])
    ordered = everything.select("start", "part", "code", "far", "name").repartition("start").sortWithinPartitions("start", "part", "code")
    return ordered.mapInArrow(walks.first_sightings(kinds, limit), walks.REACHED)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def with_names(levels: list[DataFrame], graph: Numbered) -> DataFrame:
    """The levels, one row for each path reached, with the names of both paths.

    Lists are exchanged by block of paths, and meet the names of the block there.
    """
    block = F.floor(F.col("id") / walks.BLOCK).alias("block")
    spelled = graph.paths.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("named"))
    shares = F.explode(F.sequence(F.lit(0), F.lit(walks.SHARES - 1))).alias("share")
    names = spelled.select("block", shares, F.col("named.name").alias("names"))
    reached = reduce(DataFrame.unionByName, levels).withColumn("share", F.pmod(F.hash("start"), F.lit(walks.SHARES))).drop("start")
    both = names.unionByName(reached, allowMissingColumns=True).repartition("block", "share")
    return both.sortWithinPartitions("block", "share", F.col("names").isNull()).mapInArrow(walks.spell, walks.ROWS)


def related(
    links: DataFrame,
    starts: DataFrame,
    depth: int = 1,
    relation_type: str | None = None,
    chunks: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Breadth-first neighbours up to ``depth`` hops; a path counts once, where
    it is first seen, in the order of hop and then of the edges that led to it.

    The order of a path is that of the path before it, then of the relation, then
    of its own name.  So the position of the path before it stands for the whole
    walk.  A level is exchanged once, by start and as lists of neighbours; the
    first sightings and their positions are found where the lists arrive.
    """
    depth = max(1, depth)
    if depth == 1:
        return related_one_hop(links, starts, relation_type, chunks)
    graph = numbered(links, starts, relation_type, one_kind=True)
    code = F.col("position") * graph.kinds + F.col("kind")
    ahead = graph.starts.select("start", F.col("start").alias("path"), _long(0).alias("position"))
    levels, known = [], []
    for hop in range(1, depth + 1):
        last = hop == depth
        level = step(graph, ahead, known, _long(0), code, graph.kinds, limit if last else None)
        if not last:
            level = written(level, f"hop{hop}")
            ahead = level.select("start", "far", "place").mapInArrow(walks.frontier, "start long, path long, position long")
            # Paths seen before come first in the order, and so count in the positions.
            known.append(level.select("start", _long(0).alias("part"), _long(-1).alias("code"), "far"))
        levels.append(level.withColumn("hops", F.lit(hop)))
    everything = with_names(levels, graph)
    kept = everything if limit is None else everything.filter(F.col("position") <= limit)
    # The direction decides between links to one path only, not between paths.
    direction = F.when(F.col("kind") % 2 == 1, "outgoing").otherwise("incoming").alias("direction")
    rows = kept.withColumn("type", F.shiftright("kind", 1)).join(F.broadcast(graph.types), "type")
    rows = rows.select("path", "related_path", "relation_type", direction, "hops", F.col("position").cast("int").alias("position"))
    return rows if chunks is None else with_titles(rows, chunks)


def related_by_type(
    links: DataFrame,
    starts: DataFrame,
    depth: int = 2,
    relation_type: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Fewest hops per (path, relation type), walks never returning to the start.

    An edge of some type reaches its far end one hop after the near end was
    first reached, so the distances of the near ends are enough.  As in
    ``related``, a level is exchanged once, by start and as lists.
    """
    depth = max(1, depth)
    graph = numbered(links, starts, relation_type, one_kind=False)
    ahead = graph.starts.select("start", F.col("start").alias("path"))
    levels, known, passed = [], [], []
    for hop in range(1, depth + 1):
        level = step(graph, ahead, known, F.col("kind"), _long(0))
        if hop < depth:
            level = written(level, f"typed{hop}")
            known.append(level.select("start", F.col("kind").alias("part"), _long(-1).alias("code"), "far"))
            # The first sighting of a path, over all types, goes on from there.
            new = level.select("start", _long(0).alias("part"), _long(0).alias("code"), "far")
            first = written(sightings(graph, [new, *passed]), f"first{hop}")
            passed.append(first.select("start", _long(0).alias("part"), _long(-1).alias("code"), "far"))
            ahead = first.select("start", "far", "place").mapInArrow(walks.frontier, "start long, path long, position long")
        levels.append(level.withColumn("hops", F.lit(hop)))
    found = with_names(levels, graph).withColumnRenamed("kind", "type").drop("position")
    if limit is not None:
        found = top_k(found, ["path"], [F.col("hops"), F.col("related_path"), F.col("type")], limit, "position").drop("position")
    return found.join(F.broadcast(graph.types), "type").select("path", "related_path", "relation_type", "hops")


def graph_totals(links: DataFrame, chunks: DataFrame) -> DataFrame:
    docs = chunks.agg(F.countDistinct("file_path").alias("n")).scalar()
    return links.agg(
        F.count(F.lit(1)).alias("total_edges"), F.countDistinct("relation_type").alias("relation_kinds")
    ).withColumn("total_docs", docs)


def relation_distribution(links: DataFrame) -> DataFrame:
    return (
        links.groupBy("relation_type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "relation_type")
    )


def hubs(links: DataFrame, chunks: DataFrame, limit: int = HUB_LIMIT) -> DataFrame:
    """The most connected paths; titles are looked up for those few only."""
    ends = links.select(F.col("source_path").alias("path")).unionAll(links.select(F.col("target_path").alias("path")))
    top = (
        ends.groupBy("path")
        .agg(F.count(F.lit(1)).alias("connections"))
        .orderBy(F.col("connections").desc(), "path")
        .limit(limit)
    )
    named = with_heads(top.withColumnRenamed("path", "file_path"), chunks, limit, ["title", "category"])
    return named.withColumnRenamed("file_path", "path").orderBy(F.col("connections").desc(), "path")


def orphans(links: DataFrame, chunks: DataFrame, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Documents without any link, commit histories aside."""
    docs = head_chunks(chunks).filter(~F.col("file_path").startswith(HISTORY_PREFIX))
    if category:
        docs = docs.filter(F.col("category") == category)
    linked = links.select(F.col("source_path").alias("file_path")).union(
        links.select(F.col("target_path").alias("file_path"))
    )
    alone = docs.join(linked, "file_path", "left_anti").select(F.col("file_path").alias("path"), "title", "category")
    ordered = alone.orderBy("category", "path")
    return ordered if limit is None else ordered.limit(limit)


def co_change_links(commit_files: DataFrame, prefix: str = HISTORY_PREFIX, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """Edges both ways between the histories of files changed together.

    ``commit_files`` is (commit, file), one row each.  Files may be numbers, which ``name``
    turns into paths once the pairs are made.  Commits with more than
    ``CO_CHANGE_MAX`` files carry no edges by definition; they are dropped by
    count before any pair is made, so a commit yields a bounded number.  A pair
    is exchanged once and without the prefix; both edges are made after that.
    """
    # Files that are partitioned by commit are not exchanged again up to the pairs.
    size = F.count(F.lit(1)).over(Window.partitionBy("commit_id"))
    kept = commit_files.withColumn("n", size).filter(F.col("n").between(CO_CHANGE_MIN, CO_CHANGE_MAX))
    together = kept.groupBy("commit_id").agg(F.array_sort(F.collect_set("file")).alias("files"))
    ends = together.select("files", F.posexplode("files").alias("i", "a"))
    pairs = ends.select("a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("b"))
    # Few pairs repeat among the commits of one task, so none are looked for before the exchange.
    pairs = pairs.repartition("a", "b").distinct()
    named = pairs.select(*(F.concat(F.lit(prefix), F.col(c) if name is None else name(F.col(c))).alias(c) for c in ("a", "b")))

    def edge(source: str, target: str) -> Column:
        return F.struct(F.col(source).alias("source_path"), F.col(target).alias("target_path"), F.lit("git_co_change").alias("relation_type"))

    return named.select(F.inline(F.array(edge("a", "b"), edge("b", "a"))))


def relabel_history_links(links: DataFrame) -> DataFrame:
    """Give old history links their own types, by the prefixes of both ends."""

    def inside(column: str) -> Column:
        return F.col(column).startswith(HISTORY_PREFIX)

    old = F.col("relation_type") == "relates_to"
    kind = (
        F.when(old & inside("source_path") & inside("target_path"), "git_co_change")
        .when(old & inside("source_path") & ~inside("target_path"), "git_ref")
        .otherwise(F.col("relation_type"))
    )
    return links.withColumn("relation_type", kind)
