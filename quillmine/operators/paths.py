"""Chains, paths and cycles of directed graphs, in the order in which a search would find them.

Names are compared by code points. What is searched is cut to the first so many results while it grows, so
a limit never enumerates what it then leaves out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.operators.clustering import components
from quillmine.operators.graphs import reached, strong_components
from quillmine.sources.tables import rewritten

#: Connected parts of so many edges at most are searched for cycles as a whole, in one task each.
CYCLE_EDGES = 10_000


def first_chains(edges: DataFrame, depth: int = 6, most: int = 250, starts: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(path, steps): the first chains of a depth-first search from the starts (node; null: all sources), in the order of names.

    A chain has no node twice and ends at a target (node), after depth steps, or where no other node follows.
    Chains in search order are chains in the order of their paths, and every prefix belongs to one at least.
    So of all prefixes of a length, together with the chains that ended before, only the first most can
    matter: a round keeps these.
    """
    if depth < 1 or most < 1:
        raise ValueError("depth and most must be positive")
    e = rewritten(edges.where("source <> target").select("source", "target").distinct())
    begin = e.select(F.col("source").alias("node")).distinct()
    if starts is not None:
        begin = begin.join(starts.select("node").distinct(), "node", "left_semi")
    ends = None if targets is None else targets.select(F.col("node").alias("target")).distinct().withColumn("is_end", F.lit(True))
    rows = rewritten(begin.orderBy("node").limit(most).select(F.array("node").alias("path"), F.lit(False).alias("done")))
    for step in range(1, depth + 1):
        going = rows.where("not done")
        # most rows at most.
        more = e.join(F.broadcast(going.withColumn("source", F.element_at("path", -1))), "source").where(~F.array_contains("path", F.col("target")))
        if ends is not None:
            more = more.join(ends, "target", "left")
        done = F.lit(step == depth) if ends is None else F.coalesce("is_end", F.lit(step == depth))
        longer = rewritten(more.select(F.concat("path", F.array("target")).alias("path"), done.alias("done"), F.col("path").alias("of")).orderBy("path").limit(most))
        # A prefix without a longer one is at a dead end, or has none among the first; then it comes after them all.
        went = more.select(F.col("path").alias("of")).distinct()
        stuck = going.join(F.broadcast(went), F.col("path") == F.col("of"), "left_anti").select("path", F.lit(True).alias("done"))
        rows = rewritten(rows.where("done").unionByName(stuck).unionByName(longer.drop("of")).orderBy("path").limit(most))
        if rows.where("not done").isEmpty():
            break
    return rows.select("path", (F.size("path") - 1).alias("steps"))


def chains(edges: DataFrame, **search) -> DataFrame:
    """(chain, depth) of first_chains()."""
    return first_chains(edges, **search).select(F.array_join("path", "->").alias("chain"), F.col("steps").alias("depth"))


def paths_between(edges: DataFrame, source: str, target: str, depth: int = 6, most: int = 100, types: list[str] | None = None) -> DataFrame:
    """(path, types, steps): the first paths without a repeated node from source to target, shortest first, then by target and type of their edges.

    edges: (source, target, type). Nodes from which the target is further than the steps left aren't entered, and
    the search ends with the length at which enough paths are found.
    """
    e = edges if types is None else edges.where(F.col("type").isin(types))
    e = rewritten(e.select("source", "target", "type").distinct())
    spark = edges.sparkSession
    kind = dict(e.dtypes)["source"]
    rows = spark.createDataFrame([(source,)], f"node {kind}")
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    left = rewritten(reached(back, spark.createDataFrame([(target,)], f"node {kind}"), depth).groupBy("node").agg(F.min("distance").alias("left")))
    open_ = rows.select(F.array("node").alias("path"), F.array().cast("array<string>").alias("types"), F.array().cast("array<string>").alias("key"))
    found, n = open_.where(F.element_at("path", -1) == target), int(source == target)
    open_ = open_.where(F.element_at("path", -1) != target)
    for step in range(1, depth + 1):
        if n >= most:
            break
        more = open_.withColumn("source", F.element_at("path", -1)).join(e, "source").where(~F.array_contains("path", F.col("target")))
        more = more.join(left.select(F.col("node").alias("target"), "left"), "target").where(F.col("left") <= depth - step)
        name = F.col("target").cast("string")
        more = rewritten(more.select(F.concat("path", F.array("target")).alias("path"), F.concat("types", F.array("type")).alias("types"), F.concat("key", F.array(name, "type")).alias("key"), (F.col("target") == target).alias("hit")))
        hits = more.where("hit").drop("hit")
        found = found.unionByName(hits)
        n += hits.count()
        open_ = more.where("not hit").drop("hit")
        if open_.isEmpty():
            break
    return found.orderBy(F.size("path"), "key").limit(most).select("path", "types", (F.size("path") - 1).alias("steps"))


def impact_radius(edges: DataFrame, changed: DataFrame, direction: str = "INCOMING", depth: int = 6, most: int = 500) -> tuple[DataFrame, int]:
    """((node, distance), how many more): nodes within depth steps of changed ones (node), nearest first, without these.

    OUTGOING follows edges (source, target), INCOMING goes against them, BOTH goes either way.
    """
    ways = {"OUTGOING": edges, "BOTH": edges, "INCOMING": edges.select(F.col("target").alias("source"), F.col("source").alias("target"))}
    if direction not in ways:
        raise ValueError(f"direction must be one of {', '.join(ways)}")
    rows = rewritten(reached(ways[direction], changed, depth, both=direction == "BOTH").where("distance > 0"))
    return rows.orderBy("distance", "node").limit(most), max(0, rows.count() - most)


def cyclic_components(edges: DataFrame, least: int = 2, most: int = 100) -> DataFrame:
    """(component, size, internal_edges, severity) of strongly connected components of so many nodes, the largest first.

    A component is named by its least node; from 5 nodes on it is HIGH, from 3 on MEDIUM, else LOW.
    """
    if least < 1 or most < 1:
        raise ValueError("least and most must be positive")
    e = rewritten(edges.select("source", "target").distinct())
    of = strong_components(e)
    names = of.groupBy("component").agg(F.min("node").alias("name"), F.count("*").alias("size")).where(F.col("size") >= least)
    held = rewritten(of.join(names, "component").select("node", "name", "size"))
    inner = e.join(held.select(F.col("node").alias("source"), "name"), "source").join(held.select(F.col("node").alias("target"), F.col("name").alias("other")), "target").where("name = other")
    counts = inner.groupBy("name").agg(F.count("*").alias("internal_edges"))
    severity = F.when(F.col("size") >= 5, "HIGH").when(F.col("size") >= 3, "MEDIUM").otherwise("LOW")
    rows = held.select("name", "size").distinct().join(counts, "name", "left")
    rows = rows.select(F.col("name").alias("component"), "size", F.coalesce("internal_edges", F.lit(0)).cast("long").alias("internal_edges"), severity.alias("severity"))
    return rows.orderBy(F.desc("size"), "component").limit(most)


def _back_edges(nodes: list, after: dict) -> list[list]:
    """The cycles that a depth-first search closes, going through nodes and through what follows each in order."""
    seen, found = set(), {}
    for root in nodes:
        if root in seen:
            continue
        seen.add(root)
        trail, place, rest = [root], {root: 0}, [iter(after.get(root, ()))]
        while rest:
            for nxt in rest[-1]:
                if nxt in place:
                    cycle = [*trail[place[nxt] :], nxt]
                    found[tuple(cycle)] = cycle
                elif nxt not in seen:
                    seen.add(nxt)
                    place[nxt] = len(trail)
                    trail.append(nxt)
                    rest.append(iter(after.get(nxt, ())))
                    break
            else:
                rest.pop()
                del place[trail.pop()]
    return list(found.values())


def cycles(nodes: DataFrame, edges: DataFrame, part_edges: int = CYCLE_EDGES) -> DataFrame:
    """(node_a, node_b, path, steps): cycles closed by the back edges of a depth-first search; not all cycles there are.

    Nodes (node, at) are begun with in the order of at, edges (source, target, at) followed in theirs. Parts
    that no edge joins don't influence each other, so each is a task's group; the search goes through a part of
    part_edges at most just as through the whole graph. Of a larger part, every strongly connected component is
    a group of its own, searched from its first node; there the cycles may be other ones than those of one search.
    """
    e = rewritten(edges.select("source", "target", "at"))
    part = rewritten(components(e.select(F.col("source").alias("a"), F.col("target").alias("b"))))
    alone = e.where("source = target").select(F.col("source").alias("node")).distinct().join(part, "node", "left_anti")
    part = part.unionByName(alone.select("node", F.col("node").alias("component")))
    kind = dict(e.dtypes)["source"]
    sides = e.join(part.select(F.col("node").alias("source"), "component"), "source")
    large = rewritten(sides.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > part_edges))
    key = F.col("component").cast("string")
    kept = sides.join(large, "component", "left_anti").select(F.concat(F.lit("p:"), key).alias("part"), "source", "target", "at")
    starts = nodes.join(part, "node").join(large, "component", "left_anti").select(F.concat(F.lit("p:"), key).alias("part"), "node", "at")
    if not large.isEmpty():
        inner = sides.join(large, "component", "left_semi").select("source", "target", "at")
        of = rewritten(strong_components(inner.select("source", "target")).select("node", F.concat(F.lit("c:"), F.col("component").cast("string")).alias("part")))
        both = inner.join(of.select(F.col("node").alias("source"), "part"), "source").join(of.select(F.col("node").alias("target"), F.col("part").alias("other")), "target").where("part = other")
        kept = kept.unionByName(both.select("part", "source", "target", "at"))
        starts = starts.unionByName(nodes.join(of, "node").select("part", "node", "at"))
    lines = kept.select("part", "source", "target", "at", F.lit(False).alias("begins")).unionByName(starts.select("part", F.col("node").alias("source"), F.col("node").alias("target"), "at", F.lit(True).alias("begins")))

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("at", "ascending"), ("source", "ascending"), ("target", "ascending")])
        begin, after = [], {}
        for a, b, begins in zip(*[rows[c].to_pylist() for c in ("source", "target", "begins")], strict=True):
            if begins:
                begin.append(a)
            else:
                after.setdefault(a, []).append(b)
        found = _back_edges(begin, after)
        of = rows.schema.field("source").type
        ends = [pa.array([c[i] for c in found], of) for i in (-1, -2)]
        return pa.table([*ends, pa.array(["->".join(map(str, c)) for c in found], pa.string()), pa.array([len(c) - 1 for c in found], pa.int32())], names=["node_a", "node_b", "path", "steps"])

    return lines.groupBy("part").applyInArrow(search, f"node_a {kind}, node_b {kind}, path string, steps int")
