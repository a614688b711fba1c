"""Graphs as edge tables (source, target).

Iterative operators write every round to the folder that all executors share and read it again, so that
plans stay short and a lost executor loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.sources.tables import rewritten


def degrees(edges: DataFrame) -> DataFrame:
    """In-, out- and total degree of every node, in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum(F.col("o").cast("long")).alias("outgoing"), F.sum((1 - F.col("o")).cast("long")).alias("incoming"), F.count("*").alias("total"))


def page_rank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, every: int = 5) -> DataFrame:
    """PageRank over distinct edges that aren't loops; the mass of nodes without outgoing edges is spread evenly."""
    e = edges.where("source <> target").select("source", "target").distinct()
    out = e.groupBy("source").agg(F.count("*").alias("degree"))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    nodes = rewritten(nodes.join(out, F.col("node") == F.col("source"), "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree")))
    e = rewritten(e)
    n = nodes.count()
    rank = nodes.select("node", "degree", F.lit(1.0 / max(1, n)).alias("rank"))
    for i in range(iterations):
        loose = rank.where("degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        gained = e.join(rank, F.col("source") == F.col("node")).groupBy("target").agg(F.sum(F.col("rank") / F.col("degree")).alias("gain"))
        # One row of loose mass.
        new = nodes.join(gained, F.col("node") == F.col("target"), "left").crossJoin(F.broadcast(loose))
        rank = new.select("node", "degree", ((1 - damping) / n + damping * (F.coalesce("gain", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if (i + 1) % every == 0:
            rank = rewritten(rank)
    return rank.select("node", "rank")


def reached(edges: DataFrame, seeds: DataFrame, depth: int | None = None, both: bool = False) -> DataFrame:
    """(node, distance) of nodes that seeds (node) reach in at most depth steps, seeds included."""
    e = edges.select("source", "target")
    if both:
        e = e.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    e = rewritten(e.distinct())
    seen = rewritten(seeds.select("node", F.lit(0).alias("distance")).distinct())
    step = 0
    while depth is None or step < depth:
        edge = seen.where(F.col("distance") == step).select(F.col("node").alias("source"))
        new = e.join(edge, "source").select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti")
        new = rewritten(new.select("node", F.lit(step + 1).alias("distance")))
        if new.isEmpty():
            break
        seen, step = seen.unionByName(new), step + 1
    return seen


def simple_paths(edges: DataFrame, seeds: DataFrame, depth: int, complete: bool = False) -> DataFrame:
    """(path, steps): paths from the seeds without a repeated node; if complete, those of full depth or at a dead end."""
    e = edges.select("source", "target").distinct()
    paths = seeds.select(F.array("node").alias("path"))
    found = []
    for step in range(depth):
        last = F.element_at("path", -1)
        more = paths.join(e, (last == F.col("source")) & ~F.array_contains("path", F.col("target")))
        longer = rewritten(more.select(F.concat("path", F.array("target")).alias("path")))
        if complete:
            went = longer.select(F.slice("path", 1, step + 1).alias("path")).distinct()
            found.append(paths.join(went, "path", "left_anti"))
        elif step:
            found.append(paths)
        paths = longer
    found.append(paths)
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole.select("path", (F.size("path") - 1).alias("steps"))


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges that only one of two snapshots has, in one join."""
    a, b = (side.select("source", "target").distinct().withColumn(name, F.lit(True)) for side, name in ((before, "b"), (after, "a")))
    both = a.join(b, ["source", "target"], "full_outer")
    return both.where("a is null or b is null").select("source", "target", F.when(F.col("b").isNull(), "added").otherwise("removed").alias("state"))


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (node, label) passed along edges until nothing changes: the greatest that reaches each node."""
    while True:
        best = edges.join(labels, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.max("label").alias("seen"))
        new = rewritten(labels.join(best, "node", "left").select("node", F.greatest("label", "seen").alias("label"), (F.coalesce(F.col("seen") > F.col("label"), F.lit(False))).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their greatest node; single nodes are components of their own.

    Nodes that no edge enters or none leaves go first, as long as there are any. The greatest node that reaches
    each node colours it; of a colour, the nodes that reach its name in turn form a component. Those go, and the
    rest is coloured again.
    """
    left = rewritten(edges.where("source <> target").select("source", "target").distinct())
    nodes = rewritten(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct())
    done = None
    while not nodes.isEmpty():
        core = rewritten(left.select(F.col("source").alias("node")).distinct().join(left.select(F.col("target").alias("node")), "node", "left_semi"))
        single = rewritten(nodes.join(core, "node", "left_anti").select("node", F.col("node").alias("component")))
        if not single.isEmpty():
            done = single if done is None else done.unionByName(single)
            nodes = core
            for end in ("source", "target"):
                left = left.join(core.select(F.col("node").alias(end)), end, "left_semi")
            left = rewritten(left.select("source", "target"))
            continue
        colour = _spread(left, nodes.select("node", F.col("node").alias("label")))
        back = left.select(F.col("target").alias("source"), F.col("source").alias("target"))
        inner = back.join(colour.select(F.col("node").alias("source"), F.col("label").alias("x")), "source").join(colour.select(F.col("node").alias("target"), F.col("label").alias("y")), "target")
        inner = rewritten(inner.where("x = y").select("source", "target"))
        found = rewritten(reached(inner, colour.where("node = label").select("node")).select("node").join(colour, "node").select("node", F.col("label").alias("component")))
        done = found if done is None else done.unionByName(found)
        nodes = rewritten(nodes.join(found, "node", "left_anti"))
        for end in ("source", "target"):
            left = left.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
        left = rewritten(left.select("source", "target"))
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))


def federated(graphs: dict[str, DataFrame]) -> DataFrame:
    """Edges of several graphs, node ids prefixed by the graph's name."""
    parts = [e.select(*[F.concat(F.lit(f"{name}:"), F.col(c).cast("string")).alias(c) for c in ("source", "target")], F.lit(name).alias("graph")) for name, e in graphs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def impact(edges: DataFrame, changed: DataFrame, depth: int = 3, direction: str = "both") -> DataFrame:
    """(node, distance, known): nodes within depth steps of changed ones (node), these included; a changed node that no edge has isn't known."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    way = {"forward": edges, "backward": back}.get(direction, edges)
    rows = reached(way, changed, depth, both=direction == "both")
    known = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("k", F.lit(True))
    return rows.join(known, "node", "left").select("node", "distance", F.coalesce("k", F.lit(False)).alias("known"))


def federated_graphs(graphs: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, repository, original_id, other columns) and edges of several graphs (nodes, edges), ids prefixed by the graph's name."""
    if not graphs:
        raise ValueError("no graphs")
    named = lambda name, c: F.concat(F.lit(f"{name}:"), F.col(c).cast("string"))
    nodes = None
    for name, (n, _) in graphs.items():
        rest = [c for c in n.columns if c != "id"]
        part = n.select(named(name, "id").alias("id"), F.lit(name).alias("repository"), F.col("id").cast("string").alias("original_id"), *rest)
        nodes = part if nodes is None else nodes.unionByName(part, allowMissingColumns=True)
    return nodes, federated({name: e for name, (_, e) in graphs.items()})
