"""Graphs of rules: components, cycles, levels, closures, paths, orders and degrees.

A graph of up to SMALL edges is gone through by one task; a larger one by iterated
joins, whose rounds work on a frontier that only shrinks, are written out to cut
lineage, and stop when nothing new is found.  Both give the same rows, whatever
cycles there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Edges that one task holds: some 50 MB.
SMALL = 1 << 20


def is_small(edges: DataFrame) -> bool:
    return edges.limit(SMALL + 1).count() <= SMALL


def alone(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run over all rows in one task."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            yield run(pd.concat(held, ignore_index=True))

    return rows.repartition(1).mapInPandas(whole, schema)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def numbered(e: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names in order, sources, targets) as places among the names."""
    codes, names = pd.factorize(pd.concat([e["source"], e["target"]]), sort=True)
    return np.asarray(names), codes[: len(e)], codes[len(e) :]


def outgoing(n: int, source: np.ndarray, target: np.ndarray) -> list[list[int]]:
    """Targets of each node, in order."""
    out: list[list[int]] = [[] for _ in range(n)]
    for k in np.lexsort((target, source)).tolist():
        out[source[k]].append(int(target[k]))
    return out


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (source, target) with their status: used, self_loop or dangling."""
    e = edges.select("source", "target").distinct()
    n = nodes.select("node").distinct()
    known = e.join(n.withColumnRenamed("node", "source").withColumn("_s", F.lit(1)), "source", "left").join(n.withColumnRenamed("node", "target").withColumn("_t", F.lit(1)), "target", "left")
    return known.select("source", "target", F.when(F.col("source") == F.col("target"), "self_loop").when(F.col("_s").isNull() | F.col("_t").isNull(), "dangling").otherwise("used").alias("status"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): weakly connected, labelled by the smallest node."""
    kind = type_of(nodes, "node")
    if is_small(edges):

        def run(e: pd.DataFrame) -> pd.DataFrame:
            names, u, v = numbered(e)
            label, was = np.arange(len(names)), None
            while was is None or (label != was).any():
                was = label.copy()
                np.minimum.at(label, u, was[v])
                np.minimum.at(label, v, label[u])
                label = label[label]
            return pd.DataFrame({"node": names, "component": names[label]})

        found = alone(edges.select("source", "target").where("source is not null and target is not null"), run, f"node {kind}, component {kind}")
        return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    both = cut(edges.select(F.col("source").alias("u"), F.col("target").alias("v")).unionByName(edges.select(F.col("target").alias("u"), F.col("source").alias("v"))).where("u <> v").distinct())
    label = cut(nodes.select("node", F.col("node").alias("l")).distinct())
    while True:
        near = both.join(label.toDF("v", "nl"), "v").groupBy("u").agg(F.min("nl").alias("nl"))
        low = cut(label.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", F.least("l", F.coalesce("nl", "l")).alias("l"), F.col("l").alias("was")))
        new = cut(low.join(low.select(F.col("node").alias("l"), F.col("l").alias("ll")), "l").select("node", F.least("l", "ll").alias("l"), "was"))
        label = new.select("node", "l")
        if not new.where("l < was").limit(1).count():
            return label.select("node", F.col("l").alias("component"))


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, level): every node downstream of `start` (itself level 0), with its least distance."""
    e = edges.select("source", "target").distinct()
    if is_small(e):
        kind = type_of(start, "node")

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            begin = rows["target"].isna()
            names, u, v = numbered(rows[~begin])
            at = {x: k for k, x in enumerate(names.tolist())}
            out, level = outgoing(len(names), u, v), {x: 0 for x in rows["source"][begin].tolist()}
            frontier = [at[x] for x in level if x in at]
            far = 0
            while frontier:
                far += 1
                step = {t for k in frontier for t in out[k]}
                frontier = [t for t in step if names[t] not in level]
                level |= {names[t]: far for t in frontier}
            return pd.DataFrame({"node": list(level), "level": list(level.values())})

        rows = e.where("source is not null and target is not null").unionByName(start.select(F.col("node").alias("source"), F.lit(None).cast(kind).alias("target")))
        return alone(rows, run, f"node {kind}, level int")
    seen = cut(start.select("node", F.lit(0).alias("level")).distinct())
    frontier, level = seen, 0
    while True:
        level += 1
        step = frontier.join(e, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if not frontier.limit(1).count():
            return seen
        seen = cut(seen.unionByName(frontier)) if level % 4 == 0 else seen.unionByName(frontier)


def closure(edges: DataFrame) -> DataFrame:
    """All (source, target) with a path of one edge or more; doubles the path length each round."""
    e = edges.select("source", "target").distinct()
    have = cut(e)
    n = have.count()
    while True:
        more = have.join(have.toDF("mid", "to"), F.col("target") == F.col("mid")).select("source", F.col("to").alias("target"))
        new = cut(have.unionByName(more).distinct())
        m = new.count()
        if m == n:
            return new
        have, n = new, m


def strong(out: list[list[int]]) -> np.ndarray:
    """The smallest node that each node reaches and is reached by: depth-first search there and, in order of finishing, back."""
    n = len(out)
    seen, done = [False] * n, []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], stack = True, [(root, iter(out[root]))]
        while stack:
            node, rest = stack[-1]
            for t in rest:
                if not seen[t]:
                    seen[t] = True
                    stack.append((t, iter(out[t])))
                    break
            else:
                done.append(node)
                stack.pop()
    back: list[list[int]] = [[] for _ in range(n)]
    for k, ts in enumerate(out):
        for t in ts:
            back[t].append(k)
    label = np.full(n, -1)
    for root in reversed(done):
        if label[root] >= 0:
            continue
        label[root], group, front = root, [root], [root]
        while front:
            for t in back[front.pop()]:
                if label[t] < 0:
                    label[t] = root
                    group.append(t)
                    front.append(t)
        label[group] = min(group)
    return label


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): nodes that reach each other, labelled by the smallest; nodes in no cycle are left out."""
    if is_small(edges):
        kind = type_of(edges, "source")

        def run(e: pd.DataFrame) -> pd.DataFrame:
            names, u, v = numbered(e)
            label = strong(outgoing(len(names), u, v))
            many = np.bincount(label, minlength=len(names))[label] > 1
            return pd.DataFrame({"node": names[many], "cycle": names[label[many]]})

        return alone(edges.select("source", "target").where("source <> target").distinct(), run, f"node {kind}, cycle {kind}")
    r = closure(edges.where("source <> target"))
    mutual = r.alias("a").join(r.alias("b"), (F.col("a.source") == F.col("b.target")) & (F.col("a.target") == F.col("b.source"))).select(F.col("a.source").alias("node"), F.col("a.target").alias("other"))
    return mutual.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("cycle"), F.count_distinct("other").alias("n")).where("n > 1").select("node", "cycle")


def longest_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level) of an acyclic graph: the longest path that leads to the node (its topological level).  A cycle raises ValueError."""
    e = edges.select("source", "target").distinct()
    now = cut(nodes.select("node", F.lit(0).alias("level")).distinct())
    rounds = now.count()
    for _ in range(rounds + 1):
        up = now.join(e, F.col("node") == F.col("source")).groupBy(F.col("target").alias("node")).agg((F.max("level") + 1).alias("up"))
        new = cut(now.join(up, "node", "left").select("node", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), F.col("level").alias("was")))
        now = new.select("node", "level")
        if not new.where("level > was").limit(1).count():
            return now
    raise ValueError("the graph has a cycle")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree, bucket)."""
    d = edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").count()
    out = nodes.select("node").distinct().join(d, "node", "left").select("node", F.coalesce("count", F.lit(0)).alias("degree"))
    n = F.col("degree")
    return out.withColumn("bucket", F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("11+"))


def topological_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, node, place): each component in an order in which sources come first, the smallest node that is ready next; nodes of cycles, and what hangs on them, have place null.

    A component is ordered by one task.
    """
    used = edges.select("source", "target").where("source <> target").distinct()
    c = components(used, nodes)
    kind = type_of(nodes, "node")
    inside = c.join(used.select(F.col("source").alias("node"), "target"), "node", "left")

    def order(e: pd.DataFrame) -> pd.DataFrame:
        out, waits = {}, {x: 0 for x in e["node"]}
        for s, t in e[["node", "target"]].dropna().sort_values(["node", "target"]).itertuples(index=False):
            out.setdefault(s, []).append(t)
            waits[t] = waits.get(t, 0) + 1
        ready, place = [x for x, n in waits.items() if n == 0], {}
        heapq.heapify(ready)
        while ready:
            x = heapq.heappop(ready)
            place[x] = len(place)
            for t in out.get(x, ()):
                waits[t] -= 1
                if waits[t] == 0:
                    heapq.heappush(ready, t)
        return pd.DataFrame({"component": e["component"].iloc[0], "node": list(waits), "place": pd.array([place.get(x) for x in waits], dtype="Int64")})

    return inside.groupBy("component").applyInPandas(order, f"component {kind}, node {kind}, place long")


def assembled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, nodes, edges, cycles): rules dealt into components by their distinct, clean edges (source, target, kind)."""
    e = edges.select("source", "target", "kind").distinct()
    fine = clean_edges(e, nodes).where("status = 'used'").select("source", "target")
    c = components(fine, nodes)
    loops = cycles(fine).select("node", "cycle")
    n_edges = e.join(fine, ["source", "target"], "left_semi").join(c.select(F.col("node").alias("source"), "component"), "source").groupBy("component").agg(F.count("*").alias("edges"))
    n_nodes = c.join(loops, "node", "left").groupBy("component").agg(F.count("*").alias("nodes"), F.count_distinct("cycle").alias("cycles"))
    return n_nodes.join(n_edges, "component", "left").select("component", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "cycles")


def coverage_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, distinct edges, and those used, dangling and on themselves."""
    e = clean_edges(edges, nodes).agg(F.count("*").alias("edges"), *[F.count_if(F.col("status") == s).alias(s) for s in ("used", "dangling", "self_loop")])
    return nodes.select("node").distinct().agg(F.count("*").alias("nodes")).crossJoin(e)


def chains(edges: DataFrame, most: int = 5000) -> tuple[list[tuple], list[tuple]]:
    """Maximal simple paths from the nodes that nothing leads to (from all if there are none), depth first in order, the first `most`; and the cycles met.

    The graph must be small: it is gone through on the driver.
    """
    if not is_small(edges):
        raise ValueError(f"more than {SMALL} edges")
    out: dict = {}
    into = set()
    for r in edges.select("source", "target").distinct().orderBy("source", "target").collect():
        out.setdefault(r.source, []).append(r.target)
        into.add(r.target)
    nodes = set(out) | into
    paths: list[tuple] = []
    loops: set[tuple] = set()
    for root in sorted(nodes - into) or sorted(nodes):
        stack = [((root,), iter(out.get(root, ())), [False])]
        while stack and len(paths) < most:
            path, rest, longer = stack[-1]
            for t in rest:
                if t in path:
                    loops.add((*path[path.index(t) :], t))
                else:
                    longer[0] = True
                    stack.append(((*path, t), iter(out.get(t, ())), [False]))
                    break
            else:
                stack.pop()
                if not longer[0] and len(path) > 1:
                    paths.append(path)
    return paths, sorted(loops)


def recompute(edges: DataFrame, changed: DataFrame, review: DataFrame) -> DataFrame:
    """(node, part): direct for the changed, review for what is downstream but needs a person, recompute for the rest downstream."""
    r = reach(edges, changed).join(review.select("node", F.lit(True).alias("_r")).distinct(), "node", "left")
    return r.select("node", F.when(F.col("level") == 0, "direct").when(F.col("_r"), "review").otherwise("recompute").alias("part"))
