"""Strongly connected components of many graphs at once.

Graphs (one per project) of up to ``local_edges`` edges are solved one to a task,
in memory.  Larger ones are made smaller until they are, or can be made no smaller:

* Blocks.  Nodes are cut into blocks of neighbours by name (files of a folder mostly
  import one another).  A task takes the edges inside its block, contracts their
  components (Tarjan), and leaves out inner nodes that a path only passes: those with
  no way in or out, and those with one way in or one way out.  Nodes with edges to
  other blocks stay.  What is left is a smaller graph with the same components among
  the nodes that stay; its solution is carried back into each block, where the nodes
  of one component are tied together and the inner nodes are solved exactly.
* Chains.  Nodes with a single way out follow it by pointer jumping, in as many joins
  as the length of the longest chain has bits; rings are found by it, and chains are
  replaced by one edge, whatever their names.
* Colouring, for what neither makes smaller: the smallest label that reaches a node
  becomes its colour, and what reaches its colour's root from inside the colour is a
  component; these leave, and the rest starts again.

Tables between steps are written to the shared folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import TASK_ROWS, Tables
from ..ship import ship

LOCAL_EDGES = 250_000
#: Up to so many blocks are a task and a file each; it saves two jobs a level.
MANY_BLOCKS = 256
SCHEMA = "project_id string, component string, node string"


def tarjan(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Components of two or more nodes; iterative, so depth is no limit."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    path: list[str] = []
    on_path: set[str] = set()
    found: list[list[str]] = []
    for start in out:
        if start in order:
            continue
        work = [(start, iter(out[start]))]
        order[start] = low[start] = len(order)
        path.append(start)
        on_path.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    path.append(nxt)
                    on_path.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on_path:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    group = [path.pop()]
                    while group[-1] != node:
                        group.append(path.pop())
                    on_path.difference_update(group)
                    if len(group) > 1:
                        found.append(group)
    return found


def _local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return named(key[0], tarjan(list(zip(pdf.from_path, pdf.to_path))))


def named(project: str, groups: list[list[str]]) -> pd.DataFrame:
    """A row for each member; the name of a group is looked for once."""
    rows = [(project, name, n) for name, group in ((min(group), group) for group in groups) for n in group]
    return pd.DataFrame(rows, columns=["project_id", "component", "node"])


def _inner(rows: pd.DataFrame) -> tuple[list[tuple[str, str]], pd.DataFrame]:
    edge = rows.b.notna()
    return list(zip(rows.a[edge], rows.b[edge])), rows[~edge]


def thin(edges: list[tuple[str, str]], fixed: set[str]) -> list[tuple[str, str]]:
    """A smaller graph with the same components among ``fixed`` nodes, and the same ways between them."""
    group: dict[str, str] = {}
    kept: list[tuple[str, str]] = []
    for members in tarjan(edges):
        own = sorted(n for n in members if n in fixed)
        name = own[0] if own else min(members)
        group.update(dict.fromkeys(members, name))
        if len(own) > 1:  # a ring keeps them together
            kept += zip(own, [*own[1:], own[0]])
    out: dict[str, set[str]] = {}
    into: dict[str, set[str]] = {}
    for a, b in edges:
        a, b = group.get(a, a), group.get(b, b)
        if a != b:
            out.setdefault(a, set()).add(b)
            into.setdefault(b, set()).add(a)
    work = [n for n in {*out, *into} if n not in fixed]
    while work:
        n = work.pop()
        ways_in, ways_out = into.get(n), out.get(n)
        if ways_in is None and ways_out is None or ways_in and ways_out and len(ways_in) > 1 and len(ways_out) > 1:
            continue
        into.pop(n, None)
        out.pop(n, None)
        ways_in, ways_out = ways_in or set(), ways_out or set()
        for a in ways_in:
            out[a].discard(n)
            out[a] |= ways_out
        for b in ways_out:
            into[b].discard(n)
            into[b] |= ways_in
        work += [m for m in ways_in | ways_out if m not in fixed]
    return kept + [(a, b) for a, ends in out.items() for b in ends]


def _thin(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    found = []
    for project, own in rows.groupby("project_id", sort=False):
        edges, marks = _inner(own)
        found += [(project, a, b) for a, b in thin(edges, set(marks.a))]
    return pd.DataFrame(found, columns=["project_id", "a", "b"])


def _widen(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Components of a block whose nodes of one known component are tied together."""
    found = []
    for project, own in rows.groupby("project_id", sort=False):
        edges, known = _inner(own)
        named = dict(zip(known.a, known.component))
        for _, members in known.groupby("component", sort=False):
            ring = members.a.tolist()
            edges += zip(ring, [*ring[1:], ring[0]]) if len(ring) > 1 else ()
        grouped = set()
        for members in tarjan(edges):
            name = next((named[n] for n in members if n in named), None) or min(members)
            found += [(project, name, n) for n in members]
            grouped.update(members)
        found += [(project, c, n) for n, c in named.items() if n not in grouped]
    return pd.DataFrame(found, columns=["project_id", "component", "node"])


KEY = ["project_id"]


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(*KEY, F.explode(F.array("a", "b")).alias("node")).distinct()


def _placed(tables: Tables, nodes: DataFrame, blocks: int) -> DataFrame:
    """Stored nodes, cut by name into about so many blocks of equal size; a task cuts many, so that there is no task and file for each."""
    n = nodes.count()
    tasks = min(blocks, max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS)))
    order = nodes.repartitionByRange(tasks, *KEY, "node").sortWithinPartitions(*KEY, "node").withColumn("place", F.monotonically_increasing_id())
    # the upper bits of a place are the task, the lower 33 the row's number in it
    own = F.floor(F.col("place").bitwiseAND((1 << 33) - 1) / max(1, -(-n // blocks)))
    return tables.keep(order.select(*KEY, "node", (F.shiftright("place", 33) * (1 << 33) + own).alias("block")))


def _solve(tables: Tables, edges: DataFrame, local_edges: int) -> DataFrame:
    """(project_id, component, node) of a stored graph (project_id, a, b) of any size; single nodes may be listed."""
    n = edges.count()
    if n <= local_edges:  # one task for each project, however many there are left
        return edges.groupBy(*KEY).applyInPandas(_whole, SCHEMA)
    blocks = max(2, -(-2 * n // local_edges))
    if blocks <= MANY_BLOCKS:
        placed = tables.keep(_ends(edges).repartitionByRange(blocks, *KEY, "node").withColumn("block", F.spark_partition_id()))
    else:
        placed = _placed(tables, tables.keep(_ends(edges)), blocks)
    at = lambda end: placed.select(*KEY, F.col("node").alias(end), F.col("block").alias("block_" + end))
    split = tables.keep(edges.join(at("a"), [*KEY, "a"]).join(at("b"), [*KEY, "b"]).select(*KEY, "a", "b", "block_a", "block_b"))
    large = split.where("block_a = block_b").groupBy("block_a").count().where(F.col("count") > 4 * local_edges)
    large = [r[0] for r in large.collect()]  # at most a block for each 4 * local_edges edges
    inside = (F.col("block_a") == F.col("block_b")) & ~F.col("block_a").isin(*large)
    inner, cross = split.where(inside), split.where(~inside)
    ways = cross.select(*KEY, F.explode(F.array(F.struct(F.col("block_a").alias("block"), "a"), F.struct(F.col("block_b").alias("block"), F.col("b").alias("a")))).alias("e")).select(*KEY, "e.*").distinct()
    inner = inner.select(*KEY, F.col("block_a").alias("block"), "a", "b")
    small = inner.unionByName(ways, allowMissingColumns=True).groupBy("block").applyInPandas(_thin, "project_id string, a string, b string")
    rest = tables.keep(small.unionByName(cross.select(*KEY, "a", "b")).distinct())
    found = _solve(tables, rest, local_edges) if rest.count() <= max(0.7 * n, local_edges) else _chains(tables, rest, local_edges)
    known = found.join(placed, [*KEY, "node"]).select(*KEY, "block", F.col("node").alias("a"), "component")
    return tables.keep(inner.unionByName(known, allowMissingColumns=True).groupBy("block").applyInPandas(_widen, SCHEMA))


def _whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return named(key[0], tarjan(list(zip(rows.a, rows.b))))


def _chains(tables: Tables, edges: DataFrame, local_edges: int) -> DataFrame:
    """Follows nodes with a single way out to the first node with several, by pointer jumping.

    ``hops``: of each such node the node 1, 2, 4 ... steps on, and the smallest name on the way."""
    only = edges.groupBy(*KEY, "a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
    hops = [tables.keep(only.where("n = 1").select(*KEY, F.col("a").alias("node"), F.col("b").alias("to"), F.col("a").alias("least")))]
    if hops[0].isEmpty():
        return _colour(tables, edges)
    length, chained = 1, hops[0].count()
    while length <= chained:
        one = hops[-1]
        on = one.select(*KEY, F.col("node").alias("to"), F.col("to").alias("on"), F.col("least").alias("least_on"))
        step = one.join(on, [*KEY, "to"], "left").select(*KEY, "node", F.coalesce("on", "to").alias("to"), F.least("least", F.coalesce("least_on", "least")).alias("least"), F.col("on").isNotNull().alias("more"))
        step = tables.keep(step)
        hops.append(step.select(*KEY, "node", "to", "least"))
        length *= 2
        if step.where("more").isEmpty():
            break
    first, last = hops[0], hops[-1]
    # who still has a node ahead after as many steps as there are nodes is on a ring or leads into one: those that are reached are the ring
    endless = last.join(first.select(*KEY, F.col("node").alias("to")), [*KEY, "to"], "left_semi")
    rings = endless.select(*KEY, F.col("to").alias("node")).distinct()
    rings = tables.keep(last.join(rings, [*KEY, "node"], "left_semi").select(*KEY, F.col("least").alias("component"), "node"))
    # other chains end in a node with several ways out; the rest of the graph sees their ends only
    ends = last.join(first.select(*KEY, F.col("node").alias("to")), [*KEY, "to"], "left_anti").select(*KEY, F.col("node").alias("b"), F.col("to").alias("end"))
    rest = edges.join(first.select(*KEY, F.col("node").alias("a")), [*KEY, "a"], "left_anti")
    jumps = tables.keep(rest.join(ends, [*KEY, "b"], "left").select(*KEY, "a", "b", F.coalesce("end", "b").alias("end"), F.col("end").isNotNull().alias("jumps")))
    closed = endless.select(*KEY, F.col("node").alias("end"))  # ways into a ring never come back
    short = tables.keep(jumps.join(closed, [*KEY, "end"], "left_anti").where("a <> end").select(*KEY, "a", F.col("end").alias("b")).distinct())
    smaller = short.count() <= max(0.7 * edges.count(), local_edges)
    found = tables.keep(_solve(tables, short, local_edges) if smaller else _colour(tables, short))
    # a chain is in its end's component if it begins there: its nodes are marked by the same hops
    named = lambda end: found.select(*KEY, F.col("node").alias(end), F.col("component").alias("c_" + end))
    begun = jumps.where("jumps").join(named("a"), [*KEY, "a"], "left").join(named("end"), [*KEY, "end"], "left")
    marked = tables.keep(begun.where("c_a = c_end OR a = end").select(*KEY, F.coalesce("c_end", "end").alias("component"), F.col("b").alias("node")).distinct())
    lone = marked.join(found.select(*KEY, "component").distinct(), [*KEY, "component"], "left_anti").select(*KEY, "component", F.col("component").alias("node")).distinct()
    if not marked.isEmpty():
        for hop in hops[:-1]:
            marked = tables.keep(marked.unionByName(marked.join(hop, [*KEY, "node"]).select(*KEY, "component", F.col("to").alias("node"))).distinct())
    return tables.keep(rings.unionByName(found).unionByName(marked).unionByName(lone).distinct())


def _colour(tables: Tables, edges: DataFrame) -> DataFrame:
    """The colouring loop; every round settles each colour's root.  Single nodes are listed too."""
    key, rest = KEY, tables.keep(edges)
    found: DataFrame | None = None
    while True:
        while True:  # trim
            n = rest.count()
            starts, ends = rest.select(*key, F.col("a").alias("b")).distinct(), rest.select(*key, F.col("b").alias("a")).distinct()
            before, rest = rest, tables.keep(rest.join(starts, [*key, "b"], "left_semi").join(ends, [*key, "a"], "left_semi").select(*key, "a", "b"))
            tables.drop(before)
            if rest.count() == n:
                break
        if not n:
            break
        nodes = rest.select(*key, F.col("a").alias("node")).distinct()
        colour = tables.keep(nodes.withColumn("colour", F.col("node")))
        while True:  # the smallest label flows forward
            came = rest.join(colour.withColumnRenamed("node", "a"), [*key, "a"]).groupBy(*key, F.col("b").alias("node")).agg(F.min("colour").alias("came"))
            step = tables.keep(colour.join(came, [*key, "node"], "left").select(*key, "node", F.least("colour", "came").alias("new"), "colour"))
            tables.drop(colour)
            if step.where("new <> colour").isEmpty():
                colour = step.select(*key, "node", "colour")
                break
            colour = step.select(*key, "node", F.col("new").alias("colour"))
        left = colour.select(*key, F.col("node").alias("a"), F.col("colour").alias("ca"))
        right = colour.select(*key, F.col("node").alias("b"), F.col("colour").alias("cb"))
        inner = tables.keep(rest.join(left, [*key, "a"]).join(right, [*key, "b"]).where("ca = cb").select(*key, "a", "b", F.col("ca").alias("colour")))
        group = tables.keep(colour.where("node = colour"))
        size = group.count()
        while True:  # what reaches the root flows backward
            back = inner.join(group.select(*key, F.col("node").alias("b"), "colour"), [*key, "b", "colour"], "left_semi").select(*key, F.col("a").alias("node"), "colour")
            before, group = group, tables.keep(group.unionByName(back).distinct())
            tables.drop(before)
            if (now := group.count()) == size:
                break
            size = now
        done = group.select(*key, F.col("colour").alias("component"), "node")
        found = done if found is None else found.unionByName(done)
        gone = group.select(*key, "node")
        before, rest = rest, tables.keep(rest.join(gone.withColumnRenamed("node", "a"), [*key, "a"], "left_anti").join(gone.withColumnRenamed("node", "b"), [*key, "b"], "left_anti").select(*key, "a", "b"))
        tables.drop(before, colour, inner)
    return edges.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES, self_loops: bool = False) -> DataFrame:
    """(project_id, component, node) of components of two or more nodes, and with
    ``self_loops`` of single nodes with an edge to themselves; a component is named
    by its smallest node."""
    if self_loops:
        found = Tables(edges.sparkSession, "loops").keep(strong_components(edges, local_edges))
        own = edges.where("from_path = to_path").select("project_id", F.col("from_path").alias("component"), F.col("from_path").alias("node")).distinct()
        return found.unionByName(own.join(found.select("project_id", "node"), ["project_id", "node"], "left_anti").select("project_id", "component", "node"))
    ship(edges.sparkSession)
    tables = Tables(edges.sparkSession, "scc")
    edges = tables.keep(edges.select("project_id", "from_path", "to_path"))
    large = [r[0] for r in edges.groupBy("project_id").count().where(F.col("count") > local_edges).select("project_id").collect()]  # few by their size
    near = edges.where(~F.col("project_id").isin(*large)) if large else edges
    found = near.groupBy("project_id").applyInPandas(_local, SCHEMA)
    if not large:
        return found
    far = edges.where(F.col("project_id").isin(*large)).where("from_path <> to_path")
    far = tables.keep(far.select("project_id", F.col("from_path").alias("a"), F.col("to_path").alias("b")).distinct())
    groups = tables.keep(_solve(tables, far, local_edges))
    names = groups.groupBy("project_id", "component").agg(F.min("node").alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.unionByName(groups.join(names, ["project_id", "component"]).select("project_id", F.col("name").alias("component"), "node"))
