"""Iterative graph operators: components, longest paths, strong components, clearance heights.

Bounded scenes are solved inside tasks; larger ones by a loop of joins and aggregations over edge
tables keyed by scene, in which all of them converge together. Rounds are cut by reliable checkpoints; hubs are combined map-side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandel.kernels.ordering import strong_parts
from strandel.kernels.raster import least_of_parts
from strandel.session import cut


#: Edges that one task contracts by itself.
EDGES_A_TASK = 200_000


def _contracted(batches, keys: list[str]):
    """One partition's edges contracted: every node with the smallest node of its part and keys."""
    parts = [p for p in batches if len(p)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    scene = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    values, at = np.unique(rows[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    own, ends = np.unique(scene[:, None] * len(values) + at.reshape(-1, 2), return_inverse=True)  # nodes in the order of scene, then value
    ends = ends.reshape(-1, 2)
    root = least_of_parts(len(own), ends[:, 0], ends[:, 1])
    first = np.zeros(scene.max() + 1, int)
    first[scene[::-1]] = np.arange(len(scene))[::-1]
    out = rows[keys].iloc[first[own // len(values)]].reset_index(drop=True)
    yield out.assign(u=values[own % len(values)], v=values[own[root] % len(values)])[[*keys, "u", "v"]]


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str], most_rounds: int = 1_000) -> DataFrame:
    """keys, node, component: the smallest node reachable over undirected edges (u, v).

    Each task first contracts its own edges, a bounded number, into stars. Where one task holds all,
    that is the result; else labels go to neighbours and then to the label's own label until they rest.
    """
    lines = cut(edges.select(*keys, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v"))
    parts = max(1, -(-lines.count() // EDGES_A_TASK))
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "u", "v"))
    stars = cut(lines.coalesce(parts).mapInPandas(lambda it: _contracted(it, keys), schema))
    everyone = nodes.select(*keys, F.col("node").cast("long").alias("node")).distinct()
    if parts == 1:
        return everyone.join(stars.select(*keys, F.col("u").alias("node"), F.col("v").alias("_root")), [*keys, "node"], "left").select(*keys, "node", F.coalesce("_root", "node").alias("component"))
    both = cut(stars.union(stars.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
    labels = everyone.withColumn("component", F.col("node"))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), [*keys, "v"]).groupBy(*keys, F.col("u").alias("node")).agg(F.min("component").alias("_near"))
        stepped = labels.join(near, [*keys, "node"], "left").withColumn("_step", F.least("component", F.coalesce("_near", "component")))
        roots = stepped.select(*keys, F.col("node").alias("_step"), F.col("_step").alias("_jump"))
        moved = cut(stepped.join(roots, [*keys, "_step"], "left").select(*keys, "node", F.col("component").alias("_old"), F.least("_step", F.coalesce("_jump", "_step")).alias("component")))
        labels = moved.select(*keys, "node", "component")
        if moved.filter("_old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _by_size(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with their out-edges as one row a scene, for scenes of at most EDGES_A_TASK edges; nodes and edges of the others."""
    sizes = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    large = sizes.filter(F.col("_m") > EDGES_A_TASK).select(*keys)
    lines = edges.join(large, keys, "left_anti").groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in edges.columns if c not in keys])).alias("_lines"))
    own = nodes.join(large, keys, "left_anti").groupBy(*keys).agg(F.collect_set("node").alias("_nodes"))
    return own.join(lines, keys, "left"), nodes.join(large, keys, "left_semi"), edges.join(large, keys, "left_semi")


def _in_tasks(small: DataFrame, keys: list[str], solve, out: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in small.schema}
    names = [*keys, "node", out.split()[0]]

    def run(parts):
        for part in parts:
            rows = []
            for row in part.to_dict("records"):
                held = row["_lines"]
                found = solve([int(x) for x in row["_nodes"]], [] if held is None else list(held))
                rows += [(*(row[k] for k in keys), n, v) for n, v in found.items()]
            yield pd.DataFrame(rows, columns=names)

    return small.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", node long, {out}")


def _levels(nodes: list[int], lines: list) -> dict[int, float]:
    """Heaviest paths from below, in topological order."""
    up, left = {n: [] for n in nodes}, dict.fromkeys(nodes, 0)
    for e in lines:
        up.setdefault(e["lo"], []).append((e["hi"], e["w"]))
        left[e["hi"]] = left.get(e["hi"], 0) + 1
    level, ready = dict.fromkeys({*nodes, *up, *left}, 0.0), [n for n in {*nodes, *up, *left} if not left.get(n)]
    done = 0
    while ready:
        x = ready.pop()
        done += 1
        for y, w in up.get(x, ()):
            level[y] = max(level[y], level[x] + w)
            left[y] -= 1
            if not left[y]:
                ready.append(y)
    if done < len(level):
        raise ValueError("the edges hold a cycle")
    return {n: level[n] for n in nodes}


def longest_path(nodes: DataFrame, edges: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """keys, node, level: the heaviest path from below, over edges (lo, hi); every edge weighs 1 or `weight`.

    Scenes of a bounded number of edges are swept in topological order, many a task; larger ones rise
    in rounds over the whole table. A cycle raises.
    """
    lines = cut(edges.select(*keys, "lo", "hi", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).groupBy(*keys, "lo", "hi").agg(F.max("w").alias("w")))
    small, most_nodes, most_lines = _by_size(nodes.select(*keys, F.col("node").cast("long").alias("node")).distinct(), lines, keys)
    swept = _in_tasks(small, keys, _levels, "level double")
    return swept if most_lines.isEmpty() else swept.unionByName(_rising(most_nodes, most_lines, keys))


def _rising(nodes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    levels = cut(nodes.withColumn("level", F.lit(0.0)))
    for _ in range(levels.count() + 1):
        up = lines.join(levels.withColumnRenamed("node", "lo"), [*keys, "lo"]).groupBy(*keys, F.col("hi").alias("node")).agg(F.max(F.col("level") + F.col("w")).alias("_up"))
        moved = cut(levels.join(up, [*keys, "node"], "left").select(*keys, "node", F.col("level").alias("_old"), F.greatest("level", F.coalesce("_up", "level")).alias("level")))
        levels = moved.select(*keys, "node", "level")
        if moved.filter("_old < level").isEmpty():
            return levels
    raise ValueError("the edges hold a cycle")


def _strong(nodes: list[int], lines: list) -> dict[int, int]:
    down: dict[int, list[int]] = {}
    for e in lines:
        down.setdefault(int(e["u"]), []).append(int(e["v"]))
    return {n: part[0] for part in strong_parts(sorted(nodes), down) for n in part}


def strong_components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, component: the smallest node with paths both ways, over directed edges (u, v).

    Scenes of a bounded number of edges are searched depth first, many a task; larger ones are coloured
    in rounds over the whole table.
    """
    lines = cut(edges.select(*keys, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v").distinct())
    small, most_nodes, most_lines = _by_size(nodes.select(*keys, F.col("node").cast("long").alias("node")).distinct(), lines, keys)
    found = _in_tasks(small, keys, _strong, "component long")
    return found if most_lines.isEmpty() else found.unionByName(_coloured(most_nodes, most_lines, keys))


def _coloured(nodes: DataFrame, lines: DataFrame, keys: list[str], most_rounds: int = 1_000) -> DataFrame:
    """Strong components of large scenes.

    Forward-backward colouring: labels sink along edges to each node's smallest ancestor; the nodes of a
    colour that reach its root are one component and leave; the others are coloured again.
    """
    left = cut(nodes)
    done = None
    for _ in range(most_rounds):
        colour = _spread(left.withColumn("label", F.col("node")), lines, keys, "u", "v", most_rounds)
        own = colour.select(*keys, F.col("node").alias("u"), F.col("label").alias("_cu"))
        inner = cut(lines.join(own, [*keys, "u"]).join(own.select(*keys, F.col("u").alias("v"), F.col("_cu").alias("_cv")), [*keys, "v"]).filter("_cu = _cv").select(*keys, "u", "v"))
        hit = colour.select(*keys, "node", F.when(F.col("node") == F.col("label"), 0).otherwise(1).alias("label"))
        back = _spread(hit, inner, keys, "v", "u", most_rounds)
        found = cut(colour.join(back.filter("label = 0").select(*keys, "node"), [*keys, "node"]).select(*keys, "node", F.col("label").alias("component")))
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found, [*keys, "node"], "left_anti"))
        if left.isEmpty():
            return done
        ends = left.select(*keys, F.col("node").alias("u"))
        lines = cut(inner.join(ends, [*keys, "u"], "left_semi").join(ends.withColumnRenamed("u", "v"), [*keys, "v"], "left_semi"))
    raise RuntimeError("strong components did not settle")


def _spread(labels: DataFrame, lines: DataFrame, keys: list[str], source: str, target: str, most_rounds: int) -> DataFrame:
    """Least label that reaches each node along the lines."""
    labels = cut(labels)
    for _ in range(most_rounds):
        near = lines.join(labels.withColumnRenamed("node", source), [*keys, source]).groupBy(*keys, F.col(target).alias("node")).agg(F.min("label").alias("_near"))
        moved = cut(labels.join(near, [*keys, "node"], "left").select(*keys, "node", F.col("label").alias("_old"), F.least("label", F.coalesce("_near", "label")).alias("label")))
        labels = moved.select(*keys, "node", "label")
        if moved.filter("_old <> label").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def cycle_groups(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cycle (numbered by lowest member), node of every strong component of two nodes or more."""
    from pyspark.sql.window import Window

    strong = strong_components(nodes, edges, keys)
    many = strong.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumn("cycle", F.row_number().over(Window.partitionBy(*keys).orderBy("component")))
    return strong.join(many, [*keys, "component"]).select(*keys, "cycle", "node")


def break_cycles(arms: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """The links (a, b, jump) without the longest of each component that has as many links as arms.

    Ties go to the larger (a, b); arms(keys, node); a, b are arms.
    """
    lines = cut(links.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jump"))
    while True:
        comp = connected_components(arms, lines.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")), keys)
        sizes = comp.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("arms"))
        placed = lines.join(comp.withColumnRenamed("node", "a"), [*keys, "a"])
        rings = placed.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("links"), F.max(F.struct("jump", "a", "b")).alias("worst")).join(sizes, [*keys, "component"]).filter("links >= arms").select(*keys, "worst.a", "worst.b")
        rings = cut(rings)
        if rings.isEmpty():
            return lines
        lines = cut(lines.join(rings, [*keys, "a", "b"], "left_anti"))


def induced(edges: DataFrame, nodes: DataFrame, keys: list[str], u: str = "u", v: str = "v") -> DataFrame:
    """The edges with both ends among `nodes` (keys, node)."""
    own = nodes.select(*keys, "node").distinct()
    return edges.join(own.withColumnRenamed("node", u), [*keys, u], "left_semi").join(own.withColumnRenamed("node", v), [*keys, v], "left_semi")


def relation_weights(decided: DataFrame, keys: list[str]) -> DataFrame:
    """keys, over, under, weight: the summed strength of all decisions that put one above the other."""
    return decided.groupBy(*keys, "over", "under").agg(F.sum(F.abs("score")).alias("weight"))


def stacked_heights(nodes: DataFrame, relations: DataFrame, keys: list[str], gap: float = 0.0, least_radius: float = 0.5) -> DataFrame:
    """keys, node, z: the lowest heights that keep every pair (lo, hi) apart by both radii and `gap`.

    nodes(keys, node, radius). Equals the heaviest path of the relations, shifted to a least height of 0.
    """
    sized = nodes.select(*keys, "node", F.greatest("radius", F.lit(least_radius)).alias("radius"))
    r = lambda t: sized.select(*keys, F.col("node").alias(t), F.col("radius").alias(f"_r{t}"))
    lines = relations.join(r("lo"), [*keys, "lo"]).join(r("hi"), [*keys, "hi"]).withColumn("need", F.col("_rlo") + F.col("_rhi") + gap)
    return longest_path(sized, lines, keys, "need").withColumnRenamed("level", "z")


def film_thickness(heights: DataFrame, keys: list[str]) -> DataFrame:
    """thickness: highest top less lowest bottom of (z, radius)."""
    return heights.groupBy(*keys).agg((F.max(F.col("z") + F.col("radius")) - F.min(F.col("z") - F.col("radius"))).alias("thickness"))
