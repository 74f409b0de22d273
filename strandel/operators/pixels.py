"""Raster operators on sparse pixel tables (keys, r, c): degree, labels, spurs, dilation, tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandel.kernels.raster import label as kernel_label
from strandel.operators.graphs import connected_components
from strandel.session import cut

NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def _offsets(pairs: list[tuple[int, int]]):
    return F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in pairs])


def shifted(pixels: DataFrame, keys: list[str], offsets: list[tuple[int, int]]) -> DataFrame:
    """Each pixel moved by each offset: keys, r, c (moved), r0, c0 (where from)."""
    return pixels.withColumn("_o", F.explode(_offsets(offsets))).select(*keys, (F.col("r") + F.col("_o.dr")).alias("r"), (F.col("c") + F.col("_o.dc")).alias("c"), F.col("r").alias("r0"), F.col("c").alias("c0"))


def degree(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r, c, degree: 8-neighbours in the table. Votes are summed where they land, without a self-join."""
    votes = shifted(pixels, keys, NEIGHBOURS).groupBy(*keys, "r", "c").agg(F.count(F.lit(1)).alias("_n"))
    return pixels.select(*keys, "r", "c").join(votes, [*keys, "r", "c"], "left").select(*keys, "r", "c", F.coalesce("_n", F.lit(0)).cast("long").alias("degree"))


def dilate(pixels: DataFrame, keys: list[str], offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """The pixels and their neighbours (3 x 3 by default)."""
    return shifted(pixels, keys, [(0, 0), *(NEIGHBOURS if offsets is None else offsets)]).select(*keys, "r", "c").distinct()


def label(pixels: DataFrame, keys: list[str], width: int = 1 << 20, side: int = 256) -> DataFrame:
    """keys, r, c, label: 8-connected components, numbered from 1 by their first pixel in row-major order.

    Pixels are dealt into square tiles, each labelled inside a task by the first pixel of every part;
    only parts that touch over a tile's border are joined by the graph operator.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    names = [*keys, "r", "c", "part"]

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        r, c = tile.r.to_numpy(np.int64), tile.c.to_numpy(np.int64)
        mask = np.zeros((side, side), bool)
        mask[r % side, c % side] = True
        of = kernel_label(mask)[r % side, c % side] - 1
        first = np.full(of.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, of, r * width + c)
        return tile.assign(part=first[of])[names]

    dealt = pixels.select(*keys, "r", "c", F.floor(F.col("r") / side).alias("_tr"), F.floor(F.col("c") / side).alias("_tc")).distinct()
    local = cut(dealt.groupBy(*keys, "_tr", "_tc").applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, "r", "c")) + ", part long"))
    edge = lambda x: F.pmod(F.col(x), F.lit(side)).isin(0, side - 1)
    border = local.filter(edge("r") | edge("c"))
    near = border.select(*keys, "part", F.explode(_offsets([(0, 1), (1, -1), (1, 0), (1, 1)])).alias("_o"), "r", "c").select(*keys, F.col("part").alias("u"), (F.col("r") + F.col("_o.dr")).alias("r"), (F.col("c") + F.col("_o.dc")).alias("c"))
    seams = cut(near.join(border.withColumnRenamed("part", "v"), [*keys, "r", "c"]).filter("u <> v").select(*keys, "u", "v").distinct())
    ends = seams.select(*keys, F.col("u").alias("node")).union(seams.select(*keys, "v"))
    joined = connected_components(ends, seams, keys).select(*keys, F.col("node").alias("part"), "component")
    found = local.join(joined, [*keys, "part"], "left").withColumn("component", F.coalesce("component", "part"))
    firsts = found.select(*keys, "component").distinct().withColumn("label", F.row_number().over(Window.partitionBy(*keys).orderBy("component")))
    return found.join(firsts, [*keys, "component"]).select(*keys, "r", "c", "label")


def prune_spurs(skeleton: DataFrame, keys: list[str], most: int = 3, rounds: int = 20) -> DataFrame:
    """Takes away pieces of at most `most` pixels that touch a junction and have a free end, until none is left."""
    pixels = cut(skeleton.select(*keys, "r", "c").distinct())
    for _ in range(rounds):
        deg = cut(degree(pixels, keys))
        joints = deg.filter("degree >= 3")
        pieces = label(deg.filter("degree < 3"), keys)
        near = dilate(joints, keys).withColumn("_touch", F.lit(True))
        facts = pieces.join(deg, [*keys, "r", "c"]).join(near, [*keys, "r", "c"], "left").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"), F.max(F.coalesce("_touch", F.lit(False))).alias("_touch"), F.min("degree").alias("_low"))
        doomed = cut(pieces.join(facts.filter((F.col("_n") <= most) & F.col("_touch") & (F.col("_low") <= 1)), [*keys, "label"], "left_semi").select(*keys, "r", "c"))
        if doomed.isEmpty():
            break
        pixels = cut(pixels.join(doomed, [*keys, "r", "c"], "left_anti"))
    return pixels


def tile(pixels: DataFrame, scenes: DataFrame, grid: tuple[int, int]) -> DataFrame:
    """scene_id, tile_r, tile_c and pixel places inside the tile, for a grid of rows by columns.

    scenes(scene_id, height, width). Bounds are floor(i * size / n), so the tile is found by arithmetic
    and corrected by one where the floor falls on the other side.
    """
    def cell(at: str, size: str, n: int):
        guess = F.floor(F.col(at) * n / F.col(size)).cast("int")
        up = F.floor((guess + 1) * F.col(size) / n)
        return F.when(F.col(at) >= up, guess + 1).when(F.col(at) < F.floor(guess * F.col(size) / n), guess - 1).otherwise(guess)

    placed = pixels.join(scenes, "scene_id").withColumn("tile_r", cell("r", "height", grid[0])).withColumn("tile_c", cell("c", "width", grid[1]))
    shift = lambda at, t, size, n: (F.col(at) - F.floor(F.col(t) * F.col(size) / n)).cast("int")
    return placed.withColumn("r", shift("r", "tile_r", "height", grid[0])).withColumn("c", shift("c", "tile_c", "width", grid[1])).drop("height", "width")


def disc(points: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Pixels within `radius` of any of the points (r, c): a ribbon of constant width along a polyline."""
    n = int(radius)
    near = [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b <= radius * radius]
    return shifted(points, keys, near).select(*keys, "r", "c").distinct()


def touching(pieces: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, piece, cluster: which pieces (r, c, piece) have a pixel beside one of which clusters (r, c, cluster)."""
    return shifted_to(pieces.select(*keys, "piece", "r", "c"), NEIGHBOURS).join(clusters, [*keys, "r", "c"]).select(*keys, "piece", "cluster").distinct()


def held_by(tips: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tip, node: the node (r, c, node) of most pixels around each tip (tip, r, c); the lowest among equals, null where there is none."""
    votes = shifted_to(tips.select(*keys, "tip", "r", "c"), NEIGHBOURS).join(nodes, [*keys, "r", "c"]).groupBy(*keys, "tip", "node").agg(F.count(F.lit(1)).alias("_n"))
    won = votes.groupBy(*keys, "tip").agg(F.min_by("node", F.struct(-F.col("_n"), "node")).alias("node"))
    return tips.select(*keys, "tip").distinct().join(won, [*keys, "tip"], "left")


def shifted_to(places: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each place once for every offset, moved by it, with its other columns."""
    return places.withColumn("_o", F.explode(_offsets(offsets))).withColumn("r", F.col("r") + F.col("_o.dr")).withColumn("c", F.col("c") + F.col("_o.dc")).drop("_o")


def by_area(instances: DataFrame, keys: list[str], iid: str = "iid") -> DataFrame:
    """keys, iid, area, place: the order in which instances are worked on, the largest first, then by id."""
    areas = instances.groupBy(*keys, iid).agg(F.count(F.lit(1)).alias("area"))
    return areas.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area"), iid)))


def nearest_label(places: DataFrame, owners: DataFrame, keys: list[str], reach: float, side: int = 256) -> DataFrame:
    """`places` (keys, r, c, ...) with `near`: the label above 0 of the nearest of `owners` (keys, r, c, label) within `reach`, else null.

    Among equally near pixels the first in row-major order counts. Both sides are dealt into square tiles,
    owners also into those that they are in reach of, and a tile looks along the offsets in their order.
    """
    n = int(reach)
    offsets = sorted((a * a + b * b, a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b <= reach * reach)
    own = places.withColumn("_tr", F.floor(F.col("r") / side)).withColumn("_tc", F.floor(F.col("c") / side))
    around = lambda x: F.explode(F.sequence(F.floor((F.col(x) - n) / side), F.floor((F.col(x) + n) / side)))
    held = owners.select(*keys, "r", "c", F.col("label").cast("long").alias("label")).withColumn("_tr", around("r")).withColumn("_tc", around("c"))
    kinds = {f.name: f.dataType.simpleString() for f in places.schema}

    def run(key: tuple, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = (int(key[k]) * side - n for k in (-2, -1))
        grid = np.zeros((side + 2 * n, side + 2 * n), np.int64)
        grid[known.r.to_numpy(int) - r0, known.c.to_numpy(int) - c0] = known.label
        r, c = part.r.to_numpy(int) - r0, part.c.to_numpy(int) - c0
        near, left = np.zeros(len(part), np.int64), np.arange(len(part))
        for _, a, b in offsets:
            near[left] = grid[r[left] + a, c[left] + b]
            left = left[near[left] == 0]
            if not len(left):
                break
        return part[list(kinds)].assign(near=pd.array(near, "Int64")).replace({"near": {0: pd.NA}})

    tile = [*keys, "_tr", "_tc"]
    return own.groupBy(*tile).cogroup(held.groupBy(*tile)).applyInPandas(run, ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", near long")
