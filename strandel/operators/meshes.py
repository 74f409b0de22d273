"""Tube meshes around centrelines, by joins with a small ring of angles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandel.operators.sequence import densify, unit_normals


def tubes(centrelines: DataFrame, shapes: DataFrame, sides: int = 12, step: float = 2.0, section=None) -> tuple[DataFrame, DataFrame]:
    """vertices(scene_id, iid, vid, x, y, z) and faces(scene_id, iid, v0..v3) of every instance.

    centrelines(scene_id, iid, seq, x, y), shapes(scene_id, iid, z, radius). section(angle) gives the
    cross-section as (sideways, upward) columns in radii; a circle by default.
    """
    keys = ["scene_id", "iid"]
    axis = unit_normals(densify(centrelines, keys, step), keys).join(shapes.select(*keys, "z", "radius"), keys)
    side, up = (section or (lambda a: (F.cos(a), F.sin(a))))(F.col("k") * (2 * math.pi / sides))
    ring = axis.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    vertices = ring.select(*keys, (F.col("seq") * sides + F.col("k")).alias("vid"), (F.col("x") + F.col("radius") * side * F.col("nx")).alias("x"), (F.col("y") + F.col("radius") * side * F.col("ny")).alias("y"), (F.col("z") + F.col("radius") * up).alias("z"))
    last = axis.groupBy(*keys).agg(F.max("seq").alias("last"))
    quads = last.filter("last >= 1").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("last") - 1))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    nxt = (F.col("k") + 1) % sides
    faces = quads.select(*keys, (F.col("s") * sides + F.col("k")).alias("v0"), (F.col("s") * sides + nxt).alias("v1"), ((F.col("s") + 1) * sides + nxt).alias("v2"), ((F.col("s") + 1) * sides + F.col("k")).alias("v3"))
    return vertices, faces
