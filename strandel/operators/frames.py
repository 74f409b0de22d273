"""Outward frames at the ends of tracks, fitted by power sums, and the costs of joining them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandel.functions.geometry import angle, link_cost
from strandel.kernels.matching import best_pairs
from strandel.operators.graphs import connected_components
from strandel.operators.sequence import arclength
from strandel.operators.spatial import close_pairs
from strandel.session import cut


def fit_frames(points: DataFrame, keys: list[str], window: float = 14.0, least_quadratic: float = 9.0, order: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """tip, outward tangent, curvature, support and reliability at the first point of each track.

    Least squares over the arclength window, quadratic where it spans `least_quadratic`: the normal
    equations need only sums of powers, so one grouped aggregation fits every track.
    """
    a = arclength(points, keys, order, x, y)
    near = a.filter((F.col("s") <= window) | (F.col(order) <= 1))
    tip = lambda c: F.min_by(c, order)
    s, sums = F.col("s"), {}
    for k in range(1, 5):
        sums[f"s{k}"] = F.sum(F.pow(s, F.lit(float(k))))
    for c, t in ((x, "x"), (y, "y")):
        for k in range(3):
            sums[f"{t}{k}"] = F.sum(F.pow(s, F.lit(float(k))) * F.col(c))
    g = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("span"), tip(x).alias("tip_x"), tip(y).alias("tip_y"), *[v.alias(k) for k, v in sums.items()])
    n, s1, s2, s3, s4 = (F.col(c) if c != "n" else F.col(c).cast("double") for c in ("n", "s1", "s2", "s3", "s4"))
    quadratic = (F.col("span") >= least_quadratic) & (F.col("n") >= 3)
    det1 = n * s2 - s1 * s1
    det2 = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)

    def slope(t: str) -> Column:
        b0, b1, b2 = F.col(f"{t}0"), F.col(f"{t}1"), F.col(f"{t}2")
        linear = F.try_divide(n * b1 - s1 * b0, det1)
        square = F.try_divide(n * (b1 * s4 - s3 * b2) - b0 * (s1 * s4 - s2 * s3) + s2 * (s1 * b2 - b1 * s2), det2)
        return F.when(quadratic, square).otherwise(linear)

    def bend(t: str) -> Column:
        b0, b1, b2 = F.col(f"{t}0"), F.col(f"{t}1"), F.col(f"{t}2")
        return F.when(quadratic, F.try_divide(2 * (n * (s2 * b2 - b1 * s3) - s1 * (s1 * b2 - b1 * s2) + b0 * (s1 * s3 - s2 * s2)), det2)).otherwise(0.0)

    f = g.withColumn("_ox", -slope("x")).withColumn("_oy", -slope("y")).withColumn("_bx", bend("x")).withColumn("_by", bend("y")).withColumn("_n", F.hypot("_ox", "_oy"))
    flat = F.col("_n").isNull() | (F.col("_n") < 1e-9)
    return f.select(
        *keys, "tip_x", "tip_y", F.when(flat, 0.0).otherwise(F.col("_ox") / F.col("_n")).alias("tan_x"), F.when(flat, 0.0).otherwise(F.col("_oy") / F.col("_n")).alias("tan_y"),
        F.when(flat, 0.0).otherwise((F.col("_ox") * F.col("_by") - F.col("_oy") * F.col("_bx")) / F.pow("_n", F.lit(3.0))).alias("kappa"), F.col("n").cast("int").alias("support"),
        (~flat & (F.col("span") >= 3) & (F.col("n") >= 3)).alias("reliable"),
    )


#: fdlibm's rational function of the arc sine, highest power first.
_ASIN_P = (3.47933107596021167570e-05, 7.91534994289814532176e-04, -4.00555345006794114027e-02, 2.01212532134862925881e-01, -3.25565818622400915405e-01, 1.66666666666666657415e-01, 0.0)
_ASIN_Q = (7.70381505559019352791e-02, -6.88283971605453293030e-01, 2.02094576023350569471e00, -2.40339491173441421878e00, 1.0)


def arc_cosines(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Adds the arc cosine of each column of cosines in [-1, 1], by arithmetic to a few units in the last place.

    names: cosine to angle. acos leaves the JVM for every row, which takes most of the time of very many pairs.
    """

    def horner(z: str, factors: tuple[float, ...]) -> Column:
        out = F.lit(factors[0])
        for f in factors[1:]:
            out = out * F.col(z) + f
        return out

    def angle_of(c: str) -> Column:
        x, r, half = F.col(c), F.col(f"_r{c}"), F.sqrt(f"_z{c}")
        tip = 2 * (half + half * r)
        return F.when(F.abs(x) < 0.5, math.pi / 2 - (x + x * r)).when(x > 0, tip).when(x <= 0, math.pi - tip)

    # Never null, as code without tests for nulls is shorter, and the JVM compiles no long method.
    z = rows.withColumns({f"_z{c}": F.coalesce(F.when(F.abs(c) < 0.5, F.col(c) * F.col(c)).otherwise((1 - F.abs(c)) * 0.5), F.lit(0.0)) for c in names})
    r = z.withColumns({f"_r{c}": horner(f"_z{c}", _ASIN_P) / horner(f"_z{c}", _ASIN_Q) for c in names})
    return r.withColumns({to: angle_of(c) for c, to in names.items()}).drop(*[f"_{k}{c}" for k in "zr" for c in names])


def costed(pairs: DataFrame, many: bool = False, **weights: float) -> DataFrame:
    """theta, phi_a, phi_b, length and cost of frame pairs (columns suffixed _a and _b); cost is null without both tangents.

    many: lengths and angles by arithmetic alone, some units in the last place away, for very many pairs."""
    dx, dy = F.col("tip_x_b") - F.col("tip_x_a"), F.col("tip_y_b") - F.col("tip_y_a")
    p = pairs.withColumn("length", F.sqrt(dx * dx + dy * dy) if many else F.hypot(dx, dy))
    ux, uy = F.try_divide(dx, F.col("length")), F.try_divide(dy, F.col("length"))
    ax, ay, bx, by = (F.col(c) for c in ("tan_x_a", "tan_y_a", "tan_x_b", "tan_y_b"))
    far = F.col("length") >= 1e-6
    if many:
        held = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))
        p = p.withColumns({"_t": held(-(ax * bx + ay * by)), "_a": F.when(far, held(ax * ux + ay * uy)).otherwise(1.0), "_b": F.when(far, held(-(bx * ux + by * uy))).otherwise(1.0)})
        p = arc_cosines(p, {"_t": "theta", "_a": "phi_a", "_b": "phi_b"}).drop("_t", "_a", "_b")
    else:
        p = p.withColumn("theta", angle(ax, ay, -bx, -by)).withColumn("phi_a", F.when(far, angle(ax, ay, ux, uy)).otherwise(0.0)).withColumn("phi_b", F.when(far, angle(bx, by, -ux, -uy)).otherwise(0.0))
    known = ((ax != 0) | (ay != 0)) & ((bx != 0) | (by != 0))
    return p.withColumn("cost", F.when(known, link_cost(F.col("length"), F.col("theta"), F.col("phi_a"), F.col("phi_b"), F.col("kappa_a"), F.col("kappa_b"), **weights)))


def within_node_pairs(frames: DataFrame, keys: list[str], stub: str = "sid", arm: str = "aid", node: str = "node", block: int = 1024) -> DataFrame:
    """Stub pairs a < b of one node and different arms.

    A node's stubs are dealt in order into blocks; each pair of blocks meets by itself, so a large node is many tasks' work.
    """
    held = frames.filter(F.col(node).isNotNull())
    others = [c for c in frames.columns if c not in (*keys, node)]
    w = Window.partitionBy(*keys, node)
    dealt = held.withColumn("_p", F.floor((F.row_number().over(w.orderBy(stub)) - 1) / block)).withColumn("_n", F.max("_p").over(w))
    side = lambda t, own, met, those: dealt.select(*keys, node, *[F.col(c).alias(f"{c}_{t}") for c in others], F.col("_p").alias(own), F.explode(those).alias(met))
    first, second = side("a", "_i", "_j", F.sequence("_p", "_n")), side("b", "_j", "_i", F.sequence(F.lit(0).cast("long"), F.col("_p")))
    return first.join(second, [*keys, node, "_i", "_j"]).drop("_i", "_j").filter((F.col(f"{stub}_a") < F.col(f"{stub}_b")) & (F.col(f"{arm}_a") != F.col(f"{arm}_b")))


def gap_pairs(frames: DataFrame, keys: list[str], most_length: float, most_theta: float, most_phi: float, stub: str = "sid", arm: str = "aid", node: str = "node", **weights: float) -> DataFrame:
    """Costed stub pairs across gaps: near, of different arms and nodes, and nearly in line."""
    pairs = close_pairs(frames.filter("reliable"), keys, stub, "tip_x", "tip_y", most_length)
    apart = (F.col(f"{arm}_a") != F.col(f"{arm}_b")) & ~F.coalesce(F.col(f"{node}_a") == F.col(f"{node}_b"), F.lit(False))
    priced, facts = costed(pairs.filter(apart), **weights), ["length", "theta", "phi_a", "phi_b", "cost"]
    # Exploded, so that the filter reads what was computed and does not compute all of it again in one method too long to be compiled.
    once = priced.select(*[c for c in priced.columns if c not in facts], F.explode(F.array(F.struct(*facts))).alias("_f")).select("*", "_f.*").drop("_f")
    return once.filter((F.col("cost").isNotNull()) & (F.col("theta") <= most_theta) & (F.greatest("phi_a", "phi_b") <= most_phi))


def cheapest_partner(pairs: DataFrame, keys: list[str], stub: str = "sid") -> DataFrame:
    """Each stub's least cost among its pairs; the pairs are made once for both of their ends."""
    ends = pairs.select(*keys, F.explode(F.array(f"{stub}_a", f"{stub}_b")).alias(stub), "cost")
    return ends.groupBy(*keys, stub).agg(F.min("cost").alias("cost"))


def matching_objective(matching: DataFrame, prices: DataFrame, costs: DataFrame, keys: list[str], penalty: float) -> DataFrame:
    """Cost of the links kept and the prices of the stubs left alone; a link without a cost is charged 4 penalties.

    matching(keys, a, b), a < b; prices(keys, sid, price); costs(keys, a, b, cost)."""
    linked = matching.join(costs, [*keys, "a", "b"], "left").groupBy(*keys).agg(F.sum(F.coalesce("cost", F.lit(4 * penalty)) - 2 * penalty).alias("_links"))
    alone = prices.groupBy(*keys).agg(F.sum("price").alias("_alone"))
    return alone.join(linked, keys, "left").select(*keys, (F.col("_alone") + F.coalesce("_links", F.lit(0.0))).alias("objective"))


def free_stubs(frames: DataFrame, matching: DataFrame, keys: list[str], stub: str = "sid") -> DataFrame:
    """The reliable frames whose stub no link (a, b) of the matching holds."""
    held = matching.select(*keys, F.explode(F.array("a", "b")).alias(stub))
    return frames.filter("reliable").join(held, [*keys, stub], "left_anti")


def same_matching(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """keys, same: whether two matchings (a, b) hold the same links, whichever end comes first."""
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    both = one.select(*keys, *ends, F.lit(1).alias("_w")).unionByName(other.select(*keys, *ends, F.lit(2).alias("_w")))
    links = both.groupBy(*keys, "a", "b").agg(F.count_if(F.col("_w") == 1).alias("_one"), F.count_if(F.col("_w") == 2).alias("_other"))
    return links.groupBy(*keys).agg(F.every((F.col("_one") > 0) == (F.col("_other") > 0)).alias("same"))


def matched(costs: DataFrame, keys: list[str], price: float, prices: DataFrame | None = None) -> DataFrame:
    """keys, a, b: the links that save the most over leaving stubs alone, none of which shares a stub.

    costs(keys, a, b, cost); every stub costs `price` alone, or its own in prices(keys, sid, price).
    Pairs that could not pay are dropped first, and what is left falls apart into connected parts, each
    solved exactly by itself, so parts run in parallel and the result equals one matching of all.
    """
    own = lambda x: F.coalesce(F.col(f"_p{x}"), F.lit(price))
    rows = costs.withColumn("_pa", F.lit(None).cast("double")).withColumn("_pb", F.lit(None).cast("double"))
    if prices is not None:
        held = lambda x: prices.select(*keys, F.col("sid").alias(x), F.col("price").alias(f"_p{x}"))
        rows = costs.join(held("a"), [*keys, "a"], "left").join(held("b"), [*keys, "b"], "left")
    paying = cut(rows.select(*keys, "a", "b", F.col("cost").cast("double").alias("cost"), own("a").alias("price_a"), own("b").alias("price_b")).filter("cost < price_a + price_b"))
    ends = paying.select(*keys, F.col("a").alias("node")).union(paying.select(*keys, "b"))
    parts = connected_components(ends, paying.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")), keys)
    kinds = {f.name: f.dataType.simpleString() for f in paying.schema}
    names = [*keys, "a", "b"]

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        price_of = dict(zip(part.a, part.price_a, strict=True)) | dict(zip(part.b, part.price_b, strict=True))
        links = best_pairs({(a, b): c for a, b, c in zip(part.a, part.b, part.cost, strict=True)}, price_of)
        return pd.DataFrame([(*(part[k].iloc[0] for k in keys), a, b) for a, b in links], columns=names)

    placed = paying.join(parts.withColumnRenamed("node", "a"), [*keys, "a"])
    return placed.groupBy(*keys, "component").applyInPandas(solve, ", ".join(f"`{k}` {kinds[k]}" for k in names))
