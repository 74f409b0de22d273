"""More of the driver's queries: pairs, votes, chains, orders, evidence, files and whole measured scenes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandel.config import DepthRule
from strandel.functions import geometry
from strandel.operators import agreement, encoding, frames, graphs, meshes, pixels, robust, sequence, spatial
from strandel.plans import depth, measure, report, tune
from strandel.plans import tables as T
from strandel.plans.queries import _COST_SQL, _ENDS_SQL, _ends, _r, query
from strandel.session import shared_folder
from strandel.sources import files, images

_OFF = "(SELECT unnest([-1, 0, 1]) AS i) oi, (SELECT unnest([-1, 0, 1]) AS j) oj"
#: Pixels of overlapping instances: a scene a return flag, an instance a supplier mod 10.
_INST_SQL = "inst AS (SELECT DISTINCT l_returnflag AS scene_id, CAST(l_suppkey % 10 + 1 AS INTEGER) AS iid, CAST(l_partkey % 499 AS INTEGER) AS r, CAST(l_orderkey % 499 AS INTEGER) AS c FROM lineitem)"
#: Pixels of fragments, laid over the instances with other keys.
_FRAG_SQL = "frag AS (SELECT DISTINCT l_returnflag AS scene_id, l_linenumber * 100 + l_orderkey % 97 AS frag_id, CAST((l_partkey + l_linenumber * 7) % 499 AS INTEGER) AS r, CAST((l_orderkey + l_suppkey % 3) % 499 AS INTEGER) AS c FROM lineitem)"


def _inst(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("scene_id"), (F.col("l_suppkey") % 10 + 1).cast("int").alias("iid"), (F.col("l_partkey") % 499).cast("int").alias("r"), (F.col("l_orderkey") % 499).cast("int").alias("c")).distinct()


def _frag(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("scene_id"), (F.col("l_linenumber") * 100 + F.col("l_orderkey") % 97).alias("frag_id"), ((F.col("l_partkey") + F.col("l_linenumber") * 7) % 499).cast("int").alias("r"), ((F.col("l_orderkey") + F.col("l_suppkey") % 3) % 499).cast("int").alias("c")).distinct()


# Pairs, links and chains.


@query(f"""
WITH {_ENDS_SQL}, c AS ({_COST_SQL}), p AS (SELECT scene, sid_a, sid_b, 0.2 * theta + least(1.0, len / 3.0) * (pa + pb) + 0.15 * len / 60.0 + 0.5 * bend AS cost FROM c WHERE len <= 30.0 AND theta <= 2.4 AND greatest(pa, pb) <= 2.28)
SELECT scene, sid, round(min(cost), 3) + 0.0 AS cost FROM (SELECT scene, sid_a AS sid, cost FROM p UNION ALL SELECT scene, sid_b, cost FROM p) GROUP BY scene, sid
""")
def q_cheapest_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandel.plans.queries import GAP

    pairs = frames.gap_pairs(_ends(spark, sf_dir), ["scene"], 30.0, 2.4, 2.28, **GAP)
    return frames.cheapest_partner(pairs, ["scene"]).select("scene", "sid", _r("cost", 3))


_LINKS_SQL = "link AS (SELECT DISTINCT o_orderpriority AS scene, least(o_custkey, o_orderkey % 1009) AS a, greatest(o_custkey, o_orderkey % 1009) AS b FROM orders WHERE o_custkey <> o_orderkey % 1009)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("o_custkey"), F.col("o_orderkey") % 1009
    return T.table(spark, sf_dir, "orders").filter(a != b).select(F.col("o_orderpriority").alias("scene"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


@query(f"""
WITH {_LINKS_SQL}, cost AS (SELECT scene, a, b, (a % 13) / 7.0 AS cost FROM link WHERE b % 3 <> 0), price AS (SELECT scene, sid, 0.25 + (sid % 5) / 10.0 AS price FROM (SELECT scene, a AS sid FROM link UNION SELECT scene, b FROM link)),
l AS (SELECT scene, sum(coalesce(cost, 4 * 0.62) - 2 * 0.62) AS k FROM link LEFT JOIN cost USING (scene, a, b) GROUP BY scene)
SELECT scene, round(sum(price) + max(k), 4) + 0.0 AS objective FROM price JOIN l USING (scene) GROUP BY scene
""")
def q_matching_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = _links(spark, sf_dir)
    costs = link.filter("b % 3 <> 0").withColumn("cost", F.col("a") % 13 / 7.0)
    prices = link.select("scene", F.col("a").alias("sid")).union(link.select("scene", "b")).distinct().withColumn("price", 0.25 + F.col("sid") % 5 / 10.0)
    return frames.matching_objective(link, prices, costs, ["scene"], 0.62).select("scene", _r("objective", 4))


@query(f"WITH {_LINKS_SQL} SELECT o_orderpriority AS scene, o_orderkey AS sid FROM orders WHERE o_orderstatus <> 'O' AND NOT EXISTS (SELECT 1 FROM link WHERE scene = o_orderpriority AND (a = o_orderkey OR b = o_orderkey))")
def q_free_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stubs = T.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scene"), F.col("o_orderkey").alias("sid"), (F.col("o_orderstatus") != "O").alias("reliable"))
    return frames.free_stubs(stubs, _links(spark, sf_dir), ["scene"]).select("scene", "sid")


@query(f"""
WITH {_LINKS_SQL}, other AS (SELECT scene, b AS a, a AS b FROM link WHERE scene <> '1-URGENT' OR a % 50 <> 7)
SELECT scene, NOT EXISTS (SELECT 1 FROM link l WHERE l.scene = s.scene AND NOT EXISTS (SELECT 1 FROM other o WHERE o.scene = l.scene AND o.a = l.b AND o.b = l.a)) AS same FROM (SELECT DISTINCT scene FROM link) s
""")
def q_same_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = _links(spark, sf_dir)
    other = link.filter("scene <> '1-URGENT' or a % 50 <> 7").select("scene", F.col("b").alias("a"), F.col("a").alias("b"))
    return frames.same_matching(link, other, ["scene"])


@query(f"WITH {T.DAG_SQL}, own AS (SELECT DISTINCT scene, lo AS node FROM dag WHERE lo % 3 <> 1) SELECT d.scene, d.lo, d.hi FROM dag d JOIN own a ON a.scene = d.scene AND a.node = d.lo JOIN own b ON b.scene = d.scene AND b.node = d.hi")
def q_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.dag(spark, sf_dir)
    return graphs.induced(d, d.filter("lo % 3 <> 1").select("scene", F.col("lo").alias("node")), ["scene"], "lo", "hi")


@query("SELECT l_returnflag AS scene, l_partkey % 50 AS over, l_suppkey % 50 AS under, round(sum(abs(l_discount - l_tax)), 6) + 0.0 AS weight FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50 GROUP BY ALL")
def q_relation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("scene"), (F.col("l_partkey") % 50).alias("over"), (F.col("l_suppkey") % 50).alias("under"), (F.col("l_discount") - F.col("l_tax")).alias("score"))
    return graphs.relation_weights(li.filter("over <> under"), ["scene"]).select("scene", "over", "under", _r("weight"))


#: Customers of a nation in a row, each linked to the next; in every second nation the last one to the first as well.
_RING_SQL = """
row AS (SELECT c_nationkey AS scene, c_custkey AS node, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS next, min(c_custkey) OVER (PARTITION BY c_nationkey) AS first, max(c_custkey) OVER (PARTITION BY c_nationkey) AS last, c_acctbal AS jump FROM customer),
link AS (SELECT scene, node AS a, next AS b, jump FROM row WHERE next IS NOT NULL UNION ALL SELECT scene, first, last, jump FROM row WHERE node = last AND scene % 2 = 0 AND first < last)
"""


def _ring(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    c = T.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scene"), F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("jump"))
    whole = Window.partitionBy("scene")
    rows = c.withColumn("next", F.lead("node").over(whole.orderBy("node"))).withColumn("first", F.min("node").over(whole)).withColumn("last", F.max("node").over(whole))
    line = rows.filter("next is not null").select("scene", F.col("node").alias("a"), F.col("next").alias("b"), "jump")
    close = rows.filter("node = last and scene % 2 = 0 and first < last").select("scene", F.col("first").alias("a"), F.col("last").alias("b"), "jump")
    return c.select("scene", "node"), line.unionByName(close)


@query(f"""
WITH {_RING_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY jump DESC, a DESC, b DESC) AS k FROM link)
SELECT scene, a, b FROM w WHERE scene % 2 = 1 OR k > 1 OR (SELECT count(*) FROM row WHERE row.scene = w.scene) > (SELECT count(*) FROM link WHERE link.scene = w.scene)
""")
def q_open_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms, links = _ring(spark, sf_dir)
    return graphs.break_cycles(arms, links, ["scene"]).select("scene", "a", "b")


@query(f"WITH {_RING_SQL} SELECT scene, node, first AS component FROM row")
def q_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms, links = _ring(spark, sf_dir)
    return graphs.connected_components(arms, links.select("scene", F.col("a").alias("u"), F.col("b").alias("v")), ["scene"])


@query("""
WITH arm AS (SELECT o_orderpriority AS scene_id, o_orderkey AS aid, o_custkey AS chain_id, 1 + o_orderkey % 11 AS px, o_orderkey % 3 = 0 AS held FROM orders),
f AS (SELECT scene_id, chain_id, count(*) AS n, max(px) AS px, bool_or(held) AS held FROM arm GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY chain_id) AS INTEGER) AS iid FROM f WHERE NOT (n = 1 AND px < 6 AND NOT held))
SELECT scene_id, chain_id, aid, iid FROM arm JOIN k USING (scene_id, chain_id)
""")
def q_emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scene_id"), F.col("o_orderkey").alias("aid"), F.col("o_custkey").alias("chain_id"))
    arms = o.select("scene_id", "aid", (1 + F.col("aid") % 11).alias("n_px"))
    stubs = o.select("scene_id", "aid", F.explode(F.array(F.when(F.col("aid") % 3 == 0, F.col("chain_id")), F.lit(None).cast("long"))).alias("node"))
    return encoding.emitted(o, arms, stubs).select("scene_id", "chain_id", "aid", "iid")


@query("""
WITH arm AS (SELECT DISTINCT l_returnflag AS scene_id, l_suppkey AS aid, l_partkey % 499 AS r, l_orderkey % 499 AS c FROM lineitem), node AS (SELECT DISTINCT l_returnflag AS scene_id, l_linenumber AS nid, l_orderkey % 499 AS r, l_suppkey % 499 AS c FROM lineitem),
chain AS (SELECT DISTINCT l_returnflag AS scene_id, CAST(l_suppkey % 7 + 1 AS INTEGER) AS iid, l_suppkey AS aid FROM lineitem), held AS (SELECT DISTINCT l_returnflag AS scene_id, l_linenumber AS nid, l_suppkey AS aid FROM lineitem WHERE l_suppkey % 4 = 0)
SELECT scene_id, iid, r, c FROM chain JOIN arm USING (scene_id, aid) UNION SELECT scene_id, iid, r, c FROM chain JOIN held USING (scene_id, aid) JOIN node USING (scene_id, nid)
""")
def q_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.table(spark, sf_dir, "lineitem").withColumn("scene_id", F.col("l_returnflag"))
    arm = li.select("scene_id", F.col("l_suppkey").alias("aid"), (F.col("l_partkey") % 499).alias("r"), (F.col("l_orderkey") % 499).alias("c")).distinct()
    node = li.select("scene_id", F.col("l_linenumber").alias("nid"), (F.col("l_orderkey") % 499).alias("r"), (F.col("l_suppkey") % 499).alias("c")).distinct()
    chain = li.select("scene_id", (F.col("l_suppkey") % 7 + 1).cast("int").alias("iid"), F.col("l_suppkey").alias("aid")).distinct()
    held = li.filter("l_suppkey % 4 = 0").select("scene_id", F.col("l_linenumber").alias("nid"), F.col("l_suppkey").alias("aid")).distinct()
    return encoding.layers(arm, node, chain, held)


@query("""
WITH pair AS (SELECT CAST(c_custkey // 3 AS BIGINT) AS part, c_custkey AS a, c_custkey + 1 AS b, (c_custkey * 7919 % 1000) / 1000.0 AS cost FROM customer WHERE c_custkey % 3 < 2),
w AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY cost, a) AS rn FROM pair WHERE cost < 0.62) SELECT CAST(part % 5 AS BIGINT) AS scene, a, b FROM w WHERE rn = 1
""")
def q_matched_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stubs 3k, 3k + 1 and 3k + 2 lie in a row, so the best matching of a part is its link of most gain."""
    c = T.table(spark, sf_dir, "customer").filter("c_custkey % 3 < 2")
    pairs = c.select((F.floor(F.col("c_custkey") / 3) % 5).alias("scene"), F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"), (F.col("c_custkey") * 7919 % 1000 / 1000.0).alias("cost"))
    return frames.matched(pairs, ["scene"], 0.31)


@query("""
WITH e AS (SELECT c_custkey // 4 AS n, 4 * (c_custkey // 4) + i AS a, 4 * (c_custkey // 4) + j AS b, ((c_custkey // 4) * 31 + i * 17 + j * 7) % 97 / 100.0 AS cost FROM (SELECT DISTINCT c_custkey // 4 * 4 AS c_custkey FROM customer), (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([1, 2, 3]) AS j) WHERE i < j),
price AS (SELECT *, 0.2 + (a % 5) / 10.0 + 0.2 + (b % 5) / 10.0 - cost AS gain FROM e), m AS (
  SELECT n, [a] AS l, [b] AS r, gain FROM price WHERE gain > 0
  UNION ALL SELECT x.n, [x.a, y.a], [x.b, y.b], x.gain + y.gain FROM price x JOIN price y ON x.n = y.n AND x.a < y.a AND x.b <> y.a AND x.b <> y.b WHERE x.gain > 0 AND y.gain > 0),
w AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY gain DESC) AS rn FROM m)
SELECT CAST(n AS BIGINT) AS crossing, round(gain, 6) + 0.0 AS saved FROM w WHERE rn = 1
""")
def q_matched_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best matching of four stubs at a crossing saves, with a price for every stub, against all matchings."""
    node = T.table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 4).alias("n")).distinct()
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(i + 1, 4)]))
    pairs = node.select("n", ends.alias("e")).select(F.col("n").alias("crossing"), (4 * F.col("n") + F.col("e.i")).alias("a"), (4 * F.col("n") + F.col("e.j")).alias("b"), ((F.col("n") * 31 + F.col("e.i") * 17 + F.col("e.j") * 7) % 97 / 100.0).alias("cost"))
    prices = node.select(F.col("n").alias("crossing"), F.explode(F.sequence(4 * F.col("n"), 4 * F.col("n") + 3)).alias("sid")).withColumn("price", 0.2 + F.col("sid") % 5 / 10.0)
    found = frames.matched(pairs, ["crossing"], 0.0, prices)
    alone = lambda x: prices.select("crossing", F.col("sid").alias(x), F.col("price").alias(f"p{x}"))
    kept = found.join(pairs, ["crossing", "a", "b"]).join(alone("a"), ["crossing", "a"]).join(alone("b"), ["crossing", "b"])
    return kept.groupBy("crossing").agg(F.sum(F.col("pa") + F.col("pb") - F.col("cost")).alias("saved")).select("crossing", _r("saved"))


# Votes and overlaps.


@query(f"""
WITH {_FRAG_SQL}, {_INST_SQL}, n AS (SELECT scene_id, frag_id, count(*) AS n FROM frag GROUP BY ALL), h AS (SELECT scene_id, frag_id, iid, count(*) AS k FROM frag JOIN inst USING (scene_id, r, c) GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frag_id ORDER BY k DESC, iid) AS rn FROM h), v AS (SELECT n.scene_id, n.frag_id, CASE WHEN k >= 0.3 * n THEN iid END AS iid FROM n LEFT JOIN t ON t.scene_id = n.scene_id AND t.frag_id = n.frag_id AND rn = 1),
a AS (SELECT scene_id, iid, count(*) AS area FROM inst GROUP BY ALL), o AS (SELECT scene_id, r, c, iid FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, r, c ORDER BY area DESC, iid) AS rn FROM inst JOIN a USING (scene_id, iid)) WHERE rn = 1),
d AS (SELECT i, j, i * i + j * j AS d FROM (SELECT unnest(range(-6, 7)) AS i), (SELECT unnest(range(-6, 7)) AS j) WHERE i * i + j * j <= 36),
m AS (SELECT f.scene_id, f.frag_id, f.r, f.c, f.r + i AS br, f.c + j AS bc, d FROM frag f JOIN v ON v.scene_id = f.scene_id AND v.frag_id = f.frag_id AND v.iid IS NULL, d),
w AS (SELECT m.scene_id, frag_id, m.r, m.c, o.iid, row_number() OVER (PARTITION BY m.scene_id, frag_id, m.r, m.c ORDER BY d, br, bc) AS rn FROM m JOIN o ON o.scene_id = m.scene_id AND o.r = br AND o.c = bc),
g AS (SELECT scene_id, frag_id, iid, count(*) AS k FROM w WHERE rn = 1 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frag_id ORDER BY k DESC, iid) AS rn FROM g)
SELECT v.scene_id, v.frag_id, CAST(coalesce(v.iid, b.iid, 0) AS INTEGER) AS iid FROM v LEFT JOIN b ON b.scene_id = v.scene_id AND b.frag_id = v.frag_id AND b.rn = 1
""")
def q_assign_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.assign_fragments(_frag(spark, sf_dir), _inst(spark, sf_dir))


@query(f"""
WITH {_INST_SQL}, a AS (SELECT scene_id, iid, count(*) AS area FROM inst GROUP BY ALL) SELECT scene_id, iid, area, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY area DESC, iid) AS INTEGER) AS place FROM a
""")
def q_area_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.by_area(_inst(spark, sf_dir), ["scene_id"])


@query(f"""
WITH {_FRAG_SQL}, {_INST_SQL}, t AS (SELECT scene_id, frag_id AS piece, r + i AS r, c + j AS c FROM frag, {_OFF} WHERE i <> 0 OR j <> 0)
SELECT DISTINCT scene_id, piece, iid AS cluster FROM t JOIN inst USING (scene_id, r, c)
""")
def q_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.touching(_frag(spark, sf_dir).withColumnRenamed("frag_id", "piece"), _inst(spark, sf_dir).withColumnRenamed("iid", "cluster"), ["scene_id"])


@query(f"""
WITH {_INST_SQL}, tip AS (SELECT DISTINCT l_returnflag AS scene_id, (l_suppkey % 499) * 1000 + l_orderkey % 499 AS tip, CAST(l_suppkey % 499 AS INTEGER) AS r, CAST(l_orderkey % 499 AS INTEGER) AS c FROM lineitem),
v AS (SELECT scene_id, tip, iid, count(*) AS k FROM (SELECT scene_id, tip, r + i AS r, c + j AS c FROM tip, {_OFF} WHERE i <> 0 OR j <> 0) JOIN inst USING (scene_id, r, c) GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY scene_id, tip ORDER BY k DESC, iid) AS rn FROM v)
SELECT tip.scene_id, tip.tip, w.iid AS node FROM tip LEFT JOIN w ON w.scene_id = tip.scene_id AND w.tip = tip.tip AND rn = 1
""")
def q_held_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.table(spark, sf_dir, "lineitem")
    r, c = F.col("l_suppkey") % 499, F.col("l_orderkey") % 499
    tips = li.select(F.col("l_returnflag").alias("scene_id"), (r * 1000 + c).alias("tip"), r.cast("int").alias("r"), c.cast("int").alias("c")).distinct()
    return pixels.held_by(tips, _inst(spark, sf_dir).withColumnRenamed("iid", "node"), ["scene_id"])


@query(f"WITH {T.PIXEL_SQL}, d AS (SELECT i, j FROM (SELECT unnest(range(-3, 4)) AS i), (SELECT unnest(range(-3, 4)) AS j) WHERE i * i + j * j <= 2.5 * 2.5) SELECT DISTINCT scene, CAST(r + i AS INTEGER) AS r, CAST(c + j AS INTEGER) AS c FROM pixel, d")
def q_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.disc(T.pixels(spark, sf_dir), ["scene"], 2.5)


@query(f"""
WITH RECURSIVE {T.PIXEL_SQL}, near AS (SELECT scene, r + i AS r, c + j AS c, count(*) AS k FROM pixel, {_OFF} WHERE i <> 0 OR j <> 0 GROUP BY ALL), deg AS (SELECT p.scene, p.r, p.c, coalesce(k, 0) AS k FROM pixel p LEFT JOIN near n USING (scene, r, c)),
thin AS (SELECT * FROM deg WHERE k < 3), e AS (SELECT a.scene, a.r * 1000 + a.c AS u, p.r * 1000 + p.c AS v FROM (SELECT scene, r, c, r + i AS r2, c + j AS c2 FROM thin, {_OFF}) a JOIN thin p ON p.scene = a.scene AND p.r = a.r2 AND p.c = a.c2),
w(scene, u, root) AS (SELECT scene, r * 1000 + c, r * 1000 + c FROM thin UNION SELECT e.scene, e.v, w.root FROM w JOIN e ON e.scene = w.scene AND e.u = w.u), m AS (SELECT scene, u, min(root) AS root FROM w GROUP BY scene, u),
touch AS (SELECT DISTINCT scene, r + i AS r, c + j AS c FROM deg, {_OFF} WHERE k >= 3),
f AS (SELECT m.scene, root, count(*) AS n, bool_or(touch.r IS NOT NULL) AS t, min(thin.k) AS low FROM m JOIN thin ON thin.scene = m.scene AND thin.r * 1000 + thin.c = u LEFT JOIN touch ON touch.scene = thin.scene AND touch.r = thin.r AND touch.c = thin.c GROUP BY m.scene, root),
gone AS (SELECT m.scene, u FROM m JOIN f USING (scene, root) WHERE n <= 3 AND t AND low <= 1)
SELECT scene, r, c FROM pixel WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.scene = pixel.scene AND gone.u = pixel.r * 1000 + pixel.c)
""")
def q_prune_spurs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.prune_spurs(T.pixels(spark, sf_dir), ["scene"], 3, rounds=1)


@query(f"""
WITH {_INST_SQL}, px AS (SELECT DISTINCT scene_id, r, c FROM inst), b AS (SELECT i, floor(i * 499 / 3.0) AS lo, floor((i + 1) * 499 / 3.0) AS hi FROM (SELECT unnest([0, 1, 2]) AS i)),
t AS (SELECT scene_id || '#' || y.i || '#' || x.i AS scene_id, r - y.lo AS r, c - x.lo AS c FROM px JOIN b y ON r >= y.lo AND r < y.hi JOIN b x ON c >= x.lo AND c < x.hi),
g AS (SELECT scene_id || '#' || y.i || '#' || x.i AS scene_id, iid, count(*) AS n FROM inst JOIN b y ON r >= y.lo AND r < y.hi JOIN b x ON c >= x.lo AND c < x.hi GROUP BY ALL),
k AS (SELECT scene_id FROM (SELECT scene_id FROM t GROUP BY scene_id HAVING count(*) >= 200) SEMI JOIN (SELECT scene_id FROM g WHERE n >= 20 GROUP BY scene_id HAVING count(*) >= 2) USING (scene_id))
SELECT scene_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM t SEMI JOIN k USING (scene_id)
""")
def q_tile_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = _inst(spark, sf_dir)
    scenes = inst.select("scene_id").distinct().withColumns({"height": F.lit(499), "width": F.lit(499)})
    return tune.tile_scenes(inst.select("scene_id", "r", "c").distinct(), scenes, inst, (3, 3))[0]


# Tracks.


@query(f"""
WITH {T.TRACK_SQL}, d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM track WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
n AS (SELECT *, CASE WHEN d > 1.6 AND d <= 30.0 THEN CAST(ceil(d) AS INTEGER) ELSE 1 END AS n FROM d), k AS (SELECT *, unnest(range(1, n + 1)) AS k FROM n)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq, k) - 1 AS INTEGER) AS seq, round(CASE WHEN k = n THEN x ELSE px + (x - px) * k / n END + 1e-8, 5) + 0.0 AS x, round(CASE WHEN k = n THEN y ELSE py + (y - py) * k / n END + 1e-8, 5) + 0.0 AS y FROM k
""")
def q_bridge_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.bridge_jumps(T.tracks(spark, sf_dir), ["user_id"], 30.0).withColumns({"x": F.col("x") + 1e-8, "y": F.col("y") + 1e-8}).select("user_id", "seq", _r("x", 5), _r("y", 5))


_ARC_SQL = f"{T.TRACK_SQL}, arc AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY seq) AS s FROM (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM track WINDOW w AS (PARTITION BY user_id ORDER BY seq)))"


@query(f"""
WITH {_ARC_SQL}, t AS (SELECT user_id, max(s) AS total, count(*) AS k FROM arc GROUP BY user_id), n AS (SELECT *, greatest(2, CAST(ceil(total / 20.0) AS INTEGER) + 1) AS n FROM t WHERE k >= 2 AND total >= 20.0),
g AS (SELECT user_id, n, total, unnest(range(0, n)) AS g FROM n), p AS (SELECT *, total * g / (n - 1) AS goal FROM g),
seg AS (SELECT user_id, s, x, y, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM arc WINDOW w AS (PARTITION BY user_id ORDER BY seq)), h AS (SELECT p.user_id, p.g, p.goal, seg.* EXCLUDE (user_id) FROM p ASOF JOIN (SELECT * FROM seg WHERE s1 > s) seg ON seg.user_id = p.user_id AND p.goal >= seg.s)
SELECT user_id, CAST(g AS INTEGER) AS seq, round(x + (x1 - x) * least(1.0, (goal - s) / (s1 - s)), 4) + 0.0 AS x, round(y + (y1 - y) * least(1.0, (goal - s) / (s1 - s)), 4) + 0.0 AS y FROM h
UNION ALL SELECT user_id, seq, round(x, 4) + 0.0, round(y, 4) + 0.0 FROM arc JOIN t USING (user_id) WHERE k < 2 OR total < 20.0
""")
def q_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.densify(T.tracks(spark, sf_dir), ["user_id"], 20.0).select("user_id", "seq", _r("x", 4), _r("y", 4))


@query(f"""
WITH {_ARC_SQL}, t AS (SELECT user_id, max(s) AS total FROM arc GROUP BY user_id HAVING max(s) >= 2), g AS (SELECT user_id, unnest(range(0, CAST(floor(total + 1e-9) AS BIGINT) + 1)) AS g FROM t),
seg AS (SELECT user_id, s, x, y, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM arc WINDOW w AS (PARTITION BY user_id ORDER BY seq)), h AS (SELECT g.user_id, g.g, seg.* EXCLUDE (user_id) FROM g ASOF JOIN (SELECT * FROM seg WHERE s1 > s) seg ON seg.user_id = g.user_id AND CAST(g.g AS DOUBLE) >= seg.s),
p AS (SELECT user_id, g, x + (x1 - x) * (g - s) / (s1 - s) AS x, y + (y1 - y) * (g - s) / (s1 - s) AS y FROM h)
SELECT user_id, count(*) AS n, round(sum(x), 2) + 0.0 AS sum_x, round(sum(y), 2) + 0.0 AS sum_y, round(max(abs(y)), 4) + 0.0 AS top FROM p GROUP BY user_id
""")
def q_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sequence.resample(T.tracks(spark, sf_dir), ["user_id"], 1.5)
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.max(F.abs("y")).alias("top")).select("user_id", "n", _r("sum_x", 2), _r("sum_y", 2), _r("top", 4))


_EXC_SQL = ", ".join(f"abs(median(width) OVER (PARTITION BY scene_id, iid ORDER BY seq ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING) - level) / greatest(1.2533 * sigma_noise / sqrt({w}.0), 1e-6) AS z{w}" for w in sequence.EXCURSION_WINDOWS)
_EXC_PICK = " UNION ALL ".join(f"SELECT scene_id, iid, i, {w} AS w, z{w} AS z FROM ez WHERE cnt >= {w} AND i >= {w // 2} AND i < cnt - {w // 2}" for w in sequence.EXCURSION_WINDOWS)

#: Cuts of an instance: a user's events in order, widths 1 to 31 wide; sign-ups are refused.
_CUTS_SQL = f"""
{T.TRACK_SQL}, cut AS (SELECT 'e' || CAST(user_id % 3 AS VARCHAR) AS scene_id, CAST(user_id AS INTEGER) AS iid, seq, x AS s, 1 + y / 20 AS width, y / 500 AS amplitude, CASE WHEN event_type = 'signup' THEN 'low_contrast' WHEN seq % 17 = 5 THEN 'crest_off_axis' ELSE 'ok' END AS reason FROM track),
good AS (SELECT *, count(*) OVER (PARTITION BY scene_id) >= 20 AND width > 2 * median(width) OVER (PARTITION BY scene_id) AS over_cap FROM cut WHERE reason = 'ok'), kept AS (SELECT * FROM good WHERE NOT over_cap),
base AS (SELECT *, median(width) OVER p AS level, count(*) OVER p AS cnt, row_number() OVER (PARTITION BY scene_id, iid ORDER BY seq) - 1 AS i, lag(width) OVER (PARTITION BY scene_id, iid ORDER BY seq) AS pw, lag(s) OVER (PARTITION BY scene_id, iid ORDER BY seq) AS ps FROM kept WINDOW p AS (PARTITION BY scene_id, iid)),
spread AS (SELECT scene_id, iid, count(*) AS n, median(width) AS median, 1.4826 * median(abs(width - level)) AS mad, quantile_cont(width, 0.16) AS p16, quantile_cont(width, 0.84) AS p84, quantile_cont(width, 0.9) AS p90, quantile_cont(amplitude, 0.5) AS brightness_p50, quantile_cont(amplitude, 0.9) AS brightness_p90 FROM base GROUP BY ALL),
step AS (SELECT *, CASE WHEN s - ps <= 3.0 THEN width - pw END AS d FROM base), stepm AS (SELECT *, median(d) OVER (PARTITION BY scene_id, iid) AS md FROM step),
noise0 AS (SELECT scene_id, iid, count(*) AS n, count(d) AS k, 1.4826 * median(abs(d - md)) / sqrt(2.0) AS nd, 1.4826 * median(abs(width - level)) AS nw FROM stepm GROUP BY ALL),
noise AS (SELECT scene_id, iid, CASE WHEN n >= 8 AND k >= 6 THEN nd END AS sigma_noise, CASE WHEN n >= 8 AND k >= 6 THEN sqrt(greatest(0.0, nw * nw - nd * nd)) END AS sigma_real FROM noise0),
dev AS (SELECT scene_id, iid, i, cnt, width - avg(width) OVER (PARTITION BY scene_id, iid) AS d FROM base), var AS (SELECT scene_id, iid, cnt, sum(d * d) AS v FROM dev GROUP BY ALL),
lagged AS (SELECT a.scene_id, a.iid, b.i - a.i AS k, sum(a.d * b.d) AS c FROM dev a JOIN dev b ON a.scene_id = b.scene_id AND a.iid = b.iid AND b.i - a.i BETWEEN 1 AND 40 GROUP BY ALL),
corr AS (SELECT l.scene_id, l.iid, k, c / v AS c, min(CASE WHEN c / v <= 0 THEN k END) OVER (PARTITION BY l.scene_id, l.iid) AS stop FROM lagged l JOIN var USING (scene_id, iid) WHERE k <= least(cnt // 2, 40)), corrs AS (SELECT scene_id, iid, sum(c) AS c FROM corr WHERE stop IS NULL OR k < stop GROUP BY ALL),
size AS (SELECT var.scene_id, var.iid, CASE WHEN cnt < 8 OR v <= 0 THEN CAST(cnt AS DOUBLE) ELSE greatest(1.0, cnt / greatest(1.0, 1 + 2 * coalesce(c, 0))) END AS n_eff FROM var LEFT JOIN corrs USING (scene_id, iid)),
ez AS (SELECT base.*, {_EXC_SQL} FROM base JOIN noise USING (scene_id, iid) WHERE sigma_noise > 1e-6 AND cnt >= 6), ep AS ({_EXC_PICK}),
peak AS (SELECT scene_id, iid, z AS excursion_z, w AS excursion_width FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, iid ORDER BY z DESC, w, i) AS rn FROM ep WHERE z > 0) WHERE rn = 1),
js AS (SELECT *, median(width) OVER (PARTITION BY scene_id, iid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m0, median(width) OVER (PARTITION BY scene_id, iid ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m1 FROM base),
jump AS (SELECT scene_id, iid, abs(m0 - m1) AS step, CASE WHEN abs(m0 - m1) > 0 THEN s END AS step_at FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, iid ORDER BY abs(m0 - m1) DESC, i) AS rn FROM js WHERE cnt >= 8 AND i >= 4 AND i <= cnt - 4) WHERE rn = 1),
ref AS (SELECT scene_id, iid, string_agg(reason || '=' || k, ',' ORDER BY reason) AS refusals FROM (SELECT scene_id, iid, reason, count(*) AS k FROM (SELECT scene_id, iid, reason FROM cut WHERE reason <> 'ok' UNION ALL SELECT scene_id, iid, 'wider_than_scene' FROM good WHERE over_cap) GROUP BY ALL) GROUP BY ALL),
bundle AS (SELECT c.scene_id, c.iid, CASE WHEN n >= 3 THEN n END AS n3, spread.* EXCLUDE (scene_id, iid), sigma_noise, sigma_real, n_eff, excursion_z, excursion_width, step, step_at, refusals
  FROM (SELECT DISTINCT scene_id, iid FROM cut) c LEFT JOIN spread USING (scene_id, iid) LEFT JOIN noise USING (scene_id, iid) LEFT JOIN size USING (scene_id, iid) LEFT JOIN peak USING (scene_id, iid) LEFT JOIN jump USING (scene_id, iid) LEFT JOIN ref USING (scene_id, iid))
"""


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tracks(spark, sf_dir)
    reason = F.when(F.col("event_type") == "signup", "low_contrast").when(F.col("seq") % 17 == 5, "crest_off_axis").otherwise("ok")
    return t.select(F.concat(F.lit("e"), (F.col("user_id") % 3).cast("string")).alias("scene_id"), F.col("user_id").cast("int").alias("iid"), "seq", F.col("x").alias("s"), (1 + F.col("y") / 20).alias("width"), (F.col("y") / 500).alias("amplitude"), reason.alias("reason"))


_BUNDLE_COLUMNS = {"median": 6, "mad": 6, "p16": 6, "p84": 6, "p90": 6}


@query(f"""
WITH {_CUTS_SQL} SELECT scene_id, iid, n, {", ".join(f"CASE WHEN n >= 3 THEN round({c}, 6) + 0.0 END AS {c}" for c in _BUNDLE_COLUMNS)}, CASE WHEN n IS NULL THEN NULL WHEN n < 3 THEN 'none' WHEN n < 12 OR mad > 0.6 * median THEN 'weak' ELSE 'good' END AS quality,
  round(brightness_p50, 6) + 0.0 AS brightness_p50, round(brightness_p90, 6) + 0.0 AS brightness_p90, round(sigma_noise, 6) + 0.0 AS sigma_noise, round(sigma_real, 6) + 0.0 AS sigma_real, round(n_eff, 4) + 0.0 AS n_eff, round(excursion_z, 5) + 0.0 AS excursion_z, excursion_width,
  round(step, 6) + 0.0 AS step, round(step_at, 6) + 0.0 AS step_at, coalesce(refusals, '') AS refusals, CASE WHEN n >= 3 THEN round(1.2533 * mad / sqrt(n_eff), 5) + 0.0 END AS standard_error FROM bundle
""")
def q_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = measure.bundles(_cuts(spark, sf_dir)).withColumnRenamed("at", "step_at")
    held = F.coalesce(F.array_join(F.transform(F.map_entries("refusals"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","), F.lit("")).alias("refusals")
    rounded = [_r(c, 4 if c == "n_eff" else 5 if c in ("excursion_z", "standard_error") else 6) for c in (*_BUNDLE_COLUMNS, "brightness_p50", "brightness_p90", "sigma_noise", "sigma_real", "n_eff", "excursion_z", "step", "step_at", "standard_error")]
    return b.select("scene_id", "iid", "n", "quality", "excursion_width", held, *rounded)


@query(f"""
WITH {_CUTS_SQL}, b AS (SELECT scene_id, iid, n, median FROM bundle WHERE n >= 3), e AS (SELECT scene_id, quantile_cont(median, 0.05) AS lo, quantile_cont(median, 0.95) AS hi FROM b GROUP BY scene_id)
SELECT scene_id, iid, round(median, 6) + 0.0 AS median, n, round(least(greatest((median - lo) / greatest(hi - lo, 1e-9), 0.0), 1.0), 6) + 0.0 AS colour, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, iid) <= 12 AS labelled FROM b JOIN e USING (scene_id)
""")
def q_overlay_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.overlay_table(measure.bundles(_cuts(spark, sf_dir))).select("scene_id", "iid", _r("median"), "n", _r("colour"), "labelled")


@query(f"""
WITH {_CUTS_SQL}, b AS (SELECT scene_id, iid, CASE WHEN n >= 3 THEN median END AS median FROM bundle)
SELECT scene_id, iid, round(median, 6) + 0.0 AS median, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY median DESC NULLS LAST, iid) AS INTEGER) AS place, round(median - 9.0, 6) + 0.0 AS error FROM b
""")
def q_width_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = measure.bundles(_cuts(spark, sf_dir))
    return report.width_table(b, b.select("scene_id", "iid", F.lit(9.0).alias("true_width"))).select("scene_id", "iid", _r("median"), "place", _r("error"))


@query(f"""
WITH {_CUTS_SQL}, q AS (SELECT scene_id, CASE WHEN n IS NULL THEN NULL WHEN n < 3 THEN 'none' WHEN n < 12 OR mad > 0.6 * median THEN 'weak' ELSE 'good' END AS quality FROM bundle)
SELECT scene_id, count(*) FILTER (WHERE quality = 'good') AS good, count(*) FILTER (WHERE quality = 'weak') AS weak, count(*) FILTER (WHERE quality = 'none') AS none FROM q GROUP BY ROLLUP (scene_id)
""")
def q_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.quality_counts(measure.bundles(_cuts(spark, sf_dir)))


# Evidence, costs and heights.


@query("""
WITH e AS (SELECT event_id, (value - 50) / 25.0 AS a, sin(event_id) AS b, cos(event_id) AS f FROM events)
SELECT event_id, round(2.0 * f, 6) + 0.0 AS noise_floored, round(2.0 * a + 1.0 * least(greatest(b * 3, -1.0), 1.0), 6) + 0.0 AS winsorized_linear, round(2.0 * tanh(a) + 1.0 * tanh(b * 3), 6) + 0.0 AS weight_of_evidence FROM e
""")
def q_channel_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select("event_id", ((F.col("value") - 50) / 25.0).alias("a"), (F.sin("event_id") * 3).alias("b"), F.cos("event_id").alias("f"))
    scored = e.select("event_id", *[geometry.combine_channels(F.col("a"), F.col("b"), F.col("f"), rule).alias(rule) for rule in geometry.RULES])
    return scored.select("event_id", *[_r(rule) for rule in geometry.RULES])


@query("""
WITH e AS (SELECT event_id, CAST(user_id AS INTEGER) AS i, CAST(user_id + 1000000 AS INTEGER) AS j, CASE WHEN event_id % 3 <> 0 THEN (value - 50) / 25.0 END AS score, CASE WHEN event_id % 5 <> 0 THEN least(greatest(value / 100, 0.0), 1.0) END AS p FROM events),
s AS (SELECT *, coalesce(score, CASE WHEN p IS NOT NULL THEN ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) END) AS z FROM e)
SELECT event_id, CASE WHEN abs(z) >= 0.4 THEN CASE WHEN z > 0 THEN i ELSE j END END AS by_rule, CASE WHEN abs(z) >= ln(0.65 / 0.35) THEN CASE WHEN z > 0 THEN i ELSE j END END AS by_band, CAST(NULL AS INTEGER) AS over, false AS flipped FROM s
""")
def q_abstain_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    found = e.select("event_id", F.col("user_id").cast("int").alias("i"), (F.col("user_id") + 1_000_000).cast("int").alias("j"), F.when(F.col("event_id") % 3 != 0, (F.col("value") - 50) / 25.0).alias("score"), F.when(F.col("event_id") % 5 != 0, F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))).alias("p_over"), F.lit(7).alias("over"), F.lit(True).alias("flipped"))
    by_rule = depth.abstain_again(found, rule=DepthRule()).withColumnRenamed("raw_over", "by_rule")
    return depth.abstain_again(by_rule, band=0.15).withColumnRenamed("raw_over", "by_band").select("event_id", "by_rule", "by_band", "over", "flipped")


@query(f"""
WITH e AS (SELECT event_id, value / 100 AS a, sin(event_id) AS b, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 0.05 + (event_id % 7) / 50.0 END AS noise FROM events),
z AS (SELECT event_id, {geometry.APPEARANCE_WEIGHTS[0]} * tanh(abs(a) / CASE WHEN noise > 1e-6 THEN noise ELSE 0.02 END) + {geometry.APPEARANCE_WEIGHTS[1]} * tanh(abs(b) / CASE WHEN noise > 1e-6 THEN noise ELSE 0.02 END) + {geometry.APPEARANCE_INTERCEPT} AS z FROM e)
SELECT event_id, round(ln(1 + exp(-z)) - ln(1 + exp(-{geometry.APPEARANCE_INTERCEPT})), 6) + 0.0 AS cost FROM z
""")
def q_appearance_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = F.when(F.col("event_id") % 4 != 0, 0.05 + F.col("event_id") % 7 / 50.0)
    e = T.table(spark, sf_dir, "events").select("event_id", geometry.appearance_cost(F.col("value") / 100, F.sin("event_id"), noise).alias("cost"))
    return e.select("event_id", _r("cost"))


@query("""
WITH e AS (SELECT event_id, 5 + event_id % 90 AS r, 3 + user_id % 110 AS c, sin(event_id) AS nr, cos(event_id) AS nc FROM events),
s AS (SELECT *, least((CASE WHEN nr > 0 THEN 98 - r ELSE r - 1 END) / abs(nr), (CASE WHEN nr > 0 THEN r - 1 ELSE 98 - r END) / abs(nr)) AS a, least((CASE WHEN nc > 0 THEN 118 - c ELSE c - 1 END) / abs(nc), (CASE WHEN nc > 0 THEN c - 1 ELSE 118 - c END) / abs(nc)) AS b FROM e)
SELECT event_id, round(greatest(0.0, least(22.0, a, b)), 6) + 0.0 AS reach FROM s
""")
def q_image_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select("event_id", geometry.image_reach(5 + F.col("event_id") % 90, 3 + F.col("user_id") % 110, F.sin("event_id"), F.cos("event_id"), F.lit(100), F.lit(120), 22.0).alias("reach"))
    return e.select("event_id", _r("reach"))


@query("SELECT event_id, CASE WHEN value IS NOT NULL AND event_id % 3 <> 0 THEN round(greatest(value / 100, 0.5), 6) + 0.0 END AS diameter, round(least(greatest((value - 10) / 60, 0.0), 1.0), 6) + 0.0 AS share FROM events")
def q_width_to_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    out = e.select("event_id", geometry.width_to_diameter(F.when(F.col("event_id") % 3 != 0, F.col("value") / 100)).alias("diameter"), geometry.colour_share(F.col("value"), F.lit(10.0), F.lit(70.0)).alias("share"))
    return out.select("event_id", _r("diameter"), _r("share"))


#: Decided pairs without cycles in scenes of at most ten instances, so that the order is exact and keeps them all.
_SMALL_DAG = "sdag AS (SELECT DISTINCT 's' || l_suppkey AS scene_id, CAST(least(l_partkey % 10, l_orderkey % 10) AS INTEGER) AS lo, CAST(greatest(l_partkey % 10, l_orderkey % 10) AS INTEGER) AS hi FROM lineitem WHERE l_partkey % 10 <> l_orderkey % 10)"


def _small_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey") % 10, F.col("l_orderkey") % 10
    return T.table(spark, sf_dir, "lineitem").filter(a != b).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("scene_id"), F.least(a, b).cast("int").alias("lo"), F.greatest(a, b).cast("int").alias("hi")).distinct()


_STACK_SQL = f"""
{_SMALL_DAG}, node AS (SELECT scene_id, lo AS n FROM sdag UNION SELECT scene_id, hi FROM sdag),
lv(scene_id, n, level, z) AS (SELECT scene_id, n, 0, CAST(0 AS DOUBLE) FROM node UNION SELECT lv.scene_id, hi, level + 1, z + (1.0 + lo % 3) + (1.0 + hi % 3) FROM lv JOIN sdag ON sdag.scene_id = lv.scene_id AND sdag.lo = lv.n),
top AS (SELECT scene_id, n AS iid, max(level) AS layer, max(z) AS z FROM lv GROUP BY scene_id, n)
"""


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _small_dag(spark, sf_dir)
    found = d.select("scene_id", F.col("lo").alias("i"), F.col("hi").alias("j"), F.lit(-1.0).alias("score"), F.col("hi").alias("raw_over"))
    shapes = d.select("scene_id", F.col("lo").alias("iid")).union(d.select("scene_id", "hi")).distinct().withColumn("radius", 1.0 + F.col("iid") % 3)
    return depth.stacked(found, shapes)


@query(f"WITH RECURSIVE {_STACK_SQL} SELECT scene_id, iid, layer, layer AS stack_level, z, CAST(1 + iid % 3 AS DOUBLE) AS radius FROM top")
def q_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stack(spark, sf_dir).select("scene_id", "iid", "layer", "stack_level", "z", "radius")


@query(f"WITH RECURSIVE {_STACK_SQL} SELECT scene_id, round(max(z + 1.0 + iid % 3) - min(z - 1.0 - iid % 3), 6) AS thickness FROM top GROUP BY scene_id")
def q_film_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.film_thickness(_stack(spark, sf_dir), ["scene_id"]).select("scene_id", _r("thickness"))


@query(f"""
WITH RECURSIVE {T.STEP_SQL}, n AS (SELECT scene, u AS node FROM step UNION SELECT scene, v FROM step), r(scene, a, b) AS (SELECT scene, node, node FROM n UNION SELECT r.scene, r.a, e.v FROM r JOIN step e ON e.scene = r.scene AND e.u = r.b),
c AS (SELECT x.scene, x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.scene = y.scene AND x.a = y.b AND x.b = y.a GROUP BY x.scene, x.a), m AS (SELECT scene, component, row_number() OVER (PARTITION BY scene ORDER BY component) AS cycle FROM c GROUP BY scene, component HAVING count(*) > 1)
SELECT scene, CAST(cycle AS INTEGER) AS cycle, CAST(node AS BIGINT) AS node FROM c JOIN m USING (scene, component)
""")
def q_cycle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.type_steps(spark, sf_dir)
    nodes = e.select("scene", F.col("u").alias("node")).union(e.select("scene", "v")).distinct()
    return graphs.cycle_groups(nodes, e, ["scene"])


#: Hits of a pair in the order of steps: a customer's orders on a line of prices.
_HITS_SQL = "hit AS (SELECT o_custkey AS pair, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, (o_totalprice % 40) AS x, (o_orderkey % 23) * 1.0 AS y FROM orders)"


@query(f"""
WITH RECURSIVE {_HITS_SQL}, m(pair, k, means) AS (
  SELECT DISTINCT pair, CAST(0 AS BIGINT), CAST([] AS STRUCT(sx DOUBLE, sy DOUBLE, n INTEGER)[]) FROM hit
  UNION ALL SELECT pair, k, CASE WHEN hit_at IS NULL OR hit_at = 0 THEN list_append(means, {{'sx': x, 'sy': y, 'n': 1}}) ELSE list_transform(means, lambda v, i: CASE WHEN i = hit_at THEN {{'sx': v.sx + x, 'sy': v.sy + y, 'n': v.n + 1}} ELSE v END) END
  FROM (SELECT m.pair, h.k, means, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, list_position(list_transform(means, lambda v: sqrt(pow(h.x - v.sx / v.n, 2) + pow(h.y - v.sy / v.n, 2)) < 8.0), true) AS hit_at FROM m JOIN hit h ON h.pair = m.pair AND h.k = m.k + 1)
), last AS (SELECT pair, unnest(means) AS v FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY k DESC) AS rn FROM m) WHERE rn = 1)
SELECT pair, round(v.sx / v.n, 5) + 0.0 AS x, round(v.sy / v.n, 5) + 0.0 AS y FROM last
""")
def q_merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair"), F.col("o_orderkey").alias("k"), (F.col("o_totalprice") % 40).alias("x"), (F.col("o_orderkey") % 23 * 1.0).alias("y"))
    return spatial.merged_hits(hits, ["pair"], ["k"], 8.0).select("pair", _r("x", 5), _r("y", 5))


@query("SELECT lang, round(avg(n_chars), 6) + 0.0 AS mean_n_chars, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def q_rollup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.coverage_means(T.table(spark, sf_dir, "documents"), "lang", ["n_chars"]).select("lang", _r("mean_n_chars"), "n")


@query("WITH h AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS refusals FROM h GROUP BY user_id")
def q_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = robust.refusals(T.table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return held.select("user_id", F.array_join(F.transform(F.map_entries("refusals"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("refusals"))


# Files: written into the shared folder and scanned again.


def _folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _png_files(rows: DataFrame, paint, side: int = 499) -> DataFrame:
    """scene_id, content: one PNG a scene; paint(image, part) sets the values of a scene's rows."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((side, side), np.uint8)
        paint(image, part)
        return pd.DataFrame({"scene_id": [f"set/{key[0]}"], "content": [images.encode_png(image)]})

    return rows.groupBy("scene_id").applyInPandas(run, "scene_id string, content binary")


def _paint_mask(image: np.ndarray, part: pd.DataFrame) -> None:
    image[part.r, part.c] = 255


def _paint_grey(image: np.ndarray, part: pd.DataFrame) -> None:
    np.maximum.at(image, (part.r, part.c), part.iid.to_numpy(np.uint8) * 20)


@query(f"WITH {_INST_SQL} SELECT 'set__' || scene_id AS scene_id, r, c FROM inst GROUP BY ALL")
def q_mask_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    files.save_files(_png_files(_inst(spark, sf_dir), _paint_mask), folder, "mask.png")
    return images.read_masks(spark, folder)[1].select("scene_id", "r", "c")


@query(f"""
WITH {_INST_SQL}, v AS (SELECT scene_id, r, c, max(iid) * 20 / 255.0 AS v FROM inst GROUP BY ALL)
SELECT 'set__' || scene_id AS scene_id, 499 AS height, 499 AS width, count(*) AS n, round(sum(v), 3) + 0.0 AS total, round(max(v), 5) + 0.0 AS top FROM v GROUP BY scene_id
""")
def q_grey_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    files.save_files(_png_files(_inst(spark, sf_dir), _paint_grey), folder, "sem.png")
    flat = images.read_greys(spark, folder).select("scene_id", "height", "width", F.explode("grey").alias("v")).filter("v > 0")
    g = flat.groupBy("scene_id", "height", "width").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("double")).alias("total"), F.max("v").cast("double").alias("top"))
    return g.select("scene_id", "height", "width", "n", _r("total", 3), _r("top", 5))


@query(f"WITH {_INST_SQL} SELECT 'set__' || scene_id AS scene_id, iid, r, c FROM inst")
def q_npz_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, inst = _folder(spark), _inst(spark, sf_dir)
    scenes = inst.select("scene_id").distinct().withColumns({"height": F.lit(499), "width": F.lit(499)})
    files.save_npz(encoding.encode(inst, scenes).withColumn("scene_id", F.concat(F.lit("set/"), "scene_id")), folder)
    return files.read_truth(spark, folder, "*.npz")


@query(f"WITH {_INST_SQL} SELECT scene_id, iid, r, c FROM inst")
def q_csr_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = _inst(spark, sf_dir)
    scenes = inst.select("scene_id").distinct().withColumns({"height": F.lit(499), "width": F.lit(499)})
    return encoding.decode(encoding.encode(inst, scenes))


_MESH_SQL = """
vert AS (SELECT l_returnflag AS scene_id, l_linenumber AS iid, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS vid, l_quantity AS x, l_extendedprice / 70 AS y, l_tax AS z FROM lineitem),
size AS (SELECT scene_id, iid, count(*) AS n FROM vert GROUP BY ALL), obj AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY iid) - 1 AS k, CAST(sum(n) OVER (PARTITION BY scene_id ORDER BY iid) - n AS BIGINT) AS base FROM size),
face AS (SELECT scene_id, iid, vid AS v0, vid + 1 AS v1, vid + 2 AS v2, vid + 3 AS v3 FROM vert JOIN size USING (scene_id, iid) WHERE vid + 3 < n)
"""


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    own = Window.partitionBy("l_returnflag", "l_linenumber")
    li = T.table(spark, sf_dir, "lineitem").withColumn("vid", (F.row_number().over(own.orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(own))
    v = li.select(F.col("l_returnflag").alias("scene_id"), F.col("l_linenumber").alias("iid"), "vid", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 70).alias("y"), F.col("l_tax").alias("z"), "n")
    return v.drop("n"), v.filter("vid + 3 < n").select("scene_id", "iid", F.col("vid").alias("v0"), *[(F.col("vid") + k).alias(f"v{k}") for k in (1, 2, 3)])


_XYZ = "printf('%.3f %.3f %.3f', x, y, z)"
_COLOURS = "[" + ", ".join("'" + " ".join(map(str, c)) + "'" for c in files.PALETTE) + "]"


def _read_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", F.input_file_name().alias("path"))
    return lines.select(F.element_at(F.split("path", "/"), -2).alias("scene_id"), F.col("value").alias("line")).groupBy("scene_id", "line").agg(F.count(F.lit(1)).alias("times"))


@query(f"""
WITH {_MESH_SQL}, t AS (SELECT scene_id, {_XYZ} || ' ' || ({_COLOURS})[k % 12 + 1] AS line FROM vert JOIN obj USING (scene_id, iid)
  UNION ALL SELECT scene_id, '4 ' || (v0 + base) || ' ' || (v1 + base) || ' ' || (v2 + base) || ' ' || (v3 + base) FROM face JOIN obj USING (scene_id, iid)
  UNION ALL SELECT scene_id, unnest(['ply', 'format ascii 1.0', 'element vertex ' || n, 'property float x', 'property float y', 'property float z', 'property uchar red', 'property uchar green', 'property uchar blue', 'element face ' || f, 'property list uchar int vertex_indices', 'end_header'])
  FROM (SELECT scene_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(greatest(0, n - 3)) AS BIGINT) AS f FROM size GROUP BY scene_id))
SELECT scene_id, line, count(*) AS times FROM t GROUP BY ALL
""")
def q_ply_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    files.save_ply(*_mesh(spark, sf_dir), folder)
    return _read_lines(spark, folder)


@query(f"""
WITH {_MESH_SQL}, t AS (SELECT scene_id, 'v ' || {_XYZ} AS line FROM vert UNION ALL SELECT scene_id, 'o instance_' || iid FROM obj
  UNION ALL SELECT scene_id, 'f ' || (v0 + base + 1) || ' ' || (v1 + base + 1) || ' ' || (v2 + base + 1) || ' ' || (v3 + base + 1) FROM face JOIN obj USING (scene_id, iid))
SELECT scene_id, line, count(*) AS times FROM t GROUP BY ALL
""")
def q_obj_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    files.save_obj(*_mesh(spark, sf_dir), folder)
    return _read_lines(spark, folder)


@query("SELECT c_custkey, c_nationkey, round(c_acctbal, 2) + 0.0 AS c_acctbal FROM customer")
def q_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    files.write_table(T.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), folder)
    back = spark.read.option("header", "true").schema("c_custkey long, c_nationkey int, c_acctbal double").csv(folder)
    return back.select("c_custkey", "c_nationkey", _r("c_acctbal", 2))


@query(f"WITH {T.TRACK_SQL} SELECT 'set__u' || user_id AS scene_id, CAST(ascii(event_type) AS INTEGER) AS iid, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq) - 1 AS INTEGER) AS seq, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, CAST(4 AS DOUBLE) AS d_mean FROM track")
def q_centreline_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    own = T.tracks(spark, sf_dir).groupBy(F.concat(F.lit("set/u"), F.col("user_id").cast("string")).alias("scene_id"), F.ascii("event_type").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("centerline_xy"))
    scenes = own.groupBy("scene_id").agg(F.collect_list(F.struct("id", "centerline_xy", F.lit(4.0).alias("d_mean"))).alias("instances"))
    files.save_files(scenes.select("scene_id", F.encode(F.to_json(F.struct("instances")), "utf-8").alias("content")), folder, "gt_depth.json")
    return files.read_centrelines(spark, folder).select("scene_id", "iid", "seq", _r("x", 5), _r("y", 5), "d_mean")


@query("""
WITH i AS (SELECT 's' || c_nationkey AS scene_id, count(*) AS instances, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer GROUP BY c_nationkey), x AS (SELECT 's' || s_nationkey AS scene_id, count(*) AS crossings, count(*) FILTER (WHERE s_acctbal > 0) AS known FROM supplier GROUP BY s_nationkey)
SELECT i.scene_id, instances, ids, coalesce(crossings, 0) AS crossings, coalesce(known, 0) AS known FROM i LEFT JOIN x USING (scene_id)
""")
def q_depth_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string")).alias("scene_id")
    inst = T.table(spark, sf_dir, "customer").select(name("c_nationkey"), F.col("c_custkey").alias("iid"), F.col("c_acctbal").alias("z"))
    cross = T.table(spark, sf_dir, "supplier").select(name("s_nationkey"), F.col("s_suppkey").alias("i"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("score"))
    held = files.depth_records(inst, cross).select("scene_id", F.from_json("value", "instances array<struct<iid:long,z:double>>, crossings array<struct<i:long,score:double>>").alias("v"))
    empty = F.coalesce("v.crossings", F.array().cast("array<struct<i:bigint,score:double>>"))
    return held.select("scene_id", F.size("v.instances").cast("long").alias("instances"), F.aggregate("v.instances", F.lit(0).cast("long"), lambda a, x: a + x["iid"]).alias("ids"), F.size(empty).cast("long").alias("crossings"), F.size(F.filter(empty, lambda x: x["score"].isNotNull())).cast("long").alias("known"))


# Rasters: kernels on arrays made of the tables.


def _once(spark: SparkSession, rows: DataFrame, run, schema: str) -> DataFrame:
    """`run` (pandas in, pandas out) on each batch of `rows`."""

    def each(parts):
        for part in parts:
            yield run(part)

    return rows.mapInPandas(each, schema)


@query("""
WITH e AS (SELECT event_id, least(greatest((event_id * 37 % 700) / 10.0 - 2, 0.0), 63.0) AS r, least(greatest((user_id * 53 % 900) / 11.0 - 3, 0.0), 79.0) AS c FROM events)
SELECT event_id, round(3 * r + 2 * c + r * c / 10, 5) + 0.0 AS value FROM e
""")
def q_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 3 r + 2 c + r c / 10, which bilinear interpolation gives exactly, with places held inside the image."""
    from strandel.kernels.raster import sample

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r, c = np.mgrid[0:64, 0:80].astype(float)
        got = sample(3 * r + 2 * c + r * c / 10, part.r.to_numpy(float), part.c.to_numpy(float))
        return pd.DataFrame({"event_id": part.event_id, "value": got})

    e = T.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 700 / 10.0 - 2).alias("r"), (F.col("user_id") * 53 % 900 / 11.0 - 3).alias("c"))
    return _once(spark, e, run, "event_id long, value double").select("event_id", _r("value", 5))


@query("""
WITH m AS (SELECT DISTINCT l_returnflag AS scene, CAST(l_partkey % 60 AS INTEGER) AS r, CAST(l_orderkey % 70 AS INTEGER) AS c FROM lineitem WHERE (l_partkey % 60) * 7 % 11 = 3 AND (l_orderkey % 70) * 5 % 13 = 2), g AS (SELECT scene, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM (SELECT DISTINCT scene FROM m), (SELECT unnest(range(60)) AS r), (SELECT unnest(range(70)) AS c))
SELECT g.scene, g.r, g.c, round(sqrt(min((g.r - m.r) * (g.r - m.r) + (g.c - m.c) * (g.c - m.c))), 6) + 0.0 AS distance FROM g JOIN m USING (scene) GROUP BY ALL
""")
def q_distance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of every place of a 60 x 70 image to its nearest mark."""
    from strandel.kernels.raster import distance

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros((60, 70), bool)
        marks[part.r, part.c] = True
        far, at_r, at_c = distance(marks)
        r, c = np.mgrid[0:60, 0:70]
        assert np.allclose(far, np.hypot(r - at_r, c - at_c)) and marks[at_r, at_c].all()
        return pd.DataFrame({"scene": key[0], "r": r.ravel(), "c": c.ravel(), "distance": far.ravel()})

    r, c = F.col("l_partkey") % 60, F.col("l_orderkey") % 70
    marks = T.table(spark, sf_dir, "lineitem").filter((r * 7 % 11 == 3) & (c * 5 % 13 == 2)).select(F.col("l_returnflag").alias("scene"), r.cast("int").alias("r"), c.cast("int").alias("c")).distinct()
    return marks.groupBy("scene").applyInPandas(run, "scene string, r int, c int, distance double").select("scene", "r", "c", _r("distance"))


# Whole scenes with facts that follow from how they are drawn.


def _bars(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """scene_id, r, c of filled rectangles (scene_id, r0, r1, c0, c1); ends are outside."""
    rects = spark.createDataFrame(rows, "scene_id string, r0 int, r1 int, c0 int, c1 int")
    return rects.select("scene_id", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("r"), "c0", "c1").select("scene_id", "r", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("c")).distinct()


#: One bar; a cross of two; three apart; a bar with a gap that two collinear halves leave; a dash too short to count.
_SCENES = [("bar", 40, 42, 10, 110), ("cross", 68, 70, 10, 130), ("cross", 10, 130, 68, 70), ("three", 20, 22, 10, 120), ("three", 60, 62, 10, 120), ("three", 100, 102, 10, 120), ("gap", 70, 72, 10, 60), ("gap", 70, 72, 72, 130), ("ladder", 30, 32, 10, 130), ("ladder", 90, 92, 10, 130), ("ladder", 5, 125, 66, 68)]


@query("SELECT * FROM (VALUES ('bar', 1), ('cross', 2), ('three', 3), ('gap', 1), ('ladder', 3)) AS t(scene_id, instances)")
def q_group_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandel.plans import group

    px = _bars(spark, _SCENES)
    scenes = px.select("scene_id").distinct().withColumns({"height": F.lit(140), "width": F.lit(140)})
    return group.instances(px, scenes).groupBy("scene_id").agg(F.count_distinct("iid").cast("int").alias("instances"))


@query("SELECT * FROM (VALUES ('bar', 1), ('cross', 4), ('three', 3), ('gap', 2), ('ladder', 7)) AS t(scene_id, arms)")
def q_arms_of_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandel.plans import group

    px = _bars(spark, _SCENES)
    scenes = px.select("scene_id").distinct().withColumns({"height": F.lit(140), "width": F.lit(140)})
    return group.arms(px, scenes).groupBy("scene_id").agg(F.count_distinct("aid").cast("int").alias("arms"))


@query("SELECT scene_id, CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1, CAST(1 AS DOUBLE) AS ari FROM (VALUES ('bar'), ('cross'), ('three'), ('gap'), ('ladder')) AS t(scene_id)")
def q_score_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping found against the drawn bars; a score of one follows where the right pieces are joined."""
    from strandel.plans import group

    px = _bars(spark, _SCENES)
    scenes = px.select("scene_id").distinct().withColumns({"height": F.lit(140), "width": F.lit(140)})
    numbered = [(f"{name}/{1 if name == 'gap' else k}", *rest) for k, (name, *rest) in enumerate(_SCENES, 1)]
    parts = F.split("scene_id", "/")
    truth = _bars(spark, numbered).select(parts[0].alias("scene_id"), parts[1].cast("int").alias("iid"), "r", "c")
    got = group.score(px, scenes, truth, group.instances(px, scenes))
    return got.select("scene_id", *[F.coalesce(F.col(c), F.lit(1.0)).alias(c) for c in ("precision", "recall", "f1", "ari")])


#: Decided pairs (scene, i, j, over, strength) of small scenes whose best order is plain.
_DECIDED = [("chain", 1, 2, 1, 2.2), ("chain", 2, 3, 2, 2.2), ("ring", 1, 2, 1, 2.2), ("ring", 2, 3, 2, 2.2), ("ring", 3, 1, 3, 0.85), ("four", 1, 2, 1, 2.2), ("four", 2, 3, 2, 1.4), ("four", 1, 3, 1, 0.85), ("four", 3, 4, 3, 2.9), *[("long", k, k + 1, k, 2.0) for k in range(1, 20)]]


@query("SELECT * FROM (VALUES ('chain', 1, 0), ('chain', 2, 1), ('chain', 3, 2), ('ring', 1, 0), ('ring', 2, 1), ('ring', 3, 2), ('four', 1, 0), ('four', 2, 1), ('four', 3, 2), ('four', 4, 3)) AS t(scene_id, iid, position) UNION ALL SELECT 'long', CAST(k AS INTEGER), CAST(k - 1 AS INTEGER) FROM (SELECT unnest(range(1, 21)) AS k)")
def q_global_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_DECIDED, "scene_id string, i int, j int, raw_over int, strength double")
    found = rows.select("scene_id", "i", "j", F.when(F.col("raw_over") == F.col("i"), F.col("strength")).otherwise(-F.col("strength")).alias("score"), "raw_over")
    shapes = rows.select("scene_id", F.col("i").alias("iid")).union(rows.select("scene_id", "j")).distinct().withColumn("radius", F.lit(4.0))
    return depth.stacked(found, shapes, DepthRule(undecided_order="global")).select("scene_id", "iid", "position")


#: A ring of three whose weakest decision gives way, over a tail that hangs below it.
@query("SELECT * FROM (VALUES (1, 0), (2, 1), (3, 2), (4, 3), (5, 4)) AS t(iid, position)")
def q_condensed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("s", 1, 2, 1, 2.2), ("s", 2, 3, 2, 2.2), ("s", 3, 1, 3, 0.85), ("s", 3, 4, 3, 0.5), ("s", 4, 5, 4, 3.0)], "scene_id string, i int, j int, raw_over int, strength double")
    found = rows.select("scene_id", "i", "j", F.when(F.col("raw_over") == F.col("i"), F.col("strength")).otherwise(-F.col("strength")).alias("score"), "raw_over")
    shapes = spark.range(1, 6).select(F.lit("s").alias("scene_id"), F.col("id").cast("int").alias("iid"), F.lit(4.0).alias("radius"))
    return depth.stacked(found, shapes, DepthRule(ordering="exact", undecided_order="global")).select("iid", "position")


@query("""
SELECT 'raft' AS scene_id, CAST(k AS INTEGER) AS iid, CAST(k % 2 AS INTEGER) AS stack_level, CAST(6 * (k % 2) AS DOUBLE) AS z FROM (SELECT unnest(range(1, 7)) AS k)
""")
def q_compact_raft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rods, each over or under its neighbour without evidence: two levels are enough, the first rod with two neighbours at the bottom."""
    found = spark.range(1, 6).select(F.lit("raft").alias("scene_id"), F.col("id").cast("int").alias("i"), (F.col("id") + 1).cast("int").alias("j"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("raw_over"))
    shapes = spark.range(1, 7).select(F.lit("raft").alias("scene_id"), F.col("id").cast("int").alias("iid"), F.lit(3.0).alias("radius"))
    return depth.stacked(found, shapes).select("scene_id", "iid", "stack_level", "z")


def _plateau(spark: SparkSession) -> DataFrame:
    """Grey images of 120 x 120: bars of brightness 0.9 and even widths on 0.1."""
    scenes = []
    for width in (6, 9, 12):
        image = np.full((120, 120), 0.1, np.float32)
        image[50 : 50 + width, :] = 0.9
        scenes.append((f"w{width:02}", 120, 120, image.ravel().tolist()))
    return spark.createDataFrame(scenes, "scene_id string, height int, width int, grey array<float>")


@query("SELECT scene_id, CAST(median AS DOUBLE) AS median, quality FROM (VALUES ('w06', 6, 'good'), ('w09', 9, 'good'), ('w12', 12, 'good')) AS t(scene_id, median, quality)")
def q_measured_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _bars(spark, [(f"w{w:02}", 50, 50 + w, 0, 120) for w in (6, 9, 12)])
    got = measure.bundles(measure.cuts(px, _plateau(spark)))
    return got.select("scene_id", F.round("median", 1).alias("median"), "quality")


#: Cuts across a bar of rows 12 to 20 of a 33 x 33 image: in the middle, off it, beyond it, at the edge, and where the background is unsure.
@query("SELECT * FROM (VALUES ('middle', 'ok', CAST(9 AS DOUBLE), CAST(0 AS DOUBLE)), ('dark', 'low_contrast', NULL, NULL), ('edge', 'outside_image', NULL, NULL), ('unsure', 'background_not_confident', NULL, NULL)) AS t(cut, reason, width, shift)")
def q_cut_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandel.kernels.profile import CutRule, measure_all

    def run(part: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((33, 33))
        image[12:21] = 1.0
        got = measure_all(image, np.zeros(len(part)), 0.0, part[["r", "c"]].to_numpy(float), part[["nr", "nc"]].to_numpy(float), CutRule(half_len=12.0, min_reach=5.0), part.sure.to_numpy(bool))
        return pd.DataFrame({"cut": part.cut, "reason": got["reason"], "width": got["width"], "shift": got["offset"]})

    cuts = spark.createDataFrame([("middle", 16.0, 16.0, 1.0, 0.0, True), ("dark", 27.0, 16.0, 0.0, 1.0, True), ("edge", 16.0, 2.0, 0.0, 1.0, True), ("unsure", 16.0, 16.0, 1.0, 0.0, False)], "cut string, r double, c double, nr double, nc double, sure boolean")
    known = lambda c: F.when(~F.isnan(c), F.round(c, 6) + 0.0).alias(c)
    return _once(spark, cuts, run, "cut string, reason string, width double, shift double").select("cut", "reason", known("width"), known("shift"))


#: Where the vertical bar is at 60 and the horizontal one at 60, 0.35 and 0.85 bright: the one drawn last is on top.
@query("SELECT scene_id, 1 AS i, 2 AS j, CAST(59.5 AS DOUBLE) AS x, CAST(59.5 AS DOUBLE) AS y, raw_over FROM (VALUES ('last', 2), ('same', CAST(NULL AS INTEGER))) AS t(scene_id, raw_over)")
def q_crossing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes, lines = [], []
    for name, top in (("last", 0.85), ("same", 0.35)):
        image = np.full((120, 120), 0.1, np.float32)
        image[:, 56:64] = 0.35
        image[56:64, :] = top
        scenes.append((name, 120, 120, image.ravel().tolist()))
        lines += [(name, 1, k, 59.5, float(v)) for k, v in enumerate(range(5, 116, 5))] + [(name, 2, k, float(v), 59.5) for k, v in enumerate(range(5, 116, 5))]
    greys = spark.createDataFrame(scenes, "scene_id string, height int, width int, grey array<float>")
    axes = spark.createDataFrame(lines, "scene_id string, iid int, seq int, x double, y double")
    seen = depth.with_evidence(depth.crossings(axes), axes, greys)
    return seen.select("scene_id", "i", "j", _r("x", 3), _r("y", 3), "raw_over")


#: Rods 1 and 3 lie side by side 9 apart and overlap; rod 2 crosses both.
@query("SELECT 1 AS i, 3 AS j, CAST(9 AS DOUBLE) AS distance, CAST(12 AS DOUBLE) AS required")
def q_grazing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, k, float(x), 100.0) for k, x in enumerate(range(10, 191, 4))] + [(2, k, 100.0, float(y)) for k, y in enumerate(range(10, 191, 4))] + [(3, k, float(x), 109.0) for k, x in enumerate(range(10, 191, 4))]
    lines = spark.createDataFrame([("s", *r) for r in rows], "scene_id string, iid int, seq int, x double, y double")
    crossed = depth.crossings(lines).select("scene_id", "i", "j").distinct()
    radii = lines.select("scene_id", "iid").distinct().withColumn("radius", F.lit(6.0))
    near = spatial.closest_contacts(lines.select("scene_id", "iid", "x", "y"), radii, ["scene_id"], "iid", 6.0, exclude=crossed)
    flat = radii.withColumn("z", F.lit(0.0))
    return spatial.clearance_violations(near.select("scene_id", "i", "j"), flat, ["scene_id"]).join(near, ["scene_id", "i", "j"]).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), _r("distance"), "required")


@query("SELECT CAST(k AS INTEGER) AS scene, CAST(4 * (k + 1) AS BIGINT) AS vertices, CAST(4 * k AS BIGINT) AS faces, CAST(1 AS DOUBLE) AS low, CAST(5 AS DOUBLE) AS high FROM (SELECT unnest(range(1, 9)) AS k)")
def q_tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight tubes of k steps of 2, radius 2 at height 3, with four sides."""
    lines = spark.range(1, 9).select(F.col("id").cast("string").alias("scene_id"), F.lit(1).alias("iid"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"), F.col("id").alias("k")).select("scene_id", "iid", "seq", (F.col("seq") * F.col("k") * 2.0).alias("x"), F.lit(0.0).alias("y"))
    shapes = spark.range(1, 9).select(F.col("id").cast("string").alias("scene_id"), F.lit(1).alias("iid"), F.lit(3.0).alias("z"), F.lit(2.0).alias("radius"))
    v, f = meshes.tubes(lines, shapes, sides=4)
    n = v.groupBy("scene_id").agg(F.count(F.lit(1)).alias("vertices"), F.min("z").alias("low"), F.max("z").alias("high")).join(f.groupBy("scene_id").agg(F.count(F.lit(1)).alias("faces")), "scene_id")
    return n.select(F.col("scene_id").cast("int").alias("scene"), "vertices", "faces", _r("low"), _r("high"))


#: Rods 1 and 3 overlap side by side, rod 2 lies over both: three pairs, one of them without a crossing, all kept apart.
@query("SELECT CAST(3 AS BIGINT) AS n_pairs, CAST(1 AS BIGINT) AS n_abstained, CAST(0 AS BIGINT) AS n_flipped, CAST(0 AS BIGINT) AS n_interpenetrating, CAST(2 AS INTEGER) AS top")
def q_depth_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = np.full((200, 200), 0.1, np.float32)
    image[94:107, :], image[103:116, :], image[:, 94:107] = 0.60, 0.40, 0.95
    greys = spark.createDataFrame([("s", 200, 200, image.ravel().tolist())], "scene_id string, height int, width int, grey array<float>")
    along = range(5, 196, 5)
    rows = [("s", 1, k, float(v), 100.0) for k, v in enumerate(along)] + [("s", 2, k, 100.0, float(v)) for k, v in enumerate(along)] + [("s", 3, k, float(v), 109.0) for k, v in enumerate(along)]
    lines = spark.createDataFrame(rows, "scene_id string, iid int, seq int, x double, y double")
    radii = spark.createDataFrame([("s", k, 6.0) for k in (1, 2, 3)], "scene_id string, iid int, radius double")
    out = depth.run_scenes(lines, greys, DepthRule(clear_grazing_overlaps=True), radii)
    top = out["instances"].groupBy("scene_id").agg(F.max_by("iid", "z").alias("top"))
    return out["report"].join(top, "scene_id").select("n_pairs", "n_abstained", "n_flipped", "n_interpenetrating", "top")
