"""What grows with the product of two tables, or goes one after the other, where the result does not."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from strandel.operators import encoding, frames, sequence, spatial
from strandel.plans.queries import GAP, QUERIES, _near
from strandel.sources import files


def nodes_of(frame):
    """Every node of the plan that a frame ran by, with its simple class name; runs it first."""
    frame.collect()
    todo, found = [frame._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            found.append((name, p))
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def most_joined(frame):
    """The most rows that a join of the frame's plan gives."""
    rows = [p.metrics().get("numOutputRows") for name, p in nodes_of(frame) if "Join" in name]
    return max((m.get().value() for m in rows if m.isDefined()), default=0)


def test_arms_of_a_chain_at_one_crossing_bring_its_pixels_once(spark):
    arms = spark.range(200).select(F.lit("s").alias("scene_id"), F.lit(1).alias("iid"), F.col("id").alias("aid"))
    pixels = spark.range(300).select(F.lit("s").alias("scene_id"), F.lit(7).alias("nid"), F.col("id").alias("r"), F.lit(0).cast("long").alias("c"))
    arm_pixels = arms.select("scene_id", "aid", (1000 + F.col("aid")).alias("r"), F.lit(0).cast("long").alias("c"))
    out = encoding.layers(arm_pixels, pixels, arms.select("scene_id", "iid", "aid"), arms.select("scene_id", F.lit(7).alias("nid"), "aid"))
    assert most_joined(out) <= 1_000  # 60,000 with the pixels once an arm
    assert {(x.iid, x.r) for x in out.collect()} == {(1, r) for r in [*range(300), *range(1000, 1200)]} and out.count() == 500


def test_resampling_is_never_joined_to_itself(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 3.0, 4.0), (None, 0, 0.0, 0.0), (None, 1, 9.0, 0.0)], "t long, seq int, x double, y double")
    out = sequence.resample(points, ["t"], 1.5)
    assert not [name for name, _ in nodes_of(out) if "Join" in name]
    rows = {r.seq: r for r in out.collect()}
    assert sorted(rows) == list(range(8)) and (rows[3].x, rows[3].y, rows[7].x, rows[7].y) == (3.0, 0.0, 3.0, 4.0)
    assert all(abs(r.nx**2 + r.ny**2 - 1) < 1e-9 and r.t == 1 for r in rows.values()) and abs(rows[0].ny - 1) < 0.1 and abs(rows[7].nx + 1) < 0.1


def test_files_are_written_beside_one_another(spark, tmp_path, monkeypatch):
    meets = threading.Barrier(4)
    submit = files.ThreadPoolExecutor.submit

    def beside(pool, call, row):
        def run():
            meets.wait(20)  # passes once four are under way
            return call(row)

        return submit(pool, run)

    monkeypatch.setattr(files.ThreadPoolExecutor, "submit", beside)
    rows = [(f"a/s{k}", bytearray(f"{k}".encode())) for k in range(8)]
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.files.link./out", f"file://{tmp_path}")
    files.save_files(spark.createDataFrame(rows, "scene_id string, content binary"), "viewfs://files/out", "x.bin")
    assert {p.parent.name: p.read_text() for p in tmp_path.rglob("x.bin")} == {f"s{k}": str(k) for k in range(8)}


def test_tasks_write_into_a_mounted_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ThreadPoolExecutor", None)  # the driver writes nothing
    for text in ("first", "second, longer"):
        rows = spark.createDataFrame([(f"a/s{k}", bytearray(f"{text} {k}".encode())) for k in range(8)], "scene_id string, content binary")
        files.save_files(rows, f"file://{tmp_path}", "x.bin")
        assert {p.parent.name: p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {f"s{k}": f"{text} {k}" for k in range(8)}


def test_a_file_that_fails_is_raised(spark, tmp_path):
    (tmp_path / "bad").write_text("no folder")
    rows = spark.createDataFrame([("ok", bytearray(b"1")), ("bad", bytearray(b"2"))], "scene_id string, content binary")
    with pytest.raises(Exception, match="bad"):
        files.save_files(rows, str(tmp_path), "x.bin")


def test_centrelines_are_read_without_a_pass_for_their_schema(spark, tmp_path):
    for name, text in (("u1", '{"instances": [{"id": 3, "centerline_xy": [[1, 2.5], [2, 3]], "d_mean": 4.0}]}'), ("u2", '{"instances": [{"id": "4", "centerline_xy": [["1e1", 0.1]]}]}'), ("u3", '{"instances": []}')):
        (tmp_path / "set" / name).mkdir(parents=True)
        (tmp_path / "set" / name / "gt_depth.json").write_text(text)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = files.read_centrelines(spark, str(tmp_path))
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == set(before)
    assert sorted(tuple(r) for r in out.collect()) == [("set__u1", 3, 0, 1.0, 2.5, 4.0), ("set__u1", 3, 1, 2.0, 3.0, 4.0), ("set__u2", 4, 0, 10.0, 0.1, None)]


def test_excluded_contacts_need_no_table_of_all_pairs(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("event_id"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), (F.floor(F.col("id") / 2) * 100.0).alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["q_contacts"](spark, str(tmp_path))
    assert most_joined(out) <= 1_000  # 6,407 excluded pairs
    assert sorted((r.i, r.j) for r in out.collect()) == [(i, i + 1) for i in range(0, 300, 2) if (2 * i + 1) % 7]


def test_contacts_leave_out_a_table_or_a_condition(spark):
    points = spark.createDataFrame([("s", k, float(k), 0.0) for k in range(6)], "scene string, iid long, x double, y double")
    radii = points.select("scene", "iid", F.lit(0.8).alias("radius"))
    known = spark.createDataFrame([("s", 1, 2), ("s", 4, 5)], "scene string, i long, j long")
    found = [{(r.i, r.j) for r in spatial.closest_contacts(points, radii, ["scene"], "iid", 0.8, exclude=x).collect()} for x in (known, F.col("i").isin(1, 4), F.lit(None).cast("boolean"))]
    assert found == [{(0, 1), (2, 3), (3, 4)}] * 2 + [{(k, k + 1) for k in range(5)}]


def test_near_pairs_of_short_tracks_are_not_shuffled(spark):
    points = spark.range(400).select(F.lit("s").alias("scene"), (F.col("id") % 300).alias("iid"), (F.col("id") % 7 / 10).alias("x"), (F.col("id") % 11 / 10).alias("y"))
    out = spatial.closest_contacts(points, points.select("scene", "iid", F.lit(4.0).alias("radius")).distinct(), ["scene"], "iid", 4.0)
    shuffled = [p.metrics().apply("shuffleRecordsWritten").value() for name, p in nodes_of(out) if name == "ShuffleExchangeExec"]
    assert shuffled and max(shuffled) <= 5_000 and out.count() == 300 * 299 // 2  # 44,850 pairs were shuffled


def test_closest_contacts_of_tracks_of_any_size(spark):
    rng = random.Random(8)
    spot = lambda: (rng.uniform(-9, 9), rng.uniform(-9, 9)) if rng.random() < 0.5 else (rng.randrange(-9, 10) * 1.0, rng.randrange(-9, 10) * 1.0)
    tracks = {t: [spot() for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 5, 9]))] for t in range(90)}
    tracks |= {90 + t: [*tracks[t]] * (1 + t % 2) for t in range(20)}  # equal tracks, and points that a track has twice
    tracks |= {110: [(0.0, 0.0), (2.0**-60, 0.0)], 111: [(-2.0, 0.0), (2.0, 0.0), (-2.0, 2.0**-60)], 112: [(3.0, math.nan), (-0.0, 1.0)]}
    radius = {t: (1.0, 0.5, None, 0.25)[t % 4] for t in tracks if t % 5}  # others have the default, above the widest
    points = [("s", t, *p) for t, ps in tracks.items() for p in ps] + [("s", None, 0.0, 0.0), ("s", 1, None, 0.0), (None, 2, 0.0, 0.0)]
    rng.shuffle(points)
    want = set()
    for i, j in ((i, j) for i in tracks for j in tracks if i < j and (i + j) % 7):
        need = sum(radius.get(t) or 1.5 for t in (i, j)) + 0.5
        near = [(d, (p[0] + q[0]) / 2 + 0.0, (p[1] + q[1]) / 2 + 0.0) for p in tracks[i] for q in tracks[j] if (d := math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)) < need and d <= 2.5]
        want |= {(i, j, *min(near))} if near else set()
    radii = spark.createDataFrame([("s", t, r) for t, r in radius.items()], "scene string, iid long, radius double")
    out = spatial.closest_contacts(spark.createDataFrame(points, "scene string, iid long, x double, y double"), radii, ["scene"], "iid", 1.0, 0.5, 1.5, (F.col("i") + F.col("j")) % 7 == 0)
    rows = [(r.i, r.j, r.distance, r.x + 0.0, r.y + 0.0) for r in out.collect()]
    assert len(rows) == len(want) > 500 and set(rows) == want


def steps_of(spark, lines):
    return spark.createDataFrame([("s", t, 0, *map(float, line)) for t, line in enumerate(lines)], "scene string, iid long, k int, x0 double, y0 double, x1 double, y1 double")


def test_crossings_are_found_once_without_a_shuffle_of_them(spark):
    rng = random.Random(5)
    lines = [[rng.uniform(-40, 40) for _ in range(4)] for _ in range(60)] + [[rng.randrange(-3, 4) * 4 for _ in range(4)] for _ in range(60)]  # corners of cells too
    lines += [[-30, 4 * k + d, 30, 4 * k - d] for k in range(-2, 3) for d in (1e-9, 1e-5, 0.1, 3.9)] + [[8, -20, 8, 20], [8 - 1e-9, -20, 8 + 1e-9, 20], [8, -4, 8, 4]]
    want = set()
    for i, (ax0, ay0, ax1, ay1) in enumerate(lines):
        for j, (bx0, by0, bx1, by1) in enumerate(lines[i + 1 :], i + 1):
            rx, ry, sx, sy, qx, qy = ax1 - ax0, ay1 - ay0, bx1 - bx0, by1 - by0, bx0 - ax0, by0 - ay0
            if abs(det := rx * sy - ry * sx) >= 1e-12 and 0 <= (t := (qx * sy - qy * sx) / det) <= 1 and 0 <= (qx * ry - qy * rx) / det <= 1:
                want.add((i, j, ax0 + t * rx, ay0 + t * ry))
    out = spatial.crossing_segments(steps_of(spark, lines), ["scene"], "iid", 4.0)
    rows = [(r.i, r.j, r.x, r.y) for r in out.collect()]
    assert len(rows) == len(want) > 500 and set(rows) == want
    todo, above = [out._jdf.queryExecution().optimizedPlan()], []
    while todo and (p := todo.pop()).nodeName() != "Join":
        above.append(p.nodeName())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    assert "Aggregate" not in above  # which had all crossings shuffled, several times each


def test_arithmetic_rounding_is_that_of_sql(spark):
    values = [0.0, -0.0, -1e-9, 0.49999999999999994e-3, 0.0005, 0.0015, -0.0015, 2.5, -2.5, 1.0005, 123456.7895, 1e15 + 0.5, 1e300, -1e300, math.inf, math.nan, None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", _near("v", 3)).collect()
    got = {r.k: r.v for r in rows}
    duckdb = pytest.importorskip("duckdb")
    for k, v in enumerate(values):
        want = duckdb.execute("SELECT round(?::DOUBLE, 3) + 0.0", [v]).fetchone()[0]
        assert got[k] == want or v is not None and math.isnan(v) and math.isnan(got[k]), (v, got[k], want)
        assert want is None or want != 0 or math.copysign(1, got[k]) == 1


ENDS = "scene string, sid long, aid long, node int, tip_x double, tip_y double, tan_x double, tan_y double, kappa double, reliable boolean"


def in_a_row(spark):
    return spark.createDataFrame([("s", k, k, None, 9.0 * k, 0.0, 1.0 if k % 2 == 0 else -1.0, 0.0, 0.0, True) for k in range(6)], ENDS)


def test_angles_of_a_gap_are_computed_once(spark):
    out = frames.gap_pairs(in_a_row(spark), ["scene"], 30.0, 2.4, 2.28, **GAP)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ACOS") == 3  # one each of theta, phi_a and phi_b
    assert {(r.sid_a, r.sid_b) for r in out.collect()} == {(0, 1), (0, 3), (2, 3), (2, 5), (4, 5)}


def test_partners_join_frames_once(spark):
    pairs = frames.gap_pairs(in_a_row(spark), ["scene"], 30.0, 2.4, 2.28, **GAP)
    out = frames.cheapest_partner(pairs, ["scene"])
    assert sum("Join" in name for name, _ in nodes_of(out)) == 1
    held = [(r.sid_a, r.sid_b, r.cost) for r in pairs.collect()]
    assert held and {r.sid: r.cost for r in out.collect()} == {s: min(c for a, b, c in held if s in (a, b)) for s in {x for a, b, _ in held for x in (a, b)}}


def test_a_large_node_is_dealt_into_blocks(spark):
    rng = random.Random(3)
    rows = [("s", k, rng.randrange(8), rng.choice([1, 1, 1, 2, None])) for k in rng.sample(range(100), 40)] + [("t", k, k, 1) for k in range(3)]
    out = frames.within_node_pairs(spark.createDataFrame(rows, "scene string, sid long, aid long, node int"), ["scene"], block=5)
    assert out.columns == ["scene", "node", "sid_a", "aid_a", "sid_b", "aid_b"]
    want = [(p[0], p[3], p[1], p[2], q[1], q[2]) for p in rows for q in rows if p[0] == q[0] and p[3] is not None and p[3] == q[3] and p[1] < q[1] and p[2] != q[2]]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    join = next(p for name, p in nodes_of(out) if "Join" in name)
    assert join.leftKeys().size() == 4  # scene, node and the two blocks


def test_arc_cosines_by_arithmetic(spark):
    rng = random.Random(4)
    values = [1.0, -1.0, 0.0, -0.0, 0.5, -0.5, *(s * (1 - 2.0**-k) for k in range(1, 54) for s in (1, -1)), *(rng.uniform(-1, 1) for _ in range(2000)), None]
    rows = frames.arc_cosines(spark.createDataFrame([(v,) for v in values], "v double"), {"v": "a"})
    assert rows.columns == ["v", "a"]
    for r in rows.collect():
        assert r.a is None if r.v is None else abs(r.a - math.acos(r.v)) <= 4 * math.ulp(math.acos(r.v))


def test_costs_of_very_many_pairs_are_the_same(spark, tmp_path):
    rng = random.Random(6)
    end = lambda: (rng.uniform(-9, 9), rng.uniform(-9, 9), *(lambda w: (math.cos(w), math.sin(w)))(rng.uniform(-4, 4)), rng.uniform(-1, 1))
    rows = [(*end(), *end()) for _ in range(500)] + [(1.0, 2.0, *t, 0.1, 1.0, 2.0, *u, 0.2) for t in ((1.0, 0.0), (0.0, 0.0), (None, None)) for u in ((1.0, 0.0), (-1.0, 0.0), (0.0, 1.0))]
    pairs = spark.createDataFrame(rows, ", ".join(f"{c}_{t} double" for t in "ab" for c in ("tip_x", "tip_y", "tan_x", "tan_y", "kappa")))
    names = ["length", "theta", "phi_a", "phi_b", "cost"]
    one, many = (frames.costed(pairs, many=m, **GAP).select(*names).collect() for m in (False, True))
    assert all(x is y is None or abs(x - y) < 1e-7 for r, s in zip(one, many, strict=True) for x, y in zip(r, s, strict=True))
    assert sum(r.cost is None for r in many) == 6
    events = [(k, k // 2, "view", 3.0 * (k % 5), 60 * k) for k in range(12)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, t long").selectExpr("*", "cast(1704100000 + t as timestamp) AS ts").drop("t").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["q_link_cost"](spark, str(tmp_path))
    assert out.count() == 15 and "ACOS" not in out._jdf.queryExecution().optimizedPlan().toString()  # a call of native code a row
