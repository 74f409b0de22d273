import math

import numpy as np
import pytest
from test_scenes import SCENE, lines_of, pixels_of

from strandel.config import DepthRule, GroupRule, JointRule, RibbonRule
from strandel.functions.register import register
from strandel.operators import encoding
from strandel.plans import depth, group, joint, ribbon


@pytest.fixture(scope="module")
def scene(spark):
    mask = np.zeros((120, 120), bool)
    mask[:, 56:64] = mask[56:64, :] = True
    image = np.full((120, 120), 0.1, np.float32)
    image[:, 56:64] = 0.45
    image[56:64, :] = 0.9
    return pixels_of(spark, {"s": mask}), spark.createDataFrame([("s", 120, 120)], SCENE), spark.createDataFrame([("s", 120, 120, image.ravel().tolist())], SCENE + ", grey array<float>")


def key(df):
    return sorted(map(tuple, df.select("iid", "r", "c").collect()))


def test_joint_without_weight_is_the_core(spark, scene):
    px, scenes, grey = scene
    core = key(group.instances(px, scenes))
    assert key(joint.joint_instances(px, grey, GroupRule(), JointRule(lambda_appearance=0.0))) == core
    assert key(joint.joint_instances(px, grey)) == core
    costs, prices = {(0, 1): 0.1, (2, 3): 0.1, (0, 2): 0.3, (1, 3): 0.3}, dict.fromkeys(range(4), 0.6)
    assert joint.margins([0, 1, 2, 3], [(0, 1), (2, 3)], costs, prices)[0, 1] == pytest.approx(0.4)
    assert joint.difference((0.5, 0.1), (0.5, 0.1), 0.02) == 0 and joint.difference(None, (0.5, 0.1), 0.02) is None


def test_ribbons(spark, scene):
    px, scenes, _ = scene
    widths = spark.createDataFrame([("s", 1, 8.0, [10.0, 30.0, 50.0, 90.0], [4.0, 8.0, 12.0, 12.0]), ("s", 2, None, None, None)], "scene_id string, iid int, width double, cut_s array<double>, cut_width array<double>")
    wide = {r.iid: r["count"] for r in ribbon.ribbons(px, scenes, widths).groupBy("iid").count().collect()}
    assert all(700 < n < 1150 for n in wide.values()) and len(wide) == 2
    tapered = {r.iid: r["count"] for r in ribbon.ribbons(px, scenes, widths, ribbon=RibbonRule(taper=True, taper_smooth_px=1)).groupBy("iid").count().collect()}
    assert tapered[1] != wide[1] and tapered[2] == wide[2]
    a = np.zeros((20, 20), bool)
    a[5:15, 5:15] = True
    b = a.copy()
    b[:10] = False
    kept, log = ribbon.absorb({1: b, 2: a}, 0.8, 40)
    assert list(kept) == [2] and log == [(1, 2, 1.0)]


def test_whole_depth_run(spark, scene):
    _, _, grey = scene
    lines = lines_of(spark, {1: [(59.5, v) for v in range(5, 116, 5)], 2: [(v, 59.5) for v in range(5, 116, 5)]})
    out = depth.run_scenes(lines, grey)
    row = out["crossings"].first()
    assert out["crossings"].count() == 1 and row.over == 2 and not row.flipped
    z = {r.iid: r for r in out["instances"].collect()}
    assert z[1].radius == pytest.approx(4.0, abs=0.2) and z[2].z == pytest.approx(z[1].radius + z[2].radius) and out["violations"].count() == 0
    assert out["report"].first().n_abstained == 0


def test_grazing_pairs_are_cleared_only_when_asked(spark):
    image = np.full((200, 200), 0.1, np.float32)
    for y, v in ((100, 0.6), (109, 0.4)):
        image[y - 6 : y + 7, :] = np.maximum(image[y - 6 : y + 7, :], v)
    grey = spark.createDataFrame([("s", 200, 200, image.ravel().tolist())], SCENE + ", grey array<float>")
    lines = lines_of(spark, {1: [(x, 100.0) for x in range(5, 196, 5)], 3: [(x, 109.0) for x in range(5, 196, 5)]})
    radii = spark.createDataFrame([("s", 1, 6.0), ("s", 3, 6.0)], "scene_id string, iid int, radius double")
    assert depth.run_scenes(lines, grey, DepthRule(), radii)["violations"].count() == 1
    assert depth.run_scenes(lines, grey, DepthRule(clear_grazing_overlaps=True), radii)["violations"].count() == 0


def test_sql_functions(spark, scene):
    register(spark)
    row = spark.sql("select floored_feature(0.52, 0.50, 0.52, 0.08) a, abstain_threshold(0.15) b, clipped_angle(1, 0, 0, 1) c").first()
    assert row.a == pytest.approx(-0.125) and row.b == pytest.approx(math.log(0.65 / 0.35)) and row.c == pytest.approx(math.pi / 2)
    px, scenes, _ = scene
    packed = encoding.encode(group.instances(px, scenes), scenes)
    packed.createOrReplaceTempView("packed")
    assert spark.sql("select d.* from packed p, lateral decode_instances(p.shape, p.ids, p.indptr, p.indices) d").count() == encoding.decode(packed).count()


def test_command_line_tiles_and_reports(spark, tmp_path):
    from strandel import cli
    from strandel.plans import measure, report, tune
    from strandel.sources import files, images

    mask = np.zeros((120, 120), np.uint8)
    mask[:, 26:34] = mask[:, 86:94] = mask[56:64, :] = 255
    at = tmp_path / "in" / "one" / "v"
    at.mkdir(parents=True)
    (at / "mask.png").write_bytes(images.encode_png(mask))
    (at / "sem.png").write_bytes(images.encode_png((mask // 2 + 20).astype(np.uint8)))
    scenes, px = images.read_masks(spark, str(tmp_path / "in"))
    truth = group.instances(px, scenes)
    (at / "gt_multilabel.npz").write_bytes(next(r.content for r in files.write_npz(encoding.encode(truth, scenes)).collect()))
    tiles, cut_scenes, cut_truth = tune.tile_scenes(px, scenes, truth)
    assert cut_scenes.count() == 2 and {(r.height, r.width) for r in cut_scenes.collect()} == {(60, 60)}
    assert 0 < tiles.count() < px.count() and cut_truth.agg({"r": "max"}).first()[0] < 60  # the bar's axis lies in the upper tiles
    assert tune.tile_scenes(px, scenes, truth, least_px=10**6)[1].count() == 0
    for stage in ("group", "joint", "measure", "depth"):
        assert cli.main([stage, "--scenes", str(tmp_path / "in"), "--out", str(tmp_path / stage), *(["--tubes"] if stage == "depth" else [])]) == 0
    assert spark.read.parquet(str(tmp_path / "depth" / "faces")).count() > 0
    assert cli.main(["tune", "--scenes", str(tmp_path / "in"), "--out", str(tmp_path / "t.yaml"), "--budget", "6"]) in (0, 1)
    with pytest.raises(SystemExit):
        cli.main(["group", "--scenes", "x", "--out", "y", "--set", "no_such=1"])
    b = measure.bundles(measure.cuts(px, images.read_greys(spark, str(tmp_path / "in"))))
    assert report.overlay_table(b, 1).filter("labelled").count() == 1 and report.width_table(b).count() == 3
    assert report.quality_counts(b).filter("scene_id is null").first().good == 3


def test_trials_are_scored_as_scores_are(spark):
    from strandel.operators.agreement import assign_fragments
    from strandel.plans import tune

    pieces = {1: {(0, c) for c in range(20)}, 2: {(9, c) for c in range(20)}, 3: {(30, c) for c in range(20)}, 4: {(40, c) for c in range(20)}, 5: {(60, c) for c in range(20)}}
    layers = {1: {(r, 3) for r in range(-1, 2)} | {(25, c) for c in range(20)}, 2: {(9, c) for c in range(6)} | {(15, c) for c in range(20)}, 3: {(40, c) for c in range(3)}, 4: {(46, c) for c in range(10)} | {(67, 0)}}
    rows = lambda of: [("s", k, r, c) for k, px in of.items() for r, c in sorted(px)]
    want = assign_fragments(spark.createDataFrame(rows(pieces), "scene_id string, frag_id int, r int, c int"), spark.createDataFrame(rows(layers), "scene_id string, iid int, r int, c int"))
    assert tune.assigned(pieces, layers) == {r.frag_id: r.iid for r in want.collect()}
    assert tune.assigned(pieces, layers)[3] == 1 and tune.assigned(pieces, layers)[5] == 0 and tune.assigned(pieces, {}) == dict.fromkeys(pieces, 0)
    counts = spark.createDataFrame([(0, "a", 9.0, 0.0, 0.0, False), (0, "b", 0.0, 0.0, 0.0, True), (1, "a", 4.0, 1.0, 1.0, False)], "trial int, scene_id string, tp double, fp double, fn double, failed boolean")
    assert {r.trial: r.f1 for r in tune.trial_f1(counts).collect()} == {0: 0.0, 1: 0.8}

