import numpy as np
import pytest

from strandel.config import DepthRule
from strandel.operators import encoding, meshes, spatial
from strandel.plans import depth, group, measure
from strandel.sources import files, images

SCENE = "scene_id string, height int, width int"


def pixels_of(spark, masks):
    return spark.createDataFrame([(s, int(r), int(c)) for s, m in masks.items() for r, c in zip(*np.nonzero(m), strict=True)], "scene_id string, r int, c int")


@pytest.fixture(scope="module")
def cross():
    a, b = np.zeros((140, 140), bool), np.zeros((140, 140), bool)
    a[68:70, 10:130] = True
    b[10:130, 68:70] = True
    return a, b


def test_scores_of_perfect_merged_and_split(spark, cross):
    a, b = cross
    px, scenes = pixels_of(spark, {"s": a | b}), spark.createDataFrame([("s", 140, 140)], SCENE)
    rows = lambda parts: spark.createDataFrame([("s", i, int(r), int(c)) for i, m in parts for r, c in zip(*np.nonzero(m), strict=True)], "scene_id string, iid int, r int, c int")
    truth = rows([(1, a), (2, b)])
    same = group.score(px, scenes, truth, group.instances(px, scenes)).first()
    assert (same.precision, same.recall, same.f1, same.ari) == (1.0, 1.0, 1.0, 1.0)
    merged = group.score(px, scenes, truth, rows([(1, a | b)])).first()
    assert merged.recall == 1 and merged.precision < 1 and merged.fp > 0 and merged.fn == 0
    left, right = a.copy(), a.copy()
    left[:, 70:] = False
    right[:, :70] = False
    split = group.score(px, scenes, truth, rows([(1, left), (3, right), (2, b)])).first()
    assert split.precision == 1 and split.recall < 1 and split.fn > 0 and split.fp == 0


def test_encoding_round_trip_and_npz(spark, cross, tmp_path):
    a, b = cross
    px, scenes = pixels_of(spark, {"s": a | b}), spark.createDataFrame([("s", 140, 140)], SCENE)
    own = group.instances(px, scenes)
    packed = encoding.encode(own, scenes)
    key = lambda df: sorted(map(tuple, df.select("iid", "r", "c").collect()))
    assert key(encoding.decode(packed)) == key(own)
    files.save_npz(packed, str(tmp_path / "p" / "q"))
    assert key(files.read_truth(spark, str(tmp_path), "*.npz")) == key(own)


def test_png_reads_back_and_masks_are_scanned(spark, tmp_path):
    rng = np.random.default_rng(0)
    for shape in ((7, 5), (6, 9, 3)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (images.decode_png(images.encode_png(image)).squeeze() == image).all()
    half = np.zeros((8, 8), np.uint8)
    half[:, 4:] = 255
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "mask.png").write_bytes(images.encode_png(half))
    scenes, px = images.read_masks(spark, str(tmp_path))
    assert scenes.first().scene_id == "x__y" and px.count() == 32
    grey = images.as_grey(images.decode_png(images.encode_png(half)))
    assert grey.dtype == np.float32 and grey.min() == 0 and grey.max() == 1


def lines_of(spark, lines):
    return spark.createDataFrame([("s", i, k, float(x), float(y)) for i, p in lines.items() for k, (x, y) in enumerate(p)], "scene_id string, iid int, seq int, x double, y double")


@pytest.mark.parametrize(("top", "over"), [(0.85, 2), (0.35, None)])
def test_crossing_evidence(spark, top, over):
    image = np.full((120, 120), 0.1, np.float32)
    image[:, 56:64] = 0.35
    image[56:64, :] = top
    lines = lines_of(spark, {1: [(59.5, v) for v in range(5, 116, 5)], 2: [(v, 59.5) for v in range(5, 116, 5)]})
    found = depth.crossings(lines)
    hit = found.first()
    assert found.count() == 1 and abs(hit.x - 59.5) < 1 and abs(hit.y - 59.5) < 1
    grey = spark.createDataFrame([("s", 120, 120, image.ravel().tolist())], SCENE + ", grey array<float>")
    assert depth.with_evidence(found, lines, grey).first().raw_over == over
    assert depth.with_evidence(found, lines, grey, DepthRule(use_image_evidence=False)).first().reason == 2


def shaded(spark):
    """Rod 2 lies over rod 1, whose brightness rises along it."""
    image = np.full((240, 240), 0.1, np.float32)
    image[:, 112:128] = np.linspace(0.2, 0.5, 240, dtype=np.float32)[:, None]
    image[114:126, :] = (0.6 + 0.4 * np.linspace(0, 1, 240, dtype=np.float32) ** 2)[None, :]
    image[126:130, :] = 0.3
    lines = lines_of(spark, {1: [(119.5, v) for v in range(5, 236, 5)], 2: [(v, 119.5) for v in range(5, 236, 5)]})
    return lines, spark.createDataFrame([("s", 240, 240, image.ravel().tolist())], SCENE + ", grey array<float>"), image


def test_radii_matter_to_the_scaled_core_and_edges_to_the_older_rules(spark):
    from strandel.kernels.raster import gradient

    lines, grey, image = shaded(spark)
    found = depth.crossings(lines)
    sized = lambda r: spark.createDataFrame([("s", 1, r), ("s", 2, r)], "scene_id string, iid int, radius double")
    seen = lambda r, **k: depth.with_evidence(found, lines, grey, DepthRule(**k), sized(r)).first()
    assert seen(4.0).score == seen(20.0).score and seen(4.0).feat_sharpness is None and seen(4.0).raw_over == 2
    assert seen(4.0, core_mode="radius_scaled").score != seen(30.0, core_mode="radius_scaled").score
    assert seen(4.0, scoring="winsorized_linear").feat_sharpness != seen(8.0, scoring="winsorized_linear").feat_sharpness
    a, b = np.array([(119.5, v) for v in np.arange(5, 236, 2.0)]), np.array([(v, 119.5) for v in np.arange(5, 236, 2.0)])
    for rule in ("winsorized_linear", "weight_of_evidence"):
        one, other = (depth.evidence_of(image, x, y, (119.5, 119.5), DepthRule(scoring=rule), (7.0, 7.0), gradient(image)) for x, y in ((a, b), (b, a)))
        assert one["feat_sharpness"] == pytest.approx(-other["feat_sharpness"]) != 0 and one["score"] == pytest.approx(-other["score"]) and one["score"] < 0
        with pytest.raises(ValueError, match="gradient"):
            depth.evidence_of(image, a, b, (119.5, 119.5), DepthRule(scoring=rule))


def test_stack_of_a_chain_and_mesh(spark, tmp_path):
    found = spark.createDataFrame([("s", 1, 2, 2.2, 1), ("s", 2, 3, 2.2, 2)], "scene_id string, i int, j int, score double, raw_over int")
    shapes = spark.createDataFrame([("s", 1, 4.0), ("s", 2, 3.0), ("s", 3, 5.0)], "scene_id string, iid int, radius double")
    rows = {r.iid: r for r in depth.stacked(found, shapes).collect()}
    assert [rows[k].layer for k in (3, 2, 1)] == [0, 1, 2] and rows[3].z == 0 and rows[2].z == 8 and rows[1].z == 15
    line = lines_of(spark, {1: [(x, 0.0) for x in range(0, 41, 10)]})
    v, f = meshes.tubes(line, spark.createDataFrame([("s", 1, 3.0, 2.0)], "scene_id string, iid int, z double, radius double"), sides=4)
    z = [r.z for r in v.collect()]
    assert min(z) == pytest.approx(1) and max(z) == pytest.approx(5) and f.count() == v.count() - 4
    files.save_ply(v, f, str(tmp_path / "out"))
    files.save_obj(v, f, str(tmp_path / "out"))
    ply, obj = ((tmp_path / "out" / "s" / n).read_text().splitlines() for n in ("mesh.ply", "mesh.obj"))
    n = v.count()
    assert ply[:4] == ["ply", "format ascii 1.0", f"element vertex {n}", "property float x"] and ply[9] == f"element face {n - 4}" and len(ply) == 12 + n + n - 4
    assert ply[11] == "end_header" and ply[12].endswith("230 25 75") and ply[12 + n] == "4 0 1 5 4" and obj[0] == "o instance_1" and obj[1 + n] == "f 1 2 6 5" and len(obj) == 1 + 2 * n - 4


def test_decisions_are_applied_anew(spark):
    rows = [(1, 2, 0.5, None, 9, True), (3, 4, None, 0.9, 9, True), (5, 6, -3.0, 0.1, 9, True), (7, 8, None, None, 9, True), (9, 10, float("nan"), 0.2, 9, True)]
    found = spark.createDataFrame(rows, "i int, j int, score double, p_over double, over int, flipped boolean")
    get = lambda **k: {r.i: (r.raw_over, r.over, r.flipped) for r in depth.abstain_again(found, **k).collect()}
    none = (None, False)
    assert get(rule=DepthRule()) == {1: (1, *none), 3: (3, *none), 5: (6, *none), 7: (None, *none), 9: (10, *none)}
    assert get(band=0.15) == {1: (None, *none), 3: (3, *none), 5: (6, *none), 7: (None, *none), 9: (10, *none)}
    for wrong in ({}, {"band": 0.15, "rule": DepthRule()}):
        with pytest.raises(TypeError):
            depth.abstain_again(found, **wrong)


def test_published_parameters_are_checked():
    from strandel.config import GroupRule, check_published

    check_published()
    with pytest.raises(AssertionError, match="spur_px"):
        check_published(GroupRule(spur_px=2))


def test_contacts_and_clearance(spark):
    lines = lines_of(spark, {1: [(x, 100.0) for x in range(0, 200, 4)], 3: [(x, 109.0) for x in range(0, 200, 4)], 9: [(x, 160.0) for x in range(0, 200, 4)]})
    radii = lines.selectExpr("scene_id", "iid", "6.0 as radius").distinct()
    near = spatial.closest_contacts(lines.select("scene_id", "iid", "x", "y"), radii, ["scene_id"], "iid", 6.0).collect()
    assert [(r.i, r.j, r.distance) for r in near] == [(1, 3, 9.0)]
    flat = spark.createDataFrame([("s", 1, 0.0, 6.0), ("s", 3, 0.0, 6.0)], "scene_id string, iid int, z double, radius double")
    pairs = spark.createDataFrame([("s", 1, 3)], "scene_id string, i int, j int")
    assert spatial.clearance_violations(pairs, flat, ["scene_id"]).first().required == 12.0


def test_widths_of_bars(spark):
    image = np.full((120, 120), 0.1, np.float32)
    mask = np.zeros((120, 120), bool)
    mask[:, 56:64] = mask[56:64, :] = True
    image[mask] = 0.9
    grey = spark.createDataFrame([("s", 120, 120, image.ravel().tolist())], SCENE + ", grey array<float>")
    rows = measure.bundles(measure.cuts(pixels_of(spark, {"s": mask}), grey)).collect()
    assert len(rows) == 2 and all(r["median"] == pytest.approx(8.0, abs=0.2) and r.quality == "good" for r in rows)


def test_streams(spark, cross, tmp_path):
    from strandel.streaming import scenes as stream

    a, b = cross
    (tmp_path / "in" / "s" / "v").mkdir(parents=True)
    (tmp_path / "in" / "s" / "v" / "mask.png").write_bytes(images.encode_png(((a | b) * 255).astype(np.uint8)))
    q = stream.instance_stream(stream.mask_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("inst").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.sql("select count(distinct iid) n from inst").first().n == 2


def test_session_stream(spark, tmp_path):
    from strandel.streaming import scenes as stream

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("user_id", "cast(ts as timestamp) ts", "value")
    events.write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = stream.session_stream(live).writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) n from sess").first().n == events.count()
