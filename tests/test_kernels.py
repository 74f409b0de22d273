import itertools
import random

import numpy as np
import pytest

from strandel import config
from strandel.kernels import matching, ordering, profile, raster, skeleton


def test_blossoms_equal_subsets_and_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        n = rng.randint(2, 9)
        w = {(a, b): rng.randint(1, 30) * 2 for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6}
        total = lambda pairs: sum(w[min(p), max(p)] for p in pairs)  # noqa: E731, B023
        found = matching._by_blossoms(n, w)
        used = [v for p in found for v in p]
        assert len(used) == len(set(used)) and total(found) == total(matching._by_subsets(n, w))


def test_best_pairs_decline_what_costs_more_than_the_prices():
    assert matching.best_pairs({(0, 1): 0.5, (1, 2): 0.1}, 0.2) == [(1, 2)]
    assert matching.best_pairs({(0, 1): 0.5}, 0.2) == []


def test_exact_order_beats_every_permutation():
    rng = random.Random(7)
    for _ in range(40):
        n = rng.randint(2, 6)
        w = {(a, b): rng.random() for a in range(n) for b in range(n) if a != b and rng.random() < 0.5}
        value = lambda o: sum(x for (u, v), x in w.items() if o.index(u) < o.index(v))  # noqa: E731, B023
        assert value(ordering.exact_order(list(range(n)), w)) == pytest.approx(max(value(list(p)) for p in itertools.permutations(range(n))))


def test_orders_levels_and_heights():
    w = {(1, 2): 0.9, (2, 3): 0.8, (1, 3): 0.7, (3, 4): 0.95}
    assert ordering.exact_order([1, 2, 3, 4], w) == ordering.greedy_order([1, 2, 3, 4], w) == [1, 2, 3, 4]
    assert ordering.strong_parts([1, 2, 3, 4], {1: [2], 2: [3], 3: [1], 4: []}) == [[1, 2, 3], [4]]
    report = ordering.global_order([1, 2, 3], [(1, 2, 0.9), (2, 3, 0.9), (3, 1, 0.7)])
    assert report["n_precedence_cycles_raw"] == 1 and report["n_relations_flipped"] == 1 and report["position"][1] < report["position"][3]
    assert ordering.path_levels([1, 2, 3, 4], [(1, 2), (2, 3)]) == {1: 2, 2: 1, 3: 0, 4: 0}
    z, status = ordering.heights([1, 2, 3], [(1, 2), (2, 3)], {1: 4.0, 2: 3.0, 3: 5.0}, {1: 0, 2: 1, 3: 2})
    assert z == {3: 0.0, 2: 8.0, 1: 15.0} and status == "compact_stack"
    raft = [(k, k + 1, None) for k in range(6)]
    _, level = ordering.compact_order(list(range(7)), raft)
    assert len(set(level.values())) <= 3


def test_cut_of_a_flat_ridge():
    image = np.zeros((33, 33))
    image[12:21] = 1
    cut = profile.measure(image, 0.0, 0.0, (16, 16), (1, 0), profile.CutRule(half_len=12, min_reach=5))
    assert cut.ok and cut.width == pytest.approx(9.0) and cut.offset == pytest.approx(0.0)
    assert profile.measure(image, 0.0, 0.0, (2, 2), (1, 0)).reason == "outside_image"
    assert profile.measure(np.zeros((99, 99)), 0.0, 0.0, (50, 50), (1, 0)).reason == "low_contrast"


def test_raster_kernels():
    rng = np.random.default_rng(1)
    mask = rng.random((25, 31)) < 0.08
    d, r, c = raster.distance(mask)
    at = np.argwhere(mask)
    for y, x in itertools.product(range(25), range(31)):
        assert d[y, x] == pytest.approx(np.sqrt(((at - (y, x)) ** 2).sum(1)).min())
        assert mask[r[y, x], c[y, x]]
    bar = np.zeros((60, 60), bool)
    bar[28:32, 5:55] = True
    thin = raster.thin(bar)
    assert raster.label(thin).max() == 1 and raster.degree(thin).max() <= 2
    assert not raster.distance(np.zeros((3, 3), bool))[0].any() == np.inf


def test_cross_is_two_instances_and_rings_survive():
    mask = np.zeros((140, 140), bool)
    mask[68:70, 10:130] = True
    mask[10:130, 68:70] = True
    rule = config.GroupRule()
    scene = skeleton.decompose(mask, rule)
    links, found = skeleton.solve(scene, rule)
    kept = skeleton.emitted(scene, found, 6)
    assert len(kept) == 2 and all(len(x) == 2 for x in kept)
    assert skeleton.solve(scene, rule)[0] == links
    assert skeleton.fragments(mask).max() >= 4
    assert skeleton.decompose(np.zeros((9, 9), bool), rule).paths == []
    with pytest.raises(ValueError):
        skeleton.decompose(mask, config.build("group", {"spur_px": 4}))


def test_config_is_strict(tmp_path):
    assert config.build("group", ["spur_px=2", "break_rings=yes"]).break_rings is True
    for bad in ({"no_such": 1},):
        with pytest.raises(SystemExit):
            config.build("group", bad)
    with pytest.raises(SystemExit):
        config.build("depth", {"scoring": "guess"})
    tuned = config.build("group", {"join_px": 9, "break_rings": True})
    config.write_tuned(str(tmp_path / "t.yaml"), tuned, config.GroupRule(), {"scenes": 3})
    assert config.apply_tuned(config.GroupRule(), str(tmp_path / "t.yaml")) == tuned
    assert config.apply_tuned(config.GroupRule(), str(tmp_path / "t.yaml"), {"join_px": 5}).join_px == 5
    (tmp_path / "twice.yaml").write_text("group: {a: {spur_px: 1}, b: {spur_px: 2}}")
    with pytest.raises(SystemExit):
        config.load(str(tmp_path / "twice.yaml"))


def test_graph_loops_equal_the_task_kernels(spark, monkeypatch):
    from strandel.operators import graphs

    rng = random.Random(9)
    rows = sorted({(s, rng.randint(0, 14), rng.randint(0, 14)) for s in ("a", "b") for _ in range(24)})
    any_ = spark.createDataFrame([r for r in rows if r[1] != r[2]], "scene string, u long, v long")
    down = spark.createDataFrame(sorted({(s, min(u, v), max(u, v), 1.0 + u % 3) for s, u, v in rows if u != v}), "scene string, lo long, hi long, w double")
    nodes = spark.createDataFrame([(s, n) for s in ("a", "b") for n in range(16)], "scene string, node long")
    key = lambda df: sorted(map(tuple, df.select("scene", "node", df.columns[-1]).collect()))
    calls = (lambda: graphs.strong_components(nodes, any_, ["scene"]), lambda: graphs.longest_path(nodes, down, ["scene"], "w"), lambda: graphs.connected_components(nodes, any_, ["scene"]))
    tasks = [key(f()) for f in calls]
    monkeypatch.setattr(graphs, "EDGES_A_TASK", 5)
    assert [key(f()) for f in calls] == tasks
    with pytest.raises(Exception, match="cycle"):
        graphs.longest_path(nodes, spark.createDataFrame([("a", 1, 2), ("a", 2, 1)], "scene string, lo long, hi long"), ["scene"]).collect()
    assert graphs.cycle_groups(nodes, any_, ["scene"]).count() == sum(n > 1 for n in __import__("collections").Counter((s, c) for s, _, c in tasks[0]).values() for _ in range(n))
