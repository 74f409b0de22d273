"""Each operator against brute force on odd texts, on the small tables, and on an empty table."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from strandel.llm import components, exact_dedup, fuse_filter, html_extract, language_id, line_dedup, minhash_dedup, mixing, packing, quality_classifier, quality_rules, secret_scan, subword
from strandel.llm.common import table
from strandel.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


# exact dedup


def test_fuse_filter_has_no_false_negative():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 1000, 20_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        blob = fuse_filter.build(np.concatenate((keys, keys)))
        assert fuse_filter.probe(blob, keys).all()
        assert fuse_filter.probe(blob, rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.02
        assert len(blob) < 4 * n + 200


@pytest.mark.parametrize("old", [None, "true", "false", "doc_id < 8"])
def test_exact_dedup(odd, old):
    old = F.expr(old) if old else None
    rows = texts(odd)
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = sorted((i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)
    assert sorted(map(tuple, exact_dedup.exact_dedup(odd, old).collect())) == want


def test_exact_dedup_of_ids_with_several_texts(spark):
    rows = [(1, "a"), (1, "b"), (2, "A"), (3, "b"), (None, "b"), (None, "B"), (4, None), (5, ""), (5, ""), (None, "alone")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("a", "b", "", "alone")}
    want = [(1, 2, 2, False, "a"), (1, 3, 4, False, "b"), (2, 2, 2, True, "a"), (3, 3, 4, True, "b"), (None, 3, 4, False, "b"), (None, 3, 4, False, "b"), (4, 5, 3, False, ""), (5, 5, 3, True, ""), (5, 5, 3, True, ""), (None, None, 1, True, "alone")]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((*w[:4], digest[w[4]])) for w in want)


def test_bytes_are_checked(spark, monkeypatch):
    rows = [(1, "x1"), (2, "X1"), (3, "y"), (4, "y"), (5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = spark.createDataFrame([(bytearray(hashlib.sha256(b"x1").digest()), 2, 2, 0), (bytearray(hashlib.sha256(b"y").digest()), 4, 2, 0)], "digest binary, keep_id long, n long, n_null long")
    assert exact_dedup.byte_mismatches(docs, groups, 2, "doc_id", "text").count() == 0
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n, real=exact_dedup.F.sha2: real(F.lit("one"), 256) if n == 256 else real(c, n))
    one = groups.limit(1).withColumn("digest", F.unhex(F.sha2(F.lit(""), 256)))
    assert sorted(r.doc_id for r in exact_dedup.byte_mismatches(docs, one.withColumn("keep_id", F.lit(4).cast("long")), 1, "doc_id", "text").collect()) == [1, 2, 5]
    monkeypatch.setattr(exact_dedup, "digests", lambda d, i, t: d.select("doc_id", F.unhex(F.sha2(F.lit(""), 256)).alias("digest")))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (4, 2), 4: (4, 2), 5: (5, 1)}


def test_snapshot_is_stored_and_opened_again(spark, tmp_path, monkeypatch):
    held = spark.createDataFrame([(k, f"text {k}") for k in range(300)], "doc_id long, text string")
    new = spark.createDataFrame([(1000 + k, f"text {k}") for k in range(290, 310)] + [(2000, "text 305")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "ROWS_PER_BUCKET", 50)
    exact_dedup.Snapshot.write(exact_dedup.digests(held), str(tmp_path / "snap"))
    snap = exact_dedup.Snapshot(spark, str(tmp_path / "snap"))
    assert snap.filters.count() == 6 and snap.exact.count() == 300
    batch = exact_dedup.digests(new)
    seen = snap.screen(exact_dedup._grouped(batch)).collect()
    assert len(seen) == 20 and sum(r.maybe for r in seen) >= 10 and sum(r.maybe for r in seen) < 16
    groups = snap.groups(batch).collect()
    assert len(groups) == 310 and Counter(r.n for r in groups) == {1: 299, 2: 11}


# near dedup


def shingles(t, width):
    w = lower(t).encode().split()
    return frozenset([tuple(w)] if 0 < len(w) < width else zip(*(w[k:] for k in range(width)), strict=False)) if w else frozenset()


def near_truth(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)].append(i)
    return sorted((i, len(sets[k]), min(least[root(k)]), i == min(least[root(k)])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80), (1, 50)])
def test_near_components(odd, width, percent):
    got = minhash_dedup.near_components(odd, minhash_dedup.Rule(width, percent))
    assert sorted(map(tuple, got.collect())) == near_truth(texts(odd), width, percent)


def test_near_components_of_a_dense_family(spark):
    rng = np.random.default_rng(4)
    centre = [f"w{k}" for k in range(160)]
    rows = []
    for i in range(150):
        own = list(centre)
        for at in rng.integers(0, 160, rng.integers(0, 9)):
            own[at] = f"n{rng.integers(0, 50)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash_dedup.near_components(docs, minhash_dedup.Rule(3, 85)).collect())) == near_truth(rows, 3, 85)


def test_near_query_on_the_small_table(spark):
    rows = texts(table(spark, SMALL, "documents"))
    assert sorted(map(tuple, QUERIES["op4_minhash_dedup"](spark, SMALL).collect())) == near_truth(rows, 3, 85)


def test_near_components_of_ids_with_several_texts(spark, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    a, b = " ".join(base), " ".join(base[::-1])
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "x y z"), (None, a), (None, "only here"), (7, None)]
    got = minhash_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), minhash_dedup.Rule(3, 85)).collect()
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, 1, False), (None, None, True), (7, 7, True)]
    assert sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in got))) == sorted(map(str, want))
    left = minhash_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), minhash_dedup.Rule(3, 85)).collect()
    assert len(left) == 5 and sum(r.text is not None and len(r.text) > 50 for r in left) == 2


@pytest.mark.parametrize("share", [2, 1_000])
def test_hubs_are_dealt_on_either_side(spark, monkeypatch, share):
    monkeypatch.setattr(minhash_dedup, "SHARE", share)
    pairs = [(1, k) for k in range(2, 12)] + [(k, 20) for k in range(2, 12)] + [(1, 20)]
    got = minhash_dedup._with_both(spark.createDataFrame(pairs, "a long, b long"), spark.range(30).select(F.col("id").alias("node"), (F.col("id") * 10).alias("x")), ["x"])
    assert sorted((r.a, r.b, r.x_a, r.x_b) for r in got.collect()) == sorted((a, b, 10 * a, 10 * b) for a, b in pairs)


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(8)
    for share in (0.3, 0.6, 0.9):
        pool = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
        both = int(3000 * share)
        a, b = np.unique(pool[:3000]), np.unique(np.concatenate((pool[:both], pool[3000 : 6000 - both])))
        r = minhash_dedup.registers([a, b])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(minhash_dedup.estimate(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0] - truth) < 0.15


def test_components_with_one_and_many_tasks(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 90), (90, 95), (200, 201)]
    want = {**dict.fromkeys(range(61), 0), 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components.components(df, len(edges)).collect()} == want
    monkeypatch.setattr(components, "EDGES_A_TASK", 20)
    assert {r.node: r.component for r in components.components(df.repartition(6), len(edges)).collect()} == want


# lines


@pytest.mark.parametrize("in_place", [0, 10_000])
def test_line_dedup(odd, monkeypatch, in_place):
    monkeypatch.setattr(line_dedup, "HASHES_IN_PLACE", in_place)
    rows = texts(odd)
    keys = {id(t): [lower(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")] for _, t in rows}
    for least, chars in ((2, 1), (3, 2)):
        count = Counter(k for _, t in rows for k in set(keys[id(t)]))
        drop = lambda k: len(k) >= chars and count[k] >= least  # noqa: E731, B023
        want = sorted((i, len(t.split("\n")), sum(map(drop, keys[id(t)])), "\n".join(x for x, k in zip(t.split("\n"), keys[id(t)], strict=True) if not drop(k))) for i, t in rows)
        assert sorted(map(tuple, line_dedup.line_dedup(odd, least, chars).collect())) == want


def test_runs_count_over_many_batches(spark):
    runs, want = line_dedup.LineRuns(fan_in=2), Counter()
    for k in range(5):
        part = Counter({h: 1 + (h + k) % 3 for h in range(k * 10, k * 10 + 40)})
        runs.add(spark.createDataFrame(list(part.items()), "hash long, n long"))
        want += part
    assert {r["hash"]: r["n"] for r in runs.counts().collect()} == dict(want)
    assert len(runs.levels) > 1
    runs.drop()


def test_every_batch_goes_through_the_runs(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"only {k}\nshared\neven" if k % 2 == 0 else f"only {k}\nshared") for k in range(40)], "doc_id long, text string")
    batches, seen = line_dedup.batches_of(docs), []
    assert sum(b.count() for b in batches) == 40 and sum(b.count() > 0 for b in batches) == 4
    monkeypatch.setattr(line_dedup.LineRuns, "add", lambda self, batch, real=line_dedup.LineRuns.add: (seen.append(batch.agg(F.max("n")).first()[0]), real(self, batch)))
    hot, n = line_dedup.hot_hashes(batches, line_dedup.line_hashes(F.col("text"), 1), 20)
    assert n == 2 and len(seen) == 4 and max(seen) < 20  # no batch holds the answer by itself
    monkeypatch.setattr(line_dedup.LineRuns, "add", lambda self, batch: self.levels[0].append(self._write(batch)) if not self.runs else None)
    assert line_dedup.hot_hashes(batches, line_dedup.line_hashes(F.col("text"), 1), 20)[1] == 0


# secrets


def base_of(t):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_scan(odd):
    got = secret_scan.digest(secret_scan.scan(odd, F.concat_ws("/", "source", "lang"), F.col("source"))).collect()
    want = []
    for i, t in texts(odd):
        spans = base_of(t)
        joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)


def test_ownership_parts_examples_from_live_values(spark):
    example, live = "Xk9Qm2Lp7Rt4Vw8Zb3Nc", "Jh5Gf8Ds2Ap9Oi3Uy6Te"
    rows = [(k, f"see {example} here", f"owner{k}") for k in range(5)] + [(9, f"my {live} here", "owner9"), (10, f"password = {example}", "owner1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(docs, F.col("source"), F.col("source"))).collect()}
    assert got[9].spans == f"live:3:{3 + len(live)}" and got[0].spans == "" and got[0].n_live == 0
    assert got[10].n_assign == 1 and got[10].n_copied_examples == 1 and got[10].held_by == "5:5" and got[9].held_by == "1:1"


def test_values_of_many_repositories_of_one_owner_are_examples(spark):
    wide, own = "Xk9Qm2Lp7Rt4Vw8Zb3Nc", "Jh5Gf8Ds2Ap9Oi3Uy6Te"
    rows = [(k, f"see {wide} here", None, f"repo{k}") for k in range(5)] + [(10 + k, f"my {own} here", None, f"repo{k % 4}") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(docs, F.col("repo"), F.col("source"))).collect()}
    assert all(got[k].spans == "" for k in range(5)) and all(got[10 + k].n_live == 1 and got[10 + k].held_by == "4:1" for k in range(9))


def test_candidates_that_touch_base_spans_are_left_out(spark):
    import random

    rng, rows = random.Random(6), []
    for k in range(40):
        parts = [rng.choice(["password=Ab3dEf6hIj9kLm2nOp5q", "AKIA" + "Z9" * 8, "Qw7Er3Ty9Ui2Op5As8Df", "0f" * 17, "x", "Qw7Er3Ty9Ui2" + "0f" * 16 + "AKIA" + "B7" * 7]) for _ in range(12)]
        rows.append((k, "".join(p + rng.choice([" ", "", "/", ". "]) for p in parts), f"o{k}"))
    many = " ".join(f"token=Ab{k}dEf6hIj9kLm2nOp5q Zx{k}Cv8Bn4Ml2Kj7Hg5Fd" for k in range(4_000))
    docs = spark.createDataFrame([*rows, (99, many, "o99")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(docs, F.col("source"), F.col("source"), 1_000, 1_000)).collect()}
    for i, t, _ in rows:
        base = base_of(t)
        want = [(m.start(), 3, m.end()) for m in re.finditer(secret_scan.CANDIDATE, t) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and len(set(m[0])) >= 10 and not any(a < m.end() and m.start() < b for a, _, b in base)]
        assert got[i].spans == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + want))
    assert got[99].n_assign == 4_000 and got[99].n_live == 4_000


# quality rules


def test_quality_measures(odd):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(odd).collect()}
    want = set()
    for i, t in texts(odd):
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        win, cover = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
        for k in range(len(w) - 4):
            if win[tuple(w[k : k + 5])] > 1:
                cover.update(range(k, k + 5))
        want.add((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    assert got == want


def test_quality_fences_are_near_the_quartiles_and_repeat(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    m = quality_rules.measure(docs).cache()
    found = {(r.lang, r.source): r for r in quality_rules.quartiles(quality_rules.sketches(m), ["lang", "source"]).collect()}
    by = defaultdict(list)
    for r in m.filter("n_words > 0").collect():
        by[r.lang, r.source].append(r)
    for key, rows in by.items():
        assert found[key].n == len(rows)
        for k in quality_rules.FENCES:
            values = sorted(r[k] for r in rows)
            for name, q in (("q1", 0.25), ("q3", 0.75)):
                want = values[max(0, -(-len(values) * int(q * 4) // 4) - 1)]
                assert abs(found[key][f"{name}_{k}"] - want) <= quality_rules.ERROR * want + 1e-9
    once = sorted(map(str, quality_rules.thresholds(quality_rules.sketches(m)).collect()))
    assert once == sorted(map(str, quality_rules.thresholds(quality_rules.sketches(quality_rules.measure(docs.repartition(13, "text")))).collect()))
    parts = [quality_rules.sketches(m.filter(F.col("doc_id") % 3 == k)) for k in range(3)]
    merged = parts[0].union(parts[1]).union(parts[2]).groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert once == sorted(map(str, quality_rules.thresholds(merged).collect()))


def test_quality_rules_keep_clean_and_drop_junk(spark):
    r = QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("not base_failed")
    n = {(x.quality, x.kept): x["count"] for x in r.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.1 * n[0, False] and n.get((1, False), 0) <= 0.02 * n[1, True]


# learned models


def spelled(text):
    """Counts of buckets, feature by feature."""
    found, point = Counter(), [ord(c) for c in text]
    step, low = int(subword._STEP), (1 << 32) - 1
    for n in subword.SIZES:
        for k in range(len(point) - n + 1):
            h = (point[k] * step + 17) & low
            for c in point[k + 1 : k + n]:
                h = (h * step + c) & low
            found[int(subword._bucket(np.array([h], np.uint64), n)[0])] += 1
    words = [int(np.sum([subword.mix(np.array([ord(c) + (k << 32)], np.uint64)) for k, c in enumerate(w)], dtype=np.uint64)) for w in WORD.findall(text)]
    for w in words:
        found[int(subword._bucket(np.array([w], np.uint64), 9)[0])] += 1
    for v, w in zip(words, words[1:], strict=False):
        found[int(subword._bucket(np.array([(w - v) % (1 << 64)], np.uint64), 10)[0])] += 1
    return found


def test_features_are_those_of_whole_texts_wherever_slices_end(monkeypatch):
    long = "\tAb0\u00e9\x0b" + "\t".join(f"Ab{k}\u00e9" for k in range(60)) + "\n" + "z" * 70 + "  end\n"
    texts = [long, "", "ab", " x y\tx ", "\U0001f600 a", long[1:-5]]
    want, logits = [spelled(t) for t in texts], np.random.default_rng(5).normal(0, 3, (subword.BUCKETS, 2)).astype(np.float32)
    model, seen = subword.Model(("0", "1"), logits, np.array([0.1, -0.2])), set()
    for size in (1, 2, 3, 7, 16, 63, 64, 65, 300, 1 << 19):
        monkeypatch.setattr(subword, "SLICE", size)
        got = [Counter() for _ in texts]
        for rows, starts, buckets in subword.features(texts):
            for i, a, b in zip(rows.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                got[i].update(buckets[a:b].tolist())
        assert got == want, size
        seen.add((subword.scores(model, texts).tobytes(), tuple((a.tobytes(), s.tobytes()) for a, s in subword.bags(texts))))
    assert len(seen) == 1


def test_score_replaces_a_column_of_its_name(odd):
    model = subword.Model(("0", "1"), np.zeros((subword.BUCKETS, 2), np.float32), np.array([0.0, 1.0]))
    for name in ("score", "Digest", "n_chars"):
        got = quality_classifier.score_column(odd.withColumn("SCORE", F.lit("x")), model, name)
        assert [c.lower() for c in got.columns].count(name.lower()) == 1 and got.filter(F.col(name) > 0.7).count() == odd.count()


def test_quality_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    r = QUERIES["op1_quality_classifier"](spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out")
    assert r.filter("quality = predicted").count() >= 0.95 * r.count()


def test_language_id_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    r = QUERIES["op10_language_id"](spark, sf).join(table(spark, sf, "documents"), "doc_id").filter("held_out")
    assert r.filter("lang = lang_pred").count() >= 0.97 * r.count()


def test_equal_texts_get_equal_scores(spark):
    rows = [(1, "some plain words of text"), (1, "some plain words of text"), (1, "other words"), (2, "some plain words of text"), (None, "some plain words of text"), (3, ""), (4, None)] + [(10 + k, f"learned text number {k % 3}") for k in range(30)]
    docs = spark.createDataFrame([(i, t, "en" if t and "number" not in t else "fr" if i else None) for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(10 + k, k % 3 % 2) for k in range(30)] + [(1, 1), (1, 1)], "doc_id long, quality int")
    scored = quality_classifier.score_column(docs, quality_classifier.fit(docs, labels), "score").collect()
    found = language_id.predict(docs, language_id.fit(docs)).collect()
    assert len(scored) == len(found) == len(rows) and len({r.score for r in scored if r.text == rows[0][1]}) == 1 and len({r.score for r in scored if not r.text}) == 1
    assert len({(r.lang_pred, r.score) for r in found if r.doc_id in (2, None)}) == 1


def test_models_take_odd_texts(odd, empty, spark):
    labels = spark.createDataFrame([(6, 1), (7, 0), (9, 1), (13, None), (None, 1), (6, 0)], "doc_id long, quality int")
    docs = odd.select("doc_id", "text", "lang")
    m = quality_classifier.fit(docs, labels)
    rows = quality_classifier.score_column(odd, m, "score").collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.keep_good(odd, m).columns == odd.columns
    none = quality_classifier.fit(empty, labels.limit(0))
    assert quality_classifier.keep_good(odd, none).count() == odd.count() and quality_classifier.keep_good(empty, none).count() == 0
    found = language_id.predict(odd, language_id.fit(odd)).collect()
    assert len(found) == odd.count() and {r.lang_pred for r in found if r.doc_id in (1, 2, 3, 16)} == {"und"}
    assert {r.lang_pred for r in language_id.predict(odd, language_id.fit(empty)).collect()} == {"und"}


# pages


PAGE = """<html><head><title>Not this</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies on this site</div><article><h1>Big &amp; small</h1><p>First  words
of it<br>go on.<aside>Look here too</aside><p>Second &lt;part&gt;.</p><div class="comments"><p>Nice one says a reader</p></div></article>
<form>Name <input name=a></form><footer>&copy; someone and many words of small print stand here</footer></body></html>"""


def test_html_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>only</nav>"), (5, "u", "plain words only"), (5, "u", "<article><p>cut off &am")], "page_id long, url string, html string")
    w = html_extract.learn(pages)
    got = {(r.page_id, r.text): r.n_chars for r in html_extract.main_text(pages, w).collect()}
    want = "Big & small\n\nFirst words of it go on.\n\nSecond <part>."
    assert got[1, want] == len(want) and (2, "") in got and (3, "") in got and (4, "") in got and len(got) == 6
    assert html_extract.extract(PAGE, html_extract.DEFAULT) == want


def test_html_query_against_the_marked_article(spark):
    for r in table(spark, SMALL, "pages").join(QUERIES["op8_html_extract"](spark, SMALL), ["page_id", "url"]).collect():
        inner = re.sub(r"<footer.*", "", re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1], flags=re.S)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", x)).split()) for x in re.split(r"</?(?:p|h1|div|article)>", inner))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


LONG = " ".join(f"word{k}" for k in range(40))


@pytest.mark.parametrize("wrapper", ['class="page has-sidebar"', 'id="content" class="with-comments"', 'class="sidebar-page"', 'class="widget"', 'role="banner"'])
def test_html_wrappers_named_after_other_parts_stay(wrapper):
    want = f"Title\n\n{LONG}"
    for inner in (f"<article><h1>Title</h1><p>{LONG}</p></article>", f"<h1>Title</h1><p>{LONG}</p>", f"<main><p>Title</p><p>{LONG}</p></main>", f"<p>Title</p><p>{LONG}</p>"):
        assert html_extract.extract(f"<body><div {wrapper}>{inner}</div><footer>Small print</footer></body>", html_extract.DEFAULT) == want
    assert html_extract.extract(f'<body><form id="aspnet"><p>Title</p><p>{LONG}</p></form></body>', html_extract.DEFAULT) == want


WRAPPERS = """class="layout no-sidebar"|id="page" class="site right-sidebar"|class="post-content social"|class="related work"|class="widget"|class="page-with-sidebar"|class="has-comments"|class="ad-free"
class="content share"|class="cookie-policy"|id="main-menu-open"|class="navbar-fixed site"|role="navigation"|id="sidebar"|class="promo" id="comments\"""".replace("\n", "|").split("|")


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_html_wrappers_never_empty_a_page(wrapper):
    for before, after in (("<article>", "</article>"), ("<main>", "</main>"), ("<body>", "</body>"), ("<div><div>", "</div></div>")):
        page = f"<nav>Menu one</nav>{before}<div {wrapper}><p>{LONG}</p><p>{LONG} end</p></div>{after}<footer>Small print</footer>"
        assert html_extract.extract(page, html_extract.DEFAULT) == f"{LONG}\n\n{LONG} end"
        inner = f"<nav>Menu one</nav><div {wrapper}>{before}<h1>Title</h1><p>{LONG}</p>{after}</div><aside>More</aside>"
        assert html_extract.extract(inner, html_extract.DEFAULT) == f"Title\n\n{LONG}"


def test_html_of_very_long_pages_clashing_columns_and_no_rows(spark):
    many = "".join(f"<p>{LONG} {k}</p>" for k in range(6_000))
    long = f"<nav>Menu</nav><article>{many}</article>" + "<div class=ad>x</div>" * 20_000
    pages = spark.createDataFrame([(1, "u", long, "clash", 5), (1, "u", long, None, None)], "page_id long, url string, html string, text string, n_chars long")
    for w in (html_extract.learn(pages), html_extract.learn(pages.limit(0))):
        got = html_extract.main_text(pages, w).collect()
        assert len(got) == 2 and all(r.text == "\n\n".join(f"{LONG} {k}" for k in range(6_000)) and r.n_chars == len(r.text) for r in got)


def test_html_parts_of_an_article_with_such_names_stay():
    page = f"""<article><h2 id="related-work">Related work</h2><p class="notice">Mind the gap.</p><section class="social-policy"><p>{LONG} {LONG} {LONG}</p></section>
<div class="banner"><h1>Title</h1></div><figure class="banner"><img src=x><figcaption>A view.</figcaption></figure><p>So <math><mi>a</mi><mo>=</mo><mn>1</mn><annotation>a=1</annotation></math> holds.</p>
<div class="related-posts"><a href=/>Other post</a></div><div class="ad-slot">Buy now</div><p>{LONG} {LONG} {LONG}</p></article><div id="comments"><article class="comment-body"><p>{LONG} {LONG} {LONG}</p></article></div>"""
    want = ["Related work", "Mind the gap.", f"{LONG} {LONG} {LONG}", "Title", "A view.", "So a=1 holds.", f"{LONG} {LONG} {LONG}"]
    assert html_extract.extract(page, html_extract.DEFAULT) == "\n\n".join(want)


EDGES = {
    "<h2>Short title</h2>": "Short title", "<ul><li>one two three</li><li>four five six</li><li>seven</li></ul>": "one two three\n\nfour five six\n\nseven",
    "<ol><li>Read <a href=/>the source</a></li></ol>": "Read the source", "<table><tr><th>Year</th><td>1</td></tr><tr><th>Size</th><td>2</td></tr></table>": "Year\n\n1\n\nSize\n\n2", "<blockquote>So it goes.</blockquote>": "So it goes.",
    "<figure><img src=x><figcaption>A view.</figcaption></figure>": "A view.", "<p><em>Fine</em> <code>print</code></p>": "Fine print",
}


@pytest.mark.parametrize("edge", sorted(EDGES))
def test_html_articles_begin_and_end_with_headings_lists_and_tables(spark, edge):
    seen = html_extract.learn(spark.createDataFrame([("<nav><a>x</a></nav><div>Buy this</div><article><h1>A</h1><p>Words <b>and</b><br>more</p></article><footer>Print</footer>",)], "html string"))
    for weights in (html_extract.DEFAULT, seen):
        menu = "<div><ul><li><a href=/>Home</a></li><li><a href=/a>All news</a></li></ul></div>"
        for a, b in (("<article>", "</article>"), ("", "")):
            page = f"<body>{menu}{a}{edge}<p>{LONG}</p>{edge}{b}{menu}</body>"
            assert html_extract.extract(page, weights) == f"{EDGES[edge]}\n\n{LONG}\n\n{EDGES[edge]}"
        assert html_extract.extract(f"<article><div class=article-header><h1>Title</h1></div>{edge}</article>", weights) == f"Title\n\n{EDGES[edge]}"


def test_html_weights_come_from_the_pages_that_mark_their_content(spark):
    kinds = "".join(f"<x{k}>word</x{k}>" for k in range(600))
    marked = spark.createDataFrame([(f"<div>Outside {k}</div><ARTICLE class=a><p>Inside {k}</p>{kinds}</ARTICLE>",) for k in range(3)], "html string")
    most = marked.union(spark.createDataFrame([(f"<div><p>No mark on page {k}</p></div>",) for k in range(3000)] + [(None,)], "html string"))
    found = html_extract.learn(most, most_pages=10)
    assert found == html_extract.learn(marked) and found["word:div"] == 0.0 and all(found[f"word:x{k}"] == 1.0 for k in range(600))


def test_every_fence_of_the_quality_rules_can_act(spark):
    common = " ".join(f"word{k}" for k in range(30))
    odd = {"symbol_ratio": "#" * 200, "caps_ratio": "LOUD" * 60, "mark_ratio": "!" * 200, "dup_line_ratio": "\nab" * 10 + "\n" + "".join(f"\nab{k}\nab{k}" for k in range(9)), "word_chars_mean": "x" * 900}
    rows = [(k, common, "en", "s") for k in range(300)] + [(1000 + k, f"{common} {x}", "en", "s") for k, x in enumerate(odd.values())]
    limits = quality_rules.thresholds(quality_rules.sketches(m := quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))).first()
    seen = {r.doc_id: r for r in m.filter("doc_id >= 1000").collect()}
    passed = {r.doc_id for r in quality_rules.apply_rules(m, quality_rules.thresholds(quality_rules.sketches(m)), 1).filter("not base_failed").collect()}
    assert set(odd) == set(quality_rules.FENCES)
    for k, name in enumerate(odd):
        assert seen[1000 + k][name] > limits[f"high_{name}"] and 1000 + k in passed, name


# packing


def test_packing_is_exact_and_tight(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (odd.dropDuplicates(["doc_id"]), table(spark, SMALL, "documents")):
        of, seqs = defaultdict(list), defaultdict(list)
        for r in packing.pack(docs).collect():
            of[r.doc_id].append(r)
            seqs[r.sequence_id].append((r.offset, r.length))
        for i, t in texts(docs):
            ids, at = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
            for k, r in enumerate(sorted(of[i], key=lambda r: r.piece)):
                assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes())) and (k == 0 or r.length == 1024)
                at += r.length
            assert at == len(ids)
        total = 0
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
            total += at
        assert len(seqs) <= -(-total // 1024) * 1.03 + 1


def test_plan_uses_the_histogram_up():
    rng = np.random.default_rng(2)
    for hist in ({}, {1024: 3}, {1: 5000}, {600: 40, 424: 41, 10: 3}, dict(Counter(rng.integers(1, 1025, 4000).tolist()))):
        used, packed = Counter(), packing.plan(hist)
        for p, n in packed:
            assert sum(a * m for a, m in p) <= 1024 and n > 0
            for a, m in p:
                used[a] += m * n
        assert used == Counter(hist)


# mixing


def test_mixing(odd):
    aims, rows = mixing.mix(odd)
    got = rows.collect()
    size = Counter((i, len(WORD.findall(t))) for i, t in texts(odd))
    assert Counter((r.doc_id, r["size"]) for r in got) == size
    taken = defaultdict(int)
    for r in got:
        words = [d.words for d in r.draws]
        assert all(0 < w <= r["size"] for w in words) and sum(words) <= 3 * r["size"] and len({d["pass"] for d in r.draws}) == len(words)
        taken[r.src] += sum(words)
    for r in aims.collect():
        assert r.target <= 3 * r.source_size + 1e-6 and abs(taken.get(r.src, 0) - r.target) <= 1
    assert {r.doc_id for r in mixing.mixed_documents(odd).collect()} <= {i for i, _ in size}


def test_mixes_agree_however_the_input_is_laid_out(spark):
    docs = table(spark, SMALL, "documents")
    docs = docs.union(docs.filter("doc_id % 7 = 0")).union(docs.filter("doc_id % 9 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    layouts = [docs, docs.repartition(7, "text"), docs.orderBy(F.xxhash64("text")).coalesce(2)]
    seen = {tuple(sorted(map(str, mixing.mix(d)[1].collect()))) for d in layouts}
    assert len(seen) == 1


def test_shards_take_by_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 2)
    monkeypatch.setattr(mixing, "SHARD_DRAWS", 8)
    docs = table(spark, SMALL, "documents")

    def drawn():
        by_shard = defaultdict(set)
        for r in mixing.mix(docs)[1].collect():
            for d in r.draws:
                by_shard[d.shard].add((r.src, d["pass"], r.doc_id))
        return by_shard

    got = drawn()
    quotas = spark.createDataFrame([(r.src, r.n) for r in mixing.drawn_blocks(*_blocks(docs)).groupBy("src").agg(F.sum(F.size("draws")).alias("n")).collect()], "src string, n long")
    total = sum(r.n for r in quotas.collect())
    want = {r.shard for r in mixing.split_quotas(quotas, max(3, (total // 8).bit_length())).collect()}
    assert set(got) <= want and len(got) >= 8
    sizes = sorted(len(v) for v in got.values())
    assert sizes[-1] <= 2 * 3 * -(-total // len(want))
    rows = [x for v in got.values() for x in v]
    assert len(rows) == len(set(rows))  # what one shard draws, no other draws in the same pass
    monkeypatch.setattr(mixing, "split_quotas", lambda q, levels: q.select("src", F.lit(0).cast("long").alias("shard"), F.col("n").alias("draws")))
    assert set(drawn()) == {0}
    monkeypatch.setattr(mixing, "split_quotas", lambda q, levels: q.limit(0).select("src", F.lit(0).cast("long").alias("shard"), F.col("n").alias("draws")))
    assert not drawn()


def _blocks(docs):
    held = {}
    real = mixing.drawn_blocks
    mixing.drawn_blocks = lambda blocks, aims: held.update(x=(blocks, aims)) or real(blocks, aims)
    try:
        mixing.mix(docs)
    finally:
        mixing.drawn_blocks = real
    return held["x"]


def test_many_sources_are_weighed_in_their_order(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("0s"), F.lpad((F.col("id") % 120).cast("string"), 4, "0")).alias("src"), ((F.col("id") * 37) % 101).alias("size"))
        got = {r.src: r.target for r in mixing.targets(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = Counter()
    for k in range(500):
        sizes[f"0s{k % 120:04}"] += k * 37 % 101
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    want, free, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
        free -= over
        left -= sum(want[s] for s in over)
    want |= {s: level * weight[s] for s in free}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_split_quotas_are_exact_and_near_their_means(spark):
    q = spark.createDataFrame([("a", 400), ("b", 100), ("c", 0), ("d", 12)], "src string, n long")
    rows = mixing.split_quotas(q, 3).collect()
    by_src, by_shard = Counter(), Counter()
    for r in rows:
        by_src[r.src] += r.draws
        by_shard[r.shard] += r.draws
    assert by_src == {"a": 400, "b": 100, "d": 12} and set(by_shard.values()) == {64}
    assert all(30 <= r.draws <= 64 for r in rows if r.src == "a")


def test_hypergeometric_inverts_the_exact_distribution(spark):
    import math
    import random

    rng, cases = random.Random(3), []
    for _ in range(100):
        n = rng.randint(1, 120)
        cases.append((rng.randint(0, n), n, rng.randint(0, n), rng.random()))

    def exact(k, n, m, u):
        total = 0.0
        for x in range(max(0, m - (n - k)), min(k, m) + 1):
            total += math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m)
            if total >= u:
                return x
        return min(k, m)

    df = spark.createDataFrame(cases, "k long, n long, m long, u double")
    assert all(r.x == exact(r.k, r.n, r.m, r.u) for r in df.select("*", mixing.hypergeometric(*map(F.col, "knmu")).alias("x")).collect())


# empty tables


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert minhash_dedup.near_components(empty, minhash_dedup.Rule()).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert secret_scan.digest(secret_scan.scan(empty, F.col("source"), F.col("source"))).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert all(df.count() == 0 for df in mixing.mix(empty)) and mixing.mixed_documents(empty).count() == 0
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string"), html_extract.DEFAULT).count() == 0


def pipeline_truth(spark, docs, sf_dir):
    """Rows that are left after stages 1 to 3 by brute force, from the classifier's own scores."""
    import corpus_pipeline

    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    rows = [(r.doc_id, r.text or "", r._s) for r in quality_classifier.score_column(docs, model, "_s").select("doc_id", "text", "_s").collect()]
    good = [(i, t) for i, t, s in rows if s >= 0.3]
    last = {}
    for i, t in sorted(good, key=lambda x: -1 if x[0] is None else x[0]):
        last[lower(t)] = (i, t)
    near = list(last.values())
    sets = [shingles(t, 5) for _, t in near]
    parent = list(range(len(near)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if b < a}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    groups = defaultdict(set)
    for k, (_, t) in enumerate(near):
        groups[root(k)].add(lower(t))
    return corpus_pipeline, good, near, list(groups.values())


def whole_pipeline(spark, docs, sf_dir, tmp_path):
    import shutil

    folder = str(tmp_path / "sf")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    shutil.copy(f"{sf_dir}/labels.parquet", f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("which", ["small", "odd", "empty"])
def test_pipeline_against_brute_force(spark, odd, empty, tmp_path, which):
    from tokenizers import Tokenizer
    import public_tokenizers

    docs = {"small": table(spark, SMALL, "documents"), "odd": odd.union(odd.limit(3)).union(odd.filter("doc_id in (6, 9, 13)").withColumn("doc_id", F.lit(None).cast("long"))).withColumnRenamed("digest", "_key"), "empty": empty}[which]
    folder = whole_pipeline(spark, docs, SMALL, tmp_path)
    docs = table(spark, folder, "documents")
    pipeline, good, unique, families = pipeline_truth(spark, docs, folder)
    out = docs
    for k, (_, stage) in enumerate(pipeline.STAGES[:4]):
        out = stage(spark, out, folder).cache()
        assert out.columns == docs.columns
        rows = texts(out)
        if k == 0:
            assert sorted(rows, key=str) == sorted(good, key=str)
        if k == 1:
            assert Counter(lower(t) for _, t in rows) == Counter(lower(t) for _, t in unique) and set(rows) <= set(good)
            if which == "small":
                assert sorted(rows) == sorted(unique)
        if k == 2:
            assert len(rows) == len(families) and all(sum(lower(t) in f for _, t in rows) == 1 for f in families)
    mixed = out
    times = Counter((i, t) for i, t in texts(mixed))
    assert all(n <= 3 for n in times.values()) and all(len(WORD.findall(t)) for _, t in times)
    got = pipeline.run(spark, folder)
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect())
    tok, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for (i, t), n in times.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        ends = list(range(len(ids) % 1024 or 1024, len(ids) + 1, 1024))
        for k, to in enumerate(ends):
            at = ends[k - 1] if k else 0
            want[i, k, at, to - at, zlib.crc32(ids[at:to].tobytes())] += n
    assert pieces == want
    seqs = defaultdict(list)
    for r in got.collect():
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_rows_without_an_id(spark, odd):
    null = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d e f"), (3, "a b c d e f"), (None, None), (None, "only here"), (None, "only here")], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    e = exact_dedup.exact_dedup(null).collect()
    assert len(e) == 6 and sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in e) == [(0, 0, 1, True), (0, 0, 2, True), (0, 0, 2, True), (0, 3, 3, False), (0, 3, 3, False), (3, 3, 3, True)]
    n = minhash_dedup.near_components(null, minhash_dedup.Rule()).collect()
    assert len(n) == 6 and sorted((r.component_id or 0, r.kept) for r in n) == [(0, True), (0, True), (0, True), (3, False), (3, False), (3, True)]
    assert line_dedup.line_dedup(null, 2).count() == quality_rules.quality_rules(null).count() == packing.pack(null).count() == 6
    assert secret_scan.digest(secret_scan.scan(null, F.col("source"), F.col("source"))).count() == 6
    assert mixing.mix(null)[1].count() == 6 and mixing.mixed_documents(null).count() > 0
    model = language_id.fit(null)
    assert language_id.predict(null, model).count() == 6
