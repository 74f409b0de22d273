"""Near-duplicate components by HyperMinHash: banded compressed registers, then full sets.

1. One pass takes each text's set of word shingles, its size, a 128-bit key of the set and
   REGISTERS HyperMinHash registers: the shingle hash's leading bits pick the bucket, and the
   bucket's least value is stored as a leading-zero count and MANTISSA bits. Empty buckets
   borrow from others in a fixed order, so short texts band as well.
2. Texts with equal sets become one class, before any pairing.
3. Bands of registers put classes into buckets. Every class is compared to one leader a bucket (the
   class that shares most), never to all of it. A collision-corrected estimate from the registers
   drops pairs that are surely under the threshold; the rest are checked on the full sets.
4. Buckets that still hold more than one component are searched in square blocks of bounded size:
   first each class's nearest partners in other components, then whatever pairs across components
   are left, checked on the full sets inside the block, which gives back links only. So no link
   that shares a band is lost to the choice of leaders, and pairs within a component, or pairs that
   do not link, are never listed.
5. Components of the links; the smallest doc_id of each stays.

Defined results: no words (or null) gives an empty set, size 0, linked with nothing; fewer words than
the width are one shingle; repeated rows share a class; extra columns are ignored; an empty table
gives no rows; rows that repeat a doc_id are linked each by its own text; a row without a doc_id takes
the component of its class, and stays only where no row of it has one. Sets are held as 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandel.llm.common import Bucketed, cut, cut_counted, cut_small, lookup, salted_lookup, table, with_keys
from strandel.llm.components import components
from strandel.llm.words import groups, mix, slices, text_bytes, window_hashes, word_spans

REGISTERS = 128
MANTISSA = 10
#: Standard errors of the estimate under the threshold at which a pair is dropped unchecked.
ERRORS = 4.0
#: Classes of fewer shingles than this are always checked on the full sets.
ALWAYS_CHECK = 100
#: Classes of a bucket that are searched in one block, and pairs checked in one share of a hub.
BLOCK, SHARE = 1_024, 1_000
#: Bytes of full sets in one block.
BLOCK_BYTES = 16 << 20
#: Pairs a partition when their full sets are compared.
SET_ROWS = 10_000
#: Partners of the highest estimate that each class of an open bucket is checked against first.
NEAREST = 3
_BITS = 64 - 7
_PROBES = np.random.default_rng(20240229).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1)


@dataclass(frozen=True)
class Rule:
    """Link when 100 * intersection >= percent * union of the sets of `width`-word shingles."""

    width: int = 5
    percent: int = 80
    rows: int = 5

    @property
    def bands(self) -> int:
        return REGISTERS // self.rows


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    every, marks = text_bytes(column)
    for a, b in groups(np.diff(marks)):
        words, _, _, first = word_spans(every[marks[a] : marks[b]], marks[a : b + 1] - marks[a], lower=True)
        h, text, _ = window_hashes(words, first, width)
        at = np.searchsorted(text, np.arange(b - a + 1), "left")
        n_words = np.diff(first)
        for i in range(b - a):
            if n_words[i] >= width:
                yield np.unique(h[at[i] : at[i + 1]])
            elif n_words[i]:
                with np.errstate(over="ignore"):
                    value = np.full(1, n_words[i], np.uint64)
                    for w in words[first[i] : first[i + 1]]:
                        value = mix(value) + w
                    yield mix(value)
            else:
                yield np.zeros(0, np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, one row a set; empty sets get zeros."""
    starts = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_BITS)
    least, full = np.zeros((len(sets), REGISTERS), np.uint64), np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.minimum(np.searchsorted(s, starts), len(s) - 1)
            least[i] = s[at]
            full[i] = (s[at] >> np.uint64(_BITS)) == np.arange(REGISTERS, dtype=np.uint64)
    part, power = np.frexp((least & np.uint64((1 << _BITS) - 1)).astype(np.float64))
    out = ((_BITS - power).astype(np.uint16) << np.uint16(MANTISSA)) | np.clip((part - 0.5) * 2 ** (MANTISSA + 1), 0, 2**MANTISSA - 1).astype(np.uint16)
    row, col = np.nonzero(~full & full.any(1)[:, None])
    for k in range(REGISTERS):
        if not len(row):
            break
        source = _PROBES[col, k]
        hit = full[row, source]
        out[row[hit], col[hit]] = out[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    out[~full.any(1)] = 0
    return out


def _collision_table() -> np.ndarray:
    """Chance that the registers of two disjoint sets agree, by the powers of two of values a bucket."""
    x = np.concatenate([2.0**-k * (0.5 + (np.arange(64) + 0.5) / 128) for k in range(40)])
    dx = np.concatenate([np.full(64, 2.0**-k / 128) for k in range(40)])
    cell = np.concatenate([np.full(64, 2.0 ** -(k + 1) / 2**MANTISSA) for k in range(40)])
    rate = 2.0 ** np.arange(0, 30)
    with np.errstate(under="ignore"):
        density = rate[:, None] * np.exp(-rate[:, None] * x)
    return (density * (dx * cell)) @ density.T


_COLLISIONS = _collision_table()


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (rows of a against rows of b), corrected for collisions."""
    power = lambda n: np.clip(np.log2(np.maximum(n, 1) / REGISTERS), 0, 29).astype(int)
    chance = _COLLISIONS[power(n_a), power(n_b)]
    return np.maximum(0.0, ((a == b).mean(-1) - chance) / (1 - chance))


def _passes(est: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    j = percent / 100
    sized = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sized & ((est >= j - ERRORS * np.sqrt(j * (1 - j) / REGISTERS)) | (np.minimum(n_a, n_b) < ALWAYS_CHECK))


def signatures(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, the set's key (k1, k2) and registers of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            sets = list(shingle_sets(part.column(1), rule.width))
            with np.errstate(over="ignore"):
                keys = np.array([(mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            regs = [r.tobytes() for r in registers(sets)]
            yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(regs, pa.binary())], names=names)

    names = ["doc_id", "n_shingles", "k1", "k2", "regs"]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, regs binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def likely(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose registers' estimate does not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_a, n_b = b.column(2).to_numpy(), b.column(4).to_numpy()
            est = estimate(_matrix(b.column(3).to_pylist()), _matrix(b.column(5).to_pylist()), n_a, n_b)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(_passes(est, n_a, n_b, rule.percent)))

    return _with_both(pairs, classes.select(F.col("rep").alias("node"), "n", "regs"), ["n", "regs"]).select("a", "b", "n_a", "regs_a", "n_b", "regs_b").mapInArrow(run, "a long, b long")


def _with_both(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the columns of both nodes; a hub that stands in many pairs, on either side, is dealt into shares."""
    ends = F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("node")) for x in ("a", "b")])
    stands = pairs.select(F.explode(ends).alias("e")).groupBy("e.side", "e.node").agg(F.count(F.lit(1)).alias("n"))
    hubs, n = cut_counted(stands.filter(F.col("n") > SHARE).select("side", "node", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")))
    for x, other in (("b", "a"), ("a", "b")):
        held = nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
        if not n:
            pairs = pairs.join(held.hint("merge"), x)
            continue
        shares = hubs.filter(F.col("side") == x).select(F.col("node").alias(x), "shares")
        many = F.coalesce("shares", F.lit(1))
        pairs = lookup(pairs, shares, n, [x], F.col(other)).withColumn("share", F.pmod(F.xxhash64(other), many).cast("int")).drop("shares")
        dealt = lookup(held, shares, n, [x], F.col(x)).withColumn("share", F.explode(F.sequence(F.lit(0), many - 1))).drop("shares")
        pairs = pairs.join(dealt, [x, "share"]).drop("share")
    return pairs


def _parts(df: DataFrame, rows: int) -> int:
    """Partitions for rows whose sets are compared: four a core, more where these would hold over SET_ROWS each."""
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // SET_ROWS))


def sets_of(docs: DataFrame, nodes: DataFrame, rule: Rule, key: str, text_col: str) -> Bucketed:
    """node, set (sorted shingle hashes) of the texts whose key is among `nodes`; written once for all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            yield pa.record_batch([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1), rule.width)], pa.binary())], names=["node", "set"])

    texts = docs.select(F.col(key).alias("node"), F.col(text_col).cast("string").alias("text"))
    held = texts.join(nodes.distinct().hint("shuffle_hash"), "node", "left_semi")
    return Bucketed(held.mapInArrow(run, "node long, set binary"), "node")


def _linked(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= rule.percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, n: int, sets: DataFrame, rule: Rule) -> tuple[DataFrame, int]:
    """Those of the `n` pairs that link, by the full sets of both texts, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), rule) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return cut_counted(_with_both(pairs, sets, ["set"]).select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), parts=_parts(pairs, n))


def open_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets of three classes or more that hold more than one component."""
    marked = shared.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = marked.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).filter("size > 2 and low <> high").select("key")
    return salted_lookup(marked.select("rep", "key", "band", "component"), mixed, ["key"], F.col("rep"), "inner")


def _in_blocks(rows: DataFrame, weight) -> DataFrame:
    """`rows` of buckets dealt into square blocks (x, y) of bounded weight, so that each pair of a bucket meets in one."""
    blocks = rows.groupBy("key").agg(F.ceil(F.sum(weight)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = salted_lookup(rows, blocks, ["key"], F.col("rep"), "inner").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "blocks")


def _by_block(dealt: DataFrame):
    """Groups of blocks in a counted number of parts: a block of registers costs far more time than its bytes tell."""
    spark = dealt.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, "key", "x", "y").groupBy("key", "x", "y")


def _partners(part: pd.DataFrame, same_block: bool, rule: Rule, most: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a block the rows of other components that may link to it by the estimate.

    most: only so many of the highest estimate; None gives all of smaller `rep` whose first shared
    band is this one.
    """
    regs, n, comp, rep, own = _matrix(part.regs), part.n.to_numpy(), part.component.to_numpy(), part.rep.to_numpy(), part.own.to_numpy()
    before = regs[:, : rule.rows * int(part.band.iloc[0])].reshape(len(part), -1, rule.rows)
    for i in range(len(part)):
        j = np.flatnonzero((comp != comp[i]) & ((own != own[i]) | same_block) & ((rep < rep[i]) | (most is not None)))
        if not len(j):
            continue
        est = estimate(regs[j], regs[i], n[j], np.full(len(j), n[i]))
        ok = _passes(est, n[j], n[i], rule.percent)
        j, est = j[ok], est[ok]
        if most is not None:
            j = j[np.argsort(-est, kind="stable")[:most]]
        elif before.shape[1]:
            j = j[~(before[j] == before[i]).all(-1).any(-1)]
        if len(j):
            yield i, j


def nearest_pairs(rows: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a > b) of each class and its NEAREST partners in other components of a bucket."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rep = part.rep.to_numpy()
        out = [(max(rep[i], rep[k]), min(rep[i], rep[k])) for i, j in _partners(part, key[1] == key[2], rule, NEAREST) for k in j]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    dealt = _in_blocks(rows.join(classes.select("rep", "n", "regs"), "rep"), F.lit(1.0 / BLOCK))
    return _by_block(dealt).applyInPandas(run, "a long, b long").distinct()


def remaining_links(rows: DataFrame, classes: DataFrame, sets: DataFrame, rule: Rule) -> tuple[DataFrame, int]:
    """All links (a > b) across components of open buckets, checked on the full sets inside the blocks.

    A first round finds the rows that have a possible partner at all; only those carry their sets.
    """

    def possible(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        hit = {k for i, j in _partners(part, key[1] == key[2], rule, None) for k in (i, *j)}
        return part.iloc[sorted(hit)][["rep", "key", "band", "component"]]

    def check(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sets, rep = [np.frombuffer(x, np.uint64) for x in part.set], part.rep.to_numpy()
        out = [(rep[i], rep[k]) for i, j in _partners(part, key[1] == key[2], rule, None) for k in j if _linked(sets[i], sets[k], rule)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    known = classes.select("rep", "n", "regs")
    likely_rows = _by_block(_in_blocks(rows.join(known, "rep"), F.lit(1.0 / BLOCK))).applyInPandas(possible, "rep long, key long, band int, component long")
    likely_rows = cut_small(likely_rows.distinct())
    weighed = likely_rows.join(known, "rep")
    dealt = _in_blocks(weighed, F.greatest(F.lit(1.0 / BLOCK), F.col("n") * 8.0 / BLOCK_BYTES))
    return cut_counted(dealt.join(sets.select(F.col("node").alias("rep"), "set").hint("merge"), "rep").groupBy("key", "x", "y").applyInPandas(check, "a long, b long").distinct())


def near_classes(docs: DataFrame, rule: Rule, key: str, text_col: str = "text") -> DataFrame:
    """key, n_shingles and class (the smallest key reachable; its own for an empty set) of every row; `key` tells rows apart."""
    sig = cut(signatures(docs, rule, key, text_col))
    least = F.min(F.struct("doc_id", "regs"))
    classes = cut(sig.filter("n_shingles > 0").groupBy("k1", "k2").agg(least.alias("least"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows")).select("k1", "k2", "n", "rows", F.col("least.doc_id").alias("rep"), F.col("least.regs").alias("regs")))
    slices = F.array(*[F.xxhash64(F.lit(k), F.substring("regs", 2 * rule.rows * k + 1, 2 * rule.rows)) for k in range(rule.bands)])
    bands = classes.select("rep", F.posexplode(slices).alias("band", "key"))
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = cut_small(salted_lookup(bands, sizes, ["key"], F.col("rep"), "inner").select("rep", "band", "key", "size"))
    near = shared.groupBy("rep").agg(F.sum("size").alias("near"))  # the middle of a family shares the most
    leaders = shared.join(near.hint("shuffle_hash"), "rep").groupBy("key").agg(F.max(F.struct("near", F.xxhash64("rep", "key").alias("h"), "rep")).alias("lead")).select("key", F.col("lead.rep").alias("leader"))
    stars = salted_lookup(shared, leaders, ["key"], F.col("rep"), "inner").filter("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    first, n = cut_counted(likely(stars, classes, rule))
    tried = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    held = sets_of(docs, shared.select(F.col("rep").alias("node")), rule, key, text_col)
    links, n_links = verified(first, n, held.rows, rule)
    labels = components(links, n_links)
    more, n = cut_counted(nearest_pairs(open_rows(shared, labels), classes, rule).join(tried, ["a", "b"], "left_anti"))
    if n:
        found, n = verified(more, n, held.rows, rule)
        links, n_links = links.unionByName(found), n_links + n
        labels = components(links, n_links) if n else labels
    last, n = remaining_links(open_rows(shared, labels), classes, held.rows, rule)
    held.drop()
    if n:
        labels = components(links.unionByName(last), n_links + n)
    named = classes.join(labels, F.col("rep") == F.col("node"), "left").withColumn("class", F.coalesce("component", "rep")).filter("rows > 1 or class <> rep").select("k1", "k2", "class")
    out = salted_lookup(sig.select("doc_id", "n_shingles", "k1", "k2"), named, ["k1", "k2"], F.col("doc_id"))
    mine = F.when(F.col("n_shingles") > 0, F.col("class"))
    return out.select(F.col("doc_id").alias("key"), "n_shingles", F.coalesce(mine, "doc_id").alias("class"))


def near_components(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs`."""
    keyed, key, plain = with_keys(docs, id_col)
    found = near_classes(keyed, rule, key, text_col)
    if plain:
        return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("class").alias("component_id"), (F.col("key") == F.col("class")).alias("kept"))
    found = cut(found.join(keyed.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("doc_id")), "key"))
    least = found.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    out = salted_lookup(found, least, ["class"], F.col("key"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near duplicates: one row of each component stays, the one of the smallest key."""
    keyed, key, _ = with_keys(docs, id_col)
    dropped = near_classes(keyed, rule, key, text_col).filter("key <> class").select(F.col("key").alias(key))
    return keyed.join(dropped.hint("shuffle_hash"), key, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), Rule(width=3, percent=85))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(doc, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc
), c AS (SELECT doc, min(root) AS root FROM r GROUP BY doc)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc = d.doc_id
"""
