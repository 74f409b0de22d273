"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's target is its weight's share of all words, held at `cap` times its size, the excess
reshared. A source's documents lie in blocks by a hash; a pass over the source takes every block
once, and the last pass takes blocks in a permuted order until the target is met, the document at
the edge in part. The exact number of block draws of every source is then split among the output
shards: a binary tree halves a node's draws by a multivariate-hypergeometric draw of how many of
each source go left. Shards draw disjoint stretches of each source's permuted blocks, a document is
taken by the shards that draw its block, and shards shuffle their rows locally by a hash. All of it
is Spark SQL functions, and every draw comes from hashes of the seed and of what the rows hold, so
reruns agree however the input is laid out.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; where
all sizes are 0 nothing is taken; rows that repeat a doc_id or have none are mixed as rows of their
own, equal ones told apart by a running number; extra columns are ignored; an empty table gives no
rows. Blocks of a source are bounded; the sources' quotas must fit one row (a few hundred thousand).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandel.llm.common import cut, cut_counted, cut_small, lookup, table, with_keys
from strandel.llm.exprs import let, sum_of, word_count

WEIGHTS = (5, 2, 1)
CAP = 3.0
SEED = 20_240_517
BLOCK_DOCS, MOST_BLOCKS = 256, 65_536
#: Block draws of a shard.
SHARD_DRAWS = 64


def _unit(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from a hash."""
    return (F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, src (a key without nulls), size, h (the text's hash) and rank (among equal rows) of every row."""
    source, text = F.col(source_col).cast("string"), F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("src"), word_count(text).alias("size"), F.xxhash64(text).alias("h"))
    alike = rows.groupBy("doc_id", "src", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    return alike.select("doc_id", "src", "size", "h", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("rank"))


def running(rows: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """`rows` with each sum over all rows up to and with their own in `order`; one row a range meets in one task."""
    dealt = cut(rows.select(*rows.columns, *[c.alias(f"_{k}") for k, c in sums.items()]).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums]).select("_range", *[F.coalesce(F.sum(f"_{k}").over(ahead), F.lit(0)).alias(f"_{k}_ahead") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(ranges), "_range").select(*rows.columns, *[(F.col(f"_{k}_ahead") + F.sum(f"_{k}").over(inside)).alias(k) for k in sums])


def targets(rows: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """src, source_size, docs, target: shares by weight, held at the cap, the excess reshared.

    Every source gets level * weight, or its cap where that is less. In the order of cap / weight the
    level is that of the first source whose share of what the ones before leave over is within its cap.
    """
    sources = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    placed = running(sources, ["src"], place=F.lit(1).cast("long"))
    weighed = placed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))).withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    upto = cut_small(running(weighed, ["ratio", "src"], most_upto=F.col("most"), weight_upto=F.col("weight")), parts=1)
    total, all_weights = upto.agg(F.sum("source_size"), F.sum("weight")).first()
    left = lambda whole, c: F.lit(float(whole or 0)) - F.col(f"{c}_upto") + F.col(c)  # noqa: E731
    level = left(total, "most") / left(all_weights, "weight")
    settled = upto.select("ratio", "src", level.alias("level")).filter("level <= ratio").agg(F.min(F.struct("ratio", "src", "level")).alias("first")).first()["first"]
    return upto.select("src", "source_size", "docs", F.least(F.col("most"), F.lit(settled["level"] if settled else float("inf")) * F.col("weight")).alias("target"))


def hypergeometric(good: Column, total: Column, drawn: Column, unit: Column) -> Column:
    """How many of `good` among `total` fall in `drawn` draws without replacement, by inversion.

    Weights start at 1 in the mode and follow the ratio of neighbouring probabilities 9 standard
    deviations out, beyond which nothing is left at double precision.
    """
    up = lambda x, p: (p["k"] - x) * (p["m"] - x) / ((x + 1) * (p["n"] - p["k"] - p["m"] + x + 1))  # noqa: E731
    pair = lambda w, s: F.struct(w.alias("w"), s.alias("s"))  # noqa: E731
    steps = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))  # noqa: E731

    def invert(p: Column) -> Column:
        one = pair(F.lit(1.0), F.lit(0.0))
        above = F.aggregate(steps(p["mode"], p["high"] - 1), one, lambda a, x: let(a["w"] * up(x, p), lambda w: pair(w, a["s"] + w)))["s"]
        under = F.aggregate(steps(F.lit(1).cast("long"), p["mode"] - p["low"]), one, lambda a, i: let(a["w"] / up(p["mode"] - i, p), lambda w: pair(w, a["s"] + w)))
        state = lambda w, s, x: F.struct(w.alias("w"), s.alias("s"), x.alias("x"))  # noqa: E731

        def walk(q: Column) -> Column:
            goal = p["u"] * (q["above"] + q["under"]["s"] + 1)
            start = state(q["under"]["w"], q["under"]["w"], p["low"])
            return F.aggregate(steps(p["low"], p["high"] - 1), start, lambda a, x: F.when(a["s"] >= goal, a).otherwise(let(a["w"] * up(x, p), lambda w: state(w, a["s"] + w, x + 1))))["x"]

        return let(F.struct(above.alias("above"), under.alias("under")), walk)

    def bounds(p: Column) -> Column:
        mode = F.floor((p["m"] + 1) * (p["k"] + 1) / (p["n"] + 2))
        share = p["k"] / F.greatest(p["n"], F.lit(1))
        reach = (9 * F.sqrt(p["m"] * share * (1 - share)) + 12).cast("long")
        low, high = F.greatest(F.lit(0).cast("long"), p["m"] - (p["n"] - p["k"]), mode - reach), F.least(p["k"], p["m"], mode + reach)
        return let(F.struct(p["k"].alias("k"), p["n"].alias("n"), p["m"].alias("m"), p["u"].alias("u"), F.least(F.greatest(mode, low), high).alias("mode"), low.alias("low"), high.alias("high")), invert)

    given = F.struct(good.cast("long").alias("k"), total.cast("long").alias("n"), drawn.cast("long").alias("m"), unit.alias("u"))
    return let(given, bounds)


def split_quotas(quotas: DataFrame, levels: int) -> DataFrame:
    """src, shard, draws: the block draws `n` of every source split among 2 ** levels shards."""
    none = F.array().cast("array<struct<src:string,n:bigint>>")
    nodes = quotas.filter("n > 0").agg(F.array_sort(F.collect_list(F.struct("src", F.col("n").cast("long").alias("n")))).alias("own")).select(F.lit(0).cast("long").alias("node"), "own")

    def left_half(own: Column, node: Column) -> Column:
        total = F.aggregate(own, F.lit(0).cast("long"), lambda a, s: a + s["n"])
        state = lambda room, rest, out: F.struct(room.alias("room"), rest.alias("rest"), out.alias("out"))  # noqa: E731

        def take(a: Column, s: Column) -> Column:
            drawn = hypergeometric(s["n"], a["rest"], a["room"], _unit(F.lit("tree"), node, s["src"]))
            return let(drawn, lambda x: state(a["room"] - x, a["rest"] - s["n"], F.concat(a["out"], F.array(F.struct(s["src"].alias("src"), x.alias("n"))))))

        return let(total, lambda t: F.aggregate(own, state(F.floor(t / 2), t, none), take))["out"]

    for level in range(levels):
        tagged = nodes.withColumn("left", left_half(F.col("own"), F.col("node") + (1 << level)))
        right = F.zip_with("own", "left", lambda o, x: F.struct(o["src"].alias("src"), (o["n"] - x["n"]).alias("n")))
        both = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("own")), F.struct((2 * F.col("node") + 1).alias("node"), right.alias("own")))
        nodes = tagged.select(F.explode(both).alias("b")).select("b.node", F.filter("b.own", lambda s: s["n"] > 0).alias("own"))
        if level % 4 == 3:
            nodes = cut_small(nodes.repartition("node"))
    return nodes.select(F.col("node").alias("shard"), F.explode("own").alias("s")).select("s.src", "shard", F.col("s.n").alias("draws"))


def drawn_blocks(blocks: DataFrame, aims: DataFrame) -> DataFrame:
    """src, block and its draws (pass, shard, room): which shards draw a block, and of how many words where it is the last one.

    blocks: src, block, words.
    """
    permuted = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(SEED), F.lit("order"), "src", "block"), "block")  # MOST_BLOCKS rows at most
    lined = blocks.join(aims.select("src", "passes", "rest"), "src").withColumn("ends", F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, 0)))
    room = F.col("rest") - (F.col("ends") - F.col("words"))
    last = F.when(room > 0, F.struct(F.col("passes").cast("int").alias("pass"), F.when(room < F.col("words"), room).alias("room")))
    none = F.array().cast("array<struct<pass:int,room:bigint>>")
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(1).cast("int"), F.greatest(F.lit(1), F.col("passes").cast("int"))), lambda k: F.struct((k - 1).alias("pass"), F.lit(None).cast("long").alias("room")))).otherwise(none)
    taken = lined.select("src", "block", F.explode(F.concat(whole, F.when(last.isNotNull(), F.array(last)).otherwise(none))).alias("d")).select("src", "block", "d.pass", "d.room")
    turn = Window.partitionBy("src").orderBy("pass", F.xxhash64(F.lit(SEED), "pass", "src", "block"), "block")
    numbered = cut_small(taken.withColumn("place", F.row_number().over(turn) - 1))
    quotas = cut_small(numbered.groupBy("src").agg(F.count(F.lit(1)).alias("n")), parts=1)
    total = quotas.agg(F.sum("n")).first()[0] or 0
    starts = F.sum("draws").over(Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("draws")
    quota = split_quotas(quotas, max(3, (max(1, total) // SHARD_DRAWS).bit_length()))
    dealt = quota.withColumn("start", starts).select("src", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("draws") - 1)).alias("place"))
    return numbered.join(dealt, ["src", "place"]).groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "room"))).alias("draws"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The sources' targets, and every row with its draws (pass, shard, words, local_order), in the order of passes."""
    rows = cut(sized(docs, **columns))
    aims, n = cut_counted(targets(rows, weights, cap), parts=1)
    aims = (
        aims.withColumn("blocks", F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.greatest(F.lit(0).cast("long"), F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")))
    )
    block = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "h", "rank"), F.col("blocks"))
    blocked = lookup(rows, aims.select("src", "source_size", "target", "blocks"), n, ["src"], F.xxhash64("doc_id", "h")).withColumn("block", block)
    drawn = drawn_blocks(blocked.groupBy("src", "block").agg(F.sum("size").alias("words")), aims)
    edge = Window.partitionBy("src", "block").orderBy(F.xxhash64(F.lit(SEED), F.lit("edge"), "doc_id", "h", "rank"), "doc_id", "h", "size", "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.join(drawn, ["src", "block"], "left").withColumn("before", F.coalesce(F.sum("size").over(edge), F.lit(0)))

    def one(d: Column) -> Column:
        words = F.when(d["room"].isNull(), F.col("size")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), d["room"] - F.col("before"))))
        return F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), words.alias("words"), F.xxhash64(F.lit(SEED), F.lit("local"), d["shard"], "doc_id", "h", "rank", d["pass"]).alias("local_order"))

    draws = F.filter(F.transform(F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:bigint,room:bigint>>")), one), lambda d: d["words"] > 0)
    return aims, placed.select("doc_id", "src", "size", "h", "rank", "source_size", "target", draws.alias("draws"))


def words_of(draws: str = "draws") -> Column:
    return sum_of(F.transform(draws, lambda d: d["words"]))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """`docs` as the mix holds them: each row as often as it is drawn, whole when at least half its words are."""
    keyed, key, _ = with_keys(docs)
    _, rows = mix(keyed, weights, cap, id_col=key)
    copies = rows.select(F.col("doc_id").alias(key), F.round(words_of() / F.greatest("size", F.lit(1))).cast("int").alias(f"{key}n")).filter(F.col(f"{key}n") > 0)
    joined = keyed.join(copies.hint("shuffle_hash"), key)
    return joined.withColumn(f"{key}k", F.explode(F.sequence(F.lit(1), F.col(f"{key}n")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the shards that take a document with its places in their order."""
    _, rows = mix(table(spark, sf_dir, "documents"))
    each = lambda field: F.transform("draws", lambda d: d[field])  # noqa: E731
    return rows.select("doc_id", "size", "source_size", "target", words_of().alias("taken"), each("shard").alias("shards"), each("local_order").alias("local_orders"))


def target_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of the sources, and the words that the mix takes of each, to the word."""
    _, rows = mix(table(spark, sf_dir, "documents"))
    return rows.groupBy("src", "source_size", "target").agg(F.count(F.lit(1)).alias("docs"), F.sum(words_of()).alias("taken")).select(F.expr("case when src like '0%' then substr(src, 2) end").alias("source"), "docs", "source_size", F.round("target", 3).alias("target"), "taken")


TARGET_ORACLE = rf"""
WITH RECURSIVE s AS (SELECT source, count(*) AS docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+'))) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM s),
r(step, level) AS (
  SELECT 0, (SELECT CAST(sum(size) AS DOUBLE) / sum(weight) FROM w)
  UNION ALL SELECT step + 1, (SELECT ((SELECT sum(size) FROM w) - coalesce(sum({CAP} * size) FILTER (WHERE level * weight > {CAP} * size), 0)) / sum(weight) FILTER (WHERE level * weight <= {CAP} * size) FROM w)
  FROM r WHERE step < (SELECT count(*) FROM w) AND level IS NOT NULL
), l AS (SELECT coalesce(max(level), 0) AS level FROM r)
SELECT source, docs, size AS source_size, round(CAST(least({CAP} * size, level * weight) AS DOUBLE), 3) AS target, CAST(round(least({CAP} * size, level * weight)) AS BIGINT) AS taken FROM w, l
"""
