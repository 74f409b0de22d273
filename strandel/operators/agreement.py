"""Agreement of two groupings of the same items, and votes that assign items to groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def positive_pairs(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Number of pairs of items in the same group (null groups have none)."""
    sizes = df.filter(F.col(group).isNotNull()).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(*keys).agg(F.sum(_pairs(F.col("_n"))).alias("n_pairs"))


def pairwise_agreement(df: DataFrame, keys: list[str], item: str, truth: str, found: str) -> DataFrame:
    """Pair counts, precision, recall, F1, adjusted Rand index and variation of information in bits.

    Items without a group stand alone. Every sum comes from group sizes, two aggregations deep, so no
    pair is ever listed; the sizes combine map-side and a hot group costs one row.
    """
    alone = lambda c, tag: F.coalesce(F.concat(F.lit("g"), F.col(c).cast("string")), F.concat(F.lit(tag), F.col(item).cast("string")))
    named = df.select(*keys, F.col(truth).alias("_rt"), F.col(found).alias("_rf"), alone(truth, "t").alias("_t"), alone(found, "f").alias("_f"))
    cells = named.groupBy(*keys, "_t", "_f").agg(F.count(F.lit(1)).alias("_n"), F.max("_rt").alias("_rt"), F.max("_rf").alias("_rf"))
    log_n = lambda n: F.sum(n * F.log2(n.cast("double")))
    n = F.col("_n")
    joint = cells.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(_pairs(n)).alias("tp"), log_n(n).alias("_hj"))
    rows = cells.groupBy(*keys, "_t").agg(F.sum(n).alias("_n"), F.max("_rt").alias("_r")).groupBy(*keys).agg(F.sum(_pairs(n)).alias("_st"), log_n(n).alias("_ht"), F.count("_r").alias("n_truth"))
    cols = cells.groupBy(*keys, "_f").agg(F.sum(n).alias("_n"), F.max("_rf").alias("_r")).groupBy(*keys).agg(F.sum(_pairs(n)).alias("_sf"), log_n(n).alias("_hf"), F.count("_r").alias("n_found"))
    g = joint.join(rows, keys).join(cols, keys)
    tp, st, sf, size = (F.col(c) for c in ("tp", "_st", "_sf", "n"))
    precision, recall = F.when(sf > 0, tp / sf), F.when(st > 0, tp / st)
    f1 = F.when(precision.isNotNull() & recall.isNotNull(), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0))
    expected = F.when(size > 1, st * sf / _pairs(size)).otherwise(0.0)
    spread = 0.5 * (st + sf) - expected
    enough, one = size >= 2, size == 1
    return g.select(
        *keys, size.cast("long").alias("n"), F.col("n_truth"), F.col("n_found"), tp.alias("tp"), (sf - tp).alias("fp"), (st - tp).alias("fn"),
        F.when(enough, precision).alias("precision"), F.when(enough, recall).alias("recall"), F.when(enough, f1).alias("f1"),
        F.when(enough, F.when(spread != 0, (tp - expected) / spread).otherwise(1.0)).when(one, 1.0).alias("ari"),
        F.when(enough | one, (F.col("_ht") - F.col("_hj")) / size + 0.0).alias("vi_split"), F.when(enough | one, (F.col("_hf") - F.col("_hj")) / size + 0.0).alias("vi_merge"),
    )


def vote(df: DataFrame, item: list[str], group: str, least_share: float = 0.3) -> DataFrame:
    """Each item's group of most rows (ties: the lowest), kept if it holds `least_share` of the item's rows, else null."""
    counts = df.groupBy(*item, group).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*item).agg(F.sum("_n").alias("n"), F.max("_n").alias("votes")).join(counts, item)
    won = best.filter(F.col("_n") == F.col("votes")).groupBy(*item).agg(F.first("n").alias("n"), F.first("votes").alias("votes"), F.min(group).alias("_g"))
    return won.select(*item, "n", "votes", F.when(F.col("votes") >= least_share * F.col("n"), F.col("_g")).alias("assigned"))


def assign_fragments(fragments: DataFrame, instances: DataFrame, least_share: float = 0.3, reach: float = 6.0) -> DataFrame:
    """frag_id -> iid (0: none). Votes count every instance over a pixel; the fallback looks `reach` pixels around.

    fragments(scene_id, frag_id, r, c), instances(scene_id, iid, r, c): instances may overlap. For the
    fallback a pixel under several instances counts for the largest, and each fragment pixel takes its
    nearest instance pixel, tile by tile.
    """
    from strandel.operators.pixels import nearest_label

    at = ["scene_id", "r", "c"]
    sizes = fragments.groupBy("scene_id", "frag_id").agg(F.count(F.lit(1)).alias("n"))
    hits = fragments.join(instances.distinct(), at).groupBy("scene_id", "frag_id", "iid").agg(F.count(F.lit(1)).alias("hits"))
    top = hits.groupBy("scene_id", "frag_id").agg(F.max(F.struct("hits", (-F.col("iid")).alias("_o"))).alias("b")).select("scene_id", "frag_id", F.col("b.hits").alias("hits"), (-F.col("b._o")).alias("iid"))
    voted = sizes.join(top, ["scene_id", "frag_id"], "left").withColumn("iid", F.when(F.col("hits") >= least_share * F.col("n"), F.col("iid")))
    area = instances.groupBy("scene_id", "iid").agg(F.count(F.lit(1)).alias("area"))
    owner = instances.join(area, ["scene_id", "iid"]).groupBy(*at).agg(F.max(F.struct("area", (-F.col("iid")).alias("_o"))).alias("b")).select(*at, (-F.col("b._o")).alias("label"))
    lost = fragments.join(voted.filter("iid is null").select("scene_id", "frag_id"), ["scene_id", "frag_id"], "left_semi")
    nearest = nearest_label(lost, owner, ["scene_id"], reach).filter("near is not null")
    fallback = vote(nearest, ["scene_id", "frag_id"], "near", 0.0).select("scene_id", "frag_id", F.col("assigned").cast("int").alias("fallback"))
    return voted.join(fallback, ["scene_id", "frag_id"], "left").select("scene_id", "frag_id", F.coalesce("iid", "fallback", F.lit(0)).alias("iid"))


def micro_f1(df: DataFrame, keys: list[str]) -> DataFrame:
    """F1 of summed tp, fp, fn; 0 where there is nothing to count."""
    g = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    down = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return g.withColumn("f1", F.when(down > 0, 2 * F.col("tp") / down).otherwise(0.0))


def best_trials(df: DataFrame, score: str, trial: str, most: int) -> DataFrame:
    """The `most` trials of the highest score, the lower trial first among equals (a report by design)."""
    return df.orderBy(F.desc(score), F.asc(trial)).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(trial))).cast("int"))
