"""Robust grouped statistics: scaled MAD, percentiles, pooled residual noise, bootstrap intervals."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAD_SCALE = 1.4826
BOOTSTRAP_SEED = 12_345


def beside(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with the one row of `facts` of its keys, null ones too; a window would gather a key's rows in one task."""
    named = facts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.lit(True))
    return df.join(named, same, "left").drop(*[f"_of_{k}" for k in keys])


def with_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return beside(df, df.groupBy(*keys).agg(F.median(value).alias(out)), keys)


def robust_sigma(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sigma = 1.4826 MAD per key, null under two values."""
    mid = with_median(df, keys, value, "_m")
    g = mid.groupBy(*keys).agg(F.count(value).alias("n"), F.median(F.abs(F.col(value) - F.col("_m"))).alias("_d"))
    return g.select(*keys, "n", F.when(F.col("n") >= 2, MAD_SCALE * F.col("_d")).alias("sigma"))


def spread(df: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """n, median, scaled MAD, the 16th and 84th and the 50th and 90th percentile; nulls under `least` values."""
    mid = with_median(df, keys, value, "_m")
    g = mid.groupBy(*keys).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.median(F.abs(F.col(value) - F.col("_m"))).alias("_d"), F.percentile(value, F.array(F.lit(0.16), F.lit(0.84), F.lit(0.9))).alias("_p"))
    keep = F.col("n") >= least
    return g.select(*keys, "n", *[F.when(keep, c).alias(a) for c, a in ((F.col("median"), "median"), (MAD_SCALE * F.col("_d"), "mad"), (F.col("_p")[0], "p16"), (F.col("_p")[1], "p84"), (F.col("_p")[2], "p90"))])


def pooled_noise(df: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """sigma of residuals about each part's own median, pooled over the parts of a key."""
    resid = with_median(df, [*keys, part], value, "_m").withColumn("_r", F.col(value) - F.col("_m"))
    return resid.groupBy(*keys).agg(F.count(value).alias("n"), F.median(F.abs("_r")).alias("_d")).withColumn("sigma", F.when(F.col("n") >= 2, MAD_SCALE * F.col("_d"))).select(*keys, "n", "sigma")


def quality_label(n: str, median: str, mad: str, weak_under: int = 12, weak_spread: float = 0.6):
    """good, weak or none from the number of values and their relative spread."""
    return F.when(F.col(median).isNull(), F.lit("none")).when((F.col(n) < weak_under) | (F.col(mad) > weak_spread * F.col(median)), F.lit("weak")).otherwise(F.lit("good"))


def impute_by_median(df: DataFrame, keys: list[str], value: str, default: float) -> DataFrame:
    """Missing values become the key's median, or `default` where none is known; `imputed` marks them."""
    rows = with_median(df, keys, value, "_m").withColumn("imputed", F.col(value).isNull())
    return rows.withColumn(value, F.coalesce(value, "_m", F.lit(default))).drop("_m")


def under_cap(df: DataFrame, keys: list[str], value: str, times: float = 2.0, least: int = 20) -> DataFrame:
    """`over_cap` where a value exceeds `times` the key's median, judged only with `least` values or more."""
    rows = beside(df, df.groupBy(*keys).agg(F.count(value).alias("_n"), F.median(value).alias("_m")), keys)
    return rows.withColumn("over_cap", (F.col("_n") >= least) & (F.col(value) > times * F.col("_m"))).drop("_n", "_m")


def refusals(found: DataFrame, keys: list[str], reason: str = "reason") -> DataFrame:
    """keys, refusals: how often each reason stands, as a map in the order of reasons; null reasons do not count."""
    counts = found.filter(F.col(reason).isNotNull()).groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("_k"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "_k")))).alias("refusals"))


def coverage_means(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """`by`, mean_ of each value and n: a benchmark's means for each value of `by`, and over all in the row without one."""
    return rows.rollup(by).agg(*[F.avg(v).alias(f"mean_{v}") for v in values], F.count(F.lit(1)).alias("n"))


def block_bootstrap(values: np.ndarray, block: int, repeats: int, seed: int, low: float = 5.0, high: float = 95.0) -> tuple[float | None, float | None]:
    """Percentile interval of the median when neighbours correlate: contiguous blocks are redrawn."""
    n = len(values)
    if block < 1 or n < block:
        return None, None
    blocks = -(-n // block)
    starts = np.random.default_rng(seed).integers(0, n - block + 1, size=(repeats, blocks))
    picked = (starts[..., None] + np.arange(block)).reshape(repeats, blocks * block)[:, :n]
    low_, high_ = np.percentile(np.median(values[picked], axis=1), [low, high])
    return float(low_), float(high_)


def median_interval(df: DataFrame, keys: list[str], value: str, order: str, block: int = 5, repeats: int = 2_000, least: int = 8) -> DataFrame:
    """ci_low, ci_high of each key's median; the seed follows from the last key where that is an integer."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values(order)[value].to_numpy(float)
        seed = BOOTSTRAP_SEED + (int(key[-1]) if isinstance(key[-1], (int, np.integer)) else 0)
        low, high = block_bootstrap(x, block, repeats, seed) if len(x) >= least else (None, None)
        return pd.DataFrame([[*key, low, high]], columns=[*keys, "ci_low", "ci_high"])

    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", ci_low double, ci_high double")
