"""Window operators over ordered tracks: each takes a table with key columns and an order column.

Nothing here gathers a track on the driver; every operator is one or more windows partitioned by the
track's key, so tracks are processed in parallel and Catalyst shares one exchange between windows
with the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Jumps over this are bridged by interpolation.
BRIDGE_OVER = 1.6
EXCURSION_WINDOWS = (3, 5, 9, 15, 25)


def ordered(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def step_length(w: WindowSpec, x: str, y: str) -> Column:
    """Distance from the previous point, 0 for the first."""
    return F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))


def arclength(df: DataFrame, keys: list[str], order: str = "seq", x: str = "x", y: str = "y", out: str = "s") -> DataFrame:
    """Cumulative length along each track, from 0."""
    w = ordered(keys, order)
    return df.withColumn("_step", step_length(w, x, y)).withColumn(out, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def unit_normals(df: DataFrame, keys: list[str], order: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """nx, ny: central differences (one-sided at the ends) turned by a right angle; zero where the track stands still."""
    w = ordered(keys, order)

    def slope(c: str) -> Column:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    out = df.withColumn("_dx", slope(x)).withColumn("_dy", slope(y)).withColumn("_n", F.hypot("_dx", "_dy"))
    still = F.col("_n") < 1e-9
    return out.withColumn("nx", F.when(still, 0.0).otherwise(-F.col("_dy") / F.col("_n"))).withColumn("ny", F.when(still, 0.0).otherwise(F.col("_dx") / F.col("_n"))).drop("_dx", "_dy", "_n")


def split_runs(df: DataFrame, keys: list[str], jump: float, order: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """run: number of the stretch between jumps longer than `jump`, from 0."""
    w = ordered(keys, order)
    return df.withColumn("_jump", (step_length(w, x, y) > jump).cast("int")).withColumn("run", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_jump")


def bridge_jumps(df: DataFrame, keys: list[str], longest: float, order: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Adds points at equal steps of at most 1 where a jump lies in (BRIDGE_OVER, longest]; keeps `keys`, x, y and a new order."""
    w = ordered(keys, order)
    d = step_length(w, x, y)
    n = F.when((d > BRIDGE_OVER) & (d <= longest), F.ceil(d)).otherwise(F.lit(1)).cast("int")
    rows = df.withColumn("_n", n).withColumn("_px", F.lag(x).over(w)).withColumn("_py", F.lag(y).over(w)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    part = F.col("_k") / F.col("_n")
    between = lambda p, c: F.when(F.col("_k") == F.col("_n"), F.col(c)).otherwise(F.col(p) + (F.col(c) - F.col(p)) * part)
    out = rows.select(*keys, F.col(order).alias("_o"), "_k", between("_px", x).alias(x), between("_py", y).alias(y))
    return out.withColumn(order, (F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "_k")) - 1).cast("int")).drop("_o", "_k")


def densify(df: DataFrame, keys: list[str], step: float = 2.0, order: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Points at equal arclength, at most `step` apart; tracks of under two points or a step stay as they are.

    Each segment generates the grid points that fall on it, so no join to a grid is needed.
    """
    w, whole = ordered(keys, order), Window.partitionBy(*keys)
    a = arclength(df, keys, order, x, y).withColumn("_total", F.max("s").over(whole)).withColumn("_count", F.count(F.lit(1)).over(whole))
    a = a.withColumn("_s1", F.lead("s").over(w)).withColumn("_x1", F.lead(x).over(w)).withColumn("_y1", F.lead(y).over(w))
    kept = (F.col("_count") < 2) | (F.col("_total") < step)
    n = F.greatest(F.lit(2), (F.ceil(F.col("_total") / step) + 1).cast("int"))
    unit = F.col("_total") / (n - 1)
    first = F.ceil(F.col("s") / unit - 1e-9).cast("int")
    a = a.withColumn("_end", F.lead("_s1").over(w).isNull())
    last = F.when(F.col("_end"), n - 1).otherwise(F.ceil(F.col("_s1") / unit - 1e-9).cast("int") - 1)
    grid = F.when(kept, F.array(F.col(order).cast("int"))).when(F.col("_s1").isNotNull() & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    rows = a.withColumn("_unit", unit).withColumn("_kept", kept).withColumn("_g", F.explode(grid))
    at = F.least(F.greatest((F.col("_g") * F.col("_unit") - F.col("s")) / F.greatest(F.col("_s1") - F.col("s"), F.lit(1e-300)), F.lit(0.0)), F.lit(1.0))
    mixed = lambda c, c1: F.when(F.col("_kept"), F.col(c)).otherwise(F.col(c) + (F.col(c1) - F.col(c)) * at)
    return rows.select(*keys, F.col("_g").alias(order), mixed(x, "_x1").alias(x), mixed(y, "_y1").alias(y))


def smooth(df: DataFrame, keys: list[str], window: int, order: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Moving average over an odd window with the end values repeated outside; both ends stay in place."""
    width = max(3, int(round(window)) | 1)
    half, w, whole = width // 2, ordered(keys, order), Window.partitionBy(*keys)
    rn, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    span = w.rowsBetween(-half, half)
    out = df.withColumn("_i", rn).withColumn("_n", n)
    for c in (x, y):
        low, high = F.greatest(F.lit(0), half - (F.col("_i") - 1)), F.greatest(F.lit(0), half - (F.col("_n") - F.col("_i")))
        ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        mean = (F.sum(c).over(span) + low * F.first(c).over(ends) + high * F.last(c).over(ends)) / width
        out = out.withColumn(f"_{c}", F.when((F.col("_n") < 3) | (F.col("_i") == 1) | (F.col("_i") == F.col("_n")), F.col(c)).otherwise(mean))
    return out.drop(x, y, "_i", "_n").withColumnRenamed(f"_{x}", x).withColumnRenamed(f"_{y}", y)


def gaussian(df: DataFrame, keys: list[str], sigma: float, columns: list[str], order: str = "seq") -> DataFrame:
    """Gaussian smoothing along each track (4 sigma, end values repeated outside)."""
    import math

    half = int(4 * sigma + 0.5)
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    taps = [t / sum(taps) for t in taps]
    w = ordered(keys, order)
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df
    for c in columns:
        terms = [F.lit(t) * F.coalesce(F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) if k else F.col(c), (F.first(c) if k < 0 else F.last(c)).over(ends)) for k, t in zip(range(-half, half + 1), taps, strict=True)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out = out.withColumn(f"_{c}", total)
    return out.drop(*columns).withColumnsRenamed({f"_{c}": c for c in columns})


def resample(df: DataFrame, keys: list[str], sigma: float, order: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Unit-step resampling of runs of length 2 or more, with normals of the smoothed axis; rows without a key are left out.

    The smoothed axis stands beside the points, so the grid is made once and never joined to itself.
    """
    w = ordered(keys, order)
    a = arclength(df.dropna(subset=keys), keys, order, x, y).withColumn("_s1", F.lead("s").over(w)).withColumn("_x1", F.lead(x).over(w)).withColumn("_y1", F.lead(y).over(w)).withColumn("_total", F.max("s").over(Window.partitionBy(*keys)))
    last = F.lead("_s1").over(w).isNull()
    a = a.withColumn("_last", last).filter("_s1 is not null and _total >= 2")
    top = F.when(F.col("_last"), F.floor(F.col("_total") + 1e-9)).otherwise(F.ceil("_s1") - 1).cast("int")
    rows = a.withColumn("_g", F.explode(F.when(F.ceil("s").cast("int") <= top, F.sequence(F.ceil("s").cast("int"), top)).otherwise(F.array().cast("array<int>"))))
    at = (F.col("_g") - F.col("s")) / F.greatest(F.col("_s1") - F.col("s"), F.lit(1e-300))
    along = lambda c, c1: F.col(c) + (F.col(c1) - F.col(c)) * at
    grid = rows.select(*keys, F.col("_g").alias(order), along(x, "_x1").alias(x), along(y, "_y1").alias(y), along(x, "_x1").alias("_ax"), along(y, "_y1").alias("_ay"))
    return unit_normals(gaussian(grid, keys, max(0.6, sigma), ["_ax", "_ay"], order), keys, order, "_ax", "_ay").select(*keys, order, x, y, "nx", "ny")


def effective_size(df: DataFrame, keys: list[str], value: str, order: str = "seq", most_lag: int = 40) -> DataFrame:
    """n_eff: n over the autocorrelation time, summed over lags up to the first that is not positive.

    All lags come from one window pass (lead by k), so a track is never joined to itself.
    """
    w, whole = ordered(keys, order), Window.partitionBy(*keys)
    centred = df.withColumn("_d", F.col(value) - F.avg(value).over(whole))
    lags = [(F.col("_d") * F.lead("_d", k).over(w)).alias(f"_l{k}") for k in range(1, most_lag + 1)]
    sums = centred.select(*keys, "_d", *lags).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_v"), F.array(*[F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)) for k in range(1, most_lag + 1)]).alias("_c"))
    used = F.slice("_c", F.lit(1), F.greatest(F.lit(1), F.least(F.floor(F.col("n") / 2).cast("int"), F.lit(most_lag))))
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(True).alias("on"))
    total = F.aggregate(used, state, lambda a, c: F.when(a["on"] & (c / F.col("_v") > 0), F.struct((a["sum"] + c / F.col("_v")).alias("sum"), F.lit(True).alias("on"))).otherwise(F.struct(a["sum"].alias("sum"), F.lit(False).alias("on"))))["sum"]
    n = F.col("n").cast("double")
    eff = F.when((F.col("n") < 8) | (F.col("_v") <= 0), n).otherwise(F.greatest(F.lit(1.0), n / F.greatest(F.lit(1.0), 1 + 2 * total)))
    return sums.select(*keys, "n", eff.alias("n_eff"))


def noise_split(df: DataFrame, keys: list[str], place: str, value: str, order: str = "seq", most_gap: float = 3.0) -> DataFrame:
    """sigma_noise from close neighbours' differences, sigma_real from what is left; null where too few."""
    w = ordered(keys, order)
    d = df.withColumn("_d", F.when(F.col(place) - F.lag(place).over(w) <= most_gap, F.col(value) - F.lag(value).over(w)))
    mid = d.withColumn("_md", F.median("_d").over(Window.partitionBy(*keys))).withColumn("_mv", F.median(value).over(Window.partitionBy(*keys)))
    g = mid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("_d").alias("n_near"), F.median(F.abs(F.col("_d") - F.col("_md"))).alias("_nd"), F.median(F.abs(F.col(value) - F.col("_mv"))).alias("_nv"))
    ok = (F.col("n") >= 8) & (F.col("n_near") >= 6)
    noise, total = 1.4826 * F.col("_nd") / F.sqrt(F.lit(2.0)), 1.4826 * F.col("_nv")
    return g.select(*keys, "n", F.when(ok, noise).alias("sigma_noise"), F.when(ok, F.sqrt(F.greatest(F.lit(0.0), total * total - noise * noise))).alias("sigma_real"))


def excursion(df: DataFrame, keys: list[str], value: str, sigma: str, order: str = "seq", windows: tuple = EXCURSION_WINDOWS) -> DataFrame:
    """The largest departure of a window's median from the track's level in standard errors: z, place, width."""
    w, whole = ordered(keys, order), Window.partitionBy(*keys)
    base = df.withColumn("_i", (F.row_number().over(w) - 1).cast("int")).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_level", F.median(value).over(whole))
    cells = []
    for width in windows:
        half = width // 2
        roll = F.percentile(value, 0.5).over(w.rowsBetween(-half, half))
        se = F.greatest(1.2533 * F.col(sigma) / F.sqrt(F.lit(float(width))), F.lit(1e-6))
        inside = (F.col("_n") >= width) & (F.col("_i") >= half) & (F.col("_i") < F.col("_n") - half)
        cells.append(F.struct(F.when(inside, F.abs(roll - F.col("_level")) / se).alias("z"), F.lit(-width).alias("w"), (-F.col("_i")).alias("i")))
    ok = (F.col("_n") >= 6) & (F.col(sigma) > 1e-6)
    best = base.select(*keys, ok.alias("_ok"), F.array(*cells).alias("_cells")).select(*keys, "_ok", F.explode("_cells").alias("c")).filter("_ok and c.z > 0").groupBy(*keys).agg(F.max("c").alias("c"))
    return best.select(*keys, F.col("c.z").alias("z"), (-F.col("c.i")).cast("int").alias("place"), (-F.col("c.w")).cast("int").alias("width"))


def largest_step(df: DataFrame, keys: list[str], place: str, value: str, order: str = "seq", side: int = 4) -> DataFrame:
    """The largest difference of the medians before and after a point, with at least `side` points each side."""
    w, whole = ordered(keys, order), Window.partitionBy(*keys)
    before = F.percentile(value, 0.5).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.percentile(value, 0.5).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_d", F.abs(before - after))
    inside = (F.col("_i") >= side) & (F.col("_i") <= F.col("_n") - side)
    best = d.filter("_n >= %d" % (2 * side)).groupBy(*keys).agg(F.max(F.when(inside, F.struct(F.col("_d").alias("d"), (-F.col("_i")).alias("o"), F.col(place).alias("at")))).alias("b"))
    return best.select(*keys, F.col("b.d").alias("step"), F.when(F.col("b.d") > 0, F.col("b.at")).alias("at"))
