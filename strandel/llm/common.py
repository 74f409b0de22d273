"""Session, lineage and skew helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read through Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "strandel-checkpoints"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def scratch_folder(spark: SparkSession, what: str) -> str:
    """The name of a new folder under the shared one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def give_back(spark: SparkSession) -> None:
    """Returns memory of work that is done to the system: the driver's Python, where the C library can, and its JVM."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    spark._jvm.java.lang.System.gc()


_CUTS: list[list[str]] = []


@contextlib.contextmanager
def passing_cuts(spark: SparkSession) -> Iterator[None]:
    """Deletes the checkpoints made inside once what was read from them is written elsewhere."""
    _CUTS.append([])
    try:
        yield
    finally:
        for folder in _CUTS.pop():
            remove(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: survives lost executors and ends the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    if _CUTS:
        held = done._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        _CUTS[-1] += [held.get()] if held.isDefined() else []
    return done


def cut_counted(df: DataFrame, rows: int = 100_000, parts: int | None = None) -> tuple[DataFrame, int]:
    """`cut` for results far smaller than the input, and their number of rows, counted as they are written.

    About `rows` rows a partition follow, so that rounds over few rows start few tasks and leave few
    files. The checkpoint itself is written by `parts` tasks, by default four for every core of the
    cluster; 0 leaves them as they are, for rows that hold texts.
    """
    seen = Observation()
    done = cut((df if parts == 0 else df.coalesce(parts or 4 * df.sparkSession.sparkContext.defaultParallelism)).observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return done.coalesce(max(1, -(-n // rows))), n


def cut_small(df: DataFrame, rows: int = 100_000, parts: int | None = None) -> DataFrame:
    return cut_counted(df, rows, parts)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts of single-byte characters take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def salted_lookup(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Equi-join in which one key of `left` may hold a large share of the rows.

    Each left row takes one of `salts` values from the hash of `spread`; `right`, which has
    one narrow row a key, is repeated once a salt. No row is dropped and none is doubled. Nothing is
    broadcast, however small a part looks; see `lookup` for sides of a known size.
    """
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(many.hint("shuffle_hash"), [*on, "_salt"], how).drop("_salt")


#: Most rows that are broadcast to be looked up (tens of bytes each); beyond that the join shuffles with salts.
BROADCAST_ROWS = 20_000


def lookup(left: DataFrame, right: DataFrame, n: int, on: list[str], spread: Column, how: str = "left") -> DataFrame:
    """Equi-join of `left` with the `n` narrow rows of `right`, one a key."""
    return left.join(F.broadcast(right), on, how) if n <= BROADCAST_ROWS else salted_lookup(left, right, on, spread, how)


class Bucketed:
    """Rows written once, bucketed and sorted by a key, so that later joins on the key neither shuffle nor sort them."""

    def __init__(self, rows: DataFrame, key: str) -> None:
        self.spark = rows.sparkSession
        self.folder, self.name = scratch_folder(self.spark, "bucketed"), f"bucketed_{uuid.uuid4().hex}"
        buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows.repartition(buckets, key).write.option("path", self.folder).bucketBy(buckets, key).sortBy(key).saveAsTable(self.name)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.folder)


def with_keys(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str, bool]:
    """`docs` with a column that tells its rows apart, and that column's name, and whether it is the id.

    Where no id is null or repeated it is the id. Else the rows of such ids get numbers under all
    ids, and the table is cut, so that the numbers stay the same however often it is read.
    """
    key = "_key"
    while key.lower() in (c.lower() for c in docs.columns):
        key += "_"
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    odd = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("id is null or n > 1").select("id")
    odd, n = cut_counted(odd)
    own = F.col(id_col).cast("long")
    if not n:
        return docs.withColumn(key, own), key, True
    floor = F.lit(min(ids.agg(F.min("id")).first()[0] or 0, 0)).cast("long")
    marked = salted_lookup(docs.withColumn(key, own), odd.filter("id is not null").select(F.col("id").alias(key), F.lit(True).alias(f"{key}odd")), [key], F.monotonically_increasing_id())
    number = floor - 1 - F.monotonically_increasing_id()
    return cut(marked.withColumn(key, F.when(own.isNull() | F.col(f"{key}odd").isNotNull(), number).otherwise(own)).select(*docs.columns, key)), key, False
