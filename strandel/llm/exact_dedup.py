"""Exact deduplication against immutable snapshots screened by static binary fuse filters.

A snapshot is written once and never changed: the distinct digests already held, split into hash
buckets, and one static filter a bucket. It is opened by its folder. A new batch is first grouped by
itself (its own duplicates meet there, after map-side combining), then its distinct digests are
screened by the filter of their bucket. Only positives are joined to the snapshot's exact digests, and
every group that then has two rows or more is checked byte for byte on the normalised texts.

Defined results: a null text equals the empty text; texts are equal when identical after
lower-casing A-Z only; the largest doc_id of a group stays; rows that repeat a doc_id count as
rows of their group, each by its own text, and share its verdict; an empty table gives an empty
result; a row without a doc_id counts in its group and stays only where no row of it has one; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandel.llm import fuse_filter
from strandel.llm.common import ascii_lower, cut, cut_counted, cut_small, lookup, remove, salted_lookup, scratch_folder, table, with_keys
from strandel.llm.words import slices

ROWS_PER_BUCKET = 16_384
#: A group's members are compared in shares of about this many rows.
MEMBERS_PER_SHARE = 1_000
#: Texts a partition of those that are compared.
TEXT_ROWS = 5_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [hashlib.sha256((x or b"").lower()).digest() for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, digest binary")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("n_null"))


def _keys(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in column), "<u8")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


class Snapshot:
    """An immutable set of digests (digest, keep_id, n, n_null) and their filters, in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        """Opens what `write` left in `folder`."""
        self.folder = folder
        self.exact = spark.read.schema("digest binary, keep_id long, n long, n_null long").parquet(f"{folder}/exact")
        self.filters = spark.read.schema("bucket int, buckets int, filter binary").parquet(f"{folder}/filters")

    @staticmethod
    def write(rows: DataFrame, folder: str) -> Snapshot:
        """Groups the digests of `rows` (doc_id, digest) and builds their filters."""
        spark = rows.sparkSession
        exact, n = cut_counted(_grouped(rows))
        buckets = max(1, -(-n // ROWS_PER_BUCKET))
        exact.write.parquet(f"{folder}/exact")

        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bucket": [key[0]], "buckets": [buckets], "filter": [fuse_filter.build(_keys(part.digest))]})

        held = spark.read.schema("digest binary").parquet(f"{folder}/exact")
        held.select(_bucket(buckets), "digest").groupBy("bucket").applyInPandas(run, "bucket int, buckets int, filter binary").write.parquet(f"{folder}/filters")
        return Snapshot(spark, folder)

    def screen(self, batch: DataFrame) -> DataFrame:
        """`batch` (digest, keep_id, n, n_null) with `maybe`: False where its bucket's filter excludes the digest."""

        def run(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            rows["maybe"] = fuse_filter.probe(held["filter"].iloc[0], _keys(rows.digest)) if len(held) and len(rows) else False
            return rows[["digest", "keep_id", "n", "n_null", "maybe"]]

        first = self.filters.select("buckets").first()
        rows = batch.select(_bucket(first[0] if first else 1), *batch.columns)
        return rows.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInPandas(run, "digest binary, keep_id long, n long, n_null long, maybe boolean")

    def groups(self, batch: DataFrame) -> DataFrame:
        """digest, keep_id, n, n_null of every group of the snapshot and the rows of `batch` together."""
        seen = cut_small(self.screen(_grouped(batch)))
        old = self.exact.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"), F.col("n_null").alias("old_null"))
        positives = cut_small(seen.filter("maybe").join(old, "digest", "left"))
        sums = [F.greatest("keep_id", "old_id").alias("keep_id"), *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n", "old_n"), ("n_null", "old_null"))]]
        met = positives.filter(F.col("old_n").isNotNull()).select("digest")
        untouched = self.exact.join(met, "digest", "left_anti").select("digest", "keep_id", "n", "n_null")
        return positives.select("digest", *sums).unionByName(seen.filter(~F.col("maybe")).drop("maybe")).unionByName(untouched)


def byte_mismatches(docs: DataFrame, groups: DataFrame, n_groups: int, id_col: str, text_col: str) -> DataFrame:
    """digest, doc_id, variant of rows of `groups` whose normalised text differs from that of the row that stays."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(ascii_lower(text), 256)).alias("digest"))
    members = groups.select("digest", "keep_id", "n")
    with_text = cut_small(lookup(texts, members, n_groups, ["digest"], F.col("doc_id"), "inner"), TEXT_ROWS, 0)
    shares = F.ceil(F.col("n") / MEMBERS_PER_SHARE).cast("int")
    kept = with_text.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("kept_text"), F.max(shares).alias("shares")).select("digest", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "kept_text")
    pairs = with_text.withColumn("share", F.pmod(F.xxhash64("doc_id", "text"), shares)).join(kept, ["digest", "share"])
    same = (F.col("text") == F.col("kept_text")) | (ascii_lower(F.col("text")) == ascii_lower(F.col("kept_text")))
    return pairs.filter(~same).select("digest", "doc_id", F.sha2(ascii_lower(F.col("text")), 512).alias("variant"))


def exact_dedup(docs: DataFrame, snapshot_rows=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    snapshot_rows: a condition on doc_id that marks the rows of the immutable snapshot, which is
    written to the shared folder and opened again; the others are the incoming batch. By default half
    of the rows by hash are the snapshot.
    """
    spark = docs.sparkSession
    old = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if snapshot_rows is None else snapshot_rows
    rows = cut(digests(docs, id_col, text_col).withColumn("old", F.coalesce(old, F.lit(False))))
    folder = scratch_folder(spark, "digests")
    Snapshot.write(rows.filter("old"), folder)
    groups, n = cut_counted(Snapshot(spark, folder).groups(rows.filter("not old")).filter("n > 1 or n_null > 0"))
    remove(spark, folder)
    odd, n_odd = cut_counted(byte_mismatches(docs, groups.filter("n > 1"), n, id_col, text_col))
    if n_odd:  # equal digests of unequal bytes: those groups fall apart by their bytes' wider digest
        return _apart(docs, odd, id_col, text_col)
    known = lookup(rows.filter("doc_id is not null").select("doc_id", "digest"), groups.select("digest", "keep_id", "n"), n, ["digest"], F.col("doc_id"))
    nameless = groups.filter("n_null > 0").select(F.lit(None).cast("long").alias("doc_id"), "digest", "keep_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_null")))).drop("col")
    return _verdicts(known.unionByName(nameless))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without exact copies: one row of each group stays, the one of the largest key."""
    keyed, key, _ = with_keys(docs, id_col)
    dropped = exact_dedup(keyed, id_col=key, text_col=text_col).filter("not kept").select(F.col("doc_id").alias(key))
    return keyed.join(dropped.hint("shuffle_hash"), key, "left_anti").select(*docs.columns)


def _verdicts(rows: DataFrame) -> DataFrame:
    keep = F.coalesce("keep_id", "doc_id")
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _apart(docs: DataFrame, odd: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Verdicts where a digest stands for several texts: rows of such digests are grouped by a wider one as well."""
    split = odd.select("digest").distinct().withColumn("split", F.lit(True))
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.sha2(text, 512).alias("wide"))
    wide = cut(salted_lookup(every, split, ["digest"], F.col("doc_id")).select("doc_id", "digest", F.when(F.col("split"), F.col("wide")).otherwise(F.lit("")).alias("variant")))
    again = wide.groupBy("digest", "variant").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return _verdicts(salted_lookup(wide, again, ["digest", "variant"], F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY k) AS kept, sha256(k) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM documents)
"""
