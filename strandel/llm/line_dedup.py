"""Line dedup over levelled sorted runs of line hashes, in Spark SQL functions alone.

The index keeps runs (line hash, number of documents): tables bucketed and sorted by the hash, in the
shared folder, so that merges and joins of runs neither shuffle nor sort. Batches come one after the
other; each is read and counted by itself, combined map-side. Its hashes are merge-joined to the
runs: those the runs do not hold (anti join) make the batch's own run, the others its increments.
FAN_IN runs of a level are compacted into one of the next. What the runs then count in enough
documents is dropped from every document: in place where the hashes are few, else by the places
that a join finds.

Defined results: a null or empty text is one empty line; keys shorter than min_chars are never
dropped; a text whose lines all go is empty; rows that repeat a doc_id or have none count as
documents of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandel.llm.common import Bucketed, ascii_lower, cut_counted, salted_lookup, table
from strandel.llm.exprs import BLANKS, let

BATCHES = 4
FAN_IN = 3
#: Most hot hashes that are looked up in place, as a set of constants (8 bytes each); beyond that a join finds them.
HASHES_IN_PLACE = 10_000


def line_hashes(text: Column, min_chars: int) -> Column:
    """For every line the hash of its key, or null where the key is too short to be dropped."""
    keys = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(keys, lambda x: let(F.btrim(x, F.lit(BLANKS)), lambda k: F.when(F.length(k) >= min_chars, F.xxhash64(k))))


class LineRuns:
    """Levelled runs of line hashes; `add` a batch of (hash, n), read `counts`, `drop` when done."""

    def __init__(self, fan_in: int = FAN_IN) -> None:
        self.fan_in, self.levels = fan_in, [[]]

    def _write(self, rows: DataFrame) -> Bucketed:
        return Bucketed(rows.select("hash", "n"), "hash")

    def _merged(self, runs: list[Bucketed]) -> DataFrame:
        """Runs merged pair by pair. (A union of bucketed tables must not be grouped: Spark 4.1 then skips the exchange though the parts of a union are not dealt alike.)"""
        out = runs[0].rows
        for run in runs[1:]:
            more = run.rows.withColumnRenamed("n", "more")
            out = out.join(more, "hash", "full_outer").select("hash", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("n"))
        return out

    @property
    def runs(self) -> list[Bucketed]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Adds the hashes the runs do not hold as a run of their own, and counts for the others."""
        own = self._write(batch)
        made, fresh = [], own.rows
        for run in self.runs:
            fresh = fresh.join(run.rows.select("hash"), "hash", "left_anti")
        if self.runs:
            made = [self._write(fresh)]
            made.append(self._write(own.rows.join(made[0].rows.select("hash"), "hash", "left_anti")))
            own.drop()
        self.levels[0] += made or [own]
        self._compact()

    def _compact(self) -> None:
        for k in range(64):
            if k >= len(self.levels) or len(self.levels[k]) < self.fan_in:
                return
            merged = self._write(self._merged(self.levels[k]))
            for run in self.levels[k]:
                run.drop()
            self.levels[k] = []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(merged)

    def counts(self) -> DataFrame:
        return self._merged(self.runs)

    def drop(self) -> None:
        for run in self.runs:
            run.drop()
        self.levels = [[]]


def line_counts(batch: DataFrame, hashes: Column) -> DataFrame:
    """hash, n: in how many documents of a batch each key stands."""
    return batch.select(F.explode(F.array_distinct(F.filter(hashes, lambda h: h.isNotNull()))).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


def batches_of(docs: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """The rows of `docs` dealt into batches by a hash."""
    of = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(batches))
    return [docs.filter(of == k) for k in range(batches)]


def hot_hashes(batches: list[DataFrame], hashes: Column, min_docs: int) -> tuple[DataFrame, int]:
    """hash of every key that the runs count in at least `min_docs` documents, and how many there are."""
    runs = LineRuns()
    try:
        for batch in batches:
            runs.add(line_counts(batch, hashes))
        return cut_counted(runs.counts().filter(F.col("n") >= min_docs).select("hash"))
    finally:
        runs.drop()


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hashes = line_hashes(F.col("text"), min_chars)
    hot, n = hot_hashes(batches_of(rows), hashes, min_docs)
    return _in_place(rows, hashes, [r["hash"] for r in hot.collect()]) if n <= HASHES_IN_PLACE else _by_places(rows, hashes, hot)


def _finished(rows: DataFrame, kept: Column) -> DataFrame:
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    out = rows.select("doc_id", lines.alias("n_lines"), let(kept, lambda k: F.struct(F.size(k).cast("long").alias("n"), F.array_join(k, "\n").alias("text"))).alias("kept"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.col("kept.n")).alias("n_dropped"), F.col("kept.text").alias("kept_text"))


def _in_place(rows: DataFrame, hashes: Column, hot: list[int]) -> DataFrame:
    """The lines whose hash is not in a set of constants; no row moves."""
    lines = F.split("text", "\n", -1)
    if not hot:
        return _finished(rows, lines)
    marked = rows.select("doc_id", "text", hashes.alias("hashes"))
    gone = F.expr(f"transform(hashes, h -> coalesce(h in ({', '.join(map(str, hot))}), false))")
    return _finished(marked, let(F.struct(lines.alias("lines"), gone.alias("gone")), lambda s: F.filter(s["lines"], lambda _, k: ~s["gone"][k])))


def _by_places(rows: DataFrame, hashes: Column, hot: DataFrame) -> DataFrame:
    """The lines between the places of hot ones, which a join finds once for every distinct text."""
    key = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(5), "text").alias("t2")]
    spread = F.xxhash64("t1", "place")
    held = rows.select(*key, F.posexplode(hashes).alias("place", "hash")).filter("hash is not null")
    found = salted_lookup(held, hot, ["hash"], spread, "inner").groupBy("t1", "t2").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    joined = salted_lookup(rows.select("doc_id", "text", *key), found, ["t1", "t2"], F.col("doc_id"))
    lines = F.split("text", "\n", -1)
    ends = lambda s: F.concat(F.array(F.lit(-1)), s["gone"], F.array(F.size(s["lines"])))
    between = lambda s: let(ends(s), lambda e: F.flatten(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.slice(s["lines"], e[k - 1] + 2, e[k] - e[k - 1] - 1))))
    return _finished(joined, F.when(F.col("gone").isNull(), lines).otherwise(let(F.struct(lines.alias("lines"), F.col("gone").alias("gone")), between)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.k = hot.k GROUP BY doc_id
"""
