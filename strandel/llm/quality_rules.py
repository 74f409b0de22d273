"""Quality rules whose cut-offs adapt to each language and source.

One pass measures every whole text. The measures go into mergeable quantile sketches, one a (language,
source): counts on a grid of buckets whose bounds grow by GROWTH, so that a quantile is known within
ERROR of its value (the published DDSketch). Counts add up exactly, so neither the order of rows nor a
repeated task changes a fence. A language's sketches are merged for sources with few texts, and the
whole corpus' where a language has few. Fences beyond the quartiles replace fixed cut-offs and are
joined back to the measures (one narrow row a language and source). Repeated words keep the fixed
cut-off of the base rule alone.

Defined results: a null or empty text has no words and fails the base rule; null language or
source is a group of its own; a group whose measures are all equal has fences set by the floors
in FENCES; repeated rows each get a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandel.llm.common import cut, cut_counted, cut_small, lookup, table
from strandel.llm.words import SPACE, groups, text_bytes, window_hashes, word_spans

#: measure: (side, least width of a quartile range, widths allowed beyond the quartile)
FENCES = {
    "symbol_ratio": ("upper", 0.010, 6.0),
    "caps_ratio": ("upper", 0.025, 8.0),
    "mark_ratio": ("upper", 0.020, 6.0),
    "dup_line_ratio": ("upper", 0.080, 6.0),
    "word_chars_mean": ("both", 0.500, 6.0),
}
MIN_GROUP = 200
#: Relative error of a quantile, and the growth of the grid's bounds that gives it.
ERROR = 0.01
GROWTH = (1 + ERROR) / (1 - ERROR)
#: The bucket of measures of 0 (none is negative) and the number added to the others.
ZERO, RISE = 0, 1 << 16
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?~^=@_")] = True
_CAPS = np.zeros(256, bool)
_CAPS[65:91] = True


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return np.diff(sums[offsets])


def _repeated(words: np.ndarray, first: np.ndarray, width: int = 5) -> np.ndarray:
    """For each text, its words that lie in a window found twice or more in it."""
    n = len(first) - 1
    h, text, at = window_hashes(words, first, width)
    if not len(h):
        return np.zeros(n, np.int64)
    order = np.lexsort((h, text))
    hs, ts = h[order], text[order]
    same = (hs[1:] == hs[:-1]) & (ts[1:] == ts[:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    hit = at[twice]
    cover[hit] += 1
    np.subtract.at(cover, hit + width, 1)
    return _per_text(np.cumsum(cover[:-1]) > 0, first)


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    raw, dup, all_ = data.tobytes(), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        dup.append(len(lines) - len(set(lines)))
        all_.append(len(lines))
    return dup, all_


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The base counts and the measures of FENCES of every whole text, with its language and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, marks = text_bytes(batch.column(1))
            for a, b in groups(np.diff(marks)):
                data, offsets = every[marks[a] : marks[b]], marks[a : b + 1] - marks[a]
                words, start, end, first = word_spans(data, offsets)
                chars = _per_text(((data & 0xC0) != 0x80) & ~SPACE[data], offsets)
                symbols, n_words = _per_text(_SYMBOL[data], offsets), np.diff(first)
                dup, lines = _dup_lines(data, offsets)
                repeat = _repeated(words, first)
                share = lambda x, y: x / np.maximum(y, 1)
                cols = [batch.column(0)[a:b], n_words, chars, symbols, dup, repeat, share(symbols, chars), share(_per_text(_CAPS[data], offsets), chars), share(_per_text(_MARK[data], offsets), chars), share(np.array(dup), np.array(lines)), share(chars, n_words), batch.column(2)[a:b], batch.column(3)[a:b]]
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=names)

    schema = BASE + "".join(f", {k} double" for k in FENCES) + ", lang string, source string"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(lang_col).cast("string"), F.col(source_col).cast("string")).mapInArrow(run, schema)


def _bucket(value: Column) -> Column:
    return F.when(value > 0, F.ceil(F.log(value) / math.log(GROWTH)).cast("int") + RISE).otherwise(ZERO)


def _middle(bucket: Column) -> Column:
    """The value that stands for a bucket."""
    return F.when(bucket == ZERO, 0.0).otherwise(F.pow(F.lit(GROWTH), bucket - RISE) * (2 / (1 + GROWTH)))


def sketches(measures: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: one sketch a (language, source) and measure.

    Sketches merge by adding n, so those of later batches can be added.
    """
    each = F.array(*[F.struct(F.lit(k).alias("measure"), _bucket(F.col(k)).alias("bucket")) for k in FENCES])
    return measures.filter("n_words > 0").select("lang", "source", F.explode(each).alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, and q1_ and q3_ of every measure from the sketches merged by `keys`."""
    merged = found.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    within = Window.partitionBy(*keys, "measure").orderBy("bucket")  # as many rows as a sketch has buckets
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = merged.select(*keys, "measure", "bucket", F.sum("n").over(within).alias("upto"), F.sum("n").over(whole).alias("total"))
    at = lambda k, q: _middle(F.min(F.when((F.col("measure") == k) & (F.col("upto") >= F.ceil(F.col("total") * q)), F.col("bucket"))))
    return ranked.groupBy(*keys).agg(F.max("total").alias("n"), *[at(k, q).alias(f"{name}_{k}") for k in FENCES for name, q in (("q1", 0.25), ("q3", 0.75))])


def thresholds(found: DataFrame) -> DataFrame:
    """lang, source, and for each measure low_ and high_ fences; merged sketches serve small groups."""
    tagged = lambda d, tag: d.select(*[F.col(c).alias(f"{c}_{tag}") for c in d.columns])
    own, by_lang, overall = quartiles(found, ["lang", "source"]), tagged(quartiles(found, ["lang"]), "l"), tagged(quartiles(found, []).filter("n > 0"), "a")
    joined = tagged(own, "s").join(by_lang, F.col("lang_s").eqNullSafe(F.col("lang_l")), "left").withColumn("one", F.lit(1)).join(overall.withColumn("one", F.lit(1)), "one", "left")
    pick = lambda k: F.when(F.col("n_s") >= MIN_GROUP, F.col(f"{k}_s")).when(F.col("n_l") >= MIN_GROUP, F.col(f"{k}_l")).otherwise(F.col(f"{k}_a"))
    out = [F.col("lang_s").alias("lang"), F.col("source_s").alias("source")]
    for k, (side, floor, widths) in FENCES.items():
        q1, q3 = pick(f"q1_{k}"), pick(f"q3_{k}")
        reach = F.greatest(q3 - q1, F.lit(floor)) * widths
        out += [(q3 + reach).alias(f"high_{k}"), ((q1 - reach) if side == "both" else F.lit(None).cast("double")).alias(f"low_{k}")]
    return joined.select(*out)


def apply_rules(measures: DataFrame, limits: DataFrame, n_limits: int) -> DataFrame:
    """Base counts, base_failed and kept for every measured text."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    keyed = measures.withColumn("_key", F.to_json(F.struct("lang", "source")))
    joined = lookup(keyed, limits.withColumn("_key", F.to_json(F.struct("lang", "source"))).drop("lang", "source"), n_limits, ["_key"], F.xxhash64("doc_id", "n_words", "word_chars"))
    within = F.lit(True)
    for k in FENCES:
        within &= F.coalesce(F.col(k) <= F.col(f"high_{k}"), F.lit(True)) & F.coalesce(F.col(k) >= F.col(f"low_{k}"), F.lit(True))
    names = [x.split()[0] for x in BASE.split(", ")]
    return joined.select(*names, base_failed.alias("base_failed"), (~base_failed & within).alias("kept"))


def quality_rules(docs: DataFrame, **columns: str) -> DataFrame:
    measures = cut(measure(docs, **columns))
    return apply_rules(measures, *cut_counted(thresholds(cut_small(sketches(measures)))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the base rule alone, by the operator's measuring pass."""
    return query(spark, sf_dir).drop("kept")


BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5), h AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM g),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM h), c AS (SELECT DISTINCT doc_id, i + j AS at FROM m, (SELECT unnest(range(0, 5)) AS j) WHERE k > 1), r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
"""
