"""Best-fit packing by patterns: non-negative least squares over the histogram of piece lengths.

Every document becomes pieces of at most `capacity` ids. The corpus' histogram of piece lengths has
at most `capacity` entries, so the packing itself is solved on counts: few-document patterns that
fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what is left is packed best-fit, also on counts.
Pieces then find their place by their rank among pieces of their length; ranks are taken in
bounded groups, so neither a hot length nor a hot key meets in one task.

Defined results: a null text is empty and holds the end id alone; repeated rows are packed like
any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandel.llm.common import cut, table
from strandel.llm.words import slices

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Pieces whose ranks are taken together.
RANK_GROUP = 2_048
Pattern = tuple[tuple[int, int], ...]


@functools.lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers JSON file, run by tiktoken (equal ids, a quarter of the time)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(of[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
    return tiktoken.Encoding("from_json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: only the first piece of a document may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(public_tokenizers.path(tokenizer))
        for b in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(enc.encode_to_numpy(text or "", allowed_special="all").astype("<u4"), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                ends = range(first, len(ids) + 1, capacity)
                for k, to in enumerate(ends):
                    at = 0 if k == 0 else to - capacity
                    out.append((doc, k, at, to - at, zlib.crc32(ids[at:to].tobytes())))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def exact_patterns(lengths: list[int], capacity: int) -> list[Pattern]:
    """Patterns of two to four present lengths that fill a sequence exactly."""
    have, found = set(lengths), set()
    for a in lengths:
        if capacity - a in have:
            found.add(tuple(sorted((a, capacity - a))))
        left = capacity - a
        for share in (0.5, 0.42, 0.34, 0.26, 0.18, 0.1):
            b = int(left * share)
            if b in have and left - b in have:
                found.add(tuple(sorted((a, b, left - b))))
            c = int((left - b) * 0.45)
            if {b, c, left - b - c} <= have:
                found.add(tuple(sorted((a, b, c, left - b - c))))
    return [tuple((x, p.count(x)) for x in sorted(set(p), reverse=True)) for p in sorted(found)]


def fit_counts(patterns: list[Pattern], histogram: dict[int, int], sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares of the patterns' counts against the histogram, by coordinates."""
    residual = defaultdict(float, {k: float(v) for k, v in histogram.items()})
    x, size = np.zeros(len(patterns)), [sum(m * m for _, m in p) for p in patterns]
    for _ in range(sweeps):
        moved = 0.0
        for i, p in enumerate(patterns):
            step = max(-x[i], sum(m * residual[a] for a, m in p) / size[i])
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for a, m in p:
                    residual[a] -= m * step
        if moved < 0.5:
            break
    return x


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, on counts: equal sequences are kept together with their number."""
    open_: dict[int, list[list]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = min((c for c, v in open_.items() if v and c >= length), default=None)
            if room is None:
                each = min(capacity // length, left)
                n = left // each
                open_[capacity - each * length].append([((length, each),), n])
                left -= n * each
                continue
            pattern, n = open_[room].pop()
            each = min(room // length, max(1, left // n))
            take = min(n, left // each)
            if take < n:
                open_[room].append([pattern, n - take])
            open_[room - each * length].append([(*pattern, (length, each)), take])
            left -= take * each
    return [(p, n) for v in open_.values() for p, n in v]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """(pattern, repeats) that use up the histogram exactly."""
    left = {k: v for k, v in histogram.items() if v and k < capacity}
    out: list[tuple[Pattern, int]] = [(((capacity, 1),), histogram[capacity])] if histogram.get(capacity) else []
    patterns = exact_patterns(sorted(left), capacity)
    counts = fit_counts(patterns, left)
    for i in np.argsort(-counts, kind="stable"):
        n = min(int(counts[i]), *(left[a] // m for a, m in patterns[i]))
        if n > 0:
            out.append((patterns[i], n))
            for a, m in patterns[i]:
                left[a] -= n * m
    return out + best_fit({k: v for k, v in left.items() if v}, capacity)


def places(packed: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces a sequence, offset in it) by rank."""
    used, rows, sequence = defaultdict(int), defaultdict(list), 0
    for pattern, n in packed:
        offset = 0
        for length, m in pattern:
            rows[length].append((used[length], sequence, m, offset))
            used[length] += n * m
            offset += length * m
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    """The pieces of `docs` with the sequence and the offset that each of them takes."""
    cut_pieces = cut(pieces(docs, capacity, **how))
    histogram = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}  # one row a length, `capacity` at most
    groups = [max(1, -(-histogram.get(k, 0) // RANK_GROUP)) for k in range(capacity + 1)]
    count_of = F.element_at(F.lit(groups), F.col("length").cast("int") + 1)
    keyed = cut_pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), count_of).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).cast("long").alias("rank"))
    # A few rows a length, whatever the size of the corpus: `capacity` lengths and their patterns bound the table.
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in (3, 5))
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows, at = shared.value[int(x)], length == x
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                past = rank[at] - row[:, 0]
                seq[at], offset[at] = row[:, 1] + past // row[:, 2], row[:, 3] + past % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
