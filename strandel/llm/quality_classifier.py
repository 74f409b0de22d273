"""Quality classifier: supervised subword embeddings with a softmax output.

Fitted on a bounded, hash-drawn sample of labelled rows outside the held-out fifth; applied to
whole texts in one pass without a shuffle. Neither labels nor language, source or id are inputs.

Defined results: a null or empty text has no features and gets the score of the bias; rows without
a label are scored alike; null labels are not learned from, and of several labels of one doc_id
the largest counts; without any usable label every score is 1.0 if nothing is known (kept); a column
that has the name of the score is replaced; equal texts get equal scores, and repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandel.llm.common import give_back, table
from strandel.llm.subword import Model, held_out, scores, train, training_bags
from strandel.llm.words import slices

#: Most labelled rows that the model is fitted on, both labels together.
TRAIN_ROWS = 3_000
CUTOFF = 0.3


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS) -> Model:
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    rows = training_bags(docs, known.filter(~held_out(F.col("doc_id"))), most_rows)
    give_back(docs.sparkSession)
    model = train(rows)
    give_back(docs.sparkSession)
    return model


def _one(model: Model, texts: list[str]) -> np.ndarray:
    return scores(model, texts)[:, model.classes.index("1")] if "1" in model.classes else np.full(len(texts), 0.0 if "0" in model.classes else 1.0)


def score_column(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """`docs` with every column it has and `name`, the probability of label 1, instead of any of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, docs = f"{name}_text", docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower() or c == text_col])
    if text_col.lower() == name.lower():
        docs, text_col = docs.withColumnRenamed(text_col, text), text
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = _one(shared.value, [x or "" for x in b.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def keep_good(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of `docs` whose score reaches the cut-off, with the columns of `docs`."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return score_column(docs, model, name).filter(F.col(name) >= cutoff).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_column(docs, fit(docs, table(spark, sf_dir, "labels")), "score").drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
