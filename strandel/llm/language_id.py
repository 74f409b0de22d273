"""Language ID: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

Fitted on a bounded, hash-drawn sample, even by language, of rows outside the held-out fifth with
a language; applied to whole texts in one pass without a shuffle. The temperature is fitted on
rows set aside, and so is the cut-off under which a prediction is marked as rejected.

Defined results: `und` with score 0 for null texts and texts without a letter; without any language
to learn every text is `und`; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandel.llm.common import give_back, table
from strandel.llm.subword import Model, held_out, scores, train, training_bags
from strandel.llm.words import slices

#: Most rows that the model is fitted on, all languages together.
TRAIN_ROWS = 3_000
#: A calibrated probability under this marks the prediction as rejected.
REJECT_UNDER = 0.5
UNKNOWN = "und"


def fit(docs: DataFrame, most_rows: int = TRAIN_ROWS) -> Model:
    known = docs.filter("lang is not null and doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label"))
    rows = training_bags(docs, known.filter(~held_out(F.col("doc_id"))), most_rows)
    give_back(docs.sparkSession)
    model = train(rows, epochs=6)
    give_back(docs.sparkSession)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            texts = [x or "" for x in b.column(1).to_pylist()]
            p = scores(m, texts)
            letters = [any(map(str.isalpha, t)) and m.classes != ("",) for t in texts]
            best = p.argmax(1).tolist()
            lang = [m.classes[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
            score = [float(p[i, k]) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, letters, strict=True))]
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([s < REJECT_UNDER for s in score], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
