"""Incremental forms: new scene files as they arrive, and sessions of late events under a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandel.config import GroupRule
from strandel.kernels import skeleton
from strandel.plans.group import INSTANCES, solved
from strandel.sources.images import _scene, as_mask, decode_png


def mask_stream(spark: SparkSession, root: str, name: str = "*.png", files_a_batch: int = 64) -> DataFrame:
    """path and content of masks that appear under `root`."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("maxFilesPerTrigger", files_a_batch).load(root)


def instance_stream(files: DataFrame, rule: GroupRule = GroupRule()) -> DataFrame:
    """scene_id, iid, r, c of every arriving mask; scenes are independent, so no state is kept."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, blob in zip(part.path, part.content, strict=True):
                scene, _, found = solved(as_mask(decode_png(blob)), rule)
                rows = [(_scene(path), i, *p) for i, chain in enumerate(found, 1) for p in sorted(skeleton.layer(scene, chain, rule.include_nodes))]
                yield pd.DataFrame(np.array(rows, object).reshape(-1, 4), columns=["scene_id", "iid", "r", "c"])

    return files.select("path", "content").mapInPandas(run, INSTANCES)


def session_stream(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """user_id, session_start, n, total: runs of events without a pause of `gap`, closed once `late` has passed."""
    own = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("session_start"), "n", "total")
