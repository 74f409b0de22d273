"""SQL names for the scalar expressions and a table function that decodes compressed instances."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="iid int, r int, c int")
class DecodeInstances:
    """decode_instances(shape, ids, indptr, indices): one row a pixel of each instance."""

    def eval(self, shape, ids, indptr, indices):
        for k, iid in enumerate(ids):
            for at in indices[indptr[k] : indptr[k + 1]]:
                yield int(iid), int(at // shape[1]), int(at % shape[1])


def register(spark: SparkSession) -> None:
    """Temporary SQL functions, all inside code generation but for the table function."""
    spark.udtf.register("decode_instances", DecodeInstances)
    for sql in (
        "floored_feature(core DOUBLE, fi DOUBLE, fj DOUBLE, sigma DOUBLE) RETURNS DOUBLE RETURN (abs(core - fj) - abs(core - fi)) / greatest(abs(fi - fj), 2 * sigma, 1e-12)",
        "abstain_threshold(band DOUBLE) RETURNS DOUBLE RETURN ln((0.5 + least(greatest(band, 0.0D), 0.499999D)) / (0.5 - least(greatest(band, 0.0D), 0.499999D)))",
        "clipped_angle(ux DOUBLE, uy DOUBLE, vx DOUBLE, vy DOUBLE) RETURNS DOUBLE RETURN acos(greatest(least(ux * vx + uy * vy, 1.0D), -1.0D))",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sql}")
