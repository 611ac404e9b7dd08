"""SQL functions for use on a run's views."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Plain SQL functions, so calls stay in generated code.
FUNCTIONS = (
    "create or replace temporary function voxel_index(i int, j int, k int, ny int, nz int) returns bigint return (cast(i as bigint) * ny + j) * nz + k",
    "create or replace temporary function wrap_index(a bigint, n bigint) returns bigint return pmod(a, n)",
    "create or replace temporary function minimum_image(d bigint, n bigint) returns bigint return least(abs(d), n - abs(d))",
    "create or replace temporary function lattice_hit(i bigint, edge double, offset double, origin double) returns boolean "
    "return exists(sequence(cast(floor((i - origin) / edge - offset) as bigint) - 1, cast(floor((i - origin) / edge - offset) as bigint) + 2), "
    "t -> sign(edge * (t + offset) + origin) * (floor(abs(edge * (t + offset) + origin)) + if(abs(edge * (t + offset) + origin) - floor(abs(edge * (t + offset) + origin)) >= 0.5, 1, 0)) = i)",
)


def register(spark: SparkSession) -> None:
    for f in FUNCTIONS:
        spark.sql(f)
