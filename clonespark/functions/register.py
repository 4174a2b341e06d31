"""SQL names for the functions users combine in their own queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .kernels import edit_distance_wildcard, edit_profile, minhash_sketch
from .statistics import binomial_survival, poisson_upper_tail
from .tables import register_tables


def register_functions(spark: SparkSession, edit_radius: int = 2) -> None:
    """Register the Arrow UDFs, table functions and SQL functions in the session."""
    register_tables(spark)
    spark.udf.register("edit_profile", edit_profile(edit_radius))
    spark.udf.register("edit_distance_wildcard", edit_distance_wildcard)
    spark.udf.register("minhash_sketch", minhash_sketch)
    spark.udf.register("poisson_upper_tail", poisson_upper_tail)
    spark.udf.register("binomial_survival", binomial_survival)
    # native SQL functions: no Python at run time
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normalize_nt(s STRING) RETURNS STRING "
        "RETURN regexp_replace(translate(upper(coalesce(s, '')), 'U', 'T'), '[^ACGTN]', '')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION hamming_within(a STRING, b STRING, d INT) RETURNS BOOLEAN "
        "RETURN length(a) = length(b) AND aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> if(x = y, 0, 1)), 0, (s, x) -> s + x) <= d"
    )
