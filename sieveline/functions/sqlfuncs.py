"""The engine's expressions as SQL functions of a session: no Python runs in them."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "vec_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "vec_dot(a, b) / (vec_norm(a) * vec_norm(b))",
    "fold_tempo(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE": "CASE WHEN x <= 0 THEN NULL WHEN x < lo THEN x * pow(2, ceil(log2(lo / x))) WHEN x > hi THEN x / pow(2, ceil(log2(x / hi))) ELSE x END",
    "pitch_distance(a INT, b INT) RETURNS INT": "least(pmod(a - b, 12), 12 - pmod(a - b, 12))",
    "path_pack(path STRING) RETURNS STRING": "split_part(path, '/', 1)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
