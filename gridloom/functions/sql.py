"""Functions for SQL: registered in a session, each one expression that Catalyst sees through."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, result and body.
FUNCTIONS = (
    ("hamming", "x BIGINT, y BIGINT", "INT", "bit_count(x ^ y)"),
    ("sign_hash", "v ARRAY<FLOAT>", "BIGINT", "aggregate(transform(slice(v, 1, 64), (e, i) -> if(e > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"),
    ("bin_of", "x FLOAT, borders ARRAY<FLOAT>", "INT", "size(filter(borders, b -> b < x))"),
    ("sigmoid", "raw DOUBLE", "DOUBLE", "1 / (1 + exp(-raw))"),
    ("leaf_value", "code BIGINT, shift INT, e_min INT, offset DOUBLE", "DOUBLE", "offset + code * pow(2, e_min + shift)"),
    ("is_positive", "coverage DOUBLE, least DOUBLE", "BOOLEAN", "cast(coverage as float) >= cast(least as float)"),
    ("fuses_resize", "h INT, w INT, channels INT, thumb_h INT, thumb_w INT, interpolation STRING", "BOOLEAN", "channels = 3 and interpolation = 'area' and h >= thumb_h and w >= thumb_w"),
    ("cell_row", "cell INT, g INT", "INT", "cell div g"),
    ("cell_column", "cell INT, g INT", "INT", "cell % g"),
)


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes the functions known to the session's SQL, and returns their names."""
    for name, takes, gives, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({takes}) RETURNS {gives} RETURN {body}")
    return [prefix + name for name, *_ in FUNCTIONS]
