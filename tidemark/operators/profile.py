"""Key profile of JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tidemark.functions.columns import key_list


LAST_WINS = "spark.sql.variant.allowDuplicateKeys"


def json_quality(df: DataFrame, column: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """What ``key_profile`` cannot see: ``(by..., n_rows, n_null, n_bad, n_other)``.

    ``n_bad`` counts texts that are no JSON, or too large to be read; ``n_other``
    those that are JSON but no object. What follows a complete value is not looked
    at: a text is judged by its first value. Turns on the session's
    ``variant.allowDuplicateKeys``, as ``key_profile`` does.
    """
    df.sparkSession.conf.set(LAST_WINS, "true")
    parsed = F.try_parse_json(column)
    text = F.col(column)
    kind = F.schema_of_variant(parsed)
    return df.groupBy(*key_list(by)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(text.isNull()).alias("n_null"),
        F.count_if(text.isNotNull() & parsed.isNull()).alias("n_bad"),
        F.count_if(parsed.isNotNull() & ~kind.startswith("OBJECT")).alias("n_other"),
    )


def key_profile(df: DataFrame, column: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Per key and value kind of a JSON object column: rows and nested sizes.

    ``(by..., key, kind, n_rows, min_size, max_size)``. ``kind`` is object,
    array, string, number, boolean or null; sizes are the keys of objects and
    the elements of arrays, null for plain values. Of a repeated key the last
    value counts; for that the session's ``variant.allowDuplicateKeys`` is turned
    on. Texts that are no JSON object have no keys; ``json_quality`` counts them.
    """
    keys = key_list(by)
    df.sparkSession.conf.set(LAST_WINS, "true")
    members = F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>")
    rows = df.select(*keys, F.explode(members).alias("key", "_value"))
    rows = rows.withColumn("kind", _kind(F.schema_of_variant("_value")))
    size = F.when(
        F.col("kind") == "object", F.size(F.try_variant_get("_value", "$", "map<string,variant>"))
    ).when(F.col("kind") == "array", F.size(F.try_variant_get("_value", "$", "array<variant>")))
    return (
        rows.withColumn("_size", size.cast("bigint"))
        .groupBy(*keys, "key", "kind")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("_size").alias("min_size"),
            F.max("_size").alias("max_size"),
        )
    )


def _kind(schema: Column) -> Column:
    return (
        F.when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .otherwise("number")
    )
