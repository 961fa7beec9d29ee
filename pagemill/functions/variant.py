"""Record data of any shape: JSON kept as VARIANT, read by path, malformed JSON null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(json: Column) -> Column:
    """The JSON as a variant; null where it is malformed, or null itself."""
    return F.try_parse_json(json)


def at(data: Column, path: str, kind: str = "string") -> Column:
    """The value at a path ($.a.b[0]) as a type; null where there is none, or none of that type."""
    return F.try_variant_get(data, path, kind)


def fields(rows: DataFrame, data: str = "data", by: tuple[str, ...] = ()) -> DataFrame:
    """Of all rows, or of each group, the schema that their variants have in common, and how many have one."""
    return rows.groupBy(*by).agg(F.schema_of_variant_agg(data).alias("schema"), F.count(data).alias("records"))


def equal(rows: DataFrame, path: str, value: object, data: str = "data") -> DataFrame:
    """Rows whose value at a path is this one, as a text in any case."""
    return rows.where(F.lower(at(F.col(data), path)) == str(value).lower())


def entries(rows: DataFrame, data: str = "data") -> DataFrame:
    """A row for each top-level field of each object: the other columns, place, key and value (a variant)."""
    rest = [c for c in rows.columns if c != data]
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(data).outer())).select(*rest, F.col("pos").alias("place"), "key", "value")
