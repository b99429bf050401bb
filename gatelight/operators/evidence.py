"""Evidence of rule results as VARIANT: kept as it was found, asked by path, without a schema that all rules would have to share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_variant(results: DataFrame, column: str = "evidence") -> DataFrame:
    """``results`` with its JSON evidence as VARIANT; what is no JSON becomes null."""
    return results.withColumn(column, F.try_parse_json(column))


def paths(results: DataFrame, column: str = "evidence", **asked: str) -> DataFrame:
    """``results`` plus one column per keyword: ``"$.path type"`` of the evidence; null where the path is missing or of another type."""
    out = results if results.schema[column].dataType.typeName() == "variant" else as_variant(results, column)
    split = {name: text.rsplit(" ", 1) for name, text in asked.items()}
    return out.select(*[c for c in out.columns if c not in asked], *[F.try_variant_get(column, path, kind).alias(name) for name, (path, kind) in split.items()])
