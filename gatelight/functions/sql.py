"""Box algebra as SQL functions of a session, for queries written in SQL. Catalyst inlines them; they are expressions, not UDFs.

Boxes are structs of x1, y1, x2, y2; empty and inverted ones are treated as in ``boxes``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_BOX = "struct<x1: double, y1: double, x2: double, y2: double>"
_FUNCTIONS = (
    (f"box_area(a {_BOX})", "double", "greatest(a.x2 - a.x1, 0D) * greatest(a.y2 - a.y1, 0D)"),
    (f"box_common(a {_BOX}, b {_BOX})", "double", "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0D) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0D)"),
    (f"box_iou(a {_BOX}, b {_BOX})", "double", "coalesce(try_divide(box_common(a, b), box_area(a) + box_area(b) - box_common(a, b)), 0D)"),
    (f"box_contained(a {_BOX}, b {_BOX})", "double", "coalesce(try_divide(box_common(a, b), box_area(a)), 0D)"),
    (f"box_pad(a {_BOX}, share double)", _BOX, "named_struct('x1', a.x1 - share * greatest(a.x2 - a.x1, 0D), 'y1', a.y1 - share * greatest(a.y2 - a.y1, 0D), 'x2', a.x2 + share * greatest(a.x2 - a.x1, 0D), 'y2', a.y2 + share * greatest(a.y2 - a.y1, 0D))"),
)


def register(spark: SparkSession) -> None:
    """Define box_area, box_common, box_iou, box_contained and box_pad in the session; a null box gives 0 as a ratio, else null."""
    for head, returns, body in _FUNCTIONS:
        spark.sql(f"create or replace temporary function {head} returns {returns} return {body}")
