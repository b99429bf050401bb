import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from gatelight.functions import boxes
from pyspark.sql import functions as F

number = st.floats(-500, 500, allow_nan=False).map(lambda x: round(x, 3))
box = st.tuples(number, number, number, number)


def test_box_laws(spark):
    """IoU is symmetric and within 0..1, containment is within 0..1, an empty or inverted box has area 0."""

    @settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(box, box), min_size=60, max_size=60))
    def law(pairs):
        df = spark.createDataFrame([(*a, *b) for a, b in pairs], ", ".join(f"{n}{c} double" for n in "ab" for c in ("x1", "y1", "x2", "y2")))
        a, b = (F.struct(*[F.col(n + c).alias(c) for c in ("x1", "y1", "x2", "y2")]) for n in "ab")
        rows = df.select(boxes.iou(a, b).alias("ab"), boxes.iou(b, a).alias("ba"), boxes.contained(a, b).alias("c"), boxes.area(a).alias("area"), boxes.iou(a, a).alias("aa")).collect()
        for r, (p, _) in zip(rows, pairs):
            assert r.ab == pytest.approx(r.ba) and 0 <= r.ab <= 1 + 1e-9 and 0 <= r.c <= 1 + 1e-9
            empty = p[2] <= p[0] or p[3] <= p[1]
            assert (r.area == 0) == empty and r.aa == pytest.approx(0 if empty else 1)

    law()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("text, value", [("16:9", 16 / 9), ("16/9", 16 / 9), ("1.5", 1.5), (" 4:5 ", 0.8), ("x", None), ("16:0", None), ("", None)])
def test_parse_aspect(spark, text, value):
    got = one(spark, boxes.parse_aspect(F.lit(text)))
    assert got is None if value is None else math.isclose(got, value)


@pytest.mark.parametrize("ratio, label", [(16 / 9, "16:9"), (1.79, "16:9"), (0.5625, "9:16"), (1.01, "1:1"), (0.8, "4:5"), (2.0, "2:1"), (3.0, "3.0000")])
def test_aspect_label(spark, ratio, label):
    assert one(spark, boxes.aspect_label(F.lit(ratio))) == label


def test_fit_and_rounding(spark):
    fit = one(spark, boxes.fit_to_aspect(F.lit(1920.0), F.lit(1080.0), F.lit(9 / 16)))
    assert (fit.w, fit.h) == (607, 1080)
    tiny = one(spark, boxes.fit_to_aspect(F.lit(1.0), F.lit(1.0), F.lit(100.0)))
    assert (tiny.w, tiny.h) == (1, 1)
    px = one(spark, boxes.to_int_xywh(boxes.box(0.5, 1.5, 3.0, 4.0)))
    assert (px.x, px.y, px.w, px.h) == (0, 2, 2, 2)  # halves go to even


def test_clamp_and_expand(spark):
    b = one(spark, boxes.clamp(boxes.box(-5.0, 2.0, 50.0, 90.0), 40, 80))
    assert tuple(b) == (0.0, 2.0, 40.0, 80.0)
    assert tuple(one(spark, boxes.expand(boxes.box(0.0, 0.0, 10.0, 20.0), -0.30))) == (1.5, 3.0, 8.5, 17.0)
