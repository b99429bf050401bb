"""Box algebra as column expressions over structs of x1, y1, x2, y2 (x2 and y2 exclusive).

Inverted boxes count as empty: widths and heights are never negative. Ratios over an empty area are 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Head padding around a face box (left, top, right, bottom) and the shrink that leaves its core.
HEAD_PAD = (0.18, 0.38, 0.18, 0.20)
CORE_SHRINK = -0.30
#: Named aspect ratios, in the order they are tried.
ASPECTS = (("16:9", 16 / 9), ("9:16", 9 / 16), ("1:1", 1.0), ("4:5", 4 / 5), ("4:3", 4 / 3), ("3:4", 3 / 4), ("2:1", 2.0), ("21:9", 21 / 9))


def box(x1, y1, x2, y2) -> Column:
    cast = lambda c: (F.lit(c) if isinstance(c, (int, float)) else F.col(c) if isinstance(c, str) else c).cast("double")
    return F.struct(cast(x1).alias("x1"), cast(y1).alias("y1"), cast(x2).alias("x2"), cast(y2).alias("y2"))


def width(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0))


def height(b: Column) -> Column:
    return F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def area(b: Column) -> Column:
    return width(b) * height(b)


def center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def intersect(a: Column, b: Column) -> Column:
    return box(F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]), F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"]))


def union(a: Column, b: Column) -> Column:
    """The smallest box around both."""
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def iou(a: Column, b: Column) -> Column:
    common = area(intersect(a, b))
    whole = area(a) + area(b) - common
    return F.when(whole > 0, common / whole).otherwise(0.0)


def contained(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` that lies inside ``outer``."""
    return F.when(area(inner) > 0, area(intersect(inner, outer)) / area(inner)).otherwise(0.0)


def pad(b: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """Padding in shares of the box's own width and height."""
    return box(b["x1"] - width(b) * left, b["y1"] - height(b) * top, b["x2"] + width(b) * right, b["y2"] + height(b) * bottom)


def expand(b: Column, share: float) -> Column:
    """Grow (or shrink) about the centre by ``share`` of each side in all."""
    return pad(b, share / 2, share / 2, share / 2, share / 2)


def clamp(b: Column, w, h) -> Column:
    w, h = (F.lit(float(x)) if isinstance(x, (int, float)) else x for x in (w, h))
    return box(F.greatest(b["x1"], F.lit(0.0)), F.greatest(b["y1"], F.lit(0.0)), F.least(b["x2"], w), F.least(b["y2"], h))


def normalized(b: Column, w, h) -> Column:
    return box(b["x1"] / w, b["y1"] / h, b["x2"] / w, b["y2"] / h)


def to_pixels(b: Column, w, h) -> Column:
    return box(b["x1"] * w, b["y1"] * h, b["x2"] * w, b["y2"] * h)


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def to_int_xywh(b: Column) -> Column:
    """Whole pixels, rounded half to even."""
    return F.struct(F.bround(b["x1"]).cast("int").alias("x"), F.bround(b["y1"]).cast("int").alias("y"), F.bround(width(b)).cast("int").alias("w"), F.bround(height(b)).cast("int").alias("h"))


def head(face: Column) -> Column:
    return pad(face, *HEAD_PAD)


def core(face: Column) -> Column:
    return expand(face, CORE_SHRINK)


#: How far a standing body reaches beside, above and below its face, in faces.
BODY = (1.5, 0.35, 3.2)


def body(face: Column, w, h) -> Column:
    """The body that a face suggests, within the frame."""
    across, above, below = BODY
    return clamp(box(center_x(face) - width(face) * across, face["y1"] - height(face) * above, center_x(face) + width(face) * across, face["y2"] + height(face) * below), w, h)


def parse_aspect(text: Column) -> Column:
    """'16:9', '16/9' or a plain number; null where it is neither or not positive."""
    parts = F.split(F.trim(text), "[:/]")
    a = parts[0].try_cast("double")
    b = F.when(F.size(parts) == 2, F.try_element_at(parts, F.lit(2)).try_cast("double")).when(F.size(parts) == 1, F.lit(1.0))
    return F.when((a > 0) & (b > 0), a / b)


def aspect_label(ratio: Column, tolerance: float = 0.02) -> Column:
    """The first named ratio within ``tolerance`` of the value, else the value to four places."""
    out = None
    for name, value in ASPECTS:
        near = F.abs(ratio - value) <= tolerance * value
        out = F.when(near, name) if out is None else out.when(near, name)
    return out.otherwise(F.format_string("%.4f", ratio))


def fit_to_aspect(w: Column, h: Column, ratio: Column, scale: float = 1.0) -> Column:
    """Largest whole-pixel size of a ratio inside w x h, times ``scale``, at least 1 x 1."""
    wide = w / h > ratio
    fw = F.floor(F.when(wide, h * scale * ratio).otherwise(w * scale))
    fh = F.floor(F.when(wide, h * scale).otherwise(w * scale / ratio))
    return F.struct(F.greatest(fw, F.lit(1)).cast("int").alias("w"), F.greatest(fh, F.lit(1)).cast("int").alias("h"))
