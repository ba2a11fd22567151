"""Column functions on boxes: corner boxes x0, y0, x1, y1 and boxes left, top, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: label families and thresholds
TEXT_LABELS = ["text", "content", "paragraph_title", "doc_title", "abstract", "aside_text", "list", "header", "footer", "figure_title", "table_title", "reference"]
COLUMN_LABELS = ["text", "content", "paragraph_title", "abstract", "aside_text", "list", "reference"]
PRESERVE_LABELS = ["image", "chart"]
STRUCTURE_LABELS = ["table"]
REGION_MIN_SCORE = 0.4
FLAG_MIN_SCORE = 0.5
MATCH_MIN_IOU = 0.1
DUPLICATE_IOU = 0.85
COVERED_FRACTION = 0.8
#: gaps, in heights, of boxes of one element that are stacked or on one line; overlap of boxes of one place
STACK_GAP, LINE_GAP = 1.5, 2.0
SAME_PLACE = 0.3


def family(label: Column) -> Column:
    return F.when(label.isin(PRESERVE_LABELS), "image").when(label.isin(STRUCTURE_LABELS), "table").when(label.isin(TEXT_LABELS), "text").otherwise("other")


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def box_area(b: Column) -> Column:
    return area(b["x0"], b["y0"], b["x1"], b["y1"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    common = overlap(a, b)
    union = box_area(a) + box_area(b) - common
    return F.when((common > 0) & (union > 0), common / union).otherwise(0.0)


def weight(b: Column) -> Column:
    return F.sqrt(box_area(b))


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def centre_x(left: Column, width: Column) -> Column:
    return left + width / 2


def inside(x: Column, y: Column, b: Column) -> Column:
    return (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])


def near(a: Column, b: Column) -> Column:
    """Boxes near enough to be one element: one above the other, or side by side on a line."""
    height = F.greatest(a["y1"] - a["y0"], b["y1"] - b["y0"], F.lit(1.0))
    across = F.greatest(a["x0"], b["x0"]) - F.least(a["x1"], b["x1"])
    down = F.greatest(a["y0"], b["y0"]) - F.least(a["y1"], b["y1"])
    return ((across < 0) & (down <= STACK_GAP * height)) | ((down < 0) & (across <= LINE_GAP * height))
