"""Boxes and pages: a box is a struct of x, y, width, height (doubles); null is unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column, fallback: float = 0.0) -> Column:
    d = c.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(fallback)).otherwise(d)


def clamp(c: Column, low=0.0, high=1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(finite(x).alias("x"), finite(y).alias("y"), F.greatest(F.lit(0.0), finite(width)).alias("width"), F.greatest(F.lit(0.0), finite(height)).alias("height"))


def page_dimensions(width: Column, height: Column, system: Column) -> Column:
    """Null unless both are above 0."""
    w, h = finite(width), finite(height)
    return F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height"), F.when(system == "pdf", "pdf").otherwise("top-down").alias("coordinateSystem")))


def to_top_left(b: Column, page: Column, system: Column | None = None) -> Column:
    s = F.coalesce(system, page["coordinateSystem"], F.lit("top-down")) if system is not None else F.coalesce(page["coordinateSystem"], F.lit("top-down"))
    y = F.when((s == "pdf") & page.isNotNull(), F.greatest(F.lit(0.0), page["height"] - b["y"] - b["height"])).otherwise(b["y"])
    return F.when(b.isNotNull(), F.struct(b["x"].alias("x"), y.alias("y"), b["width"].alias("width"), b["height"].alias("height")))


def relative(b: Column, page: Column) -> Column:
    part = lambda k, by: clamp(b[k] / page[by]).alias(k)
    return F.when(b.isNotNull() & page.isNotNull(), F.struct(part("x", "width"), part("y", "height"), part("width", "width"), part("height", "height")))


def union_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Aggregate: the box around all boxes of a group, null if none is known."""
    x0, y0 = F.min(x), F.min(y)
    return F.when(x0.isNotNull(), F.struct(x0.alias("x"), y0.alias("y"), F.greatest(F.lit(0.0), F.max(x + width) - x0).alias("width"), F.greatest(F.lit(0.0), F.max(y + height) - y0).alias("height")))


def box_around(boxes: Column) -> Column:
    """The box around an array of boxes, null if none is known."""
    known = F.filter(boxes, lambda b: b["x"].isNotNull())
    least = lambda f: F.array_min(F.transform(known, f))
    most = lambda f: F.array_max(F.transform(known, f))
    x, y = least(lambda b: b["x"]), least(lambda b: b["y"])
    size = lambda a, k, n: F.greatest(F.lit(0.0), most(lambda b: b[k] + b[n]) - a)
    return F.when(F.size(known) > 0, F.struct(x.alias("x"), y.alias("y"), size(x, "x", "width").alias("width"), size(y, "y", "height").alias("height")))


def usable(b: Column) -> Column:
    return F.coalesce(b.isNotNull() & b["x"].isNotNull() & b["y"].isNotNull() & (b["width"] > 0) & (b["height"] > 0), F.lit(False))


def usable_place(b: Column) -> Column:
    """Whether a box has a place that points can be near to; its width and height may be 0."""
    return F.coalesce(b["x"].isNotNull() & b["y"].isNotNull() & (b["width"] >= 0) & (b["height"] >= 0), F.lit(False))


def distance_to_line(b: Column, y: Column) -> Column:
    """0 inside, else to the nearer edge; infinite without a box."""
    a, e = b["y"], b["y"] + b["height"]
    return F.when(b.isNull(), float("inf")).when((y >= a) & (y <= e), 0.0).otherwise(F.least(F.abs(y - a), F.abs(y - e)))


def distance_to_box(x: Column, y: Column, b: Column) -> Column:
    dx = F.greatest(b["x"] - x, x - (b["x"] + b["width"]), F.lit(0.0))
    dy = F.greatest(b["y"] - y, y - (b["y"] + b["height"]), F.lit(0.0))
    return F.when(b.isNull(), float("inf")).otherwise(F.hypot(dx, dy))


def normalize_confidence(c: Column) -> Column:
    v = finite(c)
    return clamp(F.when(v > 1, v / 100).otherwise(v))


def capture_anchor(page_top: Column, page_height: Column, scroll_top: Column, viewport: Column, ratio: float = 0.38) -> Column:
    return F.when(page_height > 0, clamp((scroll_top + viewport * ratio - page_top) / page_height))


def restore_anchor(relative_offset: Column, page_top: Column, page_height: Column, viewport: Column, ratio: float = 0.38) -> Column:
    return F.when(page_height > 0, F.greatest(F.lit(0.0), page_top + page_height * relative_offset - viewport * ratio))


def ocr_render_scale(width: Column) -> Column:
    w = finite(width)
    return F.when(w <= 0, 1.5).otherwise(F.least(F.lit(3.2), F.greatest(F.lit(1.5), F.lit(1600.0) / w)))


def cache_budget(memory: Column, ocr: Column) -> Column:
    """Pages and pixels of a page cache by device memory in GB."""
    pages = F.when(memory.isNull() | (memory <= 0), 10).when(memory <= 8, 7).when(memory <= 16, 10).otherwise(14)
    pages = F.when(ocr, F.greatest(F.lit(7), pages - 1)).otherwise(pages)
    return F.struct(pages.alias("pages"), F.floor(pages * 4800000 * F.when(ocr, 0.9).otherwise(1.0) + 0.5).alias("pixels"))
