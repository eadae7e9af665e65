"""Box geometry. A box is a struct (x, y, width, height); coordinate spaces are named at the caller.

Rounding is half up (towards positive infinity), as floor(v * 10 + 0.5) / 10.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,width:double,height:double>"
PADDING, MIN_PAD, MAX_EXACT_PAD = 0.15, 4.0, 8.0
#: Role to class of control; other roles are not compared.
UI_CLASS = {"button": "button", "link": "link", "textbox": "textbox", "checkbox": "textbox", "radio": "textbox", "select": "textbox"}


def box(x, y, width, height) -> Column:
    """The fields are cast rather than the struct, so that reading one of them computes no other."""
    sides = zip(("x", "y", "width", "height"), (x, y, width, height))
    return F.struct(*((F.col(v) if isinstance(v, str) else v).cast("double").alias(n) for n, v in sides))


def either(first: Column, a: Column, b: Column) -> Column:
    """Box a where ``first`` holds, else b, side by side: a choice of structs is made anew for each of its fields."""
    return box(*(F.when(first, a[k]).otherwise(b[k]) for k in ("x", "y", "width", "height")))


def half_up(v: Column, scale: int = 1) -> Column:
    """Rounded to 1 / scale; a half goes up, also below zero."""
    return F.floor(v * scale + 0.5) / F.lit(float(scale))


def round1(v: Column) -> Column:
    return half_up(v, 10)


def round3(v: Column) -> Column:
    return half_up(v, 1000)


def _meet(a: Column, b: Column):
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return w, h


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; 0 where boxes do not meet."""
    w, h = _meet(a, b)
    return F.when((w > 0) & (h > 0), w * h / (a["width"] * a["height"] + b["width"] * b["height"] - w * h)).otherwise(0.0)


def intersect(a: Column, b: Column) -> Column:
    """The shared box, or null."""
    w, h = _meet(a, b)
    return F.when((w > 0) & (h > 0), box(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]), w, h))


def clip(b: Column, width: Column, height: Column) -> Column:
    """The part of a box within a viewport, or null."""
    zero = F.lit(0.0)
    return intersect(b, box(zero, zero, width.cast("double"), height.cast("double")))


def move(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x"] + dx, b["y"] + dy, b["width"], b["height"])


def scale(b: Column, s: Column) -> Column:
    return box(*(round1(b[k] * s) for k in ("x", "y", "width", "height")))


def to_px(b: Column, dpr: Column) -> Column:
    """CSS to screenshot pixels; a ratio that is not positive counts as 1."""
    return scale(b, F.when(dpr > 0, dpr).otherwise(1.0))


def to_css(b: Column, dpr: Column) -> Column:
    return scale(b, F.when(dpr > 0, 1 / dpr).otherwise(1.0))


def _edges(b: Column, px: Column, py: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Left, top, right and bottom of a box grown by px and py, snapped outward and clamped."""
    into = lambda v, hi: F.greatest(F.lit(0.0), F.least(v.cast("double"), hi.cast("double")))
    x0, y0 = into(F.floor(b["x"] - px), width), into(F.floor(b["y"] - py), height)
    x1, y1 = into(F.ceil(b["x"] + b["width"] + px), width), into(F.ceil(b["y"] + b["height"] + py), height)
    return x0, y0, x1, y1


def _grow(b: Column, px: Column, py: Column, width: Column, height: Column) -> Column:
    x0, y0, x1, y1 = _edges(b, px, py, width, height)
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1 - x0, y1 - y0))


def pad(b: Column, width: Column, height: Column, padding: float = PADDING, least: float = MIN_PAD) -> Column:
    """A detector's box grown by a share of its sides, snapped outward and clamped; null if nothing is left."""
    return _grow(b, F.greatest(F.lit(least), b["width"] * padding), F.greatest(F.lit(least), b["height"] * padding), width, height)


def pad_exact(b: Column, width: Column, height: Column, padding: float = PADDING, least: float = MIN_PAD, most: float = MAX_EXACT_PAD) -> Column:
    """An exact box grown on all sides by a share of its height, 4 to 8 pixels."""
    p = _exact(b, padding, least, most)
    return _grow(b, p, p, width, height)


def _exact(b: Column, padding: float = PADDING, least: float = MIN_PAD, most: float = MAX_EXACT_PAD) -> Column:
    return F.greatest(F.lit(least), F.least(b["height"] * padding, F.lit(most)))


def region_edges(b: Column, method: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Left, top, right and bottom of pad_region(), also where nothing is left between them."""
    px, py = (F.when(method == "ml", F.greatest(F.lit(MIN_PAD), b[k] * PADDING)).otherwise(_exact(b)) for k in ("width", "height"))
    return _edges(b, px, py, width, height)


def pad_region(b: Column, method: Column, width: Column, height: Column) -> Column:
    x0, y0, x1, y1 = region_edges(b, method, width, height)
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1 - x0, y1 - y0))


def grid_word(b: Column, width: Column, height: Column) -> Column:
    """Where a box's centre lies in a 3 x 3 grid of the viewport; unknown without a viewport."""
    cx, cy = (b["x"] + b["width"] / 2) / width, (b["y"] + b["height"] / 2) / height
    third = lambda v, low, high: F.when(v < F.lit(1.0) / 3, low).when(v > F.lit(2.0) / 3, high)
    col, row = third(cx, "left", "right"), third(cy, "top", "bottom")
    word = F.coalesce(F.concat(row, F.lit("-"), col), row, col, F.lit("center"))
    return F.when((width <= 0) | (height <= 0), "unknown").otherwise(word)


def from_norm(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Normalised centre and size to a pixel box."""
    return box((cx - w / 2) * width, (cy - h / 2) * height, w * width, h * height)


def norm_line(cls: Column, b: Column, width: Column, height: Column) -> Column:
    """A label line: class and normalised centre and size with six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls.cast("int"), (b["x"] + b["width"] / 2) / width, (b["y"] + b["height"] / 2) / height, b["width"] / width, b["height"] / height)


def letterbox(width: Column, height: Column, size: int) -> Column:
    """Scale and pads that fit an image into a square: struct(scale, pad_x, pad_y)."""
    s = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    side = lambda v: F.greatest(F.lit(1.0), half_up(v * s))
    margin = lambda v: half_up((F.lit(float(size)) - side(v)) / 2 - 0.1)
    return F.struct(s.alias("scale"), margin(width).alias("pad_x"), margin(height).alias("pad_y"))


def unletterbox(cx: Column, cy: Column, w: Column, h: Column, lb: Column, width: Column, height: Column) -> Column:
    """A model's centre box in image pixels, clipped to the image."""
    mx, my, mw, mh = (cx - lb["pad_x"]) / lb["scale"], (cy - lb["pad_y"]) / lb["scale"], w / lb["scale"], h / lb["scale"]
    x1, y1 = F.greatest(F.lit(0.0), mx - mw / 2), F.greatest(F.lit(0.0), my - mh / 2)
    return box(x1, y1, F.least(width, mx + mw / 2) - x1, F.least(height, my + mh / 2) - y1)


def label_clip(b: Column, width: Column, height: Column) -> Column:
    """A label's box clipped to the viewport; null under 4 pixels a side or under half visible."""
    c = clip(b, width, height)
    return F.when((c["width"] >= 4) & (c["height"] >= 4) & (c["width"] * c["height"] >= 0.5 * b["width"] * b["height"]), c)


def element_visible(b: Column, width: Column, height: Column) -> Column:
    """Boxes that touch the viewport's edge count."""
    return rendered(b) & (b["x"] + b["width"] >= 0) & (b["y"] + b["height"] >= 0) & (b["x"] <= width) & (b["y"] <= height)


def in_viewport(b: Column, width: Column, height: Column) -> Column:
    """Boxes that only touch the edge do not count."""
    return rendered(b) & (b["x"] + b["width"] > 0) & (b["y"] + b["height"] > 0) & (b["x"] < width) & (b["y"] < height)


def rendered(b: Column) -> Column:
    return (b["width"] > 0) & (b["height"] > 0)


def comparable(b: Column, width: Column, height: Column) -> Column:
    """In the viewport and at least 4 pixels a side."""
    return in_viewport(b, width, height) & (b["width"] >= 4) & (b["height"] >= 4)


def ui_class(role: Column) -> Column:
    return F.coalesce(*(F.when(role == r, c) for r, c in UI_CLASS.items()))


def centre(b: Column) -> Column:
    return F.struct(round1(b["x"] + b["width"] / 2).alias("x"), round1(b["y"] + b["height"] / 2).alias("y"))


def contains_point(b: Column, p: Column) -> Column:
    """Inclusive on all sides."""
    return (p["x"] >= b["x"]) & (p["x"] <= b["x"] + b["width"]) & (p["y"] >= b["y"]) & (p["y"] <= b["y"] + b["height"])


def contains_box(outer: Column, inner: Column) -> Column:
    return (outer["x"] <= inner["x"]) & (outer["y"] <= inner["y"]) & (outer["x"] + outer["width"] >= inner["x"] + inner["width"]) & (outer["y"] + outer["height"] >= inner["y"] + inner["height"])


def reading_row(b: Column, row: float) -> Column:
    """Rows of ``row`` pixels by the box's centre; order by it and then by x."""
    return F.floor((b["y"] + b["height"] / 2) / row + 0.5)
