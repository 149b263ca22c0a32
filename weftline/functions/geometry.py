"""Arithmetic on boxes, canvases and colours; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Twelve colour names with their values (fixed values, in fixed order).
COLOURS = {"black": "#000000", "white": "#ffffff", "grey": "#808080", "red": "#cc0000", "blue": "#0044cc", "green": "#00aa44",
           "yellow": "#ffdd00", "orange": "#ff8800", "pink": "#ff66aa", "purple": "#7733aa", "brown": "#8b5a2b", "beige": "#d9c7a7"}
PALETTE = {name: tuple(int(code[i : i + 2], 16) for i in (1, 3, 5)) for name, code in COLOURS.items()}


def overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes given as left, top, width, height."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def colour_distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance of two colours."""
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Brightness by the Rec. 601 weights."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Blue and red difference of a colour (full range)."""
    return 128.0 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128.0 + 0.5 * r - 0.418688 * g - 0.081312 * b


def looks_like_skin(r: Column, g: Column, b: Column) -> Column:
    """Within the usual box of skin tones in the chroma plane."""
    cb, cr = chroma(r, g, b)
    return cb.between(77, 127) & cr.between(133, 173)


def nearest_colour(r: Column, g: Column, b: Column) -> Column:
    """Name of the palette's nearest colour; the first of equally near ones."""
    rank = [F.struct(colour_distance([r, g, b], [F.lit(float(v)) for v in rgb]).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, rgb) in enumerate(PALETTE.items())]
    return F.array_min(F.array(*rank))["name"]


def canvas_side(length: Column, margin: float) -> Column:
    """Side of the square canvas around a subject with a margin on both sides: even, two less."""
    side = F.floor(length * (1 + 2 * margin))
    return side - side % 2 - 2


def needed_scale(side: Column, least: float) -> Column:
    """Factor that brings a side to the least one; 1 if it is large enough."""
    return F.when(side >= least, F.lit(1.0)).otherwise(F.lit(least) / side)


def centering(position: Column) -> Column:
    """1 in the middle, 0 at either end."""
    return 1 - 2 * F.abs(position - 0.5)


def clamped(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))


#: Share of a box's height, at its bottom, that a shadow is taken to fill.
SHADOW = 0.06


def without_shadow(box: list[Column], shadow: Column) -> list[Column]:
    """A box (left, top, width, height) without its lowest part where a shadow stands there."""
    left, top, width, height = box
    return [left, top, width, F.when(shadow, F.greatest(F.lit(1.0), height * (1 - SHADOW))).otherwise(height)]


def scaled_box(box: list[Column], scale: Column, width: Column, height: Column) -> list[Column]:
    """A box by a factor, rounded half to even and kept within the canvas; its sides are one at least."""
    left, top = (F.least(F.bround(v * scale), side - 1) for v, side in zip(box[:2], (width, height), strict=True))
    left, top = (F.greatest(F.lit(0.0), v) for v in (left, top))
    wide, high = (F.greatest(F.lit(1.0), F.least(F.bround(v * scale), side - at)) for v, side, at in zip(box[2:], (width, height), (left, top), strict=True))
    return [left, top, wide, high]


def box_text(box: list[Column]) -> Column:
    """A box as text: four numbers of four decimals, whatever the machine's language."""
    return F.concat_ws(",", *[F.format_string("%.4f", v.cast("double")) for v in box])


def box_of_text(c: Column) -> Column:
    """The four numbers of a box's text; null if it isn't one."""
    parts = F.transform(F.split(c, ","), lambda p: F.try_to_number(F.trim(p), F.lit("S999999999.999999999")).cast("double"))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull()), parts)
