"""Resolution, page size and the layout of words on a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Resolutions that are guessed, in order of preference at a tie, and the size in inches they assume.
CANDIDATE_DPI = (72, 96, 150, 300, 600)
INCHES = (8.27, 11.69)
#: A PDF page is wider than the first and narrower than the second (units of 1/72 inch).
LEAST_UNITS, MOST_UNITS = 3.0, 14400.0


def whole_number(text: Column) -> Column:
    """int of a text of digits with or without blanks around them, else NULL."""
    bare = F.trim(text)
    return F.when(bare.rlike("^[+-]?[0-9]{1,9}$"), bare.try_cast("int"))


def guess_dpi(width: Column, height: Column) -> Column:
    """The candidate whose page of INCHES is nearest to the image."""
    off = [F.struct((F.abs(width / INCHES[0] - d) + F.abs(height / INCHES[1] - d)).alias("off"), F.lit(k).alias("k"), F.lit(d).alias("dpi")) for k, d in enumerate(CANDIDATE_DPI)]
    return F.array_min(F.array(*off))["dpi"]


def valid_width(units: Column) -> Column:
    return (units > LEAST_UNITS) & (units < MOST_UNITS)


def prec(x: Column) -> Column:
    """x at three decimals, halves to even on the scaled value; no negative zero."""
    return F.bround(x * 1000, 0) / 1000 + F.lit(0.0)


def clip_baseline(ppi: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """y1 and y2, both at their mean where the line hardly rises and is not short."""
    flat = (F.abs(y1 - y2) * 72 < 2 * ppi) & (2 * ppi < F.abs(x1 - x2) * 72)
    mean = (y1 + y2) / 2
    return F.when(flat, mean).otherwise(y1), F.when(flat, mean).otherwise(y2)


def word_baseline(rtl: Column, ppi: Column, height: Column, word: dict[str, Column], line: dict[str, Column]) -> dict[str, Column]:
    """x and y of a word's first corner projected on its line's baseline, and the word's diagonal.

    In points from the lower left corner of the page; right-to-left words start at their other corner.
    """
    wx, wy = F.when(rtl, word["x1"]).otherwise(word["x0"]), F.when(rtl, word["y1"]).otherwise(word["y0"])
    run, rise = line["x2"] - line["x1"], line["y2"] - line["y1"]
    span = run * run + rise * rise
    share = ((wx - line["x2"]) * run + (wy - line["y2"]) * rise) / F.nullif(span, F.lit(0.0))
    x = F.coalesce(line["x2"] + share * run, line["x1"])
    y = F.coalesce(line["y2"] + share * rise, line["y1"])
    dx, dy = word["x1"] - word["x0"], word["y1"] - word["y0"]
    return {"x": x * 72 / ppi, "y": height - y * 72 / ppi, "length": F.sqrt(dx * dx + dy * dy) * 72 / ppi}


def text_matrix(rtl: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """Rotation of a line of text; right-to-left text is mirrored."""
    theta = F.atan2(y1 - y2, x2 - x1)
    sign = F.when(rtl, -1.0).otherwise(1.0)
    return {"a": sign * F.cos(theta), "b": sign * F.sin(theta), "c": -F.sin(theta), "d": F.cos(theta)}


def font_size(size: Column, y1: Column, y2: Column) -> Column:
    """The given size, or the line's rise where it is none, or 8."""
    rise = F.abs(y2 - y1)
    return F.when(size > 0, size).when(rise > 0, rise).otherwise(F.lit(8.0))


def stretch(length: Column, size: Column, text: Column) -> Column:
    """Horizontal scaling in per cent that fills length with the text and a space, in a font of half-em glyphs."""
    return 2 * prec(100 * length / (size * (F.length(text) + 1)))
