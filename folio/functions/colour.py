"""Colour modes and grey levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image format of each PDF stream filter.
FORMATS = {"JPXDecode": "jpeg2000", "DCTDecode": "jpeg", "JBIG2Decode": "jbig2", "CCITTFaxDecode": "ccitt", "FlateDecode": "png"}


def stream_format(stream_filter: Column) -> Column:
    """Likely image format of a stream filter; NULL where it is none of the known ones."""
    return F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))[stream_filter]


def pixel_mode(depth: Column, components: Column) -> Column:
    """1, L, RGB or CMYK by bits and number of colour components."""
    return F.when((depth == 1) & (components == 1), "1").when(components == 1, "L").when(components == 3, "RGB").when(components == 4, "CMYK")


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey of a colour, in thousandths 299, 587 and 114, rounded."""
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")


def level(v: Column, low: Column, high: Column) -> Column:
    """v stretched so that low becomes 0 and high 255, cut off beyond them."""
    return F.when(v <= low, 0).when(v >= high, 255).otherwise(F.floor((v - low) * 255 / (high - low))).cast("int")


def from_percent(v: Column) -> Column:
    return v * 255 / 100
