"""Encodings of text in PDF and XML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-16BE"))


def title_hex(text: Column) -> Column:
    return F.concat(F.lit("FEFF"), utf16_hex(text))


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def fixed8(x: Column) -> Column:
    return F.format_string("%.8f", x)


def file_name(prefix: Column | str, index: Column, suffix: str) -> Column:
    return F.format_string("%s_%06d." + suffix, F.lit(prefix) if isinstance(prefix, str) else prefix, index)


def flag_map(flags: Column) -> Column:
    """Codec flags k:v;k:v as a map; values keep their further colons."""
    entries = F.transform(F.filter(F.split(flags, ";"), lambda x: x != ""), lambda x: F.struct(F.split(x, ":", 2)[0].alias("key"), F.coalesce(F.get(F.split(x, ":", 2), F.lit(1)), F.lit("")).alias("value")))
    return F.map_from_entries(entries)


def first_given(*values: Column) -> Column:
    """The first value that is neither NULL nor blank."""
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in values))


def stamp(t: Column, pdf: bool = False) -> Column:
    """A UTC time as in PDF dates or as ISO seconds."""
    return F.date_format(t, "'D:'yyyyMMddHHmmss'Z'" if pdf else "yyyy-MM-dd'T'HH:mm:ss'Z'")
