"""Codecs: a registry for encoders and decoders that are not in the library, their commands and default flags."""

from __future__ import annotations

import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

IMPLEMENTATIONS = ("kakadu", "openjpeg", "grok", "pillow")
#: Encoder and decoder program of each implementation, and its option for the number of threads.
PROGRAMS = {
    "kakadu": ("kdu_compress", "kdu_expand", "-num_threads"),
    "openjpeg": ("opj_compress", "opj_decompress", "-threads"),
    "grok": ("grk_compress", "grk_decompress", "-H"),
}
#: Default flags by format, implementation, layer and quality.
DEFAULT_FLAGS = (
    ("jpeg2000", "kakadu", "bg", False, "-slope 44250"),
    ("jpeg2000", "kakadu", "fg", False, "-slope 44500"),
    ("jpeg2000", "kakadu", "bg", True, "-slope 43500"),
    ("jpeg2000", "kakadu", "fg", True, "-slope 44500"),
    ("jpeg2000", "openjpeg", "bg", False, "-r 500"),
    ("jpeg2000", "openjpeg", "fg", False, "-r 750"),
    ("jpeg2000", "openjpeg", "bg", True, "-r 100"),
    ("jpeg2000", "openjpeg", "fg", True, "-r 300"),
    ("jpeg2000", "grok", "bg", False, "-r 500"),
    ("jpeg2000", "grok", "fg", False, "-r 750"),
    ("jpeg2000", "grok", "bg", True, "-r 100"),
    ("jpeg2000", "grok", "fg", True, "-r 300"),
    ("jpeg2000", "pillow", "bg", False, 'quality_mode:"rates";quality_layers:[500]'),
    ("jpeg2000", "pillow", "fg", False, 'quality_mode:"rates";quality_layers:[750]'),
    ("jpeg2000", "pillow", "bg", True, 'quality_mode:"rates";quality_layers:[100]'),
    ("jpeg2000", "pillow", "fg", True, 'quality_mode:"rates";quality_layers:[300]'),
    ("jpeg", "", "bg", False, "-S30"),
    ("jpeg", "", "fg", False, "-S20"),
    ("jpeg", "", "bg", True, "-S40"),
    ("jpeg", "", "fg", True, "-S30"),
)


class MissingCodec(ValueError):
    """An image format that needs a codec which is not registered."""


_encoders: dict[str, Callable] = {}
_decoders: dict[str, Callable] = {}


def register(name: str, encode: Callable | None = None, decode: Callable | None = None) -> None:
    """encode(array, flags) -> bytes, decode(bytes, shrink) -> array; call it in a module the workers import."""
    if encode:
        _encoders[name] = encode
    if decode:
        _decoders[name] = decode


def encoder(name: str) -> Callable:
    if name == "png":
        from folio.sources.images import encode_png

        return lambda image, flags=None: encode_png(image)
    if name not in _encoders:
        raise MissingCodec(f"no encoder {name}; register one")
    return _encoders[name]


def decoder(name: str) -> Callable:
    if name in ("png", "pnm"):
        from folio.sources.images import decode

        return lambda data, shrink=1: decode(data)
    if name not in _decoders:
        raise MissingCodec(f"no decoder {name}; register one")
    return _decoders[name]


def command(implementation: str, encode: bool, flags: list[str], threads: int | None = None) -> list[str]:
    """The command line of an implementation; one thread is written as 0 where that means none of its own."""
    if implementation not in PROGRAMS:
        raise ValueError(f"no program for {implementation}")
    encoder_, decoder_, option = PROGRAMS[implementation]
    n = threads or 1
    return [encoder_ if encode else decoder_, *flags, option, str(0 if implementation == "kakadu" and n == 1 else n)]


def available(implementation: str) -> bool:
    return implementation in PROGRAMS and all(shutil.which(p) for p in PROGRAMS[implementation][:2])


def default_flags(image_format: str, implementation: str, layer: str, hq: bool = False) -> str:
    if layer not in ("bg", "fg"):
        raise ValueError("layer must be bg or fg")
    own = implementation if image_format == "jpeg2000" else ""
    for f, i, n, q, flags in DEFAULT_FLAGS:
        if (f, i, n, q) == (image_format, own, layer, hq):
            return flags
    raise ValueError(f"no flags for {image_format} {implementation}")


def flags_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(x) for x in DEFAULT_FLAGS], "format string, implementation string, layer string, hq boolean, flags string")
