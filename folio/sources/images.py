"""Image files: stacks of them in order, what their first bytes tell, and rasters without a codec's help."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAD_JP2 = "invalid-jp2-headers"
PROBE = "format string, width int, height int, channels int, depth int, warnings array<string>"


def image_stack(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, page_idx): files in the order of their names, without their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    order = Window.partitionBy(F.regexp_extract("path", "^(.*)/", 1)).orderBy("path")
    return files.withColumn("page_idx", F.row_number().over(order) - 1)


def probe(head: bytes) -> tuple[str | None, int | None, int | None, int | None, int | None, list[str]]:
    """format, width, height, channels, depth and warnings from the first bytes of a file."""
    none = (None, None, None, None, None, [])
    if not head:
        return none
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 26:
        w, h, depth, kind = struct.unpack(">IIBB", head[16:26])
        return "png", w, h, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind), depth, []
    if head[:2] in (b"P4", b"P5", b"P6"):
        fields = _pnm_fields(head)
        if fields:
            return "pnm", fields[0], fields[1], 3 if head[:2] == b"P6" else 1, 1 if head[:2] == b"P4" else 8, []
        return none
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(head) and head[at] == 0xFF:
            kind, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                depth, h, w, n = struct.unpack(">BHHB", head[at + 4 : at + 10])
                return "jpeg", w, h, n, depth, []
            at += 2 + size
        return "jpeg", None, None, None, None, []
    if head[4:12] == b"jP  \r\n\x87\n":
        at = head.find(b"ihdr")
        if at < 0 or len(head) < at + 15:
            return "jpeg2000", None, None, None, None, [BAD_JP2]
        h, w, n, depth = struct.unpack(">IIHB", head[at + 4 : at + 15])
        if not w or not h:
            return "jpeg2000", None, None, None, None, [BAD_JP2]
        return "jpeg2000", w, h, n, (depth & 0x7F) + 1, []
    if head[:4] in (b"II*\0", b"MM\0*"):
        e = "<" if head[:2] == b"II" else ">"
        (at,) = struct.unpack(e + "I", head[4:8])
        tags = {}
        if at + 2 <= len(head):
            (n,) = struct.unpack(e + "H", head[at : at + 2])
            for k in range(n):
                field = head[at + 2 + 12 * k : at + 14 + 12 * k]
                if len(field) == 12:
                    tag, kind, _ = struct.unpack(e + "HHI", field[:8])
                    tags[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), field[8:10] if kind == 3 else field[8:])[0]
        return "tiff", tags.get(256), tags.get(257), tags.get(277, 1), tags.get(258, 1), []
    return none


def _pnm_fields(data: bytes) -> tuple[int, int, int] | None:
    """width, height and where the pixels begin."""
    need, at, out = (2 if data[:2] == b"P4" else 3), 2, []
    while len(out) < need:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at)
            if at < 0:
                return None
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        out.append(int(data[at:end]))
        at = end
    return out[0], out[1], at + 1


def with_probe(files: DataFrame, column: str = "content") -> DataFrame:
    """files with PROBE of the first 64 KB of their content; NULL where the format is not known."""

    @F.pandas_udf(PROBE)
    def probed(head: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in PROBE.split(", ")]
        out = pd.DataFrame([probe(bytes(x) if x is not None else b"") for x in head], columns=names)
        return out.astype({n: "Int32" for n in names[1:5]})

    return files.withColumn("probe", probed(F.substring(column, 1, 65536)))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(image: np.ndarray) -> bytes:
    """PNG of a bool (1 bit), gray or colour raster, without loss."""
    h, w = image.shape[:2]
    if image.dtype == bool:
        depth, kind, rows = 1, 0, np.packbits(image, axis=1)
    else:
        depth, kind, rows = 8, 2 if image.ndim == 3 else 0, image.reshape(h, -1).astype(np.uint8)
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rows), 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """Raster of a PNG (not interlaced) or binary PNM; alpha is dropped, a palette looked up, 1 bit gives bool."""
    if data[:2] in (b"P4", b"P5", b"P6"):
        fields = _pnm_fields(data)
        if not fields:
            raise ValueError("broken PNM header")
        w, h, at = fields
        if data[:2] == b"P4":
            rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
            return np.unpackbits(rows, axis=1)[:, :w].astype(bool)
        n = 3 if data[:2] == b"P6" else 1
        v = np.frombuffer(data, np.uint8, h * w * n, at).reshape(h, w, n)
        return v[:, :, 0] if n == 1 else v
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        from folio.sources.codecs import MissingCodec

        raise MissingCodec(f"no decoder for {probe(data[:65536])[0] or 'this format'}; register one with codecs.register")
    at, idat, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    w, h, depth, kind, _, _, interlaced = head
    if interlaced or depth == 16:
        raise ValueError("interlaced and 16-bit PNG are not read")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    stride, step = (w * n * depth + 7) // 8, max(1, n * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.int64)
    if not raw[:, 0].any():  # no row is filtered
        out = raw[:, 1:]
    for y in range(h) if raw[:, 0].any() else ():
        f, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if f == 1:
            line = np.concatenate([np.cumsum(line[k::step])[:, None] for k in range(step)], 1).ravel() if stride % step == 0 else line
        elif f == 2:
            line = line + above
        elif f in (3, 4):
            for x in range(stride):
                a = int(line[x - step]) & 255 if x >= step else 0
                b, c = int(above[x]), int(above[x - step]) if x >= step else 0
                if f == 3:
                    p = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[x] = (int(line[x]) + p) & 255
        above = line & 255
        out[y] = above
    if depth < 8:
        bits = np.unpackbits(out, axis=1)[:, : w * depth].reshape(h, w, depth)
        v = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
        if kind == 3:
            return palette[v]
        return v.astype(bool) if depth == 1 else (v * (255 // ((1 << depth) - 1))).astype(np.uint8)
    v = out.reshape(h, w, n)
    if kind == 3:
        return palette[v[:, :, 0]]
    return v[:, :, 0] if n <= 2 else v[:, :, :3]


def rasters(files: DataFrame) -> DataFrame:
    """files (doc, page_idx, content) as rasters (doc, page_idx, height, width, channels, mode, data)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.content is None:
                    continue
                v = decode(bytes(r.content))
                mode = "1" if v.dtype == bool else "RGB" if v.ndim == 3 else "L"
                u = (v * 255).astype(np.uint8) if v.dtype == bool else np.ascontiguousarray(v)
                rows.append((r.doc, r.page_idx, *v.shape[:2], 3 if v.ndim == 3 else 1, mode, u.tobytes()))
            yield pd.DataFrame(rows, columns=["doc", "page_idx", "height", "width", "channels", "mode", "data"])

    return files.select("doc", "page_idx", "content").mapInPandas(run, "doc long, page_idx int, height int, width int, channels int, mode string, data binary")


def write_stack(rasters: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """(keys, path, bytes): rasters (keys, height, width, channels, data) as PNG files of a folder that all executors share.

    A file is named by its keys and put in place when it is whole, so a task that runs twice does no harm.
    """
    kinds = dict(rasters.dtypes)
    folder = folder.removeprefix("file://").removeprefix("file:")

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                v = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                path = os.path.join(folder, "_".join(str(r[k]) for k in keys) + ".png")
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(encode_png(v[:, :, 0] if r["channels"] == 1 else v))
                os.replace(f"{path}.{os.getpid()}", path)
                rows.append((*(r[k] for k in keys), path, len(r["data"])))
            yield pd.DataFrame(rows, columns=[*keys, "path", "bytes"])

    return rasters.select(*keys, "height", "width", "channels", "data").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", path string, bytes long")
