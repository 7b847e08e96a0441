"""PDF: documents from page contents and layers, and the facts of pages of a document."""

from __future__ import annotations

import re
import struct
import zlib
from datetime import UTC, datetime
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCER = "Folio"
#: Pages of one node of the structure tree.
TREE_PAGES = 32


def text_string(s: str) -> str:
    return "<FEFF" + (s or "").encode("utf-16-be", "ignore").hex().upper() + ">"


def pdf_date(t: datetime) -> str:
    return t.strftime("D:%Y%m%d%H%M%SZ")


class Image(NamedTuple):
    """A picture: raw samples, or with ``filter`` the data of a codec."""

    width: int
    height: int
    data: bytes
    components: int = 1
    bits: int = 8
    filter: str | None = None


def image_entries(image: Image, smask: int | None = None) -> str:
    if image.data is None or not image.width or not image.height:
        raise ValueError("an image needs data, width and height")
    space = {1: "/DeviceGray", 3: "/DeviceRGB", 4: "/DeviceCMYK"}[image.components]
    return (
        f" /Type /XObject /Subtype /Image /Width {image.width} /Height {image.height} /BitsPerComponent {image.bits}"
        + ("" if image.filter == "JPXDecode" else f" /ColorSpace {space}")
        + (f" /SMask {smask} 0 R" if smask else "")
        + (f" /Filter /{image.filter}" if image.filter else "")
    )


def srgb_profile() -> bytes:
    """A display profile of the sRGB primaries under D50 with a gamma of 2.2."""
    fixed = lambda *v: b"".join(struct.pack(">i", round(x * 65536)) for x in v)
    xyz = lambda *v: b"XYZ \0\0\0\0" + fixed(*v)
    name = b"sRGB\0"
    curve = b"curv\0\0\0\0" + struct.pack(">IH", 1, round(2.2 * 256)) + b"\0\0"
    tags = {
        b"desc": b"desc\0\0\0\0" + struct.pack(">I", len(name)) + name + b"\0" * 79,
        b"cprt": b"text\0\0\0\0none\0",
        b"wtpt": xyz(0.9642, 1.0, 0.8249),
        b"rXYZ": xyz(0.4361, 0.2225, 0.0139),
        b"gXYZ": xyz(0.3851, 0.7169, 0.0971),
        b"bXYZ": xyz(0.1431, 0.0606, 0.7141),
        b"rTRC": curve,
        b"gTRC": curve,
        b"bTRC": curve,
    }
    at, table, body = 128 + 4 + 12 * len(tags), b"", b""
    for tag, data in tags.items():
        table += tag + struct.pack(">II", at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    size = at + len(body)
    head = struct.pack(">I4sI4s4s4s", size, b"\0\0\0\0", 0x02100000, b"mntr", b"RGB ", b"XYZ ") + struct.pack(">6H", 2000, 1, 1, 0, 0, 0) + b"acsp" + b"\0" * 28 + fixed(0.9642, 1.0, 0.8249) + b"\0" * 48
    return head + struct.pack(">I", len(tags)) + table + body


class Builder:
    """Numbered objects, put together with their table of offsets at the end."""

    def __init__(self):
        self.objects: list[bytes | None] = []

    def reserve(self) -> int:
        self.objects.append(None)
        return len(self.objects)

    def put(self, body: str | bytes, number: int | None = None) -> int:
        number = number or self.reserve()
        self.objects[number - 1] = body.encode("latin-1") if isinstance(body, str) else body
        return number

    def stream(self, data: bytes, entries: str = "", compress: bool = True, number: int | None = None) -> int:
        if compress:
            data, entries = zlib.compress(data), entries + " /Filter /FlateDecode"
        return self.put(f"<< /Length {len(data)}{entries} >>\nstream\n".encode("latin-1") + data + b"\nendstream", number)

    def image(self, image: Image, smask: int | None = None) -> int:
        """An image; data that a codec has encoded are stored as they are."""
        return self.stream(image.data, image_entries(image, smask), compress=image.filter is None)

    def document(self, root: int, info: int) -> bytes:
        out, offsets, at = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"], [], len(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
        for k, body in enumerate(self.objects, 1):
            offsets.append(at)
            piece = f"{k} 0 obj\n".encode() + (body if body is not None else b"null") + b"\nendobj\n"
            out.append(piece)
            at += len(piece)
        table = f"xref\n0 {len(offsets) + 1}\n0000000000 65535 f \n" + "".join(f"{o:010d} 00000 n \n" for o in offsets)
        out.append(f"{table}trailer\n<< /Size {len(offsets) + 1} /Root {root} 0 R /Info {info} 0 R >>\nstartxref\n{at}\n%%EOF\n".encode())
        return b"".join(out)


def glyphless_font(b: Builder) -> int:
    """A font of half-em glyphs without shapes, whose codes are UTF-16 units."""
    cmap = b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Units def /CMapType 2 def 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap end end"
    to_unicode = b.stream(cmap)
    describe = b.put("<< /Type /FontDescriptor /FontName /Glyphless /Flags 5 /FontBBox [0 0 500 1000] /Ascent 1000 /Descent -1 /CapHeight 1000 /ItalicAngle 0 /StemV 80 >>")
    cid = b.put(f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Glyphless /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor {describe} 0 R /DW 500 >>")
    return b.put(f"<< /Type /Font /Subtype /Type0 /BaseFont /Glyphless /Encoding /Identity-H /DescendantFonts [{cid} 0 R] /ToUnicode {to_unicode} 0 R >>")


def xmp(title: str, producer: str, created: datetime, conformance: bool = True, meta: dict[str, str] | None = None) -> bytes:
    """Metadata packet; texts are escaped.  meta: author, subject, language, creator tool."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    stamp = created.strftime("%Y-%m-%dT%H:%M:%SZ")
    part = '<rdf:Description rdf:about="" xmlns:pdfaid="http://www.aiim.org/pdfa/ns/id/"><pdfaid:part>3</pdfaid:part><pdfaid:conformance>B</pdfaid:conformance></rdf:Description>' if conformance else ""
    meta = meta or {}
    more = "".join(f"<dc:{k}><rdf:{kind}><rdf:li>{esc(v)}</rdf:li></rdf:{kind}></dc:{k}>" for k, kind, v in (("creator", "Seq", meta.get("author")), ("subject", "Bag", meta.get("subject")), ("language", "Bag", meta.get("language"))) if v)
    tool = f"<xmp:CreatorTool>{esc(meta['creatortool'])}</xmp:CreatorTool>" if meta.get("creatortool") else ""
    body = f'<rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title><rdf:Alt><rdf:li xml:lang="x-default">{esc(title)}</rdf:li></rdf:Alt></dc:title>{more}</rdf:Description><rdf:Description rdf:about="" xmlns:pdf="http://ns.adobe.com/pdf/1.3/"><pdf:Producer>{esc(producer)}</pdf:Producer></rdf:Description><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/"><xmp:CreateDate>{stamp}</xmp:CreateDate>{tool}</rdf:Description>'
    return f'<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">{body}{part}</rdf:RDF></x:xmpmeta><?xpacket end="w"?>'.encode()


def build(pages: list[dict], title: str = "", language: str | None = None, labels: str | None = None, toc: list[tuple[int, str, int]] = (), created: datetime | None = None) -> bytes:
    """A document of pages {width, height, content, images: [{width, height, data, components, bits, mask, ...}], links: [{uri, bbox}]}.

    Images are drawn under the text in order, each over its bbox (else the whole page), with their masks; toc holds (level, title,
    page from 0); labels is the text of the label array.
    """
    b = Builder()
    root, tree, info = b.reserve(), b.reserve(), b.reserve()
    font = glyphless_font(b)
    created = created or datetime.now(UTC)
    kids, structs = [], []
    parents = b.reserve()
    for n, p in enumerate(pages):
        names, draw = [], []
        for k, im in enumerate(p.get("images") or ()):
            own = lambda v, bits: Image(v["width"], v["height"], v["data"], v.get("components", 1), v.get("bits", bits), v.get("filter"))
            mask = b.image(own(im["mask"], 1)) if im.get("mask") is not None else None  # in its own size
            x = b.image(own(im, 8), mask)
            names.append(f"/Im{k} {x} 0 R")
            x0, y0, x1, y1 = im.get("bbox") or (0, 0, p["width"], p["height"])
            draw.append(f"q {x1 - x0:.3f} 0 0 {y1 - y0:.3f} {x0:.3f} {y0:.3f} cm /Im{k} Do Q\n")
        content = b.stream(("".join(draw) + (p.get("content") or "")).encode("latin-1", "replace"))
        annots = []
        for link in p.get("links") or ():
            annots.append(b.put("<< /Type /Annot /Subtype /Link /Border [0 0 0] /Rect [" + " ".join(f"{v:.2f}" for v in link["bbox"]) + f"] /A << /S /URI /URI ({link['uri'].replace(chr(92), chr(92) * 2).replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) >> >>"))
        page = b.put(f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {p['width']:.3f} {p['height']:.3f}] /CropBox [0 0 {p['width']:.3f} {p['height']:.3f}] /Rotate 0 /Tabs /S /StructParents {n} /Contents {content} 0 R /Resources << /Font << /f-0-0 {font} 0 R >>" + (f" /XObject << {' '.join(names)} >>" if names else "") + " >>" + (f" /Annots [{' '.join(f'{a} 0 R' for a in annots)}]" if annots else "") + " >>")
        kids.append(page)
        structs.append(b.put(f"<< /Type /StructElem /S /Div /Pg {page} 0 R /P {parents} 0 R >>"))
    b.put(f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} >>", tree)
    # the number tree of the structure in nodes of TREE_PAGES, every page in one
    nodes = []
    for at in range(0, len(structs), TREE_PAGES):
        own = range(at, min(at + TREE_PAGES, len(structs)))
        nodes.append(b.put(f"<< /Limits [{own[0]} {own[-1]}] /Nums [{' '.join(f'{k} [{structs[k]} 0 R]' for k in own)}] >>"))
    number_tree = b.put(f"<< /Kids [{' '.join(f'{k} 0 R' for k in nodes)}] >>")
    b.put(f"<< /Type /StructTreeRoot /K [{' '.join(f'{k} 0 R' for k in structs)}] /ParentTree {number_tree} 0 R >>", parents)
    outline = _outline(b, list(toc), kids)
    meta = b.stream(xmp(title, PRODUCER, created), " /Type /Metadata /Subtype /XML", compress=False)
    profile = b.stream(srgb_profile(), " /N 3")
    intent = b.put(f"<< /Type /OutputIntent /S /GTS_PDFA1 /OutputConditionIdentifier (sRGB) /Info (sRGB) /DestOutputProfile {profile} 0 R >>")
    extra = (f" /PageLabels << /Nums [{labels}] >>" if labels else "") + (f" /Outlines {outline} 0 R" if outline else "") + (f" /Lang ({language})" if language else "")
    b.put(f"<< /Type /Catalog /Pages {tree} 0 R /MarkInfo << /Marked true >> /StructTreeRoot {parents} 0 R /Metadata {meta} 0 R /OutputIntents [{intent} 0 R]{extra} >>", root)
    b.put(f"<< /Producer {text_string(PRODUCER)} /CreationDate ({pdf_date(created)}) /Title {text_string(title)} >>", info)
    return b.document(root, info)


def _outline(b: Builder, toc: list, kids: list[int]) -> int | None:
    toc = [t for t in toc if 0 <= t[2] < len(kids)]
    if not toc:
        return None
    root, numbers = b.reserve(), [b.reserve() for _ in toc]
    parent, stack = [], [(0, root)]
    for (level, _, _), n in zip(toc, numbers):
        while len(stack) > 1 and stack[-1][0] >= level:
            stack.pop()
        parent.append(stack[-1][1])
        stack.append((level, n))
    own = {p: [n for n, q in zip(numbers, parent) if q == p] for p in {root, *parent}}
    for (_, title, page), n, p in zip(toc, numbers, parent):
        row = own[p]
        k = row.index(n)
        links = (f" /Prev {row[k - 1]} 0 R" if k else "") + (f" /Next {row[k + 1]} 0 R" if k + 1 < len(row) else "")
        if n in own:
            links += f" /First {own[n][0]} 0 R /Last {own[n][-1]} 0 R /Count {len(own[n])}"
        b.put(f"<< /Title {text_string(title)} /Parent {p} 0 R /Dest [{kids[page]} 0 R /Fit]{links} >>", n)
    b.put(f"<< /Type /Outlines /First {own[root][0]} 0 R /Last {own[root][-1]} 0 R /Count {len(own[root])} >>", root)
    return root


_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")


class Reader:
    """Pages, images, links and text of a PDF whose objects stand by themselves or in object streams."""

    def __init__(self, data: bytes):
        self.data = data
        self.bodies: dict[int, bytes] = {}
        for m in _OBJECT.finditer(data):
            end = data.find(b"endobj", m.end())
            if end > 0:
                self.bodies[int(m[1])] = data[m.end() : end]
        for body in list(self.bodies.values()):
            if b"/ObjStm" in body[:300]:
                raw = self.stream(body)
                first, n = int(self.value(body, "First") or 0), int(self.value(body, "N") or 0)
                head = raw[:first].split()
                for k in range(n):
                    at = first + int(head[2 * k + 1])
                    to = first + int(head[2 * k + 3]) if k + 1 < n else len(raw)
                    self.bodies[int(head[2 * k])] = raw[at:to]

    def head(self, body: bytes) -> bytes:
        at = body.find(b"stream")
        return body if at < 0 else body[:at]

    def value(self, body: bytes, key: str) -> str | None:
        m = re.search(rb"/" + key.encode() + rb"\s*(\[[^\]]*\]|<<.*?>>|/[^\s/<>\[\]()]+|\([^)]*\)|<[0-9A-Fa-f]*>|\d+\s+\d+\s+R|[-+.\d]+|true|false|null)", self.head(body), re.S)
        return m[1].decode("latin-1") if m else None

    def ref(self, text: str | None) -> int | None:
        m = re.match(r"(\d+)\s+\d+\s+R", text or "")
        return int(m[1]) if m else None

    def stream(self, body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n", body)
        raw = body[m.end() :] if m else b""
        raw = raw[: raw.rfind(b"endstream")].rstrip(b"\r\n") if b"endstream" in raw else raw
        if "FlateDecode" in (self.value(body, "Filter") or ""):
            try:
                return zlib.decompressobj().decompress(raw)
            except zlib.error:
                return b""
        return raw

    def colour(self, text: str | None, depth: int = 0) -> tuple[str | None, int, np.ndarray | None]:
        """Name, components and palette of a colour space; profiles count by their number of components."""
        text = (text or "").strip()
        n = self.ref(text)
        if n is not None and not text.startswith("["):
            return self.colour(self.bodies.get(n, b"").decode("latin-1").strip(), depth + 1) if depth < 8 else (None, 0, None)
        name = (re.match(r"\[?\s*/([^\s/\[\]<>()]+)", text) or [None, None])[1]
        if name in ("DeviceGray", "CalGray", "G"):
            return name, 1, None
        if name in ("DeviceRGB", "CalRGB", "Lab", "RGB"):
            return name, 3, None
        if name in ("DeviceCMYK", "CMYK"):
            return name, 4, None
        if name == "ICCBased":
            body = self.bodies.get(self.ref(text[text.find("ICCBased") + 8 :].strip()) or -1, b"")
            return name, int(self.value(body, "N") or 3), None
        if name == "Separation":
            return name, 1, None
        if name == "DeviceN":
            names = re.search(r"DeviceN\s*\[([^\]]*)\]", text)
            return name, max(1, len(re.findall(r"/[^\s/\[\]]+", names[1] if names else ""))), None
        if name in ("Indexed", "I"):
            m = re.match(r"\[\s*/\w+\s+(/\w+|\d+\s+\d+\s+R|\[.*?\])\s+(\d+)\s*(.*)\]", text, re.S)
            _, k, _ = self.colour(m[1], depth + 1) if m else (None, 3, None)
            table = m[3].strip() if m else ""
            ref = self.ref(table)
            raw = self.stream(self.bodies[ref]) if ref in self.bodies else bytes.fromhex(re.sub(r"[^0-9A-Fa-f]", "", table)) if table.startswith("<") else b""
            return name, 1, np.frombuffer(raw[: len(raw) // max(k, 1) * k], np.uint8).reshape(-1, max(k, 1))
        return name, 0, None

    def picture(self, xref: int) -> dict:
        """Size, depth, mode, colour space and filter of an image, as it would be decoded: anything but one bit has eight."""
        im = self.bodies.get(xref, b"")
        number = lambda key: int(re.match(r"\d+", self.value(im, key) or "0")[0] if re.match(r"\d+", self.value(im, key) or "0") else 0)
        bits = number("BitsPerComponent") or 8
        mask = (self.value(im, "ImageMask") or "") == "true"
        name, n, palette = ("DeviceGray", 1, None) if mask else self.colour(self.whole(im, "ColorSpace"))
        if palette is not None:
            n = palette.shape[1]
        if name == "ICCBased" or name == "DeviceN":  # of unknown make: read as colours
            mode = "RGB"
        else:
            mode = {1: "L", 3: "RGB", 4: "CMYK"}.get(n)
        one = mask or bits == 1 and mode == "L" and palette is None
        return {"xref": xref, "width": number("Width"), "height": number("Height"), "depth": 1 if one else 8, "mode": "1" if one else mode, "colorspace": name, "filter": (self.value(im, "Filter") or "").strip("[]/ "), "components": n, "bits": 1 if mask else bits, "palette": palette}

    def whole(self, body: bytes, key: str) -> str | None:
        """A value with all of its nested brackets."""
        head = self.head(body).decode("latin-1")
        m = re.search(rf"/{key}\s*", head)
        if not m:
            return None
        if head[m.end() : m.end() + 1] != "[":
            return self.value(body, key)
        level, at = 0, m.end()
        for at in range(m.end(), len(head)):
            level += (head[at] == "[") - (head[at] == "]")
            if not level:
                break
        return head[m.end() : at + 1]

    def pixels(self, xref: int) -> np.ndarray | None:
        """Raster of an image: raw and deflated samples here, other filters by their registered decoders; None where it is broken."""
        from folio.sources import codecs

        p = self.picture(xref)
        w, h = p["width"], p["height"]
        body = self.bodies.get(xref, b"")
        if not w or not h:
            return None
        coded = {"DCTDecode": "jpeg", "JPXDecode": "jpeg2000", "JBIG2Decode": "jbig2", "CCITTFaxDecode": "ccitt"}.get(p["filter"])
        if coded:
            return np.asarray(codecs.decoder(coded)(self.stream(body)))
        n, bits = (1 if p["palette"] is not None else p["components"]), p["bits"]
        stride = (w * n * bits + 7) // 8
        raw = self.stream(body)
        if not n or len(raw) < stride * h:
            return None
        rows = np.frombuffer(raw, np.uint8)[: stride * h].reshape(h, stride)
        if bits < 8:
            v = (np.unpackbits(rows, axis=1)[:, : w * n * bits].reshape(h, w, n, bits) * (1 << np.arange(bits - 1, -1, -1))).sum(3)
            v = v if p["palette"] is not None else v * (255 // ((1 << bits) - 1))
        else:
            v = rows[:, :: bits // 8][:, : w * n].reshape(h, w, n)
        v = v.astype(np.uint8)
        if p["palette"] is not None:
            v = p["palette"][np.minimum(v[:, :, 0], len(p["palette"]) - 1)]
            n = v.shape[2]
        if n == 4:  # inks to light
            v = ((255 - v[:, :, :3].astype(int)) * (255 - v[:, :, 3:].astype(int)) // 255).astype(np.uint8)
        elif n == 2:
            v = v[:, :, 0]
        v = v[:, :, 0] if v.ndim == 3 and v.shape[2] == 1 else v
        return v > 127 if p["mode"] == "1" else v

    def title(self) -> str:
        """Title of the document's information, or none."""
        for body in self.bodies.values():
            if re.search(rb"/Producer\b", self.head(body)) and (raw := self.value(body, "Title")):
                if raw.startswith("<"):
                    data = bytes.fromhex(raw.strip("<>"))
                    return data[2:].decode("utf-16-be", "ignore") if data[:2] == b"\xfe\xff" else data.decode("latin-1")
                return raw.strip("()")
        return ""

    def page_numbers(self) -> list[int]:
        root = next((n for n, b in self.bodies.items() if re.search(rb"/Type\s*/Catalog\b", self.head(b))), None)
        out: list[int] = []

        def walk(n: int | None, depth: int = 0) -> None:
            body = self.bodies.get(n or -1)
            if body is None or depth > 50:
                return
            if re.search(rb"/Type\s*/Pages\b", self.head(body)):
                for k in re.findall(r"(\d+)\s+\d+\s+R", self.value(body, "Kids") or ""):
                    walk(int(k), depth + 1)
            else:
                out.append(n)

        walk(self.ref(self.value(self.bodies[root], "Pages")) if root else None)
        return out

    def pages(self) -> list[dict]:
        out = []
        for n in self.page_numbers():
            body = self.bodies[n]
            box = [float(x) for x in re.findall(r"[-+.\d]+", self.value(body, "MediaBox") or "0 0 612 792")]
            contents = self.value(body, "Contents") or ""
            content = b"\n".join(self.stream(self.bodies[int(k)]) for k in re.findall(r"(\d+)\s+\d+\s+R", contents) if int(k) in self.bodies)
            names = {}
            m = re.search(rb"/XObject\s*<<(.*?)>>", self.head(body), re.S)
            for label, k in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", m[1] if m else b""):
                names[label.decode("latin-1")] = int(k)
            place = {}
            for a, b_, c, d, e, f, label in re.findall(rb"([-+.\d]+)\s+([-+.\d]+)\s+([-+.\d]+)\s+([-+.\d]+)\s+([-+.\d]+)\s+([-+.\d]+)\s+cm\s+/([^\s]+)\s+Do", content):
                place.setdefault(label.decode("latin-1"), [float(x) for x in (a, b_, c, d, e, f)])
            images = []
            for k, (label, xref) in enumerate(names.items()):
                im = self.bodies.get(xref, b"")
                if self.value(im, "Subtype") == "/Image" and label in place:
                    t = place[label]
                    p = self.picture(xref)
                    images.append({"ord": k, "xref": xref, "mask_xref": self.ref(self.value(im, "SMask")) or self.ref(self.value(im, "Mask")) or 0, "width": p["width"], "height": p["height"], "depth": p["bits"], "label": label, "stream_filter": p["filter"], "mode": p["mode"], "colorspace": p["colorspace"], "bbox": [round(x, 2) for x in (t[4], t[5], t[4] + t[0], t[5] + t[3])], "transform": [round(x, 2) for x in t]})
            links = []
            for k in re.findall(r"(\d+)\s+\d+\s+R", self.value(body, "Annots") or ""):
                annot = self.bodies.get(int(k), b"")
                uri = re.search(rb"/URI\s*\(((?:[^()\\]|\\.)*)\)", annot)
                if uri:
                    links.append({"xref": int(k), "uri": re.sub(r"\\(.)", r"\1", uri[1].decode("latin-1")), "bbox": [float(x) for x in re.findall(r"[-+.\d]+", self.value(annot, "Rect") or "")]})
            out.append({"page": len(out), "rotation": int(self.value(body, "Rotate") or 0), "rect": [round(x, 2) for x in box], "has_text": bool(re.search(rb"\bT[jJ]\b", content)), "images": images, "links": links, "content": content.decode("latin-1")})
        return out


PAGES = (
    "page int, rotation int, rect array<double>, has_text boolean, "
    "images array<struct<ord:int,xref:int,mask_xref:int,width:int,height:int,depth:int,label:string,stream_filter:string,mode:string,colorspace:string,bbox:array<double>,transform:array<double>>>, "
    "links array<struct<xref:int,uri:string,bbox:array<double>>>, content string"
)


def pdf_pages(files: DataFrame, key: str = "doc", column: str = "pdf") -> DataFrame:
    """(key, PAGES) of files, a page a row."""
    kind = dict(files.dtypes)[key]
    names = ["page", "rotation", "rect", "has_text", "images", "links", "content"]

    def run(batches):
        for pdf in batches:
            rows = [(k, *(p[n] for n in names)) for k, data in zip(pdf[key], pdf[column]) if data is not None for p in Reader(bytes(data)).pages()]
            yield pd.DataFrame(rows, columns=[key, *names])

    return files.select(key, column).mapInPandas(run, f"{key} {kind}, {PAGES}")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    return pdf_pages(spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("pdf")), "path")


def page_rasters(files: DataFrame, key: str = "doc", column: str = "pdf") -> DataFrame:
    """(key, page_idx, height, width, channels, mode, data): the first picture of each page; pages without one have no row."""
    kind = dict(files.dtypes)[key]

    def run(batches):
        for pdf in batches:
            for k, data in zip(pdf[key], pdf[column]):
                if data is None:
                    continue
                reader = Reader(bytes(data))
                rows = []
                for p in reader.pages():
                    v = reader.pixels(p["images"][0]["xref"]) if p["images"] else None
                    if v is not None:
                        mode = "1" if v.dtype == bool else "RGB" if v.ndim == 3 else "L"
                        u = v.astype(np.uint8) * 255 if v.dtype == bool else np.ascontiguousarray(v)
                        rows.append((k, p["page"], *v.shape[:2], 3 if v.ndim == 3 else 1, mode, u.tobytes()))
                yield pd.DataFrame(rows, columns=[key, "page_idx", "height", "width", "channels", "mode", "data"])

    return files.select(key, column).mapInPandas(run, f"{key} {kind}, page_idx int, height int, width int, channels int, mode string, data binary")
