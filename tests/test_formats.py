"""Round trips of files."""

import re
import zipfile
from io import BytesIO

import numpy as np
import pytest

from folio.sources import archive, codecs, hocr, images, pdf, pdf_parts, scandata


def test_png_and_pnm():
    rng = np.random.default_rng(0)
    for v in (rng.integers(0, 256, (7, 13), dtype=np.uint8), rng.integers(0, 256, (5, 3, 3), dtype=np.uint8), rng.random((6, 11)) < 0.5):
        data = images.encode_png(v)
        assert (images.decode(data) == v).all()
        f, w, h, n, depth, _ = images.probe(data)
        assert (f, w, h, n, depth) == ("png", v.shape[1], v.shape[0], 3 if v.ndim == 3 else 1, 1 if v.dtype == bool else 8)
    pgm = b"P5 # x\n3 2\n255\n" + bytes(range(6))
    assert images.decode(pgm).tolist() == [[0, 1, 2], [3, 4, 5]] and images.probe(pgm)[:3] == ("pnm", 3, 2)


def test_probes():
    jp2 = b"\0\0\0\x0cjP  \r\n\x87\n" + b"\0" * 20 + b"ihdr" + bytes([0, 0, 0, 9, 0, 0, 0, 8, 0, 3, 7]) + b"\0" * 8
    assert images.probe(jp2) == ("jpeg2000", 8, 9, 3, 8, [])
    assert images.probe(jp2[:20])[5] == ["invalid-jp2-headers"]
    jpeg = b"\xff\xd8\xff\xe0\0\x04xx\xff\xc0\0\x11\x08\0\x05\0\x06\x03" + b"\0" * 12
    assert images.probe(jpeg) == ("jpeg", 6, 5, 3, 8, [])
    assert images.probe(b"")[0] is None and images.probe(b"hello")[0] is None
    with pytest.raises(codecs.MissingCodec):
        images.decode(jpeg)


def test_image_stack_order(spark, tmp_path):
    for n in ("b10.png", "b2.png", "a.png", "x.txt"):
        (tmp_path / n).write_bytes(images.encode_png(np.zeros((2, 2), np.uint8)))
    rows = images.image_stack(spark, str(tmp_path), "*.png").orderBy("page_idx").collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["a.png", "b10.png", "b2.png"] and rows[0].page_idx == 0


def test_hocr():
    text = """<html><div class='ocr_page' title='image "x"; bbox 0 0 100 200; scan_res 300 400'><p class='ocr_par' dir='rtl'>
      <span class='ocr_line' title='bbox 1 2 3 4; baseline 0.01 -5'><span class='ocrx_word' title='bbox 1 2 2 4; x_wconf 93; x_fsize 9'><strong>A&amp;b</strong></span> <br><span class='ocrx_word' title='bbox 2 2 3 4'>c</span></span></p></div>
      <div class='ocr_page' title='bbox 0 0 7 8'></div></html>"""
    rows = hocr.parse(text, 2.0)
    assert [(r[0], r[1], r[2], r[3], r[5], r[8], r[9], r[10], r[12], r[13]) for r in rows] == [(0, 100, 200, 400, 0, 0, "A&b", 93.0, 18.0, "RTL"), (0, 100, 200, 400, 0, 1, "c", None, 0.0, "RTL")]
    assert rows[0][7] == {"slope": 0.01, "const": -5.0}
    assert hocr.parse("") == [] and hocr.parse("<p>broken <div") == []


def test_scandata_of_one_page(spark):
    xml = '<book><bookData><dpi>300</dpi></bookData><pageData><page leafNum="7"><pageType title="T0">Title</pageType><addToAccessFormats>false</addToAccessFormats></page></pageData></book>'
    r = scandata.scandata_pages(spark.createDataFrame([(1, xml)], "doc long, xml string")).collect()
    assert len(r) == 1 and r[0].page_type["_title"] == "T0" and r[0].leaf_num == "7" and r[0].add_to_access == "false" and r[0].page_number is None


def test_pdf_offsets_and_facts():
    mask = {"width": 8, "height": 2, "data": b"\xf0\x0f", "bits": 1}
    pages = [
        {"width": 200.0, "height": 300.0, "content": "BT\n3 Tr /f-0-0 8 Tf [ <00410020> ] TJ\nET\n", "images": [{"width": 4, "height": 3, "data": bytes(12)}, {"width": 4, "height": 3, "data": bytes(36), "components": 3, "mask": mask}], "links": [{"uri": "http://x/(a)", "bbox": [1, 2, 3, 4]}]},
        *({"width": 10.0, "height": 10.0, "content": ""} for _ in range(40)),
    ]
    data = pdf.build(pages, "T & <t>", "en", "0 << /S /D /St 1 >>", [(1, "One", 0), (2, "Two", 1), (1, "Three", 5), (1, "gone", 99)])
    at = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[at : at + 4] == b"xref"
    offsets = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data)]
    assert offsets == sorted(offsets) and all(data[o:].startswith(b"%d 0 obj" % k) for k, o in enumerate(offsets, 1))
    got = pdf.Reader(data).pages()
    assert len(got) == 41 and got[0]["has_text"] and not got[1]["has_text"]
    assert [(i["width"], i["depth"], bool(i["mask_xref"])) for i in got[0]["images"]] == [(4, 8, False), (4, 8, True)]
    assert got[0]["images"][0]["bbox"] == [0, 0, 200, 300] and got[0]["links"][0]["uri"] == "http://x/(a)"
    assert b"/Limits [32 40]" in data and b"T &amp; &lt;t&gt;" in data and data.count(b"/Dest [") == 3
    with pytest.raises(ValueError):
        pdf.Builder().image(pdf.Image(0, 1, b""))
    profile = pdf.srgb_profile()
    assert int.from_bytes(profile[:4], "big") == len(profile) and profile[36:40] == b"acsp" and b"/DestOutputProfile" in data


def test_parts_of_documents(spark, tmp_path):
    rows = [(d, p, 100.0, 50.0, f"BT [ <{p:04X}> ] TJ ET", b"\xf0" * 2, 2, 4, bytes(8), 2, 4, bytes(24), 2, 4) for d, n in ((1, 70), (2, 1)) for p in range(0, 2 * n, 2)]
    pages = spark.createDataFrame(rows, "doc long, page_idx int, width double, height double, content string, mask binary, mask_height int, mask_width int, background binary, bg_height int, bg_width int, foreground binary, fg_height int, fg_width int")
    docs = spark.createDataFrame([(1, "T & <t>", "0 << /S /D /St 1 >>", [(1, "One", 0), (2, "Two", 1), (1, "Three", 69), (1, "gone", 70)]), (2, None, None, None), (3, "none", None, None)], "doc long, title string, nums string, toc array<struct<level:int,title:string,page:int>>")
    parts = pdf_parts.document_parts(pages, docs, "en")
    pdf_parts.write_files(parts, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1.pdf", "2.pdf"]
    for r in pdf_parts.assembled(parts).collect():
        data = bytes(r.pdf)
        assert (tmp_path / f"{r.doc}.pdf").read_bytes() == data
        at = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", data)[1])
        lines = data[at:].split(b"\n")
        n = int(lines[1].split()[1])
        table = lines[2 : 2 + n]
        assert lines[0] == b"xref" and len(table) == n and all(len(x) == 19 for x in table)
        for k, x in enumerate(table):
            if x.endswith(b"n "):
                assert data[int(x[:10]) :].startswith(b"%d 0 obj" % k)
        used = {k for k, x in enumerate(table) if x.endswith(b"n ")}
        assert {int(x) for x in re.findall(rb"(\d+) 0 R", data)} <= used
        got = pdf.Reader(data).pages()
        assert [bool(p["has_text"]) for p in got] == [True] * (70 if r.doc == 1 else 1)
        assert [(i["width"], bool(i["mask_xref"])) for i in got[0]["images"]] == [(4, False), (4, True)]
    one = bytes(pdf_parts.assembled(parts).where("doc = 1").first().pdf)
    assert one.count(b"/Dest [") == 3 and b"/PageLabels" in one and b"/Limits [64 69]" in one


def test_codecs():
    assert codecs.default_flags("jpeg2000", "kakadu", "fg") == "-slope 44500" and codecs.default_flags("jpeg", "kakadu", "bg", True) == "-S40"
    assert codecs.command("kakadu", True, []) == ["kdu_compress", "-num_threads", "0"]
    with pytest.raises(codecs.MissingCodec):
        codecs.encoder("jpeg2000")
    with pytest.raises(ValueError):
        codecs.default_flags("jpeg2000", "kakadu", "mask")


def test_zip(spark):
    r = spark.createDataFrame([(1, 1, 1, 2, 1, bytes([5, 6])), (1, 0, 1, 2, 1, bytes([7, 8]))], "doc long, page_idx int, height int, width int, channels int, data binary")
    z = archive.page_zips(r, spark.createDataFrame([(1, "it")], "doc long, identifier string")).first()
    names = zipfile.ZipFile(BytesIO(z.zip)).namelist()
    assert names == ["it_png/it_0000.png", "it_png/it_0001.png"]
    assert images.decode(zipfile.ZipFile(BytesIO(z.zip)).read(names[0])).tolist() == [[7, 8]]
