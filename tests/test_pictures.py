"""Pictures of PDFs, layers with other codecs, pages of one bit, and recompression."""

import sys
import types
import zlib

import numpy as np
import pytest

from folio.plans import recode as R
from folio.plans.recompress import _document, without_pictures
from folio.sources import archive, codecs, images, pdf


def row(**own):
    base = {"doc": 1, "page_idx": 0, "raster_height": None, "raster_width": None, "channels": 1, "data": None, "mode": None, "boxes": None, "imwidth": None, "imheight": None, "dpi": 60, "hq": False, "warnings": []}
    return types.SimpleNamespace(**base | own)


def gray(rng, h=60, w=80):
    v = rng.integers(200, 256, (h, w), dtype=np.uint8)
    v[20:30, 10:60:4] = 20
    return v


def test_pages_of_one_bit():
    rng = np.random.default_rng(1)
    v = gray(rng)
    plain = row(raster_height=60, raster_width=80, data=v.tobytes())
    layers, size, _ = R.page_layers(plain, R.Options())
    assert set(layers) == {"mask", "background", "foreground"} and size == v.size
    forced, _, _ = R.page_layers(plain, R.Options(bitonal=True))
    mask = np.unpackbits(np.frombuffer(layers["mask"].data, np.uint8).reshape(60, -1), axis=1)[:, :80]
    inverse = np.unpackbits(np.frombuffer(forced["whole"].data, np.uint8).reshape(60, -1), axis=1)[:, :80]
    assert set(forced) == {"whole"} and (inverse == 1 - mask).all() and forced["whole"].bits == 1
    own, _, _ = R.page_layers(row(raster_height=60, raster_width=80, mode="1", data=v.tobytes()), R.Options())
    bits = np.unpackbits(np.frombuffer(own["whole"].data, np.uint8).reshape(60, -1), axis=1)[:, :80]
    assert (bits == (v > 127)).all()  # past the separation
    assert R.page_layers(row(), R.Options()) == ({}, 0, []) and R.page_layers(row(raster_height=2, raster_width=2, data=b"1"), R.Options())[0] == {}


def test_boxes_in_pixels_of_the_raster(spark):
    words = spark.createDataFrame([(1, 0, 0, n, 0, "w", 90.0, b) for n, b in enumerate([(0.0, 0.0, 100.0, 20.0), (5.0, 5.0, 5.0, 9.0), (9.0, 9.0, 4.0, 12.0), (150.0, 10.0, 220.0, 30.0), (-1.0, 0.0, 5.0, 5.0)])], "doc long, page_idx int, par int, line int, word int, text string, conf double, line_bbox struct<x0:double,y0:double,x1:double,y1:double>")
    geometry = spark.createDataFrame([(1, 0, 200, 100)], "doc long, page_idx int, imwidth int, imheight int")
    r = R.text_boxes(words, geometry).first()
    assert [tuple(b) for b in r.boxes] == [(0, 0, 100, 20)]  # degenerate, inverted and outside ones are gone
    assert R._boxes(r, (50, 400)) == [(0, 0, 200, 10)]


def test_codecs_of_layers(tmp_path):
    seen = []
    module = types.ModuleType("folio_test_codecs")
    sys.modules["folio_test_codecs"] = module
    codecs.register("jpeg2000", encode=lambda v, flags: seen.append(flags) or b"JP" + zlib.compress(v.tobytes()))
    codecs.register("jbig2", encode=lambda v, flags: b"JB" + np.packbits(v).tobytes())
    try:
        r = row(raster_height=60, raster_width=80, data=gray(np.random.default_rng(2)).tobytes(), hq=True)
        options = R.Options(layer_format="jpeg2000", mask_format="jbig2", implementation="grok", fg_flags="-r 9", codecs="folio_test_codecs", side_output=str(tmp_path))
        layers, _, _ = R.page_layers(r, options)
        assert [layers[k].filter for k in ("mask", "background", "foreground")] == ["JBIG2Decode", "JPXDecode", "JPXDecode"]
        assert sorted(seen) == ["-r 100", "-r 300"]  # the flags of good quality
        assert sorted(p.name for p in (tmp_path / "1").iterdir()) == ["000000_bg.jp2", "000000_fg.jp2", "000000_mask.jbig2"]
        seen.clear()
        R.page_layers(row(**{**vars(r), "hq": False}), options)
        assert sorted(seen) == ["-r 500", "-r 9"]
    finally:
        codecs._encoders.clear()
        del sys.modules["folio_test_codecs"]
    with pytest.raises(codecs.MissingCodec):
        R.page_layers(r, R.Options(layer_format="jpeg2000"))
    with pytest.raises(ValueError):
        R.Options(mask_format="jpeg")


def test_image_files_are_read_by_path(tmp_path):
    v = gray(np.random.default_rng(3))
    path = tmp_path / "a.png"
    path.write_bytes(images.encode_png(v))
    layers, size, _ = R.page_layers(row(path=f"file:{path}"), R.Options(bg_downsample=2, downsample=2))
    assert size == v.size and (layers["mask"].width, layers["background"].width) == (40, 20)


def test_colour_spaces():
    rgb = bytes(range(12))
    objects = {
        1: b"<< /Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace [/ICCBased 9 0 R] /Length 12 >>\nstream\n" + rgb + b"\nendstream",
        2: b"<< /Subtype /Image /Width 4 /Height 1 /BitsPerComponent 2 /ColorSpace [/Indexed /DeviceRGB 2 <000000FF0000FFFFFF>] /Length 1 >>\nstream\n" + bytes([0b00011000]) + b"\nendstream",
        3: b"<< /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceCMYK /Length 4 >>\nstream\n" + bytes([0, 255, 0, 0]) + b"\nendstream",
        4: b"<< /Subtype /Image /Width 8 /Height 1 /ImageMask true /Length 1 >>\nstream\n\xf0\nendstream",
        5: b"<< /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace [/DeviceN [/Cyan /Gold] /DeviceCMYK 8 0 R] /Length 2 >>\nstream\nab\nendstream",
        6: b"<< /Subtype /Image /Width 9 /Height 9 /BitsPerComponent 8 /ColorSpace /DeviceGray /Length 2 >>\nstream\nab\nendstream",
        7: b"<< /Subtype /Image /Width 9 /Height 9 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /DCTDecode /Length 2 >>\nstream\nab\nendstream",
        9: b"<< /N 3 /Length 0 >>\nstream\n\nendstream",
    }
    r = pdf.Reader(b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n" % k + v + b"\nendobj\n" for k, v in objects.items()))
    modes = {k: (r.picture(k)["mode"], r.picture(k)["depth"], r.picture(k)["colorspace"]) for k in (1, 2, 3, 4, 5)}
    assert modes == {1: ("RGB", 8, "ICCBased"), 2: ("RGB", 8, "Indexed"), 3: ("CMYK", 8, "DeviceCMYK"), 4: ("1", 1, "DeviceGray"), 5: ("RGB", 8, "DeviceN")}
    assert r.pixels(1).tobytes() == rgb
    assert r.pixels(2).tolist() == [[[0, 0, 0], [255, 0, 0], [255, 255, 255], [0, 0, 0]]]
    assert r.pixels(3).tolist() == [[[255, 0, 255]]] and r.pixels(4).tolist() == [[True] * 4 + [False] * 4]
    assert r.pixels(5).shape == (1, 1) and r.pixels(6) is None
    with pytest.raises(codecs.MissingCodec):
        r.pixels(7)


def test_recompression_keeps_places_links_and_text():
    v = gray(np.random.default_rng(4))
    page = {"width": 80.0, "height": 60.0, "content": "BT [ <0041> ] TJ ET", "images": [{"width": 80, "height": 60, "data": v.tobytes(), "bbox": [5, 6, 45, 36]}], "links": [{"uri": "http://x", "bbox": [1, 2, 3, 4]}]}
    got = pdf.Reader(_document(pdf.build([page], "A title"), {0: [{"x0": 8, "y0": 18, "x1": 70, "y1": 32}]}, "fast", 3))
    own = got.pages()[0]
    assert got.title() == "A title" and own["has_text"] and own["links"][0]["uri"] == "http://x"
    assert [i["bbox"] for i in own["images"]] == [[5, 6, 45, 36]] * 2 and [i["width"] for i in own["images"]] == [26, 80] and own["images"][1]["mask_xref"]
    assert own["content"].count(" Do") == 2
    assert without_pictures("q /Im0 Do Q /im1 do /Im10 Do", ["Im0", "Im1"]) == "q  Q  /Im10 Do"


def test_page_json_is_read(spark):
    text = '{"page_count": 2, "page_data": [{"page": 0, "image_data": [{"xref": 4, "width": 2, "height": 3, "depth": 8, "label": "a", "bbox": [0.126, 1.0, 2.5, 3.375], "mask": {"xref": 9}}]}, {"image_data": []}]}'
    r = archive.read_page_json(spark.createDataFrame([(1, text), (2, None), (3, "{")], "doc long, json string")).collect()
    assert [(x.doc, x.page, x.xref, x.mask_xref, x.bbox) for x in r] == [(1, 0, 4, 9, [0.13, 1.0, 2.5, 3.38])]
