"""Documents of other kinds: ZIP archives of page images and JSON of page facts."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.codecs import encoder


def page_json(records: DataFrame) -> DataFrame:
    """(doc, json): the records (doc, page, record) of each item as one indented text, in page order."""
    pages = records.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "record"))), lambda x: x["record"]).alias("page_data"))
    return pages.select("doc", F.to_json(F.struct(F.size("page_data").alias("page_count"), "page_data"), {"pretty": "true"}).alias("json"))


IMAGE = "struct<xref:int,width:int,height:int,depth:int,label:string,mode:string,bbox:array<double>,mask:struct<xref:int,width:int,height:int,depth:int,mode:string>,mask_xref:int>"


def two_decimals(x):
    """A coordinate in two decimals, halves to the even one."""
    return F.bround(x, 2)


def read_page_json(texts: DataFrame) -> DataFrame:
    """(doc, page, ord, xref, width, height, depth, label, mode, bbox, mask_xref, mask) of the images in (doc, json); boxes in two decimals.

    NULL and broken JSON has no rows.
    """
    read = F.from_json("json", f"page_count int, page_data array<struct<page:int,image_data:array<{IMAGE}>>>")
    pages = texts.select("doc", F.posexplode(read["page_data"]).alias("position", "p"))
    images = pages.select("doc", F.coalesce("p.page", "position").alias("page"), F.posexplode("p.image_data").alias("ord", "i"))
    return images.select("doc", "page", "ord", "i.xref", "i.width", "i.height", "i.depth", "i.label", "i.mode", F.transform("i.bbox", two_decimals).alias("bbox"), F.coalesce("i.mask.xref", "i.mask_xref").alias("mask_xref"), "i.mask")


def page_zips(rasters: DataFrame, identifiers: DataFrame, codec: str = "png") -> DataFrame:
    """(doc, pages, zip): each item's pages {id}_{codec}/{id}_0000.{codec}; identifiers: (doc, identifier)."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        encode = encoder(codec)
        out = io.BytesIO()
        name = pdf["identifier"].iloc[0]
        with zipfile.ZipFile(out, "w", allowZip64=True) as z:
            for n, r in enumerate(pdf.sort_values("page_idx").itertuples()):
                v = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                z.writestr(zipfile.ZipInfo(f"{name}_{codec}/{name}_{n:04d}.{codec}"), encode(v[:, :, 0] if r.channels == 1 else v))
        return pd.DataFrame({"doc": [key[0]], "pages": [len(pdf)], "zip": [out.getvalue()]})

    return rasters.join(identifiers, "doc").groupBy("doc").applyInPandas(one, "doc long, pages int, zip binary")
