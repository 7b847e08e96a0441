"""Queries on rasters.  The vectors of the table of embeddings serve as one: a row each, values as grey levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import colour as C
from folio.operators import raster as R
from folio.operators.mrc import components
from folio.plans.pages import read


def raster(spark, d):
    e = read(spark, d, "embeddings").select(F.lit(0).cast("long").alias("doc"), F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return e.select("doc", "y", "x", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("e").cast("double") * 255 + 128))).cast("int").alias("p"))


def colours(spark, d):
    """The raster in groups of three columns as red, green and blue, a picture of each row."""
    r = raster(spark, d)
    at = lambda k: F.max(F.when(F.col("x") % 3 == k, F.col("p")))
    return r.where("x < 63").groupBy(F.col("y").alias("doc"), F.expr("x div 3").cast("int").alias("x")).agg(at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))


def sauvola_mean(spark, d):
    return R.sauvola(raster(spark, d), 7).select("y", "x", "mean", "var")


def sauvola_mask(spark, d):
    return R.sauvola(raster(spark, d), 7).select("y", "x", "dark")


def line_threshold(spark, d):
    return R.sauvola(raster(spark, d), 25, k=0.1).select("y", "x", "dark")


def mask_ratio(spark, d):
    return R.sauvola(raster(spark, d), 7).groupBy("doc").agg(F.sum(F.col("dark").cast("long")).alias("ones"), F.count("*").alias("size"))


def mask_union(spark, d):
    r = raster(spark, d)
    return R.union(R.sauvola(r, 7).select("doc", "y", "x", "dark"), R.sauvola(r, 25, k=0.1)).where("dark").select("y", "x")


def mask_complement(spark, d):
    return R.complement(R.sauvola(raster(spark, d), 7)).where("dark").select("y", "x")


def neighbour_count(spark, d):
    return R.neighbours(R.sauvola(raster(spark, d), 7).select("doc", "y", "x", "dark"), 2).select("y", "x", "others")


def channel_stats(spark, d):
    c = colours(spark, d)
    one = lambda n: [F.min(n).alias(f"{n}_min"), F.max(n).alias(f"{n}_max"), F.sum(F.col(n).cast("long")).alias(f"{n}_sum"), F.floor(F.stddev_pop(n) * 1000 + 0.5).cast("long").alias(f"{n}_std")]
    return c.agg(*one("r"), *one("g"), *one("b"))


def page_colour_mode(spark, d):
    return R.colour_mode(colours(spark, d))


def grey_levels(spark, d):
    c = colours(spark, d)
    return c.select("doc", "x", C.luma(F.col("r"), F.col("g"), F.col("b")).alias("grey"))


def level_stretch(spark, d):
    return raster(spark, d).select("y", "x", C.level(F.col("p"), F.lit(60), F.lit(200)).alias("level"), (255 - F.col("p")).alias("inverse"))


def layer_composite(spark, d):
    """The raster over its inverse by the mask, the second layer where it is not dark."""
    return R.sauvola(raster(spark, d), 7).select("y", "x", F.when(F.col("dark"), F.col("p")).otherwise(255 - F.col("p")).alias("v"))


def pages_of(spark, d):
    """The raster in strips of 25 rows as pages of bytes, each value a square of four pixels, dark below 100, with a text box each."""
    r = raster(spark, d).withColumn("ink", F.repeat(F.when(F.col("p") < 100, "1E").otherwise("EB"), 4))
    rows = r.groupBy(F.expr("cast(y div 25 as int)").alias("page_idx"), "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ink"))), lambda q: q["ink"]), "").alias("row"))
    pages = rows.groupBy("page_idx").agg((F.count("*") * 4).cast("int").alias("height"), F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda q: F.repeat(q["row"], F.lit(4))), "")).alias("data"))
    box = F.struct(F.lit(8).alias("x0"), F.lit(20).alias("y0"), F.lit(240).alias("x1"), F.least(F.lit(80), F.col("height")).alias("y1"))
    return pages.select(F.lit(0).cast("long").alias("doc"), "page_idx", "height", F.lit(256).alias("width"), F.lit(1).alias("channels"), "data", F.lit(60).alias("dpi"), F.array(box).alias("boxes"))


def mrc_components(spark, d):
    c = components(pages_of(spark, d), bg_downsample=3)
    return c.select("doc", "page_idx", "height", "width", F.sha2("mask", 256).alias("mask"), F.sha2("foreground", 256).alias("foreground"), "bg_height", "bg_width", F.sha2("background", 256).alias("background"), F.array_join("warnings", ",").alias("warnings"))


def layer_fill(spark, d):
    c = components(pages_of(spark, d), denoise="none")
    return c.select("doc", "page_idx", F.length("foreground").alias("bytes"), F.sha2("foreground", 256).alias("foreground"), F.sha2("background", 256).alias("background"))


def mask_denoise(spark, d):
    a = components(pages_of(spark, d), denoise="none").select("doc", "page_idx", F.sha2("mask", 256).alias("before"))
    b = components(pages_of(spark, d), denoise="fast").select("doc", "page_idx", F.sha2("mask", 256).alias("after"))
    return a.join(b, ["doc", "page_idx"]).select("doc", "page_idx", "before", "after")


def page_figures(spark, d):
    """Noise of each page of bytes, and the mean of its adaptive grey with the page as all three channels."""
    from folio.operators import kernels as K

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                v = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
                rows.append((r.page_idx, round(K.page_noise_level(v), 6), round(float(K.adaptive_gray(np.dstack([v] * 3)).mean()), 6), int(K.partial_blur(v < 100, v).mean()), int(K.total_variation(v < 100).sum())))
            yield pd.DataFrame(rows, columns=["page_idx", "noise", "grey", "blurred", "smooth"])

    return pages_of(spark, d).select("page_idx", "height", "width", "data").mapInPandas(run, "page_idx int, noise double, grey double, blurred int, smooth long")


def step_timings(spark, d):
    c = components(pages_of(spark, d))
    return c.select("doc", "page_idx", F.explode("timing").alias("t")).groupBy("t.key").agg(F.count("*").alias("pages"))


QUERIES = {f.__name__: f for f in (sauvola_mean, sauvola_mask, line_threshold, mask_ratio, mask_union, mask_complement, neighbour_count, channel_stats, page_colour_mode, grey_levels, level_stretch, layer_composite, mrc_components, layer_fill, mask_denoise, page_figures, step_timings)}

RASTER_SQL = "ra AS (SELECT vec_id AS y, unnest(range(0, len(embedding)))::INT AS x, unnest(embedding) AS e FROM embeddings), px AS (SELECT y, x, least(255, greatest(0, floor(e::DOUBLE * 255 + 128)))::INT AS p FROM ra)"


def box_sql(name: str, source: str, r: int, values: dict[str, str]) -> str:
    down = f"OVER (PARTITION BY x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    across = f"OVER (PARTITION BY y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    return f"{name}_d AS (SELECT *, {', '.join(f'sum({v}) {down} AS d_{k}' for k, v in values.items())} FROM {source}), {name} AS (SELECT *, {', '.join(f'(sum(d_{k}) {across})::BIGINT AS {k}' for k in values)} FROM {name}_d)"


def sauvola_sql(name: str, r: int, k: float) -> str:
    return (
        box_sql(f"{name}_b", "px", r, {"s1": "p::BIGINT", "s2": "p::BIGINT * p", "n": "1"})
        + f", {name}_m AS (SELECT y, x, p, s1 // n AS mean, s2 // n - (s1 // n) * (s1 // n) AS var FROM {name}_b), {name} AS (SELECT *, p + mean * ({k - 1!r})::DOUBLE <= 0 OR (p + mean * ({k - 1!r})::DOUBLE) * (p + mean * ({k - 1!r})::DOUBLE) <= mean::DOUBLE * mean * ({k * k / (128.0 * 128.0)!r})::DOUBLE * var AS dark FROM {name}_m)"
    )


A, B = sauvola_sql("a", 7, 0.34), sauvola_sql("b", 25, 0.1)
COLOUR_SQL = f"{RASTER_SQL}, co AS (SELECT y AS doc, x // 3 AS x, max(p) FILTER (x % 3 = 0) AS r, max(p) FILTER (x % 3 = 1) AS g, max(p) FILTER (x % 3 = 2) AS b FROM px WHERE x < 63 GROUP BY y, x // 3)"
ORACLES = {
    "step_timings": "SELECT unnest(['grey_conversion', 'hocr_mask_gen', 'threshold', 'fast_denoise', 'fg_partial_blur', 'bg_partial_blur']) AS key, (count(*) + 24) // 25 AS pages FROM embeddings",
    "sauvola_mean": f"WITH {RASTER_SQL}, {A} SELECT y, x, mean, var FROM a",
    "sauvola_mask": f"WITH {RASTER_SQL}, {A} SELECT y, x, dark FROM a",
    "line_threshold": f"WITH {RASTER_SQL}, {B} SELECT y, x, dark FROM b",
    "mask_ratio": f"WITH {RASTER_SQL}, {A} SELECT 0::BIGINT AS doc, count(*) FILTER (dark) AS ones, count(*) AS size FROM a",
    "mask_union": f"WITH {RASTER_SQL}, {A}, {B} SELECT y, x FROM a WHERE dark UNION SELECT y, x FROM b WHERE dark",
    "mask_complement": f"WITH {RASTER_SQL}, {A} SELECT y, x FROM px EXCEPT SELECT y, x FROM a WHERE dark",
    "neighbour_count": f"WITH {RASTER_SQL}, {A}, m AS (SELECT y, x, dark::INT AS o FROM a), {box_sql('q', 'm', 2, {'c': 'o'})} SELECT y, x, c - o AS others FROM q",
    "channel_stats": f"WITH {COLOUR_SQL} SELECT " + ", ".join(f"min({n}) AS {n}_min, max({n}) AS {n}_max, sum({n})::BIGINT AS {n}_sum, floor(stddev_pop({n}) * 1000 + 0.5)::BIGINT AS {n}_std" for n in "rgb") + " FROM co",
    "page_colour_mode": f"WITH {COLOUR_SQL} SELECT doc, CASE WHEN NOT bool_and(r = g AND g = b) THEN 'RGB' WHEN bool_and(r IN (lo, hi)) THEN 'Bitonal' ELSE 'Grayscale' END AS mode FROM (SELECT *, min(least(r, g, b)) OVER (PARTITION BY doc) AS lo, max(greatest(r, g, b)) OVER (PARTITION BY doc) AS hi FROM co) GROUP BY doc",
    "grey_levels": f"WITH {COLOUR_SQL} SELECT doc, x::INT AS x, ((r * 299 + g * 587 + b * 114 + 500) // 1000)::INT AS grey FROM co",
    "level_stretch": f"WITH {RASTER_SQL} SELECT y, x, CASE WHEN p <= 60 THEN 0 WHEN p >= 200 THEN 255 ELSE (p - 60) * 255 // 140 END AS level, 255 - p AS inverse FROM px",
    "layer_composite": f"WITH {RASTER_SQL}, {A} SELECT y, x, CASE WHEN dark THEN p ELSE 255 - p END AS v FROM a",
}
