"""Ratios of items with unusual sums: whole numbers, as in SQL."""

import datetime

from folio.plans import metrics


def test_no_output_and_large_sums(spark, tmp_path):
    """Images without area give no ratio; sums beyond what fits in a long by a million, or exactly in a double, are divided whole."""
    at = datetime.datetime(2024, 1, 1)
    sizes = {1: (2000, 3000, 0, 300), 2: (2000, 3000, 800, 100), 3: (2**31 - 1, 2**31 - 1, 30011, 30013)}
    spark.createDataFrame([(d, 0, "true", at) for d in sizes], "doc long, idx int, add_to_access string, loaded_at timestamp").write.parquet(f"{tmp_path}/scandata_pages.parquet")
    spark.createDataFrame([(d, 0, w, h) for d, (w, h, _, _) in sizes.items()], "doc long, page_idx int, imwidth int, imheight int").write.parquet(f"{tmp_path}/page_geometry.parquet")
    spark.createDataFrame([(d, w, h, 8) for d, (_, _, w, h) in sizes.items()], "doc long, width int, height int, depth int").write.parquet(f"{tmp_path}/page_images.parquet")
    got = {r.doc: (r.source, r.output, r.ratio_millionths) for r in metrics.compression_ratio(spark, str(tmp_path)).collect()}
    want = {d: (w * h, a * b, w * h * 10**6 // (a * b) if a * b else None) for d, (w, h, a, b) in sizes.items()}
    assert got == want
