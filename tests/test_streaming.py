"""Streams that run over what is there give what a batch gives."""

import json

import numpy as np
from pyspark.sql import functions as F

from folio.sources.images import encode_png
from folio.streaming import pages as P


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_page_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.png").write_bytes(encode_png(np.zeros((k + 1, 4), np.uint8)))
    q = P.page_files(spark, str(src)).writeStream.format("memory").queryName("files").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    drain(q)
    assert sorted(r.probe["height"] for r in spark.table("files").collect()) == [1, 2, 3]


def test_timings(spark, data, tmp_path):
    src = tmp_path / "in"
    batch = spark.read.parquet(f"{data}/timings.parquet")
    batch.write.parquet(str(src))
    q = P.windowed_timings(P.timing_stream(spark, str(src)), "1 day", "3650 days").writeStream.format("memory").queryName("wt").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    drain(q)
    got = spark.table("wt").groupBy("step_key").agg(F.sum("rows").alias("n")).collect()
    want = batch.dropDuplicates(["doc", "page_idx", "step_key", "seconds", "logged_at"]).groupBy("step_key").count().collect()
    assert {r.step_key: r.n for r in got} == {r.step_key: r["count"] for r in want}


def test_reports(spark, data, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{data}/timings.parquet").write.parquet(str(src))
    out = []
    drain(P.report_to(P.page_reports(P.timing_stream(spark, str(src)), 2), out.append, str(tmp_path / "c")))
    rows = [json.loads(x) for x in out]
    pages = {r.doc: r.n for r in spark.read.parquet(str(src)).groupBy("doc").agg(F.count_distinct("page_idx").alias("n")).collect()}
    assert rows and all(r["pages"] == 2 for r in rows)
    assert all(sum(1 for r in rows if r["doc"] == d) >= n // 2 for d, n in pages.items())
