"""Pages as they arrive: file ingest, deduplicated timings in windows of event time, reports by number of pages."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from folio.sources.images import with_probe

FILES = "path string, modificationTime timestamp, length long, content binary"


def page_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of page images with their probe; the content is read once and not carried on."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(path)
    return with_probe(files).drop("content")


def timing_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = "doc long, page_idx int, step_key string, seconds double, logged_at timestamp_ntz"
    return spark.readStream.schema(schema).parquet(path).withColumn("logged_at", F.col("logged_at").cast("timestamp"))


def windowed_timings(timings: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Seconds and rows of each step in windows of event time; repeated rows count once, rows later than ``late`` are out."""
    once = timings.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["doc", "page_idx", "step_key", "seconds", "logged_at"])
    return once.groupBy(F.window("logged_at", window), "step_key").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("rows"))


def page_reports(timings: DataFrame, every: int) -> DataFrame:
    """(doc, report, pages, seconds) of a stream whenever ``every`` more pages of an item are in; the state holds the rest."""

    def step(key, batches, state):
        pages, seconds, number = state.get if state.exists else ([], 0.0, 0)
        pages, out = set(pages), []
        for pdf in batches:
            for page, s in zip(pdf["page_idx"], pdf["seconds"]):
                pages.add(int(page))
                seconds += float(s)
                if len(pages) >= every:
                    out.append((key[0], number, len(pages), seconds))
                    pages, seconds, number = set(), 0.0, number + 1
        state.update((sorted(pages), seconds, number))
        yield pd.DataFrame(out, columns=["doc", "report", "pages", "seconds"])

    return timings.groupBy("doc").applyInPandasWithState(step, "doc long, report int, pages int, seconds double", "pages array<int>, seconds double, number int", "append", GroupStateTimeout.NoTimeout)


def report_to(stream: DataFrame, reporter: Callable[[str], None], checkpoint: str, mode: str = "append"):
    """Starts a query that hands each batch's rows to reporter as JSON lines; reports are small by their nature."""

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.toJSON().toLocalIterator():
            reporter(row)

    return stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
