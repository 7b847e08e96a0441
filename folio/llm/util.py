"""What several operators of this package share: reading, broadcasting under a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a table may have that an operator sends to every executor.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_rows(df: DataFrame, most: int = BROADCAST_ROWS) -> list | None:
    """The rows of df, or None where it has more than ``most``."""
    rows = df.limit(most + 1).collect()
    return None if len(rows) > most else rows


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """df, a plain scan, over at least as many partitions as there are cores; no shuffle where it has them.

    Counting the partitions of a join would run it, so joins are not passed through here.
    """
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes not to be a column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of df with the greatest counts, at most ``most`` of them, cut where counts differ by about a fifth."""
    return frequent_and_rest(df, count, most)[0]


def frequent_and_rest(df: DataFrame, count: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """most_frequent, and the other rows, all with smaller counts, or None where there are none.

    Only a histogram of the counts' logarithms reaches the driver, and no row is sorted.
    """
    step = F.floor(F.log2(F.greatest(F.col(count), F.lit(1))) * 4).cast("int")
    sizes = sorted(((r[0], r[1]) for r in df.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total = 0
    for b, n in sizes:
        total += n
        if total > most:
            return df.where(step > b), df.where(step <= b)
    return df if sizes else df.limit(0), None
