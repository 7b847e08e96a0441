"""Running sums and neighbours along the rows of a key, when one key may hold a large share of all rows.

The rows of a key are cut into blocks of SIZE positions.  Windows run within blocks, so no task sees more than a
block; one row a block is summed up and passed on along the key, and joined back on the partitioning that the
windows already have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 8192


def with_context(df: DataFrame, keys: list[str], order: str, before: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, following: dict[str, Column] | None = None, size: int = SIZE) -> DataFrame:
    """df with new columns: ``before``, the sums over the rows before each; ``previous``, the values of the row before it
    (NULL at the first); ``following``, the first value after it that is not NULL.

    order is a whole number, unique within the keys.
    """
    before, previous, following = before or {}, previous or {}, following or {}
    cut = df.withColumn("_block", F.floor(F.col(order) / size))
    own = Window.partitionBy(*keys, "_block").orderBy(order)
    at = F.col(order)
    summary = cut.groupBy(*keys, "_block").agg(
        *(F.coalesce(F.sum(v), F.lit(0)).alias(f"_s_{n}") for n, v in before.items()),
        *(F.max_by(v, at).alias(f"_p_{n}") for n, v in previous.items()),
        *(F.min_by(v, F.when(v.isNotNull(), at)).alias(f"_f_{n}") for n, v in following.items()),
    )
    along = Window.partitionBy(*keys).orderBy("_block")
    passed = summary.select(
        *keys,
        "_block",
        *(F.coalesce(F.sum(f"_s_{n}").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_s_{n}") for n in before),
        *(F.lag(f"_p_{n}").over(along).alias(f"_p_{n}") for n in previous),
        *(F.first(f"_f_{n}", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias(f"_f_{n}") for n in following),
    )
    inside = cut.withColumns(
        {f"_i_{n}": F.coalesce(F.sum(v).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n, v in before.items()}
        | {f"_l_{n}": F.lag(v).over(own) for n, v in previous.items()}
        | {"_first": F.row_number().over(own) == 1}
        | {f"_n_{n}": F.first(v, ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing)) for n, v in following.items()}
    )
    joined = inside.join(passed, [*keys, "_block"])
    new = {n: F.col(f"_i_{n}") + F.col(f"_s_{n}") for n in before} | {n: F.when(F.col("_first"), F.col(f"_p_{n}")).otherwise(F.col(f"_l_{n}")) for n in previous} | {n: F.coalesce(f"_n_{n}", f"_f_{n}") for n in following}
    drop = ["_block", "_first", *(f"_{k}_{n}" for n in before for k in "is"), *(f"_{k}_{n}" for n in previous for k in "lp"), *(f"_{k}_{n}" for n in following for k in "nf")]
    return joined.withColumns(new).drop(*drop)
