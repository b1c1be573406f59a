"""One row per record out of tables in which a record may be delivered several times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_delivery(df: DataFrame, key: str, columns: Sequence[str], order: str = "loaded_at") -> DataFrame:
    """Keep the earliest delivery of each key: columns ``key`` and ``columns``.

    Rows with a null key have no identity and are left out. Ties on ``order`` go to the smallest values; a null
    ``order`` counts as latest. The aggregate combines map-side, so a key with a third of all rows is one row per task
    before the shuffle.
    """
    rank = F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("o"), *[F.col(c).alias(c) for c in columns])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(rank).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in columns])


def strip_cr(c: Column | str) -> Column:
    """Drop one trailing carriage return."""
    return F.regexp_replace(c, "\r\\z", "")


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Comparison of two tables as multisets, whatever their order: one row, ``missing`` from and ``extra`` in the second."""
    columns = a.columns
    count = lambda df, sign: df.select(*columns, F.lit(sign).alias("_n"))
    net = count(a, 1).unionByName(count(b, -1)).groupBy(*columns).agg(F.sum("_n").alias("_n"))
    zero = F.lit(0).cast("bigint")
    return net.agg(F.coalesce(F.sum(F.greatest("_n", zero)), zero).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("_n"), zero)), zero).alias("extra"))
