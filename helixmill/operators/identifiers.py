"""Identifier streams: tokens, and each token against the same place in the identifier before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helixmill.functions.seq import id_tokens, token_type


def tokens(reads: DataFrame, idx: str = "read_idx", ident: str = "id") -> DataFrame:
    """One row per token: ``idx``, ``pos`` from 0, ``tok``, ``type``."""
    return reads.select(F.col(idx).alias("read_idx"), F.posexplode(id_tokens(ident)).alias("pos", "tok")).withColumn("type", token_type("tok"))


def against_previous(toks: DataFrame, block: int) -> DataFrame:
    """How each token follows from the identifier one index before it in the same block.

    ``match`` if equal, ``delta`` if both are numbers and it is larger by less than 256, else its own type. Blocks bound
    the group a window works on.
    """
    per = W.partitionBy(F.floor(F.col("read_idx") / block), "pos").orderBy("read_idx")
    near = F.lag("read_idx").over(per) == F.col("read_idx") - 1
    prev, kind = F.lag("tok").over(per), F.lag("type").over(per)
    diff = F.when((F.col("type") == "digit") & (kind == "digit"), F.col("tok").cast("bigint") - prev.cast("bigint"))
    coded = F.when(near & (prev == F.col("tok")), "match").when(near & (diff > 0) & (diff < 256), "delta").otherwise(F.col("type"))
    return toks.withColumn("coded", coded).withColumn("delta", F.when(F.col("coded") == "delta", diff))


def untokenise(toks: DataFrame) -> DataFrame:
    """Identifiers from their tokens."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "tok")))
    return toks.groupBy("read_idx").agg(F.array_join(F.transform(parts, lambda x: x["tok"]), "").alias("id"))


def file_pattern(pairs: DataFrame, code) -> DataFrame:
    """The pattern of the first pair, if all pairs obey it, else 0: one row ``pattern``.

    ``pairs`` has ``pair_idx``, ``id_1`` and ``id_2``; ``code`` is the pattern of one pair as a column.
    """
    from helixmill.functions.seq import fits_pattern

    first = pairs.agg(F.min_by(code, "pair_idx").alias("first")).first()["first"]
    obeys = F.coalesce(fits_pattern("id_1", "id_2", int(first or 0)), F.lit(False))
    return pairs.agg(F.when(F.bool_and(obeys), int(first or 0)).otherwise(0).alias("pattern"))
