"""Helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a narrow table that are sent to all executors.
FEW = 250_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, a written table or cheap to count, with a broadcast hint if it has at most ``most`` rows, so that wide rows joined to it stay where they are."""
    return F.broadcast(df) if df.count() <= most else df


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that later steps refer to values and don't repeat them.

    A chain of plain projections would be merged into one expression, or pushed down with a filter,
    that evaluates every earlier step wherever it is named.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def salted(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str, most: int, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``salt_l`` and ``salt_r`` to join on beside ``on``: a value of ``on`` with more than ``most`` rows of a side is spread over parts.

    Each part meets every part of the other side once. Both sides are laid out by these keys over
    ``parts`` partitions (the session's shuffle partitions if null), a number that is kept: what
    follows grows with the pairs, not with the bytes by which small partitions would be merged.
    """

    def full(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1)

    n_l, n_r = full(left, "n_l"), full(right, "n_r")
    n = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(df: DataFrame, own: str, key: str, far: str) -> DataFrame:
        d = df.join(n_l, on, "left").join(n_r, on, "left")
        d = d.withColumn(f"salt_{own}", F.pmod(F.xxhash64(key), F.coalesce(f"n_{own}", F.lit(1))).cast("int")).withColumn(f"salt_{far}", F.explode(F.sequence(F.lit(0), F.coalesce(f"n_{far}", F.lit(1)) - 1)))
        return d.drop("n_l", "n_r").repartition(n, *on, "salt_l", "salt_r")

    return spread(left, "l", left_key, "r"), spread(right, "r", right_key, "l")
