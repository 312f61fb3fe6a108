"""Streaming forms: normalised records with keyed upsert, windowed counts with late data, and the rate limiter with state."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from landweave.operators import timestamps


def parsed_times(stream: DataFrame, value: str) -> DataFrame:
    """A stream of time texts with ``instant_us``, ``reading``, ``posterior`` and ``is_ambiguous``, as ``timestamps.instants`` adds them.

    The stream has ``source``, ``date_order`` and ``time_zone``; what a mixture would have to learn from
    all values stays ambiguous.
    """
    return timestamps.resolve(timestamps.readings(stream, value), None)


def window_counts(stream: DataFrame, ts: str, key: str, length: str, late: str) -> DataFrame:
    """Events by key and tumbling window; rows later than ``late`` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), key, "events")


def admissions(stream: DataFrame, key: str, ts: str, most: int, seconds: int) -> DataFrame:
    """(key, ts, admitted): the sliding-window limiter; state holds the times of at most ``most`` admitted events a key."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for df in frames:
            df = df.sort_values(ts)
            out = []
            for t in df[ts]:
                now = t.timestamp()
                kept = [x for x in kept if x >= now - seconds]
                out.append(len(kept) < most)
                if out[-1]:
                    kept.append(now)
            yield pd.DataFrame({key: k[0], ts: df[ts], "admitted": out})
        state.update((kept,))

    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {ts} timestamp, admitted boolean"
    return stream.groupBy(key).applyInPandasWithState(run, schema, "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions below ``path``, the latest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        return []
    names = [str(f.getPath().getName()) for f in fs.listStatus(hadoop(path))]
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(hadoop(f"{path}/{n}/_SUCCESS"))]
    return sorted((int(n[1:]) for n in done), reverse=True)


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table that ``upsert`` keeps at ``path``: of each bucket the latest version; null if nothing was written yet.

    A version holds the buckets that its batch touched. ``before`` leaves later versions out.
    """
    kept, seen = [], set()
    for n in _versions(spark, path):
        if before is not None and n >= before:
            continue
        rows = spark.read.parquet(f"{path}/v{n}")
        # Buckets are a bounded number of folders; their names, not their rows, come to the driver.
        own = [r[0] for r in rows.select("_bucket").distinct().collect()]
        fresh = [b for b in own if b not in seen]
        if fresh:
            kept.append(rows.where(F.col("_bucket").isin(*fresh)))
            seen |= set(fresh)
    return reduce(DataFrame.unionByName, kept).drop("_bucket") if kept else None


def upsert(path: str, key: str, order: str, buckets: int = 64):
    """A ``foreachBatch`` function that keeps the latest row of each key in a Parquet table, read by ``current``.

    Keys are hashed to ``buckets``; a batch reads and rewrites only those it touches, as a version
    named by its number, from all versions before it, however far back they lie. A batch that runs
    again after a failure replaces its own version and comes to the same rows. Null keys are one key.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
        if touched:
            last = current(spark, path, number)
            rows = batch if last is None else batch.unionByName(last.where(bucket.isin(*touched)))
            newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
            newest.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v{number}")
        batch.unpersist()

    return run
