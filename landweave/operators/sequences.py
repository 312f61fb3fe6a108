"""Order-sensitive operators: admission by a sliding window, linking of neighbouring numbers, pages."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landweave.functions.text import ulpin_normal, ulpin_status


def admissions(events: DataFrame, key: str, ts: str, order: str, most: int, seconds: int) -> DataFrame:
    """(key, order, ts, admitted): at most ``most`` admitted events of a key within ``seconds``; only admitted ones count.

    A pause longer than the window forgets all, so each run between pauses is decided on its own. Runs
    are found among the time slots of a key, a slot as long as the window: a pause can only lie between
    slots, so no task sorts a key's events to find them. One run is decided in order, in one task.
    Events without a time are left out.
    """
    e = events.select(key, order, ts).withColumn("_s", F.col(ts).cast("timestamp").cast("double")).where("_s IS NOT NULL").withColumn("_slot", F.floor(F.col("_s") / seconds))
    slots = e.groupBy(key, "_slot").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    w = Window.partitionBy(key).orderBy("_slot")
    slots = slots.withColumn("_new", F.coalesce((F.col("_lo") - F.lag("_hi").over(w) > seconds).cast("int"), F.lit(1)))
    runs = slots.select(F.col(key).alias("_key"), F.col("_slot").alias("_at"), F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run")).withColumnRenamed("_at", "_slot2")
    e = e.join(runs, e[key].eqNullSafe(runs["_key"]) & (e["_slot"] == runs["_slot2"])).drop("_key", "_slot2", "_slot")
    laid = e.repartition(key, "_run").sortWithinPartitions(key, "_run", "_s", order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, deque()
        for df in frames:
            out = []
            for k, r, t in zip(df[key], df["_run"], df["_s"]):
                if (k, r) != now:
                    now, kept = (k, r), deque()
                while kept and kept[0] < t - seconds:
                    kept.popleft()
                out.append(len(kept) < most)
                if out[-1]:
                    kept.append(t)
            yield df[[key, order, ts]].assign(admitted=out)

    schema = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in (key, order, ts)) + ", admitted boolean"
    return laid.mapInPandas(run, schema)


def ulpin_groups(rows: DataFrame, column: str, reach: int = 50) -> DataFrame:
    """(ulpin, group): valid numbers of one prefix within ``reach`` of their group's seed, its least number.

    Runs without a neighbour within reach are independent, so only a run is in one task; runs are found
    among slots of numbers as wide as the reach.
    """
    n = rows.where(ulpin_status(F.col(column)) == "VALID").select(ulpin_normal(F.col(column)).alias("ulpin")).distinct()
    n = n.withColumn("_p", F.substring("ulpin", 1, 4)).withColumn("_s", F.substring("ulpin", 5, 10).cast("long")).withColumn("_slot", F.floor(F.col("_s") / reach))
    w = Window.partitionBy("_p").orderBy("_slot")
    slots = n.groupBy("_p", "_slot").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).withColumn("_new", F.coalesce((F.col("_lo") - F.lag("_hi").over(w) > reach).cast("int"), F.lit(1)))
    n = n.join(slots.select("_p", "_slot", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run")), ["_p", "_slot"]).drop("_slot")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("_s")
        seeds, seed = [], None
        for u, s in zip(df["ulpin"], df["_s"]):
            if seed is None or s - seed[1] > reach:
                seed = (u, s)
            seeds.append(seed[0])
        return pd.DataFrame({"ulpin": df["ulpin"], "group": seeds})

    return n.groupBy("_p", "_run").applyInPandas(run, "ulpin string, group string")


def page(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """A page of rows in order of ``key`` with the number of all rows."""
    total = df.agg(F.count("*").alias("number_matched"))
    return df.orderBy(key).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row of one count
