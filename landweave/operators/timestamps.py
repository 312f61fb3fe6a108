"""Texts that name a time, in many formats, precisions and zones, as one UTC instant.

A value has one or more readings (``28/02/21`` reads as day-month-year or year-month-day). The
readings of a source are a mixture: expectation-maximisation over the counts of values by the set
of readings that are valid for them gives each source's weights, and the posterior of a value
chooses its reading. Where the source's office declares its date order, that order is the prior
with all the weight, so the mixture stays there and a value that isn't valid in that order names
no day. Where nothing is declared the weights are learned, and a value whose best reading stays
below ``SURE`` and whose readings differ is marked ambiguous and gets no instant.

All of it is JVM expressions. Counts by source and set are at most eight rows a source, however
many values it has; only these are iterated over.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions.columns import step

#: A learned reading below this posterior is left unresolved.
SURE = 0.95
ORDERS = ("DMY", "MDY", "YMD")
#: Seconds that GPS time is ahead of UTC.
GPS_AHEAD_S = 18
_US = 1_000_000
_SEP = "\u0001"

#: Minutes east of UTC of zone letters that several zones use, by the office's zone; the common reading is in ``ZONE_LETTERS``.
OFFICE_LETTERS = {
    "Asia/Dhaka|BST": 360, "Europe/London|BST": 60, "Asia/Jerusalem|IST": 120, "Europe/Dublin|IST": 60, "Asia/Kolkata|IST": 330, "America/New_York|EST": -300, "Australia/Sydney|EST": 600, "Australia/Sydney|AEST": 600,
    "America/Chicago|CST": -360, "Asia/Shanghai|CST": 480, "America/Havana|CST": -300, "Asia/Dubai|GST": 240, "Asia/Karachi|PKT": 300, "Asia/Manila|PST": 480, "America/Los_Angeles|PST": -480, "Asia/Riyadh|AST": 180, "America/Halifax|AST": -240,
}
#: Zone letters and their minutes east of UTC.
ZONE_LETTERS = {
    "Z": 0, "UTC": 0, "GMT": 0, "IST": 330, "NPT": 345, "GST": 240, "CET": 60, "CEST": 120,
    "BST": 60, "EST": -300, "EDT": -240, "AEST": 600, "AEDT": 660,
}
#: First three letters of English month names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_TIME = (
    r"(?:(?:t| |, ?)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?"  # hour minute second fraction
    r" ?(am|pm|a\.m\.|p\.m\.)?"
    r" ?(z|[+-]\d{2}:?\d{2}|[a-z]{3,4})?"
    r"(?:\[([a-z_/+-]+)\])?$"
)
# Each replaces a value by kind and three date parts; the time's seven parts follow.
_FORMS = [
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TIME, ["Y", "$1", "$3", "$4"], 5),
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + _TIME, ["N", "$1", "$3", "$4"], 5),
    (r"^(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(\d{2})?(z)?)?$", ["Y", "$1", "$2", "$3", "$4", "$5", "$6", "", "", "$7", ""], 0),
    (r"^(?:[a-z]{3,9},? )?(\d{1,2})(?:st|nd|rd|th)?[- ](" + _MONTH + r")[-, ]+(\d{4}|\d{2})" + _TIME, ["M", "$3", "$2", "$1"], 4),
    (r"^(?:[a-z]{3,9},? )?(" + _MONTH + r") (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + _TIME, ["M", "$3", "$1", "$2"], 4),
    (r"^(\d{4})-w(\d{2})-(\d)$", ["W", "$1", "$2", "$3"], None),
    (r"^(\d{4})-(\d{3})$", ["O", "$1", "$2", ""], None),
    (r"^(\d{10}|\d{13}|\d{16})$", ["E", "$1", "", ""], None),
    (r"^gps ?w? ?(\d{1,4}) ?[:/ ] ?(\d+(?:\.\d+)?)$", ["G", "$1", "$2", ""], None),
]


def _split_forms(text: Column) -> Column:
    """array of kind, three date parts, hour, minute, second, fraction, half, zone, place; or null."""
    out = F.lit(None).cast("string")
    for pattern, head, first in reversed(_FORMS):
        parts = list(head)
        if first:
            parts += [f"${first + i}" for i in range(7)]
        parts += [""] * (11 - len(parts))
        # Parts that don't take part in a match come out empty.
        out = F.when(text.rlike("(?i)" + pattern), F.regexp_replace(text, "(?i)" + pattern, _SEP.join(parts))).otherwise(out)
    return F.split(out, _SEP, -1)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _day(y: Column, m: Column, d: Column) -> Column:
    """Micros from 1970 of an existing day's midnight, as if in UTC, or null."""
    return F.unix_micros(F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))


def clean(value: Column) -> Column:
    """Digits of any Indian script as ASCII; blanks, also no-break ones, joined and trimmed."""
    ascii_digits = F.translate(value, "०१२३४५६७८९০১২৩৪৫৬৭৮৯", "01234567890123456789")
    return F.trim(F.regexp_replace(ascii_digits, r"[\s ​﻿]+", " "))


def readings(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``_p`` (parts), ``_days`` (midnight by reading) and ``_mask`` (valid readings).

    ``_days`` has one entry for a value with a single reading and one for each of ``ORDERS`` for an
    all-numeric date with its year not first; ``_mask`` is null for the former.
    """
    df = step(step(df, _t=clean(F.col(value))), _p=_split_forms(F.col("_t")))
    p = lambda i: F.col("_p")[i]
    df = step(df, _n1=F.when(p(0) != "E", _int(p(1))), _n2=_int(p(2)), _n3=_int(p(3)))
    kind, a, n1, b, c = p(0), p(1), F.col("_n1"), F.col("_n2"), F.col("_n3")
    year = F.when((kind == "M") & (F.length(a) == 2), n1 + 2000).otherwise(n1)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(p(2), 1, 3))).cast("int")
    jan4 = F.unix_micros(F.try_make_timestamp(n1, F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    day_us = 86_400 * _US
    jan4_dow = F.pmod(F.floor(jan4 / day_us) + 3, F.lit(7))  # Monday is 0
    week = jan4 + ((b - 1) * 7 + (c - 1) - jan4_dow).cast("long") * day_us
    week_ok = (b >= 1) & c.between(1, 7) & (F.expr("extract(YEAROFWEEK FROM timestamp_micros(_week))") == n1)
    leap = (n1 % 4 == 0) & ((n1 % 100 != 0) | (n1 % 400 == 0))
    ordinal = F.when(b.between(1, F.when(leap, 366).otherwise(365)), _day(n1, F.lit(1), F.lit(1)) + (b - 1).cast("long") * day_us)
    y_last = F.when(F.length(p(3)) == 4, c).when(F.length(p(3)) == 2, c + 2000)
    numeric = F.array(
        _day(y_last, b, n1),
        _day(y_last, n1, b),
        F.when(F.length(p(3)) == 2, _day(n1 + 2000, b, c)),
    )
    epoch = F.col("_t").try_cast("decimal(20,0)")
    instant = (
        F.when((kind == "E") & (F.length(a) == 10), epoch * _US).when((kind == "E") & (F.length(a) == 13), epoch * 1000).when(kind == "E", epoch)
        .when((kind == "G") & (p(2).try_cast("decimal(20,6)") < 604_800), (F.lit(315_964_800 - GPS_AHEAD_S) + n1 * 604_800 + p(2).try_cast("decimal(20,6)")) * _US)
    ).cast("long")
    df = step(df, _week=F.when(kind == "W", week), _fixed=instant)
    single = (
        F.when(kind == "Y", _day(n1, b, c)).when(kind == "M", _day(year, month, c))
        .when((kind == "W") & week_ok, F.col("_week")).when(kind == "O", ordinal)
    )
    df = step(df, _days=F.when(kind == "N", numeric).otherwise(F.array(single)))
    bits = sum(F.when(F.col("_days")[i].isNotNull(), 1 << i).otherwise(0) for i in range(3))
    return step(df, _mask=F.when(kind == "N", bits)).drop("_week", "_n1", "_n2", "_n3")


def _mixture(rows: pd.DataFrame) -> pd.DataFrame:
    """Weights of the readings of one source by expectation-maximisation."""
    declared = rows["date_order"].iloc[0]
    masks, counts = rows["mask"].to_numpy(), rows["n"].to_numpy(dtype=float)
    prior = [1.0 if declared == o else 0.0 for o in ORDERS] if declared in ORDERS else [1 / 3] * 3
    w = list(prior)
    for _ in range(200):
        got = [0.0] * 3
        for m, n in zip(masks, counts):
            like = [w[i] if m >> i & 1 else 0.0 for i in range(3)]
            total = sum(like)
            if total > 0:
                for i in range(3):
                    got[i] += n * like[i] / total
        total = sum(got)
        new = [(g / total) if total else p for g, p in zip(got, prior)]
        if max(abs(x - y) for x, y in zip(w, new)) < 1e-9:
            break
        w = new
    return pd.DataFrame({"source": [rows["source"].iloc[0]], "weights": [w], "n_values": [int(counts.sum())]})


def mixtures(parsed: DataFrame) -> DataFrame:
    """(source, weights, n_values): the mixture of readings of each source, from all its values."""
    counts = (
        parsed.where(F.col("_mask") > 0).groupBy("source", "date_order", F.col("_mask").alias("mask")).agg(F.count("*").alias("n"))
    )
    # At most one row a source and mask: seven rows a group.
    return counts.groupBy("source").applyInPandas(_mixture, "source string, weights array<double>, n_values bigint")


def instants(df: DataFrame, value: str) -> DataFrame:
    """Adds ``instant_us``, ``reading``, ``posterior`` and ``is_ambiguous`` to ``df``.

    ``df`` has the text column ``value`` and ``source``, ``date_order`` and ``time_zone`` (each may
    be null). Null, blank and unreadable texts, and texts that name no existing day, get a null
    instant. A value without a zone is local time of ``time_zone`` (UTC if that is null): a time that occurs
    twice is the earlier, one in a gap moves on by the gap. Repeated rows are kept. Other columns
    of ``df`` pass through; its names must not begin with an underscore.
    """
    parsed = readings(df, value)
    return resolve(parsed, mixtures(parsed))


def resolve(parsed: DataFrame, learned: DataFrame | None) -> DataFrame:
    """The last step of ``instants`` on the result of ``readings``, with the weights of ``mixtures``.

    Without them, as in a stream that can't be read twice, a declared order decides and what would
    have to be learned stays ambiguous.
    """
    if learned is None:
        declared = F.array(*[F.when(F.col("date_order") == o, 1.0).otherwise(0.0) for o in ORDERS])
        joined = parsed.withColumn("_weights", F.when(F.col("date_order").isin(*ORDERS), declared))
    else:
        joined = parsed.join(learned.select("source", F.col("weights").alias("_weights")), "source", "left")
    w = F.coalesce(F.col("_weights"), F.array(*[F.lit(1 / 3)] * 3))
    like = F.expr("transform(_days, (x, i) -> CASE WHEN x IS NULL THEN 0D ELSE coalesce(_w[i], 0D) END)")
    numeric = F.col("_p")[0] == "N"
    joined = step(step(joined, _w=w), _like=like)
    total = F.aggregate("_like", F.lit(0.0), lambda s, x: s + x)
    best = F.array_max("_like")
    pos = (F.array_position("_like", best) - 1).cast("int")
    joined = step(joined, _pos=F.when(numeric & (best > 0), pos), posterior=F.when(numeric & (total > 0), best / total))
    distinct_days = F.expr("size(array_distinct(filter(_days, x -> x IS NOT NULL)))")
    joined = step(joined, is_ambiguous=F.coalesce(numeric & (distinct_days > 1) & (F.col("posterior") < SURE), F.lit(False)))
    day = F.when(numeric, F.when(~F.col("is_ambiguous") & F.col("_pos").isNotNull(), F.col("_days")[F.col("_pos")])).otherwise(F.col("_days")[0])
    p = lambda i: F.col("_p")[i]
    half = F.lower(F.substring(p(8), 1, 1))
    joined = step(joined, _day=day, _h=_int(p(4)))
    day, h = F.col("_day"), F.col("_h")
    hour = F.when(half == "", h).when(h.between(1, 12), (h % 12) + F.when(half == "p", 12).otherwise(0))
    minute, second = _int(p(5)), F.coalesce(_int(p(6)), F.lit(0))
    fraction = F.coalesce(F.rpad(F.substring(p(7), 1, 6), 6, "0").try_cast("long"), F.lit(0))
    of_day = F.when(F.coalesce(p(4), F.lit("")) == "", F.lit(0).cast("long")).when(
        hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59), ((hour * 3600 + minute * 60 + second).cast("long") * _US + fraction)
    )
    joined = step(joined, _local=day + of_day, _zone=F.upper(F.coalesce(p(9), F.lit(""))))
    local, zone = F.col("_local"), F.col("_zone")
    offset = F.when(zone.rlike("^[+-]"), F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.expr("try_cast(right(_zone, 2) AS int)")))
    letters = F.create_map(*[F.lit(x) for kv in ZONE_LETTERS.items() for x in kv])
    own = F.create_map(*[F.lit(x) for kv in OFFICE_LETTERS.items() for x in kv])
    # A bare day takes no zone letters; letters that no zone has make the text unreadable.
    offset = F.when(zone == "", F.lit(None).cast("int")).otherwise(F.coalesce(offset, F.element_at(own, F.concat_ws("|", "time_zone", zone)), F.element_at(letters, zone)))
    place = F.coalesce(F.when(p(10) != "", p(10)), F.col("time_zone"), F.lit("UTC"))
    at_place = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), place))
    instant = F.when(F.col("_fixed").isNotNull(), F.col("_fixed")).when(zone == "", at_place).when(offset.isNotNull(), local - offset.cast("long") * 60 * _US)
    reading = F.when(numeric & F.col("_pos").isNotNull(), F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("_pos") + 1)).otherwise(p(0))
    joined = step(joined, reading=reading, instant_us=instant)
    return joined.drop("_day", "_h", "_local", "_zone", "_t", "_p", "_days", "_mask", "_fixed", "_w", "_like", "_pos", "_weights")


def with_office(df: DataFrame, dataset: str, profiles: DataFrame, offices: DataFrame) -> DataFrame:
    """Adds ``source``, ``date_order`` and ``time_zone`` of the office that produced each row's dataset.

    A row of an unknown dataset has its dataset as source and neither order nor zone.
    """
    by = (
        profiles.select(F.col("dataset_id").alias("_ds"), "office_id").dropDuplicates(["_ds"])
        .join(offices.select("office_id", "date_order", "time_zone").dropDuplicates(["office_id"]), "office_id", "left")
    )
    return df.join(by, df[dataset] == by["_ds"], "left").withColumn("source", F.coalesce("office_id", F.col(dataset), F.lit(""))).drop("_ds", "office_id")
