"""One consistent table of deliveries whose fields drift, and a list of every change.

A row is read as a map from path (the top-level key, case and all) to a raw value with its JSON
type, as a VARIANT, in the JVM. Statistics of path and type by delivery, a few rows each, show
what was added, removed and retyped. A removed and an added field are one renamed field if the
same records carry the same content under both: content is compared in a normal form that takes
off wrappers, units and spellings of yes and no, by an equi-join on the record, so it needs no
list of names. Only fields that changed take part in that join.
"""

from __future__ import annotations

import pandas as pd
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landweave.functions.columns import step
from landweave.session import Stage

#: Agreement of the records beyond chance (Cohen's kappa) that makes a rename. By chance alone two
#: unrelated yes-or-no fields often agree on two thirds of the records; their kappa is about 0.
SAME_CONTENT = 0.6

#: Changed fields, some 100 bytes each, up to which their list is broadcast.
BROADCAST_FIELDS = 200_000

#: Texts that stand for no value, lower case.
FILLERS = ("", "-", "--", "na", "n/a", "none", "null", "nil")
_YES, _NO = ("y", "yes", "true", "t", "haan", "ha"), ("n", "no", "false", "f", "nahi", "nahin")


def fields(rows: DataFrame, json: str, *keep: str) -> DataFrame:
    """One row for each field of each readable row: ``keep``, ``field``, ``kind`` and ``value`` (variant).

    ``kind`` is number, string, boolean, array, object or null. Null and unreadable texts, and
    texts that are no JSON object, give no rows.
    """
    v = rows.select(*keep, F.try_parse_json(F.col(json)).alias("_v"))
    return typed(v.select(*keep, F.explode(F.try_variant_get("_v", "$", "map<string,variant>")).alias("field", "value")))


def typed(each: DataFrame) -> DataFrame:
    """Adds ``kind``, the JSON type of ``value``."""
    t = F.col("_t")
    kind = (
        F.when(t.isNull() | (t == "VOID"), "null").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
        .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("number")
    )
    return step(step(each, _t=F.schema_of_variant("value")), kind=kind).drop("_t")


def plain(value: Column, kind: Column) -> Column:
    """The text of a value without its wrapper: an object's ``value``, an array's items joined by blanks."""
    items = F.array_join(F.try_variant_get(value, "$", "array<string>"), " ")
    return F.when(kind == "object", F.coalesce(F.try_variant_get(value, "$.value", "string"), F.try_variant_get(value, "$", "string"))).when(
        kind == "array", items
    ).otherwise(F.try_variant_get(value, "$", "string"))


def content(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds ``name``: the normal form by which values of two deliveries are compared; null for fillers."""
    t = F.col("_c")
    number = F.regexp_extract(t, r"^(?:no|nr|num|number|rs|inr)?\.? ?#? ?(-?\d+(?:\.\d+)?) ?(?:%|[a-z]{1,4}\.? ?[a-z]?\.?)?$", 1)
    day = F.unix_seconds(F.try_to_timestamp(F.concat(t, F.lit(" +00:00")), F.lit("yyyy-MM-dd XXX")))
    form = (
        F.when(t.isin(*FILLERS), None).when(t.isin(*_YES), "1.0").when(t.isin(*_NO), "0.0")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.cast("double").cast("string"))
        .when(F.col("_n") != "", F.col("_n").try_cast("double").cast("string")).otherwise(t)
    )
    df = step(step(df, _c=F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))), _n=number)
    return step(df, **{name: form}).drop("_c", "_n")


def _statistics(rows: DataFrame, json: str) -> DataFrame:
    """(feed_id, delivery_no, field, kind): fields of each delivery with the type of most non-null values, or null."""
    by = fields(rows, json, "feed_id", "delivery_no").groupBy("feed_id", "delivery_no", "field", "kind").agg(F.count("*").alias("n"))
    typed = F.when(F.col("kind") != "null", F.struct("n", F.col("kind").alias("k")))
    return by.groupBy("feed_id", "delivery_no", "field").agg(F.max(typed).alias("top")).select("feed_id", "delivery_no", "field", F.col("top.k").alias("kind"))


def _renames(rows: DataFrame, json: str, gone: DataFrame, come: DataFrame, stage: Stage) -> DataFrame:
    """(feed_id, delivery_no, before, after) of fields whose content goes on under another name."""
    changed = gone.select("feed_id", (F.col("delivery_no") - 1).alias("delivery_no"), "field", F.col("delivery_no").alias("change_no"), F.lit("before").alias("side"))
    changed = changed.unionByName(come.select("feed_id", "delivery_no", "field", F.col("delivery_no").alias("change_no"), F.lit("after").alias("side")))
    v = rows.where(F.col("record_id").isNotNull()).select("feed_id", "delivery_no", "record_id", F.try_parse_json(F.col(json)).alias("_v"))
    each = v.select("feed_id", "delivery_no", "record_id", F.explode(F.try_variant_get("_v", "$", "map<string,variant>")).alias("field", "value"))
    # Only fields that changed go on; the list is of fields by delivery, not of rows. It is broadcast
    # if it is small, which spares a shuffle of all fields of all rows, and joined by a shuffle else.
    small = changed.limit(BROADCAST_FIELDS + 1).count() <= BROADCAST_FIELDS
    each = typed(each.join(F.broadcast(changed) if small else changed, ["feed_id", "delivery_no", "field"]))
    each = content(step(each, text=plain(F.col("value"), F.col("kind"))), F.col("text"), "form")
    each = each.select("feed_id", "change_no", "record_id", "side", "field", F.explode(F.array_compact(F.array("form"))).alias("form"))
    values = stage.write(each.groupBy("feed_id", "change_no", "record_id", "side", "field").agg(F.min("form").alias("form")))
    half = lambda side: values.where(F.col("side") == side).select("feed_id", "change_no", "record_id", F.col("field").alias(side), F.col("form").alias(f"v_{side}"))
    both = half("before").join(half("after"), ["feed_id", "change_no", "record_id"])
    pair = ["feed_id", "change_no", "before", "after"]
    cells = both.groupBy(*pair, "v_before", "v_after").agg(F.count("*").alias("n"))
    side = lambda v, b, a: F.struct(F.col(v).alias("v"), b.alias("nb"), a.alias("na"), F.when(F.col("v_before") == F.col("v_after"), b).otherwise(0).alias("hit"))
    zero = F.lit(0).cast("long")
    margins = (
        cells.select(*pair, F.inline(F.array(side("v_before", F.col("n"), zero), side("v_after", zero, F.col("n")))))
        .groupBy(*pair, "v").agg(*[F.sum(c).alias(c) for c in ("nb", "na", "hit")])
        .groupBy(*pair).agg(F.sum("nb").cast("double").alias("n"), F.sum("hit").alias("hit"), F.sum(F.col("nb").cast("double") * F.col("na")).alias("cross"))
    )
    chance = F.col("cross") / (F.col("n") * F.col("n"))
    observed = F.col("hit") / F.col("n")
    # Where both sides have one and the same value there is nothing beyond chance; the share itself decides.
    kappa = F.when(chance >= 1, observed).otherwise((observed - chance) / F.nullif(1 - chance, F.lit(0.0)))
    good = margins.withColumn("same", kappa).where(F.col("same") >= SAME_CONTENT)
    rank = lambda c: F.row_number().over(Window.partitionBy("feed_id", "change_no", c).orderBy(F.desc("same"), F.desc("n"), "before", "after"))
    best = good.withColumn("rb", rank("before")).withColumn("ra", rank("after")).where("rb = 1 AND ra = 1")
    return best.select("feed_id", F.col("change_no").alias("delivery_no"), "before", "after")


def changes(rows: DataFrame, json: str = "attributes_raw") -> DataFrame:
    """(feed_id, delivery_no, change_kind, field_before, field_after) of each delivery against the one before.

    ``rows`` has feed_id, delivery_no, record_id and the JSON text. A delivery whose predecessor
    is missing has no changes. A renamed field whose type also differs gives two rows. Repeated
    rows change nothing but the counts of types.
    """
    stage = Stage(rows.sparkSession)
    stats = stage.write(_statistics(rows, json))
    known = stats.select("feed_id", "delivery_no").distinct()
    now = stats.join(known.select("feed_id", (F.col("delivery_no") + 1).alias("delivery_no")), ["feed_id", "delivery_no"], "left_semi")
    before = stats.select("feed_id", (F.col("delivery_no") + 1).alias("delivery_no"), "field", F.col("kind").alias("kind_before")).join(
        known, ["feed_id", "delivery_no"], "left_semi"
    )
    both = now.withColumn("is", F.lit(True)).join(before.withColumn("was", F.lit(True)), ["feed_id", "delivery_no", "field"], "full")
    both = stage.write(both)
    gone = both.where(F.col("is").isNull()).select("feed_id", "delivery_no", "field", "kind_before")
    come = both.where(F.col("was").isNull()).select("feed_id", "delivery_no", "field", "kind")
    renamed = stage.write(_renames(rows, json, gone, come, stage))
    on = ["feed_id", "delivery_no"]
    removed = gone.join(renamed.select(*on, F.col("before").alias("field")), [*on, "field"], "left_anti")
    added = come.join(renamed.select(*on, F.col("after").alias("field")), [*on, "field"], "left_anti")
    pair = (
        renamed.join(gone.select(*on, F.col("field").alias("before"), "kind_before"), [*on, "before"])
        .join(come.select(*on, F.col("field").alias("after"), "kind"), [*on, "after"]).select(*on, "before", "after", "kind_before", "kind")
    )
    kept = both.where(F.col("is") & F.col("was")).select(*on, F.col("field").alias("before"), F.col("field").alias("after"), "kind_before", "kind")
    retyped = kept.unionByName(pair).where(F.col("kind") != F.col("kind_before"))
    row = lambda df, what, b, a: df.select(*on, F.lit(what).alias("change_kind"), b.alias("field_before"), a.alias("field_after"))
    none = F.lit("")
    return (
        row(removed, "removed", F.col("field"), none).unionByName(row(added, "added", none, F.col("field")))
        .unionByName(row(renamed, "renamed", F.col("before"), F.col("after"))).unionByName(row(retyped, "retyped", F.col("before"), F.col("after")))
    )


def _identities(feed: pd.DataFrame) -> pd.DataFrame:
    """The first name of every field of one feed, following renames; rows are fields by delivery."""
    name: dict[tuple[int, str], str] = {}
    back = {(n, a): b for n, a, b in feed.loc[feed["renamed_from"].notna(), ["delivery_no", "field", "renamed_from"]].itertuples(index=False)}
    for n, f in sorted(feed[["delivery_no", "field"]].itertuples(index=False)):
        old = back.get((n, f), f)
        name[n, f] = name.get((n - 1, old), name.get((n, f), f))
    return feed[["feed_id", "delivery_no", "field", "kind"]].assign(unified=[name[n, f] for n, f in feed[["delivery_no", "field"]].itertuples(index=False)])


#: Typed columns of ``consistent``: the map's name, the JSON type whose fields it holds, and the SQL type of its values.
TYPED = (("numbers", "number", "double"), ("booleans", "boolean", "boolean"), ("arrays", "array", "array<string>"), ("objects", "object", "map<string,string>"))


def _typed(text: Column, form: Column, target: Column) -> dict[str, Column]:
    """The value of a field under each type, null where the field is of another or the value can't be read so."""
    low = F.lower(F.trim(form))
    truth = F.when(low.isin("true", "t", "yes", "y", "1", "1.0"), True).when(low.isin("false", "f", "no", "n", "0", "0.0"), False)
    of = {"number": form.try_cast("double"), "boolean": truth, "array": F.from_json(text, "array<string>"), "object": F.when(F.trim(text).startswith("{"), F.from_json(text, "map<string,string>"))}
    return {kind: F.when(target == kind, v) for kind, v in of.items()}


def consistent(rows: DataFrame, json: str = "attributes_raw") -> DataFrame:
    """(feed_id, delivery_no, ingest_seq, record_id, attributes, numbers, booleans, arrays, objects, days, failed) of every readable row.

    ``attributes`` maps a field's first name in its feed to its plain text. The field's type is that of
    most of its deliveries; ``numbers``, ``booleans``, ``arrays`` and ``objects`` hold the values cast to
    it, ``days`` those of text fields that are ISO dates. ``failed`` lists the fields whose value isn't
    null or a filler and can't be cast. A readable row without any value has empty maps. Yes, no, 1
    and 0 count as booleans.
    """
    stage = Stage(rows.sparkSession)
    stats = _statistics(rows, json)
    ren = changes(rows, json).where(F.col("change_kind") == "renamed").select("feed_id", "delivery_no", F.col("field_after").alias("field"), F.col("field_before").alias("renamed_from"))
    meta = stats.join(ren, ["feed_id", "delivery_no", "field"], "left")
    # One group holds the field names of one feed's deliveries, not its rows.
    ids = meta.groupBy("feed_id").applyInPandas(_identities, "feed_id string, delivery_no int, field string, kind string, unified string")
    most = ids.groupBy("feed_id", "unified", "kind").agg(F.count("*").alias("n")).groupBy("feed_id", "unified").agg(F.max_by("kind", F.struct("n", "kind")).alias("target"))
    ids = stage.write(ids.select("feed_id", "delivery_no", "field", "unified").join(most, ["feed_id", "unified"]))
    key = ["feed_id", "delivery_no", "ingest_seq", "record_id"]
    each = fields(rows, json, *key).join(ids, ["feed_id", "delivery_no", "field"])
    raw = F.when(F.col("kind").isin("array", "object"), F.try_variant_get("value", "$", "string"))
    each = content(step(each, text=plain(F.col("value"), F.col("kind")), _raw=raw), F.col("text"), "form").where(F.col("form").isNotNull())
    each = step(each, **_typed(F.coalesce("_raw", "text"), F.col("form"), F.col("target")), day=F.when((F.col("target") == "string") & F.col("text").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("text").try_cast("date")))
    bad = reduce(lambda x, y: x | y, [(F.col("target") == kind) & F.col(kind).isNull() for _, kind, _ in TYPED])
    # Two fields of a row never share a first name unless the sender repeats one; that of the least text is kept then.
    cell = each.groupBy(*key, "unified").agg(F.min(F.struct("text", "number", "boolean", "array", F.to_json("object").alias("object"), "day", bad.alias("bad"))).alias("c")).select(*key, "unified", "c.*")
    entry = lambda c, v: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("unified", v.alias(c))))))
    cells = cell.groupBy(*key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("unified", "text")))).alias("attributes"), entry("number", F.col("number")).alias("numbers"), entry("boolean", F.col("boolean")).alias("booleans"),
        entry("array", F.col("array")).alias("arrays"), entry("object", F.col("object")).alias("objects"), entry("day", F.col("day")).alias("days"), F.sort_array(F.collect_list(F.when(F.col("bad"), F.col("unified")))).alias("failed"),
    )
    v = F.try_parse_json(F.col(json))
    readable = rows.where(F.schema_of_variant(v).startswith("OBJECT")).select(*key)
    none = {"attributes": "map<string,string>", "numbers": "map<string,double>", "booleans": "map<string,boolean>", "arrays": "map<string,array<string>>", "objects": "map<string,string>", "days": "map<string,date>"}
    # Every readable row once for each time it was delivered; a key with nulls is compared as such.
    k = F.xxhash64(*key)
    out = readable.withColumn("_k", k).join(cells.withColumn("_k", k).withColumnsRenamed({c: f"_{c}" for c in key}), "_k", "left")
    return out.select(*key, *[F.coalesce(F.col(n), F.create_map().cast(t)).alias(n) for n, t in none.items()], F.coalesce("failed", F.array().cast("array<string>")).alias("failed"))
