"""Candidate pairs by grid, pair scores, and resolved parcels.

Records have case_id, record_id, seq, source_type, the bounds minx to maxy in degrees and typed
attributes; ``seq`` is the order of arrival, on which pair orientation and ties depend.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave import config
from landweave.config import DEFAULT, Config
from landweave.functions import planar
from landweave.functions.columns import salted, step
from landweave.functions.text import identifier, token_set_ratio_col
from landweave.operators import lineage
from landweave.session import Stage

#: Rows of one side of a cell that a task takes; a fuller cell is salted.
CELL_ROWS = 20_000
#: Shapes of identifiers, of all names together, by which parts are chosen; with more of them, by length only.
SHAPES = 2_000
BOUNDS = ("minx", "miny", "maxx", "maxy")
#: Fewer metres than any degree has here.
METRES_LEAST = 100_000


def candidates(records: DataFrame, cfg: Config = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs of a case whose boxes, one widened by the buffer, meet; columns a_* and b_*, a before b.

    Boxes are copied to the grid cells they meet and joined on the cell; a pair is kept in one cell
    only, that of the lower corner of what the boxes share, so no distinct follows.
    """
    cols = ["record_id", "seq", *BOUNDS, *carry]
    step = max(cfg.buffer_deg, 1e-6)
    cell = lambda c: F.floor(c / step).cast("long")
    a = records.select("case_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = records.select("case_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    wide = {"x0": F.col("a_minx") - step, "y0": F.col("a_miny") - step, "x1": F.col("a_maxx") + step, "y1": F.col("a_maxy") + step}
    a = a.withColumn("cx", F.explode(F.sequence(cell(wide["x0"]), cell(wide["x1"])))).withColumn("cy", F.explode(F.sequence(cell(wide["y0"]), cell(wide["y1"]))))
    b = b.withColumn("cx", F.explode(F.sequence(cell(F.col("b_minx")), cell(F.col("b_maxx"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("b_miny")), cell(F.col("b_maxy")))))
    meet = (
        (F.col("a_seq") < F.col("b_seq"))
        & (wide["x0"] <= F.col("b_maxx")) & (F.col("b_minx") <= wide["x1"]) & (wide["y0"] <= F.col("b_maxy")) & (F.col("b_miny") <= wide["y1"])
    )
    home = (F.col("cx") == cell(F.greatest(wide["x0"], F.col("b_minx")))) & (F.col("cy") == cell(F.greatest(wide["y0"], F.col("b_miny"))))
    a, b = salted(a, b, ["case_id", "cx", "cy"], "a_record_id", "b_record_id", CELL_ROWS)
    return a.join(b, ["case_id", "cx", "cy", "salt_l", "salt_r"]).where(meet & home).drop("cx", "cy", "salt_l", "salt_r")


def _reach(cfg: Config) -> float:
    """Degrees by which boxes may lie apart where no identifier is alike and the outlines can still be enough; at most the buffer."""
    least = (cfg.match_at - 0.0002 - cfg.weight_attribute - cfg.weight_temporal * 0.9 - cfg.weight_provenance) / cfg.weight_geometry
    # Apart, the shared area is none: 0.3 by the distance, 0.2 by equal areas and 0.1 by equal centres are left of ``geometry_score``.
    return min(cfg.buffer_deg, max(0.0, 500 * (2 - least / 0.3)) / METRES_LEAST + 1e-9)


def _meeting(a: DataFrame, b: DataFrame, reach: float, size: float, enough: Column | None = None, brief: tuple[str, ...] = ()) -> DataFrame:
    """(a_id, b_id) of two lists of boxes of a case, at most ``reach`` apart, over cells of ``size``; of one list with itself, by ``seq``.

    With ``enough``, a condition on the columns ``brief`` and the boxes of both, pairs that don't meet it are left out where they are found.
    """
    cell = lambda c: F.floor(c / size).cast("long")
    spread = lambda d, p, by: d.withColumn("cx", F.explode(F.sequence(cell(F.col(f"{p}minx") - by), cell(F.col(f"{p}maxx") + by)))).withColumn("cy", F.explode(F.sequence(cell(F.col(f"{p}miny") - by), cell(F.col(f"{p}maxy") + by))))
    sides = [d.select("case_id", *[F.col(n).alias(p + n) for n in ("id", "seq", *BOUNDS, *brief)]) for d, p in ((a, "a_"), (b, "b_"))]
    met = _near(reach) & ((F.col("a_seq") < F.col("b_seq")) if a is b else F.lit(True))
    l, r = salted(spread(sides[0], "a_", reach), spread(sides[1], "b_", 0.0), ["case_id", "cx", "cy"], "a_id", "b_id", CELL_ROWS)
    return l.join(r, ["case_id", "cx", "cy", "salt_l", "salt_r"]).where(met if enough is None else met & enough).select("a_id", "a_seq", "b_id", "b_seq")


def _near(reach: float) -> Column:
    c = F.col
    return (c("a_minx") - reach <= c("b_maxx")) & (c("b_minx") <= c("a_maxx") + reach) & (c("a_miny") - reach <= c("b_maxy")) & (c("b_miny") <= c("a_maxy") + reach) & (c("a_seq") != c("b_seq"))


def _shape(key: Column) -> Column:
    """Letters as a, figures as 0."""
    return F.translate(key, "bcdefghijklmnopqrstuvwxyz123456789", "a" * 25 + "0" * 9)


def _parts(known: frozenset[tuple]) -> Callable[[Column, Column], Column]:
    """array of the distinct parts of a key whose shape, or else length, is among ``known`` (name, shape or length)."""
    plain = str.maketrans("bcdefghijklmnopqrstuvwxyz123456789", "a" * 25 + "0" * 9)
    shapes = {x for _, x in known}
    sizes = sorted({len(x) if isinstance(x, str) else x for x in shapes})
    by_shape = any(isinstance(x, str) for x in shapes)

    def run(names: pa.Array, keys: pa.Array) -> pa.Array:
        @cache
        def spans(name: str, shape: str) -> list[tuple[int, int]]:
            return [(i, i + n) for n in sizes for i in range(len(shape) - n + 1) if (name, shape[i : i + n] if by_shape else n) in known]

        found = [list(dict.fromkeys(k[i:j] for i, j in spans(n, k.translate(plain)))) if n and k else [] for n, k in zip(names.to_pylist(), keys.to_pylist())]
        return pa.array(found, pa.list_(pa.string()))

    return lambda name, key: F.arrow_udf(run, "array<string>")(name, key)


def _alike(records: DataFrame, names: list[str], buffer: float) -> DataFrame:
    """(a_id, b_id) of records of a case at most ``buffer`` apart of which an identifier of one is that of the other or part of it.

    The parts of each identifier, of the lengths and order of letters and figures that whole ones have, are joined with these.
    """
    size = 4 * buffer
    cell = lambda c: F.floor(c / size).cast("long")
    # Without letters and figures, the text itself, marked by a sign that no other key has.
    key = lambda n: F.coalesce(F.col(f"id_{n}"), F.when(F.col(n) != "", F.concat(F.lit("="), F.trim(n))))
    keys = records.select("case_id", "id", "seq", *BOUNDS, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), key(n).alias("key")) for n in names]))).where("key IS NOT NULL")
    keys = Stage(records.sparkSession).write(keys)
    whole = keys.where(~F.col("key").startswith("="))
    shapes = whole.select("name", _shape(F.col("key")).alias("shape")).distinct().limit(SHAPES + 1).collect()
    known = frozenset((r["name"], r["shape"]) for r in shapes)
    if len(known) > SHAPES:
        known = frozenset((r["name"], r["n"]) for r in whole.select("name", F.length("key").alias("n")).distinct().collect())
    parts = _parts(known)(F.col("name"), F.col("key"))
    sides = [keys.select("case_id", "name", "key", *[F.col(n).alias(p + n) for n in ("id", "seq", *BOUNDS)]) for p in ("a_", "b_")]
    b = sides[1].withColumn("key", F.explode(F.when(F.col("key").startswith("="), F.array("key")).otherwise(parts)))
    a, b = (
        d.withColumn("cx", F.explode(F.sequence(cell(F.col(f"{p}minx") - by), cell(F.col(f"{p}maxx") + by)))).withColumn("cy", F.explode(F.sequence(cell(F.col(f"{p}miny") - by), cell(F.col(f"{p}maxy") + by))))
        for d, p, by in ((sides[0], "a_", buffer), (b, "b_", 0.0))
    )
    # Sizes are estimated before the parts and cells are made, so no broadcast.
    return a.hint("merge").join(b, ["case_id", "name", "key", "cx", "cy"]).where(_near(buffer)).select("a_id", "a_seq", "b_id", "b_seq")


def likely(records: DataFrame, names: list[str], cfg: Config = DEFAULT, carry: tuple[str, ...] = (), enough: Column | None = None, brief: dict[str, Column] | None = None) -> DataFrame:
    """Those of ``candidates`` that can match: boxes that all but meet, or identifiers alike; the same columns.

    ``records`` has unique record ids, deg2 and, for each of ``names``, the letters and figures of the
    identifier as ``id_*``. The rest of a pair's score, whole, and the geometry of boxes that lie apart
    don't reach the threshold without an identifier. Two records without area are candidates anyway.
    ``enough`` tells of a pair without an identifier alike, by its boxes and the columns ``brief`` of
    both, whether it can match; most pairs end there, before whole records are joined to them.
    """
    cols = ["record_id", "seq", *BOUNDS, *carry]
    buffer = max(cfg.buffer_deg, 1e-6)
    r = records.withColumn("id", F.col("record_id"))
    slim = r.select("case_id", "id", "seq", *BOUNDS, F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")).alias("_size"), (F.coalesce("deg2", F.lit(0.0)) == 0).alias("_flat"), *[x.alias(n) for n, x in (brief or {}).items()])
    slim = Stage(records.sparkSession).write(slim)
    reach, wide = _reach(cfg), buffer / 2
    small, large, flat = slim.where(F.col("_size") <= wide), slim.where(F.col("_size") > wide), slim.where("_flat")
    met = lambda a, b, by, size: _meeting(a, b, by, size, enough, tuple(brief or ()))
    found = met(small, small, reach, buffer / 10).unionByName(met(large, slim, reach, buffer)).unionByName(met(flat, flat, buffer, buffer))
    if names:
        found = found.unionByName(_alike(r, names, buffer + 1e-9))
    first = F.col("a_seq") < F.col("b_seq")
    pairs = found.select(F.when(first, F.col("a_id")).otherwise(F.col("b_id")).alias("a_record_id"), F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("b_record_id")).distinct()
    # Written, so that the layouts by cells and keys are gone before whole records are laid out.
    pairs = Stage(records.sparkSession).write(pairs)
    # Both sides with the same columns, so that one layout of the records serves both.
    a, b = (records.select(F.col("case_id").alias(case), *[F.col(c).alias(p + c) for c in cols]) for p, case in (("a_", "case_id"), ("b_", "_case")))
    c = F.col
    meet = (c("case_id") == c("_case")) & (c("a_minx") - buffer <= c("b_maxx")) & (c("b_minx") <= c("a_maxx") + buffer) & (c("a_miny") - buffer <= c("b_maxy")) & (c("b_miny") <= c("a_maxy") + buffer)
    return pairs.join(a, "a_record_id").join(b, "b_record_id").where(meet).drop("_case")


def near_boxes(records: DataFrame, probes: DataFrame, metres: float) -> DataFrame:
    """(probe_id, record_id): records of the case whose box meets a probe's box widened by ``metres``."""
    d = metres / 111_000.0
    r = records.select("case_id", "record_id", *BOUNDS)
    p = probes.select("case_id", F.col("record_id").alias("probe_id"), *[F.col(c).alias(f"p_{c}") for c in BOUNDS])
    step = max(d, 0.001)
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / step).cast("long"), F.floor(hi / step).cast("long")))
    p = p.withColumn("cx", cells(F.col("p_minx") - d, F.col("p_maxx") + d)).withColumn("cy", cells(F.col("p_miny") - d, F.col("p_maxy") + d))
    r = r.withColumn("cx", cells(F.col("minx"), F.col("maxx"))).withColumn("cy", cells(F.col("miny"), F.col("maxy")))
    meet = (F.col("p_minx") - d <= F.col("maxx")) & (F.col("minx") <= F.col("p_maxx") + d) & (F.col("p_miny") - d <= F.col("maxy")) & (F.col("miny") <= F.col("p_maxy") + d)
    # Of the cells that both meet, that of the lower corner of what they share.
    home = (F.col("cx") == F.floor(F.greatest(F.col("p_minx") - d, "minx") / step)) & (F.col("cy") == F.floor(F.greatest(F.col("p_miny") - d, "miny") / step))
    # Sizes are estimated before boxes are copied to their cells, so a broadcast would take many times what it seems to.
    return p.hint("merge").join(r, ["case_id", "cx", "cy"]).where(meet & home & (F.col("probe_id") != F.col("record_id"))).select("probe_id", "record_id").distinct()


def geometry_score(iou: Column, hausdorff_m: Column, area_diff: Column, centroid_m: Column) -> Column:
    return 0.4 * F.greatest(F.lit(0.0), iou) + 0.3 * F.greatest(F.lit(0.0), 1 - hausdorff_m / 500) + 0.2 * F.greatest(F.lit(0.0), 1 - area_diff) + 0.1 * F.greatest(F.lit(0.0), 1 - centroid_m / 500)


def identifier_score(pairs: list[tuple[Column, ...]]) -> Column:
    """1 for an equal trimmed field, 0.9 for equal letters and figures, 0.6 where one holds the other, else 0; pass by pass over all fields.

    A pair may bring its letters and figures as third and fourth column.
    """
    some = lambda c: (c.isNotNull()) & (c != "")
    exact = F.lit(False)
    normal = F.lit(False)
    part = F.lit(False)
    for a, b, *plain in pairs:
        x, y = plain or (identifier(a), identifier(b))
        exact = exact | F.coalesce(some(a) & some(b) & (F.trim(a) == F.trim(b)), F.lit(False))
        normal = normal | F.coalesce(x == y, F.lit(False))
        part = part | F.coalesce(x.contains(y) | y.contains(x), F.lit(False))
    return F.when(exact, 1.0).when(normal, 0.9).when(part, 0.6).otherwise(0.0)


def plain_text(c: Column) -> Column:
    """Trimmed and in lower case; null if nothing is left."""
    return F.nullif(F.trim(F.lower(c)), F.lit(""))


def attribute_score(owner_similarity: Column | None, land_a: Column, land_b: Column, ward_a: Column, ward_b: Column) -> Column:
    """Mean of what both sides have: owner similarity, land use (1 or 0.2), ward (1 or 0), the last two as ``plain_text``; 0.5 for nothing."""
    same = lambda a, b, no: F.when(a == b, 1.0).when(a != b, no)
    parts = [*([owner_similarity] if owner_similarity is not None else []), same(land_a, land_b, 0.2), same(ward_a, ward_b, 0.0)]
    total = reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0.0)) for p in parts])
    known = reduce(lambda x, y: x + y, [p.isNotNull().cast("int") for p in parts])
    return F.when(known > 0, total / known).otherwise(0.5)


def temporal_score(a: Column, b: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(a.isNull() | b.isNull(), 0.7).when(F.abs(F.datediff(a, b)) > cfg.temporal_gap_days, 0.4).otherwise(0.9)


def provenance_score(independent: Column, lineages: Column) -> Column:
    """0.5 where nothing is known, 0.3 for one origin, 0.7 and 0.1 for each origin up to 1."""
    return F.when(independent.isNull(), 0.5).when(independent, F.least(F.lit(1.0), 0.7 + 0.1 * lineages)).otherwise(0.3)


IDENTIFIERS = ("parcel_reference", "ulpin", "survey_number")
MEASURES = ("iou", "hausdorff_m", "area_diff", "centroid_m")


def measured(pairs: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame:
    """Adds iou, hausdorff_m, area_diff and centroid_m: of the outlines where pairs have them, else of the boxes.

    Each is worked out once, behind a generator, and not again wherever a later step names it.
    """
    if f"{a}geometry" in pairs.columns:
        return pairs.select("*", F.inline(F.array(planar.measures_col(F.col(f"{a}geometry"), F.col(f"{b}geometry")))))
    return planar.box_measures(pairs, a, b)


def _geometry_bound(cfg: Config) -> Column:
    """What a pair's geometry score can be at most, by its boxes, areas and centres, before the outlines are compared."""
    c = F.col
    if_boxes = planar.overlap(c("a_minx"), c("a_maxx"), c("b_minx"), c("b_maxx")) * planar.overlap(c("a_miny"), c("a_maxy"), c("b_miny"), c("b_maxy"))
    small, large = F.least("a_deg2", "b_deg2"), F.greatest("a_deg2", "b_deg2")
    iou = F.coalesce(F.least(if_boxes, small) / F.nullif(large, F.lit(0.0)), F.lit(1.0))
    # The outline that reaches farther has a corner at least as far from the other.
    apart = F.greatest(*[F.abs(c(f"a_{n}") - c(f"b_{n}")) for n in BOUNDS]) * METRES_LEAST
    area = F.coalesce(1 - small / F.nullif(large, F.lit(0.0)), F.lit(0.0))
    return geometry_score(iou, apart, area, F.lit(0.0))


def scored(records: DataFrame, cfg: Config = DEFAULT, lineage_pairs: DataFrame | None = None, matches_only: bool = False) -> DataFrame:
    """Candidate pairs with their measures, five scores, the overall score and decisions.

    Records may have ``geometry`` with ``deg2`` (outlines are compared), ``owner_reference``, further
    identifiers and ``provenance_node_id``; what is missing counts as unknown. ``lineage_pairs`` is the
    result of ``lineage.origin_pairs``. With ``matches_only``, pairs that can't reach the threshold
    whatever their outlines, owners and lineages say are left out before these are looked at.
    """
    have = lambda n: n in records.columns
    ids = [n for n in IDENTIFIERS if have(n)]
    r = step(records, _land=plain_text(F.col("land_use")), _ward=plain_text(F.col("ward")), **{f"id_{n}": identifier(F.col(n)) for n in ids})
    carry = ["source_type", "land_use", "capture_date", "_land", "_ward", *ids, *[f"id_{n}" for n in ids], *[n for n in ("owner_reference", "geometry", "deg2") if have(n)]]
    if lineage_pairs is not None:
        carry.append("provenance_node_id")
    c = F.col
    owners = have("owner_reference")
    known_owners = (F.coalesce(F.trim("a_owner_reference"), F.lit("")) != "") & (F.coalesce(F.trim("b_owner_reference"), F.lit("")) != "") if owners else F.lit(False)
    best = F.when(known_owners, 1.0) if owners else None
    attribute, temporal = attribute_score(best, c("a__land"), c("b__land"), c("a__ward"), c("b__ward")), temporal_score(c("a_capture_date"), c("b_capture_date"), cfg)
    # Lineages are unknown, and count a half, unless both records name a node.
    told = F.when(c("a_provenance_node_id").isNotNull() & c("b_provenance_node_id").isNotNull(), 1.0).otherwise(0.5) if lineage_pairs is not None else F.lit(0.5)
    if matches_only and have("deg2"):
        # Texts that only need to be equal or there, by a number or a sign: alike where the texts are, so the bound holds.
        brief = {"deg2": c("deg2"), "capture_date": c("capture_date"), **{n: F.when(c(n).isNotNull(), F.xxhash64(n)) for n in ("_land", "_ward")}}
        if owners:
            brief["owner_reference"] = F.when(F.trim("owner_reference") != "", "x")
        if lineage_pairs is not None:
            brief["provenance_node_id"] = F.when(c("provenance_node_id").isNotNull(), "x")
        most = cfg.weight_geometry * _geometry_bound(cfg) + cfg.weight_attribute * attribute + cfg.weight_temporal * temporal + cfg.weight_provenance * told
        p = likely(r, ids, cfg, tuple(carry), most >= cfg.match_at - 0.0002, brief)
    else:
        p = candidates(r, cfg, tuple(carry))
    p = step(
        p, score_identifier=identifier_score([(c(f"a_{n}"), c(f"b_{n}"), c(f"a_id_{n}"), c(f"b_id_{n}")) for n in ids]) if ids else F.lit(0.0),
        score_temporal=temporal, _attribute=attribute,
    )
    p = p.withColumn("land_use_match", F.coalesce(c("a__land") == c("b__land"), F.lit(False))).withColumn("ward_match", F.coalesce(c("a__ward") == c("b__ward"), F.lit(False)))
    rest = cfg.weight_identifier * c("score_identifier") + cfg.weight_attribute * c("_attribute") + cfg.weight_temporal * c("score_temporal") + cfg.weight_provenance * told
    if matches_only:
        bound = _geometry_bound(cfg) if have("deg2") else geometry_score(
            F.when((c("a_minx") <= c("b_maxx")) & (c("b_minx") <= c("a_maxx")) & (c("a_miny") <= c("b_maxy")) & (c("b_miny") <= c("a_maxy")), 1.0).otherwise(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
        enough = cfg.weight_geometry * bound + rest >= cfg.match_at - 0.0002
        p = p.where(enough)
    if owners:
        p = p.withColumn("owner_similarity", F.when(known_owners, token_set_ratio_col(c("a_owner_reference"), c("b_owner_reference")) / 100))
        p = step(p, _attribute2=attribute_score(c("owner_similarity"), c("a__land"), c("b__land"), c("a__ward"), c("b__ward"))).drop("_attribute").withColumnRenamed("_attribute2", "_attribute")
        if matches_only:
            p = p.where(enough)  # once more with the owners' likeness, before outlines are compared
    p = measured(p)
    if lineage_pairs is not None:
        p = p.withColumnsRenamed({"a_provenance_node_id": "a_node", "b_provenance_node_id": "b_node"})
        p = lineage.pair_independence(Stage(p.sparkSession).write(p), lineage_pairs)
        p = p.withColumn("_provenance", provenance_score(c("independent"), c("lineages")))
    else:
        p = p.withColumn("lineages", F.lit(0)).withColumn("_provenance", F.lit(0.5))
    p = step(p, _geometry=F.when(c("iou").isNull(), 0.0).otherwise(geometry_score(c("iou"), c("hausdorff_m"), c("area_diff"), c("centroid_m"))))
    overall = (
        c("_geometry") * cfg.weight_geometry + c("score_identifier") * cfg.weight_identifier + c("_attribute") * cfg.weight_attribute + c("score_temporal") * cfg.weight_temporal + c("_provenance") * cfg.weight_provenance
    )
    p = step(p, overall=F.round(overall, 4))
    p = p.withColumn("score_geometry", F.round("_geometry", 4)).withColumn("score_attribute", F.round("_attribute", 4)).withColumn("score_provenance", F.round("_provenance", 4))
    p = p.drop("_geometry", "_attribute", "_provenance", "a__land", "b__land", "a__ward", "b__ward", *[f"{s}_id_{n}" for s in "ab" for n in ids])
    p = p.withColumn("is_match", c("overall") >= cfg.match_at).withColumn("requires_review", (c("overall") >= cfg.match_at) & (c("overall") < cfg.review_below))
    return p.where("is_match") if matches_only else p


def verdict(overall: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(overall >= cfg.high_at, "HIGH_CONFIDENCE").when(overall >= cfg.review_below, "REVIEW_REQUIRED").when(overall >= cfg.match_at, "LOW_CONFIDENCE").otherwise("NO_MATCH")


def signals(pairs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(a_record_id, b_record_id, overall, verdict, boost, drag): the signals that lift and lower a pair most against neutral evidence.

    Null where the strongest is within 0.02 of neutral; the first of equals in the order of the weights.
    """
    names = ("geometry", "identifier", "attribute", "temporal", "provenance")
    delta = F.array(*[F.struct(F.round((F.col(f"score_{n}") - 0.5) * getattr(cfg, f"weight_{n}"), 4).alias("delta"), F.lit(-i).alias("first"), F.lit(n).alias("signal")) for i, n in enumerate(names)])
    low = F.array(*[F.struct(F.round((F.col(f"score_{n}") - 0.5) * getattr(cfg, f"weight_{n}"), 4).alias("delta"), F.lit(i).alias("first"), F.lit(n).alias("signal")) for i, n in enumerate(names)])
    p = step(pairs.select("a_record_id", "b_record_id", "overall", *[f"score_{n}" for n in names]), _top=F.array_max(delta), _low=F.array_min(low))
    return p.select(
        "a_record_id", "b_record_id", "overall", verdict(F.col("overall"), cfg).alias("verdict"),
        F.when(F.col("_top.delta") > 0.02, F.col("_top.signal")).alias("boost"), F.when(F.col("_low.delta") < -0.02, F.col("_low.signal")).alias("drag"),
    )


def explain(pairs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row for each signal of a scored pair: raw score, weight, contribution and difference to neutral evidence."""
    parts = [(n, f"score_{n}", getattr(cfg, f"weight_{n}")) for n in ("geometry", "identifier", "attribute", "temporal", "provenance")]
    rows = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(s).cast("double").alias("raw"), F.lit(str(w)).cast("decimal(6,4)").alias("weight")) for n, s, w in parts])
    out = pairs.select("a_record_id", "b_record_id", F.inline(rows))
    raw = F.col("raw").cast("decimal(8,4)")
    contribution, delta = raw * F.col("weight"), (raw - F.lit("0.5").cast("decimal(8,4)")) * F.col("weight")
    return out.withColumn("contribution", F.round(contribution, 4).cast("double")).withColumn("delta", F.round(delta, 4).cast("double"))


def source_weight(source_type: Column) -> Column:
    """Weight of a source type; that of UNKNOWN for others."""
    m = F.create_map(*[F.lit(x) for kv in config.SOURCE_WEIGHT.items() for x in kv])
    return F.coalesce(F.element_at(m, source_type), F.lit(config.SOURCE_WEIGHT["UNKNOWN"]))
