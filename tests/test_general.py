"""The general data-preparation operators against brute force and on edge cases."""

import json
import random

from pyspark.sql import functions as F

from landweave.operators import hierarchy, schema_drift, spatial, timestamps

TIMES = "value string, source string, date_order string, time_zone string, weights int"


def instants(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], TIMES)
    return {(r.value, r.date_order): r for r in timestamps.instants(df, "value").collect()}


def test_times_name_one_instant(spark):
    dmy, kol = "DMY", "Asia/Kolkata"
    cases = {
        "2020-01-02T03:04:05Z": "2020-01-02 03:04:05", "20200102T030405Z": "2020-01-02 03:04:05", " ०२/०१/२०२० ": "2020-01-01 18:30:00", "2020-W01-4": "2020-01-01 18:30:00",
        "2020-002": "2020-01-01 18:30:00", "Thu, 02 Jan 2020 03:04:05 +0400": "2020-01-01 23:04:05", "2nd January 2020": "2020-01-01 18:30:00", "Jan 2, 2020 01:02:03": "2020-01-01 19:32:03",
        "02.01.20": "2020-01-01 18:30:00", "2 Jan 2020 00:00:01 IST": "2020-01-01 18:30:01", "02-01-2020 1:05 p.m.": "2020-01-02 07:35:00", "2020-01-02 12:05 AM": "2020-01-01 18:35:00",
        "2020-01-02T03:04:05.123456789Z": "2020-01-02 03:04:05.123456", "2020-01-02T03:04:05[Europe/Berlin]": "2020-01-02 02:04:05", "1577934245": "2020-01-02 03:04:05", "1577934245123": "2020-01-02 03:04:05.123",
        "GPS 2086:356645.0": "2020-01-02 03:03:47",
    }
    nothing = ["31/04/2020", "2020-13-01", "", "   ", "unknown", "2020-01", "circa 2004", "2019-W53-1", "2019-366", "GPS 2086:604800.0", None, "x" * 100_000]
    got = instants(spark, [(v, "s", dmy, kol) for v in [*cases, *nothing]])
    for v, t in cases.items():
        expected = spark.range(1).select(F.unix_micros(F.to_timestamp(F.lit(t + "+00:00")))).first()[0]
        assert got[v, dmy].instant_us == expected, v
    for v in nothing:
        assert got[v, dmy].instant_us is None, v


def test_gap_and_overlap(spark):
    rows = [("2021-03-28T02:30:00", "b", "DMY", "Europe/Berlin"), ("2021-10-31T02:30:00", "b", "DMY", "Europe/Berlin")]
    got = instants(spark, rows)
    us = lambda t: int(spark.range(1).select(F.unix_micros(F.to_timestamp(F.lit(t)))).first()[0])
    assert got[rows[0][0], "DMY"].instant_us == us("2021-03-28 01:30:00+00:00")
    assert got[rows[1][0], "DMY"].instant_us == us("2021-10-31 00:30:00+00:00")


def test_undeclared_order_is_learned(spark):
    rows = [(f"{d:02d}/03/2021", "learn", None, None) for d in range(13, 29)] + [("04/05/2021", "learn", None, None), ("04/05/2021", "lone", None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], TIMES)
    got = {(r.source, r.value): r for r in timestamps.instants(df, "value").collect()}
    assert got["learn", "04/05/2021"].reading == "DMY" and not got["learn", "04/05/2021"].is_ambiguous
    assert got["lone", "04/05/2021"].is_ambiguous and got["lone", "04/05/2021"].instant_us is None
    assert got["lone", "04/05/2021"].weights == 1


def test_times_of_an_empty_table(spark):
    assert timestamps.instants(spark.createDataFrame([], TIMES), "value").count() == 0


NODES = "node_id string, parent_ids array<string>, case_id string, depth int"


def brute_roots(rows):
    k = lambda x: x.strip().upper()
    parents = {}
    for n, p, *_ in rows:
        if n and n.strip():
            parents.setdefault(k(n), set()).update(k(x) for x in p or [] if x and x.strip())
    parents = {n: {x for x in p if x in parents} for n, p in parents.items()}
    out = set()
    for n in parents:
        level, seen, bad, found = {n}, {}, False, {}
        d = 0
        while level and d <= len(parents) + 1:
            for x in level:
                if not parents[x]:
                    found.setdefault(x, d)
            level = {y for x in level for y in parents[x]}
            d += 1
        bad = bool(level)
        out |= {(n, "", -1)} if bad else {(n, r, s) for r, s in found.items()}
        del seen
    return out


def test_roots_match_brute_force(spark):
    rng = random.Random(5)
    for size, extra in ((40, 0.1), (60, 0.4)):
        rows = []
        for i in range(size):
            ps = [f"n{rng.randrange(max(1, i))}"] if i and rng.random() < 0.9 else []
            if rng.random() < extra:
                ps.append(f" N{rng.randrange(size)} ")
            rows.append((f"n{i}", ps + ([None, "", "absent"] if i % 7 == 0 else []), f"c{i % 3}", 0))
        rows += [("n3", None, "c0", 0), ("n3", [], "c1", 0), (None, ["n1"], "c", 0), ("loop", ["LOOP"], "c", 0), ("under", ["loop"], "c", 0)]
        got = hierarchy.roots(spark.createDataFrame(rows, NODES))
        assert {tuple(r) for r in got.collect()} == brute_roots(rows)


def test_long_chain_over_many_fragments(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "FRAGMENT_ROWS", 20)
    order = list(range(150))
    random.Random(1).shuffle(order)
    rows = [(f"x{order[i]:03d}", [f"x{order[i - 1]:03d}"] if i else [], "c", 0) for i in range(150)] + [("p", ["q"], "c", 0), ("q", ["p"], "c", 0), ("r", ["q"], "c", 0)]
    got = {tuple(r) for r in hierarchy.roots(spark.createDataFrame(rows, NODES)).collect()}
    assert got == brute_roots(rows)


def test_paths_and_descendants(spark):
    rows = [("a", [], "c", 0), ("b", ["a"], "c", 0), ("c", ["b", "a"], "c", 0), ("z", ["z"], "c", 0)]
    df = spark.createDataFrame(rows, NODES)
    p = hierarchy.paths(df, hierarchy.roots(df))
    assert {(r.node_id, tuple(r.path)) for r in p.collect()} == {("A", ("A",)), ("B", ("A", "B")), ("C", ("A", "C")), ("Z", ())}
    assert {tuple(r) for r in hierarchy.descendants(df, hierarchy.roots(df)).collect()} == {("A", "B", 1), ("A", "C", 1), ("B", "C", 1)}


def test_descendants_through_every_parent(spark):
    rng = random.Random(9)
    rows = [("a", [], "c", 0), ("b", ["a"], "c", 0), ("c", ["b", "a"], "c", 0), ("z", ["z"], "c", 0), ("y", ["z", "a"], "c", 0)]
    rows += [(f"n{i:02d}", [f"n{rng.randrange(max(0, i - 4), i):02d}" for _ in range(rng.randrange(1, 4))] if i else [], "c", 0) for i in range(40)]
    df = spark.createDataFrame(rows, NODES)
    got = hierarchy.descendants(df, hierarchy.roots(df)).collect()
    parents = {n.upper(): {p.upper() for p in ps} for n, ps, *_ in rows if n not in "zy"}
    want = set()
    for n in parents:
        level, steps, seen = {n}, 0, {n}
        while level:
            level, steps = {p for x in level for p in parents[x]} - seen, steps + 1
            seen |= level
            want |= {(p, n, steps) for p in level}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and {("A", "B", 1), ("A", "C", 1), ("B", "C", 1)} <= want


def test_paths_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from landweave import session

    n, written = 3000, []
    whole = session.Stage.write
    monkeypatch.setattr(session.Stage, "write", lambda self, df: written.append(1) or whole(self, df))
    rows = [(f"x{i:05d}", [f"x{i - 1:05d}", f"X{i - 1:05d} "] if i else [], "c", 0) for i in range(n)] + [("side", ["x01000", "x00999"], "c", 0)]
    df = spark.createDataFrame(rows, NODES)
    found = hierarchy.roots(df)
    before = len(written)
    got = {r.node_id: r.path for r in hierarchy.paths(df, found).collect()}
    assert len(written) - before <= 4 + 13 and len(got) == n + 1
    assert got[f"X{n - 1:05d}"] == [f"X{i:05d}" for i in range(n)] and got["SIDE"] == [f"X{i:05d}" for i in range(1000)] + ["SIDE"]


def test_hierarchy_of_an_empty_table(spark):
    assert hierarchy.paths(spark.createDataFrame([], NODES), spark.createDataFrame([], "node_id string, root_id string, depth int")).count() == 0
    assert hierarchy.roots(spark.createDataFrame([], NODES)).count() == 0


ROWS = "feed_id string, delivery_no int, record_id string, ingest_seq bigint, attributes_raw string, field string"


def deliveries(spark, feeds):
    rows, seq = [], 0
    for (feed, no), records in feeds.items():
        for rid, a in records:
            seq += 1
            rows.append((feed, no, rid, seq, a if a is None or isinstance(a, str) else json.dumps(a), "x"))
    return spark.createDataFrame(rows, ROWS)


def test_schema_changes(spark):
    n = range(12)
    feeds = {
        ("f", 1): [(f"r{i}", {"Plot": i + 100, "Area": float(i), "Well": i % 2 == 0, "Tax": True, "Gone": "g"}) for i in n] + [("bad", '{"Plot": 1'), ("none", None), ("list", "[1]")],
        ("f", 2): [(f"r{i}", {"Plot_No": {"value": f"No. {i + 100}", "src": "x"}, "Area": f"{i}.0 m", "well": "Y" if i % 2 == 0 else "N", "Tax": None, "New": [1]}) for i in n] * 2,
        ("g", 2): [("r1", {"Alone": 1})],
    }
    got = {tuple(r) for r in schema_drift.changes(deliveries(spark, feeds)).collect()}
    assert got == {
        ("f", 2, "renamed", "Plot", "Plot_No"), ("f", 2, "retyped", "Plot", "Plot_No"), ("f", 2, "retyped", "Area", "Area"), ("f", 2, "renamed", "Well", "well"), ("f", 2, "retyped", "Well", "well"),
        ("f", 2, "removed", "Gone", ""), ("f", 2, "added", "", "New"),
    }
    rows = {(r.delivery_no, r.record_id): r for r in schema_drift.consistent(deliveries(spark, feeds)).where("feed_id = 'f'").collect()}
    assert rows[2, "r3"].attributes["Plot"] == "No. 103" and rows[2, "r3"].numbers.get("Plot", 103.0) == 103.0
    assert schema_drift.changes(deliveries(spark, {})).count() == 0


def test_drifting_fields_have_typed_values(spark):
    good = {"B": True, "L": [1, "x"], "O": {"x": 1}, "D": "2020-01-02", "N": 5, "T": "text"}
    bad = {"B": "maybe", "L": "oops", "O": "oops", "D": "soon", "N": "five", "T": "7"}
    feeds = {("h", 1): [*[(f"a{i}", good) for i in range(3)], ("b", bad), ("c", {"B": None}), ("d", "{"), ("e", {}), ("n", None), ("y", {"B": "No", "N": " 6 "})], ("h", 2): [("a0", {**good, "B": False})]}
    got = {(r.delivery_no, r.record_id): r for r in schema_drift.consistent(deliveries(spark, feeds)).collect()}
    assert set(got) == {(1, "a0"), (1, "a1"), (1, "a2"), (1, "b"), (1, "c"), (1, "e"), (1, "y"), (2, "a0")}
    a = got[1, "a0"]
    assert a.numbers == {"N": 5.0} and a.booleans == {"B": True} and a.arrays == {"L": ["1", "x"]} and json.loads(a.objects["O"]) == {"x": "1"} and str(a.days["D"]) == "2020-01-02" and a.attributes["T"] == "text" and a.failed == []
    b = got[1, "b"]
    assert b.failed == ["B", "L", "N", "O"] and b.numbers == b.booleans == b.arrays == b.objects == b.days == {} and b.attributes["N"] == "five"
    assert got[1, "c"].attributes == {} == got[1, "e"].attributes and got[1, "c"].failed == [] and got[1, "y"].booleans == {"B": False} and got[1, "y"].numbers == {"N": 6.0} and got[2, "a0"].booleans == {"B": False}
    assert schema_drift.consistent(deliveries(spark, {})).count() == 0


def test_points_near_and_within(spark):
    rng = random.Random(2)
    marks = [(i, 74 + rng.random() * 0.002, 11 + rng.random() * 0.002) for i in range(400)] + [(999, None, None)]
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    geoms = {
        1: {"type": "Polygon", "coordinates": [square(74.0003, 11.0003, 0.001), square(74.0006, 11.0006, 0.0003)]},
        2: {"type": "MultiPolygon", "coordinates": [[square(74.0, 11.0, 0.0002)], [[[11.0015, 74.0015], [11.0019, 74.0015], [11.0016, 74.0017], [11.0015, 74.0019], [11.0015, 74.0015]]]]},
        3: {"type": "Point", "coordinates": ["74.001", "11.001"]}, 4: {"type": "Feature", "geometry": {"type": "Point", "coordinates": [11.0005, 74.0005]}}, 5: {"type": "LineString", "coordinates": [[74, 11], [74.1, 11]]},
        6: {"type": "Point", "coordinates": []},
    }
    seen = spatial.shapes(spark.createDataFrame([(k, json.dumps(g)) for k, g in geoms.items()] + [(7, None), (8, "{"), (9, "")], "key bigint, geometry string"), "key", "geometry")
    assert {r.key for r in seen.collect()} == {1, 2, 3, 4}
    m = spark.createDataFrame(marks, "id bigint, lon double, lat double")
    from landweave.functions.triangles import inside

    polys = {1: [[r[:-1] for r in map(lambda q: [tuple(p) for p in q], geoms[1]["coordinates"])]], 2: [[[tuple(p) for p in geoms[2]["coordinates"][0][0][:-1]]], [[(p[1], p[0]) for p in geoms[2]["coordinates"][1][0][:-1]]]]}
    want = {(i, k) for i, x, y in marks if x for k, p in polys.items() if inside(p, x, y)}
    assert {tuple(r) for r in spatial.within(m, seen).collect()} == want and want
    import math

    def metres(x1, y1, x2, y2):
        h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return 2 * spatial.EARTH_M * math.asin(math.sqrt(h))

    pts = {3: (74.001, 11.001), 4: (74.0005, 11.0005)}
    near = {(i, k) for i, x, y in marks if x for k, p in pts.items() if metres(x, y, *p) <= 20}
    assert {(r.id, r.key) for r in spatial.near(m, seen.where("area IS NULL"), 20.0).collect()} == near and near


def test_full_cells_are_salted(spark, monkeypatch):
    m = spark.createDataFrame([(i, 74.00001, 11.00001) for i in range(50)], "id bigint, lon double, lat double")
    p = spark.createDataFrame([(i, 74.00001, 11.00001) for i in range(7)], "key bigint, lon double, lat double")
    monkeypatch.setattr(spatial, "CELL_ROWS", 3)
    assert spatial.near(m, p, 10.0).select("id", "key").distinct().count() == 350 == spatial.near(m, p, 10.0).count()
