"""Functions, formats, evidence, streaming and the queries' contract of the core."""

import hashlib
import io
import json
import math
import random
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from landweave.functions import planar, text
from landweave.functions.triangles import area2, triangulate
from landweave.operators import evidence, ingest, sequences
from landweave.operators.components import components
from landweave.sources import formats, sinks
from landweave.streaming import streams


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = prev + 1 if x == y else max(row[j + 1], row[j])
            prev = keep
    return row[-1]


def test_indel_ratio_is_the_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc_") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        want = 100.0 if not a and not b else 200 * brute_lcs(a, b) / (len(a) + len(b))
        assert text.indel_ratio(a, b) == pytest.approx(want)


def test_names():
    assert text.normal_name("Shri Ramesh Kumar") == "ramesh kumar" and text.normal_name("Smt. Priya Devi s/o X") == "priya devi"
    assert text.token_set_ratio("ramesh kumar", "kumar ramesh singh") == 100 and text.compare_names(None, "x") == (0.0, 0.0, "NO_MATCH")
    assert text.indic_soundex("") == "0000" and text.compare_names("Ramesh", "Shri RAMESH")[2] == "EXACT"
    assert text.best_owner(["a b", "ramesh kumar"], ["Ramesh Kumar"])[1] == 1.0


def test_numbers_and_gates(spark):
    rows = [("15421852073856", "VALID"), ("15-4218 52073856", "VALID"), ("99421852073856", "UNKNOWN_STATE"), ("123", "WRONG_LENGTH"), ("1542185207385x", "NOT_DIGITS"), ("", "EMPTY"), (None, "EMPTY")]
    df = spark.createDataFrame(rows, "u string, want string")
    assert df.where(text.ulpin_status(F.col("u")) != F.col("want")).count() == 0
    gates = spark.createDataFrame([(77.0, 28.0, "NONE"), (18.5, 73.8, "AXIS_ORDER"), (77.0, 95.0, "IMPOSSIBLE_EXTENT"), (0.0, 0.0, "PLAUSIBILITY")], "x double, y double, want string")
    x, y = F.col("x"), F.col("y")
    assert gates.where(ingest.crs_gate(x, y, x, y) != F.col("want")).count() == 0
    links = sequences.ulpin_groups(spark.createDataFrame([(f"1542{s:010d}",) for s in (5, 29, 55, 56, 300)], "u string"), "u")
    assert {r.group for r in links.collect()} == {"15420000000005", "15420000000056", "15420000000300"}


def test_polygon_kernels():
    box = lambda x, y, w, h: [[[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]]
    assert planar.intersection_area(box(0, 0, 2, 1), box(1, 0, 2, 1)) == pytest.approx(1)
    shape_l = [[[(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]]]
    assert planar.intersection_area(shape_l, box(0.5, 0.5, 1, 1)) == pytest.approx(0.75)
    holed = [[box(0, 0, 4, 4)[0][0], [(1, 1), (1, 3), (3, 3), (3, 1)]]]
    assert planar.plain_area(holed) == 12 and planar.intersection_area(holed, box(0, 0, 4, 4)) == pytest.approx(12)
    assert planar.hausdorff(box(0, 0, 1, 1), box(0, 0, 1, 3)) == pytest.approx(2) and planar.length_inside([(-1, 0.5), (3, 0.5)], box(0, 0, 2, 1)) == pytest.approx(2)
    rng = random.Random(4)
    for _ in range(30):
        pts = sorted((rng.random() * 2 * math.pi for _ in range(rng.randrange(3, 12))))
        ring = [(math.cos(t) * r, math.sin(t) * r) for t, r in ((t, 0.3 + rng.random()) for t in pts)]
        if any(b - a > 3 for a, b in zip(pts, pts[1:] + [pts[0] + 2 * math.pi])):
            continue  # the star then doesn't hold its centre and may cross itself
        assert sum(abs(area2(list(t))) for t in triangulate([ring])) == pytest.approx(abs(area2(ring)))


def test_box_measures_match_the_kernels(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(40):
        a, b = ([74 + rng.random() * 0.0005, 11 + rng.random() * 0.0005] for _ in range(2))
        rows.append((*a, a[0] + 0.0004, a[1] + 0.0003, *b, b[0] + 0.0003, b[1] + 0.0005))
    df = spark.createDataFrame(rows, ", ".join(f"{p}{n} double" for p in "ab" for n in ("minx", "miny", "maxx", "maxy")))
    for r in planar.box_measures(df, "a", "b").collect():
        g = lambda p: json.dumps({"type": "Polygon", "coordinates": [[[r[p + x], r[p + y]] for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))]]})  # noqa: B023, E731
        assert [r.iou, r.hausdorff_m, r.area_diff, r.centroid_m] == pytest.approx(planar.measures(g("a"), g("b")), rel=1e-6, abs=1e-9)


def test_ed25519_and_envelopes():
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    key = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    assert evidence.public_key(seed) == key
    assert evidence.sign(seed, b"\x72").hex().startswith("92a009a9f0d4cab8720e820b5f642540")
    env = evidence.envelope({"b": [1, "é"], "a": None}, seed)
    trusted = {evidence.key_id(key): key}
    assert evidence.check_envelope(env, trusted) == "OK"
    assert evidence.check_envelope({**env, "a": 1}, trusted) == "HASH_MISMATCH" and evidence.check_envelope(env, {}) == "UNKNOWN_KEY"
    assert evidence.check_envelope({**env, "signature": "00" * 64}, trusted) == "BAD_SIGNATURE" and evidence.check_envelope({**env, "signature": None}, trusted) == "MISSING_SIGNATURE"


def test_keys_and_payloads(spark):
    seed = bytes(range(32))
    assert evidence.seed_of(seed) == seed == evidence.seed_of(evidence.pem_of(seed))
    with pytest.raises(ValueError):
        evidence.seed_of(b"-----BEGIN X-----\nAAAA\n-----END X-----")
    r = evidence.Registry({"a": evidence.public_key(seed)})
    r.register("a", evidence.public_key(seed))
    with pytest.raises(ValueError):
        r.register("a", bytes(32))
    assert evidence.Registry.from_json(r.to_json()).keys == r.keys
    df = spark.createDataFrame([(["b", "a"], ["r2", "r1"], ["GAP"], None)], "p array<string>, r array<string>, c array<string>, d string")
    got = json.loads(df.select(evidence.payload(F.lit("2024-01-01T00:00:00Z"), F.col("p"), F.col("r"), F.col("c"), decision=F.col("d"))).first()[0])
    assert got["parcel_ids"] == ["a", "b"] and got["source_record_ids"] == ["r1", "r2"] and got["decision"] is None and got["created_at_utc"].startswith("2024")


def test_reranking(spark, tmp_path):
    from landweave.operators import ml

    rows = [("a", "b", 0.9, 0.95, 1.0, 0.02, 0.5, 1.0, 0.9, True, True, 2), ("c", "d", 0.5, 0.0, 450.0, 0.5, 400.0, 0.0, 0.0, False, False, 0), ("e", "f", 0.6, None, None, None, None, None, None, None, None, None)]
    p = spark.createDataFrame(rows, "a_record_id string, b_record_id string, overall double, iou double, hausdorff_m double, area_diff double, centroid_m double, score_identifier double, owner_similarity double, land_use_match boolean, ward_match boolean, lineages int")
    p = p.withColumn("a_capture_date", F.lit(None).cast("date")).withColumn("b_capture_date", F.current_date()).withColumn("a_source_type", F.lit("DRONE_ORI")).withColumn("b_source_type", F.lit(None).cast("string"))
    f = {r.a_record_id: r for r in p.select("a_record_id", *[v.alias(n) for n, v in ml.features(p).items()]).collect()}
    assert f["c"].owner_similarity == 0.5 == f["e"].owner_similarity and f["c"].hausdorff_norm == 0.9 and f["e"].iou == 0 and f["a"].independent_lineages == 2 and f["a"].source_quality_diff == pytest.approx(0.5)
    model = ml.ensured(spark, str(tmp_path / "m"))
    assert model.info["metrics"]["f1"] > 0.9 and set(model.info["feature_importances"]) == set(ml.FEATURES)
    again = ml.load(spark, str(tmp_path / "m"))
    got = {r.a_record_id: r for r in ml.rerank(p, model).collect()}
    assert got == {r.a_record_id: r for r in ml.rerank(p, again).collect()} and ml.load(spark, str(tmp_path / "none")) is None
    assert got["a"].learned > 0.8 > 0.3 > got["c"].learned and got["a"].calibrated > got["c"].calibrated and got["a"].final == pytest.approx(0.6 * got["a"].learned + 0.36, abs=1e-5) and len(got["a"].strongest) == 4
    plain = {r.a_record_id: r for r in ml.rerank(p, None).collect()}
    assert plain["c"].final == plain["c"].learned == 0.5 and plain["c"].strongest == []


def test_formats(spark, tmp_path):
    point = {"type": "Point", "coordinates": [74.5, 11.5]}
    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": point, "properties": {"Ward": 4, "capture_date": "2020-01-02"}}, {"type": "Feature", "geometry": None, "properties": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(fc))
    (tmp_path / "b.csv").write_text('id,WKT,Survey_Date\n1,"POLYGON ((0 0, 1 0, 1 1, 0 0))",2019-01-01\n2,,\n')
    (tmp_path / "c.csv").write_text("lat,lon,n\n11.5,74.5,x\nbad,,y\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "bad.geojson").write_text("{")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("in.geojson", json.dumps(fc))
    df = spark.createDataFrame([("p1", json.dumps(point)), ("p2", None)], "name string, geometry string")
    sinks.write_geopackage(str(tmp_path / "g.gpkg"), {"parcels": df})
    assert formats.geopackage_layers((tmp_path / "g.gpkg").read_bytes()) == ["parcels"]
    got = formats.read_features(spark, str(tmp_path)).collect()
    by = lambda n: [r for r in got if r.path.endswith(n)]
    assert by("a.geojson")[0].properties == {"Ward": "4"} and by("a.geojson")[0].capture_timestamp == "2020-01-02" and by("a.geojson")[1].geometry is None
    assert json.loads(by("b.csv")[0].geometry)["type"] == "Polygon" and by("b.csv")[0].capture_timestamp == "2019-01-01" and by("b.csv")[1].geometry is None
    assert json.loads(by("c.csv")[0].geometry) == point and by("c.csv")[1].geometry is None and not by("d.csv")
    assert by("bad.geojson")[0].error and len(by("z.zip")) == 2
    assert json.loads(by("g.gpkg")[0].geometry) == point and by("g.gpkg")[1].geometry is None


def test_shapefile_and_tiff():
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp = b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body
    dbf = struct.pack("<4BIHH20x", 3, 0, 0, 0, 1, 65, 6) + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5]) + b"\0" * 15 + b"\r" + b" hello"
    (geometry, props, _), = formats.read_shapefile(shp, dbf)
    assert json.loads(geometry)["coordinates"] == [[list(p) for p in ring]] and props == {"NAME": "hello"}
    tags = [(256, 3, 1, 10), (257, 3, 1, 20), (33550, 12, 3, 100), (33922, 12, 6, 124)]
    tif = b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
    tif = tif.ljust(100, b"\0") + struct.pack("<3d", 0.1, 0.1, 0) + struct.pack("<6d", 0, 0, 0, 70.0, 20.0, 0)
    (geometry, props, _), = formats.read_geotiff(tif)
    assert props["width"] == "10" and json.loads(geometry)["coordinates"][0][2] == pytest.approx([71.0, 20.0])


def test_shapefiles_and_parquet_through_the_reader(spark, tmp_path):
    from landweave.operators import adapters

    ring = [(500000.0, 2000000.0), (500000.0, 2000100.0), (500100.0, 2000100.0), (500000.0, 2000000.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "Plots.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    (tmp_path / "plots.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 0, 0, 0, 1, 65, 6) + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5]) + b"\0" * 15 + b"\r" + b" hello")
    (tmp_path / "Plots.prj").write_text('PROJCS["WGS_1984_UTM_Zone_43N",GEOGCS["GCS_WGS_1984"]]')
    (tmp_path / "Plots.shx").write_bytes(b"x")
    (tmp_path / "what.xyz").write_bytes(b"x")
    (tmp_path / "m.csv").write_text("Point_ID,lon,lat,method,Epoch,pdop\nA,74.5,11.5,RTK CORS,2020-01-01,1.2\n,x,,,,\n")
    wkb = sinks.wkb({"type": "Point", "coordinates": [74.5, 11.5]})
    spark.createDataFrame([(bytearray(wkb), "a", "2020-01-01", [1, 2]), (bytearray(b"bad"), None, "", None), (None, "c", None, [])], "geometry binary, Name string, survey_date string, list array<int>").coalesce(1).write.parquet(str(tmp_path / "geo"))
    got = formats.read_features(spark, str(tmp_path)).collect()
    shp, = [r for r in got if r.path.endswith(".shp")]
    lon, lat = json.loads(shp.geometry)["coordinates"][0][0]
    assert shp.properties == {"NAME": "hello"} and lon == pytest.approx(75.0) and lat == pytest.approx(18.0887089, abs=1e-6)
    assert [r.error for r in got if r.path.endswith("what.xyz")] == ["ValueError: unknown format"] and not [r for r in got if r.path.endswith((".dbf", ".prj", ".shx"))]
    rows = {r.feature_idx: r for r in got if r.path.endswith(".parquet")}
    assert json.loads(rows[0].geometry)["coordinates"] == [74.5, 11.5] and rows[0].properties == {"Name": "a", "list": "[1,2]"} and rows[0].capture_timestamp == "2020-01-01"
    assert rows[1].geometry is None and rows[1].capture_timestamp is None and rows[2].geometry is None and rows[2].properties["Name"] == "c"
    plan = formats.read_geoparquet_table(spark, str(tmp_path / "geo"), properties=("Name",)).select("properties")._jdf.queryExecution().executedPlan().toString()
    assert "Name#" in plan and "survey_date#" not in plan and "geometry#" not in plan
    marks = {r.point_id: r for r in adapters.gnss_files(formats.read_features(spark, str(tmp_path / "m.csv")), "DS", "c").collect()}
    assert (marks["A"].lon, marks["A"].method, marks["A"].pdop, marks["A"].observation_epoch) == (74.5, "RTK CORS", 1.2, "2020-01-01") and marks["P0001"].lon is None
    assert adapters.gnss(adapters.gnss_files(formats.read_features(spark, str(tmp_path / "m.csv")), "DS", "c")).count() == 1
    assert [r.parent_ids for r in adapters.lineage_nodes("DS", "GNSS", "c", spark).collect()] == [[], ["ORIG-GNSS-DS"]]
    seen = {r.path[-7:]: r.sha256 for r in formats.file_hashes(spark, str(tmp_path)).collect()}
    assert seen["hat.xyz"] == hashlib.sha256(b"x").hexdigest()


def test_packages(spark):
    rows = spark.createDataFrame([("p", {"decision.json": '{"a":1}'}), ("q", None)], "id string, members map<string,string>")
    p, q = sorted(sinks.packages(rows).collect())
    with zipfile.ZipFile(io.BytesIO(p.content)) as z:
        assert z.namelist() == [f"parcel_p/{n}" for n in (*sinks.MEMBERS, "manifest.sha256")] and p.size == len(p.content)
        for line in z.read("parcel_p/manifest.sha256").decode().splitlines():
            digest, name = line.split("  ")
            assert hashlib.sha256(z.read(f"parcel_p/{name}")).hexdigest() == digest
        assert z.read("parcel_p/decision.json") == b'{"a":1}'
    assert q.name == "q.zip" and q.manifest_hash != p.manifest_hash
    f = sinks.geojson_features(spark.createDataFrame([("b", None, 1), ("a", '{"type":"Point","coordinates":[1,2]}', 2), ("c", "{", 3)], "id string, geometry string, n int"), "id", "geometry", ("n",))
    first = sinks.items(f, "id", "http://x", "parcels", 0, 2)
    assert first["numberMatched"] == 3 and first["numberReturned"] == 2 and [x["rel"] for x in first["links"]] == ["self", "next"] and first["links"][1]["href"].endswith("items?offset=2&limit=2")
    last = sinks.items(f, "id", "http://x", "parcels", 2, 2)
    assert [x["id"] for x in last["features"]] == ["c"] and [x["rel"] for x in last["links"]] == ["self", "prev"] and sinks.item(f, "id", "a")["properties"] == {"n": 2} and sinks.item(f, "id", "z") is None
    assert {c["id"] for c in sinks.collections("http://x")} == set(sinks.COLLECTIONS)
    doc = json.loads(sinks.feature_collection(f, "id", 2))
    assert [x["id"] for x in doc["features"]] == ["a", "b"] and doc["features"][0]["geometry"]["coordinates"] == [1, 2]


def test_evidence_and_names_take_every_row(spark, tmp_path):
    import __spark_entry__ as entry

    parcels = [("P1", "V000001", ["a"], "NEW"), ("P2", "V000002", ["b"], "NEW"), ("P5", None, None, "NEW"), ("P6", "V000009", [], None)]
    spark.createDataFrame(parcels, "canonical_id string, village_code string, source_record_ids array<string>, status string").write.parquet(str(tmp_path / "canonical_parcel.parquet"))
    names = [(1, "Shri Ramesh Kumar"), (2, "श्री रमेश"), (3, "José Pinto"), (4, ""), (5, None)]
    spark.createDataFrame(names, "pair_id bigint, name_a string").write.parquet(str(tmp_path / "name_match_result.parquet"))
    run = lambda q: entry.queries()[q](spark, str(tmp_path)).collect()
    assert {r.pair_id: r.normal for r in run("name_normalize")} == {i: None if n is None else text.normal_name(n) for i, n in names}
    verdicts = {r.verdict: r.envelopes for r in run("evidence_verify")}
    assert sum(verdicts.values()) == 4 and sorted(verdicts.values()) == [1, 3]
    assert len(run("evidence_zip")) == 4


def test_rate_limiter(spark):
    rows = [(1, i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 1, 2, 3, 30, 31])] + [(1, 9, "2024-01-01 00:05:00"), (2, 10, "2024-01-01 00:00:00")]
    e = spark.createDataFrame(rows, "k int, n int, t string").withColumn("ts", F.to_timestamp("t"))
    got = {r.n: r.admitted for r in sequences.admissions(e, "k", "ts", "n", 2, 20).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 9: True, 10: True}


def test_components(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefg"], "node string")
    pairs = spark.createDataFrame([("g", "f"), ("f", "e"), ("e", "b"), ("c", "d"), ("c", "c")], "u string, v string")
    assert {tuple(r) for r in components(nodes, pairs).collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "c"), ("e", "b"), ("f", "b"), ("g", "b")}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:10:00")], "k int, t string").withColumn("ts", F.to_timestamp("t")).write.parquet(str(src))
    read = lambda: spark.readStream.schema("k int, t string, ts timestamp").parquet(str(src))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sum(r.admitted for r in run(streams.admissions(read(), "k", "ts", 1, 60), "limited", "append")) == 2
    assert {(r.k, r.events) for r in run(streams.window_counts(read(), "ts", "k", "1 minute", "1 minute"), "counted", "complete")} == {(1, 2), (2, 1)}
    q = read().writeStream.foreachBatch(streams.upsert(str(tmp_path / "table"), "k", "ts")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert streams.current(spark, str(tmp_path / "table")).count() == 2
    times = spark.createDataFrame([("02/01/2020 10:00 pm", "s", "DMY", "Asia/Kolkata"), ("02/01/2020", "s", None, None), ("2020-01-02T03:04:05Z", "s", None, None)], "value string, source string, date_order string, time_zone string")
    times.write.parquet(str(tmp_path / "times"))
    got = {r.value: r for r in run(streams.parsed_times(spark.readStream.schema(times.schema).parquet(str(tmp_path / "times")), "value"), "timed", "append")}
    us = lambda t: spark.sql(f"SELECT unix_micros(timestamp'{t}')").first()[0]
    assert got["02/01/2020 10:00 pm"].instant_us == us("2020-01-02 16:30:00+00:00") and got["2020-01-02T03:04:05Z"].instant_us == us("2020-01-02 03:04:05+00:00")
    assert got["02/01/2020"].instant_us is None and got["02/01/2020"].is_ambiguous


def test_upsert_keeps_what_lies_far_back(spark, tmp_path):
    put = streams.upsert(str(tmp_path / "t"), "k", "n", buckets=4)
    assert streams.current(spark, str(tmp_path / "t")) is None
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n int, v string")
    put(rows(("a", 1, "x"), ("b", 1, "x"), (None, 1, "x"), ("a", 2, "y")), 0)
    put(rows(("c", 1, "x")), 7)
    put(rows(), 8)
    put(rows(("b", 0, "late"), ("a", 3, "z")), 20)
    put(rows(("b", 0, "late"), ("a", 3, "z")), 20)  # the same batch again
    assert {(r.k, r.n, r.v) for r in streams.current(spark, str(tmp_path / "t")).collect()} == {("a", 3, "z"), ("b", 1, "x"), ("c", 1, "x"), (None, 1, "x")}


def test_queries_have_unique_names_and_sql():
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and "flagship_conflict_summary" in q and len(q) > 70


def test_geopackage_is_sqlite(spark, tmp_path):
    sinks.write_geopackage(str(tmp_path / "e.gpkg"), {"none": spark.createDataFrame([], "geometry string, a int")})
    with sqlite3.connect(tmp_path / "e.gpkg") as db:
        assert db.execute('SELECT count(*) FROM "none"').fetchone() == (0,)


def test_topology_corrections():
    from landweave.functions import geojson
    from landweave.operators import topology

    box = lambda x, y, w, h: json.dumps({"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]})
    a, b = box(74, 11, 0.0004, 0.0004), box(74.0003, 11.0001, 0.0004, 0.0002)
    area = lambda g: planar.plain_area(geojson.shape(g)[1])
    got = topology.correct("OVERLAP", a, b, True)
    assert got[0] == "OVERLAP_SPLIT" and area(got[3]) == pytest.approx(area(b) - 0.0001 * 0.0002, rel=1e-6) and area(got[2]) == pytest.approx(area(a))
    kept = topology.correct("OVERLAP", a, b, False)
    assert area(kept[2]) == pytest.approx(area(a) - 0.0001 * 0.0002, rel=1e-6) and area(kept[3]) == pytest.approx(area(b))
    assert topology.correct("OVERLAP", a, a, True)[0] == topology.correct("OVERLAP", a, box(75, 11, 1e-4, 1e-4), True)[0] == "NONE"
    assert topology.correct("OVERLAP", a, None, True)[0] == topology.correct("GAP", "{", a, True)[0] == "NO_AREA" and topology.correct("AREA_MISMATCH", a, b, True)[0] == "NONE"
    lat_m = 111132.92 - 559.82 * math.cos(math.radians(2 * 11.0002))
    near = topology.correct("BOUNDARY_OFFSET", a, box(74.00001, 11, 0.0004, 0.0004), True)
    assert near[0] == "BOUNDARY_ALIGN" and near[1] == pytest.approx(0.00001 * lat_m, rel=1e-5) and area(near[3]) == pytest.approx(area(a), rel=1e-6)
    assert topology.correct("BOUNDARY_OFFSET", a, a, True)[0] == "NONE" and topology.correct("BOUNDARY_OFFSET", a, b, True)[0] == "OFFSET_TOO_LARGE"
    # 1 m apart over a side of 44 m: 50 square metres are not exceeded; 2 m apart they are.
    thin = topology.correct("GAP", a, box(74.00041, 11, 0.0004, 0.0004), True)
    assert thin[0] == "GAP_FILL" and thin[1] == pytest.approx(0.00001 * 0.0004 * lat_m * 111412.84 * math.cos(math.radians(11.0002)), rel=1e-5)
    assert area(thin[2]) == pytest.approx(area(a) + 0.000005 * 0.0004, rel=1e-4) == pytest.approx(area(thin[3]), rel=1e-4)
    assert topology.correct("GAP", a, box(74.00042, 11, 0.0004, 0.0004), True)[0] == "GAP_LARGE" and topology.correct("GAP", a, b, True)[0] == "NONE"
    line, across = [(74, 11), (74.001, 11)], [(73.999, 11.0002), (74.001, 11.0002)]
    ring = geojson.shape(a)[1]
    assert topology.collinear_m(line, ring) == pytest.approx(0.0004 * planar.RIPPLE_M_PER_DEG, rel=1e-6)
    assert topology.crossing_m(across, ring) == pytest.approx(0.0004 * planar.RIPPLE_M_PER_DEG, rel=1e-6) and topology.collinear_m(across, ring) == 0


def test_lines_meet_areas_in_every_cell_they_cross(spark):
    from landweave.operators import topology

    box = lambda x, y, w, h: json.dumps({"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]})
    lines = [(1, "c", json.dumps({"type": "LineString", "coordinates": [[74.0, 11.0], [74.03, 11.02]]})), (2, "c", json.dumps({"type": "MultiLineString", "coordinates": [[[11.0, 74.0], [11.02, 74.03]], [[11.5, 75], [11.6, 75]]]})),
             (3, "d", json.dumps({"type": "LineString", "coordinates": [[74.0, 11.0], [74.03, 11.02]]})), (4, "c", None), (5, "c", "{"), (6, "c", json.dumps({"type": "LineString", "coordinates": [[1, 2], None]})), (7, None, "")]
    areas = [("far", "c", box(74.02, 11.012, 0.004, 0.004)), ("wide", "c", box(74.001, 10.99, 0.02, 0.02)), ("off", "c", box(74.0, 11.015, 0.001, 0.001)), ("none", "c", None)]
    got = {(r.key, r.area_key): r for r in topology.lines_on_areas(spark.createDataFrame(lines, "key bigint, case_id string, line string"), spark.createDataFrame(areas, "area_key string, case_id string, area string")).collect()}
    inside = {k for k, r in got.items() if r.inside_m > 0.5}
    assert inside == {(1, "far"), (1, "wide"), (2, "far"), (2, "wide")}
    # The line leaves the first area through its upper right half: from x = 74.02 to 74.024, y = 2/3 of x.
    assert got[1, "far"].inside_m == pytest.approx(math.hypot(0.004, 0.004 * 2 / 3) * planar.RIPPLE_M_PER_DEG, rel=1e-3) == pytest.approx(got[2, "far"].inside_m, rel=1e-6)
