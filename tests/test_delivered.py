"""What the delivered queries keep and leave out, over the smallest tables."""

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from landweave import session
from landweave.operators import ingest, lineage, pipeline, reconcile, topology
from landweave.plans import delivered_queries as q
from landweave.tables import table


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    to = tmp_path_factory.mktemp("delivered") / "t"
    shutil.copytree(Path("/root/testdata/sf0.001"), to)
    return str(to)


def kept(folder):
    return {k[1] for k in session._kept if folder in k[2]}


def test_geometries_do_not_wait_for_proposals(spark, folder):
    got = q.delivered_geometries(spark, folder)
    assert not {"delivered measured", "delivered told", "delivered proposals"} & kept(folder)
    rows = got.collect()
    m = {r.record_id: (r.parcel_id, r.geometry) for r in q._reconciled(spark, folder)["members"].collect()}
    assert len(rows) == len(m) and all(m[r.record_id] == (r.parcel_id, r.geometry) for r in rows)
    assert sorted(r.parcel_id for r in rows if r.is_reference) == sorted({p for p, _ in m.values()})


def test_topology_does_not_wait_for_lineages(spark, folder):
    assert q.delivered_topology(spark, folder).count() > 0
    assert "delivered measured" in kept(folder) and not {"delivered told", "delivered proposals"} & kept(folder)


def test_lone_records_give_the_same_proposals_without_grouping(spark, folder):
    r = q._proposed(spark, folder)
    m = r["members"]
    told = lineage.independence(m.select(F.col("parcel_id").alias("group_id"), "record_id", F.col("provenance_node_id").alias("node_id")), r["origins"])
    measured = reconcile.measured_pairs(m).drop("a_geometry", "b_geometry")
    whole = pipeline.proposals(m, r["pairs"], measured, told, pipeline.conflicts(m, measured, told))
    # Moved outlines depend in their last figures on the order in which positions are added.
    texts = lambda df: sorted(json.dumps(x.asDict() | {"proposed_geometry": None if x.moved_m else x.proposed_geometry, "area_change": round(x.area_change, 12)}, sort_keys=True) for x in df.collect())
    got = q._all_proposed(r)
    assert got.dtypes == whole.dtypes and texts(got) == texts(whole)
    assert "Exchange hashpartitioning" not in pipeline.lone_proposals(r["lone"])._jdf.queryExecution().executedPlan().toString()
    assert r["proposed"].where("records < 2").isEmpty() and r["several"].count() < m.count()


def test_packages_hash_only_what_they_hold(spark, folder):
    assert "content_hash" not in q._ingested(spark, folder).columns
    r = q._several(spark, folder)
    got = {x.seq: x.content_hash for x in q._hashed(spark, folder, r["several"]).select("seq", "content_hash").collect()}
    want = {x.ingest_seq: ingest.canonical_hash(x.geometry, x.attributes, x.source_crs) for x in table(spark, folder, "source_record").collect()}
    assert len(got) == r["several"].count() > 0 and all(want[s] == h for s, h in got.items())
    n, packages = q._proposed(spark, folder)["proposed"].count(), q.delivered_packages(spark, folder).collect()
    assert len(packages) == n and all(len(p.manifest_hash) == 64 for p in packages)


def test_lines_apart_from_outlines_are_not_measured(spark, monkeypatch):
    box = lambda x, y, d: json.dumps({"type": "Polygon", "coordinates": [[[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]]})
    line = lambda *p: json.dumps({"type": "LineString", "coordinates": p})
    areas = spark.createDataFrame([("in", "c", box(74.0001, 11.0001, 2e-4)), ("beside", "c", box(74.0006, 11.0006, 2e-4)), ("other", "d", box(74.0001, 11.0001, 2e-4))], "area_key string, case_id string, area string")
    lines = spark.createDataFrame([(1, "c", line([74.0, 11.0002], [74.0004, 11.0002])), (2, "c", line([11.0002, 74.0], [11.0002, 74.0004])), (3, "c", "{")], "key bigint, case_id string, line string")
    all_, near = topology.lines_on_areas(lines, areas), topology.lines_on_areas(lines, areas, apart=False)
    some = lambda df: sorted((r.key, r.area_key, round(r.inside_m, 6)) for r in df.where("inside_m > 0 OR on_outline_m > 0").collect())
    assert some(all_) == some(near) and [x[:2] for x in some(near)] == [(1, "in"), (2, "in")]
    assert all_.count() == 4 and near.count() == 2


def test_found_pairs_are_written_before_records_are_joined(spark, folder, monkeypatch):
    from landweave.operators import matching

    written, write = [], session.Stage.write
    monkeypatch.setattr(session.Stage, "write", lambda self, df: written.append(df.columns) or write(self, df))
    matching.likely(q._reconciled(spark, folder)["records"].limit(0).withColumn("id_ulpin", F.col("ulpin")), ["ulpin"])
    assert ["a_record_id", "b_record_id"] in written
