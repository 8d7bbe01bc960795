"""The registry, and a few registered queries against their oracle."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["flagship_project_report", "lots_from_records", "validate_lots", "outbox_materialize", "win_project_workspace", "geo_area",
          "join_point_in_polygon", "sink_geojson_features", "st_outbox"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    df = entry.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    order = [rel.columns.index(c) for c in names]
    theirs = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_envelope_query_signs_its_bodies(spark, tmp_path):
    import hashlib
    import hmac
    rows = spark.sql("select 7L event_id, timestamp_ntz'2000-01-02 03:04:05.678' ts, 33L user_id, 'click' event_type, 1.5D value, '{\"k\": 1}' props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    row = entry.queries()["outbox_envelope"](spark, str(tmp_path)).first()
    key = hashlib.sha256(b"secret8").digest()
    assert row.signature == "v1=" + hmac.new(key, f"1767225600.{row.body}".encode(), hashlib.sha256).hexdigest()


def test_best_face_tries_every_snap_grid(spark, tmp_path, monkeypatch):
    from parcelflow.operators import faces as Fc
    spark.range(50, 53).selectExpr("id p_partkey", "1 p_size", "1000.0D p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    tried, meshes = [], Fc.meshes
    monkeypatch.setattr(Fc, "meshes", lambda lines, key, snaps, *rest: tried.append(snaps) or meshes(lines, key, snaps, *rest))
    assert entry.queries()["win_best_face_per_anchor"](spark, str(tmp_path)).count() > 0
    assert tried == [(None, 0.50, 0.75, 1.00, 1.25, 1.75)]
