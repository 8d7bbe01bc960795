"""Availability, identity, outbox, jobs, limits and streams against the golden scenarios."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from parcelflow.operators import availability as A, identity as I, jobs as J, limits as M, outbox as O, tenancy as T, validation as V
from parcelflow.streaming import jobs as SJ

T0 = dt.datetime(2024, 1, 1)
REQ = "seq bigint, project_id bigint, unit_id bigint, system string, event_id string, status string, expected_revision bigint, digest string"


def sequential(rows):
    rev, seen, out = {}, {}, {}
    for seq, p, u, s, e, st, x, d in sorted(rows):
        old = seen.get((p, s, e))
        if old is not None:
            out[seq] = "replayed" if old == d else "conflict"
        elif rev.get(u, 0) == x:
            rev[u] = x + 1
            seen[(p, s, e)] = d
            out[seq] = "applied"
        else:
            out[seq] = "stale"
    return out


def random_requests(n, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        u, e, x, st = rng.randrange(6), rng.randrange(n // 3), rng.randrange(4), rng.choice(["sold", "blocked"])
        rows.append((seq, u % 2, u, "crm", f"e{e}", st, x, f"{u}/{e}/{x}/{st}"))
    return rows


def no_units(spark):
    return spark.createDataFrame([], "unit_id bigint, revision bigint")


def test_replay_scenario(spark):
    row = lambda seq, e, st, x: (seq, 1, 1, "crm", e, st, x, f"{e}{st}{x}")
    rows = [row(1, "e1", "sold", 0), row(2, "e1", "reserved", 0), row(3, "e2", "sold", 0), row(4, "e2", "blocked", 1), row(5, "e1", "sold", 0)]
    done = A.apply_requests(spark.createDataFrame(rows, REQ), no_units(spark))
    assert [r.outcome for r in done.orderBy("seq").collect()] == ["applied", "conflict", "stale", "applied", "replayed"]
    state = A.unit_state(done.where("outcome = 'applied'")).first()
    assert (state.status, state.revision) == ("blocked", 2)


def test_apply_matches_the_sequential_walk_in_any_chunking(spark, monkeypatch):
    rows = random_requests(300, 4)
    monkeypatch.setattr(A, "CHUNK_ROWS", 40)
    done = A.apply_requests(spark.createDataFrame(rows, REQ).repartition(3), no_units(spark))
    assert {r.seq: r.outcome for r in done.collect()} == sequential(rows)


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    rows = random_requests(240, 9)
    for i in range(3):
        spark.createDataFrame(rows[i * 80:(i + 1) * 80], REQ).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    source = spark.readStream.schema(REQ).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = SJ.availability(spark, source, str(tmp_path / "out")).collect()
    assert {r.seq: r.outcome for r in got} == sequential(rows)
    again = SJ.availability(spark, source, str(tmp_path / "out")).count()
    assert again == len(rows)


def test_identity_across_versions(spark):
    lots = lambda rows: spark.createDataFrame(rows, "project_id bigint, version_id bigint, lot_id string, block string, name string, status string")
    units = spark.createDataFrame([(1, "u1", "A", "01", "sold", "mapped", "l1")], "project_id bigint, unit_id string, block string, name string, status string, mapping_state string, lot_id string")
    bridge = spark.createDataFrame([("u1", "l1", 1)], "unit_id string, lot_id string, version_id bigint")
    second = I.reconcile_version(lots([(1, 2, "l2", "A", "01", "available")]), units, bridge, True)
    r = second.first()
    assert (r.unit_id, r.status, r.created) == ("u1", "sold", False)
    third = I.reconcile_version(lots([(1, 3, "l3", None, None, "available")]), units, bridge, True)
    assert third.first().status == "blocked" and third.first().created
    after = {x.unit_id: x for x in I.units_after(units, third).collect()}
    assert len(after) == 2 and after["u1"].mapping_state == "needs_reconciliation" and after["u1"].lot_id is None


def test_backfill_keeps_the_sale(spark):
    lots = spark.createDataFrame([(1, 1, "l", T0, 0, "A", "01", "sold"), (1, 2, "m", T0 + dt.timedelta(1), 0, "A", "01", "available")],
                                 "project_id bigint, version_id bigint, lot_id string, created_at timestamp_ntz, sort_order int, block string, name string, status string")
    units, bridge = I.backfill_units(lots)
    u = units.first()
    assert (u.status, u.mapping_state, u.revision, u.lot_id, u.lots) == ("sold", "needs_reconciliation", 0, "m", 2) and bridge.count() == 2


def test_validation_scenario(spark):
    geo = '{"points":[[0,0],[1,0],[1,1]]}'
    lots = spark.createDataFrame([(1, 1, 0, "L001", geo, 1.0), (1, 2, 1, "L001", geo, 1.0), (1, 3, 2, None, geo, None), (1, 4, 3, "L004", '{"points":[[0,0],[1,1]]}', -1.0), (1, 5, 4, "L5", "{bad", -1.0)],
                                 "version_id bigint, lot_id bigint, sort_order int, name string, geometry_json string, area_m2 double")
    issues = V.validate_lots(lots)
    assert {(r.lot_id, r.type) for r in issues.collect()} == {(1, "duplicate_name"), (2, "duplicate_name"), (3, "missing_name"), (4, "invalid_geometry"), (4, "invalid_area"), (5, "invalid_geometry_json")}
    s = V.validation_summary(lots, issues).first()
    assert (s.lot_count, s.issue_count, s.error_count) == (5, 6, 2)


def deliveries(spark, rows):
    return spark.createDataFrame(rows, "delivery_id bigint, webhook_id bigint, event_id bigint, status string, attempts int, next_attempt_at timestamp_ntz, lease_until timestamp_ntz")


def at(seconds):
    return F.lit(T0 + dt.timedelta(seconds=seconds)).cast("timestamp_ntz")


def test_lease_and_backoff(spark):
    first = O.claim(deliveries(spark, [(1, 1, 1, "pending", 0, T0, None)]), at(0)).collect()
    assert first[0].attempts == 1 and first[0].lease_until == T0 + dt.timedelta(seconds=60)
    held = spark.createDataFrame(first, "delivery_id bigint, webhook_id bigint, event_id bigint, status string, attempts int, next_attempt_at timestamp_ntz, lease_until timestamp_ntz, lease_token string, last_error string")
    plain = held.drop("lease_token", "last_error")
    assert O.claim(plain, at(1)).count() == 0
    third = O.claim(plain, at(61)).first()
    assert third.attempts == 2 and third.lease_token != first[0].lease_token
    stale = spark.createDataFrame([(1, "other", 200)], "delivery_id bigint, lease_token string, http_status int")
    assert O.settle(held, stale, at(2)).count() == 0
    for attempts in range(1, 9):
        row = held.withColumn("attempts", F.lit(attempts))
        answer = spark.createDataFrame([(1, first[0].lease_token, 503)], "delivery_id bigint, lease_token string, http_status int")
        out = O.settle(row, answer, at(0)).first()
        assert out.next_attempt_at == T0 + dt.timedelta(seconds=min(3600, 5 * 2 ** (attempts - 1)))
        assert out.status == ("failed" if attempts == 8 else "pending")


def test_repeated_result_settles_once(spark):
    held = deliveries(spark, [(1, 1, 1, "sending", 1, T0, T0)]).withColumn("lease_token", F.lit("t"))
    twice = spark.createDataFrame([(1, "t", 204), (1, "t", 204)], "delivery_id bigint, lease_token string, http_status int")
    assert [r.status for r in O.settle(held, twice, at(0)).collect()] == ["succeeded"]


def test_late_event_is_delivered(spark):
    subs = spark.createDataFrame([(1, 3, 7, '["x"]', True, True)], "webhook_id bigint, organization_id bigint, project_id bigint, event_types_json string, active boolean, valid boolean")
    events = lambda ids, owner=3: spark.createDataFrame([(i, owner, 7, "x") for i in ids], "event_id bigint, organization_id bigint, project_id bigint, event_type string")
    none = deliveries(spark, [])
    one = O.materialize(subs, events([50]), none)
    two = O.materialize(subs, events([20, 50]), one)
    assert [r.event_id for r in two.collect()] == [20]
    assert O.materialize(subs, events([20, 50]), one.unionByName(two)).count() == 0
    assert O.materialize(subs, events([60], owner=4), none).count() == 0


OUTBOX_SUBS = "webhook_id bigint, organization_id bigint, project_id bigint, event_types_json string, active boolean, valid boolean"
OUTBOX_EVENTS = "event_id bigint, organization_id bigint, project_id bigint, event_type string"


def outbox_case(spark):
    rnd = random.Random(5)
    subs = [(w, w % 2, w % 2, '["x","y"]' if w % 3 else '["y"]', True, True) for w in range(12)]
    events = [(e, e % 2, e % 2, "xyz"[e % 3]) for e in range(120)]
    given = sorted({(rnd.randrange(14), rnd.randrange(130)) for _ in range(300)} | {(4, e) for e in range(0, 80, 2)})
    types = {w: ("x", "y") if w % 3 else ("y",) for w in range(12)}
    pairs = sorted({(w, e) for w, *_ in subs for e, o, _, t in events if o == w % 2 and t in types[w]} - set(given))
    return (spark.createDataFrame(subs, OUTBOX_SUBS), spark.createDataFrame(events, OUTBOX_EVENTS),
            spark.createDataFrame(given, "webhook_id bigint, event_id bigint"), pairs)


@pytest.mark.parametrize("tile", [2, 4096])
def test_pending_pairs_are_never_shuffled(spark, monkeypatch, tile):
    monkeypatch.setattr(O, "TILE", tile)
    subs, events, given, pairs = outbox_case(spark)
    pending = O.pending_pairs(subs, events, given).select("webhook_id", "event_id")
    assert sorted(map(tuple, pending.collect())) == pairs
    assert "LeftAnti" not in pending._jdf.queryExecution().optimizedPlan().toString()


def test_first_pending_meets_only_the_first_events(spark, monkeypatch):
    monkeypatch.setattr(O, "RANK_BLOCK", 4)
    subs, events, given, pairs = outbox_case(spark)
    first = [(w, e) for i, (w, e) in enumerate(pairs) if sum(p[0] == w for p in pairs[:i]) < 3]
    assert sorted((r.webhook_id, r.event_id) for r in O.first_pending(subs, events, given, 3).collect()) == first
    assert sorted(map(tuple, O.materialize(subs, events, given, 3).collect())) == first
    none = given.limit(0)
    assert O.first_candidates(subs, events, none, 3).count() == 3 * 20  # 8 webhooks want two types, 4 one


def test_claim_keeps_the_last_error(spark):
    held = deliveries(spark, [(1, 1, 1, "pending", 2, T0, None)]).withColumn("last_error", F.lit("Webhook delivery failed."))
    assert O.claim(held, at(0)).first().last_error == "Webhook delivery failed."


def test_envelope_payload_is_compact(spark):
    event = spark.createDataFrame([(1, "t", 2, 3, T0, '{ "k z": 1,\n "a" : [1, "x \\" y"] }')],
                                  "event_id bigint, event_type string, organization_id bigint, project_id bigint, created_at timestamp_ntz, payload_json string")
    body = O.envelope(event, F.lit("00"), F.lit("1")).first().body
    assert body.endswith('"data":{"k z":1,"a":[1,"x \\" y"]}}')


def test_replay_gives_the_recorded_revision(spark):
    row = lambda seq, e, st, x: (seq, 1, 1, "crm", e, st, x, f"{e}{st}{x}")
    rows = [row(1, "e1", "sold", 0), row(2, "e2", "blocked", 1), row(3, "e1", "sold", 0), row(4, "e1", "blocked", 2)]
    done = {r.seq: (r.outcome, r.revision) for r in A.apply_requests(spark.createDataFrame(rows, REQ), no_units(spark)).collect()}
    assert done == {1: ("applied", 1), 2: ("applied", 2), 3: ("replayed", 1), 4: ("conflict", None)}
    recorded = spark.createDataFrame([(1, "crm", "e1", "e1sold0", 1)], "project_id bigint, system string, event_id string, digest string, revision bigint")
    again = A.apply_requests(spark.createDataFrame([row(9, "e1", "sold", 0)], REQ), spark.createDataFrame([(1, 5)], "unit_id bigint, revision bigint"), recorded).first()
    assert (again.outcome, again.revision) == ("replayed", 1)


def test_streams_read_folders_and_late_rows(spark, tmp_path):
    late = [(i, T0 + dt.timedelta(days=30 - 10 * (i // 250), seconds=i)) for i in range(1000)]
    for part in range(4):
        rows = spark.createDataFrame(late[250 * part:250 * (part + 1)], "k long, ts timestamp")
        events = rows.selectExpr("k as event_id", "cast(ts as timestamp_ntz) as ts", "k % 50 as user_id", "'view' as event_type", "1.0 as value", "'{}' as props")
        events.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = SJ.table_stream(spark, str(tmp_path), "events", 1)
    feed = SJ.audit_feed(spark, stream.select(F.lit("view").alias("action"), F.col("ts").cast("timestamp").alias("created_at")), str(tmp_path / "audit"))
    assert feed.agg(F.sum("events")).first()[0] == 1000
    counts = SJ.rate_minute(spark, stream.select(F.lit(1).cast("long").alias("key_id"), F.col("ts").cast("timestamp").alias("ts")), str(tmp_path / "rate"))
    assert counts.agg(F.sum("requests")).first()[0] == 1000


def test_stalled_jobs(spark):
    old, now = T0, T0 + dt.timedelta(hours=1)
    recent = now - dt.timedelta(seconds=60)
    jobs = spark.createDataFrame([(1, old, old, "running"), (2, recent, recent, "running"), (3, old, old, "running"), (4, old, None, "queued"), (5, old, old, "succeeded")],
                                 "job_id bigint, created_at timestamp_ntz, started_at timestamp_ntz, status string")
    logs = spark.createDataFrame([(3, recent)], "job_id bigint, at timestamp_ntz")
    done = J.stalled_jobs(jobs, logs, F.lit(now).cast("timestamp_ntz"))
    assert {r.job_id for r in done.collect()} == {1, 4}
    assert J.stalled_audit(done).count() == 2


def test_minute_budget(spark):
    rows = [(1, 1, 0), (2, 1, 5), (3, 1, 30), (4, 2, 31), (5, 1, 60)]
    df = spark.createDataFrame([(s, k, T0 + dt.timedelta(seconds=t)) for s, k, t in rows], "seq bigint, key_id bigint, ts timestamp_ntz")
    got = {r.seq: (r.allowed, r.retry_after) for r in M.minute_budget(df, 2).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 30), 4: (True, None), 5: (True, None)}


@pytest.mark.parametrize("pattern, blocked", [("F" * 8 + "F", [8]), ("F" * 7 + "S" + "F" * 8, [])])
def test_sliding_failures_stream(spark, tmp_path, pattern, blocked):
    schema = "key string, seq bigint, ts timestamp_ntz, ok boolean"
    rows = [("k", i, T0 + dt.timedelta(seconds=i), c == "S") for i, c in enumerate(pattern)]
    for i, part in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = SJ.rate_sliding(spark, source, str(tmp_path / "out")).collect()
    assert sorted(r.seq for r in got if r.blocked) == blocked and len(got) == len(rows)


def plain_attempts(rows, limit, window):
    """(blocked, wait) by walking every key's rows."""
    hits, out = {}, {}
    for key, seq, ts, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        live = [h for h in hits.get(key, []) if h > ts - dt.timedelta(seconds=window)]
        blocked = len(live) >= limit
        out[key, seq] = (blocked, max(1, math.ceil((live[0] - ts).total_seconds() + window)) if blocked else None)
        hits[key] = live if blocked else [] if ok else live + [ts]
    return out


def attempt_rows(seed):
    """A key under steady attack, one with bursts and successes, and quiet ones."""
    rnd = random.Random(seed)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("attack", i, at(7 * i + rnd.random()), rnd.random() < 0.1) for i in range(400)]
    t = 0.0
    for i in range(400, 800):
        t += rnd.choice([1, 1, 2, 5, 30, 150])
        rows.append(("bursts", i, at(t), rnd.random() < 0.2))
    return rows + [(f"quiet{i % 7}", i, at(rnd.randrange(20000)), rnd.random() < 0.5) for i in range(800, 900)]


@pytest.mark.parametrize("seed, windows", [(1, 1), (2, 3), (3, 1000)])
def test_attempts_equal_a_walk(spark, seed, windows):
    rows = attempt_rows(seed)
    judged, last = M.password_attempts(spark.createDataFrame(rows, "key string, seq bigint, ts timestamp_ntz, ok boolean"), None, 5, 60, windows)
    got = {(r.key, r.seq): (r.blocked, r.retry_after) for r in judged.collect()}
    assert got == plain_attempts(rows, 5, 60) and sum(b for b, _ in got.values()) > 100
    assert {r.key for r in last.collect()} == {r[0] for r in rows}


def test_attempt_chunks_run_in_many_tasks(spark):
    """One busy key: its chunks lie in different partitions."""
    rows = [("k", i, T0 + dt.timedelta(seconds=20 * i), False) for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    judged, _ = M.password_attempts(spark.createDataFrame(rows, "key string, seq bigint, ts timestamp_ntz, ok boolean"), None, 5, 60, 8)
    assert judged.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_attempt_stream_equals_batch(spark, tmp_path):
    """Twenty batches: past snapshots of the carried state."""
    schema = "key string, seq bigint, ts timestamp_ntz, ok boolean"
    rows = sorted((r for r in attempt_rows(4) if r[0] != "bursts"), key=lambda r: (r[2], r[1]))
    for i in range(20):
        part = rows[i * len(rows) // 20:(i + 1) * len(rows) // 20]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{i:02}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {(r.key, r.seq): (r.blocked, r.retry_after) for r in SJ.rate_sliding(spark, source, str(tmp_path / "out"), 5, 60).collect()}
    assert got == plain_attempts(rows, 5, 60)


def test_pages(spark):
    df = spark.range(3)
    page = lambda offset: [(r.id, r.total, r.next_offset) for r in T.offset_page(df, [F.col("id")], 2, offset).collect()]
    assert page(0) == [(0, 3, 2), (1, 3, 2)] and page(2) == [(2, 3, None)]
    key = T.keyset_page(df, "id", 0, 1).first()
    assert (key.id, key.has_more, key.next_cursor) == (1, True, 1)


def test_workspace_visibility(spark):
    one = lambda row, schema: spark.createDataFrame([row], schema)
    w = T.workspace(
        one((1, 1, "link"), "project_id bigint, organization_id bigint, access_mode string"), one((1, "Org"), "organization_id bigint, name string"),
        one((5, 1, T0, "high", 1509), "version_id bigint, project_id bigint, created_at timestamp_ntz, quality string, lot_count int"),
        one((1, 1, True, True), "link_id bigint, project_id bigint, active boolean, has_password boolean"),
        one((1, 1, "a.pdf", T0), "asset_id bigint, project_id bigint, original_name string, created_at timestamp_ntz"),
        one((1, 1, T0 - dt.timedelta(1), "failed", 10), "job_id bigint, project_id bigint, created_at timestamp_ntz, status string, progress int")).first()
    assert (w.visibility, w.processing_status, w.lots, w.client) == ("password", "processed", 1509, "Org")


def test_chunk_maps_are_composed_as_rows(spark):
    """Starting revisions of many chunks against a walk; no plan or row gathers a unit's maps."""
    import random
    rng = random.Random(9)
    rows, want = [], {}
    for unit in (1, 2, 3):
        now = 4 if unit == 1 else 0
        for chunk in sorted(rng.sample(range(3, 40), 20 if unit < 3 else 1)):
            want[unit, chunk] = now
            ends = {s: s + rng.randint(1, 3) for s in rng.sample(range(now + 6), min(4, now + 6))}
            rows += [(unit, chunk, s, e) for s, e in ends.items()]
            now = ends.get(now, now)
    maps = spark.createDataFrame(rows, "unit_id long, chunk long, start long, final long")
    units = spark.createDataFrame([(1, 4)], "unit_id long, revision long")
    found = A._chunk_starts(maps, units)
    assert {(r.unit_id, r.chunk): r.revision_in for r in found.collect()} == want
    assert A._chunk_starts(maps.where("false"), units).count() == 0


UNITS = "unit_id bigint, project_id bigint, external_system string, external_unit_id string, status string, revision bigint"
LOTS = "lot_id bigint, project_id bigint, status string"


def test_external_system_and_side_effects(spark):
    """The unit's own system names the event id; events carry the status before; lots of each link follow, those of other projects do not."""
    units = spark.createDataFrame([(1, 1, "erp9", "A-1", "reserved", 4), (2, 1, None, None, "available", 0)], UNITS)
    raw = [(1, 1, 1, "crm", "e1", "sold", 4), (2, 1, 1, "shop", "e1", "sold", 4), (3, 1, 2, "crm", "e1", "blocked", 0), (4, 1, 1, "crm", "e2", "available", 5),
           (5, 1, 2, "crm", "e2", "sold", 0)]
    rows = spark.createDataFrame(raw, "seq bigint, project_id bigint, unit_id bigint, source string, event_id string, status string, expected_revision bigint")
    named = A.with_system(rows, units)
    assert [r.system for r in named.orderBy("seq").collect()] == ["erp9", "erp9", "crm", "erp9", "crm"]
    done = A.apply_requests(named.withColumn("digest", F.concat_ws("/", "unit_id", "status", "source")), units)
    assert [r.outcome for r in done.orderBy("seq").collect()] == ["applied", "conflict", "applied", "applied", "stale"]
    changes = done.where("outcome = 'applied'").select("seq", "unit_id", "event_id", "status", "revision")
    events = A.with_previous_status(changes, units).withColumns({"source": F.lit("crm"), "ts": F.lit(T0)})
    told = {r.seq: (r.previous_status, r.status, r.revision, r.payload_json) for r in A.event_payload(events).collect()}
    assert {k: v[:3] for k, v in told.items()} == {1: ("reserved", "sold", 5), 3: ("available", "blocked", 1), 4: ("sold", "available", 6)}
    assert '"external_system":"erp9","external_unit_id":"A-1"' in told[1][3] and '"external_system":null' in told[3][3]
    assert {(r.unit_id, r.status, r.revision) for r in A.units_after(units, changes).collect()} == {(1, "available", 6), (2, "blocked", 1)}
    lots = spark.createDataFrame([(10, 1, "reserved"), (11, 1, "reserved"), (12, 2, "reserved"), (13, 1, "sold"), (14, 1, "retired")], LOTS)
    links = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 13)], "unit_id bigint, lot_id bigint")
    after = {r.lot_id: r.status for r in A.lots_after(lots, links, units, changes).collect()}
    assert after == {10: "available", 11: "available", 12: "reserved", 13: "blocked", 14: "retired"}


def test_batch_status_goes_through_the_units(spark):
    units = spark.createDataFrame([(1, 1, None, None, "available", 3), (2, 2, None, None, "available", 0)], UNITS)
    lots = spark.createDataFrame([(10, 1, "available"), (11, 1, "available"), (12, 1, "sold"), (13, 1, "sold")], LOTS)
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "unit_id bigint, lot_id bigint")
    edits = spark.createDataFrame([(1, 10, "sold"), (1, 11, "sold"), (2, 10, "sold"), (3, 11, "blocked"), (1, 13, "sold"), (2, 13, "available"), (1, 12, "blocked")],
                                  "batch bigint, lot_id bigint, status string")
    got = {(r.batch, r.lot_id): (r.unit, r.previous_status, r.changed, r.revision) for r in A.lot_edits(edits, lots, links, units, ["batch", "lot_id"]).collect()}
    assert got == {(1, 10): ("1", "available", True, 4), (1, 11): ("1", "sold", False, None), (2, 10): ("1", "sold", False, None), (3, 11): ("1", "sold", True, 5),
                   (1, 13): ("lot-13", "sold", False, None), (2, 13): ("lot-13", "sold", True, 1), (1, 12): (None, None, False, None)}


def test_a_busy_unit_is_edited_in_order(spark):
    rng = random.Random(12)
    rows = [(s, 10, rng.choice(["sold", "reserved", "available"])) for s in rng.sample(range(10**12), 1500)]
    units = spark.createDataFrame([(1, 1, None, None, "available", 0)], UNITS)
    lots, links = spark.createDataFrame([(10, 1, "available")], LOTS), spark.createDataFrame([(1, 10)], "unit_id bigint, lot_id bigint")
    done = A.lot_edits(spark.createDataFrame(rows, "seq bigint, lot_id bigint, status string").repartition(7), lots, links, units, ["seq"])
    status, revision, want = "available", 0, {}
    for seq, _, new in sorted(rows):
        revision += new != status
        want[seq] = (status, new != status, revision if new != status else None)
        status = new
    assert {r.seq: (r.previous_status, r.changed, r.revision) for r in done.collect()} == want


def test_rows_for_one_user(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "project_id bigint, organization_id bigint")
    mine = lambda *m: spark.createDataFrame(list(m), "user_id bigint, organization_id bigint, role string, platform_role string")
    seen = lambda m, role=None: sorted(r.project_id for r in T.rows_for_user(rows, m, role).collect())
    member = mine((7, 1, "client_admin", "none"), (7, 2, "client_member", "none"))
    assert seen(member) == [1, 2] and seen(member, "client_admin") == [1]
    assert seen(mine((8, 1, "client_member", "operator"))) == [1, 2, 3] and seen(member.where("false")) == []


def test_rounds_of_applying_broadcast_nothing(spark, monkeypatch):
    """Every round joins small tables; none of them may go through the driver, with or without units of several chunks."""
    rows = random_requests(120, 5)
    store = spark._jsparkSession.sharedState().statusStore()
    for chunk in (10, 1000):
        monkeypatch.setattr(A, "CHUNK_ROWS", chunk)
        before = store.executionsCount()
        done = A.apply_requests(spark.createDataFrame(rows, REQ), no_units(spark))
        assert {r.seq: r.outcome for r in done.collect()} == sequential(rows)
        runs = store.executionsList()
        plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
        assert len(plans) > 5 and not [p for p in plans if "BroadcastExchange" in p]


def test_outbox_stream_shuffles_no_pairs(spark, tmp_path):
    """An event id that comes twice, or with two types that a webhook wants, is delivered once; pairs are told apart only for the latter."""
    subs, events, given, pairs = outbox_case(spark)
    given, store = given.limit(0), spark._jsparkSession.sharedState().statusStore()

    def run(name, rows):
        rows.coalesce(1).write.parquet(str(tmp_path / name / "in"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / name / "in"))
        before = store.executionsCount()
        got = sorted(map(tuple, SJ.outbox(spark, source, subs, given, str(tmp_path / name / "out")).collect()))
        runs = store.executionsList()
        plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
        return got, [p for p in plans if re.search(r"hashpartitioning\(webhook_id#\d+L, event_id#", p)]

    once, shuffled = run("twice", events.unionByName(events))
    assert once == sorted({(w, e) for w, e in pairs} | {tuple(r) for r in O.pending_pairs(subs, events, given).select("webhook_id", "event_id").collect()}) and not shuffled
    both = events.unionByName(events.withColumn("event_type", F.when(F.col("event_type") == "x", "y").otherwise("x")))
    keyed, _ = run("keyed", both)
    assert len(keyed) == len(set(keyed)) and set(once) < set(keyed)
