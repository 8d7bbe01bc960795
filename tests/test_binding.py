"""Bind requests against a walk in order."""

import random

import pytest

from parcelflow.operators import identity as I

REQ = "seq bigint, project_id bigint, system string, external_unit_id string, lot_id bigint"
LOTS = "lot_id bigint, project_id bigint, version_id bigint, status string"
UNITS = "unit_id bigint, project_id bigint, external_system string, external_unit_id string, status string, revision int, mapping_state string"
BRIDGE = "lot_id bigint, unit_id bigint, version_id bigint"


def walk(requests, lots, units, bridge):
    lot = {r[0]: r for r in lots}
    unit = {r[0]: dict(ref=(r[1], r[2], r[3]) if r[2] else None, status=r[4], fresh=r[5] == 0 and r[6] == "needs_reconciliation", links={v: x for x, u, v in bridge if u == r[0]}, id=r[0]) for r in units}
    link = {x: unit[u] for x, u, _ in bridge}
    named = {u["ref"]: u for u in unit.values() if u["ref"]}
    out = {}
    for seq, project, system, ext, i in sorted(requests):
        ref = (project, system, ext)
        if i not in lot or lot[i][1] != project:
            out[seq] = "not_found"
            continue
        version, status = lot[i][2:]
        own, other = link.get(i), named.get(ref)
        if own and other and own is not other:
            if own["ref"] or not own["fresh"] or len(own["links"]) != 1 or (own["status"] in ("sold", "reserved") and other["status"] != own["status"]):
                out[seq] = "conflict_lot_bound"
            elif other["links"].get(version, i) != i:
                out[seq] = "conflict_version"
            else:
                out[seq] = "absorb"
                other["links"][version] = i
                link[i] = other
        elif own:
            if own["ref"] and own["ref"] != ref:
                out[seq] = "conflict_reference"
            else:
                out[seq] = "reuse"
                own["ref"] = ref
                named[ref] = own
        elif other:
            if other["links"].get(version, i) != i:
                out[seq] = "conflict_version"
            else:
                out[seq] = "reuse"
                other["links"][version] = i
                link[i] = other
        else:
            out[seq] = "create"
            named[ref] = link[i] = dict(ref=ref, status=status, fresh=False, links={version: i}, id=None)
    return out


def run(spark, requests, lots, units, bridge):
    frames = [spark.createDataFrame(rows, kind) for rows, kind in zip((requests, lots, units, bridge), (REQ, LOTS, UNITS, BRIDGE))]
    rows = I.bind_plan(*frames).collect()
    assert len(rows) == len(requests)
    return {r.seq: r.outcome for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_walk(spark, seed):
    rnd = random.Random(seed)
    states = ["available", "sold", "reserved", "blocked"]
    lots = [(i, i % 2, 10 * (i % 2) + rnd.randrange(3), rnd.choice(states)) for i in range(60)]
    units, bridge = [], []
    for u in range(0, 24):
        project = u % 2
        named = rnd.random() < 0.4
        units.append((u, project, "crm" if named else None, f"R{u}" if named else None, rnd.choice(states), rnd.choice([0, 0, 1]), rnd.choice(["needs_reconciliation"] * 2 + ["mapped"])))
        taken = set()
        for x in rnd.sample([r for r in lots if r[1] == project], 2):
            if x[2] not in taken and x[0] not in {b[0] for b in bridge} and (not taken or rnd.random() < 0.4):
                bridge.append((x[0], u, x[2]))
                taken.add(x[2])
    requests = []
    for seq in rnd.sample(range(1000), 260):
        project = rnd.randrange(2)
        requests.append((seq, project, rnd.choice(["crm", "crm", "crm", "erp"]), f"R{rnd.randrange(30)}", rnd.randrange(64)))
    got = run(spark, requests, lots, units, bridge)
    want = walk(requests, lots, units, bridge)
    assert got == want and len(set(want.values())) >= 6


def test_busy_reference_and_busy_lot(spark):
    """Hundreds of requests for one reference, then for one lot."""
    lots = [(i, 1, 1 + i % 3, "available") for i in range(300)]
    requests = [(i, 1, "crm", "A", i) for i in range(300)] + [(1000 + i, 1, "crm", f"B{i}", 299) for i in range(300)]
    got = run(spark, requests, lots, [], [])
    assert got == walk(requests, lots, [], [])
    assert [got[i] for i in range(4)] == ["create", "reuse", "reuse", "conflict_version"] and got[1000] == "create" and got[1299] == "conflict_reference"


def test_chain_of_shared_lots_and_references(spark):
    lots = [(i, 1, 1, "available") for i in range(12)]
    requests = [(2 * i + j, 1, "crm", f"A{i + j}", i) for i in range(12) for j in range(2)]
    assert run(spark, requests, lots, [], []) == walk(requests, lots, [], [])


def test_no_requests(spark):
    assert run(spark, [], [(1, 1, 1, "sold")], [], []) == {}
