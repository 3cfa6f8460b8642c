"""Command batches against a step-by-step simulation of the same commands."""

import random
from datetime import datetime, timedelta

import pytest

from fleetlens import schemas
from fleetlens.operators import kept_counts, location_changes, skew
from fleetlens.operators.loan_changes import (
    DUE_TOO_EARLY,
    MISSING_CHECKOUT,
    MISSING_FIELDS,
    NOT_AVAILABLE,
    NOT_OUT,
    UNKNOWN_COMMAND,
    apply_loan_commands,
)
from fleetlens.operators.location_changes import (
    EXISTS,
    IN_USE,
    NOT_FOUND,
    NOTHING_GIVEN,
    apply_location_changes,
)
from fleetlens.operators.toggles import toggle_loaner
from fleetlens.sources.storage import stored

START = datetime(2024, 1, 1)
FIELDS = schemas.LOCATION_FIELDS


def inventory(spark, rows):
    """rows: (inventory_id, asset_tag, is_loaner, location_id)"""
    full = [
        {f.name: None for f in schemas.INVENTORY} | dict(inventory_id=i, asset_tag=t, is_loaner=l, location_id=p)
        for i, t, l, p in rows
    ]
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.INVENTORY) for r in full], schemas.INVENTORY)


# --- loans ---------------------------------------------------------------------------------------


def simulate_loans(inv, loans, cmds):
    tags = {i: t for i, t, _l, _p in inv}
    flags = {i: l for i, _t, l, _p in inv}
    stored = {l[0] for l in loans}
    state = [dict(zip(schemas.LOANER_CHECKOUTS.fieldNames(), l)) for l in loans]
    fresh, audit, rejected = [], [], {}
    for c in sorted(cmds, key=lambda c: (c[1], c[0])):
        cid, ts, kind, device, loan, user, due, notes = c
        if kind not in ("CHECKOUT", "CHECKIN"):
            rejected[cid] = UNKNOWN_COMMAND
            continue
        if kind == "CHECKOUT":
            if not device or not user:
                rejected[cid] = MISSING_FIELDS
            elif not flags.get(device) or any(l["inventory_id"] == device and l["checkin_date"] is None for l in state):
                rejected[cid] = NOT_AVAILABLE
            else:
                row = dict(
                    checkout_id=None, inventory_id=device, user_name=user, checkout_date=ts,
                    expected_return_date=due, checkin_date=None, checkout_notes=notes,
                )
                fresh.append(row)
                state.append(row)
                audit.append(("CHECKOUT", tags[device], "available", "checked out", user, ts))
            continue
        if loan:
            hits = [l for l in state if l["checkout_id"] == loan and loan in stored and l["checkin_date"] is None and l["inventory_id"] in tags]
        elif device:
            hits = [l for l in state if l["inventory_id"] == device and l["checkin_date"] is None and device in tags]
        else:
            rejected[cid] = MISSING_CHECKOUT
            continue
        if not hits:
            rejected[cid] = NOT_OUT
        for l in hits:
            l["checkin_date"] = ts
            audit.append(("CHECKIN", tags[l["inventory_id"]], "checked out", "available", l["user_name"], ts))
    for n, row in enumerate(fresh):
        row["checkout_id"] = max(stored, default=0) + 1 + n
    return [tuple(l.values()) for l in state], audit, rejected


def random_loans(seed, devices=25, commands=700):
    rng = random.Random(seed)
    inv = [(i, f"T{i}", rng.random() < 0.85, None) for i in range(1, devices + 1)]
    loans, n = [], 0
    for i in range(1, devices + 3):
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            n += 1
            back = rng.choice([None, None, START - timedelta(days=1)])
            loans.append((n, i, f"old{n}", START - timedelta(days=9), None, back, None))
    cmds = []
    for c in range(commands):
        # one device gets a third of all commands
        device = 3 if rng.random() < 0.33 else rng.randint(1, devices + 4)
        kind = rng.choice(["CHECKOUT", "CHECKIN", "CHECKOUT", "CHECKIN", "CHECKIN", "RETURN" if rng.random() < 0.1 else "CHECKOUT"])
        loan = rng.randint(1, n + 20) if kind == "CHECKIN" and rng.random() < 0.3 else None
        if loan and rng.random() < 0.5:
            device = None
        user = None if rng.random() < 0.05 else f"u{c}"
        if rng.random() < 0.02:
            device, loan = None, None
        ts = START + timedelta(minutes=rng.randint(0, 400))
        cmds.append((c, ts, kind, device, loan, user, ts + timedelta(days=3), rng.choice([None, "n"])))
    return inv, loans, cmds


def run_loans(spark, inv, loans, cmds, **kw):
    frames = (
        inventory(spark, inv),
        spark.createDataFrame(loans, schemas.LOANER_CHECKOUTS),
        spark.createDataFrame(cmds, schemas.LOAN_COMMANDS),
    )
    return apply_loan_commands(*frames, **kw)


@pytest.fixture(params=["broadcast", "shares"])
def join_kind(request, monkeypatch):
    """Run with small sides broadcast, and with hot keys cut into shares as beyond the size limit."""
    if request.param == "shares":
        monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)


def test_loan_batches(spark, join_kind, request):
    inv, loans, cmds = random_loans(1 if "shares" in request.node.name else 2)
    new, audit, rejected = run_loans(spark, inv, loans, cmds)
    want_loans, want_audit, want_rejected = simulate_loans(inv, loans, cmds)
    assert {r.command_id: r.reason for r in rejected.collect()} == want_rejected
    assert sorted(map(repr, map(tuple, new.collect()))) == sorted(map(repr, want_loans))
    got = [(r.action_type, r.asset_tag, r.old_value, r.new_value, r.changed_by, r.changed_at) for r in audit.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want_audit))
    assert len(want_rejected) + len(want_audit) > 0


def test_one_batch_equals_two(spark):
    inv, loans, cmds = random_loans(9)
    cmds = [c for c in cmds if c[4] is None]
    cmds.sort(key=lambda c: (c[1], c[0]))
    whole, audit, rejected = run_loans(spark, inv, loans, cmds)
    half = len(cmds) // 2
    first, audit1, rejected1 = run_loans(spark, inv, loans, cmds[:half])
    second, audit2, rejected2 = apply_loan_commands(
        inventory(spark, inv), first, spark.createDataFrame(cmds[half:], schemas.LOAN_COMMANDS)
    )
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, second.collect()))
    assert audit.count() == audit1.count() + audit2.count()
    assert rejected.count() == rejected1.count() + rejected2.count()


def with_handles(cmds):
    """Half of the check-ins name a loan by the command that makes it, mostly one of the same device."""
    rng = random.Random(3)
    outs = {}
    for c in cmds:
        if c[2] == "CHECKOUT" and c[3]:
            outs.setdefault(c[3], []).append(c[0])
    every, named = [i for ids in outs.values() for i in ids], []
    for c in cmds:
        if c[2] == "CHECKIN" and c[4] is None and c[3] and rng.random() < 0.6:
            c = (*c[:3], None, rng.choice(outs.get(c[3], every) if rng.random() < 0.9 else every), *c[5:])
        named.append(c)
    return named


def simulate_handles(inv, loans, cmds):
    tags, flags = {i: t for i, t, _l, _p in inv}, {i: l for i, _t, l, _p in inv}
    state, rejected = [dict(zip(schemas.LOANER_CHECKOUTS.fieldNames(), l)) for l in loans], {}
    for cid, ts, kind, device, loan, user, due, notes in sorted(cmds, key=lambda c: (c[1], c[0])):
        away = [l for l in state if l["checkin_date"] is None and l["inventory_id"] in tags]
        if kind == "CHECKOUT":
            if not device or not user:
                rejected[cid] = MISSING_FIELDS
            elif not flags.get(device) or any(l["inventory_id"] == device for l in away):
                rejected[cid] = NOT_AVAILABLE
            else:
                state.append(dict(zip(schemas.LOANER_CHECKOUTS.fieldNames(), (cid, device, user, ts, due, None, notes))))
            continue
        if not loan and not device:
            rejected[cid] = MISSING_CHECKOUT
            continue
        hits = [l for l in away if (l["checkout_id"] == loan if loan else l["inventory_id"] == device)]
        if not hits:
            rejected[cid] = NOT_OUT
        for l in hits:
            l["checkin_date"] = ts
    return [tuple(l.values()) for l in state], rejected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_loans_named_by_their_commands(spark, seed):
    """One by one, as one batch, and cut into three batches anywhere: always the same."""
    inv, loans, cmds = random_loans(seed)
    shift = 100_000
    cmds = with_handles([(c[0] + shift, *c[1:]) for c in cmds if c[2] in ("CHECKOUT", "CHECKIN")])
    want, want_rejected = simulate_handles(inv, loans, cmds)
    new, _, rejected = run_loans(spark, inv, loans, cmds, ids_from_commands=True)
    assert {r.command_id: r.reason for r in rejected.collect()} == want_rejected
    assert sorted(map(repr, map(tuple, new.collect()))) == sorted(map(repr, want))
    assert sum(c[4] is not None and c[4] > shift and c[0] not in want_rejected for c in cmds) > 3
    if seed == 1:
        cmds.sort(key=lambda c: (c[1], c[0]))
        state, refused = spark.createDataFrame(loans, schemas.LOANER_CHECKOUTS), {}
        for a, b in ((0, len(cmds) // 3), (len(cmds) // 3, len(cmds) // 2), (len(cmds) // 2, len(cmds))):
            some = spark.createDataFrame(cmds[a:b], schemas.LOAN_COMMANDS)
            state, _, rejected = apply_loan_commands(inventory(spark, inv), stored(state), some, ids_from_commands=True)
            refused |= {r.command_id: r.reason for r in rejected.collect()}
        assert refused == want_rejected
        assert sorted(map(repr, map(tuple, state.collect()))) == sorted(map(repr, want))


def test_command_order_of_one_device(spark):
    inv = [(1, "T1", True, None)]
    kinds = ["CHECKOUT", "CHECKOUT", "CHECKIN", "CHECKIN", "CHECKOUT"]
    cmds = [(n, START + timedelta(hours=n), k, 1, None, "u", None, None) for n, k in enumerate(kinds)]
    new, _, rejected = run_loans(spark, inv, [], cmds)
    assert sorted(r.command_id for r in rejected.collect()) == [1, 3]
    assert sorted((r.checkout_id, r.checkin_date) for r in new.collect() if r.checkin_date) == [(1, START + timedelta(hours=2))]
    assert new.where("checkin_date IS NULL").count() == 1


def test_due_date_is_checked_on_request(spark):
    inv = [(1, "T1", True, None), (2, "T2", True, None), (3, "T3", True, None)]
    noon = START + timedelta(hours=12)
    cmds = [
        (1, noon, "CHECKOUT", 1, None, "u", START, None),
        (2, noon, "CHECKOUT", 2, None, "u", START - timedelta(seconds=1), None),
        (3, noon, "CHECKOUT", 3, None, "u", None, None),
    ]
    rejected = run_loans(spark, inv, [], cmds, require_due=True)[2]
    assert {r.command_id: r.reason for r in rejected.collect()} == {2: DUE_TOO_EARLY, 3: DUE_TOO_EARLY}
    assert run_loans(spark, inv, [], cmds)[2].count() == 0


# --- locations -----------------------------------------------------------------------------------


def simulate_locations(locs, used, cmds, ids_from_commands=False):
    state = {l[0]: dict(zip(FIELDS, l[1:])) for l in locs}
    start = max(state, default=0) + 1
    names, created, audit, rejected = {}, [], [], {}

    def holder(site, room, but=None):
        return any(k != but and (v["site_name"], v["room_number"]) == (site, room) for k, v in state.items())

    for c in sorted(cmds, key=lambda c: (c["command_ts"], c["command_id"])):
        cid, ts, by = c["command_id"], c["command_ts"], c["changed_by"] or "system"
        values = {f: c[f] for f in FIELDS if f in (c["given"] or [])}
        if c["kind"] == "CREATE":
            lacking = [f for f in FIELDS if not values.get(f)]
            if lacking:
                rejected[cid] = f"Missing required field: {lacking[0]}"
            elif holder(values["site_name"], values["room_number"]):
                rejected[cid] = EXISTS
            else:
                key = cid if ids_from_commands else start + len(created)
                created.append(key)
                state[key] = dict(values)
                audit.append(("CREATE", f"LOC_{key}", "location", None, f"{values['site_name']} - {values['room_number']}", by, ts))
        elif c["kind"] in ("UPDATE", "DELETE") and (
            c["location_id"] not in state or (c["location_id"] >= start and not ids_from_commands)
        ):
            rejected[cid] = NOT_FOUND
        elif c["kind"] == "UPDATE":
            old = state[c["location_id"]]
            nulls = [f for f in FIELDS if f in values and values[f] is None]
            new = old | values
            if not values:
                rejected[cid] = NOTHING_GIVEN
            elif nulls:
                rejected[cid] = f"Field must not be NULL: {nulls[0]}"
            elif holder(new["site_name"], new["room_number"], c["location_id"]):
                rejected[cid] = EXISTS
            else:
                for f in FIELDS:
                    if f in values and values[f] != old[f]:
                        audit.append(("UPDATE", f"LOC_{c['location_id']}", f, old[f], values[f], by, ts))
                state[c["location_id"]] = new
        elif c["kind"] == "DELETE":
            old = state[c["location_id"]]
            if c["location_id"] in used:
                rejected[cid] = IN_USE
            else:
                audit.append(("DELETE", f"LOC_{c['location_id']}", "location", f"{old['site_name']} - {old['room_number']}", None, by, ts))
                del state[c["location_id"]]
        else:
            rejected[cid] = "Unknown command"
    return [(k, *[v[f] for f in FIELDS]) for k, v in state.items()], audit, rejected


def random_locations(seed, rooms=6, commands=150):
    rng = random.Random(seed)
    spots = [(f"S{s}", f"R{r}") for s in range(3) for r in range(rooms)]
    locs = [(n + 1, s, r, f"name{n}", "Other") for n, (s, r) in enumerate(rng.sample(spots, 9))]
    used = {1, 2, 3, 4, 5}
    cmds = []
    for c in range(commands):
        kind = rng.choice(["CREATE", "UPDATE", "UPDATE", "UPDATE", "DELETE"] + ["MOVE"] * (rng.random() < 0.05))
        given = [f for f in FIELDS if rng.random() < (0.95 if kind == "CREATE" else 0.4)]
        # one room and one location are fought over
        site, room = ("S0", "R0") if rng.random() < 0.33 else rng.choice(spots)
        cmds.append(
            dict(
                command_id=c,
                command_ts=START + timedelta(minutes=rng.randint(0, 200)),
                kind=kind,
                location_id=None if kind == "CREATE" else (1 if rng.random() < 0.33 else rng.randint(1, 11)),
                site_name=site if rng.random() < 0.97 else None,
                room_number=room,
                room_name=rng.choice(["x", "y", "z", ""]),
                room_type=rng.choice(["Storage", "Other"]),
                given=given if rng.random() < 0.97 else None,
                changed_by=rng.choice([None, "ann"]),
            )
        )
    return locs, used, cmds


def test_location_batches(spark, join_kind, request):
    locs, used, cmds = random_locations(1 if "shares" in request.node.name else 2)
    names = schemas.LOCATION_COMMANDS.fieldNames()
    new, audit, rejected = apply_location_changes(
        spark.createDataFrame(locs, schemas.LOCATIONS),
        inventory(spark, [(i, f"T{i}", False, i) for i in used]),
        spark.createDataFrame([tuple(c[n] for n in names) for c in cmds], schemas.LOCATION_COMMANDS),
    )
    want, want_audit, want_rejected = simulate_locations(locs, used, cmds)
    assert {r.command_id: r.reason for r in rejected.collect()} == want_rejected
    assert sorted(map(tuple, new.collect())) == sorted(want)
    got = [(r.action_type, r.asset_tag, r.field_name, r.old_value, r.new_value, r.changed_by, r.changed_at) for r in audit.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want_audit))
    assert EXISTS in want_rejected.values() and len(want_audit) > 20


def run_locations(spark, locs, used, cmds, **more):
    names = schemas.LOCATION_COMMANDS.fieldNames()
    new, audit, rejected = apply_location_changes(
        spark.createDataFrame(locs, schemas.LOCATIONS),
        inventory(spark, [(i, f"T{i}", False, i) for i in used]),
        spark.createDataFrame([tuple(c[n] for n in names) for c in cmds], schemas.LOCATION_COMMANDS),
        **more,
    )
    log = [(r.action_type, r.asset_tag, r.field_name, r.old_value, r.new_value, r.changed_by, r.changed_at) for r in audit.collect()]
    return sorted(map(tuple, new.collect())), sorted(map(repr, log)), {r.command_id: r.reason for r in rejected.collect()}


def expect_locations(*args, **more):
    new, log, rejected = simulate_locations(*args, **more)
    return sorted(new), sorted(map(repr, log)), rejected


def named_by_command(seed, commands=220):
    """Random commands, most of which name a location by the command that makes it, or one that does not."""
    locs, used, cmds = random_locations(seed, commands=commands)
    rng = random.Random(seed)
    cmds.sort(key=lambda c: (c["command_ts"], c["command_id"]))
    for at, c in enumerate(cmds):
        c["command_id"] += 1000
        if rng.random() < 0.3:
            c["kind"] = "CREATE"
            c["given"] = list(FIELDS) if rng.random() < 0.9 else c["given"]
    makers = [c["command_id"] for c in cmds if c["kind"] == "CREATE"]
    for at, c in enumerate(cmds):
        if c["kind"] != "CREATE" and rng.random() < 0.75:
            earlier = [m["command_id"] for m in cmds[max(0, at - 12) : at] if m["kind"] == "CREATE"]
            c["location_id"] = rng.choice(earlier or makers) if rng.random() < 0.8 else rng.choice([m["command_id"] for m in cmds])
        elif c["kind"] == "CREATE" and rng.random() < 0.1:
            c["location_id"] = rng.choice(makers)
    return locs, used, cmds


def test_rooms_named_by_their_commands(spark, join_kind, request):
    locs, used, cmds = named_by_command(3 if "shares" in request.node.name else 4)
    want = expect_locations(locs, used, cmds, ids_from_commands=True)
    assert run_locations(spark, locs, used, cmds, ids_from_commands=True) == want
    named = {c["command_id"] for c in cmds if (c["location_id"] or 0) >= 1000 and c["kind"] != "CREATE"}
    assert len(named - set(want[2])) > 5 and len(named & set(want[2])) > 5


def test_a_log_cut_in_two_gives_the_same_rooms(spark, cut=90):
    locs, used, cmds = named_by_command(5)
    locs_between, log, rejected = run_locations(spark, locs, used, cmds[:cut], ids_from_commands=True)
    after, more_log, more_rejected = run_locations(spark, locs_between, used, cmds[cut:], ids_from_commands=True)
    assert (after, sorted(log + more_log), rejected | more_rejected) == run_locations(spark, locs, used, cmds, ids_from_commands=True)


def test_one_room_made_changed_moved_and_removed(spark):
    def cmd(n, kind, location_id=None, **values):
        values = {"site_name": None, "room_number": None, "room_name": None, "room_type": None} | values
        return dict(command_id=n, command_ts=START + timedelta(minutes=n), kind=kind, location_id=location_id, given=[f for f in values if values[f]], changed_by="ann", **values)

    full = {"site_name": "S", "room_number": "R", "room_name": "x", "room_type": "Other"}
    cmds = [
        cmd(101, "UPDATE", 102, room_name="too early"), cmd(102, "CREATE", **full), cmd(103, "UPDATE", 102, room_name="y"),
        cmd(104, "CREATE", **full), cmd(105, "UPDATE", 104, room_name="of a refused room"), cmd(106, "UPDATE", 104, site_name="T"),
        cmd(107, "UPDATE", 102, room_number="R2"), cmd(108, "CREATE", **full), cmd(109, "DELETE", 102), cmd(110, "DELETE", 102),
        cmd(111, "UPDATE", 108, room_number="R2"), cmd(112, "DELETE", 104),
    ]
    new, log, rejected = run_locations(spark, [(1, "A", "B", "x", "Other")], {1}, cmds, ids_from_commands=True)
    assert new == [(1, "A", "B", "x", "Other"), (108, "S", "R2", "x", "Other")]
    assert rejected == {101: NOT_FOUND, 104: EXISTS, 105: NOT_FOUND, 106: NOT_FOUND, 110: NOT_FOUND, 112: NOT_FOUND}
    assert (new, log, rejected) == expect_locations([(1, "A", "B", "x", "Other")], {1}, cmds, ids_from_commands=True)


def count_passes(monkeypatch):
    passes, inner = [], location_changes._winners
    monkeypatch.setattr(location_changes, "_winners", lambda *a: passes.append(1) or inner(*a))
    return passes


def test_chain_of_new_rooms(spark, monkeypatch, chain=512):
    """Rooms are made and then all move one door down; the last door is taken, then empties for a second try."""
    locs = [(1, "S", "R0", "x", "Other"), (2, "T", "R0", "x", "Other")]
    base = dict(site_name=None, room_number=None, room_name=None, room_type=None, changed_by="ann", location_id=None)
    cmds, clock = [], 1000
    for n in range(1, chain + 1):
        clock += 1
        cmds.append(base | dict(command_id=clock, kind="CREATE", site_name="S", room_number=f"R{n}", room_name="x", room_type="Other", given=FIELDS))
    for turn in range(2):
        for n in range(1, chain + 1):
            clock += 1
            cmds.append(base | dict(command_id=clock, kind="UPDATE", location_id=1000 + n, room_number=f"R{n - 1}", given=["room_number"]))
        if turn == 0:
            clock += 1
            cmds.append(base | dict(command_id=clock, kind="DELETE", location_id=1, given=[]))
    for c in cmds:
        c["command_ts"] = START + timedelta(minutes=c["command_id"])
    passes = count_passes(monkeypatch)
    got = run_locations(spark, locs, {2}, cmds, ids_from_commands=True)
    assert got == expect_locations(locs, {2}, cmds, ids_from_commands=True)
    assert len(got[2]) == chain and len(passes) <= chain.bit_length() + 1


def test_one_room_changes_hands_many_times(spark, monkeypatch):
    """Every move waits for the one before it; the passes must not grow with their number."""
    locs = [(n, f"S{n}", "R0", "x", "Other") for n in range(1, 31)]
    cmds, clock = [], 0
    for turn in range(150):
        for site in ("HOT", f"S{turn % 30 + 1}") if turn % 3 else ("HOT",):
            clock += 1
            cmds.append(
                dict(
                    command_id=clock, command_ts=START + timedelta(minutes=clock), kind="UPDATE",
                    location_id=turn % 30 + 1, site_name=site, room_number="R0", room_name=None, room_type=None,
                    given=["site_name", "room_number"], changed_by="ann",
                )
            )
    passes = count_passes(monkeypatch)
    names = schemas.LOCATION_COMMANDS.fieldNames()
    new, audit, rejected = apply_location_changes(
        spark.createDataFrame(locs, schemas.LOCATIONS),
        inventory(spark, [(1, "T", False, 1)]),
        spark.createDataFrame([tuple(c[n] for n in names) for c in cmds], schemas.LOCATION_COMMANDS),
    )
    want, want_audit, want_rejected = simulate_locations(locs, {1}, cmds)
    assert {r.command_id: r.reason for r in rejected.collect()} == want_rejected
    assert sorted(map(tuple, new.collect())) == sorted(want)
    assert audit.count() == len(want_audit)
    assert len(want_rejected) > 100
    assert len(passes) < 12


@pytest.mark.parametrize("chain", [64, 512])
def test_chain_of_refused_moves(spark, monkeypatch, chain):
    """Everyone moves one door down, and the last door is taken: all stay, found out in a few passes."""
    locs = [(n, "S", f"R{n}", "x", "Other") for n in range(1, chain + 2)]
    cmds = [
        dict(
            command_id=clock, command_ts=START + timedelta(minutes=clock), kind="UPDATE", location_id=chain + 1 - clock,
            site_name=None, room_number=f"R{chain + 2 - clock}", room_name=None, room_type=None, given=["room_number"], changed_by="ann",
        )
        for clock in range(1, chain + 1)
    ]
    passes = count_passes(monkeypatch)
    names = schemas.LOCATION_COMMANDS.fieldNames()
    new, _, rejected = apply_location_changes(
        spark.createDataFrame(locs, schemas.LOCATIONS),
        inventory(spark, [(1, "T", False, 1)]),
        spark.createDataFrame([tuple(c[n] for n in names) for c in cmds], schemas.LOCATION_COMMANDS),
    )
    assert {r.command_id: r.reason for r in rejected.collect()} == dict.fromkeys(range(1, chain + 1), EXISTS)
    assert sorted(map(tuple, new.collect())) == sorted(locs)
    assert len(passes) <= 4


def test_later_passes_follow_only_what_changed(spark, monkeypatch):
    """Two hundred locations move to free rooms; of two others one is refused, and so the next one is, too."""
    locs = [(n, "S", f"R{n}", "x", "Other") for n in range(1, 204)]
    base = dict(kind="UPDATE", site_name=None, room_name=None, room_type=None, given=["room_number"], changed_by="ann")
    wants = {**{n: f"N{n}" for n in range(1, 201)}, 201: "R202", 203: "R201"}
    cmds = [base | dict(command_id=n, command_ts=START + timedelta(minutes=n), location_id=n, room_number=room) for n, room in wants.items()]
    followed, inner = [], location_changes.cut_pieces

    def counted(df, order, *rest):
        if "_seq" in order and "_ent" in order:
            followed.append(df.count())
        return inner(df, order, *rest)

    monkeypatch.setattr(location_changes, "cut_pieces", counted)
    got = run_locations(spark, locs, {1}, cmds)
    assert got == expect_locations(locs, {1}, cmds)
    assert got[2] == {201: EXISTS, 203: EXISTS}
    assert followed[0] == 404 and 0 < sum(followed[1:]) <= 12


def test_counts_are_kept_up(spark):
    """Counts with the differences of both batches added are those of a fresh count."""
    locs, used, cmds = random_locations(8, commands=80)
    names = schemas.LOCATION_COMMANDS.fieldNames()
    inv = inventory(spark, [(i, f"T{i % 50}" if i % 11 else None, i % 3 == 0, sorted(used)[i % len(used)] if i % 5 else None) for i in range(60)])
    before = spark.createDataFrame(locs, schemas.LOCATIONS)
    after, room_log, _ = apply_location_changes(before, inv, spark.createDataFrame([tuple(c[n] for n in names) for c in cmds], schemas.LOCATION_COMMANDS))
    flips = [(n, START + timedelta(minutes=n), f"T{n * 8 % 45}", "ann") for n in range(100)]
    flipped, flip_log, _ = toggle_loaner(inv, spark.createDataFrame(flips, schemas.TOGGLE_COMMANDS))

    def rows(df):
        return sorted(map(repr, map(tuple, df.collect())))

    devices = kept_counts.add_deltas(kept_counts.device_counts(inv), kept_counts.flag_deltas(flip_log, inv))
    assert rows(devices) == rows(kept_counts.device_counts(flipped)) != rows(kept_counts.device_counts(inv))
    places = kept_counts.add_deltas(kept_counts.location_counts(before), kept_counts.location_deltas(room_log, before, after))
    assert rows(places) == rows(kept_counts.location_counts(after)) != rows(kept_counts.location_counts(before))
    assert rows(kept_counts.kept_by_room(after, devices, places).select("site_name", "room_type", "locations")) == rows(places)
    nothing = kept_counts.add_deltas(devices, kept_counts.flag_deltas(flip_log.where("false"), inv))
    assert rows(nothing) == rows(devices)


# --- toggles -------------------------------------------------------------------------------------


def test_toggle_batches(spark, join_kind):
    rng = random.Random(4)
    inv = [(i, f"T{i if i != 7 else 6}", i % 2 == 0, None) for i in range(1, 20)]
    cmds = []
    for c in range(400):
        tag = "T3" if rng.random() < 0.33 else rng.choice([f"T{i}" for i in range(1, 22)] + ["", None])
        cmds.append((c, START + timedelta(minutes=rng.randint(0, 90)), tag, rng.choice([None, "ann"])))
    flags = {t: l for i, t, l, _ in inv if t != "T6"}
    want_audit, want_rejected = [], {}
    for c, ts, tag, by in sorted(cmds, key=lambda c: (c[1], c[0])):
        if tag == "T6":
            want_rejected[c] = "Asset tag is not unique"
        elif tag not in flags:
            want_rejected[c] = "Asset not found"
        else:
            want_audit.append((tag, str(flags[tag]), str(not flags[tag]), by or "system", ts))
            flags[tag] = not flags[tag]
    new, audit, rejected = toggle_loaner(inventory(spark, inv), spark.createDataFrame(cmds, schemas.TOGGLE_COMMANDS))
    assert {r.command_id: r.reason for r in rejected.collect()} == want_rejected
    got = [(r.asset_tag, r.old_value, r.new_value, r.changed_by, r.changed_at) for r in audit.collect()]
    assert sorted(got) == sorted(want_audit)
    kept = {t: l for i, t, l, _ in inv if t == "T6"}
    assert all(r.is_loaner == flags.get(r.asset_tag, r.inventory_id % 2 == 0) for r in new.collect())
    assert new.count() == len(inv) and kept


def test_same_tag_twice_changes_nothing(spark):
    inv = [(1, "T1", False, None)]
    cmds = [(1, START, "T1", "a"), (2, START, "T1", "b")]
    new, audit, _ = toggle_loaner(inventory(spark, inv), spark.createDataFrame(cmds, schemas.TOGGLE_COMMANDS))
    assert [r.is_loaner for r in new.collect()] == [False]
    assert audit.count() == 2
