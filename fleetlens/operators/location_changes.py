"""Applying batches of CREATE, UPDATE and DELETE commands to the locations.

Commands count in the order (command_ts, command_id). Most checks depend on one command alone, or on
the first DELETE of its location. Only one depends on other commands: a (site, room) may be taken
while another location holds it.

That is settled by passes over all commands that take or leave a room. A pass assumes answers for
the moves (at first: all accepted), follows every location from room to room, and finds out when
whoever takes a room would leave it again. In each room the first to ask gets it, then the first to
ask after that one left, and so on; jumps of doubled length find all of them in a few steps, however
many ask for one room. If the answers for the moves come out as assumed, they are those of going one
by one. If not, the next pass assumes the new ones; the earliest wrong answer is right from then on.
A move that turns out to be refused does not leave its old room either, so whoever got that room by
it is refused too, and so on; and one that turns out to be accepted makes room for the next in the
same way. Jumps of doubled length follow such chains to their end within one pass.

With ``ids_from_commands`` a new location has the id of the command that makes it, so later commands
of the same batch can change, move and delete it, and it makes no difference where a log is cut into
batches. Such a location lives from its CREATE, if that got its room, to its first DELETE; what
names it outside that span finds nothing. A pass then also assumes an answer for every CREATE: the
commands on a location that was not made neither take nor leave a room.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.cells import any_of, is_blank, location_label, location_ref
from fleetlens.operators.history import log_rows
from fleetlens.operators.ordering import assign_ids, cut_pieces, plain, reached, reached_nearby, running_last
from fleetlens.operators.skew import fits_broadcast, join_checked, join_unique
from fleetlens.schemas import LOCATION_FIELDS
from fleetlens.sources.storage import stored
from fleetlens.sources.tables import next_id

# The reasons given with a rejected command.
UNKNOWN_COMMAND = "Unknown command"
NOT_FOUND = "Location not found"
NOTHING_GIVEN = "No fields to update"
IN_USE = "Cannot delete location that has inventory items assigned to it"
EXISTS = "Location already exists"

CREATE, UPDATE, DELETE = "CREATE", "UPDATE", "DELETE"
_ENTITY = ["_new", "_ent"]
_ROOM = ["_site", "_roomno"]


def _taken() -> Column:
    """The room of a row as a key in which NULLs are equal."""
    return F.struct("_site", "_roomno")


def _left() -> Column:
    """The same of the room that it left."""
    return F.struct(F.col("_from_site").alias("_site"), F.col("_from_room").alias("_roomno"))


def _given(field: str) -> Column:
    return F.coalesce(F.array_contains("given", field), F.lit(False))


def _lacking(field: str) -> Column:
    return ~_given(field) | is_blank(field)


def _made_in_batch(cmds: DataFrame, ids_from_commands: bool) -> DataFrame:
    """location_id, fields and moment (``_made``) of the locations that well-formed commands of the batch ask for."""
    wanted = cmds.where(F.col("kind") == CREATE).where(~any_of([_lacking(f) for f in LOCATION_FIELDS]))
    if not ids_from_commands:
        wanted = wanted.where("false")
    return wanted.select(F.col("command_id").alias("location_id"), *LOCATION_FIELDS, F.col("_when").alias("_made"))


def _judge_alone(loc: DataFrame, inv: DataFrame, cmds: DataFrame, ids_from_commands: bool) -> DataFrame:
    """Every command with the fields that its location starts with and the reason against it, if any.

    ``_made`` is the moment at which a command of the batch makes the location, NULL for stored ones.
    """
    kind = F.coalesce("kind", F.lit(""))
    cmds = cmds.select("*", F.struct("command_ts", "command_id").alias("_when"))
    naming = cmds.where(F.col("kind").isin(UPDATE, DELETE) & F.col("location_id").isNotNull())
    deletes = F.when(F.col("kind") == DELETE, F.col("_when"))
    named = naming.groupBy("location_id").agg(F.min(deletes).alias("_first_delete"))
    used = inv.where("location_id IS NOT NULL").select("location_id").distinct()
    used = used.join(named, "location_id", "left_semi").withColumn("_used", F.lit(True))
    begins = [F.col(f).alias(f"_old_{f}") for f in LOCATION_FIELDS]
    facts = (
        loc.join(named, "location_id")
        .join(used, "location_id", "left")
        .select(
            "location_id",
            *begins,
            F.coalesce("_used", F.lit(False)).alias("_used"),
            F.when(F.col("_used").isNull(), F.col("_first_delete")).alias("_gone"),
            F.lit(None).cast(cmds.schema["_when"].dataType).alias("_made"),
        )
    )
    if ids_from_commands:
        made = stored(_made_in_batch(cmds, ids_from_commands).join(named.select("location_id"), "location_id", "left_semi"), "made")
        after = join_checked(naming.select("location_id", "kind", "_when"), made.select("location_id", "_made"), ["location_id"], "inner", ["_when"])
        ends = after.where("_when > _made").groupBy("location_id").agg(F.min(deletes).alias("_gone"))
        made = made.join(ends, "location_id", "left")
        facts = facts.unionByName(made.select("location_id", *begins, F.lit(False).alias("_used"), "_gone", "_made"))
    rows = join_checked(cmds, stored(facts, "facts"), ["location_id"], "left", ["command_id"])

    early = F.coalesce(F.col("_when") <= F.col("_made"), F.lit(False))
    absent = F.col("_used").isNull() | early | F.coalesce(F.col("_when") > F.col("_gone"), F.lit(False))
    reason = F.when(~kind.isin(CREATE, UPDATE, DELETE), UNKNOWN_COMMAND)
    for f in LOCATION_FIELDS:
        reason = reason.when((kind == CREATE) & _lacking(f), f"Missing required field: {f}")
    reason = reason.when(kind.isin(UPDATE, DELETE) & absent, NOT_FOUND)
    reason = reason.when((kind == UPDATE) & ~any_of([_given(f) for f in LOCATION_FIELDS]), NOTHING_GIVEN)
    for f in LOCATION_FIELDS:
        reason = reason.when((kind == UPDATE) & _given(f) & F.col(f).isNull(), f"Field must not be NULL: {f}")
    reason = reason.when((kind == DELETE) & F.col("_used"), IN_USE)
    fields = [F.when(_given(f), F.col(f)).alias(f) for f in LOCATION_FIELDS]
    others = [c for c in rows.columns if c not in LOCATION_FIELDS and c != "_made"]
    made_at = F.when(kind.isin(UPDATE, DELETE), F.col("_made")).alias("_made")
    return stored(rows.select(*others, made_at, *fields, reason.alias("reason")), "judged")


def _settle_rooms(loc: DataFrame, judged: DataFrame, ids_from_commands: bool) -> DataFrame:
    """command_id and ``_ok`` of every command that takes or leaves a room."""
    created = F.col("kind") == CREATE
    # A DELETE or a move of a new location counts only if that was made; other updates wait for the outcome.
    events = judged.where("reason IS NULL").where(
        (F.col("kind") != UPDATE) | F.col("site_name").isNotNull() | F.col("room_number").isNotNull()
    )
    events = events.select(
        (created | F.col("_made").isNotNull()).alias("_new"),
        F.when(created, F.col("command_id")).otherwise(F.col("location_id")).alias("_ent"),
        F.lit(1).alias("_seq"),
        "command_ts",
        "command_id",
        "kind",
        F.col("site_name").alias("_site"),
        F.col("room_number").alias("_roomno"),
    )
    moved = events.where("NOT _new").select(F.col("_ent").alias("location_id")).distinct()

    def at_start(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.lit(False).alias("_new"),
            F.col("location_id").alias("_ent"),
            F.lit(0).alias("_seq"),
            F.lit(None).cast("timestamp_ntz").alias("command_ts"),
            F.lit(None).cast("long").alias("command_id"),
            F.lit("START").alias("kind"),
            F.col("site_name").alias("_site"),
            F.col("room_number").alias("_roomno"),
        )

    starts = stored(at_start(loc.join(moved, "location_id", "left_semi")).withColumn("_ok", F.lit(True)), "starts")
    bystanders = stored(at_start(loc.join(moved, "location_id", "left_anti")), "bystanders")
    events = stored(events, "events")
    # Whether a CREATE got its room, or a DELETE a location, changes no path if nobody can name new locations.
    weighs = F.lit(True) if ids_from_commands else F.col("kind") == UPDATE
    wrong = weighs & (F.col("_was") != F.col("_ok"))

    path = _follow(events.withColumn("_ok", F.lit(True)).unionByName(starts))
    answers, onward = _weighed(path, path, path, bystanders)
    open_ = stored(answers.where(wrong).select("command_id", "kind", "_ok"), "open")
    # What the passes after the first one found; it holds in place of what the first one did.
    assumed = later = touched = rooms = jumps = after = None
    while not open_.isEmpty():
        known = onward if jumps is None else _listed(rooms, ["_room"])(onward, "left_anti").unionByName(jumps)
        wanted = open_.select("command_id", "_ok")
        # What follows from an answer that turned out otherwise is assumed along with it.
        for then in (True, False):
            turned = open_.where((F.col("kind") == UPDATE) & (F.col("_ok") == then)).select("command_id")
            if not turned.isEmpty():
                found = reached_nearby(turned, known.select("command_id", "_to")).distinct().withColumn("_ok", F.lit(then))
                found = stored(found, "turned")
                wanted = wanted.join(found, "command_id", "left_anti").unionByName(found)
        wanted = stored(wanted, "wanted")
        if assumed is None:
            changed, assumed = wanted.where("NOT _ok"), wanted
        else:
            was = assumed.select("command_id", F.col("_ok").alias("_was"))
            changed = wanted.join(was, "command_id", "left").where(F.col("_ok") != F.coalesce("_was", F.lit(True)))
            changed = stored(changed, "changed")
            assumed = stored(assumed.join(wanted, "command_id", "left_anti").unionByName(wanted), "assumed")

        # Follow the locations anew whose answers are assumed otherwise now; the others go as before.
        dirty = stored(events.join(changed.select("command_id"), "command_id", "left_semi").select(*_ENTITY).distinct(), "dirty")
        of_dirty = _listed(dirty, _ENTITY)
        mine = of_dirty(events, "left_semi").join(assumed, "command_id", "left").withColumn("_ok", F.coalesce("_ok", F.lit(True)))
        fresh = _follow(mine.unionByName(of_dirty(starts, "left_semi")))
        # Only rooms that these touch, or touched, are weighed anew, with all that the other locations do there.
        went = of_dirty(path, "left_semi")
        if later is not None:
            went = touched(went, "left_anti").unionByName(of_dirty(later, "left_semi"))
        went = went.unionByName(fresh)
        again = stored(went.select(_taken().alias("_room")).unionByName(went.select(_left().alias("_room"))).distinct(), "again")
        later = fresh if later is None else stored(of_dirty(later, "left_anti").unionByName(fresh), "later")
        touched = _listed(stored(later.select(*_ENTITY).distinct(), "touched"), _ENTITY)
        there = _listed(again, ["_room"])
        taken, left = (
            stored(
                touched(there(path.withColumn("_room", room), "left_semi"), "left_anti")
                .unionByName(there(later.withColumn("_room", room), "left_semi"))
                .drop("_room"),
                "there",
            )
            for room in (_taken(), _left())
        )
        answered, found = _weighed(taken, left, fresh, bystanders)
        rooms = again if rooms is None else stored(rooms.unionByName(again).distinct(), "rooms")
        jumps = found if jumps is None else stored(there(jumps, "left_anti").unionByName(found), "jumps")
        after = answered if after is None else stored(after.join(answered, "command_id", "left_anti").unionByName(answered), "after")
        # An answer that was set aside by what followed from another one, and not weighed again, is still open.
        aside = open_.join(answered, "command_id", "left_anti").join(assumed.withColumnRenamed("_ok", "_was"), "command_id")
        open_ = stored(answered.where(wrong).select(*open_.columns).unionByName(aside.where("_was <> _ok").select(*open_.columns)), "open")
    if after is not None:
        answers = answers.join(after, "command_id", "left_anti").unionByName(after)
    return answers.select("command_id", "_ok")


def _listed(keys: DataFrame, on: list[str]) -> Callable[[DataFrame, str], DataFrame]:
    """Picks the rows whose key is in a list (left_semi), or is not (left_anti); a list that fits is broadcast."""
    if fits_broadcast(keys):
        return lambda rows, how: rows.join(F.broadcast(keys), on, how)
    return lambda rows, how: join_unique(rows, keys, on, how, ["command_id"])


def _follow(flagged: DataFrame) -> DataFrame:
    """The room of each location before and after each command, and when it leaves next, given ``_ok`` of all commands."""
    path = running_last(
        cut_pieces(flagged, [*_ENTITY, "_seq", "command_ts", "command_id"]),
        _ENTITY,
        {
            "_from_site": F.when(F.col("_ok"), F.col("_site")),
            "_from_room": F.when(F.col("_ok"), F.col("_roomno")),
            "_born": F.when(F.col("kind") == CREATE, F.col("_ok")),
        },
    )
    to_site, to_room = F.coalesce("_site", "_from_site"), F.coalesce("_roomno", "_from_room")
    stays = (F.col("kind") == UPDATE) & (to_site == F.col("_from_site")) & (to_room == F.col("_from_room"))
    path = path.withColumns(
        {"_site": to_site, "_roomno": to_room, "_stays": F.coalesce(stays, F.lit(False)), "_alive": F.coalesce("_born", F.lit(True))}
    )
    path = stored(path, "path")
    leaving = F.col("_alive") & ((F.col("kind") == DELETE) | (_moves() & F.col("_ok")))
    path = running_last(path, _ENTITY, {"_leave": F.when(leaving, F.struct("command_ts", "command_id"))}, backwards=True)
    return stored(plain(path), "path")


def _moves() -> Column:
    return (F.col("kind") == UPDATE) & ~F.col("_stays")


def _weighed(taken: DataFrame, left: DataFrame, fresh: DataFrame, bystanders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """command_id, kind, ``_ok`` and ``_was`` (the assumption) of the commands weighed, and the jumps of `_winners`.

    ``taken`` and ``left`` hold the paths of all that come to, or would leave, the rooms in question;
    ``fresh`` those of the locations followed anew, whose commands without a room are answered too.
    """
    takes = taken.where(F.col("_alive") & ~F.col("_stays") & (F.col("kind") != DELETE))
    asks = takes.where("_seq = 1").select(*_ROOM, "command_ts", "command_id", "kind", "_ok")
    asked = asks.select(*_ROOM).distinct()
    here = bystanders.join(asked, _ROOM, "left_semi").withColumn("_leave", F.lit(None).cast(takes.schema["_leave"].dataType))
    would_leave = left.where(F.col("_alive") & _moves() & ~F.col("_ok")).select(
        F.col("_from_site").alias("_site"), F.col("_from_room").alias("_roomno"), "command_ts", "command_id"
    )
    winners, onward = _winners(takes.unionByName(here, allowMissingColumns=True), asks, would_leave)

    judged_asks = asks.join(winners.withColumn("_won", F.lit(True)), "command_id", "left").select(
        "command_id", "kind", F.coalesce("_won", F.lit(False)).alias("_ok"), F.col("_ok").alias("_was")
    )
    rest = fresh.where("_seq = 1 AND (_stays OR kind = 'DELETE' OR NOT _alive)").select(
        "command_id", "kind", F.col("_alive").alias("_ok"), F.col("_ok").alias("_was")
    )
    return stored(judged_asks.unionByName(rest), "answers"), stored(onward, "onward")


def _winners(takes: DataFrame, asks: DataFrame, would_leave: DataFrame) -> tuple[DataFrame, DataFrame]:
    """command_id of every ask that finds its room empty, given when each taker would leave.

    Also the jumps from a move (command_id) to the first ask (_to) for the room (_room) that it
    leaves, or would leave if it were accepted.
    """
    first = takes.groupBy(*_ROOM).agg(
        F.min_by(F.struct("_seq", "command_id"), F.struct("_seq", "command_ts", "command_id")).alias("first")
    )
    # For each taker, the first ask for the same room after it left.
    ask_marks = asks.select(
        *_ROOM, "command_ts", "command_id", F.lit(0).alias("_mark"), F.lit(None).cast("int").alias("_seq"),
        F.lit(None).cast("long").alias("_by"), F.lit(None).cast("long").alias("_move"),
    )
    leave_marks = takes.where("_leave IS NOT NULL").select(
        *_ROOM, F.col("_leave.command_ts").alias("command_ts"), F.col("_leave.command_id").alias("command_id"),
        F.lit(1).alias("_mark"), "_seq", F.col("command_id").alias("_by"), F.col("_leave.command_id").alias("_move"),
    )
    idle_marks = would_leave.select(
        *_ROOM, "command_ts", "command_id", F.lit(1).alias("_mark"), F.lit(None).cast("int").alias("_seq"),
        F.lit(None).cast("long").alias("_by"), F.col("command_id").alias("_move"),
    )
    line = cut_pieces(
        ask_marks.unionByName(leave_marks).unionByName(idle_marks), [*_ROOM, "command_ts", "command_id", "_mark", "_seq", "_by"]
    )
    nexts = running_last(line, _ROOM, {"_next": F.when(F.col("_mark") == 0, F.col("command_id"))}, backwards=True)
    nexts = nexts.where("_mark = 1 AND _next IS NOT NULL").select("_seq", "_by", "_next", "_move", _taken().alias("_room"))
    nexts = stored(nexts, "nexts")

    found = first.where("first._seq = 1").select(F.col("first.command_id").alias("command_id")).unionByName(
        nexts.where("_seq = 0").select(F.col("_next").alias("command_id"))
    )
    jumps = nexts.where("_seq = 1").select(F.col("_by").alias("command_id"), F.col("_next").alias("_to"))
    onward = nexts.select(F.col("_move").alias("command_id"), F.col("_next").alias("_to"), "_room").distinct()
    return reached(found, jumps), onward


def apply_location_changes(
    loc: DataFrame, inv: DataFrame, cmds: DataFrame, first_id: int | None = None, ids_from_commands: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New locations, log rows and rejected commands.

    ``first_id`` numbers the new locations; with ``ids_from_commands`` they are numbered by their
    commands, whose ids must then differ from those of all locations.
    """
    alone = _judge_alone(loc, inv, cmds, ids_from_commands)
    rooms = _settle_rooms(loc, alone, ids_from_commands)
    clash = F.when(~F.coalesce("_ok", F.lit(True)), EXISTS)
    answered = alone.join(rooms, "command_id", "left").withColumn("_unmade", F.lit(False))
    if ids_from_commands:
        # Commands on a location whose CREATE was refused, whatever they ask for.
        refused = rooms.where("NOT _ok").join(alone.where(F.col("kind") == CREATE).select("command_id"), "command_id")
        refused = stored(refused.select(F.col("command_id").alias("location_id"), F.lit(True).alias("_unmade")), "refused")
        answered = join_checked(answered.drop("_unmade"), refused, ["location_id"], "left", ["command_id"])
    unmade = F.coalesce(F.col("_unmade") & F.col("_made").isNotNull(), F.lit(False))
    reason = F.when(unmade, NOT_FOUND).otherwise(F.coalesce("reason", clash))
    judged = stored(answered.withColumn("reason", reason).drop("_ok", "_unmade"), "settled")
    rejected = judged.where("reason IS NOT NULL").select("command_id", "reason")
    good = judged.where("reason IS NULL")
    updates, deletes = good.where(F.col("kind") == UPDATE), good.where(F.col("kind") == DELETE)

    created = good.where(F.col("kind") == CREATE).select("command_ts", "command_id", *LOCATION_FIELDS, "changed_by")
    if ids_from_commands:
        created = created.withColumn("location_id", F.col("command_id"))
    else:
        first_id = next_id(loc, "location_id") if first_id is None else first_id
        created = assign_ids(created, ["command_ts", "command_id"], first_id, "location_id")
    latest = updates.groupBy("location_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_when"))).alias(f"_last_{f}") for f in LOCATION_FIELDS]
    )
    changed = loc.select("location_id", *LOCATION_FIELDS).unionByName(created.select("location_id", *LOCATION_FIELDS))
    changed = changed.join(latest, "location_id", "left")
    changed = changed.select(
        "location_id", *[F.coalesce(f"_last_{f}", f).alias(f) for f in LOCATION_FIELDS]
    )
    new_loc = changed.join(deletes.select("location_id"), "location_id", "left_anti")

    by = F.coalesce("changed_by", F.lit("system"))
    nothing = F.lit(None).cast("string")
    label, ref = location_label("site_name", "room_number"), location_ref("location_id")
    made = log_rows(created, ref, F.lit(CREATE), F.lit("location"), nothing, label, by, F.col("command_ts"))
    last_state = deletes.select("location_id", "command_ts", "changed_by").join(changed, "location_id")
    dropped = log_rows(last_state, ref, F.lit(DELETE), F.lit("location"), label, nothing, by, F.col("command_ts"))

    history = running_last(
        cut_pieces(updates, ["location_id", "command_ts", "command_id"]),
        ["location_id"],
        {f"_prev_{f}": F.col(f) for f in LOCATION_FIELDS},
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.coalesce(f"_prev_{f}", f"_old_{f}").alias("old_value"),
                F.col(f).alias("new_value"),
            )
            for f in LOCATION_FIELDS
        ]
    )
    steps = plain(history).select("location_id", "command_ts", "changed_by", F.inline(cells))
    steps = steps.where("new_value IS NOT NULL AND new_value <> old_value")
    edited = log_rows(
        steps, ref, F.lit(UPDATE), F.col("field"), F.col("old_value"), F.col("new_value"), by, F.col("command_ts")
    )
    return new_loc, made.unionByName(edited).unionByName(dropped), rejected
