"""The versioned mapping log: which mapping of a concept is valid after a series of events.

Rule for one event: look at the valid mappings of its source concept whose dialect is equal or
missing (all of them when the event has no dialect) and take the one with the lowest id. If there
is none, the event becomes valid. If it is user-made and the event comes from the bridge, the event
is stored invalid. Otherwise the event becomes valid and replaces that one mapping.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators.dimensions import upsert_concepts
from termweave.runtime import import_in_tasks, materialise, ranked
from termweave.schemas import BRIDGE_MAPPING, BRIDGE_SESSION

_ROW = "struct<mapping_id:bigint,dialect:bigint,bridge:boolean>"
_KEY = ["source_concept_id", "destination_dialect_id"]
# Rows folded by one expression call; longer histories are cut into pieces of about this size.
CHUNK_ROWS = 20_000
# Events after which the states of one chunk are compared, to go on as one where they are equal.
MEETING_ROWS = 32
# Chunks composed by one call.
NEIGHBOURS = 32
# Rounds in which chunks are asked about their neighbours' states before a history is folded in order.
ROUNDS = 12


def _row() -> Column:
    return F.struct(
        F.col("mapping_id").cast("long").alias("mapping_id"),
        F.col("destination_dialect_id").cast("long").alias("dialect"),
        F.col("is_bridge").alias("bridge"),
    )


def _apply(state: Column, event: Column) -> Column:
    """The valid rows after one event; rows stay in id order because events arrive in id order."""
    rivals = F.filter(
        state,
        lambda r: event["dialect"].isNull() | r["dialect"].isNull() | (r["dialect"] == event["dialect"]),
    )
    added = F.array(event)

    def settle(old: Column) -> Column:
        return (
            F.when(old.isNull(), F.concat(state, added))
            .when(event["bridge"] & ~old["bridge"], state)
            .otherwise(F.concat(F.filter(state, lambda r: r["mapping_id"] != old["mapping_id"]), added))
        )

    # a one-element transform binds the rival, so it is looked up once per event
    return F.get(F.transform(F.array(F.get(rivals, F.lit(0))), settle), F.lit(0))


def _fold(start: Column, events: Column) -> Column:
    return F.aggregate(F.array_sort(events), start, _apply)


def _nothing() -> Column:
    return F.array().cast(f"array<{_ROW}>")


def latest_mappings(events: DataFrame) -> DataFrame:
    """Ids of the valid mappings when every event has a dialect: one winner per (source, dialect).

    The winner is the last user-made event or, without one, the last bridge event. A maximum
    combines before the shuffle, so a frequent concept costs no more than a rare one.
    """
    best = F.max(F.struct((~F.col("is_bridge")).alias("by_user"), "mapping_id"))
    return events.groupBy(*_KEY).agg(best.alias("best")).select(F.col("best.mapping_id").alias("mapping_id"))


def _chunked(events: DataFrame, chunk_rows: int) -> DataFrame:
    """Long histories cut at id boundaries: (source, chunk, events), at most two widths of events each.

    Ids come from one sequence, so a block of as many ids as the width holds at most that many events
    of a concept. Thin neighbouring blocks are merged by their running size, and chunks are numbered from 0.
    """
    blocks = events.withColumn("block", F.floor(F.col("mapping_id") / chunk_rows))
    sizes = blocks.groupBy("source_concept_id", "block").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("source_concept_id").orderBy("block")
    filled = sizes.withColumn("fill", F.floor((F.sum("n").over(running) - 1) / chunk_rows))
    chunks = filled.select("source_concept_id", "block", (F.dense_rank().over(running.orderBy("fill")) - 1).cast("long").alias("chunk"))
    placed = blocks.join(chunks, ["source_concept_id", "block"])
    return placed.groupBy("source_concept_id", "chunk").agg(F.collect_list(_row()).alias("events"))


def _outcomes(starts: list[tuple], events: list[tuple]) -> dict[tuple, tuple]:
    """For each given state before the events, the state after them.

    A start is a tuple of (dialect, is_bridge) in id order; a row of an end also tells where it is from: a place in the
    start, or the id of an event. Starts whose states have become equal are carried on as one, so soon there are few.
    """
    live = {tuple((*row, place, None) for place, row in enumerate(start)): [start] for start in starts}
    for at in range(0, len(events), MEETING_ROWS):
        after: dict[tuple, list] = {}
        for state, owners in live.items():
            rows = list(state)
            for event in events[at : at + MEETING_ROWS]:
                _settle(rows, *event)
            after.setdefault(tuple(rows), []).extend(owners)
        live = after
    return {start: state for state, owners in live.items() for start in owners}


def _settle(rows: list[tuple], mapping_id: int, dialect: int | None, bridge: bool) -> None:
    """One event on the open rows, in place."""
    for k, row in enumerate(rows):
        if dialect is None or row[0] is None or row[0] == dialect:
            if bridge and not row[1]:
                return
            del rows[k]
            break
    rows.append((dialect, bridge, None, mapping_id))


_STATE = "array<struct<dialect:bigint,bridge:boolean>>"
_END = "array<struct<dialect:bigint,bridge:boolean,place:int,mapping_id:bigint>>"
_KIND_FIELDS = [("dialect", pa.int64()), ("bridge", pa.bool_())]
_ROW_FIELDS = [("mapping_id", pa.int64()), *_KIND_FIELDS]
_END_FIELDS = [*_KIND_FIELDS, ("place", pa.int32()), ("mapping_id", pa.int64())]
_TABLE = pa.schema(
    [
        ("source_concept_id", pa.int64()),
        ("node", pa.int64()),
        ("start", pa.list_(pa.struct(_KIND_FIELDS))),
        ("end", pa.list_(pa.struct(_END_FIELDS))),
    ]
)


def _events_of(cell: pa.ListScalar) -> list[tuple]:
    """A chunk's events as (mapping_id, dialect, is_bridge) in id order."""
    fields = [cell.values.field(name).to_pylist() for name in ("mapping_id", "dialect", "bridge")]
    return sorted(zip(*fields), key=lambda e: (e[0], e[1] is not None, e[1] or 0, bool(e[2])))


def _kinds_in(rows: list[dict]) -> tuple:
    return tuple((r["dialect"], r["bridge"]) for r in rows)


def _table_row(source: int, node: int, start: tuple, end: tuple) -> dict:
    names = [name for name, _ in _END_FIELDS]
    return {
        "source_concept_id": source,
        "node": node,
        "start": [dict(zip(names, row)) for row in start],
        "end": [dict(zip(names, row)) for row in end],
    }


def _tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the states to be tried, as one row for each chunk and state."""
    for batch in batches:
        for k in range(batch.num_rows):
            source, node = (batch.column(name)[k].as_py() for name in ("source_concept_id", "node"))
            starts = [_kinds_in(start) for start in batch.column("starts")[k].as_py()]
            ends = _outcomes(starts, _events_of(batch.column("events")[k]))
            yield pa.RecordBatch.from_pylist([_table_row(source, node, *both) for both in ends.items()], schema=_TABLE)


def _composed(group: pa.Table) -> pa.Table:
    """The tables of some neighbours as one: each is looked up with what the one before it leaves.

    A state that a neighbour was not asked about is left out.
    """
    nodes: dict[int, dict[tuple, list]] = {}
    for row in group.to_pylist():
        end = [(r["dialect"], r["bridge"], r["place"], r["mapping_id"]) for r in row["end"]]
        nodes.setdefault(row["node"], {})[_kinds_in(row["start"])] = end
    order = sorted(nodes)
    found = []
    for start, end in nodes[order[0]].items():
        for node in order[1:]:
            last = nodes[node].get(tuple(r[:2] for r in end))
            if last is None:
                break
            end = [r if r[2] is None else end[r[2]] for r in last]
        else:
            found.append((start, end))
    source = group.column("source_concept_id")[0].as_py()
    return pa.Table.from_pylist([_table_row(source, order[0] // NEIGHBOURS, *both) for both in found], schema=_TABLE)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by source and node, each folded from the open rows that the one before it leaves."""
    schema = pa.schema([("source_concept_id", pa.int64()), ("state", pa.list_(pa.struct(_ROW_FIELDS)))])
    names = [name for name, _ in _ROW_FIELDS]
    source, rows = None, []

    def settled() -> pa.RecordBatch:
        state = [dict(zip(names, (r[3], r[0], r[1]))) for r in rows]
        return pa.RecordBatch.from_pylist([{"source_concept_id": source, "state": state}], schema=schema)

    for batch in batches:
        for k in range(batch.num_rows):
            owner = batch.column("source_concept_id")[k].as_py()
            if owner != source:
                if source is not None:
                    yield settled()
                source = owner
                rows = [(r["dialect"], r["bridge"], None, r["mapping_id"]) for r in batch.column("rows")[k].as_py()]
            for event in _events_of(batch.column("events")[k]):
                _settle(rows, *event)
    if source is not None:
        yield settled()


def _kinds(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(r["dialect"].alias("dialect"), r["bridge"].alias("bridge")))


def _tables_of_chunks(chunks: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The states before and after every chunk, and the sources for which they do not join up.

    A chunk is asked about what its left neighbour leaves. To have something to leave, every chunk but the first is tried
    with no open rows, and then with user rows without dialect, as many as any chunk of the source has left: states of one
    size meet after few events, and what a chunk leaves rarely tells where it began. Rounds go on until nothing is left
    that the right neighbour was not asked about, or for ``ROUNDS``.
    """
    key = ["source_concept_id", "node"]
    nodes = materialise(chunks.select(*key))
    later = nodes.filter("node > 0")
    none = F.array().cast(_STATE)
    asked = (
        nodes.join(first.select("source_concept_id", _kinds(F.col("rows")).alias("before")), "source_concept_id")
        .select(*key, F.when(F.col("node") == 0, F.col("before")).otherwise(none).alias("start"))
    )
    table = tried = None
    for turn in range(ROUNDS):
        starts = asked.groupBy(*key).agg(F.collect_list("start").alias("starts"))
        found = chunks.join(starts, key).select(*key, "events", "starts")
        found = materialise(found.mapInArrow(_tabled, f"source_concept_id long, node long, start {_STATE}, end {_END}"))
        table = found if table is None else table.unionByName(found)
        # only the first turn looks ahead; later ones add the sizes that have come up
        ahead = F.sequence(F.size("end"), F.size("end") + (2 if turn == 0 else 0))
        sizes = found.select("source_concept_id", F.explode(ahead).alias("n")).distinct()
        if tried is not None:
            sizes = sizes.join(tried, ["source_concept_id", "n"], "left_anti")
        sizes = materialise(sizes)
        tried = sizes if tried is None else tried.unionByName(sizes)
        blank = F.struct(F.lit(None).cast("long").alias("dialect"), F.lit(False).alias("bridge"))
        guessed = later.join(sizes, "source_concept_id").select(*key, F.array_repeat(blank, F.col("n")).alias("start"))
        left = found.select("source_concept_id", (F.col("node") + 1).alias("node"), _kinds(F.col("end")).alias("start"))
        wanted = left.distinct().join(later, key, "left_semi").unionByName(guessed).distinct()
        asked = materialise(wanted.join(table.select(*key, "start"), [*key, "start"], "left_anti"))
        if asked.isEmpty():
            break
    return table, asked.select("source_concept_id").distinct()


def _fold_long(events: DataFrame, start: DataFrame, chunk_rows: int) -> DataFrame:
    """Fold histories that are too long for one task, chunk by chunk in parallel.

    A chunk is summed up as a function: for each state before it that may be (dialect and origin of the open rows in id
    order) the state after it, whose rows are rows of the state before or events of the chunk. Neighbouring functions
    compose, ``NEIGHBOURS`` at a time, exactly. Where chunks depend on their beginning for so long that the functions do
    not join up, the source's chunks are folded in order, one at a time.
    """
    import_in_tasks(events.sparkSession)
    chunks = materialise(_chunked(events, chunk_rows).withColumnRenamed("chunk", "node"))
    first = (
        chunks.select("source_concept_id").distinct().join(start, "source_concept_id", "left")
        .select("source_concept_id", F.coalesce("start", _nothing()).alias("rows"))
    )
    first = materialise(first)
    table, apart = _tables_of_chunks(chunks, first)
    apart = materialise(apart)
    table = table.join(apart, "source_concept_id", "left_anti")
    longest = chunks.agg(F.max("node")).first()[0]
    while longest > 0:
        neighbours = table.groupBy("source_concept_id", F.floor(F.col("node") / NEIGHBOURS))
        table = materialise(neighbours.applyInArrow(_composed, table.schema))
        longest //= NEIGHBOURS
    whole = first.select("source_concept_id", "rows", _kinds(F.col("rows")).alias("start")).join(table, ["source_concept_id", "start"])
    row = lambda r: F.struct(F.coalesce(r["mapping_id"], F.get("rows", r["place"])["mapping_id"]).alias("mapping_id"), r["dialect"].alias("dialect"), r["bridge"].alias("bridge"))
    states = whole.select("source_concept_id", F.transform("end", row).alias("state"))
    if apart.isEmpty():
        return states
    queues = chunks.join(apart, "source_concept_id", "left_semi").join(first, "source_concept_id")
    in_order = queues.repartition("source_concept_id").sortWithinPartitions("source_concept_id", "node")
    return states.unionByName(in_order.mapInArrow(_carried, f"source_concept_id long, state array<{_ROW}>"))


def _fold_mixed(mixed: DataFrame, kinds: DataFrame, chunk_rows: int) -> DataFrame:
    """Ids of the valid mappings of concepts that need the ordered fold.

    ``mixed`` holds their open and new rows, ``kinds`` their number of new rows (n_new).
    """
    is_long = F.col("n_new") > chunk_rows
    start = (
        mixed.filter("_old")
        .groupBy("source_concept_id")
        .agg(F.array_sort(F.collect_list(_row())).alias("start"))
    )
    fresh = mixed.filter(~F.col("_old"))
    short = (
        fresh.filter(~is_long)
        .groupBy("source_concept_id")
        .agg(F.collect_list(_row()).alias("events"))
        .join(start, "source_concept_id", "full")
    )
    long_ids = kinds.filter(is_long).select("source_concept_id")
    states = short.join(long_ids, "source_concept_id", "left_anti").select(
        _fold(F.coalesce("start", _nothing()), F.coalesce("events", _nothing())).alias("state")
    )
    if not long_ids.isEmpty():
        states = states.unionByName(_fold_long(fresh.filter(is_long), start, chunk_rows).select("state"))
    return states.select(F.explode("state").alias("row")).select("row.mapping_id")


def _users_before_bridge(rows: DataFrame) -> DataFrame:
    """Ids of the valid mappings where only the bridge leaves the dialect out and only users name one.

    The first user event takes the place of the bridge's row, and no later bridge event can replace a
    user's. So the last user event of each dialect is valid or, without any, the last bridge event.
    """
    last = rows.groupBy(*_KEY, "is_bridge").agg(F.max("mapping_id").alias("mapping_id"))
    has_user = last.groupBy("source_concept_id").agg(F.bool_and("is_bridge").alias("only_bridge"))
    return (
        last.join(has_user, "source_concept_id")
        .filter(~F.col("is_bridge") | F.col("only_bridge"))
        .select("mapping_id")
    )


def fold_mappings(existing: DataFrame, events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Append ``events`` to the log and settle the ``valid`` flags of old and new rows.

    Both inputs hold mapping_id, source_concept_id, destination_dialect_id and is_bridge plus any
    further shared columns; ``existing`` also has ``valid``. New ids lie above old ones and come
    from one sequence. Two kinds of concepts have a closed form that only needs maxima: those whose
    rows all name a dialect, and those where the bridge never and users always do. Any other mixture
    takes the ordered fold.
    """
    open_rows = existing.filter("valid").drop("valid")
    closed_rows = existing.filter(~F.col("valid"))
    log = open_rows.withColumn("_old", F.lit(True)).unionByName(events.withColumn("_old", F.lit(False)))

    no_dialect = F.col("destination_dialect_id").isNull()
    per_dialect = log.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("_old").alias("n_old"),
        F.count_if("is_bridge").alias("n_bridge"),
        F.count_if(F.col("_old") & F.col("is_bridge")).alias("n_old_bridge"),
    )
    concept = per_dialect.groupBy("source_concept_id").agg(
        F.bool_or(no_dialect).alias("some_missing"),
        F.bool_or(F.col("n_old") > 1).alias("repeated"),
        F.bool_and(F.when(no_dialect, F.col("n_bridge") == F.col("n")).otherwise(F.col("n_bridge") == 0)).alias("split"),
        # a settled log of this kind never keeps a bridge row next to a user's
        ((F.sum("n_old_bridge") > 0) & (F.sum("n_old") > F.sum("n_old_bridge"))).alias("both_open"),
        F.sum(F.col("n") - F.col("n_old")).alias("n_new"),
    )
    split = F.col("split") & ~F.col("both_open")
    kind = (
        F.when(F.col("repeated"), "fold")
        .when(~F.col("some_missing"), "dialect")
        .when(split, "split")
        .otherwise("fold")
    )
    special = materialise(
        concept.select("source_concept_id", kind.alias("kind"), "n_new").filter("kind <> 'dialect'")
    )
    if special.isEmpty():
        winners = latest_mappings(log)
    else:
        rows = log.join(special, "source_concept_id", "left")
        winners = latest_mappings(rows.filter("kind IS NULL")).unionByName(
            _users_before_bridge(rows.filter("kind = 'split'"))
        )
        mixed = special.filter("kind = 'fold'")
        if not mixed.isEmpty():
            winners = winners.unionByName(_fold_mixed(rows.filter("kind = 'fold'"), mixed, chunk_rows))

    settled = (
        log.drop("_old")
        .join(winners.withColumn("valid", F.lit(True)), "mapping_id", "left")
        .withColumn("valid", F.coalesce("valid", F.lit(False)))
    )
    return closed_rows.unionByName(settled.select(*closed_rows.columns))


def bridge_mappings(bridge: DataFrame, old_concepts: DataFrame, new_concepts: DataFrame) -> DataFrame:
    """(source_concept_id, destination_concept_id) for each bridge row typed ``Match``.

    ``bridge`` holds code_harmonised, nomen2, conceptid, term and type. The concept tables hold
    concept_id, code_text and term_text of the two systems. Rows are numbered in ``order_no`` by
    source, then destination code, term and id, so the last match of a source wins the fold.
    """
    matches = bridge.filter(F.col("type") == "Match").select(
        F.col("code_harmonised").alias("source_code_text"),
        F.col("nomen2").alias("source_term_text"),
        F.col("conceptid").cast("string").alias("destination_code_text"),
        F.col("term").alias("destination_term_text"),
    )

    def side(concepts: DataFrame, prefix: str) -> DataFrame:
        return concepts.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("concept_id", "code_text", "term_text")])

    joined = matches.join(
        side(old_concepts, "source"), ["source_code_text", "source_term_text"]
    ).join(side(new_concepts, "destination"), ["destination_code_text", "destination_term_text"])
    order = ("source_concept_id", "destination_code_text", "destination_term_text", "destination_concept_id")
    return ranked(joined, *map(F.col, order), name="order_no")


def bridge_events(matches: DataFrame, user_id: Column, start: int = 1) -> DataFrame:
    """Mapping events of a bridge load: no dialect and no comment."""
    return matches.select(
        (F.col("order_no") - 1 + start).alias("mapping_id"),
        user_id.alias("user_id"),
        F.lit(BRIDGE_SESSION).cast("long").alias("session_id"),
        "source_concept_id",
        "destination_concept_id",
        F.lit(None).cast("long").alias("destination_dialect_id"),
        F.lit(BRIDGE_MAPPING).alias("event_type_name"),
        F.lit(None).cast("string").alias("comment"),
        F.lit(True).alias("is_bridge"),
    )


def derive_event_type(requests: DataFrame) -> DataFrame:
    return requests.withColumn(
        "event_type_name", fn.request_event_type(F.col("new_code"), F.col("new_term"))
    )


def request_events(requests: DataFrame, start: int = 1) -> DataFrame:
    """One event per concept of a request: the page concept, then the selected ones in order."""
    concepts = F.concat(F.array("concept_id"), F.coalesce("old_concepts", F.array().cast("array<bigint>")))
    exploded = derive_event_type(requests).select(
        *[c for c in requests.columns if c not in ("concept_id", "old_concepts")],
        "event_type_name",
        F.posexplode(concepts).alias("place", "source_concept_id"),
    )
    return ranked(exploded, F.col("request_id"), F.col("place"), name="mapping_id", start=start)


def with_destination(events: DataFrame, named: DataFrame) -> DataFrame:
    """Events with the id of the concept they name, if any.

    An event that lacks a part of the name meets nothing, and many do: they stay out of the join, where NULL would send
    all of them to a few tasks.
    """
    keys = ["new_code", "new_term", "owner_organisation_id", "target_dialect_id"]
    complete = reduce(and_, (F.col(key).isNotNull() for key in keys))
    found = events.filter(complete).join(named, keys, "left")
    unnamed = events.filter(~complete).withColumn("destination_concept_id", F.lit(None).cast("long"))
    return found.unionByName(unnamed)


def apply_requests(
    requests: DataFrame,
    code: DataFrame,
    term: DataFrame,
    concept: DataFrame,
    dialects: DataFrame,
    existing: DataFrame,
    start: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Map concepts by request: create missing target concepts, then append the events.

    ``requests`` holds request_id, concept_id, old_concepts, new_code, new_term, comment, user_id
    and target_dialect_id; ``dialects`` is ``v_dialect``, whose code system owner becomes the
    organisation of a created concept. Returns the code, term and concept tables and the log.
    """
    owner = dialects.select(
        F.col("dialect_id").alias("target_dialect_id"),
        F.col("code_system_owner_organisation_id").alias("owner_organisation_id"),
    )
    events = materialise(request_events(requests, start).join(owner, "target_dialect_id", "left"))
    target = events.filter(F.col("event_type_name") != "Incorrect concept").select(
        F.col("new_code").alias("code_text"),
        F.col("new_term").alias("term_text"),
        F.col("owner_organisation_id").alias("organisation_id"),
        F.col("target_dialect_id").alias("dialect_id"),
    )
    code, term, concept = upsert_concepts(code, term, concept, target.distinct())
    named = (
        concept.join(code, "code_id")
        .join(term, "term_id")
        .groupBy("code_text", "term_text", "organisation_id", "dialect_id")
        .agg(F.min("concept_id").alias("destination_concept_id"))
        .select(
            F.col("code_text").alias("new_code"),
            F.col("term_text").alias("new_term"),
            F.col("organisation_id").alias("owner_organisation_id"),
            F.col("dialect_id").alias("target_dialect_id"),
            "destination_concept_id",
        )
    )
    resolved = materialise(with_destination(events, named).select(
        "mapping_id",
        "user_id",
        "source_concept_id",
        "destination_concept_id",
        F.col("target_dialect_id").alias("destination_dialect_id"),
        "event_type_name",
        "comment",
        (F.col("event_type_name") == BRIDGE_MAPPING).alias("is_bridge"),
    ))
    return code, term, concept, fold_mappings(existing, resolved)


def upsert_notes(existing: DataFrame, edits: DataFrame) -> DataFrame:
    """Latest note per (user, concept); an empty note deletes the row.

    ``edits`` holds user_id, concept_id, note and edit_no; existing notes precede every edit.
    """
    old = existing.select("user_id", "concept_id", "note", F.lit(None).cast("long").alias("edit_no"))
    every = old.unionByName(edits.select("user_id", "concept_id", "note", F.col("edit_no").cast("long")))
    latest = every.groupBy("user_id", "concept_id").agg(
        F.max(F.struct("edit_no", "note")).alias("last")
    )
    kept = F.coalesce("last.note", F.lit("")) != ""
    return latest.filter(kept).select("user_id", "concept_id", F.col("last.note").alias("note"))


def set_defaults(users: DataFrame, edits: DataFrame) -> DataFrame:
    """Each user's latest choice of source and target dialect replaces the stored one.

    ``edits`` holds user_id, source_dialect_id, destination_dialect_id and edit_no.
    """
    latest = edits.groupBy("user_id").agg(
        F.max(F.struct("edit_no", "source_dialect_id", "destination_dialect_id")).alias("choice")
    )
    return (
        users.join(latest, "user_id", "left")
        .withColumns(
            {
                "default_source_dialect_id": F.coalesce("choice.source_dialect_id", "default_source_dialect_id"),
                "default_destination_dialect_id": F.coalesce(
                    "choice.destination_dialect_id", "default_destination_dialect_id"
                ),
            }
        )
        .select(*users.columns)
    )
