import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import mapping as log
from termweave.plans import fixtures as fx

EVENT = "mapping_id long, source_concept_id long, destination_dialect_id long, is_bridge boolean"


def replay(rows):
    """Row-by-row rule: ids of the valid rows."""
    valid = {}
    for mapping_id, source, dialect, bridge in sorted(rows):
        state = valid.setdefault(source, [])
        rivals = [r for r in state if dialect is None or r[1] is None or r[1] == dialect]
        old = min(rivals, default=None)
        if old is not None and bridge and not old[2]:
            continue
        if old is not None:
            state.remove(old)
        state.append((mapping_id, dialect, bridge))
    return {r[0] for state in valid.values() for r in state}


def fold(spark, rows, existing=(), **options):
    events = spark.createDataFrame(list(rows), EVENT)
    old = spark.createDataFrame(list(existing), EVENT + ", valid boolean")
    return log.fold_mappings(old, events, **options)


def valid_ids(df):
    return {r.mapping_id for r in df.filter("valid").collect()}


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([(1, 1, 5, True)], {1}),
        ([(1, 1, 5, False), (2, 1, 5, True)], {1}),  # bridge does not replace a user
        ([(1, 1, 5, True), (2, 1, 5, False)], {2}),
        ([(1, 1, 5, True), (2, 1, 5, True)], {2}),
        ([(1, 1, 5, False), (2, 1, 6, False)], {1, 2}),  # other dialect
        ([(1, 1, None, True), (2, 1, 5, False)], {2}),  # missing dialect meets every dialect
        ([(1, 1, 5, False), (2, 1, 6, False), (3, 1, None, False)], {2, 3}),  # only the lowest id goes
        ([(1, 1, 5, False), (2, 1, None, True)], {1}),
        ([(1, 1, None, False), (2, 1, 5, False), (3, 2, None, True)], {2, 3}),
    ],
)
def test_rule(spark, rows, expected):
    assert replay(rows) == expected
    assert valid_ids(fold(spark, rows)) == expected


def random_events(seed, n, sources, dialects, start=1):
    rng = random.Random(seed)
    return [
        (start + i, rng.choice(sources), rng.choice(dialects), rng.random() < 0.4) for i in range(n)
    ]


def test_closed_form_equals_replay(spark):
    rows = random_events(1, 3000, range(60), [1, 2, 3])
    assert valid_ids(fold(spark, rows)) == replay(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_mixed_dialects_equal_replay(spark, seed):
    rows = random_events(seed, 2000, range(80), [1, 2, 3, None])
    assert valid_ids(fold(spark, rows)) == replay(rows)


@pytest.mark.parametrize("seed,dialects,chunk_rows", [(5, [1] * 200 + [2, None], 200), (6, [None, 1, 2, 3, 4], 300)])
def test_long_history_is_folded_in_chunks(spark, seed, dialects, chunk_rows):
    """One concept holds most events and is folded in parallel pieces."""
    rows = random_events(seed, 1500, [7] * 9 + [8], dialects)
    assert valid_ids(fold(spark, rows, chunk_rows=chunk_rows)) == replay(rows)


def test_chunks_are_tried_with_few_states(spark):
    """States of one size meet, so a chunk's table does not grow with the number of chunks."""
    rows = random_events(21, 6000, [7], [1, 2, 3, None])
    chunks = log._chunked(spark.createDataFrame(rows, EVENT), 200).withColumnRenamed("chunk", "node")
    log.import_in_tasks(spark)
    first = spark.createDataFrame([(7, [])], f"source_concept_id long, rows array<{log._ROW}>")
    table, apart = log._tables_of_chunks(chunks, first)
    assert apart.isEmpty()
    sizes = [r["count"] for r in table.groupBy("node").count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 60
    assert valid_ids(fold(spark, rows, chunk_rows=200)) == replay(rows)


def test_histories_that_do_not_join_up_are_folded_in_order(spark, monkeypatch):
    monkeypatch.setattr(log, "ROUNDS", 1)
    rows = random_events(22, 1500, [7, 7, 8], [1, 2, None])
    first = fold(spark, rows[:500]).collect()
    existing = [(r.mapping_id, r.source_concept_id, r.destination_dialect_id, r.is_bridge, r.valid) for r in first]
    assert valid_ids(fold(spark, rows[500:], existing, chunk_rows=100)) == replay(rows)


@pytest.mark.parametrize("dialects", [[1, None], [1, 2, 3], [1, 2, None], [1, 2, 3, 4, None, None]])
def test_summaries_of_chunks_compose(dialects):
    """The state after two chunks is that of the second, looked up with what the first leaves."""
    rng = random.Random(len(dialects))
    events = [(k, rng.choice(dialects), rng.random() < 0.4) for k in range(60)]
    state = ()
    for at in range(0, 60, 15):
        kinds = tuple((d, b) for d, b, _ in state)
        others = [tuple((rng.choice(dialects), rng.random() < 0.5) for _ in range(n)) for n in (0, 1, 2, 3)]
        end = log._outcomes([kinds, *others], events[at : at + 15])[kinds]
        state = tuple((d, b, state[place][2] if mapping_id is None else mapping_id) for d, b, place, mapping_id in end)
        assert {r[2] for r in state} == replay([(k, 1, d, b) for k, d, b in events[: at + 15]])


def split_events(seed, n, sources):
    """Only the bridge leaves the dialect out, as in the loaders."""
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        bridge = rng.random() < 0.6
        rows.append((i, rng.choice(sources), None if bridge else rng.choice([1, 2, 3]), bridge))
    return rows


def test_bridge_without_dialect_has_a_closed_form(spark, monkeypatch):
    rows = split_events(11, 2000, range(300))
    expected = replay(rows)
    monkeypatch.setattr(log, "_fold_mixed", None)  # the ordered fold is not needed
    assert valid_ids(fold(spark, rows)) == expected
    first = fold(spark, rows[:900]).collect()
    existing = [(r.mapping_id, r.source_concept_id, r.destination_dialect_id, r.is_bridge, r.valid) for r in first]
    assert valid_ids(fold(spark, rows[900:], existing)) == expected


def test_open_rows_of_both_kinds_take_the_fold(spark):
    """A bridge row left open next to a user's row is not what the closed form assumes."""
    existing = [(1, 1, None, True, True), (2, 1, 5, False, True)]
    rows = [(3, 1, None, True)]
    assert valid_ids(fold(spark, rows, existing)) == {2, 3}


def test_second_load_starts_from_the_settled_log(spark):
    rows = random_events(9, 1200, [7] * 5 + list(range(30)), [1, 2, None])
    first = fold(spark, rows[:600]).collect()
    existing = [(r.mapping_id, r.source_concept_id, r.destination_dialect_id, r.is_bridge, r.valid) for r in first]
    for chunk_rows in (200, 20_000):
        both = fold(spark, rows[600:], existing, chunk_rows=chunk_rows)
        assert both.count() == 1200
        assert valid_ids(both) == replay(rows)


def test_bridge_events_stored_invalid_on_insert():
    """Known sizes of the derived log at sf0.01, from the replay alone."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    body = fx.with_tables(("mapping_event_null",), "SELECT mapping_id, source_concept_id, destination_dialect_id, is_bridge FROM mapping_event_null")
    rows = db.execute(body).fetchall()
    valid = replay(rows)
    assert len({r[1] for r in rows}) == 4345
    assert len(valid) == 6550
    assert sum(r[3] for r in rows if r[0] in valid) == 336


def test_notes_last_write_wins_and_empty_deletes(spark):
    old = spark.createDataFrame([(1, 1, "old"), (1, 2, "keep"), (1, 3, "gone")], "user_id long, concept_id long, note string")
    edits = spark.createDataFrame(
        [(1, 1, "new", 5), (1, 1, "older", 4), (1, 3, "", 6), (2, 1, None, 7), (2, 2, "x", 8)],
        "user_id long, concept_id long, note string, edit_no long",
    )
    rows = {(r.user_id, r.concept_id): r.note for r in log.upsert_notes(old, edits).collect()}
    assert rows == {(1, 1): "new", (1, 2): "keep", (2, 2): "x"}


def test_requests_expand_page_concept_first(spark):
    requests = spark.createDataFrame(
        [(1, 10, [11, 12], "c", None), (2, 20, None, None, None)],
        "request_id long, concept_id long, old_concepts array<bigint>, new_code string, new_term string",
    )
    rows = log.request_events(requests, start=5).orderBy("mapping_id").collect()
    assert [(r.mapping_id, r.source_concept_id, r.event_type_name) for r in rows] == [
        (5, 10, "User mapping"), (6, 11, "User mapping"), (7, 12, "User mapping"), (8, 20, "Incorrect concept"),
    ]


def test_events_without_a_name_do_not_meet_in_one_task(spark):
    rows = [(k, None if k % 2 else "c", None if k % 3 == 1 else "t", 1, 5) for k in range(4000)] + [(4000, "c", "t", 1, None)]
    events = spark.createDataFrame(rows, "mapping_id long, new_code string, new_term string, owner_organisation_id long, target_dialect_id long").repartition(8, "mapping_id")
    named = spark.createDataFrame([("c", "t", 1, 5, 77)], "new_code string, new_term string, owner_organisation_id long, target_dialect_id long, destination_concept_id long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = log.with_destination(events, named).select("mapping_id", "destination_concept_id", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert {r.mapping_id: r.destination_concept_id for r in found} == {k: 77 if c and t and d else None for k, c, t, _, d in rows}
    unnamed = [r.part for r in found if r.destination_concept_id is None]
    assert max(map(unnamed.count, set(unnamed))) < len(unnamed) / 3
