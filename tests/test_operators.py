import pytest
from pyspark.sql import functions as F

from termweave.operators import candidates as cand
from termweave.operators import constraints as con
from termweave.operators import hierarchy as hier
from termweave.operators import integrity
from termweave.operators import tableops as tab
from termweave.operators import terminology as term
from termweave.operators import worklist as wl
from termweave.schemas import IS_A


def ids(df):
    return sorted(r[0] for r in df.collect())


# --- table operators


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(i, i % 3, f"Name {i}") for i in range(10)], "id int, g int, name string").cache()


@pytest.mark.parametrize("start,length,expected", [(0, 3, [0, 1, 2]), (8, 5, [8, 9]), (10, 5, []), (4, -1, list(range(10))), (0, 10, list(range(10)))])
def test_page(numbers, start, length, expected):
    assert [r.id for r in tab.page(numbers, [F.col("id")], start, length).collect()] == expected


def test_deep_page_uses_row_numbers(spark):
    df = spark.range(30_000)
    rows = tab.page(df, [F.col("id").desc()], 15_000, 5).collect()
    assert [r.id for r in rows] == [14_999, 14_998, 14_997, 14_996, 14_995]


def test_last_sort_key_is_primary(numbers):
    rows = tab.table_sort(numbers, [("id", "desc"), ("g", "asc")], ["id"]).collect()
    assert [r.id for r in rows] == [9, 6, 3, 0, 7, 4, 1, 8, 5, 2]


def test_search(numbers):
    assert ids(tab.search_rows(numbers, "NAME [12]", ["name"])) == [1, 2]
    assert tab.search_rows(numbers, "", ["name"]).count() == 10
    totals = tab.search_totals(numbers, "name 1", ["name"]).first()
    assert (totals.total_records, totals.total_display_records) == (10, 1)
    umlaut = numbers.limit(1).select(F.lit("Lähde").alias("name"))
    assert tab.search_rows(umlaut, "LÄHDE", ["name"]).count() == 1


# --- work lists


def test_progress_of_an_empty_list_is_zero(spark):
    empty = spark.createDataFrame([], "status string, term_counts long, samp_counts long")
    row = wl.progress_summary(empty).first()
    assert row.total_concepts == 0 and row.self_concepts_percent == 0.0 and row.mapped_samples == 0


def test_progress_summary_uses_samples_for_every_status(spark):
    counts = spark.createDataFrame(
        [("self", 1, 10), ("other_organisation", 2, 30), (None, 1, None)], "status string, term_counts long, samp_counts long"
    )
    row = wl.progress_summary(counts).first()
    assert (row.other_organisation_samples, row.total_samples, row.mapped_concepts) == (30, 40, 3)
    assert row.other_organisation_samples_percent == 75.0


@pytest.fixture(scope="module")
def small_lists(spark):
    concepts = spark.createDataFrame(
        [(i, code, text, dialect, None, None, None) for i, code, text, dialect in [
            (1, "A", "x", 1), (2, "a", "X", 2), (3, "B", "y", 1), (4, "b", "Y", 2), (5, "C", "z", 1), (6, "D", "w", 1), (7, "D", "x", 1),
        ]],
        "concept_id long, code_text string, term_text string, dialect_id long, obs_number int, first_obs_date date, last_obs_date date",
    )
    names = {r.concept_id: (r.code_text, r.term_text) for r in concepts.collect()}

    def mapping(i, source, user, organisation, event, code="K", valid=True, dialect=9):
        return (i, valid, source, dialect, user, organisation, *names[source], event, code, "term", "Last", "First", "Org", None)

    mappings = spark.createDataFrame(
        [
            mapping(1, 1, 100, 1, "User mapping"),
            mapping(2, 2, 200, 2, "User mapping", code="OTHER"),
            mapping(3, 4, 200, 2, "Bridge mapping"),
            mapping(4, 5, 101, 1, "Incorrect concept", code=None),
            mapping(5, 6, 100, 1, "User mapping", dialect=8),
            mapping(6, 6, 100, 1, "User mapping", valid=False),
        ],
        "mapping_id long, valid boolean, source_concept_id long, destination_dialect_id long, user_id long, organisation_id long, "
        "source_code_text string, source_term_text string, event_type_name string, destination_code_text string, "
        "destination_term_text string, last_name string, first_name string, organisation_name string, insert_ts timestamp_ntz",
    )
    viewers = spark.createDataFrame([(100, 1, 1, 9)], "user_id long, organisation_id long, source_dialect_id long, target_dialect_id long")
    notes = spark.createDataFrame([(100, 3, "mine"), (101, 1, "theirs")], "user_id long, concept_id long, note string")
    return wl.concept_worklist(concepts, mappings, viewers, notes).cache()


def test_worklist_status(small_lists):
    rows = {r.source_concept_id: r for r in small_lists.collect()}
    status = {k: r.status for k, r in rows.items()}
    assert status == {1: "self", 3: "bridge", 5: "own_organisation", 6: None, 7: None}
    assert rows[1].destination_code_text == "K" and rows[3].user_concept_note == "mine"
    assert rows[1].user_concept_note is None and rows[1].mapping_user == "Last, F (Org)"


def test_next_step_and_rejection(small_lists):
    rows = {r.source_concept_id: (r.next_step, r.rejected) for r in wl.next_step(small_lists).collect()}
    assert rows == {
        1: ("history", False), 3: ("candidates", False), 5: ("history", True), 6: ("free_mapping", False), 7: ("free_mapping", False),
    }


def test_similar_rows_share_code_or_term_but_not_both(spark, small_lists):
    pages = spark.createDataFrame([(100, 7, "D", "x")], "user_id long, page_concept_id long, code_text string, term_text string")
    found = wl.similar_concepts(small_lists, pages, ["user_id"])
    assert ids(found.select("source_concept_id")) == [1, 6]
    counts = {(r.code_text, r.term_text): (r.same_code, r.same_term) for r in wl.similar_counts(small_lists, ["user_id"]).collect()}
    assert counts[("D", "x")] == (1, 1) and counts[("B", "y")] == (0, 0)


# --- candidates


def test_exact_candidates_ignore_case_and_blank_destinations(spark):
    mappings = spark.createDataFrame(
        [
            (1, "a", "X", "K", "k", "d", "Org B", 50),
            (1, "A", "x", "K", "k", "d", "Org A", 60),
            (1, "A", "x", "", "k", "d", "Org A", 61),
            (1, "A", "x", None, None, "d", "Org A", None),
            (2, "A", "x", "L", "l", "d", "Org A", 62),
        ],
        "source_code_system_id long, source_code_text string, source_term_text string, destination_code_text string, "
        "destination_term_text string, destination_dialect_name string, organisation_name string, destination_concept_id long",
    )
    concepts = spark.createDataFrame([(7, "A", "X", 1), (8, "A", "q", 1)], "concept_id long, code_text string, term_text string, code_system_id long")
    exact = cand.candidates_exact(concepts, mappings).collect()
    assert [(r.concept_id, r.organisation_name, r.destination_concept_id) for r in exact] == [(7, "Org A", 60)]
    loose = {(r.concept_id, r.organisation_name): r.destination_concept_id for r in cand.candidates_any(concepts, mappings).collect()}
    assert loose == {(7, "Org A"): 60, (7, "Org B"): 50, (8, "Org A"): 60} or loose == {(7, "Org A"): 60, (8, "Org A"): 60, (7, "Org B"): 50}
    assert [r.concept_id for r in cand.single_candidates(cand.candidates_exact(concepts, mappings)).collect()] == [7]


# --- hierarchy and constraints


@pytest.fixture(scope="module")
def graph(spark):
    pairs = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("x", "y"), ("y", "x")]
    return spark.createDataFrame(pairs, "child string, parent string").cache()


def of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "concept_id string")


def test_descendants_and_ancestors(spark, graph):
    assert ids(hier.descendants_of(graph, of(spark, "a"))) == ["b", "c", "d", "e"]
    assert ids(hier.descendants_of(graph, of(spark, "b"), include_self=True)) == ["b", "d", "e"]
    assert ids(hier.ancestors_of(graph, of(spark, "e"))) == ["a", "b", "c", "d"]
    assert ids(hier.descendants_of(graph, of(spark, "x"))) == ["x", "y"]
    assert ids(hier.descendants_of(graph, of(spark, "e"))) == []


def test_descendants_below_two_parents_count_once(graph):
    counts = {r.concept_id: r.descendants for r in hier.descendant_counts(graph).collect()}
    assert counts == {"a": 4, "b": 2, "c": 2, "d": 1, "e": 0, "x": 1, "y": 1}


def test_views_and_activity(spark):
    rel = spark.createDataFrame(
        [("1", IS_A, "0", True, "stated"), ("1", "9", "5", True, "stated"), ("1", "9", "6", False, "stated"), ("1", IS_A, "2", True, "inferred")],
        "source string, type string, target string, active boolean, view string",
    )
    parents, attributes = hier.split_relationships(rel, "stated")
    assert [r.target for r in parents.collect()] == ["0"] and [r.target for r in attributes.collect()] == ["5"]


def test_combine(spark):
    a, b, c = of(spark, "1", "2", "3"), of(spark, "2", "3", "4"), of(spark, "3")
    assert ids(con.combine([[a, b]])) == ["2", "3"]
    assert ids(con.combine([[a], [b]], [[c]])) == ["1", "2", "4"]
    assert ids(con.combine([[a], [b]], [[a, c], [of(spark, "4")]])) == ["1", "2"]


# --- terminology


def test_definition_text(spark):
    concepts = spark.createDataFrame([("1", True), ("2", False), ("3", False)], "concept_id string, fully_defined boolean")
    rel = spark.createDataFrame(
        [
            ("1", IS_A, "is a", "10", "Alpha", 0), ("1", IS_A, "is a", "11", "Beta", 0),
            ("1", "5", "site", "20", "Heart", 1), ("1", "6", "kind", "21", "Wall", 1), ("1", "5", "site", "22", "Lung", 0),
            ("2", "5", "site", "20", "Heart", 2),
        ],
        "source string, type string, type_name string, target string, target_name string, group_id int",
    )
    texts = {r.concept_id: r.text for r in term.definition_expression(concepts, rel).filter("part = 0").collect()}
    assert texts["1"] == "=== 10 |Alpha| + 11 |Beta| : 5 |site| = 22 |Lung| { 5 |site| = 20 |Heart|, 6 |kind| = 21 |Wall| }"
    assert texts["2"] == "<<< : { 5 |site| = 20 |Heart| }"
    assert texts["3"] == "<<< "
    parts = sorted(term.definition_expression(concepts, rel, part_pieces=2).collect())
    assert [(r.concept_id, r.part) for r in parts] == [("1", 0), ("1", 1), ("1", 2), ("2", 0), ("3", 0)]
    assert "".join(r.text for r in parts if r.concept_id == "1") == texts["1"]


def test_very_long_definition_keeps_every_piece(spark):
    concepts = spark.createDataFrame([("1", True)], "concept_id string, fully_defined boolean")
    name = F.format_string("n%05d", "id")
    rel = spark.range(10_500).select(
        F.lit("1").alias("source"), F.lit("5").alias("type"), F.lit("site").alias("type_name"),
        F.col("id").cast("string").alias("target"), name.alias("target_name"), F.lit(1).alias("group_id"),
    )
    parts = sorted(term.definition_expression(concepts, rel).collect())
    assert [r.part for r in parts] == list(range(11))
    want = ", ".join(f"5 |site| = {k} |n{k:05d}|" for k in range(10_500))
    assert "".join(r.text for r in parts) == "=== : { " + want + " }"


def test_phrases_under_three_characters_find_nothing(spark):
    df = spark.createDataFrame([(1, 1, "on the heart")], "description_id long, concept_id long, term string")
    assert term.search_descriptions(df, "on").count() == 0
    assert term.search_descriptions(df, "(heart) ON").count() == 1
    assert term.search_descriptions(df, "^on.*rt$", mode="regex").count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_descendant_counts_of_any_graph(spark, seed):
    import random

    rng = random.Random(seed)
    edges = {(k, rng.randrange(max(1, k - 6), k)) for k in range(2, 40)}
    edges |= {(rng.randrange(1, 40), rng.randrange(1, 40)) for _ in range(4 * seed)}  # shared children, cycles, loops
    below = {n: set() for e in edges for n in e}
    for n in below:
        stack = [n]
        while stack:
            at = stack.pop()
            fresh = {c for c, p in edges if p == at} - below[n]
            below[n] |= fresh
            stack += fresh
    found = hier.descendant_counts(spark.createDataFrame([*edges, *edges], "child long, parent long"))
    assert {r.concept_id: r.descendants for r in found.collect()} == {n: len(x - {n}) for n, x in below.items()}
    left, _, folded = hier.fold_leaves(spark.createDataFrame([*edges], "child long, parent long"))
    assert seed or (left.count() == 0 and folded.count() == len(below) - 1)


def test_childless_nodes_stay_out_of_the_closure(spark, monkeypatch):
    """Leaves of several parents are joined to the ancestors above, on a cycle and with a parent above another one too."""
    edges = [("s1", "n1"), ("s2", "n1"), ("s3", "n2"), ("n1", "r"), ("n2", "r"), ("r", "n2")]
    edges += [(f"p{k}", s) for k in range(20) for s in ("s1", "s2", "s3", "n1")] + [(None, "s1"), ("s1", None), ("b", "p0")]
    seen, whole = [], hier.closure
    monkeypatch.setattr(hier, "closure", lambda e: seen.append(e.count()) or whole(e))
    found = hier.descendant_counts(spark.createDataFrame(edges, "child string, parent string"))
    counts = {r.concept_id: r.descendants for r in found.collect()}
    assert {k: counts[k] for k in ("s1", "s3", "n1", "n2", "r", "p0", "p1", "b")} == {"s1": 21, "s3": 21, "n1": 23, "n2": 26, "r": 26, "p0": 1, "p1": 0, "b": 0}
    assert max(seen) <= 7


def test_descendant_counts_of_no_edges(spark):
    assert hier.descendant_counts(spark.createDataFrame([], "child long, parent long")).count() == 0


def test_newest_of_destination_goes_on_from_its_cursor(spark):
    import datetime as dt

    schema = """mapping_id long, valid boolean, source_concept_id long, destination_concept_id long, insert_ts timestamp, last_name string, first_name string,
      organisation_name string, source_code_text string, source_term_text string, event_type_name string, comment string,
      source_concept_metadata_id long, destination_concept_metadata_id long"""
    at = lambda k: None if k == 3 else dt.datetime(2020, 1, 1 + k // 2)
    rows = [(k, k != 5, k, 7 if k < 9 else None if k == 9 else 8, at(k), "L", "F", "O", "c", "t", "e", None, m, None) for k in range(12) for m in ((None, 2) if k == 4 else (1,))]
    df = spark.createDataFrame(rows, schema)
    order = sorted((r for r in rows if r[1] and r[3] == 7), key=lambda r: (r[4] or dt.datetime.min, r[0], -(r[12] or -1)), reverse=True)
    seen, after = [], None
    while True:
        got = cand.newest_of_destination(df, 3, after=after).filter("destination_concept_id = 7").orderBy("position")
        part = [(r.mapping_id, r.position) for r in got.collect()]
        if not part:
            break
        assert [p for _, p in part] == list(range(1, len(part) + 1))
        seen, after = seen + [m for m, _ in part], got
    assert seen == [r[0] for r in order]
    asked = spark.createDataFrame([(10,), (5,), (99,)], "concept_id long")
    assert {r.destination_concept_id for r in cand.newest_of_destination(df, 3, concepts=asked).collect()} == {8}
    plan = cand.newest_of_destination(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle


def test_index_finds_what_the_scan_finds(spark):
    terms = ["On the Heart", "heart", "the  the\nhearty", None, "", "art of the (heart)", "ÉTÉ heart\u00a0the", "x"]
    df = spark.createDataFrame([(k, k // 2, t) for k, t in enumerate(terms)], "description_id long, concept_id long, term string")
    index = term.term_index(df)
    assert {r.token: r.descriptions for r in index.vocabulary.collect()}["heart"] == 2
    for phrase in ("heart", "(heart) THE", "the the", "été", "   ", "he", "", "none of it", "\u00a0the"):
        for grouped in (False, True):
            want = ids(term.search_descriptions(df, phrase, group_by_concept=grouped).select("description_id"))
            assert ids(term.search_descriptions(df, phrase, group_by_concept=grouped, index=index).select("description_id")) == want, phrase
    empty = term.term_index(df.limit(0))
    assert term.search_descriptions(df.limit(0), "heart", index=empty).count() == 0


def test_search_in_a_reference_set(spark):
    df = spark.createDataFrame([(1, 1, "the heart"), (2, 2, "the heart"), (3, None, "the heart")], "description_id long, concept_id long, term string")
    refsets = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "refset_id string, concept_id long")
    for index in (None, term.term_index(df)):
        found = term.search_descriptions(df, "heart", index=index, refset=con.members_of(refsets, "a"))
        assert [tuple(r) for r in found.select(*df.columns).collect()] == [(1, 1, "the heart")]
        assert term.search_descriptions(df, "heart", index=index, refset=con.members_of(refsets, "c")).count() == 0


def test_facets_have_names_where_known(spark):
    counts = spark.createDataFrame([("refset", "a", 2), ("refset", "b", 1), ("lang", "a", 3)], "facet string, value string, matches long")
    names = spark.createDataFrame([("refset", "a", "Z"), ("refset", "a", "A"), ("lang", "b", "B")], "facet string, value string, default_term string")
    assert sorted(tuple(r) for r in term.name_facets(counts, names).collect()) == [("lang", "a", 3, None), ("refset", "a", 2, "A"), ("refset", "b", 1, None)]


def test_members_page_past_the_end(spark):
    members = spark.createDataFrame([("r", i) for i in range(5)], "refset_id string, concept_id long")
    rows = term.members_page(members, "r", 3, 10).collect()
    assert [(r.concept_id, r.total, r.remaining, r.next_size) for r in rows] == [(3, 5, 0, 0), (4, 5, 0, 0)]
    assert [r.remaining for r in term.members_page(members, "r", 0, 2).collect()] == [3, 3]


# --- integrity


def test_audit_counts_each_kind_of_violation(spark):
    tables = {
        "term": spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "term_id long, term_text string"),
        "code": spark.createDataFrame([(1, "c")], "code_id long, code_text string"),
        "synonym": spark.createDataFrame([(1, 1, "s", 1), (2, 9, "s", 1), (3, 9, "s", 1)], "synonym_id long, code_id long, synonym string, dialect_id long"),
    }
    report = {(r.rule, r.table_name, r.columns): r.violations for r in integrity.audit(tables).collect()}
    assert report[("unique", "term", "term_text")] == 1
    assert report[("not_null", "term", "term_text")] == 1
    assert report[("foreign_key", "synonym", "code_id")] == 2
    assert report[("unique", "synonym", "code_id,synonym")] == 1
    assert report[("unique", "code", "code_text")] == 0


def test_audit_takes_empty_tables_and_dangling_parents(spark):
    tables = {
        "code": spark.createDataFrame([], "code_id long, code_text string"),
        "synonym": spark.createDataFrame([(1, 9, "s", None), (1, None, None, 2)], "synonym_id int, code_id int, synonym string, dialect_id long"),
    }
    report = {(r.rule, r.table_name, r.columns): r.violations for r in integrity.audit(tables).collect()}
    assert report[("foreign_key", "synonym", "code_id")] == 1 and ("foreign_key", "synonym", "dialect_id") not in report
    assert report[("unique", "synonym", "synonym_id")] == 1 and report[("unique", "synonym", "code_id,synonym")] == 0
    assert [report[("not_null", "synonym", c)] for c in ("synonym_id", "code_id", "synonym", "dialect_id")] == [0, 1, 1, 1]
    assert report[("not_null", "code", "code_text")] == report[("unique", "code", "code_text")] == 0


def test_each_table_is_scanned_once_for_the_audit(spark, tmp_path):
    for name, schema in (("code", "code_id long, code_text string"), ("synonym", "synonym_id long, code_id long, synonym string, dialect_id long")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    tables = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("code", "synonym")}
    plan = integrity.audit(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2
