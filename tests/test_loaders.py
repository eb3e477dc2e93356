from datetime import date, datetime

from pyspark.sql import functions as F

from termweave import schemas
from termweave.operators import dimensions as dim
from termweave.operators.mapping import fold_mappings
from termweave.plans import loaders
from termweave.runtime import ranked, small_table
from termweave.sources import readers, seeds, sinks

DAY = [datetime(2015, 1, d) for d in range(1, 10)]


def observations(spark):
    rows = [
        ("T1234015", "Skin", "M1", "Scar", "A1", DAY[0]),
        (" T1234015", "Skin", "M1", "Scar", "A1", DAY[3]),
        ("T1234015", "Skin", None, None, "B2", DAY[1]),
        ("M9", "Wrong axis", "T9", "Wrong axis", "C3", DAY[2]),
        ("T5", None, "Q1", "Odd", "AN4", DAY[2]),
        ("T5", None, "Q1", "Odd", "S5", DAY[2]),
    ]
    return spark.createDataFrame(rows, schemas.OBSERVATIONS)


def concept_rows(tables):
    view = loaders.concept_view(tables)
    return sorted(tuple(r) for r in view.select("code_text", "term_text", "obs_number", "first_obs_date", "last_obs_date").collect())


def test_observations_end_to_end_and_reload(spark):
    loader = loaders.LOADERS["VSSHP"]
    tables = loaders.load_organisation(seeds.empty_tables(spark), loader, observations(spark))
    expected = [
        ("M1", "Scar", 1, date(2015, 1, 1), date(2015, 1, 4)),
        ("Q1", "Odd", 1, date(2015, 1, 3), date(2015, 1, 3)),
        ("T12345", "Skin", 1, date(2015, 1, 4), date(2015, 1, 4)),
        ("T12345", "Skin", 2, date(2015, 1, 1), date(2015, 1, 2)),
        ("T5", "", 1, date(2015, 1, 3), date(2015, 1, 3)),
    ]
    # the two spellings of one code stay two rows, so the concept is repeated by its metadata
    assert concept_rows(tables) == expected
    assert [tuple(r) for r in tables["synonym"].select("synonym", "dialect_id").collect()] == [("T1234015", 1)]
    sizes = {name: tables[name].count() for name in ("code", "term", "concept", "synonym", "concept_metadata")}
    again = loaders.load_organisation(tables, loader, observations(spark))
    assert {name: again[name].count() for name in sizes} == sizes
    assert concept_rows(again) == expected


def test_second_organisation_shares_codes_and_terms(spark):
    tables = loaders.load_organisation(seeds.empty_tables(spark), loaders.LOADERS["VSSHP"], observations(spark))
    counts = spark.createDataFrame([(" M1 ", "Scar", 7), (None, "Blank", 1)], schemas.CODE_COUNTS["count"])
    both = loaders.load_organisation(tables, loaders.LOADERS["HUS"], counts)
    assert both["code"].count() == tables["code"].count() + 1
    assert both["term"].count() == tables["term"].count() + 1
    named = loaders.concept_view(both).filter("organisation_name = 'HUS'")
    assert sorted((r.code_text, r.term_text, r.obs_number) for r in named.collect()) == [("", "Blank", 1), ("M1", "Scar", 7)]
    ids = [r[0] for r in both["concept"].select("concept_id").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_year_and_span_layouts(spark):
    years = spark.createDataFrame(
        [("T1234567", "a", 1, 2, 3, 4), ("M1", "b", 1, None, 1, 1), (None, "c", 1, 1, 1, 1)], schemas.CODE_COUNTS["years"]
    )
    rows = loaders.stage(loaders.LOADERS["PSHP"], years).collect()
    assert sorted((r.code_harmonised, r.obs_number) for r in rows) == [("M1", None), ("T12345", 10)]
    open_day = datetime(2017, 12, 29)
    spans = spark.createDataFrame(
        [("T1 ", "a", DAY[1], DAY[2], 1), ("T1 ", "a", DAY[0], open_day, 2), ("T2", "b", DAY[0], DAY[1], 1)],
        schemas.CODE_COUNTS["span"],
    )
    oulu = {r.code_harmonised: r for r in loaders.stage(loaders.LOADERS["PPSHP"], spans).collect()}
    assert (oulu["T1 "].min_ts, oulu["T1 "].max_ts, oulu["T1 "].obs_number) == (DAY[0], None, 3)
    kuopio = {r.code_harmonised: r for r in loaders.stage(loaders.LOADERS["PSSHP"], spans).collect()}
    assert kuopio["T1 "].max_ts == open_day


def test_bridge_keeps_last_match_of_a_source(spark):
    rows = [
        ("T-1", "old", None, 10, None, None, "new a", "Match", None),
        ("T1 ", "old", None, 11, None, None, "new b", "Match", None),
        ("T-1", "old", None, 12, None, None, "new c", "Narrow", None),
        ("T-2", "lost", None, None, None, None, None, "Match", None),
    ]
    tables, events = loaders.load_bridge(seeds.empty_tables(spark), spark.createDataFrame(rows, schemas.BRIDGE), user_id=5)
    assert events.count() == 2
    assert {r.destination_dialect_id for r in events.collect()} == {None}
    none = events.limit(0).withColumn("valid", F.lit(True))
    valid = fold_mappings(none, events).filter("valid").collect()
    target = tables["concept"].join(tables["code"], "code_id").filter("code_text = '11'").first()
    assert [r.destination_concept_id for r in valid] == [target.concept_id]
    assert sorted(r.synonym for r in tables["synonym"].collect()) == ["T-1", "T-2"]
    # the bridge brings no counts; its concepts still show
    view = loaders.concept_view(tables).collect()
    assert len(view) == tables["concept"].count() and {r.concept_metadata_id for r in view} == {None}


def test_ranked_numbers_are_dense_and_in_order(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), (F.col("id") * 7919 % 5000).cast("string")).alias("k"))
    rows = ranked(df, F.col("k"), start=11).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(11, 5011))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_readers_and_sinks_round_trip(spark, tmp_path):
    path = sinks.write_staging(observations(spark), "observations", str(tmp_path / "obs"))
    assert readers.read_observations(spark, path).count() == 6
    out = sinks.export(spark.createDataFrame([(1, "a")], "id int, name string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(out).collect()[0].asDict() == {"id": "1", "name": "a"}
    counts = spark.createDataFrame([("c", "t", 3)], schemas.CODE_COUNTS["count"])
    csv = sinks.export(counts, str(tmp_path / "counts"))
    assert readers.read_code_counts(spark, csv, "count", fmt="csv").collect()[0].n == 3


def test_seeds_and_resolution(spark):
    tables = seeds.seed_dimensions(spark)
    assert tables["organisation"].count() == 8 and tables["dialect"].count() == 8
    found = spark.range(1).select(
        dim.dialect_id(tables["dialect"], tables["code_system"], "HUS dialect", "Snomed II").alias("d"),
        dim.dialect_id(tables["dialect"], tables["code_system"], "HUS dialect", "Snomed CT").alias("none"),
        dim.dialect_id(tables["dialect"], tables["code_system"], "International Snomed CT").alias("by_name"),
        dim.organisation_id(tables["organisation"], "HUS").alias("o"),
    ).first()
    assert (found.d, found.none, found.by_name, found.o) == (6, None, 2, 6)


def test_deleting_concepts_deletes_their_metadata(spark):
    concept = small_table(spark, [(1, 1, 1, 1, 1), (2, 2, 2, 1, 1)], schemas.TABLES["concept"])
    metadata = small_table(spark, [(1, 1, 5, None, None), (2, 2, 6, None, None)], schemas.TABLES["concept_metadata"])
    kept, left = dim.delete_concepts(concept, metadata, spark.createDataFrame([(1,)], "concept_id long"))
    assert [r.concept_id for r in kept.collect()] == [2]
    assert [r.concept_metadata_id for r in left.collect()] == [2]


def test_lines_are_counted_after_one_shuffle(spark, tmp_path):
    """Lines are dealt by part and counted there: no table of distinct orders is kept before the shuffle."""
    import datetime as dt

    from termweave.plans import fixtures as fx

    day = lambda k: dt.datetime(2020, 1, k)
    rows = [(1, "O", 5, day(2)), (1, "O", 5, day(4)), (1, "O", 6, day(1)), (1, "O", 6, day(1)), (1, "F", None, day(3)), (2, None, 7, None), (None, "O", 8, day(9))]
    spark.createDataFrame(rows, "l_partkey long, l_linestatus string, l_orderkey long, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    table = fx.concept_metadata.__wrapped__.__wrapped__(spark, str(tmp_path))
    assert table._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    found = {(r.concept_id, r.concept_metadata_id, r.obs_number, r.first_obs_date and r.first_obs_date.day, r.last_obs_date and r.last_obs_date.day) for r in table.collect()}
    assert found == {(1, 3, 2, 1, 4), (1, 2, 0, 3, 3), (2, 4, 1, None, None), (None, None, 1, 9, 9)}
