"""Queries over sources, harmonisation, staging and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators import dimensions as dim
from termweave.operators import mapping as log
from termweave.operators import staging as stg
from termweave.plans import fixtures as fx
from termweave.plans import loaders
from termweave.plans.registry import query
from termweave.sources import readers, seeds, sinks

RAW = "code, term, sample_number, sampled_at, organisation_id"


def _counts_raw(spark, sf_dir, layout):
    """Raw observations as one of the pre-aggregated layouts."""
    raw = fx.raw_observations(spark, sf_dir)
    year = F.year("sampled_at")
    if layout == "years":
        columns = [F.count_if(year == 1998 + i).cast("int").alias(name) for i, name in enumerate(loaders.YEARS)]
        return raw.groupBy("code", "term").agg(*columns)
    if layout == "count":
        return raw.groupBy("code", "term").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return raw.groupBy("code", "term", "organisation_id").agg(
        F.min("sampled_at").alias("started_at"),
        F.max("sampled_at").alias("ended_at"),
        F.count(F.lit(1)).cast("int").alias("n"),
    ).drop("organisation_id")


YEAR_SQL = ", ".join(
    f"CAST(count(*) FILTER (WHERE year(sampled_at) = {1998 + i}) AS INTEGER) AS {name}"
    for i, name in enumerate(loaders.YEARS)
)
SPAN_SQL = """SELECT code, term, min(sampled_at) AS started_at, max(sampled_at) AS ended_at, CAST(count(*) AS INTEGER) AS n
  FROM raw_obs GROUP BY code, term, organisation_id"""


# --- sources and sinks ----------------------------------------------------------------------


@query(
    "observations_scan",
    "raw_obs",
    sql="""SELECT CASE WHEN trim(code) LIKE 'T%' THEN code END AS t_code, CASE WHEN NOT trim(code) LIKE 'T%' THEN code END AS m_code,
       count(*) AS n, count(DISTINCT sample_number) AS samples, min(sampled_at) AS first_ts, max(sampled_at) AS last_ts
  FROM raw_obs GROUP BY 1, 2""",
)
def observations_scan(spark, sf_dir):
    path = sinks.write_staging(fx.two_column_observations(spark, sf_dir), "observations")
    return readers.read_observations(spark, path).groupBy("t_code", "m_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("sample_number").alias("samples"),
        F.min("sampled_at").alias("first_ts"),
        F.max("sampled_at").alias("last_ts"),
    )


@query("year_counts_scan", "raw_obs", sql=f"SELECT code, term, {YEAR_SQL} FROM raw_obs GROUP BY code, term")
def year_counts_scan(spark, sf_dir):
    path = sinks.write_staging(_counts_raw(spark, sf_dir, "years"), "years")
    return readers.read_code_counts(spark, path, "years")


@query(
    "code_counts_scan",
    "raw_obs",
    sql="SELECT code, term, CAST(count(*) AS INTEGER) AS n FROM raw_obs GROUP BY code, term",
)
def code_counts_scan(spark, sf_dir):
    path = sinks.write_staging(_counts_raw(spark, sf_dir, "count"), "counts")
    return readers.read_code_counts(spark, path, "count")


@query("span_counts_scan", "raw_obs", sql=SPAN_SQL)
def span_counts_scan(spark, sf_dir):
    path = sinks.write_staging(_counts_raw(spark, sf_dir, "span"), "spans")
    return readers.read_code_counts(spark, path, "span")


@query(
    "bridge_scan",
    "bridge_raw",
    sql="SELECT code2, nomen2, class2, conceptid, descriptionid, term, type FROM bridge_raw",
)
def bridge_scan(spark, sf_dir):
    path = sinks.write_staging(fx.bridge_rows(spark, sf_dir), "bridge")
    return readers.read_bridge(spark, path).drop("snomedid", "additional_code")


@query(
    "staging_rebuild",
    "staged_obs",
    sql="SELECT code_original, term_text, min_ts, max_ts, obs_number, code_harmonised FROM staged_obs",
)
def staging_rebuild(spark, sf_dir):
    """Staged rows of both axes, written once and read back."""
    staged = loaders.stage_observations(fx.two_column_observations(spark, sf_dir))
    return spark.read.parquet(sinks.write_staging(staged, "staged"))


@query("export_members", "member", sql="SELECT refset_id, concept_id FROM member")
def export_members(spark, sf_dir):
    """The complete membership list as CSV, read back."""
    from termweave.runtime import staging_path

    path = sinks.export(fx.customer_refsets(spark, sf_dir), staging_path(spark, "members"))
    return spark.read.option("header", True).schema("refset_id string, concept_id string").csv(path)


# --- projections and filters ----------------------------------------------------------------


@query(
    "clean_text",
    "part_code",
    sql="SELECT p_partkey, coalesce(trim(code_raw), '') AS code_raw, coalesce(trim(p_name), '') AS p_name FROM part_code",
)
def clean_text(spark, sf_dir):
    return stg.clean_text(fx.part_codes(spark, sf_dir), ["code_raw", "p_name"]).select("p_partkey", "code_raw", "p_name")


@query(
    "harmonise_overlay",
    "part_code",
    sql=f"""SELECT p_partkey, {fx.OVERLAY_SQL["T"].format("code_raw")} AS t_code, {fx.OVERLAY_SQL["M"].format("code_raw")} AS m_code
  FROM part_code""",
)
def harmonise_overlay(spark, sf_dir):
    parts = stg.harmonise_overlay(fx.part_codes(spark, sf_dir), "code_raw", "T", "12", out="t_code")
    return stg.harmonise_overlay(parts, "code_raw", "M", "1234", out="m_code").select("p_partkey", "t_code", "m_code")


@query(
    "harmonise_prefix",
    "part_code",
    sql="SELECT p_partkey, substr(trim(code_raw), 1, 6) AS code_harmonised FROM part_code",
)
def harmonise_prefix(spark, sf_dir):
    return stg.harmonise_prefix(fx.part_codes(spark, sf_dir), "code_raw").select("p_partkey", "code_harmonised")


@query("harmonise_strip", "bridge", sql="SELECT code2, code_harmonised, nomen2, conceptid FROM bridge")
def harmonise_strip(spark, sf_dir):
    stripped = stg.harmonise_strip(fx.bridge_rows(spark, sf_dir), "code2")
    return stg.cast_columns(stripped, {"conceptid": "string"}).select("code2", "code_harmonised", "nomen2", "conceptid")


@query(
    "harmonise_identity",
    "part_code",
    sql="SELECT p_partkey, coalesce(trim(code_raw), '') AS trimmed, code_raw AS raw FROM part_code",
)
def harmonise_identity(spark, sf_dir):
    parts = stg.harmonise_identity(fx.part_codes(spark, sf_dir), "code_raw", out="trimmed")
    return stg.harmonise_identity(parts, "code_raw", trimmed=False, out="raw").select("p_partkey", "trimmed", "raw")


@query(
    "split_axis",
    "part_code",
    sql="""SELECT 't' AS rule, p_partkey FROM part_code WHERE regexp_matches(code_raw, '^T', 'i')
  UNION ALL SELECT 'not_t', p_partkey FROM part_code WHERE NOT regexp_matches(code_raw, '^T', 'i')
  UNION ALL SELECT 't_column', p_partkey FROM part_code WHERE NOT regexp_matches(code_raw, '^M', 'i')
  UNION ALL SELECT 'm_column', p_partkey FROM part_code WHERE NOT regexp_matches(code_raw, '^T', 'i')""",
)
def split_axis(spark, sf_dir):
    parts = fx.part_codes(spark, sf_dir)
    rules = [
        stg.split_axis(parts, "code_raw", rule).select(F.lit(rule).alias("rule"), "p_partkey")
        for rule in ("t", "not_t", "t_column", "m_column")
    ]
    return rules[0].unionByName(rules[1]).unionByName(rules[2]).unionByName(rules[3])


@query(
    "filter_samples",
    "raw_obs",
    sql="""SELECT sample_number, count(*) AS n FROM raw_obs WHERE regexp_matches(sample_number, '^[ABCDNRSYK][^N]', 'i')
  GROUP BY sample_number""",
)
def filter_samples(spark, sf_dir):
    raw = fx.raw_observations(spark, sf_dir)
    return stg.filter_samples(raw, "sample_number").groupBy("sample_number").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sum_years",
    "raw_obs",
    sql=f"""SELECT code, term, y1 + y2 + y3 + y4 AS obs_number FROM (
    SELECT code, term, nullif(count_in_2014, 0) AS y1, count_in_2015 AS y2, count_in_2016 AS y3, count_in_2017 AS y4
      FROM (SELECT code, term, {YEAR_SQL} FROM raw_obs GROUP BY code, term))""",
)
def sum_years(spark, sf_dir):
    years = _counts_raw(spark, sf_dir, "years").withColumn("count_in_2014", F.nullif("count_in_2014", F.lit(0)))
    return stg.sum_years(years, loaders.YEARS).select("code", "term", "obs_number")


@query(
    "null_sentinel",
    "raw_obs",
    sql="""SELECT code, term, n, CASE WHEN ended_at <> (SELECT max(sampled_at) FROM raw_obs) THEN ended_at END AS ended_at
  FROM (SELECT code, term, max(sampled_at) AS ended_at, count(*) AS n FROM raw_obs GROUP BY code, term)""",
)
def null_sentinel(spark, sf_dir):
    """The latest date of the data stands for "still in use"."""
    raw = fx.raw_observations(spark, sf_dir)
    ended = raw.groupBy("code", "term").agg(F.max("sampled_at").alias("ended_at"), F.count(F.lit(1)).alias("n"))
    sentinel = raw.agg(F.max("sampled_at")).first()[0]
    return stg.null_sentinel(ended, "ended_at", str(sentinel))


@query(
    "cast_columns",
    sql="SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders",
)
def cast_columns(spark, sf_dir):
    orders = fx.given(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return stg.cast_columns(orders, {"o_orderkey": "string", "o_orderdate": "date"})


@query(
    "bridge_matches",
    "bridge",
    sql="""SELECT code_harmonised, nomen2, conceptid, term FROM bridge
  WHERE conceptid IS NOT NULL AND term IS NOT NULL AND type = 'Match'""",
)
def bridge_matches(spark, sf_dir):
    bridge = stg.harmonise_strip(fx.bridge_rows(spark, sf_dir), "code2")
    return stg.cast_columns(stg.bridge_matches(bridge), {"conceptid": "string"}).select(
        "code_harmonised", "nomen2", "conceptid", "term"
    )


# --- staging --------------------------------------------------------------------------------


@query(
    "profile_observations",
    "raw_obs",
    sql="""SELECT organisation_id, coalesce(trim(code), '') AS code_original, coalesce(trim(term), '') AS term_text,
       min(sampled_at) AS min_ts, max(sampled_at) AS max_ts, count(DISTINCT sample_number) AS obs_number,
       substr(trim(code), 1, 6) AS code_harmonised
  FROM raw_obs WHERE regexp_matches(sample_number, '^[ABCDNRSYK][^N]', 'i') GROUP BY organisation_id, code, term""",
)
def profile_observations(spark, sf_dir):
    """Profile per organisation, harmonised by prefix; codes that are missing stay NULL."""
    samples = stg.filter_samples(fx.raw_observations(spark, sf_dir), "sample_number")
    return stg.profile_observations(samples, fn.prefix_code(F.col("code")), keys=["organisation_id"])


@query(
    "profile_counts",
    "raw_obs",
    sql=f"""SELECT code, term, min(started_at) AS min_ts, max(ended_at) AS max_ts, CAST(sum(n) AS BIGINT) AS obs_number
  FROM ({SPAN_SQL}) GROUP BY code, term""",
)
def profile_counts(spark, sf_dir):
    return stg.profile_counts(_counts_raw(spark, sf_dir, "span"))


@query(
    "distinct_codes",
    "staged_obs",
    sql="SELECT DISTINCT code_harmonised AS code_text FROM staged_obs",
)
def distinct_codes(spark, sf_dir):
    staged = loaders.stage_observations(fx.two_column_observations(spark, sf_dir))
    return dim.distinct_values(staged, "code_harmonised", "code_text")


@query(
    "union_axes",
    "raw_obs",
    sql="SELECT DISTINCT coalesce(trim(code), '') AS code_text, coalesce(trim(term), '') AS term_text FROM raw_obs",
)
def union_axes(spark, sf_dir):
    raw = fx.raw_observations(spark, sf_dir)
    is_t = F.coalesce(F.trim("code").startswith("T"), F.lit(False))
    return dim.union_axes(
        dim.clean_pairs(raw.filter(is_t), "code", "term"), dim.clean_pairs(raw.filter(~is_t), "code", "term")
    )


# --- dimensions -----------------------------------------------------------------------------


@query(
    "upsert_codes",
    "part_code",
    sql="""SELECT row_number() OVER (ORDER BY NOT known, code_text) AS code_id, code_text FROM (
    SELECT trim(code_raw) AS code_text, bool_or(p_type = 'ECONOMY') AS known FROM part_code WHERE code_raw IS NOT NULL GROUP BY 1)""",
)
def upsert_codes(spark, sf_dir):
    """Two loads: the second keeps the ids of the first and numbers new codes after them, in code order."""
    parts = fx.part_codes(spark, sf_dir).withColumn("code_text", F.trim("code_raw"))
    first = dim.upsert_codes(seeds.empty_tables(spark)["code"], parts.filter("p_type = 'ECONOMY'"))
    return dim.upsert_codes(first, parts)


@query(
    "upsert_terms",
    sql="""SELECT row_number() OVER (ORDER BY term_text) AS term_id, term_text
  FROM (SELECT DISTINCT p_name || ' ' || p_type AS term_text FROM part)""",
)
def upsert_terms(spark, sf_dir):
    texts = fx.given(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_type").alias("term_text"))
    return dim.upsert_terms(seeds.empty_tables(spark)["term"], texts)


def _loaded(spark, sf_dir, organisation="VSSHP"):
    loader = loaders.LOADERS[organisation]
    raw = {
        "observations": fx.two_column_observations,
        "years": lambda s, d: _counts_raw(s, d, "years"),
        "count": lambda s, d: _counts_raw(s, d, "count"),
        "span": lambda s, d: _counts_raw(s, d, "span"),
    }[loader.layout](spark, sf_dir)
    return loaders.load_organisation(seeds.empty_tables(spark), loader, raw)


def _named(tables):
    return tables["concept"].join(tables["code"], "code_id").join(tables["term"], "term_id")


@query(
    "upsert_concepts",
    "staged_obs",
    sql="""SELECT row_number() OVER (ORDER BY code_id, term_id) AS concept_id, code_id, term_id, code_text, term_text,
       CAST(1 AS BIGINT) AS organisation_id, CAST(1 AS BIGINT) AS dialect_id FROM (
    SELECT DISTINCT code_harmonised AS code_text, term_text, dense_rank() OVER (ORDER BY code_harmonised) AS code_id,
           dense_rank() OVER (ORDER BY term_text) AS term_id FROM staged_obs)""",
)
def upsert_concepts(spark, sf_dir):
    """Codes, terms and concepts of one organisation, ids included."""
    named = _named(_loaded(spark, sf_dir))
    return named.select("concept_id", "code_id", "term_id", "code_text", "term_text", "organisation_id", "dialect_id")


@query(
    "load_synonyms",
    "staged_obs",
    sql="""SELECT synonym, code_harmonised AS code_text, CAST(1 AS BIGINT) AS dialect_id
  FROM (SELECT DISTINCT code_original AS synonym, code_harmonised FROM staged_obs WHERE code_original <> code_harmonised)""",
)
def load_synonyms(spark, sf_dir):
    tables = _loaded(spark, sf_dir)
    return tables["synonym"].join(tables["code"], "code_id").select("synonym", "code_text", "dialect_id")


@query(
    "load_metadata",
    "staged_obs",
    sql="""SELECT code_harmonised AS code_text, term_text, CAST(obs_number AS INTEGER) AS obs_number,
       CAST(min_ts AS DATE) AS first_obs_date, CAST(max_ts AS DATE) AS last_obs_date FROM staged_obs""",
)
def load_metadata(spark, sf_dir):
    tables = _loaded(spark, sf_dir)
    return tables["concept_metadata"].join(_named(tables), "concept_id").select(
        "code_text", "term_text", "obs_number", "first_obs_date", "last_obs_date"
    )


@query(
    "load_year_counts",
    "raw_obs",
    sql=f"""SELECT substr(trim(code), 1, 6) AS code_text, term AS term_text, 'PSHP dialect' AS dialect_name,
       count_in_2014 + count_in_2015 + count_in_2016 + count_in_2017 AS obs_number, CAST(NULL AS DATE) AS first_obs_date
  FROM (SELECT code, term, {YEAR_SQL} FROM raw_obs WHERE code IS NOT NULL GROUP BY code, term)""",
)
def load_year_counts(spark, sf_dir):
    view = loaders.concept_view(_loaded(spark, sf_dir, "PSHP"))
    return view.select("code_text", "term_text", "dialect_name", "obs_number", "first_obs_date")


@query(
    "load_code_counts",
    "raw_obs",
    sql="""SELECT coalesce(trim(code), '') AS code_text, term AS term_text, 'HUS' AS organisation_name, CAST(count(*) AS INTEGER) AS obs_number
  FROM raw_obs GROUP BY code, term""",
)
def load_code_counts(spark, sf_dir):
    view = loaders.concept_view(_loaded(spark, sf_dir, "HUS"))
    return view.select("code_text", "term_text", "organisation_name", "obs_number")


@query(
    "load_span_counts",
    "raw_obs",
    sql="""SELECT code AS code_text, term AS term_text, 'PPSHP' AS organisation_name, 'Snomed II' AS code_system_name,
       CAST(count(*) AS INTEGER) AS obs_number FROM raw_obs WHERE code IS NOT NULL GROUP BY code, term""",
)
def load_span_counts(spark, sf_dir):
    view = loaders.concept_view(_loaded(spark, sf_dir, "PPSHP"))
    return view.select("code_text", "term_text", "organisation_name", "code_system_name", "obs_number")


@query(
    "resolve_dialect",
    "part_code",
    sql="""SELECT p_partkey, CAST(3 AS BIGINT) AS dialect_id, CAST(3 AS BIGINT) AS organisation_id FROM part_code""",
)
def resolve_dialect(spark, sf_dir):
    """Rows tagged with the dialect and organisation resolved by name."""
    tables = seeds.seed_dimensions(spark)
    return fx.part_codes(spark, sf_dir).select(
        "p_partkey",
        dim.dialect_id(tables["dialect"], tables["code_system"], seeds.BRIDGE_DIALECT, seeds.OLD_SYSTEM).alias("dialect_id"),
        dim.organisation_id(tables["organisation"], seeds.OWNER).alias("organisation_id"),
    )


@query(
    "bridge_mappings",
    "bridge",
    sql="""SELECT code_harmonised AS source_code_text, nomen2 AS source_term_text, conceptid AS destination_code_text,
       term AS destination_term_text, count(*) AS n FROM bridge
  WHERE type = 'Match' AND conceptid IS NOT NULL AND term IS NOT NULL GROUP BY ALL""",
)
def bridge_mappings(spark, sf_dir):
    """Mapping events of the bridge load, with the names of both concepts."""
    tables, events = loaders.load_bridge(seeds.empty_tables(spark), fx.bridge_rows(spark, sf_dir), user_id=1)
    named = _named(tables)

    def side(prefix):
        return named.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("concept_id", "code_text", "term_text")])

    joined = events.join(side("source"), "source_concept_id").join(side("destination"), "destination_concept_id")
    return joined.groupBy(
        "source_code_text", "source_term_text", "destination_code_text", "destination_term_text"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "bridge_valid_mappings",
    "bridge",
    sql="""SELECT source_code_text, source_term_text, destination_code_text, destination_term_text FROM (
    SELECT code_harmonised AS source_code_text, nomen2 AS source_term_text, conceptid AS destination_code_text,
           term AS destination_term_text, row_number() OVER (PARTITION BY code_harmonised, nomen2 ORDER BY conceptid DESC, term DESC) AS rn
      FROM bridge WHERE type = 'Match' AND conceptid IS NOT NULL AND term IS NOT NULL) WHERE rn = 1""",
)
def bridge_valid_mappings(spark, sf_dir):
    """The bridge load names no dialect, so only the last match of a source stays valid."""
    tables, events = loaders.load_bridge(seeds.empty_tables(spark), fx.bridge_rows(spark, sf_dir), user_id=1)
    none = events.limit(0).withColumn("valid", F.lit(True))
    valid = log.fold_mappings(none, events).filter("valid").select("source_concept_id", "destination_concept_id")
    named = _named(tables)

    def side(prefix):
        return named.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("concept_id", "code_text", "term_text")])

    return valid.join(side("source"), "source_concept_id").join(side("destination"), "destination_concept_id").select(
        "source_code_text", "source_term_text", "destination_code_text", "destination_term_text"
    )


@query(
    "bridge_synonyms",
    "bridge",
    sql="SELECT DISTINCT code2 AS synonym, code_harmonised AS code_text FROM bridge WHERE code2 <> code_harmonised",
)
def bridge_synonyms(spark, sf_dir):
    tables, _ = loaders.load_bridge(seeds.empty_tables(spark), fx.bridge_rows(spark, sf_dir), user_id=1)
    return tables["synonym"].join(tables["code"], "code_id").select("synonym", "code_text")


@query(
    "delete_concepts",
    "concept",
    "concept_metadata",
    "mapping_event",
    sql="""SELECT 'concept' AS kind, concept_id AS id FROM concept WHERE concept_id IN (SELECT source_concept_id FROM mapping_event)
  UNION ALL SELECT 'metadata', concept_metadata_id FROM concept_metadata WHERE concept_id IN (SELECT source_concept_id FROM mapping_event)""",
)
def delete_concepts(spark, sf_dir):
    """Delete every concept that was never mapped, together with its metadata."""
    concept = fx.concept(spark, sf_dir)
    mapped = fx.mapping_events(spark, sf_dir).select(F.col("source_concept_id").alias("concept_id"))
    gone = concept.join(mapped, "concept_id", "left_anti").select("concept_id")
    kept, metadata = dim.delete_concepts(concept, fx.concept_metadata(spark, sf_dir), gone)
    return kept.select(F.lit("concept").alias("kind"), F.col("concept_id").alias("id")).unionByName(
        metadata.select(F.lit("metadata").alias("kind"), F.col("concept_metadata_id").alias("id"))
    )
