"""Adapters that derive the mapping tables from the given tables, in Spark and as SQL.

``SQL`` holds the same definitions as common table expressions: name -> (inputs, body). The functions
are cached per session and folder: what is kept is the lazy DataFrame, the definition of a view.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators import views
from termweave.operators.mapping import latest_mappings
from termweave.schemas import (
    ACCEPTABLE,
    BRIDGE_MAPPING,
    INCORRECT_CONCEPT,
    IS_A,
    NO_MATCH,
    PREFERRED,
    USER_MAPPING,
)
from termweave.sources.sinks import write_staging

Build = Callable[[SparkSession, str], DataFrame]

EVENT_NAMES = {
    "purchase": USER_MAPPING,
    "click": USER_MAPPING,
    "view": BRIDGE_MAPPING,
    "error": INCORRECT_CONCEPT,
    "signup": NO_MATCH,
}

SQL: dict[str, tuple[tuple[str, ...], str]] = {}


@functools.cache
def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(build: Build) -> Build:
    """Keep a derived table: written to the shared folder once per application, then read back.

    The harmonised tables are stored tables in real use; reading them gives the planner their true
    size, and no query repeats their derivation.
    """

    @functools.cache
    @functools.wraps(build)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = build(spark, sf_dir)
        return spark.read.schema(table.schema).parquet(write_staging(table, build.__name__))

    return read


def with_tables(names: tuple[str, ...], select: str) -> str:
    """``select`` preceded by the common table expressions it needs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name not in SQL:
            return
        for needed in SQL[name][0]:
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    bodies = ",\n".join(f"{name} AS ({SQL[name][1]})" for name in ordered)
    return f"WITH RECURSIVE {bodies}\n{select}" if bodies else select


# --- codes of parts and raw observations ----------------------------------------------------


def code_raw() -> Column:
    key = F.col("p_partkey")
    body = F.concat(
        F.when(key % 2 == 0, "T").otherwise("M"),
        F.lpad((key % 100).cast("string"), 4, "0"),
        F.lit("0"),
        (F.col("p_size") % 6).cast("string"),
        (F.col("p_size") % 10).cast("string"),
    )
    spaced = F.when(key % 7 == 0, F.concat(F.lit(" "), body, F.lit(" "))).otherwise(body)
    return F.when(key % 11 != 0, spaced)


@functools.cache
def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = given(spark, sf_dir, "part")
    return part.select("p_partkey", "p_name", "p_type", "p_brand", "p_size", code_raw().alias("code_raw"))


SQL["part_code"] = (
    (),
    """SELECT p_partkey, p_name, p_type, p_brand, p_size,
       CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 7 = 0 THEN ' ' || body || ' ' ELSE body END END AS code_raw
  FROM (SELECT *, (CASE WHEN p_partkey % 2 = 0 THEN 'T' ELSE 'M' END) || lpad(CAST(p_partkey % 100 AS VARCHAR), 4, '0')
               || '0' || CAST(p_size % 6 AS VARCHAR) || CAST(p_size % 10 AS VARCHAR) AS body FROM part)""",
)


@functools.cache
def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("l_orderkey")
    sample = F.concat(
        F.substring(F.lit("ABCDNRSYKX"), order % 10 + 1, F.lit(1)),
        F.when(order % 13 == 0, "N").otherwise(""),
        order.cast("string"),
    )
    line = given(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    supplier = given(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        line.join(part_codes(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("code_raw").alias("code"),
            F.col("p_name").alias("term"),
            sample.alias("sample_number"),
            F.col("l_shipdate").alias("sampled_at"),
            F.col("s_nationkey").cast("long").alias("organisation_id"),
        )
    )


SQL["raw_obs"] = (
    ("part_code",),
    """SELECT code_raw AS code, p_name AS term,
       substr('ABCDNRSYKX', CAST(l_orderkey % 10 + 1 AS INTEGER), 1) || (CASE WHEN l_orderkey % 13 = 0 THEN 'N' ELSE '' END)
         || CAST(l_orderkey AS VARCHAR) AS sample_number,
       l_shipdate AS sampled_at, CAST(s_nationkey AS BIGINT) AS organisation_id
  FROM lineitem JOIN part_code ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
)


@functools.cache
def two_column_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with the code in a T or an M column by its first letter."""
    raw = raw_observations(spark, sf_dir)
    is_t = F.trim("code").startswith("T")
    return raw.select(
        F.when(is_t, F.col("code")).alias("t_code"),
        F.when(is_t, F.col("term")).alias("t_term"),
        F.when(~is_t, F.col("code")).alias("m_code"),
        F.when(~is_t, F.col("term")).alias("m_term"),
        "sample_number",
        "sampled_at",
    )


OVERLAY_SQL = {
    axis: f"CASE WHEN length(trim({{0}})) = 8 AND regexp_full_match(trim({{0}}), '(?is){axis}....0[{digits}].') "
    "THEN substr(trim({0}), 1, 5) || substr(trim({0}), 8) ELSE coalesce(trim({0}), '') END"
    for axis, digits in (("T", "12"), ("M", "1234"))
}

SQL["staged_obs"] = (
    ("raw_obs",),
    f"""SELECT coalesce(trim(code), '') AS code_original, coalesce(trim(term), '') AS term_text, min(sampled_at) AS min_ts,
       max(sampled_at) AS max_ts, count(DISTINCT sample_number) AS obs_number,
       CASE WHEN trim(code) LIKE 'T%' THEN {OVERLAY_SQL["T"].format("code")} ELSE {OVERLAY_SQL["M"].format("code")} END AS code_harmonised
  FROM raw_obs WHERE code IS NOT NULL AND regexp_matches(sample_number, '^[ABCDNRSYK][^N]', 'i')
  GROUP BY code, term""",
)


# --- background dimensions ------------------------------------------------------------------


@functools.cache
def organisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = given(spark, sf_dir, "region")
    return given(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("organisation_id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("City of "), "n_name").alias("city"),
        F.col("r_name").alias("country"),
    )


SQL["organisation"] = (
    (),
    """SELECT CAST(n_nationkey AS BIGINT) AS organisation_id, n_name AS name, 'City of ' || n_name AS city, r_name AS country
  FROM nation JOIN region ON n_regionkey = r_regionkey""",
)


@functools.cache
def code_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = given(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("owner"))
    return given(spark, sf_dir, "region").join(owners, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_regionkey").cast("long").alias("code_system_id"),
        F.col("r_name").alias("name"),
        F.lit(None).cast("string").alias("version"),
        F.col("owner").cast("long").alias("owner_organisation_id"),
    )


SQL["code_system"] = (
    (),
    """SELECT CAST(r_regionkey AS BIGINT) AS code_system_id, r_name AS name, CAST(NULL AS VARCHAR) AS version,
       CAST(min(n_nationkey) AS BIGINT) AS owner_organisation_id
  FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
)


@functools.cache
def dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return given(spark, sf_dir, "nation").select(
        key.cast("long").alias("dialect_id"),
        F.col("n_regionkey").cast("long").alias("code_system_id"),
        F.concat("n_name", F.lit(" dialect")).alias("dialect_name"),
        (key % 3 == 0).alias("is_official"),
    )


SQL["dialect"] = (
    (),
    """SELECT CAST(n_nationkey AS BIGINT) AS dialect_id, CAST(n_regionkey AS BIGINT) AS code_system_id,
       n_name || ' dialect' AS dialect_name, n_nationkey % 3 = 0 AS is_official FROM nation""",
)


@functools.cache
def event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that occur, numbered by the first letter of their name for a stable id."""
    names = given(spark, sf_dir, "events").select(event_name().alias("name")).distinct()
    return names.select(F.ascii("name").cast("long").alias("event_type_id"), "name")


def event_name() -> Column:
    cases = [F.when(F.col("event_type") == kind, name) for kind, name in EVENT_NAMES.items()]
    return F.coalesce(*cases)


EVENT_SQL = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in EVENT_NAMES.items()) + " END"
SQL["event_type_dim"] = (
    (),
    f"SELECT CAST(ascii(name) AS BIGINT) AS event_type_id, name FROM (SELECT DISTINCT {EVENT_SQL} AS name FROM events)",
)


@functools.cache
def user(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return given(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.col("c_nationkey").cast("long").alias("organisation_id"),
        F.concat(F.lit("user"), key.cast("string")).alias("username"),
        F.concat(key.cast("string"), F.lit("@example.org")).alias("email"),
        F.col("c_name").alias("last_name"),
        F.col("c_mktsegment").alias("first_name"),
        F.when(key % 2 == 0, F.col("c_nationkey").cast("long")).alias("default_source_dialect_id"),
        F.when(key % 3 == 0, key % 25).alias("default_destination_dialect_id"),
    )


SQL["app_user"] = (
    (),
    """SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS organisation_id, 'user' || c_custkey AS username,
       c_custkey || '@example.org' AS email, c_name AS last_name, c_mktsegment AS first_name,
       CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS BIGINT) END AS default_source_dialect_id,
       CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 25 END AS default_destination_dialect_id FROM customer""",
)

SQL["v_user"] = (
    ("app_user", "organisation"),
    """SELECT user_id, username, email, last_name, first_name, u.organisation_id, name AS organisation_name
  FROM app_user u JOIN organisation o ON u.organisation_id = o.organisation_id""",
)
SQL["v_dialect"] = (
    ("dialect", "code_system", "organisation"),
    """SELECT dialect_id, dialect_name, is_official, cs.code_system_id, cs.name AS code_system_name,
       o.organisation_id AS code_system_owner_organisation_id, o.name AS code_system_owner_organisation_name
  FROM dialect d JOIN code_system cs ON d.code_system_id = cs.code_system_id
  JOIN organisation o ON cs.owner_organisation_id = o.organisation_id""",
)


# --- concepts: one per part, so ids agree with the SQL --------------------------------------


@functools.cache
def concept_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as concepts: code (blank when missing), term with brand, organisation by key."""
    key = F.col("p_partkey")
    return part_codes(spark, sf_dir).select(
        key.alias("concept_id"),
        fn.overlay_code(F.col("code_raw"), "T", "12").alias("code_text"),
        F.concat("p_name", F.lit(" "), "p_brand").alias("term_text"),
        (key % 25).alias("organisation_id"),
        (key % 25).alias("dialect_id"),
    )


SQL["concept_part"] = (
    ("part_code",),
    f"""SELECT p_partkey AS concept_id, {OVERLAY_SQL["T"].format("code_raw")} AS code_text,
       p_name || ' ' || p_brand AS term_text, p_partkey % 25 AS organisation_id, p_partkey % 25 AS dialect_id FROM part_code""",
)


@stored
def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concept_parts(spark, sf_dir).groupBy("code_text").agg(F.min("concept_id").alias("code_id")).select("code_id", "code_text")


@stored
def term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concept_parts(spark, sf_dir).groupBy("term_text").agg(F.min("concept_id").alias("term_id")).select("term_id", "term_text")


@stored
def concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        concept_parts(spark, sf_dir)
        .join(code(spark, sf_dir), "code_text")
        .join(term(spark, sf_dir), "term_text")
        .select("concept_id", "code_id", "term_id", "organisation_id", "dialect_id")
    )


SQL["code"] = (("concept_part",), "SELECT min(concept_id) AS code_id, code_text FROM concept_part GROUP BY code_text")
SQL["term"] = (("concept_part",), "SELECT min(concept_id) AS term_id, term_text FROM concept_part GROUP BY term_text")
SQL["concept"] = (
    ("concept_part", "code", "term"),
    """SELECT concept_id, code_id, term_id, organisation_id, dialect_id
  FROM concept_part p JOIN code c ON p.code_text = c.code_text JOIN term t ON p.term_text = t.term_text""",
)


@stored
def concept_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two rows per concept, one per line status.

    Nearly every line is a distinct order of its part, so lines are dealt by part first: counting before the shuffle would
    keep a table of all lines of a task. The number of partitions grows with the input's, so that a partition does not.
    """
    lines = given(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", "l_orderkey", "l_shipdate")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * lines.rdd.getNumPartitions())
    grouped = lines.repartition(parts, "l_partkey").groupBy("l_partkey", "l_linestatus").agg(
        F.countDistinct("l_orderkey").cast("int").alias("obs_number"),
        F.min("l_shipdate").cast("date").alias("first_obs_date"),
        F.max("l_shipdate").cast("date").alias("last_obs_date"),
    )
    return grouped.select(
        (F.col("l_partkey") * 2 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("concept_metadata_id"),
        F.col("l_partkey").alias("concept_id"),
        "obs_number",
        "first_obs_date",
        "last_obs_date",
    )


SQL["concept_metadata"] = (
    (),
    """SELECT l_partkey * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS concept_metadata_id, l_partkey AS concept_id,
       CAST(count(DISTINCT l_orderkey) AS INTEGER) AS obs_number, CAST(min(l_shipdate) AS DATE) AS first_obs_date,
       CAST(max(l_shipdate) AS DATE) AS last_obs_date
  FROM lineitem GROUP BY l_partkey, l_linestatus""",
)
SQL["v_concept"] = (
    ("concept", "code", "term", "organisation", "v_dialect", "concept_metadata"),
    """SELECT co.concept_id, c.code_id, c.code_text, t.term_id, t.term_text, o.organisation_id, o.name AS organisation_name,
       d.dialect_id, d.dialect_name, d.is_official, d.code_system_id, d.code_system_name,
       d.code_system_owner_organisation_id, d.code_system_owner_organisation_name,
       m.concept_metadata_id, m.obs_number, m.first_obs_date, m.last_obs_date
  FROM concept co JOIN code c ON co.code_id = c.code_id JOIN term t ON co.term_id = t.term_id
  JOIN organisation o ON co.organisation_id = o.organisation_id JOIN v_dialect d ON co.dialect_id = d.dialect_id
  LEFT JOIN concept_metadata m ON co.concept_id = m.concept_id""",
)


@functools.cache
def dialects_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.v_dialect(dialect(spark, sf_dir), code_system(spark, sf_dir), organisation(spark, sf_dir))


@functools.cache
def users_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.v_user(user(spark, sf_dir), organisation(spark, sf_dir))


@functools.cache
def concepts_view(spark: SparkSession, sf_dir: str, counted: bool = True) -> DataFrame:
    """``v_concept``; without counts every concept is one row."""
    metadata = concept_metadata(spark, sf_dir)
    return views.v_concept(
        concept(spark, sf_dir),
        code(spark, sf_dir),
        term(spark, sf_dir),
        organisation(spark, sf_dir),
        dialects_view(spark, sf_dir),
        metadata if counted else metadata.limit(0),
    )


# --- mapping log ----------------------------------------------------------------------------


@functools.cache
def mapping_events(spark: SparkSession, sf_dir: str, bridge_without_dialect: bool = False) -> DataFrame:
    """Events as mappings. In the NULL-dialect variant the bridge names none and sources are finer."""
    k = F.get_json_object("props", "$.k").cast("long")
    is_bridge = F.col("event_type") == "view"
    dialect_id = F.col("user_id") % 3
    step = 50 if bridge_without_dialect else 10
    if bridge_without_dialect:
        dialect_id = F.when(~is_bridge, dialect_id)
    target = F.when(
        ~F.col("event_type").isin("error", "signup"), F.floor(F.col("value")).cast("long") % 50
    )
    return given(spark, sf_dir, "events").select(
        F.col("event_id").alias("mapping_id"),
        "user_id",
        F.lit(-101).cast("long").alias("session_id"),
        (k * step + F.col("user_id") % step).alias("source_concept_id"),
        target.alias("destination_concept_id"),
        dialect_id.alias("destination_dialect_id"),
        F.ascii(event_name()).cast("long").alias("event_type_id"),
        is_bridge.alias("is_bridge"),
        F.when(F.col("event_id") % 4 == 0, F.col("props")).alias("comment"),
        F.col("ts").alias("insert_ts"),
        F.lit(None).cast("timestamp_ntz").alias("update_ts"),
    )


@functools.cache
def mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in which users and the bridge may leave the dialect out; every third belongs to one source."""
    key, user = F.col("mapping_id"), F.col("user_id")
    own = user * 20 + F.col("source_concept_id") % 20
    return mapping_events(spark, sf_dir, bridge_without_dialect=True).withColumns(
        {
            "source_concept_id": F.when(key % 3 == 0, 0).otherwise(own).cast("long"),
            "destination_dialect_id": F.when(key % 5 != 0, user % 3),
        }
    )


def _mapping_sql(step: int, dialect_sql: str) -> str:
    return f"""SELECT event_id AS mapping_id, user_id, CAST(-101 AS BIGINT) AS session_id,
       CAST(props->>'k' AS BIGINT) * {step} + user_id % {step} AS source_concept_id,
       CASE WHEN event_type NOT IN ('error', 'signup') THEN CAST(floor(value) AS BIGINT) % 50 END AS destination_concept_id,
       {dialect_sql} AS destination_dialect_id, CAST(ascii({EVENT_SQL}) AS BIGINT) AS event_type_id,
       event_type = 'view' AS is_bridge, CASE WHEN event_id % 4 = 0 THEN props END AS comment, ts AS insert_ts,
       CAST(NULL AS TIMESTAMP) AS update_ts FROM events"""


SQL["mapping_event"] = ((), _mapping_sql(10, "user_id % 3"))
SQL["mapping_event_null"] = ((), _mapping_sql(50, "CASE WHEN event_type <> 'view' THEN user_id % 3 END"))
SQL["mapping"] = (
    ("mapping_event",),
    """SELECT *, row_number() OVER (PARTITION BY source_concept_id, destination_dialect_id ORDER BY is_bridge, mapping_id DESC) = 1 AS valid
  FROM mapping_event""",
)
# The general variant: any event may lack a dialect, and one source holds a third of all events.
SQL["mapping_event_mixed"] = (
    ("mapping_event_null",),
    """SELECT * REPLACE (CASE WHEN mapping_id % 3 = 0 THEN 0 ELSE user_id * 20 + source_concept_id % 20 END AS source_concept_id,
       CASE WHEN mapping_id % 5 <> 0 THEN user_id % 3 END AS destination_dialect_id) FROM mapping_event_null""",
)
# Every source's events in id order, each applied to the rows left by the ones before.
SQL["replay_mixed"] = (
    ("mapping_event_mixed",),
    """SELECT source_concept_id, list_reduce(
         list([{'id': mapping_id, 'd': destination_dialect_id, 'b': is_bridge}] ORDER BY mapping_id),
         lambda open, e: list_transform([list_filter(open, lambda x: e[1].d IS NULL OR x.d IS NULL OR x.d = e[1].d)[1]], lambda old:
           CASE WHEN old IS NULL THEN open || e WHEN e[1].b AND NOT old.b THEN open
                ELSE list_filter(open, lambda x: x.id <> old.id) || e END)[1]) AS state
  FROM mapping_event_mixed GROUP BY source_concept_id""",
)
# Row-by-row replay: the n-th event of every source meets the state left by the ones before.
SQL["replay_event"] = (
    ("mapping_event_null",),
    "SELECT *, row_number() OVER (PARTITION BY source_concept_id ORDER BY mapping_id) AS n FROM mapping_event_null",
)
SQL["replay"] = (
    ("replay_event",),
    """SELECT s AS source_concept_id, 0::BIGINT AS n, []::STRUCT(id BIGINT, d BIGINT, b BOOLEAN)[] AS state
    FROM (SELECT DISTINCT source_concept_id AS s FROM replay_event)
  UNION ALL
  SELECT source_concept_id, n,
       CASE WHEN old IS NULL THEN list_append(state, me) WHEN me.b AND NOT old.b THEN state
            ELSE list_append(list_filter(state, lambda x: x.id <> old.id), me) END
  FROM (SELECT r.source_concept_id, e.n, r.state, {'id': e.mapping_id, 'd': e.destination_dialect_id, 'b': e.is_bridge} AS me,
               list_filter(r.state, lambda x: e.destination_dialect_id IS NULL OR x.d IS NULL OR x.d = e.destination_dialect_id)[1] AS old
          FROM replay r JOIN replay_event e ON e.source_concept_id = r.source_concept_id AND e.n = r.n + 1)""",
)


@stored
def mapping_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settled log of the variant in which every event has a dialect."""
    events = mapping_events(spark, sf_dir)
    winners = latest_mappings(events).withColumn("valid", F.lit(True))
    return events.join(winners, "mapping_id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


@functools.cache
def mappings_view(spark: SparkSession, sf_dir: str, concepts: DataFrame | None = None) -> DataFrame:
    return views.v_mapping(
        mapping_log(spark, sf_dir),
        concepts if concepts is not None else concepts_view(spark, sf_dir),
        users_view(spark, sf_dir),
        event_type(spark, sf_dir),
        dialect(spark, sf_dir),
    )


_CONCEPT_SIDE = (
    "code_id", "code_text", "term_id", "term_text", "organisation_id", "organisation_name", "code_system_id",
    "code_system_name", "code_system_owner_organisation_id", "code_system_owner_organisation_name",
    "concept_metadata_id", "obs_number", "first_obs_date", "last_obs_date",
)
_SIDES = ", ".join(f"{a}.{c} AS {side}_{c}" for a, side in (("s", "source"), ("d", "destination")) for c in _CONCEPT_SIDE)
SQL["v_mapping"] = (
    ("mapping", "v_concept", "v_user", "event_type_dim", "dialect"),
    f"""SELECT m.mapping_id, m.valid, u.user_id, u.username, u.last_name, u.first_name, u.organisation_id, u.organisation_name,
       m.session_id, m.source_concept_id, m.destination_concept_id, {_SIDES},
       s.dialect_id AS source_dialect_id, s.dialect_name AS source_dialect_name,
       CASE WHEN d.concept_id IS NOT NULL THEN d.dialect_id ELSE dd.dialect_id END AS destination_dialect_id,
       CASE WHEN d.concept_id IS NOT NULL THEN d.dialect_name ELSE dd.dialect_name END AS destination_dialect_name,
       et.name AS event_type_name, m.comment, m.insert_ts, m.update_ts
  FROM mapping m JOIN v_concept s ON m.source_concept_id = s.concept_id
  LEFT JOIN v_concept d ON m.destination_concept_id = d.concept_id JOIN v_user u ON m.user_id = u.user_id
  JOIN event_type_dim et ON m.event_type_id = et.event_type_id LEFT JOIN dialect dd ON m.destination_dialect_id = dd.dialect_id""",
)


@functools.cache
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mapping requests: the page concept and selected ones (none, some, or many); status P rejects."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    rejected = F.col("o_orderstatus") == "P"
    selected = (
        F.when(key % 11 == 0, F.lit(None).cast("array<bigint>"))
        .when(key % 11 == 1, F.array().cast("array<bigint>"))
        .when(key % 101 == 2, F.sequence(key, key + 99))
        .otherwise(F.array(customer, key + customer))
    )
    return given(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        key.alias("concept_id"),
        selected.alias("old_concepts"),
        F.when(~rejected, F.concat(F.lit("C"), customer.cast("string"))).alias("new_code"),
        F.when(~rejected, F.concat(F.lit("target "), customer.cast("string"))).alias("new_term"),
        F.col("o_orderpriority").alias("comment"),
        customer.alias("user_id"),
        (customer % 3).alias("target_dialect_id"),
    )


SQL["request"] = (
    (),
    """SELECT o_orderkey AS request_id, o_orderkey AS concept_id,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN []
            WHEN o_orderkey % 101 = 2 THEN generate_series(o_orderkey, o_orderkey + 99) ELSE [o_custkey, o_orderkey + o_custkey] END AS old_concepts,
       CASE WHEN o_orderstatus <> 'P' THEN 'C' || o_custkey END AS new_code,
       CASE WHEN o_orderstatus <> 'P' THEN 'target ' || o_custkey END AS new_term,
       o_orderpriority AS comment, o_custkey AS user_id, o_custkey % 3 AS target_dialect_id FROM orders""",
)


@functools.cache
def note_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("long")
    return given(spark, sf_dir, "events").select(
        "user_id",
        (k * 10 + F.col("user_id") % 10).alias("concept_id"),
        note.alias("note"),
        F.col("event_id").alias("edit_no"),
    )


SQL["note"] = (
    (),
    """SELECT user_id, concept_id, note FROM (
    SELECT user_id, CAST(props->>'k' AS BIGINT) * 10 + user_id % 10 AS concept_id,
           CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS note,
           row_number() OVER (PARTITION BY user_id, CAST(props->>'k' AS BIGINT) * 10 + user_id % 10 ORDER BY event_id DESC) AS rn
      FROM events) WHERE rn = 1 AND note <> ''""",
)


@functools.cache
def viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list per organisation: its lowest mapper, its own dialect as source, one target dialect."""
    active = given(spark, sf_dir, "events").select("user_id").distinct()
    own = user(spark, sf_dir).join(active, "user_id")
    return own.groupBy("organisation_id").agg(F.min("user_id").alias("user_id")).select(
        "user_id",
        "organisation_id",
        F.col("organisation_id").alias("source_dialect_id"),
        (F.col("organisation_id") % 3).alias("target_dialect_id"),
    )


SQL["viewer"] = (
    ("app_user",),
    """SELECT min(user_id) AS user_id, organisation_id, organisation_id AS source_dialect_id, organisation_id % 3 AS target_dialect_id
  FROM app_user WHERE user_id IN (SELECT user_id FROM events) GROUP BY organisation_id""",
)

_PICK = "m.mapping_id, m.destination_code_text, m.destination_term_text, m.mapping_user, m.mapping_ts"
SQL["valid_mapping"] = (
    ("v_mapping",),
    """SELECT DISTINCT mapping_id, source_concept_id, destination_dialect_id, user_id, organisation_id,
       upper(source_code_text) AS ucode, upper(source_term_text) AS uterm, event_type_name = 'Bridge mapping' AS is_bridge,
       destination_code_text, destination_term_text,
       last_name || ', ' || substr(first_name, 1, 1) || ' (' || organisation_name || ')' AS mapping_user,
       strftime(insert_ts, '%Y-%m-%d %H:%M') AS mapping_ts FROM v_mapping WHERE valid""",
)
SQL["list_concept"] = (
    ("v_concept", "viewer"),
    """SELECT DISTINCT v.user_id, v.organisation_id AS viewer_org, v.target_dialect_id, c.concept_id,
       upper(c.code_text) AS ucode, upper(c.term_text) AS uterm FROM v_concept c JOIN viewer v ON c.dialect_id = v.source_dialect_id""",
)
SQL["list_pick"] = (
    ("list_concept", "valid_mapping"),
    f"""SELECT user_id, concept_id, status, destination_code_text, destination_term_text, mapping_user, mapping_ts FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, concept_id ORDER BY rank, mapping_id DESC) AS rn FROM (
      SELECT k.user_id, k.concept_id, CASE WHEN m.user_id = k.user_id THEN 1 ELSE 2 END AS rank,
             CASE WHEN m.user_id = k.user_id THEN 'self' ELSE 'own_organisation' END AS status, {_PICK}
        FROM list_concept k JOIN valid_mapping m ON m.source_concept_id = k.concept_id AND m.destination_dialect_id = k.target_dialect_id
       WHERE m.user_id = k.user_id OR m.organisation_id = k.viewer_org
      UNION ALL
      SELECT k.user_id, k.concept_id, CASE WHEN m.is_bridge THEN 4 ELSE 3 END,
             CASE WHEN m.is_bridge THEN 'bridge' ELSE 'other_organisation' END, {_PICK}
        FROM list_concept k JOIN valid_mapping m ON m.ucode = k.ucode AND m.uterm = k.uterm
             AND m.destination_dialect_id = k.target_dialect_id AND m.source_concept_id <> k.concept_id)) WHERE rn = 1""",
)
SQL["worklist"] = (
    ("v_concept", "viewer", "list_pick", "note"),
    """SELECT v.user_id, v.source_dialect_id, c.code_text, c.term_text, p.destination_code_text, p.destination_term_text,
       c.obs_number, c.first_obs_date, c.last_obs_date, p.mapping_user, p.mapping_ts, p.status,
       c.concept_id AS source_concept_id, n.note AS user_concept_note
  FROM v_concept c JOIN viewer v ON c.dialect_id = v.source_dialect_id
  LEFT JOIN list_pick p ON p.user_id = v.user_id AND p.concept_id = c.concept_id
  LEFT JOIN note n ON n.user_id = v.user_id AND n.concept_id = c.concept_id""",
)
SQL["page_concept"] = (
    ("v_concept",),
    """SELECT dialect_id, code_system_id, concept_id, code_text, term_text FROM (
    SELECT *, row_number() OVER (PARTITION BY dialect_id ORDER BY obs_number DESC NULLS LAST, concept_id) AS rn FROM v_concept) WHERE rn = 1""",
)


def page_concepts(concepts: DataFrame) -> DataFrame:
    """The most observed concept of each dialect: the page a reader would open first."""
    most = F.max(
        F.struct(F.coalesce("obs_number", F.lit(-1)), -F.col("concept_id"), "code_system_id", "code_text", "term_text", "concept_id")
    )
    return concepts.groupBy("dialect_id").agg(most.alias("top")).select(
        "dialect_id", "top.code_system_id", "top.concept_id", "top.code_text", "top.term_text"
    )


# --- bridge file ----------------------------------------------------------------------------


@functools.cache
def bridge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (part, supplier) pairs as bridge rows; some lack a target or are no match."""
    pair = given(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    supplier = given(spark, sf_dir, "supplier")
    key = F.col("l_suppkey")
    trimmed = F.trim("code_raw")
    return (
        pair.join(part_codes(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, key == F.col("s_suppkey"))
        .filter(F.col("code_raw").isNotNull())
        .select(
            F.concat(F.substring(trimmed, 1, 1), F.lit("-"), F.substring(trimmed, 2, 4), F.lit(" ")).alias("code2"),
            F.col("p_name").alias("nomen2"),
            F.col("p_type").alias("class2"),
            F.when(key % 10 != 0, key).alias("conceptid"),
            F.lit(None).cast("string").alias("snomedid"),
            (key * 10).alias("descriptionid"),
            F.when(key % 10 != 5, F.col("s_name")).alias("term"),
            F.when((F.col("l_partkey") + key) % 3 != 0, "Match").otherwise("Narrow").alias("type"),
            F.lit(None).cast("string").alias("additional_code"),
        )
    )


SQL["bridge_raw"] = (
    ("part_code",),
    """SELECT substr(trim(code_raw), 1, 1) || '-' || substr(trim(code_raw), 2, 4) || ' ' AS code2, p_name AS nomen2, p_type AS class2,
       CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS conceptid, l_suppkey * 10 AS descriptionid,
       CASE WHEN l_suppkey % 10 <> 5 THEN s_name END AS term,
       CASE WHEN (l_partkey + l_suppkey) % 3 <> 0 THEN 'Match' ELSE 'Narrow' END AS type
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part_code ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE code_raw IS NOT NULL""",
)
SQL["bridge"] = (
    ("bridge_raw",),
    """SELECT trim(replace(code2, '-', '')) AS code_harmonised, trim(code2) AS code2, nomen2, class2,
       CAST(conceptid AS VARCHAR) AS conceptid, descriptionid, term, type FROM bridge_raw""",
)


# --- terminology graph ----------------------------------------------------------------------


@functools.cache
def is_a_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> region, supplier -> nation, customer -> nation with prefixed ids."""

    def edge(name: str, child: str, letter: str, parent: str, above: str) -> DataFrame:
        return given(spark, sf_dir, name).select(
            F.concat(F.lit(letter), F.col(child).cast("string")).alias("child"),
            F.concat(F.lit(above), F.col(parent).cast("string")).alias("parent"),
        )

    return (
        edge("nation", "n_nationkey", "N", "n_regionkey", "R")
        .unionByName(edge("supplier", "s_suppkey", "S", "s_nationkey", "N"))
        .unionByName(edge("customer", "c_custkey", "C", "c_nationkey", "N"))
    )


SQL["edge"] = (
    (),
    """SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer""",
)
SQL["closure"] = (
    ("edge",),
    """SELECT parent AS ancestor, child AS descendant FROM edge
  UNION SELECT c.ancestor, e.child FROM closure c JOIN edge e ON e.parent = c.descendant""",
)


@functools.cache
def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the graph's nodes."""

    def named(table: str, key: str, letter: str, name: str) -> DataFrame:
        return given(spark, sf_dir, table).select(
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("concept_id"), F.col(name).alias("default_term")
        )

    return (
        named("region", "r_regionkey", "R", "r_name")
        .unionByName(named("nation", "n_nationkey", "N", "n_name"))
        .unionByName(named("supplier", "s_suppkey", "S", "s_name"))
        .unionByName(named("customer", "c_custkey", "C", "c_name"))
    )


@functools.cache
def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, supplier, part and batch: parts have several suppliers, batches one part, and nation 1 lies above its own region."""

    def edge(name: str, child: str, letter: str, parent: str, above: str) -> DataFrame:
        return given(spark, sf_dir, name).select(
            F.concat(F.lit(letter), F.col(child).cast("string")).alias("child"),
            F.concat(F.lit(above), F.col(parent).cast("string")).alias("parent"),
        )

    first = given(spark, sf_dir, "nation").filter("n_nationkey = 1")
    return (
        edge("nation", "n_nationkey", "N", "n_regionkey", "R")
        .unionByName(edge("supplier", "s_suppkey", "S", "s_nationkey", "N"))
        .unionByName(edge("lineitem", "l_partkey", "P", "l_suppkey", "S"))
        .unionByName(edge("part", "p_partkey", "B", "p_partkey", "P"))
        .unionByName(first.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("child"), F.lit("N1").alias("parent")))
        .distinct()
    )


SQL["supply_edge"] = (
    (),
    """SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation
  UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION SELECT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem
  UNION SELECT 'B' || p_partkey, 'P' || p_partkey FROM part
  UNION SELECT 'R' || n_regionkey, 'N1' FROM nation WHERE n_nationkey = 1""",
)
SQL["node"] = (
    (),
    """SELECT 'R' || r_regionkey AS concept_id, r_name AS default_term FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'C' || c_custkey, c_name FROM customer""",
)


# Attribute type by return flag and line status.
ATTRIBUTE_TYPES = {
    ("A", "F"): "127489000",
    ("A", "O"): "732943007",
    ("N", "F"): "732944001",
    ("N", "O"): "732945000",
    ("R", "F"): "732946004",
    ("R", "O"): "732947008",
}


@functools.cache
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as relationships of the order: line 1 is-a, line 7 dose form, others attributes."""
    line = F.col("l_linenumber")
    cases = [
        F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), kind)
        for (flag, status), kind in ATTRIBUTE_TYPES.items()
    ]
    kind = F.when(line == 1, IS_A).when(line == 7, "411116001").otherwise(F.coalesce(*cases))
    part = given(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return (
        given(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").cast("string").alias("source"),
            kind.alias("type"),
            F.concat(F.lit("type "), kind).alias("type_name"),
            F.col("l_partkey").cast("string").alias("target"),
            F.concat("p_name", F.lit(" "), "p_brand").alias("target_name"),
            F.when(line == 1, 0).otherwise(line % 4).alias("group_id"),
            (F.col("l_suppkey") % 10 != 3).alias("active"),
            F.when(F.col("l_suppkey") % 2 == 0, "stated").otherwise("inferred").alias("view"),
            line.alias("ordinal"),
        )
        .distinct()
    )


_TYPE_SQL = (
    f"CASE WHEN l_linenumber = 1 THEN '{IS_A}' WHEN l_linenumber = 7 THEN '411116001' "
    + " ".join(f"WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' THEN '{k}'" for (f, s), k in ATTRIBUTE_TYPES.items())
    + " END"
)
SQL["relationship"] = (
    (),
    f"""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS source, {_TYPE_SQL} AS type, 'type ' || {_TYPE_SQL} AS type_name,
       CAST(l_partkey AS VARCHAR) AS target, p_name || ' ' || p_brand AS target_name,
       CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber % 4 END AS group_id, l_suppkey % 10 <> 3 AS active,
       CASE WHEN l_suppkey % 2 = 0 THEN 'stated' ELSE 'inferred' END AS view, l_linenumber AS ordinal
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
)


@functools.cache
def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("o_orderstatus") == "F", "clinical drug").otherwise("substance")
    return given(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("concept_id"),
        F.concat("o_orderpriority", F.lit(" ("), tag, F.lit(")")).alias("default_term"),
        (F.col("o_orderstatus") == "F").alias("fully_defined"),
    )


SQL["product_name"] = (
    (),
    """SELECT CAST(o_orderkey AS VARCHAR) AS concept_id,
       o_orderpriority || ' (' || CASE WHEN o_orderstatus = 'F' THEN 'clinical drug' ELSE 'substance' END || ')' AS default_term,
       o_orderstatus = 'F' AS fully_defined FROM orders""",
)


# --- descriptions ---------------------------------------------------------------------------

TAGS = ("finding", "procedure", "substance", "body structure")
FULL_NAME, SYNONYM = "900000000000003001", "900000000000013009"


@functools.cache
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as descriptions, three to a concept, with a trailing semantic tag."""
    key = F.col("doc_id")
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (key % 4 + 1).cast("int"))
    owner = F.floor(key / 3)
    return given(spark, sf_dir, "documents").select(
        key.alias("description_id"),
        owner.alias("concept_id"),
        F.concat("text", F.lit(" ("), tag, F.lit(")")).alias("term"),
        F.when(key % 3 == 0, FULL_NAME).otherwise(SYNONYM).alias("type_id"),
        "lang",
        tag.alias("semantic_tag"),
        F.col("source").alias("module"),
        (key % 5 != 0).alias("active"),
        (owner % 7 != 0).alias("concept_active"),
    )


SQL["description"] = (
    (),
    f"""SELECT doc_id AS description_id, doc_id // 3 AS concept_id,
       text || ' (' || {list(TAGS)}[doc_id % 4 + 1] || ')' AS term,
       CASE WHEN doc_id % 3 = 0 THEN '{FULL_NAME}' ELSE '{SYNONYM}' END AS type_id, lang,
       {list(TAGS)}[doc_id % 4 + 1] AS semantic_tag, source AS module, doc_id % 5 <> 0 AS active,
       (doc_id // 3) % 7 <> 0 AS concept_active FROM documents""",
)


@functools.cache
def language_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as language memberships: two sets, preferred when the quality is 1."""
    return given(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("description_id"),
        F.concat(F.lit("set"), F.col("toxic").cast("string")).alias("language_set"),
        F.when(F.col("quality") == 1, PREFERRED).otherwise(ACCEPTABLE).alias("acceptability"),
    )


SQL["language_row"] = (
    (),
    """SELECT doc_id AS description_id, 'set' || toxic AS language_set,
       CASE WHEN quality = 1 THEN '900000000000548007' ELSE '900000000000549004' END AS acceptability FROM labels""",
)


@functools.cache
def concept_refsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference sets of concepts that own a labelled description."""
    return given(spark, sf_dir, "labels").select(
        F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("refset_id"),
        F.floor(F.col("doc_id") / 3).alias("concept_id"),
    ).distinct()


SQL["concept_refset"] = ((), "SELECT DISTINCT 'q' || quality || 't' || toxic AS refset_id, doc_id // 3 AS concept_id FROM labels")


@functools.cache
def facet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the reference sets of good descriptions, and of modules with English texts."""
    labels, documents = given(spark, sf_dir, "labels"), given(spark, sf_dir, "documents")
    key = F.concat(F.lit("q1t"), F.col("toxic").cast("string"))
    sets = labels.filter("quality = 1").select(F.lit("refset").alias("facet"), key.alias("value"), F.concat(F.lit("Good, toxic "), F.col("toxic").cast("string")).alias("default_term"))
    modules = documents.filter("lang = 'en' AND source IS NOT NULL").select(F.lit("module").alias("facet"), F.col("source").alias("value"), F.upper("source").alias("default_term"))
    return sets.unionByName(modules).distinct()


SQL["facet_name"] = (
    (),
    """SELECT DISTINCT 'refset' AS facet, 'q1t' || toxic AS value, 'Good, toxic ' || toxic AS default_term FROM labels WHERE quality = 1
  UNION SELECT DISTINCT 'module', source, upper(source) FROM documents WHERE lang = 'en' AND source IS NOT NULL""",
)


@functools.cache
def customer_refsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("refset_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("concept_id")
    )


SQL["member"] = ((), "SELECT c_mktsegment AS refset_id, 'C' || c_custkey AS concept_id FROM customer")
