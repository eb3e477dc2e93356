"""Queries over the views and the mapping log."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators import candidates as cand
from termweave.operators import integrity
from termweave.operators import mapping as log
from termweave.operators import views
from termweave.plans import fixtures as fx
from termweave.plans.registry import query
from termweave.runtime import materialise
from termweave.sources import seeds

LABEL_SQL = "last_name || ', ' || substr(first_name, 1, 1) || ' (' || organisation_name || ')'"
MINUTE_SQL = "strftime({0}, '%Y-%m-%d %H:%M')"
SHOWN_SQL = f"""valid, {LABEL_SQL} AS mapper, {{}}, event_type_name, coalesce(comment, '') AS comment,
       {MINUTE_SQL.format("insert_ts")} AS insert_ts"""


# --- views ----------------------------------------------------------------------------------


@query("user_view", "v_user", sql="SELECT * FROM v_user")
def user_view(spark, sf_dir):
    return fx.users_view(spark, sf_dir)


@query(
    "dialect_view",
    "v_dialect",
    sql="""SELECT v_dialect.*, count(*) AS customers FROM v_dialect JOIN customer ON dialect_id = c_nationkey GROUP BY ALL""",
)
def dialect_view(spark, sf_dir):
    """Dialects with code system, owner and number of customers in the dialect's nation."""
    users = fx.given(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("dialect_id")).agg(
        F.count(F.lit(1)).alias("customers")
    )
    return fx.dialects_view(spark, sf_dir).join(users, "dialect_id")


def _synonyms(spark, sf_dir):
    return fx.part_codes(spark, sf_dir).filter(F.col("code_raw").isNotNull()).select(
        F.col("p_partkey").alias("synonym_id"),
        F.col("code_raw").alias("synonym"),
        fn.overlay_code(F.col("code_raw"), "T", "12").alias("code_text"),
        (F.col("p_partkey") % 25).alias("dialect_id"),
    ).join(fx.code(spark, sf_dir), "code_text").select("synonym_id", "code_id", "synonym", "dialect_id")


@query(
    "synonym_view",
    "part_code",
    "code",
    "dialect",
    sql=f"""SELECT c.code_id, c.code_text, p_partkey AS synonym_id, code_raw AS synonym, d.dialect_id, d.dialect_name
  FROM part_code JOIN code c ON c.code_text = {fx.OVERLAY_SQL["T"].format("code_raw")}
  JOIN dialect d ON d.dialect_id = p_partkey % 25 WHERE code_raw IS NOT NULL""",
)
def synonym_view(spark, sf_dir):
    return views.v_synonym(_synonyms(spark, sf_dir), fx.code(spark, sf_dir), fx.dialect(spark, sf_dir))


@query("concept_view", "v_concept", sql="SELECT * FROM v_concept")
def concept_view(spark, sf_dir):
    return fx.concepts_view(spark, sf_dir)


@query("mapping_view", "v_mapping", sql="SELECT * FROM v_mapping")
def mapping_view(spark, sf_dir):
    return fx.mappings_view(spark, sf_dir)


@query(
    "mapping_statistics",
    "v_mapping",
    sql=f"SELECT {', '.join(views.STATISTIC_KEYS)}, count(*) AS count FROM v_mapping GROUP BY ALL",
)
def mapping_statistics(spark, sf_dir):
    return views.mapping_statistics(fx.mappings_view(spark, sf_dir))


@query(
    "mapper_label",
    "v_user",
    sql=f"SELECT user_id, {LABEL_SQL} AS mapper FROM v_user",
)
def mapper_label(spark, sf_dir):
    label = fn.mapper(F.col("last_name"), F.col("first_name"), F.col("organisation_name"))
    return fx.users_view(spark, sf_dir).select("user_id", label.alias("mapper"))


@query(
    "format_minute",
    sql=f"SELECT event_id, {MINUTE_SQL.format('ts')} AS minute FROM events",
)
def format_minute(spark, sf_dir):
    return fx.given(spark, sf_dir, "events").select("event_id", fn.minute_text(F.col("ts")).alias("minute"))


# --- mapping log ----------------------------------------------------------------------------


def _no_log(events):
    return events.limit(0).withColumn("valid", F.lit(True))


LOG_COLUMNS = ["mapping_id", "source_concept_id", "destination_concept_id", "destination_dialect_id", "is_bridge", "valid"]


@query("latest_mappings", "mapping", sql="SELECT mapping_id FROM mapping WHERE valid")
def latest_mappings(spark, sf_dir):
    return log.latest_mappings(fx.mapping_events(spark, sf_dir))


@query("fold_mappings", "mapping", sql=f"SELECT {', '.join(LOG_COLUMNS)} FROM mapping")
def fold_mappings(spark, sf_dir):
    """Every event has a dialect, so the closed form settles the log."""
    events = fx.mapping_events(spark, sf_dir)
    return log.fold_mappings(_no_log(events), events).select(*LOG_COLUMNS)


REPLAY_VALID = """SELECT unnest(list_transform(state, lambda x: x.id)) AS id
  FROM (SELECT source_concept_id, arg_max(state, n) AS state FROM replay GROUP BY source_concept_id)"""


@query(
    "fold_mappings_without_dialect",
    "replay",
    sql=f"""SELECT mapping_id, source_concept_id, destination_concept_id, destination_dialect_id, is_bridge,
       mapping_id IN ({REPLAY_VALID}) AS valid FROM mapping_event_null""",
)
def fold_mappings_without_dialect(spark, sf_dir):
    """Bridge events name no dialect, so the order of events decides."""
    events = fx.mapping_events(spark, sf_dir, bridge_without_dialect=True)
    return log.fold_mappings(_no_log(events), events).select(*LOG_COLUMNS)


@query(
    "fold_mappings_in_steps",
    "replay",
    sql=f"""SELECT mapping_id, source_concept_id, mapping_id IN ({REPLAY_VALID}) AS valid FROM mapping_event_null""",
)
def fold_mappings_in_steps(spark, sf_dir):
    """The same log built in two loads: the second starts from the settled first."""
    events = fx.mapping_events(spark, sf_dir, bridge_without_dialect=True)
    half = events.agg(F.max("mapping_id")).first()[0] // 2
    first = materialise(log.fold_mappings(_no_log(events), events.filter(F.col("mapping_id") <= half)))
    second = log.fold_mappings(first, events.filter(F.col("mapping_id") > half))
    return second.select("mapping_id", "source_concept_id", "valid")


MIXED_SQL = """SELECT mapping_id, source_concept_id, destination_dialect_id, is_bridge,
       mapping_id IN (SELECT unnest(list_transform(state, lambda x: x.id)) FROM replay_mixed) AS valid FROM mapping_event_mixed"""
MIXED_COLUMNS = ["mapping_id", "source_concept_id", "destination_dialect_id", "is_bridge", "valid"]
# Rows of a chunk where a query is to fold in chunks: one source holds a third of the events.
SMALL_CHUNK = 1_000


@query("fold_mappings_mixed", "replay_mixed", sql=MIXED_SQL)
def fold_mappings_mixed(spark, sf_dir):
    """Users and the bridge both may leave the dialect out, so only the order of the events decides."""
    events = fx.mixed_events(spark, sf_dir)
    return log.fold_mappings(_no_log(events), events).select(*MIXED_COLUMNS)


@query("fold_mappings_mixed_in_chunks", "replay_mixed", sql=MIXED_SQL)
def fold_mappings_mixed_in_chunks(spark, sf_dir):
    """The same, with every longer history cut into chunks that are folded in parallel."""
    events = fx.mixed_events(spark, sf_dir)
    return log.fold_mappings(_no_log(events), events, chunk_rows=SMALL_CHUNK).select(*MIXED_COLUMNS)


@query("fold_mappings_mixed_in_steps", "replay_mixed", sql=MIXED_SQL)
def fold_mappings_mixed_in_steps(spark, sf_dir):
    """The same in two loads: the second starts from the open rows of the settled first."""
    events = fx.mixed_events(spark, sf_dir)
    half = events.agg(F.max("mapping_id")).first()[0] // 2
    first = materialise(log.fold_mappings(_no_log(events), events.filter(F.col("mapping_id") <= half), chunk_rows=SMALL_CHUNK))
    return log.fold_mappings(first, events.filter(F.col("mapping_id") > half), chunk_rows=SMALL_CHUNK).select(*MIXED_COLUMNS)


@query(
    "derive_event_type",
    "request",
    sql="""SELECT request_id, CASE WHEN new_code IS NULL AND new_term IS NULL THEN 'Incorrect concept' ELSE 'User mapping' END AS event_type_name
  FROM request""",
)
def derive_event_type(spark, sf_dir):
    return log.derive_event_type(fx.requests(spark, sf_dir)).select("request_id", "event_type_name")


REQUEST_EVENT_SQL = """SELECT *, CASE WHEN new_code IS NULL AND new_term IS NULL THEN 'Incorrect concept' ELSE 'User mapping' END AS event_type_name,
       row_number() OVER (ORDER BY request_id, place) AS mapping_id FROM (
    SELECT * EXCLUDE (concept_id, old_concepts), unnest(range(1 + coalesce(len(old_concepts), 0))) AS place,
           unnest(list_prepend(concept_id, coalesce(old_concepts, []))) AS source_concept_id FROM request)"""


@query(
    "request_events",
    "request",
    sql=f"SELECT mapping_id, request_id, source_concept_id, event_type_name, new_code FROM ({REQUEST_EVENT_SQL})",
)
def request_events(spark, sf_dir):
    """Requests expanded to one numbered event per concept."""
    events = log.request_events(fx.requests(spark, sf_dir))
    return events.select("mapping_id", "request_id", "source_concept_id", "event_type_name", "new_code")


@query(
    "apply_requests",
    "request",
    "v_dialect",
    sql=f"""SELECT mapping_id, source_concept_id, event_type_name, target_dialect_id AS destination_dialect_id,
       CASE WHEN event_type_name = 'User mapping' THEN new_code END AS code_text,
       CASE WHEN event_type_name = 'User mapping' THEN new_term END AS term_text,
       CASE WHEN event_type_name = 'User mapping' THEN code_system_owner_organisation_id END AS organisation_id,
       row_number() OVER (PARTITION BY source_concept_id, target_dialect_id ORDER BY mapping_id DESC) = 1 AS valid
  FROM ({REQUEST_EVENT_SQL}) JOIN v_dialect ON target_dialect_id = dialect_id""",
)
def apply_requests(spark, sf_dir):
    """Requests as mappings: target concepts created under the target's owner, log settled."""
    tables = seeds.empty_tables(spark)
    none = spark.createDataFrame(
        [],
        "mapping_id long, user_id long, source_concept_id long, destination_concept_id long, destination_dialect_id long, "
        "event_type_name string, comment string, is_bridge boolean, valid boolean",
    )
    code, term, concept, mapping = log.apply_requests(
        fx.requests(spark, sf_dir), tables["code"], tables["term"], tables["concept"], fx.dialects_view(spark, sf_dir), none
    )
    target = concept.join(code, "code_id").join(term, "term_id").select(
        F.col("concept_id").alias("_key"), "code_text", "term_text", "organisation_id"
    )
    # rejected requests have no destination: a key of their own, since NULL would send all of them to one task
    key = F.coalesce("destination_concept_id", -1 - F.col("mapping_id"))
    return mapping.withColumn("_key", key).join(target, "_key", "left").select(
        "mapping_id",
        "source_concept_id",
        "event_type_name",
        "destination_dialect_id",
        "code_text",
        "term_text",
        "organisation_id",
        "valid",
    )


@query("upsert_notes", "note", sql="SELECT user_id, concept_id, note FROM note")
def upsert_notes(spark, sf_dir):
    edits = fx.note_edits(spark, sf_dir)
    return log.upsert_notes(edits.drop("edit_no").limit(0), edits)


@query(
    "set_defaults",
    "app_user",
    sql="""SELECT u.user_id, coalesce(s, default_source_dialect_id) AS default_source_dialect_id,
       coalesce(t, default_destination_dialect_id) AS default_destination_dialect_id
  FROM app_user u LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey % 25, o_orderkey) AS s, arg_max(o_orderkey % 7, o_orderkey) AS t
    FROM orders GROUP BY o_custkey) ON u.user_id = o_custkey""",
)
def set_defaults(spark, sf_dir):
    """Orders as choices of a default source and target dialect; the latest order decides."""
    key = F.col("o_orderkey")
    edits = fx.given(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        (key % 25).alias("source_dialect_id"),
        (key % 7).alias("destination_dialect_id"),
        key.alias("edit_no"),
    )
    return log.set_defaults(fx.user(spark, sf_dir), edits).select(
        "user_id", "default_source_dialect_id", "default_destination_dialect_id"
    )


# --- candidates, history, choices -----------------------------------------------------------


DICTIONARY_SQL = """SELECT source_code_system_id, match_on, match_text, destination_code_text, destination_term_text,
       destination_dialect_name, organisation_name, min(destination_concept_id) AS destination_concept_id FROM (
    SELECT *, 'code' AS match_on, source_code_text AS match_text FROM v_mapping
    UNION ALL SELECT *, 'term', source_term_text FROM v_mapping) WHERE destination_code_text <> '' GROUP BY ALL"""


@query("candidate_dictionary", "v_mapping", sql=DICTIONARY_SQL)
def candidate_dictionary(spark, sf_dir):
    return cand.candidate_dictionary(fx.mappings_view(spark, sf_dir))


@query(
    "candidates_any",
    "page_concept",
    "v_mapping",
    sql="""SELECT c.concept_id, destination_code_text, destination_term_text, destination_dialect_name, organisation_name,
       min(destination_concept_id) AS destination_concept_id
  FROM page_concept c JOIN v_mapping m ON m.source_code_system_id = c.code_system_id
       AND (m.source_code_text = c.code_text OR m.source_term_text = c.term_text)
 WHERE destination_code_text <> '' GROUP BY ALL""",
)
def candidates_any(spark, sf_dir):
    """Loose candidates for the page of each dialect's most observed concept."""
    concepts = fx.concepts_view(spark, sf_dir)
    return cand.candidates_any(fx.page_concepts(concepts), fx.mappings_view(spark, sf_dir, concepts))


EXACT_SQL = """SELECT concept_id, source_code_text, source_term_text, destination_code_text, destination_term_text,
       destination_dialect_name, organisation_name, destination_concept_id FROM (
    SELECT c.concept_id, m.source_code_text, m.source_term_text, m.destination_code_text, m.destination_term_text,
           m.destination_dialect_name, m.organisation_name, m.destination_concept_id,
           row_number() OVER (PARTITION BY c.concept_id, m.destination_code_text, m.destination_term_text, m.destination_dialect_name
                              ORDER BY m.organisation_name, m.destination_concept_id, m.source_code_text, m.source_term_text) AS rn
      FROM (SELECT DISTINCT concept_id, code_text, term_text, code_system_id FROM v_concept) c
      JOIN v_mapping m ON m.source_code_system_id = c.code_system_id AND upper(m.source_code_text) = upper(c.code_text)
           AND upper(m.source_term_text) = upper(c.term_text)
     WHERE m.destination_code_text <> '') WHERE rn = 1"""


@query("candidates_exact", "v_concept", "v_mapping", sql=EXACT_SQL)
def candidates_exact(spark, sf_dir):
    """Strict candidates for every concept."""
    concepts = fx.concepts_view(spark, sf_dir)
    return cand.candidates_exact(concepts, fx.mappings_view(spark, sf_dir, concepts))


@query(
    "single_candidates",
    "v_concept",
    "v_mapping",
    sql=f"""SELECT * FROM ({EXACT_SQL}) QUALIFY count(*) OVER (PARTITION BY concept_id) = 1""",
)
def single_candidates(spark, sf_dir):
    return cand.single_candidates(candidates_exact(spark, sf_dir))


@query(
    "mapping_history",
    "v_mapping",
    sql=f"""SELECT source_concept_id, mapping_id, {SHOWN_SQL.format("destination_code_text, destination_term_text")},
       row_number() OVER (ORDER BY source_concept_id, v_mapping.insert_ts DESC, mapping_id DESC,
         coalesce(source_concept_metadata_id, -1), coalesce(destination_concept_metadata_id, -1)) AS position
  FROM v_mapping WHERE valid""",
)
def mapping_history(spark, sf_dir):
    return cand.mapping_history(fx.mappings_view(spark, sf_dir))


@query(
    "destination_groups",
    "v_mapping",
    sql=f"""SELECT destination_concept_id, count(*) OVER (PARTITION BY destination_concept_id) AS group_size, mapping_id,
       {SHOWN_SQL.format("source_code_text, source_term_text")} FROM v_mapping WHERE valid AND destination_concept_id IS NOT NULL""",
)
def destination_groups(spark, sf_dir):
    return cand.destination_groups(fx.mappings_view(spark, sf_dir))


@query(
    "same_destination",
    "v_mapping",
    sql=f"""SELECT * FROM (WITH valid_row AS (SELECT * FROM v_mapping WHERE valid AND destination_concept_id IS NOT NULL),
  page AS (SELECT DISTINCT source_concept_id FROM valid_row WHERE mapping_id IN (SELECT max(mapping_id) FROM valid_row GROUP BY destination_concept_id))
  SELECT p.source_concept_id AS page_concept_id, m.mapping_id, m.destination_concept_id,
         {SHOWN_SQL.format("m.source_code_text, m.source_term_text").replace("valid,", "m.valid,", 1).replace("last_name", "m.last_name").replace("first_name", "m.first_name").replace("organisation_name", "m.organisation_name").replace("event_type_name", "m.event_type_name").replace("(comment", "(m.comment").replace("strftime(insert_ts", "strftime(m.insert_ts")}
    FROM valid_row m JOIN valid_row p ON m.destination_concept_id = p.destination_concept_id
   WHERE p.source_concept_id IN (SELECT source_concept_id FROM page))""",
)
def same_destination(spark, sf_dir):
    """The page of the concept mapped last to each destination."""
    mappings = materialise(fx.mappings_view(spark, sf_dir))
    valid = mappings.filter("valid").filter(F.col("destination_concept_id").isNotNull())
    newest = valid.groupBy("destination_concept_id").agg(F.max_by("source_concept_id", "mapping_id").alias("concept_id"))
    return cand.same_destination(mappings, newest)


@query(
    "destination_newest",
    "v_mapping",
    sql=f"""SELECT * EXCLUDE (place), (place - 1) // 4 + 1 AS page, (place - 1) % 4 + 1 AS position FROM (
  SELECT destination_concept_id, mapping_id, {SHOWN_SQL.format("source_code_text, source_term_text")},
         row_number() OVER (PARTITION BY destination_concept_id ORDER BY v_mapping.insert_ts DESC, mapping_id DESC,
           coalesce(source_concept_metadata_id, -1), coalesce(destination_concept_metadata_id, -1)) AS place
    FROM v_mapping WHERE valid AND destination_concept_id IS NOT NULL) WHERE place <= 8""",
)
def destination_newest(spark, sf_dir):
    """The two newest pages of four for every destination, the second from the cursor of the first."""
    mappings = materialise(fx.mappings_view(spark, sf_dir).filter("valid"))
    first = materialise(cand.newest_of_destination(mappings, 4))
    second = cand.newest_of_destination(mappings, 4, after=first)
    both = first.withColumn("page", F.lit(1).cast("long")).unionByName(second.withColumn("page", F.lit(2).cast("long")))
    return both.drop("cursor")


@query(
    "mapped_terms",
    "v_mapping",
    sql="""SELECT source_code_text AS code_text, arg_max(source_term_text, mapping_id) AS term_text FROM v_mapping GROUP BY source_code_text""",
)
def mapped_terms(spark, sf_dir):
    return cand.mapped_terms(fx.mappings_view(spark, sf_dir))


@query(
    "source_systems",
    "v_concept",
    sql="""SELECT DISTINCT code_system_name, code_system_owner_organisation_name, organisation_name, dialect_name, code_system_id FROM v_concept""",
)
def source_systems(spark, sf_dir):
    return cand.source_systems(fx.concepts_view(spark, sf_dir))


@query(
    "user_defaults",
    "app_user",
    "v_dialect",
    sql="""SELECT user_id, s.code_system_name AS source_system, s.code_system_id AS source_system_id, s.dialect_name AS source_dialect,
       s.dialect_id AS source_dialect_id, t.code_system_name AS target_system, t.code_system_id AS target_system_id,
       t.dialect_name AS target_dialect, t.dialect_id AS target_dialect_id
  FROM app_user JOIN v_dialect s ON default_source_dialect_id = s.dialect_id JOIN v_dialect t ON default_destination_dialect_id = t.dialect_id""",
)
def user_defaults(spark, sf_dir):
    return cand.user_defaults(fx.user(spark, sf_dir), fx.dialects_view(spark, sf_dir))


@query(
    "target_options",
    "v_dialect",
    "v_concept",
    sql="""SELECT t.code_system_name, t.code_system_owner_organisation_name, t.dialect_name, t.code_system_id, count(v.concept_id) AS concepts
  FROM v_dialect t LEFT JOIN (SELECT DISTINCT concept_id, dialect_name FROM v_concept) v ON v.dialect_name = t.dialect_name
 WHERE t.is_official AND (t.code_system_name <> 'AFRICA' OR t.dialect_name <> 'NATION_0 dialect' OR t.code_system_owner_organisation_name <> 'NATION_0')
 GROUP BY ALL""",
)
def target_options(spark, sf_dir):
    """Possible target systems for one source, with the number of concepts each offers."""
    options = cand.target_options(fx.dialects_view(spark, sf_dir), "AFRICA", "NATION_0 dialect", "NATION_0")
    concepts = fx.concept(spark, sf_dir).join(fx.dialect(spark, sf_dir).select("dialect_id", "dialect_name"), "dialect_id")
    sizes = concepts.groupBy("dialect_name").agg(F.count(F.lit(1)).alias("concepts"))
    return options.join(sizes, "dialect_name", "left").withColumn("concepts", F.coalesce("concepts", F.lit(0)))


# --- integrity ------------------------------------------------------------------------------


def _sql_audit() -> str:
    names = {
        "mapping": "mapping", "concept": "concept", "synonym": "synonym_row", "user": "app_user", "code_system": "code_system",
        "dialect": "dialect", "concept_metadata": "concept_metadata", "user_concept_note": "note", "term": "term",
        "code": "code", "organisation": "organisation", "event_type": "event_type_dim",
    }
    lines = [
        f"SELECT 'foreign_key' AS rule, '{child}' AS table_name, '{column}' AS columns, count(*) AS violations FROM {names[child]} c "
        f"WHERE c.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {names[parent]} p WHERE p.{key} = c.{column})"
        for child, column, parent, key in integrity.FOREIGN_KEYS
        if child in names and parent in names
    ]
    lines += [
        f"SELECT 'unique', '{table}', '{','.join(columns)}', count(*) FROM (SELECT {', '.join(columns)} FROM {names[table]} "
        f"WHERE {' AND '.join(c + ' IS NOT NULL' for c in columns)} GROUP BY ALL HAVING count(*) > 1)"
        for table, columns in integrity.UNIQUE_KEYS
        if table in names
    ]
    lines += [
        f"SELECT 'not_null', '{table}', '{column}', count(*) FROM {names[table]} WHERE {column} IS NULL"
        for table, columns in integrity.REQUIRED.items()
        if table in names
        for column in columns
    ]
    return "\nUNION ALL ".join(lines)


fx.SQL["synonym_row"] = (
    ("part_code", "code"),
    f"""SELECT p_partkey AS synonym_id, code_id, code_raw AS synonym, p_partkey % 25 AS dialect_id FROM part_code
  JOIN code ON code_text = {fx.OVERLAY_SQL["T"].format("code_raw")} WHERE code_raw IS NOT NULL""",
)


@query(
    "integrity_audit",
    "mapping", "concept", "synonym_row", "app_user", "code_system", "dialect", "concept_metadata", "note", "term", "code",
    "organisation", "event_type_dim",
    sql=_sql_audit(),
)
def integrity_audit(spark, sf_dir):
    """The derived tables break some rules on purpose: unknown concepts, repeated synonyms."""
    edits = fx.note_edits(spark, sf_dir)
    return integrity.audit(
        {
            "mapping": fx.mapping_log(spark, sf_dir),
            "concept": fx.concept(spark, sf_dir),
            "synonym": _synonyms(spark, sf_dir),
            "user": fx.user(spark, sf_dir),
            "code_system": fx.code_system(spark, sf_dir),
            "dialect": fx.dialect(spark, sf_dir),
            "concept_metadata": fx.concept_metadata(spark, sf_dir),
            "user_concept_note": log.upsert_notes(edits.drop("edit_no").limit(0), edits),
            "term": fx.term(spark, sf_dir),
            "code": fx.code(spark, sf_dir),
            "organisation": fx.organisation(spark, sf_dir),
            "event_type": fx.event_type(spark, sf_dir),
        }
    )
