"""Denormalising views over the harmonised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATISTIC_KEYS = [
    f"{side}_{part}"
    for side in ("source", "destination")
    for part in (
        "organisation_id",
        "organisation_name",
        "dialect_id",
        "dialect_name",
        "code_system_id",
        "code_system_name",
    )
]


def v_user(user: DataFrame, organisation: DataFrame) -> DataFrame:
    """Users with the name of their organisation; secrets are not part of the table."""
    names = organisation.select("organisation_id", F.col("name").alias("organisation_name"))
    return user.join(names, "organisation_id").select(
        "user_id",
        "username",
        "email",
        "last_name",
        "first_name",
        "organisation_id",
        "organisation_name",
    )


def v_dialect(dialect: DataFrame, code_system: DataFrame, organisation: DataFrame) -> DataFrame:
    systems = code_system.select(
        "code_system_id",
        F.col("name").alias("code_system_name"),
        F.col("owner_organisation_id").alias("code_system_owner_organisation_id"),
    )
    owners = organisation.select(
        F.col("organisation_id").alias("code_system_owner_organisation_id"),
        F.col("name").alias("code_system_owner_organisation_name"),
    )
    return (
        dialect.join(systems, "code_system_id")
        .join(owners, "code_system_owner_organisation_id")
        .select(
            "dialect_id",
            "dialect_name",
            "is_official",
            "code_system_id",
            "code_system_name",
            "code_system_owner_organisation_id",
            "code_system_owner_organisation_name",
        )
    )


def v_synonym(synonym: DataFrame, code: DataFrame, dialect: DataFrame) -> DataFrame:
    return (
        synonym.join(code.select("code_id", "code_text"), "code_id")
        .join(dialect.select("dialect_id", "dialect_name"), "dialect_id")
        .select("code_id", "code_text", "synonym_id", "synonym", "dialect_id", "dialect_name")
    )


def v_concept(
    concept: DataFrame,
    code: DataFrame,
    term: DataFrame,
    organisation: DataFrame,
    dialects: DataFrame,
    metadata: DataFrame,
) -> DataFrame:
    """Concepts with all names; ``dialects`` is ``v_dialect``.

    Metadata is outer-joined: a concept with several metadata rows is repeated.
    """
    names = organisation.select("organisation_id", F.col("name").alias("organisation_name"))
    return (
        concept.join(code.select("code_id", "code_text"), "code_id")
        .join(term.select("term_id", "term_text"), "term_id")
        .join(names, "organisation_id")
        .join(dialects, "dialect_id")
        .join(metadata, "concept_id", "left")
        .select(
            "concept_id",
            "code_id",
            "code_text",
            "term_id",
            "term_text",
            "organisation_id",
            "organisation_name",
            *dialects.columns,
            "concept_metadata_id",
            "obs_number",
            "first_obs_date",
            "last_obs_date",
        )
    )


def v_mapping(
    mapping: DataFrame,
    concepts: DataFrame,
    users: DataFrame,
    event_type: DataFrame,
    dialect: DataFrame,
) -> DataFrame:
    """Mappings with both concepts, mapper and event name; ``concepts`` is ``v_concept``.

    The destination is outer-joined. Without one, the dialect stored on the mapping is shown. Mappings without a
    destination meet nothing, whatever their key, so each has a key of its own below zero: NULL would send all of
    them to one task. Ids of concepts are positive.
    """

    def side(prefix: str) -> DataFrame:
        shown = [c for c in concepts.columns if c != "is_official"]
        return concepts.select(*[F.col(c).alias(f"{prefix}_{c}") for c in shown])

    source, destination = side("source"), side("destination")
    resolved = destination.withColumnsRenamed(
        {"destination_concept_id": "_key", "destination_dialect_id": "own_dialect_id", "destination_dialect_name": "own_dialect_name"}
    )
    key = F.coalesce(F.col("destination_concept_id").cast("long"), -1 - F.col("mapping_id").cast("long"))
    stored = dialect.select(
        F.col("dialect_id").alias("stored_dialect_id"), F.col("dialect_name").alias("stored_dialect_name")
    )
    events = event_type.select("event_type_id", F.col("name").alias("event_type_name"))
    joined = (
        mapping.withColumnRenamed("destination_dialect_id", "stored_dialect_id")
        .join(events, "event_type_id")
        .join(users, "user_id")
        .join(stored, "stored_dialect_id", "left")
        .join(source, "source_concept_id")
        .withColumn("_key", key)
        .join(resolved.withColumn("_key", F.col("_key").cast("long")), "_key", "left")
    )
    found = F.col("destination_code_id").isNotNull()
    return joined.select(
        "mapping_id",
        "valid",
        "user_id",
        "username",
        "last_name",
        "first_name",
        "organisation_id",
        "organisation_name",
        "session_id",
        *source.columns,
        "destination_concept_id",
        *[c for c in resolved.columns if c not in ("_key", "own_dialect_id", "own_dialect_name")],
        # stored_dialect_name is NULL when the dialect does not exist, and then so is the id shown
        F.when(found, F.col("own_dialect_id"))
        .when(F.col("stored_dialect_name").isNotNull(), F.col("stored_dialect_id"))
        .alias("destination_dialect_id"),
        F.when(found, F.col("own_dialect_name"))
        .otherwise(F.col("stored_dialect_name"))
        .alias("destination_dialect_name"),
        "event_type_name",
        "comment",
        "insert_ts",
        "update_ts",
    )


def mapping_statistics(mappings: DataFrame) -> DataFrame:
    """Row count per source and destination organisation, dialect and code system; NULL is a group."""
    return mappings.groupBy(*STATISTIC_KEYS).agg(F.count(F.lit(1)).alias("count"))
