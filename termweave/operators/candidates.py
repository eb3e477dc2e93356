"""Candidate mappings, history and choices of source and target system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.runtime import ranked

_TARGET = ["destination_code_text", "destination_term_text", "destination_dialect_name"]


def _between(mappings: DataFrame, source_system: int | None, target_system: int | None) -> DataFrame:
    """Mappings between the chosen systems with a destination code, valid or not."""
    kept = mappings.filter(F.col("destination_code_text") != "")
    if source_system is not None:
        kept = kept.filter(F.col("source_code_system_id") == source_system)
    if target_system is not None:
        kept = kept.filter(F.col("destination_code_system_id") == target_system)
    return kept


def candidate_dictionary(
    mappings: DataFrame, source_system: int | None = None, target_system: int | None = None
) -> DataFrame:
    """Distinct destinations per source code and per source term, one row per mapper organisation.

    The lowest destination id survives. The result is no larger than twice the mapping log.
    """
    kept = _between(mappings, source_system, target_system)
    match = F.explode(
        F.array(
            F.struct(F.lit("code").alias("match_on"), F.col("source_code_text").alias("match_text")),
            F.struct(F.lit("term").alias("match_on"), F.col("source_term_text").alias("match_text")),
        )
    ).alias("match")
    wide = kept.select(
        "source_code_system_id", match, *_TARGET, "organisation_name", "destination_concept_id"
    ).select("*", "match.*")
    return wide.groupBy(
        "source_code_system_id", "match_on", "match_text", *_TARGET, "organisation_name"
    ).agg(F.min("destination_concept_id").alias("destination_concept_id"))


def candidates_any(
    concepts: DataFrame,
    mappings: DataFrame,
    source_system: int | None = None,
    target_system: int | None = None,
) -> DataFrame:
    """Destinations of mappings whose source has the concept's code or its term.

    ``concepts`` holds the page concepts: concept_id, code_text, term_text and code_system_id. One
    equi-join against the dictionary replaces the OR condition.
    """
    words = concepts.select(
        "concept_id",
        F.col("code_system_id").alias("source_code_system_id"),
        F.explode(
            F.array(
                F.struct(F.lit("code").alias("match_on"), F.col("code_text").alias("match_text")),
                F.struct(F.lit("term").alias("match_on"), F.col("term_text").alias("match_text")),
            )
        ).alias("match"),
    ).select("concept_id", "source_code_system_id", "match.*").distinct()
    found = words.join(
        candidate_dictionary(mappings, source_system, target_system),
        ["source_code_system_id", "match_on", "match_text"],
    )
    return found.groupBy("concept_id", *_TARGET, "organisation_name").agg(
        F.min("destination_concept_id").alias("destination_concept_id")
    )


def candidates_exact(
    concepts: DataFrame,
    mappings: DataFrame,
    source_system: int | None = None,
    target_system: int | None = None,
) -> DataFrame:
    """Destinations of mappings whose source has the concept's code and term, ignoring case.

    One row per destination code, term and dialect; the lowest (organisation, id) survives.
    """
    survivor = F.min(
        F.struct("organisation_name", "destination_concept_id", "source_code_text", "source_term_text")
    )
    known = (
        _between(mappings, source_system, target_system)
        .groupBy(
            "source_code_system_id",
            F.upper("source_code_text").alias("upper_code"),
            F.upper("source_term_text").alias("upper_term"),
            *_TARGET,
        )
        .agg(survivor.alias("first"))
    )
    asked = concepts.select(
        "concept_id",
        F.col("code_system_id").alias("source_code_system_id"),
        F.upper("code_text").alias("upper_code"),
        F.upper("term_text").alias("upper_term"),
    ).distinct()
    return asked.join(known, ["source_code_system_id", "upper_code", "upper_term"]).select(
        "concept_id",
        "first.source_code_text",
        "first.source_term_text",
        *_TARGET,
        "first.organisation_name",
        "first.destination_concept_id",
    )


def single_candidates(candidates: DataFrame) -> DataFrame:
    """Concepts with exactly one candidate, together with it."""
    rest = [c for c in candidates.columns if c != "concept_id"]
    return (
        candidates.groupBy("concept_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*rest)).alias("only"))
        .filter("n = 1")
        .select("concept_id", "only.*")
    )


def _shown(extra: Sequence[str | Column]) -> list:
    return [
        "valid",
        fn.mapper(F.col("last_name"), F.col("first_name"), F.col("organisation_name")).alias("mapper"),
        *extra,
        "event_type_name",
        F.coalesce("comment", F.lit("")).alias("comment"),
        fn.minute_text(F.col("insert_ts")).alias("insert_ts"),
    ]


def mapping_history(mappings: DataFrame) -> DataFrame:
    """Valid mappings of each concept, newest first, numbered over the whole result."""
    rows = mappings.filter("valid").withColumn("sort_ts", F.col("insert_ts"))
    order = [F.col("source_concept_id"), F.col("sort_ts").desc_nulls_last(), F.col("mapping_id").desc()]
    shown = rows.select(
        "source_concept_id",
        "mapping_id",
        "sort_ts",
        F.coalesce("source_concept_metadata_id", F.lit(-1)).alias("source_row"),
        F.coalesce("destination_concept_metadata_id", F.lit(-1)).alias("destination_row"),
        *_shown(["destination_code_text", "destination_term_text"]),
    )
    numbered = ranked(shown, *order, F.col("source_row"), F.col("destination_row"))
    return numbered.drop("sort_ts", "source_row", "destination_row")


def same_destination(mappings: DataFrame, concepts: DataFrame) -> DataFrame:
    """Valid mappings that share a destination with a valid mapping of the page concept.

    ``concepts`` holds concept_id, the pages asked for. The concept itself is included, rows keep
    their multiplicity and mappings without destination drop out.
    """
    valid = mappings.filter("valid").filter(F.col("destination_concept_id").isNotNull())
    pages = (
        valid.join(concepts.select(F.col("concept_id").alias("source_concept_id")).distinct(), "source_concept_id", "left_semi")
        .select(F.col("source_concept_id").alias("page_concept_id"), "destination_concept_id")
    )
    return valid.join(pages, "destination_concept_id").select(
        "page_concept_id",
        "mapping_id",
        "destination_concept_id",
        *_shown(["source_code_text", "source_term_text"]),
    )


def destination_groups(mappings: DataFrame) -> DataFrame:
    """Every valid mapping with the size of its destination's group.

    A concept's page lists the rows of its destination; stored once per destination the listing
    stays linear, while one copy per asking concept would be quadratic for popular destinations.
    """
    valid = mappings.filter("valid").filter(F.col("destination_concept_id").isNotNull())
    sizes = valid.groupBy("destination_concept_id").agg(F.count(F.lit(1)).alias("group_size"))
    return valid.join(sizes, "destination_concept_id").select(
        "destination_concept_id",
        "group_size",
        "mapping_id",
        *_shown(["source_code_text", "source_term_text"]),
    )


def newest_of_destination(mappings: DataFrame, length: int, concepts: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """The newest ``length`` valid mappings of each destination, with ``position`` from 1 and a ``cursor``.

    ``concepts`` (concept_id) names the pages asked for: only destinations they are mapped to are listed, once each however many
    pages share them. ``after`` is an earlier result: the rows behind its last row of each destination follow, and destinations not
    in it are left out. Every task keeps at most ``length`` rows of a destination before the shuffle.
    """
    key = "destination_concept_id"
    valid = mappings.filter("valid").filter(F.col(key).isNotNull())
    if concepts is not None:
        asked = valid.join(concepts.select(F.col("concept_id").alias("source_concept_id")), "source_concept_id", "left_semi")
        valid = valid.join(asked.select(key).distinct(), key, "left_semi")
    cursor = F.struct(
        F.col("insert_ts").alias("newest"),
        F.col("mapping_id"),
        (-F.coalesce("source_concept_metadata_id", F.lit(-1))).alias("source_row"),
        (-F.coalesce("destination_concept_metadata_id", F.lit(-1))).alias("destination_row"),
    )
    rows = valid.select(key, "mapping_id", *_shown(["source_code_text", "source_term_text"]), cursor.alias("cursor"))
    if after is not None:
        last = after.groupBy(key).agg(F.min("cursor").alias("last"))
        rows = rows.join(last, key).filter(F.col("cursor") < F.col("last")).drop("last")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("cursor").desc()))
    return rows.withColumn("position", place.cast("long")).filter(F.col("position") <= length)


def mapped_terms(mappings: DataFrame) -> DataFrame:
    """Code to term dictionary of mapped sources; the newest mapping of a code wins."""
    return mappings.groupBy(F.col("source_code_text").alias("code_text")).agg(
        F.max(F.struct("mapping_id", "source_term_text")).alias("last")
    ).select("code_text", F.col("last.source_term_text").alias("term_text"))


def source_systems(concepts: DataFrame, organisation_id: int | None = None) -> DataFrame:
    """Distinct source systems of an organisation (of all, when none is given), by code system id."""
    columns = [
        "code_system_name",
        "code_system_owner_organisation_name",
        "organisation_name",
        "dialect_name",
        "code_system_id",
    ]
    own = concepts if organisation_id is None else concepts.filter(F.col("organisation_id") == organisation_id)
    return own.select(*columns).distinct().orderBy("code_system_id", *columns[:4])


def user_defaults(user: DataFrame, dialects: DataFrame) -> DataFrame:
    """Default source and target system of the users who have both set."""

    def side(prefix: str, key: str) -> DataFrame:
        return dialects.select(
            F.col("dialect_id").alias(key),
            F.col("code_system_name").alias(f"{prefix}_system"),
            F.col("code_system_id").alias(f"{prefix}_system_id"),
            F.col("dialect_name").alias(f"{prefix}_dialect"),
        )

    source, target = "default_source_dialect_id", "default_destination_dialect_id"
    return (
        user.filter(F.col(source).isNotNull() & F.col(target).isNotNull())
        .join(side("source", source), source)
        .join(side("target", target), target)
        .select(
            "user_id",
            "source_system",
            "source_system_id",
            "source_dialect",
            F.col(source).alias("source_dialect_id"),
            "target_system",
            "target_system_id",
            "target_dialect",
            F.col(target).alias("target_dialect_id"),
        )
    )


def target_options(dialects: DataFrame, system: str, dialect: str, owner: str) -> DataFrame:
    """Official dialects that differ from the chosen source in system, dialect or owner."""
    differs = (
        (F.col("code_system_name") != system)
        | (F.col("dialect_name") != dialect)
        | (F.col("code_system_owner_organisation_name") != owner)
    )
    return (
        dialects.filter(differs & F.col("is_official"))
        .select("code_system_name", "code_system_owner_organisation_name", "dialect_name", "code_system_id")
        .orderBy("code_system_id", "dialect_name")
    )
