"""Shared dimensions: get-or-create codes, terms and concepts, synonyms and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.runtime import materialise, ranked


def distinct_values(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return df.select(F.col(column).alias(out or column)).distinct()


def union_axes(*axes: DataFrame) -> DataFrame:
    """Distinct union of the concept pairs of several axes."""
    pairs = axes[0]
    for other in axes[1:]:
        pairs = pairs.unionByName(other)
    return pairs.distinct()


def next_id(df: DataFrame, id_column: str) -> int:
    """One above the highest id."""
    return (df.agg(F.max(id_column)).first()[0] or 0) + 1


def append_new(existing: DataFrame, candidates: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """Give every unseen key the next free id, in key order; existing rows keep theirs.

    A NULL key cannot be stored and is left out.
    """
    fresh = (
        candidates.select(*keys)
        .dropna(subset=list(keys))
        .distinct()
        .join(existing.select(*keys), list(keys), "left_anti")
    )
    numbered = ranked(fresh, *map(F.col, keys), name=id_column, start=next_id(existing, id_column))
    return existing.unionByName(numbered.select(*existing.columns))


def upsert_codes(existing: DataFrame, texts: DataFrame) -> DataFrame:
    return append_new(existing, texts, ["code_text"], "code_id")


def upsert_terms(existing: DataFrame, texts: DataFrame) -> DataFrame:
    return append_new(existing, texts, ["term_text"], "term_id")


def upsert_concepts(
    code: DataFrame, term: DataFrame, concept: DataFrame, pairs: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Get-or-create concepts for (code_text, term_text, organisation_id, dialect_id) rows.

    Returns the extended code, term and concept tables.
    """
    code = upsert_codes(code, pairs)
    term = upsert_terms(term, pairs)
    keys = ["code_id", "term_id", "organisation_id", "dialect_id"]
    wanted = pairs.join(code, "code_text").join(term, "term_text").select(*keys)
    return code, term, append_new(concept, wanted, keys, "concept_id")


def dialect_id(dialect: DataFrame, code_system: DataFrame, name: str, system: str | None = None) -> Column:
    """The id of one dialect, resolved by its name and, if given, its code system's name."""
    chosen = dialect.filter(F.col("dialect_name") == name)
    if system is not None:
        chosen = chosen.join(code_system.filter(F.col("name") == system), "code_system_id")
    return chosen.select("dialect_id").scalar()


def organisation_id(organisation: DataFrame, name: str) -> Column:
    return organisation.filter(F.col("name") == name).select("organisation_id").scalar()


def load_synonyms(existing: DataFrame, staging: DataFrame, code: DataFrame) -> DataFrame:
    """Add (original spelling, code, dialect) where the spelling differs from the code.

    ``staging`` holds code_original, code_harmonised and dialect_id. A (code, spelling) pair that
    exists keeps its row; among new rows of one pair the lowest dialect is kept.
    """
    spelled = staging.filter(F.col("code_original") != F.col("code_harmonised")).select(
        F.col("code_original").alias("synonym"),
        F.col("code_harmonised").alias("code_text"),
        "dialect_id",
    )
    wanted = (
        spelled.groupBy("code_text", "synonym")
        .agg(F.min("dialect_id").alias("dialect_id"))
        .join(code, "code_text")
        .select("code_id", "synonym", "dialect_id")
        .join(existing.select("code_id", "synonym"), ["code_id", "synonym"], "left_anti")
    )
    order = [F.col("code_id"), F.col("synonym")]
    numbered = ranked(wanted, *order, name="synonym_id", start=next_id(existing, "synonym_id"))
    return existing.unionByName(numbered.select(*existing.columns))


def load_metadata(
    staging: DataFrame, code: DataFrame, term: DataFrame, concept: DataFrame
) -> DataFrame:
    """Staged counts attached to their concept, without ids.

    ``staging`` holds code_harmonised, term_text, organisation_id, dialect_id, obs_number and the
    optional min_ts and max_ts. Each staged row gives one row, so a concept may get several.
    """
    named = (
        concept.join(code, "code_id")
        .join(term, "term_id")
        .select("concept_id", "code_text", "term_text", "organisation_id", "dialect_id")
    )
    staged = staging.withColumnRenamed("code_harmonised", "code_text")
    keys = ["code_text", "term_text", "organisation_id", "dialect_id"]

    def day(column: str) -> Column:
        return F.col(column).cast("date") if column in staging.columns else F.lit(None).cast("date")

    return staged.join(named, keys).select(
        "concept_id",
        F.col("obs_number").cast("int").alias("obs_number"),
        day("min_ts").alias("first_obs_date"),
        day("max_ts").alias("last_obs_date"),
    )


def replace_metadata(existing: DataFrame, loaded: DataFrame, owned: DataFrame) -> DataFrame:
    """Swap the metadata of the ``owned`` concepts for freshly loaded rows, so a reload adds nothing."""
    kept = existing.join(owned.select("concept_id"), "concept_id", "left_anti").select(*existing.columns)
    kept = materialise(kept)
    order = [F.col(c) for c in ("concept_id", "first_obs_date", "last_obs_date", "obs_number")]
    numbered = ranked(loaded, *order, name="concept_metadata_id", start=next_id(kept, "concept_metadata_id"))
    return kept.unionByName(numbered.select(*kept.columns))


def delete_concepts(
    concept: DataFrame, metadata: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Delete concepts and, with them, their metadata."""
    gone = ids.select("concept_id").distinct()
    return (
        concept.join(gone, "concept_id", "left_anti").select(*concept.columns),
        metadata.join(gone, "concept_id", "left_anti").select(*metadata.columns),
    )


def clean_pairs(df: DataFrame, code: str, term: str) -> DataFrame:
    """Distinct cleaned (code_text, term_text) pairs of a raw table."""
    return df.select(fn.clean(F.col(code)).alias("code_text"), fn.clean(F.col(term)).alias("term_text")).distinct()
