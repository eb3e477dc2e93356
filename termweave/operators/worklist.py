"""Work lists: every concept of a source dialect with its mapping state for one viewer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.runtime import materialise
from termweave.schemas import BRIDGE_MAPPING

# Statuses, best first.
STATUSES = ("self", "own_organisation", "other_organisation", "bridge")
# Fixed value: text of the marker column.
MARKER = "Huomio"

_RANK = {status: len(STATUSES) - i for i, status in enumerate(STATUSES)}


_PICKED = ["rank", "mapping_id", "status", "destination_code_text", "destination_term_text", "mapping_user", "mapping_ts"]


def _pick(status: Column) -> list:
    """Columns of one possible choice; the highest (rank, mapping_id) wins."""
    rank = F.coalesce(*[F.when(status == name, rank) for name, rank in _RANK.items()])
    return [rank.alias("rank"), "mapping_id", status.alias("status"), *_PICKED[3:]]


def concept_worklist(
    concepts: DataFrame, mappings: DataFrame, viewers: DataFrame, notes: DataFrame
) -> DataFrame:
    """Status, destination and note of each concept in each viewer's list.

    ``concepts`` is ``v_concept``, ``mappings`` is ``v_mapping``; ``viewers`` holds user_id,
    organisation_id, source_dialect_id and target_dialect_id, one row per list. Valid mappings to the
    target dialect count, best first: by the viewer, by the viewer's organisation, of another concept
    with equal upper-case code and term by users, the same by the bridge; then the newest.
    """
    lists = concepts.join(
        viewers.select(
            "user_id",
            F.col("organisation_id").alias("viewer_organisation_id"),
            F.col("source_dialect_id").alias("dialect_id"),
            "target_dialect_id",
        ),
        "dialect_id",
    )
    keys = lists.select(
        "user_id",
        "viewer_organisation_id",
        "target_dialect_id",
        "concept_id",
        F.upper("code_text").alias("upper_code"),
        F.upper("term_text").alias("upper_term"),
    ).distinct()

    # both joins below read the valid mappings, which cost several joins themselves
    valid = materialise(
        mappings.filter("valid").select(
            "mapping_id",
            "source_concept_id",
            F.col("destination_dialect_id").alias("target_dialect_id"),
            F.col("user_id").alias("mapper_id"),
            F.col("organisation_id").alias("mapper_organisation_id"),
            F.upper("source_code_text").alias("upper_code"),
            F.upper("source_term_text").alias("upper_term"),
            (F.col("event_type_name") == BRIDGE_MAPPING).alias("is_bridge"),
            "destination_code_text",
            "destination_term_text",
            fn.mapper(F.col("last_name"), F.col("first_name"), F.col("organisation_name")).alias("mapping_user"),
            fn.minute_text(F.col("insert_ts")).alias("mapping_ts"),
        )
    )

    by_concept = valid.withColumnRenamed("source_concept_id", "concept_id").drop("upper_code", "upper_term")
    mapper = F.when(F.col("mapper_id") == F.col("user_id"), "self").when(
        F.col("mapper_organisation_id") == F.col("viewer_organisation_id"), "own_organisation"
    )
    direct = keys.join(by_concept, ["concept_id", "target_dialect_id"]).filter(mapper.isNotNull())

    # Two concepts per key are enough: whichever concept asks, the newest other one is among them.
    alike_key = ["upper_code", "upper_term", "target_dialect_id", "is_bridge"]
    per_concept = valid.groupBy(*alike_key, "source_concept_id").agg(
        F.max(F.struct("mapping_id", *_PICKED[3:])).alias("best")
    )
    newest = Window.partitionBy(*alike_key).orderBy(F.desc("best.mapping_id"))
    alike = (
        per_concept.withColumn("place", F.row_number().over(newest))
        .filter("place <= 2")
        .select(*alike_key, "source_concept_id", "best.*")
    )
    similar = keys.join(alike, ["upper_code", "upper_term", "target_dialect_id"]).filter(
        F.col("source_concept_id") != F.col("concept_id")
    )
    origin = F.when(F.col("is_bridge"), "bridge").otherwise("other_organisation")

    best = (
        direct.select("user_id", "concept_id", *_pick(mapper))
        .unionByName(similar.select("user_id", "concept_id", *_pick(origin)))
        .groupBy("user_id", "concept_id")
        .agg(F.max(F.struct(*_PICKED)).alias("best"))
        .select("user_id", "concept_id", "best.*")
    )
    return (
        lists.join(best, ["user_id", "concept_id"], "left")
        .join(
            notes.select("user_id", "concept_id", F.col("note").alias("user_concept_note")),
            ["user_id", "concept_id"],
            "left",
        )
        .select(
            "user_id",
            F.col("dialect_id").alias("source_dialect_id"),
            "code_text",
            "term_text",
            "destination_code_text",
            "destination_term_text",
            "obs_number",
            "first_obs_date",
            "last_obs_date",
            "mapping_user",
            "mapping_ts",
            "status",
            F.col("concept_id").alias("source_concept_id"),
            "user_concept_note",
        )
    )


def worklist_projection(worklist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The columns shown on the page, without NULLs."""

    def blank(column: str):
        return F.coalesce(F.col(column), F.lit("")).alias(column)

    return worklist.select(
        *keys,
        F.lit(MARKER).alias("huom"),
        blank("code_text"),
        blank("term_text"),
        blank("destination_code_text"),
        blank("destination_term_text"),
        F.coalesce("obs_number", F.lit(1)).alias("obs_number"),
        F.coalesce(fn.day_text(F.col("first_obs_date")), F.lit("")).alias("first_obs_date"),
        F.coalesce(fn.day_text(F.col("last_obs_date")), F.lit("")).alias("last_obs_date"),
        blank("mapping_user"),
        blank("mapping_ts"),
        blank("status"),
        F.coalesce("source_concept_id", F.lit(-1)).alias("source_concept_id"),
        blank("user_concept_note"),
    )


def next_step(worklist: DataFrame) -> DataFrame:
    """The page a row leads to, and whether the concept was rejected."""
    status = F.coalesce("status", F.lit(""))
    no_code = F.coalesce("destination_code_text", F.lit("")) == ""
    return worklist.withColumns(
        {
            "next_step": F.when(status.isin("bridge", "other_organisation"), "candidates")
            .when(status.isin("self", "own_organisation"), "history")
            .otherwise("free_mapping"),
            "rejected": (status != "") & no_code,
        }
    )


def progress(worklist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Concept count and sample sum per status."""
    return worklist.groupBy(*keys, "status").agg(
        F.count(F.lit(1)).alias("term_counts"), F.sum("obs_number").alias("samp_counts")
    )


def progress_summary(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals, mapped counts and percentages per status; 0 where the total is 0."""

    def total(column: str, status: str | None = None):
        value = F.col(column) if status is None else F.when(F.col("status") == status, F.col(column))
        return F.coalesce(F.sum(value), F.lit(0))

    kinds = (("concepts", "term_counts"), ("samples", "samp_counts"))
    sums = [
        total(column, status).alias(f"{status}_{kind}") for kind, column in kinds for status in STATUSES
    ] + [total(column).alias(f"total_{kind}") for kind, column in kinds]
    summed = counts.groupBy(*keys).agg(*sums)

    def percent(status: str, kind: str):
        part, whole = F.col(f"{status}_{kind}"), F.col(f"total_{kind}")
        return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0)).alias(f"{status}_{kind}_percent")

    mapped = [sum(F.col(f"{s}_{kind}") for s in STATUSES).alias(f"mapped_{kind}") for kind, _ in kinds]
    return summed.select(
        "*", *mapped, *[percent(status, kind) for kind, _ in kinds for status in STATUSES]
    )


def concept_with_note(concepts: DataFrame, notes: DataFrame, user_id: int) -> DataFrame:
    """Concept details with the user's own note, blank when there is none."""
    own = notes.filter(F.col("user_id") == user_id).select("concept_id", "note")
    return concepts.join(own, "concept_id", "left").select(
        "concept_id", "code_text", "term_text", "obs_number", F.coalesce("note", F.lit("")).alias("note_text")
    )


def similar_concepts(worklist: DataFrame, pages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Work-list rows with the code or the term of a page concept, but not both.

    ``pages`` holds page_concept_id, code_text, term_text and the list ``keys``. Two equi-joins
    replace the OR condition; a row can only come from one of them.
    """
    page = pages.select(
        *keys,
        "page_concept_id",
        F.col("code_text").alias("page_code"),
        F.col("term_text").alias("page_term"),
    )
    by_code = worklist.withColumn("page_code", F.col("code_text")).join(page, [*keys, "page_code"])
    by_term = worklist.withColumn("page_term", F.col("term_text")).join(page, [*keys, "page_term"])
    shown = ["page_concept_id", *worklist.columns]
    return (
        by_code.filter(F.col("term_text") != F.col("page_term"))
        .select(*shown)
        .unionByName(by_term.filter(F.col("code_text") != F.col("page_code")).select(*shown))
    )


def similar_counts(worklist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """For each distinct (code, term) of a list, how many rows its similar-concepts page shows.

    Counts per code, per term and per pair give the number without building the pairs.
    """
    pair = worklist.groupBy(*keys, "code_text", "term_text").agg(F.count(F.lit(1)).alias("n"))
    code = pair.groupBy(*keys, "code_text").agg(F.sum("n").alias("n_code"))
    term = pair.groupBy(*keys, "term_text").agg(F.sum("n").alias("n_term"))
    return (
        pair.join(code, [*keys, "code_text"])
        .join(term, [*keys, "term_text"])
        .select(
            *keys,
            "code_text",
            "term_text",
            (F.col("n_code") - F.col("n")).alias("same_code"),
            (F.col("n_term") - F.col("n")).alias("same_term"),
        )
    )
