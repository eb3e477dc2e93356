"""Set operators over concepts: membership, refinement, AND, OR and MINUS."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.hierarchy import descendants_of
from termweave.runtime import small_table
from termweave.schemas import ATTRIBUTE_ROOT, EXTRA_ATTRIBUTES


def members_of(members: DataFrame, refset_id) -> DataFrame:
    """Concepts of one reference set (``members`` holds refset_id and concept_id)."""
    return members.filter(F.col("refset_id") == refset_id).select("concept_id").distinct()


def has_relationship(relationship: DataFrame, target_id) -> DataFrame:
    """Concepts with an active relationship to the given target."""
    kept = relationship.filter(F.col("active") & (F.col("target") == target_id))
    return kept.select(F.col("source").alias("concept_id")).distinct()


def has_description(descriptions: DataFrame, type_id) -> DataFrame:
    """Concepts with an active description of the given type."""
    kept = descriptions.filter(F.col("active") & (F.col("type_id") == type_id))
    return kept.select("concept_id").distinct()


def refine(focus: DataFrame, relationship: DataFrame, type_id: str, values: DataFrame) -> DataFrame:
    """Focus concepts with an active attribute (``*`` for any type) that points into ``values``."""
    attributes = relationship.filter("active")
    if type_id != "*":
        attributes = attributes.filter(F.col("type") == type_id)
    wanted = values.select(F.col("concept_id").alias("target"))
    owners = attributes.join(wanted, "target", "left_semi").select(F.col("source").alias("concept_id"))
    return focus.select("concept_id").distinct().join(owners, "concept_id", "left_semi")


def _all_of(sets: Sequence[DataFrame]) -> DataFrame:
    first = sets[0].select("concept_id").distinct()
    return reduce(lambda a, b: a.join(b.select("concept_id"), "concept_id", "left_semi"), sets[1:], first)


def _any_of(conditions: Sequence[Sequence[DataFrame]]) -> DataFrame:
    parts = [_all_of(sets) for sets in conditions]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def combine(
    includes: Sequence[Sequence[DataFrame]], excludes: Sequence[Sequence[DataFrame]] = ()
) -> DataFrame:
    """AND inside a condition, OR across includes, minus the OR across excludes."""
    kept = _any_of(includes)
    return kept.join(_any_of(excludes), "concept_id", "left_anti") if excludes else kept


def attribute_types(edges: DataFrame, names: DataFrame, root: str = ATTRIBUTE_ROOT) -> DataFrame:
    """Descendants of the attribute root plus the fixed "or self" entries, by name."""
    spark = edges.sparkSession
    start = small_table(spark, [(root,)], "concept_id string")
    fixed = small_table(spark, EXTRA_ATTRIBUTES, "concept_id string, default_term string")
    below = descendants_of(edges, start).join(names, "concept_id").select("concept_id", "default_term")
    return below.unionByName(fixed).orderBy("default_term", "concept_id")


def condition_counts(conditions: Mapping[str, DataFrame]) -> DataFrame:
    """Size of each condition's result."""
    counts = [
        df.select("concept_id").distinct().agg(F.count(F.lit(1)).alias("concepts")).select(
            F.lit(name).alias("condition"), "concepts"
        )
        for name, df in conditions.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)
