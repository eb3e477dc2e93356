"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termweave.plans import fixtures as fx
from termweave.plans import loaders, loading_queries, mapping_queries, terminology_queries, worklist_queries
from termweave.plans.registry import ORACLE, QUERIES
from termweave.sources import seeds

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load one organisation end to end and show its concepts with their observation profile."""
    raw = fx.two_column_observations(spark, sf_dir)
    tables = loaders.load_organisation(seeds.empty_tables(spark), loaders.LOADERS["VSSHP"], raw)
    return loaders.concept_view(tables).select(
        "code_text",
        "term_text",
        "organisation_name",
        "dialect_name",
        "code_system_name",
        "obs_number",
        "first_obs_date",
        "last_obs_date",
    )
