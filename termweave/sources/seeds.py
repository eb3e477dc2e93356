"""Fixed background rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termweave.runtime import small_table
from termweave.schemas import EVENT_TYPES, TABLES

# Organisations (name, city, country).
ORGANISATIONS = (
    ("VSSHP", "Turku", "Finland"),
    ("THL", "Helsinki", "Finland"),
    ("IHTSDO", "World", "World"),
    ("PSHP", "Tampere", "Finland"),
    ("PPSHP", "Oulu", "Finland"),
    ("HUS", "Helsinki", "Finland"),
    ("KSSHP", "Jyväskylä", "Finland"),
    ("PSSHP", "Kuopio", "Finland"),
)

# Code systems and their owner.
OWNER = "IHTSDO"
OLD_SYSTEM = "Snomed II"
NEW_SYSTEM = "Snomed CT"

# Dialects (code system, name, official).
BRIDGE_DIALECT = "Official bridge to Snomed CT"
NEW_DIALECT = "International Snomed CT"
DIALECTS = (
    (OLD_SYSTEM, "VSSHP dialect", False),
    (NEW_SYSTEM, NEW_DIALECT, True),
    (OLD_SYSTEM, BRIDGE_DIALECT, True),
    (OLD_SYSTEM, "PSHP dialect", False),
    (OLD_SYSTEM, "PPSHP dialect", False),
    (OLD_SYSTEM, "HUS dialect", False),
    (OLD_SYSTEM, "KSSHP dialect", False),
    (OLD_SYSTEM, "PSSHP dialect", False),
)


def seed_dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """Organisations, code systems, dialects and event types with ids in listed order."""
    organisation_id = {row[0]: i for i, row in enumerate(ORGANISATIONS, 1)}
    system_id = {OLD_SYSTEM: 1, NEW_SYSTEM: 2}
    rows = {
        "organisation": [(i, *row) for i, row in enumerate(ORGANISATIONS, 1)],
        "code_system": [(i, name, None, organisation_id[OWNER]) for name, i in system_id.items()],
        "dialect": [(i, system_id[s], name, ok) for i, (s, name, ok) in enumerate(DIALECTS, 1)],
        "event_type": list(enumerate(EVENT_TYPES, 1)),
    }
    return {name: small_table(spark, data, TABLES[name]) for name, data in rows.items()}


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The seeds plus empty tables for everything that loading fills."""
    tables = {name: small_table(spark, [], schema) for name, schema in TABLES.items()}
    return tables | seed_dimensions(spark)
