"""Integrity audit: foreign keys, unique keys and required columns as one report."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.runtime import small_table

# Foreign keys (table, column, parent table, parent column).
FOREIGN_KEYS = (
    ("mapping", "event_type_id", "event_type", "event_type_id"),
    ("user_group", "group_id", "group", "group_id"),
    ("concept", "term_id", "term", "term_id"),
    ("concept", "code_id", "code", "code_id"),
    ("synonym", "code_id", "code", "code_id"),
    ("user", "organisation_id", "organisation", "organisation_id"),
    ("concept", "organisation_id", "organisation", "organisation_id"),
    ("code_system", "owner_organisation_id", "organisation", "organisation_id"),
    ("dialect", "code_system_id", "code_system", "code_system_id"),
    ("concept", "dialect_id", "dialect", "dialect_id"),
    ("synonym", "dialect_id", "dialect", "dialect_id"),
    ("user", "default_source_dialect_id", "dialect", "dialect_id"),
    ("user", "default_destination_dialect_id", "dialect", "dialect_id"),
    ("concept_metadata", "concept_id", "concept", "concept_id"),
    ("mapping", "source_concept_id", "concept", "concept_id"),
    ("mapping", "destination_concept_id", "concept", "concept_id"),
    ("user_concept_note", "concept_id", "concept", "concept_id"),
    ("mapping", "user_id", "user", "user_id"),
    ("session", "user_id", "user", "user_id"),
    ("user_group", "user_id", "user", "user_id"),
    ("user_concept_note", "user_id", "user", "user_id"),
    ("mapping", "session_id", "session", "session_id"),
)
# Unique keys and primary keys.
UNIQUE_KEYS = (
    ("term", ("term_text",)),
    ("code", ("code_text",)),
    ("code_system", ("name", "version")),
    ("synonym", ("code_id", "synonym")),
    ("event_type", ("event_type_id",)),
    ("group", ("group_id",)),
    ("term", ("term_id",)),
    ("code", ("code_id",)),
    ("organisation", ("organisation_id",)),
    ("code_system", ("code_system_id",)),
    ("dialect", ("dialect_id",)),
    ("synonym", ("synonym_id",)),
    ("concept", ("concept_id",)),
    ("concept_metadata", ("concept_metadata_id",)),
    ("user", ("user_id",)),
    ("user_concept_note", ("user_id", "concept_id")),
    ("user_group", ("user_id", "group_id")),
    ("session", ("session_id",)),
    ("mapping", ("mapping_id",)),
)
# Required columns.
REQUIRED = {
    "event_type": ("event_type_id", "name"),
    "group": ("group_id", "name"),
    "term": ("term_id", "term_text"),
    "code": ("code_id", "code_text"),
    "organisation": ("organisation_id", "name", "city", "country"),
    "code_system": ("code_system_id", "name", "owner_organisation_id"),
    "dialect": ("dialect_id", "code_system_id", "dialect_name", "is_official"),
    "synonym": ("synonym_id", "code_id", "synonym", "dialect_id"),
    "concept": ("concept_id", "code_id", "term_id", "organisation_id", "dialect_id"),
    "concept_metadata": ("concept_metadata_id", "concept_id"),
    "user": ("user_id", "organisation_id", "email", "last_name", "first_name"),
    "user_concept_note": ("user_id", "concept_id", "note"),
    "user_group": ("user_id", "group_id"),
    "session": ("session_id", "user_id", "start_ts"),
    "mapping": ("mapping_id", "valid", "user_id", "session_id", "source_concept_id", "event_type_id"),
}


def _key(*columns: str):
    """The values as text, NULL if one of them is NULL."""
    parts = [F.col(c).cast("string") for c in columns]
    known = [F.col(c).isNotNull() for c in columns]
    return F.when(reduce(lambda a, b: a & b, known), F.array(*parts))


def _lines(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    """The rules (rule, table_name, columns) on the tables given."""
    lines = [("foreign_key", child, column) for child, column, parent, _ in FOREIGN_KEYS if child in tables and parent in tables]
    lines += [("unique", table, ",".join(columns)) for table, columns in UNIQUE_KEYS if table in tables]
    return lines + [("not_null", table, column) for table, columns in REQUIRED.items() if table in tables for column in columns]


def _uses(name: str, table: DataFrame, lines: list[tuple[str, str, str]], parents: Mapping[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """What one scan of a table has to say: (space, key, line).

    A space is what keys must agree in: a table's key columns. ``line`` is the rule's place for a foreign key's use of
    a parent's key, -1 for a key that the table itself holds, and -1 for each NULL in the space of its rule.
    """
    said = []
    for place, (rule, owner, columns) in enumerate(lines):
        if owner != name:
            continue
        parts = columns.split(",")
        if rule == "foreign_key":
            said.append(("/".join(parents[owner, columns]), _key(*parts), place))
        elif rule == "unique":
            said.append((f"{owner}/{columns}", _key(*parts), -1))
        else:
            null = F.when(F.col(columns).isNull(), F.array().cast("array<string>"))
            said.append((f"{owner}/{columns}/NULL", null, -1))
    rows = [F.struct(F.lit(space).alias("space"), key.alias("key"), F.lit(line).alias("line")) for space, key, line in said]
    return table.select(F.explode(F.array(*rows)).alias("x")).select("x.*").filter("key IS NOT NULL")


def audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Violations per rule for the tables given; rules on other tables are left out.

    foreign_key counts rows whose value no parent row has, unique the keys that more than one row holds (a key with a NULL part never
    collides), not_null the NULLs. Each table is scanned once: all its keys, uses of other tables' keys and NULLs go into one
    column and are counted per value in one shuffle, where a frequent value is one row of each task.
    """
    if not tables:
        raise ValueError("no tables to audit")
    lines = _lines(tables)
    spark = next(iter(tables.values())).sparkSession
    parents = {(child, column): (parent, key) for child, column, parent, key in FOREIGN_KEYS}
    said = reduce(lambda a, b: a.unionByName(b), [_uses(name, table, lines, parents) for name, table in tables.items() if any(o == name for _, o, _ in lines)])
    foreign = [place for place, (rule, *_) in enumerate(lines) if rule == "foreign_key"]
    counts = said.groupBy("space", "key").agg(
        F.count_if(F.col("line") == -1).alias("own"), *[F.count_if(F.col("line") == place).alias(f"use{place}") for place in foreign]
    )
    named = {f"{owner}/{columns}" + ("/NULL" if rule == "not_null" else ""): place for place, (rule, owner, columns) in enumerate(lines) if rule != "foreign_key"}
    place_of = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])[F.col("space")]
    own = F.when(F.col("space").endswith("/NULL"), F.col("own")).otherwise((F.col("own") > 1).cast("long"))
    found = [F.struct(place_of.alias("line"), own.alias("n"))]
    found += [F.struct(F.lit(place).alias("line"), F.when(F.col("own") == 0, F.col(f"use{place}")).otherwise(0).alias("n")) for place in foreign]
    violations = counts.select(F.explode(F.array(*found)).alias("x")).select("x.*").filter("n > 0").groupBy("line").agg(F.sum("n").alias("violations"))
    report = small_table(spark, [(place, *line) for place, line in enumerate(lines)], "line int, rule string, table_name string, columns string")
    return report.join(violations, "line", "left").select("rule", "table_name", "columns", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"))
