"""Table layouts and fixed identifiers."""

from __future__ import annotations

from pyspark.sql import types as T

# Event type names.
INCORRECT_CONCEPT = "Incorrect concept"
NO_MATCH = "No match for concept in target dialect"
BRIDGE_MAPPING = "Bridge mapping"
USER_MAPPING = "User mapping"
EVENT_TYPES = (INCORRECT_CONCEPT, NO_MATCH, BRIDGE_MAPPING, USER_MAPPING)

# Identifiers of the target terminology.
IS_A = "116680003"
PREFERRED = "900000000000548007"
ACCEPTABLE = "900000000000549004"
ATTRIBUTE_ROOT = "410662002"
DOSE_FORM = "411116001"
PRODUCT_PARTS = {
    "127489000": "ingredient",
    "732943007": "base_substance",
    "732944001": "numerator_value",
    "732945000": "numerator_unit",
    "732946004": "denominator_value",
    "732947008": "denominator_unit",
}
EXTRA_ATTRIBUTES = (
    ("<< 47429007", "Associated with (attribute) [<<]"),
    ("<< 405815000", "Procedure device (attribute) [<<]"),
    ("<< 405816004", "Procedure morphology (attribute) [<<]"),
    ("<< 363704007", "Procedure site (attribute) [<<]"),
)

# The session that bridge loading writes its mappings under.
BRIDGE_SESSION = -101


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_long, _int, _text = T.LongType(), T.IntegerType(), T.StringType()
_flag, _date, _time = T.BooleanType(), T.DateType(), T.TimestampNTZType()

TABLES: dict[str, T.StructType] = {
    "event_type": _schema(("event_type_id", _long), ("name", _text)),
    "term": _schema(("term_id", _long), ("term_text", _text)),
    "code": _schema(("code_id", _long), ("code_text", _text)),
    "organisation": _schema(
        ("organisation_id", _long), ("name", _text), ("city", _text), ("country", _text)
    ),
    "code_system": _schema(
        ("code_system_id", _long), ("name", _text), ("version", _text), ("owner_organisation_id", _long)
    ),
    "dialect": _schema(
        ("dialect_id", _long), ("code_system_id", _long), ("dialect_name", _text), ("is_official", _flag)
    ),
    "synonym": _schema(
        ("synonym_id", _long), ("code_id", _long), ("synonym", _text), ("dialect_id", _long)
    ),
    "concept": _schema(
        ("concept_id", _long),
        ("code_id", _long),
        ("term_id", _long),
        ("organisation_id", _long),
        ("dialect_id", _long),
    ),
    "concept_metadata": _schema(
        ("concept_metadata_id", _long),
        ("concept_id", _long),
        ("obs_number", _int),
        ("first_obs_date", _date),
        ("last_obs_date", _date),
    ),
    "user": _schema(
        ("user_id", _long),
        ("organisation_id", _long),
        ("username", _text),
        ("email", _text),
        ("last_name", _text),
        ("first_name", _text),
        ("default_source_dialect_id", _long),
        ("default_destination_dialect_id", _long),
    ),
    "user_concept_note": _schema(("user_id", _long), ("concept_id", _long), ("note", _text)),
    "mapping": _schema(
        ("mapping_id", _long),
        ("valid", _flag),
        ("user_id", _long),
        ("session_id", _long),
        ("source_concept_id", _long),
        ("destination_concept_id", _long),
        ("destination_dialect_id", _long),
        ("event_type_id", _long),
        ("comment", _text),
        ("insert_ts", _time),
        ("update_ts", _time),
    ),
}

OBSERVATIONS = _schema(
    ("t_code", _text),
    ("t_term", _text),
    ("m_code", _text),
    ("m_term", _text),
    ("sample_number", _text),
    ("sampled_at", _time),
)

CODE_COUNTS: dict[str, T.StructType] = {
    "years": _schema(
        ("code", _text),
        ("term", _text),
        ("count_in_2014", _int),
        ("count_in_2015", _int),
        ("count_in_2016", _int),
        ("count_in_2017", _int),
    ),
    "count": _schema(("code", _text), ("term", _text), ("n", _int)),
    "span": _schema(
        ("code", _text), ("term", _text), ("started_at", _time), ("ended_at", _time), ("n", _int)
    ),
}

BRIDGE = _schema(
    ("code2", _text),
    ("nomen2", _text),
    ("class2", _text),
    ("conceptid", _long),
    ("snomedid", _text),
    ("descriptionid", _long),
    ("term", _text),
    ("type", _text),
    ("additional_code", _text),
)
