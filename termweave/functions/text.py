"""Text, code and label functions, all evaluated inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from termweave.schemas import INCORRECT_CONCEPT, USER_MAPPING

# Sample number pattern and the date that stands for "still in use".
SAMPLE_PATTERN = "^[ABCDNRSYK][^N]"
OPEN_END = "2017-12-29 00:00:00"


def clean(text: Column) -> Column:
    """Trimmed text, blank for NULL."""
    return F.coalesce(F.trim(text), F.lit(""))


def overlay_code(code: Column, axis: str, digits: str) -> Column:
    """Drop characters 6-7 of an 8-character code such as ``T1234015`` (axis T, digits 12)."""
    trimmed = F.trim(code)
    matches = (F.length(trimmed) == 8) & trimmed.rlike(f"(?is)^{axis}....0[{digits}].$")
    return F.when(matches, F.overlay(trimmed, F.lit(""), F.lit(6), F.lit(2))).otherwise(clean(code))


def prefix_code(code: Column, size: int = 6) -> Column:
    return F.substring(F.trim(code), 1, size)


def strip_code(code: Column, unwanted: str = "-") -> Column:
    return F.trim(F.replace(code, F.lit(unwanted), F.lit("")))


def identity_code(code: Column, trimmed: bool = True) -> Column:
    return clean(code) if trimmed else code


def starts_with_letter(code: Column, letter: str) -> Column:
    """Case-insensitive first letter test on the raw code; NULL stays NULL."""
    return code.rlike(f"(?i)^{letter}")


def is_wanted_sample(sample_number: Column) -> Column:
    return sample_number.rlike(f"(?i){SAMPLE_PATTERN}")


def year_total(*years: Column) -> Column:
    """Plain sum: one missing year makes the total NULL."""
    return reduce(add, years)


def open_end(moment: Column, sentinel: str = OPEN_END) -> Column:
    return F.when(moment != F.lit(sentinel).cast("timestamp_ntz"), moment)


def minute_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm")


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def mapper(last_name: Column, first_name: Column, organisation: Column) -> Column:
    """``Last, F (Organisation)``; a NULL part is left out."""
    return F.concat_ws(
        "", last_name, F.lit(", "), F.substring(first_name, 1, 1), F.lit(" ("), organisation, F.lit(")")
    )


def request_event_type(new_code: Column, new_term: Column) -> Column:
    rejected = new_code.isNull() & new_term.isNull()
    return F.when(rejected, F.lit(INCORRECT_CONCEPT)).otherwise(F.lit(USER_MAPPING))


def without_semantic_tag(term: Column) -> Column:
    """Cut one character before the last ``(``, unless the term starts with its only one."""
    last_open = F.length(term) - F.instr(F.reverse(term), "(")
    has_tag = (F.instr(term, "(") > 0) & (last_open > 0)
    return F.when(has_tag, F.left(term, F.greatest(last_open - 1, F.lit(0)))).otherwise(term)


def semantic_tag(term: Column) -> Column:
    """Text inside the trailing brackets, NULL when there are none."""
    tag = F.regexp_extract(term, r"\(([^()]*)\)$", 1)
    return F.when(tag != "", tag)


def identifier_kind(identifier: Column) -> Column:
    """``concept`` or ``description`` by the second-last digit of a numeric identifier."""
    trimmed = F.trim(identifier)
    digit = F.when(F.length(trimmed) >= 2, F.substring(trimmed, -2, 1)).otherwise(trimmed)
    numeric = trimmed.rlike("^[0-9]+$")
    return F.when(numeric & (digit == "0"), "concept").when(numeric & (digit == "1"), "description")


def search_phrase(phrase: Column, mode: str = "partial") -> Column:
    """Normalised phrase; NULL when it is shorter than three characters."""
    cleaned = F.trim(phrase)
    if mode == "partial":
        for bracket in ("(", ")"):
            place = F.instr(cleaned, bracket)
            without = F.concat(F.left(cleaned, place - 1), F.substr(cleaned, place + 1))
            cleaned = F.when(place > 0, without).otherwise(cleaned)
        cleaned = F.lower(cleaned)
    return F.when(F.length(phrase) >= 3, cleaned)


def contains_all_words(text: Column, phrase: str) -> Column:
    """Every blank-separated word of the phrase occurs in the text, ignoring case."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a & b, [lowered.contains(word) for word in phrase.split()], F.lit(True))
