"""Search, sort, page and count rows of any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.runtime import ranked

# Pages that end below this row are read by a top-k; deeper pages by distributed row numbers.
TOP_ROWS = 10_000

# Work-list columns as shown, in order (name in the data, title, searchable).
WORKLIST_COLUMNS = (
    ("huom", "Huom", False),
    ("code_text", "Lähdekoodi", True),
    ("term_text", "Lähdetermi", True),
    ("destination_code_text", "Kohdekoodi", True),
    ("destination_term_text", "Kohdetermi", True),
    ("obs_number", "N", False),
    ("first_obs_date", "Alkaen", False),
    ("last_obs_date", "Asti", False),
    ("mapping_user", "Sillannut", True),
    ("mapping_ts", "Aikaleima", False),
    ("status", "Status", False),
    ("source_concept_id", "Concept ID", False),
    ("user_concept_note", "Note", False),
)
SEARCHABLE = tuple(name for name, _, searchable in WORKLIST_COLUMNS if searchable)


def matches(phrase: str, cols: Sequence[str]) -> Column:
    """True where any column matches the case-insensitive pattern; a blank pattern matches all."""
    found = F.lit(not phrase)
    if phrase:
        for name in cols:
            found = found | F.coalesce(F.col(name).cast("string").rlike(f"(?iu){phrase}"), F.lit(False))
    return found


def search_rows(df: DataFrame, phrase: str, cols: Sequence[str] = SEARCHABLE) -> DataFrame:
    return df.filter(matches(phrase, cols))


def sort_order(keys: Sequence[tuple[str, str]], tiebreak: Sequence[str]) -> list[Column]:
    """Sort keys as (column, "asc" or "desc"); the last one listed is the primary key."""
    order = [
        F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_last()
        for name, direction in reversed(keys)
    ]
    return order + [F.col(name).asc_nulls_last() for name in tiebreak]


def table_sort(df: DataFrame, keys: Sequence[tuple[str, str]], tiebreak: Sequence[str]) -> DataFrame:
    return df.orderBy(*sort_order(keys, tiebreak))


def ordered_rows(df: DataFrame, keys: Sequence[tuple[str, str]], tiebreak: Sequence[str]) -> DataFrame:
    """The sorted table with its row number in ``position``."""
    return ranked(df, *sort_order(keys, tiebreak))


def page(df: DataFrame, order: Sequence[Column], start: int, length: int) -> DataFrame:
    """Rows ``start`` to ``start + length`` of the sorted table; length -1 returns them all."""
    if length == -1:
        return df.orderBy(*order)
    if start + length <= TOP_ROWS:
        return df.orderBy(*order).offset(start).limit(length)
    place = F.col("_position")
    deep = ranked(df, *order, name="_position", start=0)
    return deep.filter((place >= start) & (place < start + length)).orderBy(place).drop("_position")


def select_columns(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Pick, rename and order columns: name in the data to name shown."""
    return df.select(*[F.col(name).alias(title) for name, title in spec.items()])


def worklist_columns(df: DataFrame) -> DataFrame:
    return select_columns(df, {name: title for name, title, _ in WORKLIST_COLUMNS})


def search_totals(df: DataFrame, phrase: str, cols: Sequence[str] = SEARCHABLE) -> DataFrame:
    """Number of rows before and after the search, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(matches(phrase, cols)).alias("total_display_records"),
    )
