"""Harmonise raw codes and profile observations per (code, term)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as fn


def clean_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({name: fn.clean(F.col(name)) for name in cols})


def harmonise_overlay(
    df: DataFrame, code: str, axis: str, digits: str, out: str = "code_harmonised"
) -> DataFrame:
    return df.withColumn(out, fn.overlay_code(F.col(code), axis, digits))


def harmonise_prefix(df: DataFrame, code: str, size: int = 6, out: str = "code_harmonised") -> DataFrame:
    return df.withColumn(out, fn.prefix_code(F.col(code), size))


def harmonise_strip(df: DataFrame, code: str, unwanted: str = "-", out: str = "code_harmonised") -> DataFrame:
    """Harmonised code without ``unwanted``; the trimmed original replaces the raw code."""
    return df.withColumns({out: fn.strip_code(F.col(code), unwanted), code: F.trim(F.col(code))})


def harmonise_identity(
    df: DataFrame, code: str, trimmed: bool = True, out: str = "code_harmonised"
) -> DataFrame:
    return df.withColumn(out, fn.identity_code(F.col(code), trimmed))


def split_axis(df: DataFrame, code: str, rule: str) -> DataFrame:
    """Keep one axis of the raw codes; a NULL code never passes.

    ``t`` and ``not_t`` split one code column; ``t_column`` and ``m_column`` only drop codes of
    the other axis from a column that should hold one axis.
    """
    is_t = fn.starts_with_letter(F.col(code), "T")
    is_m = fn.starts_with_letter(F.col(code), "M")
    rules = {"t": is_t, "not_t": ~is_t, "t_column": ~is_m, "m_column": ~is_t}
    return df.filter(rules[rule])


def filter_samples(df: DataFrame, sample_number: str) -> DataFrame:
    return df.filter(fn.is_wanted_sample(F.col(sample_number)))


def sum_years(df: DataFrame, cols: Sequence[str], out: str = "obs_number") -> DataFrame:
    return df.withColumn(out, fn.year_total(*map(F.col, cols)))


def null_sentinel(df: DataFrame, column: str, value: str = fn.OPEN_END) -> DataFrame:
    return df.withColumn(column, fn.open_end(F.col(column), value))


def cast_columns(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: F.col(name).cast(kind) for name, kind in spec.items()})


def profile_observations(
    df: DataFrame,
    harmonised: Column,
    code: str = "code",
    term: str = "term",
    sample_number: str = "sample_number",
    sampled_at: str = "sampled_at",
    keys: Sequence[str] = (),
) -> DataFrame:
    """First time, last time and distinct sample count per raw (code, term).

    Grouping is on raw values, so two spellings that trim to one pair stay two rows. Both steps
    of the distinct count combine before the shuffle, so a frequent pair is spread by sample.
    ``harmonised`` is an expression over the raw ``code`` column.
    """
    profile = df.groupBy(*keys, code, term).agg(
        F.min(sampled_at).alias("min_ts"),
        F.max(sampled_at).alias("max_ts"),
        F.countDistinct(sample_number).alias("obs_number"),
    )
    return profile.select(
        *keys,
        fn.clean(F.col(code)).alias("code_original"),
        fn.clean(F.col(term)).alias("term_text"),
        "min_ts",
        "max_ts",
        "obs_number",
        harmonised.alias("code_harmonised"),
    )


def profile_counts(
    df: DataFrame,
    code: str = "code",
    term: str = "term",
    started_at: str = "started_at",
    ended_at: str = "ended_at",
    n: str = "n",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Earliest start, latest end and total count per (code, term)."""
    return df.groupBy(*keys, code, term).agg(
        F.min(started_at).alias("min_ts"),
        F.max(ended_at).alias("max_ts"),
        F.sum(n).alias("obs_number"),
    )


def bridge_matches(bridge: DataFrame) -> DataFrame:
    """Bridge rows that give a usable mapping: typed ``Match`` and with a target code and term."""
    usable = F.col("conceptid").isNotNull() & F.col("term").isNotNull()
    return bridge.filter(usable & (F.col("type") == "Match"))
