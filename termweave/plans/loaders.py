"""Load organisations and the bridge into the harmonised tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators import dimensions as dim
from termweave.operators import mapping as log
from termweave.operators import staging as stg
from termweave.operators import views
from termweave.runtime import materialise
from termweave.sources import seeds


@dataclass(frozen=True)
class Loader:
    """How one organisation's raw tables become (code, term, count) rows.

    ``layout`` is ``observations``, ``years``, ``count`` or ``span``. ``dated`` loads the first and
    last date with the counts. ``open_end`` blanks the end date that stands for "still in use".
    """

    organisation: str
    layout: str
    dated: bool = False
    open_end: bool = False

    @property
    def dialect(self) -> str:
        return f"{self.organisation} dialect"


# The organisations and the layout each delivers.
LOADERS = {
    loader.organisation: loader
    for loader in (
        Loader("VSSHP", "observations", dated=True),
        Loader("PSHP", "years"),
        Loader("KSSHP", "count"),
        Loader("HUS", "count"),
        Loader("PPSHP", "span", open_end=True),
        Loader("PSSHP", "span"),
    )
}

# The digits that mark an overlaid code of each axis.
OVERLAY_DIGITS = {"T": "12", "M": "1234"}
YEARS = ("count_in_2014", "count_in_2015", "count_in_2016", "count_in_2017")

Tables = dict[str, DataFrame]


def stage_observations(raw: DataFrame) -> DataFrame:
    """Both axes of sample-level rows in one scan: filter samples, drop the other axis, profile, harmonise."""
    samples = stg.filter_samples(raw, "sample_number")
    axes = [
        F.struct(F.lit(axis).alias("axis"), F.col(f"{axis.lower()}_code").alias("code"), F.col(f"{axis.lower()}_term").alias("term"))
        for axis in OVERLAY_DIGITS
    ]
    rows = samples.select("sample_number", "sampled_at", F.inline(F.array(*axes)))
    own = rows.filter(
        F.when(F.col("axis") == "T", ~fn.starts_with_letter(F.col("code"), "M")).otherwise(
            ~fn.starts_with_letter(F.col("code"), "T")
        )
    )
    overlaid = {axis: fn.overlay_code(F.col("code"), axis, digits) for axis, digits in OVERLAY_DIGITS.items()}
    harmonised = F.when(F.col("axis") == "T", overlaid["T"]).otherwise(overlaid["M"])
    return stg.profile_observations(own, harmonised, keys=["axis"]).drop("axis")


def stage_years(raw: DataFrame) -> DataFrame:
    """Both axes of year counts; the axes only differ by a filter, so one pass serves both."""
    known = raw.filter(F.col("code").isNotNull())
    summed = stg.sum_years(known, YEARS)
    return summed.select(
        fn.clean(F.col("code")).alias("code_original"),
        fn.clean(F.col("term")).alias("term_text"),
        "obs_number",
        fn.prefix_code(F.col("code")).alias("code_harmonised"),
    )


def stage_counts(raw: DataFrame) -> DataFrame:
    return raw.select(
        fn.clean(F.col("code")).alias("code_original"),
        fn.clean(F.col("term")).alias("term_text"),
        F.col("n").alias("obs_number"),
        fn.identity_code(F.col("code")).alias("code_harmonised"),
    )


def stage_spans(raw: DataFrame, open_end: bool) -> DataFrame:
    """Codes and terms stay as delivered; rows without one cannot be stored and drop out later."""
    counted = stg.profile_counts(raw)
    if open_end:
        counted = stg.null_sentinel(counted, "max_ts")
    return counted.select(
        F.col("code").alias("code_original"),
        F.col("term").alias("term_text"),
        "min_ts",
        "max_ts",
        "obs_number",
        fn.identity_code(F.col("code"), trimmed=False).alias("code_harmonised"),
    )


def stage(loader: Loader, raw: DataFrame) -> DataFrame:
    """Staged rows of one organisation. Code tables hold T and M rows together."""
    if loader.layout == "observations":
        return stage_observations(raw)
    if loader.layout == "years":
        return stage_years(raw)
    if loader.layout == "count":
        return stage_counts(raw)
    return stage_spans(raw, loader.open_end)


def _owner(tables: Tables, organisation: str, dialect: str, system: str) -> dict[str, Column]:
    return {
        "organisation_id": dim.organisation_id(tables["organisation"], organisation),
        "dialect_id": dim.dialect_id(tables["dialect"], tables["code_system"], dialect, system),
    }


def _load_concepts(tables: Tables, pairs: DataFrame) -> Tables:
    code, term, concept = dim.upsert_concepts(tables["code"], tables["term"], tables["concept"], pairs)
    return tables | {"code": code, "term": term, "concept": concept}


def load_organisation(tables: Tables, loader: Loader, raw: DataFrame) -> Tables:
    """Terms, codes, concepts, synonyms and metadata of one organisation; loading twice adds nothing.

    The staged rows are the only thing computed from the raw data and are materialised, because
    every table below is derived from them.
    """
    owner = _owner(tables, loader.organisation, loader.dialect, seeds.OLD_SYSTEM)
    staged = materialise(stage(loader, raw).withColumns(owner))
    pairs = staged.select(
        F.col("code_harmonised").alias("code_text"), "term_text", "organisation_id", "dialect_id"
    )
    loaded = _load_concepts(tables, dim.union_axes(pairs))
    loaded["synonym"] = dim.load_synonyms(tables["synonym"], staged, loaded["code"])
    own = loaded["concept"].join(
        staged.select("organisation_id", "dialect_id").distinct(), ["organisation_id", "dialect_id"], "left_semi"
    )
    counted = staged if loader.dated else staged.drop("min_ts", "max_ts")
    metadata = dim.load_metadata(counted, loaded["code"], loaded["term"], own)
    loaded["concept_metadata"] = dim.replace_metadata(tables["concept_metadata"], metadata, own)
    return loaded


def load_bridge(tables: Tables, raw: DataFrame, user_id: int, start: int = 1) -> tuple[Tables, DataFrame]:
    """Concepts of both systems from the bridge, and the mapping events its matches give."""
    bridge = materialise(
        stg.harmonise_strip(raw, "code2").withColumn("conceptid", F.col("conceptid").cast("string"))
    )
    old_owner = _owner(tables, seeds.OWNER, seeds.BRIDGE_DIALECT, seeds.OLD_SYSTEM)
    new_owner = _owner(tables, seeds.OWNER, seeds.NEW_DIALECT, seeds.NEW_SYSTEM)
    old_pairs = bridge.select(
        F.col("code_harmonised").alias("code_text"), F.col("nomen2").alias("term_text")
    ).withColumns(old_owner)
    new_pairs = bridge.select(
        F.col("conceptid").alias("code_text"), F.col("term").alias("term_text")
    ).withColumns(new_owner)
    loaded = _load_concepts(tables, old_pairs.unionByName(new_pairs).distinct())
    spelled = bridge.withColumnRenamed("code2", "code_original").withColumn("dialect_id", old_owner["dialect_id"])
    loaded["synonym"] = dim.load_synonyms(tables["synonym"], spelled, loaded["code"])

    named = loaded["concept"].join(loaded["code"], "code_id").join(loaded["term"], "term_id")
    own = named.filter(F.col("organisation_id") == old_owner["organisation_id"])
    matches = log.bridge_mappings(
        bridge,
        own.filter(F.col("dialect_id") == old_owner["dialect_id"]),
        own.filter(F.col("dialect_id") == new_owner["dialect_id"]),
    )
    return loaded, log.bridge_events(matches, F.lit(user_id).cast("long"), start)


def concept_view(tables: Tables) -> DataFrame:
    """``v_concept`` over a set of loaded tables."""
    dialects = views.v_dialect(tables["dialect"], tables["code_system"], tables["organisation"])
    return views.v_concept(
        tables["concept"],
        tables["code"],
        tables["term"],
        tables["organisation"],
        dialects,
        tables["concept_metadata"],
    )
