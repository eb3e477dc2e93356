"""Descriptions, relationships, search with facets, reference sets and definition texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators.tableops import page
from termweave.runtime import ranked, staging_path
from termweave.schemas import ACCEPTABLE, DOSE_FORM, IS_A, PREFERRED, PRODUCT_PARTS

# Pieces in one part of a definition text.
PART_PIECES = 1_000


# --- descriptions ---------------------------------------------------------------------------


def filter_status(descriptions: DataFrame, mode: str = "activeAndInactive") -> DataFrame:
    """Active, inactive or all descriptions; ``danger`` marks an inactive description or concept."""
    modes = {
        "activeOnly": F.col("active"),
        "inactiveOnly": ~F.col("active"),
        "activeAndInactive": F.lit(True),
    }
    danger = ~F.col("active") | ~F.col("concept_active")
    return descriptions.filter(modes[mode]).withColumn("danger", danger)


def language_membership(
    descriptions: DataFrame,
    membership: DataFrame,
    languages: Sequence[str],
    hide_not_acceptable: bool = False,
    display_inactive: bool = False,
) -> DataFrame:
    """Visible descriptions per language set with included, preferred and acceptable flags.

    ``membership`` holds description_id, language_set and acceptability.
    """
    flags = membership.groupBy("description_id", "language_set").agg(
        F.bool_or(F.col("acceptability") == PREFERRED).alias("preferred"),
        F.bool_or(F.col("acceptability") == ACCEPTABLE).alias("acceptable"),
        F.lit(True).alias("included"),
    )
    sets = F.explode(F.array(*[F.lit(name) for name in languages]))
    flag_names = ("included", "preferred", "acceptable")
    joined = (
        descriptions.withColumn("language_set", sets)
        .join(flags, ["description_id", "language_set"], "left")
        .withColumns({name: F.coalesce(name, F.lit(False)) for name in flag_names})
    )
    if display_inactive:
        return joined
    others = F.lit(False) if hide_not_acceptable else F.col("active")
    return joined.filter(F.col("included") | others)


def description_order() -> list[Column]:
    """Active first, in the language set first, type, preferred first, term."""
    in_set = F.col("preferred") | F.col("acceptable")
    return [
        F.col("active").desc(),
        in_set.desc(),
        F.col("type_id").asc(),
        F.col("preferred").desc(),
        F.col("term").asc(),
    ]


def order_descriptions(df: DataFrame, *keys: str) -> DataFrame:
    """Descriptions in display order within ``keys``, numbered over the whole result."""
    return ranked(df, *map(F.col, keys), *description_order(), F.col("description_id"))


def order_by_name(df: DataFrame, *keys: str, name: str = "default_term", tiebreak: str = "concept_id") -> DataFrame:
    """Rows by lower-cased name within ``keys``, numbered over the whole result."""
    return ranked(df, *map(F.col, keys), F.lower(name), F.col(tiebreak))


# --- search ---------------------------------------------------------------------------------


class TermIndex(NamedTuple):
    """Tokens with their number of descriptions, and (token, description_id)."""

    vocabulary: DataFrame
    postings: DataFrame


def term_index(descriptions: DataFrame) -> TermIndex:
    """An inverted index of the terms, written once below the shared folder.

    Tokens are the lower-cased parts between blanks and line breaks; a null term has none. The postings lie in
    ranges of (token, description_id), so a token's rows are few row groups, and a frequent token fills several files.
    """
    spark = descriptions.sparkSession
    parts = F.explode(F.array_distinct(F.split(F.lower("term"), "[ \\t\\n\\r]+")))
    pairs = descriptions.select("description_id", parts.alias("token")).filter("token <> ''").select("token", "description_id")
    path = staging_path(spark, "term-index")
    pairs.repartitionByRange("token", "description_id").sortWithinPartitions("token", "description_id").write.parquet(f"{path}/postings")
    postings = spark.read.schema(pairs.schema).parquet(f"{path}/postings")
    counted = postings.groupBy("token").agg(F.count(F.lit(1)).alias("descriptions"))
    counted.write.parquet(f"{path}/vocabulary")
    return TermIndex(spark.read.schema(counted.schema).parquet(f"{path}/vocabulary"), postings)


def indexed_matches(index: TermIndex, words: Sequence[str]) -> DataFrame:
    """``description_id`` of the terms that hold every word, from the rarest word on.

    A word without blanks lies in a text exactly if it lies in one of its tokens, so the vocabulary is searched instead of
    the texts. Only one number for each word comes to the driver.
    """
    words = sorted(set(words))
    holds = {word: F.col("token").contains(word) for word in words}
    sizes = index.vocabulary.agg(*[F.sum(F.when(holds[w], F.col("descriptions"))) for w in words]).first()
    found = None
    for _, word in sorted((size or 0, word) for size, word in zip(sizes, words)):
        tokens = index.vocabulary.filter(holds[word]).select("token")
        owners = index.postings.join(tokens, "token", "left_semi").select("description_id")
        found = owners.distinct() if found is None else found.join(owners, "description_id", "left_semi")
    return found


def search_descriptions(
    descriptions: DataFrame,
    phrase: str,
    mode: str = "partial",
    filters: Mapping[str, object] | None = None,
    skip: int = 0,
    limit: int | None = None,
    group_by_concept: bool = False,
    index: TermIndex | None = None,
    refset: DataFrame | None = None,
) -> DataFrame:
    """Descriptions that match a phrase, with facet filters, in display order.

    ``refset`` holds the concept_id of a reference set's members (``members_of``): only their descriptions are found.
    With an ``index`` of the same descriptions, partial mode looks the words up there instead of in every term.

    Partial mode looks for every word of the normalised phrase; regex mode for the pattern. Phrases
    under three characters match nothing. Both modes put short terms first. With
    ``group_by_concept`` the first match of each concept stands for it. Without ``limit`` all matches
    are returned unordered.
    """
    term = F.col("term")
    if len(phrase) < 3:
        hit = F.lit(False)
    elif mode == "regex":
        hit = term.rlike(phrase.strip())
    else:
        hit = fn.contains_all_words(term, phrase.strip().replace("(", "", 1).replace(")", "", 1).lower())
    words = phrase.strip().replace("(", "", 1).replace(")", "", 1).lower().split()
    if index is not None and mode != "regex" and len(phrase) >= 3 and words:
        found = descriptions.join(indexed_matches(index, words), "description_id", "left_semi")
    else:
        found = descriptions.filter(hit)
    if refset is not None:
        found = found.join(refset.select("concept_id"), "concept_id", "left_semi").select(*descriptions.columns)
    for column, value in (filters or {}).items():
        found = found.filter(F.col(column) == value)
    if group_by_concept:
        names = [c for c in found.columns if c not in ("concept_id", "term", "description_id")]
        first = F.min(F.struct(F.length(term).alias("n"), "term", "description_id", *names))
        found = found.groupBy("concept_id").agg(first.alias("m")).select("concept_id", "m.*").select(*found.columns)
    if limit is None:
        return found
    return page(found, [F.length(term), term, F.col("description_id")], skip, limit)


def search_identifier(descriptions: DataFrame, identifier: str, mode: str = "activeAndInactive") -> DataFrame:
    """What a numeric phrase finds: a concept's descriptions by status, or one description.

    The second-last digit tells which: 0 a concept, 1 a description, anything else nothing.
    """
    digits = identifier.strip()
    kind = digits[-2:-1] or digits
    if digits.isdecimal() and kind == "0":
        return filter_status(descriptions.filter(F.col("concept_id") == int(digits)), mode)
    own = F.col("description_id") == int(digits) if digits.isdecimal() and kind == "1" else F.lit(False)
    return filter_status(descriptions.filter(own))


def facets(found: DataFrame, refsets: DataFrame | None = None) -> DataFrame:
    """Match counts by language, semantic tag, module and reference set in long form.

    The three description facets share one pass. ``refsets`` holds refset_id and concept_id.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("facet"), F.col(column).alias("value"))
                for name, column in (("lang", "lang"), ("semTag", "semantic_tag"), ("module", "module"))
            ]
        )
    )
    long = found.select(pairs.alias("pair")).select("pair.*")
    if refsets is not None:
        owned = found.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n")).join(refsets, "concept_id")
        members = owned.groupBy(F.lit("refset").alias("facet"), F.col("refset_id").alias("value")).agg(
            F.sum("n").alias("matches")
        )
    counted = long.filter(F.col("value").isNotNull()).groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("matches")
    )
    return counted if refsets is None else counted.unionByName(members)


def name_facets(counts: DataFrame, names: DataFrame) -> DataFrame:
    """Facet values with the ``default_term`` that ``names`` (facet, value, default_term) gives them, NULL when unknown.

    Of several names of a value the first in order is shown.
    """
    one = names.groupBy("facet", "value").agg(F.min("default_term").alias("default_term"))
    return counts.join(one, ["facet", "value"], "left")


def order_facets(counts: DataFrame) -> DataFrame:
    """Facet values by count, highest first, numbered over the whole result."""
    return ranked(counts, F.col("facet"), F.col("matches").desc(), F.col("value"))


# --- relationships --------------------------------------------------------------------------


def order_relationships(relationship: DataFrame, *keys: str) -> DataFrame:
    """By group, parents first, then target name; numbered over the whole result."""
    attribute = F.when(F.col("type") == IS_A, 0).otherwise(1)
    order = [F.col("group_id"), attribute, F.col("target_name"), F.col("target"), F.col("type")]
    return ranked(relationship, *map(F.col, keys), *order)


def references_by_type(relationship: DataFrame) -> DataFrame:
    """Concepts that point at a target, grouped by the name of their first relationship to it.

    A stated relationship goes before an inferred one, then the lower ``ordinal``. Rows are numbered
    in display order: target, relationship name, source name.
    """
    stated_first = F.when(F.col("view") == "stated", 0).otherwise(1)
    first = F.min(F.struct(stated_first.alias("rank"), "ordinal", "type_name"))
    grouped = relationship.groupBy("target", "source", "source_name").agg(first.alias("first"))
    rows = grouped.select("target", F.col("first.type_name").alias("relationship"), "source_name", "source")
    return ranked(rows, *map(F.col, ("target", "relationship", "source_name", "source")))


def _active_product_rows(relationship: DataFrame, names: DataFrame) -> DataFrame:
    drugs = names.filter(F.col("default_term").endswith("(clinical drug)")).select(
        F.col("concept_id").alias("source")
    )
    return relationship.filter(F.col("active")).join(drugs, "source", "left_semi")


def product_ingredients(relationship: DataFrame, names: DataFrame) -> DataFrame:
    """One row per product and role group with the parts of its ingredient.

    Dose forms and group 0 are left out. If a part occurs twice the highest target name is shown.
    """
    rows = _active_product_rows(relationship, names).filter(
        (F.col("group_id") != 0) & (F.col("type") != DOSE_FORM)
    )
    parts = [
        F.max(F.when(F.col("type") == kind, F.col("target_name"))).alias(name)
        for kind, name in PRODUCT_PARTS.items()
    ]
    return rows.groupBy(F.col("source").alias("concept_id"), "group_id").agg(*parts)


def product_forms(relationship: DataFrame, names: DataFrame) -> DataFrame:
    """The dose forms of each product."""
    rows = _active_product_rows(relationship, names).filter(F.col("type") == DOSE_FORM)
    return rows.select(F.col("source").alias("concept_id"), F.col("target_name").alias("form")).distinct()


# --- definition text ------------------------------------------------------------------------


def definition_pieces(concepts: DataFrame, relationship: DataFrame) -> DataFrame:
    """The definition text of each concept, one row per piece; pieces in ``place`` order make the text.

    ``concepts`` holds concept_id and fully_defined; ``relationship`` the active rows of one view:
    source, type, type_name, target, target_name, group_id. Which piece opens or closes a list is
    found by minimum and maximum per group, so a concept with very many relationships stays spread.
    """
    ref = F.concat("target", F.lit(" |"), "target_name", F.lit("|"))
    kind = F.when(F.col("type") == IS_A, 0).otherwise(1)
    rows = relationship.select(
        F.col("source").alias("concept_id"),
        kind.alias("kind"),
        F.when(kind == 1, F.col("group_id")).otherwise(F.lit(0)).alias("group_id"),
        F.struct("target_name", "target", "type").alias("rank"),
        F.when(kind == 0, ref)
        .otherwise(F.concat("type", F.lit(" |"), "type_name", F.lit("| = "), ref))
        .alias("text"),
    )
    groups = rows.groupBy("concept_id", "kind", "group_id").agg(
        F.min("rank").alias("first"), F.max("rank").alias("last")
    )
    lists = groups.groupBy("concept_id").agg(
        F.min("kind").alias("first_kind"), F.min(F.when(F.col("kind") == 1, F.col("group_id"))).alias("first_group")
    )
    marked = rows.join(groups, ["concept_id", "kind", "group_id"]).join(lists, "concept_id")
    opens, closes = F.col("rank") == F.col("first"), F.col("rank") == F.col("last")
    braced = F.col("group_id") != 0
    parent = F.when(opens, F.lit("")).otherwise(F.lit(" + "))
    colon = F.when(F.col("first_kind") == 0, F.lit(" : ")).otherwise(F.lit(": "))
    lead = F.when(~opens, F.lit(", ")).when(F.col("group_id") == F.col("first_group"), colon).otherwise(F.lit(" "))
    attribute = F.concat(
        lead,
        F.when(opens & braced, F.lit("{ ")).otherwise(F.lit("")),
        "text",
        F.when(closes & braced, F.lit(" }")).otherwise(F.lit("")),
    )
    place = F.struct(
        (F.col("kind") + 1).alias("section"), "group_id", "rank.target_name", "rank.target", "rank.type"
    )
    body = marked.select(
        "concept_id",
        place.alias("place"),
        F.when(F.col("kind") == 0, F.concat(parent, "text")).otherwise(attribute).alias("piece"),
    )
    blank = F.lit("")
    head = concepts.select(
        "concept_id",
        F.struct(
            F.lit(0).alias("section"),
            F.lit(0).cast(rows.schema["group_id"].dataType).alias("group_id"),
            blank.alias("target_name"),
            blank.alias("target"),
            blank.alias("type"),
        ).alias("place"),
        F.when(F.col("fully_defined"), F.lit("=== ")).otherwise(F.lit("<<< ")).alias("piece"),
    )
    return head.unionByName(body)


def numbered_pieces(concepts: DataFrame, relationship: DataFrame) -> DataFrame:
    """(concept_id, position, piece): the pieces numbered from 1 per concept, by one distributed sort."""
    rows = ranked(definition_pieces(concepts, relationship), F.col("concept_id"), F.col("place"), name="row")
    begins = rows.groupBy("concept_id").agg(F.min("row").alias("begin"))
    position = F.col("row") - F.col("begin") + 1
    return rows.join(begins, "concept_id").select("concept_id", position.alias("position"), "piece")


def definition_expression(concepts: DataFrame, relationship: DataFrame, part_pieces: int = PART_PIECES) -> DataFrame:
    """Definition text of each concept as (concept_id, part, text); the parts from 0 on, joined, make the text.

    Every part but the last holds ``part_pieces`` pieces, so no concept is left out and none is gathered in one row.
    """
    pieces = numbered_pieces(concepts, relationship)
    part = F.floor((F.col("position") - 1) / part_pieces).alias("part")
    ordered = F.array_sort(F.collect_list(F.struct("position", "piece")))
    return pieces.groupBy("concept_id", part).agg(ordered.alias("pieces")).select(
        "concept_id", "part", F.concat_ws("", F.transform("pieces", lambda p: p["piece"])).alias("text")
    )


# --- reference sets -------------------------------------------------------------------------


def members_page(members: DataFrame, refset_id, skip: int, limit: int) -> DataFrame:
    """One page of a reference set by concept, with the remaining count and the next page's size."""
    own = members.filter(F.col("refset_id") == refset_id)
    total = own.agg(F.count(F.lit(1)).alias("total")).scalar()
    remaining = F.greatest(total - F.lit(skip + limit), F.lit(0))
    return page(own, [F.col("concept_id")], skip, limit).select(
        "*",
        total.alias("total"),
        remaining.alias("remaining"),
        F.least(remaining, F.lit(limit)).alias("next_size"),
    )


def refset_catalogue(refsets: DataFrame) -> DataFrame:
    """Reference sets by type (``daily-build`` first), then name; numbered."""
    daily_first = F.when(F.col("type") == "daily-build", 0).otherwise(1)
    return ranked(refsets, daily_first, F.col("type"), F.col("default_term"), F.col("refset_id"))
