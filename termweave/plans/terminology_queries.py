"""Queries over the concept graph, descriptions, search and reference sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.functions import text as fn
from termweave.operators import constraints as con
from termweave.operators import hierarchy as hier
from termweave.operators import terminology as term
from termweave.plans import fixtures as fx
from termweave.plans.registry import query
from termweave.runtime import ranked, small_table, staging_path
from termweave.schemas import EXTRA_ATTRIBUTES, IS_A, PRODUCT_PARTS
from termweave.sources import sinks

# --- text -----------------------------------------------------------------------------------


@query(
    "strip_semantic_tag",
    "description",
    sql="""SELECT description_id, CASE WHEN last_open > 0 THEN left(term, greatest(last_open - 1, 0)) ELSE term END AS term
  FROM (SELECT *, CASE WHEN contains(term, '(') THEN length(term) - position('(' IN reverse(term)) ELSE -1 END AS last_open FROM description)""",
)
def strip_semantic_tag(spark, sf_dir):
    return fx.descriptions(spark, sf_dir).select("description_id", fn.without_semantic_tag(F.col("term")).alias("term"))


@query(
    "identifier_kind",
    sql="""SELECT l_orderkey, l_partkey, CASE substr(t, -2, 1) WHEN '0' THEN 'concept' WHEN '1' THEN 'description' END AS kind
  FROM (SELECT l_orderkey, l_partkey, CAST(l_orderkey * 1000 + l_partkey AS VARCHAR) AS t FROM lineitem)""",
)
def identifier_kind(spark, sf_dir):
    identifier = (F.col("l_orderkey") * 1000 + F.col("l_partkey")).cast("string")
    return fx.given(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", fn.identifier_kind(identifier).alias("kind"))


PHRASE_SQL = "' (' || p_name || ') (' || p_type || ') '"


@query(
    "normalise_phrase",
    sql=f"""SELECT p_partkey, lower(trim(p_name || ' ' || p_type || ') (' || p_brand || ')')) AS partial, trim({PHRASE_SQL}) AS regex, CAST(NULL AS VARCHAR) AS short
  FROM (SELECT p_partkey, '' || p_name AS p_name, p_type, p_brand FROM part)""",
)
def normalise_phrase(spark, sf_dir):
    """Partial mode drops the first bracket of each kind; two characters are too few."""
    partial = F.concat(F.lit(" ("), "p_name", F.lit(") "), "p_type", F.lit(") ("), "p_brand", F.lit(")"))
    regex = F.concat(F.lit(" ("), "p_name", F.lit(") ("), "p_type", F.lit(") "))
    return fx.given(spark, sf_dir, "part").select(
        "p_partkey",
        fn.search_phrase(partial, "partial").alias("partial"),
        fn.search_phrase(regex, "regex").alias("regex"),
        fn.search_phrase(F.left("p_name", F.lit(2))).alias("short"),
    )


# --- descriptions ---------------------------------------------------------------------------


@query(
    "filter_status",
    "description",
    sql="""SELECT 'activeOnly' AS mode, description_id, NOT active OR NOT concept_active AS danger FROM description WHERE active
  UNION ALL SELECT 'inactiveOnly', description_id, NOT active OR NOT concept_active FROM description WHERE NOT active
  UNION ALL SELECT 'activeAndInactive', description_id, NOT active OR NOT concept_active FROM description""",
)
def filter_status(spark, sf_dir):
    every = fx.descriptions(spark, sf_dir).select("description_id", "active", "concept_active")
    modes = [
        term.filter_status(every, mode).select(F.lit(mode).alias("mode"), "description_id", "danger")
        for mode in ("activeOnly", "inactiveOnly", "activeAndInactive")
    ]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


fx.SQL["shown_description"] = (
    ("description", "language_row"),
    """SELECT d.*, l.language_set, coalesce(bool_or(m.description_id IS NOT NULL), false) AS included,
       coalesce(bool_or(m.acceptability = '900000000000548007'), false) AS preferred,
       coalesce(bool_or(m.acceptability = '900000000000549004'), false) AS acceptable
  FROM description d CROSS JOIN (VALUES ('set0'), ('set1')) l(language_set)
  LEFT JOIN language_row m ON m.description_id = d.description_id AND m.language_set = l.language_set GROUP BY ALL""",
)
FLAGS = "description_id, language_set, included, preferred, acceptable"


def _shown(spark, sf_dir, **options):
    return term.language_membership(
        fx.descriptions(spark, sf_dir), fx.language_rows(spark, sf_dir), ["set0", "set1"], **options
    )


@query(
    "language_membership",
    "shown_description",
    sql=f"""SELECT 'default' AS rule, {FLAGS} FROM shown_description WHERE included OR active
  UNION ALL SELECT 'hide', {FLAGS} FROM shown_description WHERE included
  UNION ALL SELECT 'all', {FLAGS} FROM shown_description""",
)
def language_membership(spark, sf_dir):
    rules = (("default", {}), ("hide", {"hide_not_acceptable": True}), ("all", {"display_inactive": True}))
    parts = [
        _shown(spark, sf_dir, **options).select(F.lit(rule).alias("rule"), *FLAGS.split(", ")) for rule, options in rules
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "order_descriptions",
    "shown_description",
    sql="""SELECT concept_id, language_set, description_id, row_number() OVER (ORDER BY concept_id, language_set, active DESC,
       (preferred OR acceptable) DESC, type_id, preferred DESC, term, description_id) AS position FROM shown_description WHERE included OR active""",
)
def order_descriptions(spark, sf_dir):
    ordered = term.order_descriptions(_shown(spark, sf_dir), "concept_id", "language_set")
    return ordered.select("concept_id", "language_set", "description_id", "position")


@query(
    "order_by_name",
    "edge",
    "node",
    sql="""SELECT parent, concept_id, default_term, row_number() OVER (ORDER BY parent, lower(default_term), concept_id) AS position
  FROM edge JOIN node ON child = concept_id""",
)
def order_by_name(spark, sf_dir):
    named = fx.is_a_edges(spark, sf_dir).withColumnRenamed("child", "concept_id").join(fx.node_names(spark, sf_dir), "concept_id")
    return term.order_by_name(named, "parent").select("parent", "concept_id", "default_term", "position")


# --- search ---------------------------------------------------------------------------------

WORDS = "The (and"
HIT_SQL = "contains(lower(term), 'the') AND contains(lower(term), 'and')"
FOUND = "description_id, concept_id, type_id, lang, semantic_tag, module"


@query(
    "search_descriptions",
    "description",
    sql=f"SELECT {FOUND} FROM description WHERE {HIT_SQL} AND semantic_tag = 'finding' AND active",
)
def search_descriptions(spark, sf_dir):
    filters = {"semantic_tag": "finding", "active": True}
    return term.search_descriptions(fx.descriptions(spark, sf_dir), WORDS, filters=filters).select(*FOUND.split(", "))


@query(
    "search_page",
    "description",
    sql=f"SELECT {FOUND} FROM description WHERE regexp_matches(term, '[Oo]n +the') ORDER BY length(term), term, description_id LIMIT 20 OFFSET 10",
)
def search_page(spark, sf_dir):
    """Regex mode, shortest terms first, second page."""
    found = term.search_descriptions(fx.descriptions(spark, sf_dir), "[Oo]n +the", mode="regex", skip=10, limit=20)
    return found.select(*FOUND.split(", "))


@query(
    "search_by_concept",
    "description",
    sql=f"""SELECT {FOUND} FROM description WHERE {HIT_SQL}
  QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY length(term), term, description_id) = 1""",
)
def search_by_concept(spark, sf_dir):
    found = term.search_descriptions(fx.descriptions(spark, sf_dir), WORDS, group_by_concept=True)
    return found.select(*FOUND.split(", "))


@query(
    "term_index",
    "description",
    sql=r"""SELECT token, count(*) AS descriptions FROM (
    SELECT DISTINCT description_id, unnest(regexp_split_to_array(lower(term), '[ \t\n\r]+')) AS token FROM description) WHERE token <> '' GROUP BY token""",
)
def term_index(spark, sf_dir):
    return term.term_index(fx.descriptions(spark, sf_dir)).vocabulary


@query("search_indexed", "description", sql=f"SELECT {FOUND} FROM description WHERE {HIT_SQL}")
def search_indexed(spark, sf_dir):
    """All words of the phrase, looked up in the inverted index."""
    every = fx.descriptions(spark, sf_dir)
    return term.search_descriptions(every, WORDS, index=term.term_index(every)).select(*FOUND.split(", "))


@query(
    "search_in_refset",
    "description",
    "concept_refset",
    sql=f"""SELECT {FOUND}, row_number() OVER (ORDER BY description_id) AS position FROM description
  WHERE {HIT_SQL} AND lang = 'en' AND concept_id IN (SELECT concept_id FROM concept_refset WHERE refset_id = 'q1t0')""",
)
def search_in_refset(spark, sf_dir):
    """Matches in one language whose concept belongs to one reference set, numbered by id."""
    members = con.members_of(fx.concept_refsets(spark, sf_dir), "q1t0")
    found = term.search_descriptions(fx.descriptions(spark, sf_dir), WORDS, filters={"lang": "en"}, refset=members)
    return ranked(found.select(*FOUND.split(", ")), F.col("description_id"))


@query(
    "search_identifier",
    "description",
    sql="""SELECT 'concept' AS kind, description_id, NOT active OR NOT concept_active AS danger FROM description WHERE concept_id = 8 AND active
  UNION ALL SELECT 'concept', description_id, NOT active OR NOT concept_active FROM description WHERE concept_id = 7 AND NOT active
  UNION ALL SELECT 'description', description_id, NOT active OR NOT concept_active FROM description WHERE description_id = 115""",
)
def search_identifier(spark, sf_dir):
    """Two concepts under different status filters, and one description."""
    every = fx.descriptions(spark, sf_dir)
    found = [
        ("concept", term.search_identifier(every, "008", "activeOnly")),
        ("concept", term.search_identifier(every, "007", "inactiveOnly")),
        ("description", term.search_identifier(every, " 115 ")),
        ("none", term.search_identifier(every, "125")),
    ]
    parts = [df.select(F.lit(kind).alias("kind"), "description_id", "danger") for kind, df in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


FACET_SQL = f"""SELECT facet, value, count(*) AS matches FROM (
    SELECT 'lang' AS facet, lang AS value FROM description WHERE {HIT_SQL}
    UNION ALL SELECT 'semTag', semantic_tag FROM description WHERE {HIT_SQL}
    UNION ALL SELECT 'module', module FROM description WHERE {HIT_SQL}
    UNION ALL SELECT 'refset', refset_id FROM description JOIN concept_refset USING (concept_id) WHERE {HIT_SQL}) GROUP BY ALL"""


def _facets(spark, sf_dir):
    found = term.search_descriptions(fx.descriptions(spark, sf_dir), WORDS)
    return term.facets(found, fx.concept_refsets(spark, sf_dir))


@query("facets", "description", "concept_refset", sql=FACET_SQL)
def facets(spark, sf_dir):
    return _facets(spark, sf_dir)


@query(
    "order_facets",
    "description",
    "concept_refset",
    sql=f"SELECT *, row_number() OVER (ORDER BY facet, matches DESC, value) AS position FROM ({FACET_SQL})",
)
def order_facets(spark, sf_dir):
    return term.order_facets(_facets(spark, sf_dir))


@query(
    "facets_named",
    "description",
    "concept_refset",
    "facet_name",
    sql=f"""SELECT facet, value, matches, default_term, row_number() OVER (ORDER BY facet, matches DESC, value) AS position
  FROM ({FACET_SQL}) LEFT JOIN facet_name USING (facet, value)""",
)
def facets_named(spark, sf_dir):
    """Facet values with display names, most frequent first."""
    return term.order_facets(term.name_facets(_facets(spark, sf_dir), fx.facet_names(spark, sf_dir)))


# --- relationships --------------------------------------------------------------------------


@query(
    "split_relationships",
    "relationship",
    sql=f"""SELECT CASE WHEN type = '{IS_A}' THEN 'parent' ELSE 'attribute' END AS part, source, type, target, group_id
  FROM relationship WHERE active AND view = 'stated'""",
)
def split_relationships(spark, sf_dir):
    parents, attributes = hier.split_relationships(fx.relationships(spark, sf_dir), "stated")

    def part(df, name):
        return df.select(F.lit(name).alias("part"), "source", "type", "target", "group_id")

    return part(parents, "parent").unionByName(part(attributes, "attribute"))


RELATIONSHIP_ORDER = "source, view, group_id, CASE WHEN type = '116680003' THEN 0 ELSE 1 END, target_name, target, type"


@query(
    "order_relationships",
    "relationship",
    sql=f"""SELECT source, view, type, target, group_id, row_number() OVER (ORDER BY {RELATIONSHIP_ORDER}, active) AS position FROM (
    SELECT source, view, type, target, target_name, group_id, active FROM relationship GROUP BY ALL)""",
)
def order_relationships(spark, sf_dir):
    kept = fx.relationships(spark, sf_dir).select("source", "view", "type", "target", "target_name", "group_id", "active").distinct()
    ordered = term.order_relationships(kept, "source", "view")
    return ordered.select("source", "view", "type", "target", "group_id", "position")


@query(
    "references_by_type",
    "relationship",
    "product_name",
    sql="""SELECT target, relationship, source, source_name, row_number() OVER (ORDER BY target, relationship, source_name, source) AS position FROM (
    SELECT target, source, default_term AS source_name, arg_min(type_name, (CASE WHEN view = 'stated' THEN 0 ELSE 1 END, ordinal, type_name)) AS relationship
      FROM relationship JOIN product_name ON source = concept_id WHERE active GROUP BY target, source, default_term)""",
)
def references_by_type(spark, sf_dir):
    names = fx.product_names(spark, sf_dir).select(F.col("concept_id").alias("source"), F.col("default_term").alias("source_name"))
    return term.references_by_type(fx.relationships(spark, sf_dir).filter("active").join(names, "source"))


PART_SQL = ", ".join(f"max(target_name) FILTER (WHERE type = '{kind}') AS {name}" for kind, name in PRODUCT_PARTS.items())


@query(
    "product_ingredients",
    "relationship",
    "product_name",
    sql=f"""SELECT source AS concept_id, group_id, {PART_SQL} FROM relationship JOIN product_name ON source = concept_id
  WHERE active AND default_term LIKE '%(clinical drug)' AND group_id <> 0 AND type <> '411116001' GROUP BY source, group_id""",
)
def product_ingredients(spark, sf_dir):
    return term.product_ingredients(fx.relationships(spark, sf_dir), fx.product_names(spark, sf_dir))


@query(
    "product_forms",
    "relationship",
    "product_name",
    sql="""SELECT DISTINCT source AS concept_id, target_name AS form FROM relationship JOIN product_name ON source = concept_id
  WHERE active AND default_term LIKE '%(clinical drug)' AND type = '411116001'""",
)
def product_forms(spark, sf_dir):
    return term.product_forms(fx.relationships(spark, sf_dir), fx.product_names(spark, sf_dir))


PIECES_SQL = f"""WITH rel AS (
    SELECT DISTINCT source, type, type_name, target, target_name, type <> '{IS_A}' AS attribute,
           CASE WHEN type = '{IS_A}' THEN 0 ELSE group_id END AS group_id
      FROM relationship WHERE active AND view = 'inferred'),
  marked AS (SELECT *, target || ' |' || target_name || '|' AS ref,
      row_number() OVER (PARTITION BY source ORDER BY attribute, group_id, target_name, target, type) AS place,
      row_number() OVER (PARTITION BY source, attribute, group_id ORDER BY target_name, target, type) AS up,
      row_number() OVER (PARTITION BY source, attribute, group_id ORDER BY target_name DESC, target DESC, type DESC) AS down,
      row_number() OVER (PARTITION BY source, attribute ORDER BY group_id, target_name, target, type) AS nth,
      bool_or(NOT attribute) OVER (PARTITION BY source) AS has_parent FROM rel)
  SELECT concept_id, CAST(1 AS BIGINT) AS position, CASE WHEN fully_defined THEN '=== ' ELSE '<<< ' END AS piece FROM product_name
  UNION ALL SELECT source, place + 1, CASE
      WHEN NOT attribute THEN CASE WHEN up = 1 THEN '' ELSE ' + ' END || ref
      ELSE CASE WHEN up > 1 THEN ', ' WHEN nth > 1 THEN ' ' WHEN has_parent THEN ' : ' ELSE ': ' END
           || CASE WHEN up = 1 AND group_id <> 0 THEN '{{ ' ELSE '' END || type || ' |' || type_name || '| = ' || ref
           || CASE WHEN down = 1 AND group_id <> 0 THEN ' }}' ELSE '' END END FROM marked"""


def _inferred(spark, sf_dir):
    shown = fx.relationships(spark, sf_dir).filter("active AND view = 'inferred'")
    return shown.select("source", "type", "type_name", "target", "target_name", "group_id").distinct()


def _parts_sql(size: int) -> str:
    return f"""SELECT concept_id, (position - 1) // {size} AS part, string_agg(piece, '' ORDER BY position) AS text
  FROM ({PIECES_SQL}) GROUP BY ALL"""


@query("definition_expression", "relationship", "product_name", sql=_parts_sql(term.PART_PIECES))
def definition_expression(spark, sf_dir):
    return term.definition_expression(fx.product_names(spark, sf_dir), _inferred(spark, sf_dir))


@query("definition_expression_in_parts", "relationship", "product_name", sql=_parts_sql(4))
def definition_expression_in_parts(spark, sf_dir):
    """The same texts in parts of four pieces."""
    return term.definition_expression(fx.product_names(spark, sf_dir), _inferred(spark, sf_dir), part_pieces=4)


@query("definition_pieces", "relationship", "product_name", sql=f"SELECT * FROM ({PIECES_SQL})")
def definition_pieces(spark, sf_dir):
    """Every piece of every definition with its place."""
    return term.numbered_pieces(fx.product_names(spark, sf_dir), _inferred(spark, sf_dir))


# --- hierarchy ------------------------------------------------------------------------------


def _ids(spark, *ids):
    return small_table(spark, [(i,) for i in ids], "concept_id string")


@query("children_of", "edge", sql="SELECT DISTINCT child AS concept_id FROM edge WHERE parent IN ('R1', 'N3')")
def children_of(spark, sf_dir):
    return hier.children_of(fx.is_a_edges(spark, sf_dir), _ids(spark, "R1", "N3"))


@query("parents_of", "edge", sql="SELECT DISTINCT parent AS concept_id FROM edge WHERE child LIKE 'S%'")
def parents_of(spark, sf_dir):
    edges = fx.is_a_edges(spark, sf_dir)
    suppliers = edges.filter(F.col("child").startswith("S")).select(F.col("child").alias("concept_id"))
    return hier.parents_of(edges, suppliers)


@query("descendants_of", "closure", sql="SELECT DISTINCT descendant AS concept_id FROM closure WHERE ancestor = 'R2'")
def descendants_of(spark, sf_dir):
    return hier.descendants_of(fx.is_a_edges(spark, sf_dir), _ids(spark, "R2"))


@query(
    "descendants_or_self",
    "closure",
    sql="SELECT DISTINCT descendant AS concept_id FROM closure WHERE ancestor IN ('R0', 'N7') UNION SELECT 'R0' UNION SELECT 'N7'",
)
def descendants_or_self(spark, sf_dir):
    return hier.descendants_of(fx.is_a_edges(spark, sf_dir), _ids(spark, "R0", "N7"), include_self=True)


@query(
    "ancestors_of",
    "closure",
    sql="SELECT DISTINCT ancestor AS concept_id FROM closure WHERE descendant LIKE 'C%'",
)
def ancestors_of(spark, sf_dir):
    edges = fx.is_a_edges(spark, sf_dir)
    customers = edges.filter(F.col("child").startswith("C")).select(F.col("child").alias("concept_id"))
    return hier.ancestors_of(edges, customers)


@query(
    "ancestors_or_self",
    "closure",
    sql="SELECT DISTINCT ancestor AS concept_id FROM closure WHERE descendant = 'S1' UNION SELECT 'S1'",
)
def ancestors_or_self(spark, sf_dir):
    return hier.ancestors_of(fx.is_a_edges(spark, sf_dir), _ids(spark, "S1"), include_self=True)


@query("self_of", "node", sql="SELECT concept_id FROM node WHERE concept_id IN ('R1', 'S3')")
def self_of(spark, sf_dir):
    return hier.self_of(fx.node_names(spark, sf_dir), _ids(spark, "R1", "S3", "unknown"))


@query(
    "descendant_counts",
    "closure",
    "node",
    sql="""SELECT concept_id, count(descendant) AS descendants FROM node LEFT JOIN closure ON ancestor = concept_id GROUP BY concept_id""",
)
def descendant_counts(spark, sf_dir):
    return hier.descendant_counts(fx.is_a_edges(spark, sf_dir))


@query(
    "descendant_counts_shared",
    "supply_edge",
    sql="""SELECT concept_id, count(DISTINCT descendant) AS descendants FROM (SELECT child AS concept_id FROM supply_edge UNION SELECT parent FROM supply_edge)
  LEFT JOIN (WITH RECURSIVE walk AS (SELECT parent AS ancestor, child AS descendant FROM supply_edge
      UNION SELECT ancestor, child FROM walk JOIN supply_edge ON parent = descendant) SELECT * FROM walk WHERE ancestor <> descendant)
    ON ancestor = concept_id GROUP BY concept_id""",
)
def descendant_counts_shared(spark, sf_dir):
    """Counts in a graph with shared children and a cycle."""
    return hier.descendant_counts(fx.supply_edges(spark, sf_dir))


# --- constraints ----------------------------------------------------------------------------


@query("members_of", "member", sql="SELECT DISTINCT concept_id FROM member WHERE refset_id = 'MACHINERY'")
def members_of(spark, sf_dir):
    return con.members_of(fx.customer_refsets(spark, sf_dir), "MACHINERY")


@query(
    "has_relationship",
    "relationship",
    sql="SELECT DISTINCT source AS concept_id FROM relationship WHERE active AND target = '7'",
)
def has_relationship(spark, sf_dir):
    return con.has_relationship(fx.relationships(spark, sf_dir), "7")


@query(
    "has_description",
    "description",
    sql=f"SELECT DISTINCT concept_id FROM description WHERE active AND type_id = '{fx.FULL_NAME}'",
)
def has_description(spark, sf_dir):
    return con.has_description(fx.descriptions(spark, sf_dir), fx.FULL_NAME)


@query(
    "refine",
    "relationship",
    "product_name",
    sql="""SELECT 'typed' AS kind, concept_id FROM product_name WHERE fully_defined AND concept_id IN (
    SELECT source FROM relationship WHERE active AND type = '127489000' AND target IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_brand = 'Brand#3'))
  UNION ALL SELECT 'any', concept_id FROM product_name WHERE fully_defined AND concept_id IN (
    SELECT source FROM relationship WHERE active AND target IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_brand = 'Brand#3'))""",
)
def refine(spark, sf_dir):
    focus = fx.product_names(spark, sf_dir).filter("fully_defined")
    values = fx.given(spark, sf_dir, "part").filter("p_brand = 'Brand#3'").select(F.col("p_partkey").cast("string").alias("concept_id"))
    rel = fx.relationships(spark, sf_dir)
    typed = con.refine(focus, rel, "127489000", values).select(F.lit("typed").alias("kind"), "concept_id")
    return typed.unionByName(con.refine(focus, rel, "*", values).select(F.lit("any").alias("kind"), "concept_id"))


def _conditions(spark, sf_dir):
    edges, members = fx.is_a_edges(spark, sf_dir), fx.customer_refsets(spark, sf_dir)
    return {
        "below R1": hier.descendants_of(edges, _ids(spark, "R1")),
        "below N3": hier.children_of(edges, _ids(spark, "N3")),
        "machinery": con.members_of(members, "MACHINERY"),
        "furniture": con.members_of(members, "FURNITURE"),
        "household": con.members_of(members, "HOUSEHOLD"),
    }


CONDITION_SQL = {
    "below R1": "SELECT descendant AS concept_id FROM closure WHERE ancestor = 'R1'",
    "below N3": "SELECT child AS concept_id FROM edge WHERE parent = 'N3'",
    "machinery": "SELECT concept_id FROM member WHERE refset_id = 'MACHINERY'",
    "furniture": "SELECT concept_id FROM member WHERE refset_id = 'FURNITURE'",
    "household": "SELECT concept_id FROM member WHERE refset_id = 'HOUSEHOLD'",
}


COMBINE_SQL = f"""(({CONDITION_SQL["below R1"]} INTERSECT {CONDITION_SQL["machinery"]}) UNION ({CONDITION_SQL["furniture"]}))
  EXCEPT (({CONDITION_SQL["below N3"]}) UNION ({CONDITION_SQL["household"]} INTERSECT {CONDITION_SQL["below R1"]}))"""


@query(
    "combine",
    "closure",
    "member",
    sql=COMBINE_SQL,
)
def combine(spark, sf_dir):
    """(below R1 AND machinery OR furniture) MINUS (below N3 OR household AND below R1)."""
    c = _conditions(spark, sf_dir)
    return con.combine(
        [[c["below R1"], c["machinery"]], [c["furniture"]]], [[c["below N3"]], [c["household"], c["below R1"]]]
    )


@query("export_constraint", "closure", "member", "node", sql=f"SELECT concept_id, default_term FROM node JOIN ({COMBINE_SQL}) USING (concept_id)")
def export_constraint(spark, sf_dir):
    """The complete result of ``combine`` with names as CSV, read back."""
    named = combine(spark, sf_dir).join(fx.node_names(spark, sf_dir), "concept_id").select("concept_id", "default_term")
    path = sinks.export(named, staging_path(spark, "constraint"))
    return spark.read.option("header", True).schema("concept_id string, default_term string").csv(path)


@query(
    "condition_counts",
    "closure",
    "member",
    sql="\nUNION ALL ".join(
        f"SELECT '{name}' AS condition, count(DISTINCT concept_id) AS concepts FROM ({body})" for name, body in CONDITION_SQL.items()
    ),
)
def condition_counts(spark, sf_dir):
    return con.condition_counts(_conditions(spark, sf_dir))


EXTRA_SQL = ", ".join(f"('{i}', '{name}')" for i, name in EXTRA_ATTRIBUTES)


@query(
    "attribute_types",
    "closure",
    "node",
    sql=f"""SELECT concept_id, default_term FROM closure JOIN node ON descendant = concept_id WHERE ancestor = 'R3'
  UNION ALL SELECT * FROM (VALUES {EXTRA_SQL})""",
)
def attribute_types(spark, sf_dir):
    """Attribute list below a root of the derived graph."""
    return con.attribute_types(fx.is_a_edges(spark, sf_dir), fx.node_names(spark, sf_dir), root="R3")


# --- reference sets -------------------------------------------------------------------------


@query(
    "members_page",
    "member",
    sql="""SELECT refset_id, concept_id, total, greatest(total - 30, 0) AS remaining, least(greatest(total - 30, 0), 20) AS next_size FROM (
    SELECT *, count(*) OVER () AS total FROM member WHERE refset_id = 'BUILDING') ORDER BY concept_id LIMIT 20 OFFSET 10""",
)
def members_page(spark, sf_dir):
    return term.members_page(fx.customer_refsets(spark, sf_dir), "BUILDING", skip=10, limit=20)


@query(
    "refset_catalogue",
    sql="""SELECT refset_id, type, default_term, row_number() OVER (ORDER BY CASE WHEN type = 'daily-build' THEN 0 ELSE 1 END, type, default_term, refset_id) AS position FROM (
    SELECT 'M' || c_mktsegment || c_nationkey AS refset_id, CASE WHEN c_nationkey % 4 = 0 THEN 'daily-build' WHEN c_nationkey % 4 = 1 THEN 'core' ELSE 'map' END AS type,
           min(c_name) AS default_term FROM customer GROUP BY c_mktsegment, c_nationkey)""",
)
def refset_catalogue(spark, sf_dir):
    """Customer segments per nation as reference sets."""
    key = F.col("c_nationkey") % 4
    sets = fx.given(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.min("c_name").alias("default_term"))
    named = sets.select(
        F.concat(F.lit("M"), "c_mktsegment", F.col("c_nationkey").cast("string")).alias("refset_id"),
        F.when(key == 0, "daily-build").when(key == 1, "core").otherwise("map").alias("type"),
        "default_term",
    )
    return term.refset_catalogue(named)
