"""Queries over work lists and the table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.operators import tableops as tab
from termweave.operators import worklist as wl
from termweave.operators import mapping as log
from termweave.plans import fixtures as fx
from termweave.plans.registry import query

LIST_KEYS = ["user_id", "source_dialect_id"]


def _notes(spark, sf_dir):
    edits = fx.note_edits(spark, sf_dir)
    return log.upsert_notes(edits.drop("edit_no").limit(0), edits)


def worklist(spark, sf_dir):
    """One work list per organisation."""
    concepts = fx.concepts_view(spark, sf_dir)
    # mappings need the concepts only by name, so metadata rows need not repeat them
    names = fx.concepts_view(spark, sf_dir, counted=False)
    mappings = fx.mappings_view(spark, sf_dir, names)
    return wl.concept_worklist(concepts, mappings, fx.viewers(spark, sf_dir), _notes(spark, sf_dir))


PROJECTED_SQL = """SELECT user_id, source_dialect_id, 'Huomio' AS huom, coalesce(code_text, '') AS code_text, coalesce(term_text, '') AS term_text,
       coalesce(destination_code_text, '') AS destination_code_text, coalesce(destination_term_text, '') AS destination_term_text,
       coalesce(obs_number, 1) AS obs_number, coalesce(strftime(first_obs_date, '%Y-%m-%d'), '') AS first_obs_date,
       coalesce(strftime(last_obs_date, '%Y-%m-%d'), '') AS last_obs_date, coalesce(mapping_user, '') AS mapping_user,
       coalesce(mapping_ts, '') AS mapping_ts, coalesce(status, '') AS status, coalesce(source_concept_id, -1) AS source_concept_id,
       coalesce(user_concept_note, '') AS user_concept_note FROM worklist"""
fx.SQL["shown"] = (("worklist",), PROJECTED_SQL)


@query("concept_worklist", "worklist", sql="SELECT * FROM worklist")
def concept_worklist(spark, sf_dir):
    return worklist(spark, sf_dir)


@query("worklist_projection", "shown", sql="SELECT * FROM shown")
def worklist_projection(spark, sf_dir):
    return wl.worklist_projection(worklist(spark, sf_dir), LIST_KEYS)


@query(
    "next_step",
    "worklist",
    sql="""SELECT user_id, source_concept_id, CASE WHEN status IN ('bridge', 'other_organisation') THEN 'candidates'
       WHEN status IN ('self', 'own_organisation') THEN 'history' ELSE 'free_mapping' END AS next_step,
       coalesce(status, '') <> '' AND coalesce(destination_code_text, '') = '' AS rejected FROM worklist""",
)
def next_step(spark, sf_dir):
    return wl.next_step(worklist(spark, sf_dir)).select("user_id", "source_concept_id", "next_step", "rejected")


PROGRESS_SQL = """SELECT user_id, source_dialect_id, status, count(*) AS term_counts, CAST(sum(obs_number) AS BIGINT) AS samp_counts
  FROM worklist GROUP BY ALL"""


@query("progress", "worklist", sql=PROGRESS_SQL)
def progress(spark, sf_dir):
    return wl.progress(worklist(spark, sf_dir), LIST_KEYS)


def _summary_sql() -> str:
    sums, percents = [], []
    for kind, column in (("concepts", "term_counts"), ("samples", "samp_counts")):
        for status in wl.STATUSES:
            part = f"coalesce(sum({column}) FILTER (WHERE status = '{status}'), 0)"
            sums.append(f"CAST({part} AS BIGINT) AS {status}_{kind}")
            percents.append(
                f"CASE WHEN coalesce(sum({column}), 0) > 0 THEN CAST({part} AS DOUBLE) / CAST(sum({column}) AS DOUBLE) * 100 ELSE 0.0::DOUBLE END AS {status}_{kind}_percent"
            )
        sums.append(f"CAST(coalesce(sum({column}), 0) AS BIGINT) AS total_{kind}")
        listed = ", ".join(f"'{s}'" for s in wl.STATUSES)
        sums.append(f"CAST(coalesce(sum({column}) FILTER (WHERE status IN ({listed})), 0) AS BIGINT) AS mapped_{kind}")
    return f"SELECT user_id, source_dialect_id, {', '.join(sums + percents)} FROM ({PROGRESS_SQL}) GROUP BY user_id, source_dialect_id"


@query("progress_summary", "worklist", sql=_summary_sql())
def progress_summary(spark, sf_dir):
    return wl.progress_summary(wl.progress(worklist(spark, sf_dir), LIST_KEYS), LIST_KEYS)


@query(
    "concept_with_note",
    "v_concept",
    "note",
    sql="""SELECT c.concept_id, code_text, term_text, obs_number, coalesce(note, '') AS note_text
  FROM v_concept c LEFT JOIN note n ON n.concept_id = c.concept_id AND n.user_id = 7""",
)
def concept_with_note(spark, sf_dir):
    return wl.concept_with_note(fx.concepts_view(spark, sf_dir), _notes(spark, sf_dir), user_id=7)


@query(
    "similar_concepts",
    "worklist",
    "page_concept",
    sql="""SELECT p.concept_id AS page_concept_id, w.source_dialect_id, w.source_concept_id, w.code_text, w.term_text, w.obs_number, w.status
  FROM worklist w JOIN page_concept p ON w.source_dialect_id = p.dialect_id
 WHERE (w.code_text = p.code_text OR w.term_text = p.term_text) AND NOT (w.code_text = p.code_text AND w.term_text = p.term_text)""",
)
def similar_concepts(spark, sf_dir):
    """Similar concepts for the page of each dialect's most observed concept, within its list."""
    pages = fx.page_concepts(fx.concepts_view(spark, sf_dir)).select(
        F.col("dialect_id").alias("source_dialect_id"), F.col("concept_id").alias("page_concept_id"), "code_text", "term_text"
    )
    found = wl.similar_concepts(worklist(spark, sf_dir), pages, ["source_dialect_id"])
    return found.select(
        "page_concept_id", "source_dialect_id", "source_concept_id", "code_text", "term_text", "obs_number", "status"
    )


@query(
    "similar_counts",
    "worklist",
    sql="""SELECT source_dialect_id, code_text, term_text,
       CAST(sum(n) OVER (PARTITION BY source_dialect_id, code_text) - n AS BIGINT) AS same_code,
       CAST(sum(n) OVER (PARTITION BY source_dialect_id, term_text) - n AS BIGINT) AS same_term
  FROM (SELECT source_dialect_id, code_text, term_text, count(*) AS n FROM worklist GROUP BY ALL)""",
)
def similar_counts(spark, sf_dir):
    return wl.similar_counts(worklist(spark, sf_dir), ["source_dialect_id"])


# --- table operators ------------------------------------------------------------------------

PHRASE = "T00[1-4].*|blue|önation|nation_2\\)"
SEARCH_SQL = " OR ".join(f"regexp_matches({name}, '{PHRASE}', 'i')" for name in tab.SEARCHABLE)
SORT_KEYS = [("term_text", "asc"), ("obs_number", "desc")]
TIEBREAK = ["source_concept_id", "first_obs_date", "last_obs_date"]
SORT_SQL = "obs_number DESC, term_text, source_concept_id, first_obs_date, last_obs_date"
DEEP_START = 20


def _shown(spark, sf_dir):
    return wl.worklist_projection(worklist(spark, sf_dir), LIST_KEYS)


@query("search_rows", "shown", sql=f"SELECT * FROM shown WHERE {SEARCH_SQL}")
def search_rows(spark, sf_dir):
    return tab.search_rows(_shown(spark, sf_dir), PHRASE)


@query(
    "table_sort",
    "shown",
    sql=f"""SELECT source_concept_id, term_text, obs_number, first_obs_date, row_number() OVER (ORDER BY {SORT_SQL}) AS position FROM shown""",
)
def table_sort(spark, sf_dir):
    """The last key listed is the primary one."""
    ordered = tab.ordered_rows(_shown(spark, sf_dir), SORT_KEYS, TIEBREAK)
    return ordered.select("source_concept_id", "term_text", "obs_number", "first_obs_date", "position")


@query(
    "page_rows",
    "shown",
    sql=f"SELECT source_concept_id, term_text, obs_number FROM shown ORDER BY {SORT_SQL} LIMIT 25 OFFSET 50",
)
def page_rows(spark, sf_dir):
    order = tab.sort_order(SORT_KEYS, TIEBREAK)
    return tab.page(_shown(spark, sf_dir), order, 50, 25).select("source_concept_id", "term_text", "obs_number")


@query(
    "page_deep",
    sql="""SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rn
  FROM lineitem) WHERE rn > (SELECT count(*) // 2 + 10000 FROM lineitem) AND rn <= (SELECT count(*) // 2 + 10025 FROM lineitem)""",
)
def page_deep(spark, sf_dir):
    """A page from the middle of a long table, read by distributed row numbers."""
    line = fx.given(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in ("l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    start = line.count() // 2 + tab.TOP_ROWS
    return tab.page(line, order, start, 25).select("l_orderkey", "l_partkey", "l_extendedprice")


@query("page_all", "shown", sql="SELECT source_concept_id, term_text, obs_number FROM shown")
def page_all(spark, sf_dir):
    """Length -1 returns every row, whatever the start."""
    order = tab.sort_order(SORT_KEYS, TIEBREAK)
    return tab.page(_shown(spark, sf_dir), order, 50, -1).select("source_concept_id", "term_text", "obs_number")


@query(
    "select_columns",
    "shown",
    sql="SELECT " + ", ".join(f'{name} AS "{title}"' for name, title, _ in tab.WORKLIST_COLUMNS) + " FROM shown",
)
def select_columns(spark, sf_dir):
    return tab.worklist_columns(_shown(spark, sf_dir))


@query(
    "search_totals",
    "shown",
    sql=f"SELECT count(*) AS total_records, count(*) FILTER (WHERE {SEARCH_SQL}) AS total_display_records FROM shown",
)
def search_totals(spark, sf_dir):
    return tab.search_totals(_shown(spark, sf_dir), PHRASE)
