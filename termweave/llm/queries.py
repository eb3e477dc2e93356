"""Registered queries of the operators for training data, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import (
    bin_slack,
    decontamination,
    disclosure,
    language_ppm,
    ngram_trie,
    odd_sketches,
    rare_features,
    repeats,
    sampled_pieces,
    spelling,
    url_rules,
    weak_rules,
    whitening,
)
from termweave.runtime import small_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Host, path and verdict of each rule.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

OP9_SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query("op9_url_rules", sql=OP9_SQL)
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the rules; urls that no rule fits are allowed."""
    rules = small_table(spark, URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


@query("op2_weak_rules")
def op2_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and posterior verdict of every document."""
    out = weak_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("probability", 9).alias("probability"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_bin_slack")
def op6_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of 1024."""
    return bin_slack.pack(bin_slack.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


@query("op3_language_ppm")
def op3_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_ppm.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


@query("op5_rare_features")
def op5_rare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return rare_features.compare_with_next(table(spark, sf_dir, "documents"))


@query("op4_disclosure")
def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with the terms that disclose it."""
    found = disclosure.find(table(spark, sf_dir, "documents"))
    counts = [disclosure.count_of(kind).alias(f"n_{kind}") for kind in disclosure.KINDS]
    return found.select("doc_id", *counts, "base_sha256", disclosure.spans_text().alias("spans"))


@query("op8_odd_sketches")
def op8_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: three-word shingles, similarity 0.85."""
    return odd_sketches.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_repeats")
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that also stand in an earlier one, in passages of 50 bytes or more."""
    return repeats.without_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@query("op1_ngram_trie")
def op1_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the model of the documents that are not held out."""
    return ngram_trie.score(table(spark, sf_dir, "documents"))


def sampled(texts: DataFrame, *keep: str) -> DataFrame:
    import public_tokenizers

    found = sampled_pieces.encode_sampled(texts, public_tokenizers.path("piece_bpe_32k.model"), keep=keep)
    digest = F.crc32(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"))
    return found.select(*keep, "sample", F.size("ids").cast("long").alias("n_pieces"), digest.alias("ids_crc32"), "log_probability", "perturbed", "log_inclusion")


@query("op7_sampled_pieces")
def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every document."""
    return sampled(table(spark, sf_dir, "documents"), "doc_id")


@query("op7_sampled_turns")
def op7_sampled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every conversation turn."""
    return sampled(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its more frequent variant, if it has one."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector in whitened coordinates, one row for each component."""
    found, model = whitening.whiten(table(spark, sf_dir, "embeddings"))
    rows = found.select("vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    shares = [] if model is None else [float(v / model.trace) for v in model.variances]
    explained = F.array(*map(F.lit, shares)).cast("array<double>")
    return rows.select(
        "vec_id",
        (F.col("component") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("component")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


#: Windows of ten item words; an item of fewer words is one window.
OP13_SQL = r"""
WITH b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS s FROM sized)
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), shingles AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM win))
), hits AS (SELECT doc_id, item_id, s, k FROM shingles JOIN win USING (k, phrase)),
words_hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS place FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op13_decontamination", sql=OP13_SQL)
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a ten-word window of a benchmark item."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
