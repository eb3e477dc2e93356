"""From raw documents to packed training sequences, in five stages.

Each stage gets the rows its predecessor left, as a table read back from Parquet. Columns are renamed while an operator works, so
that extra columns cannot clash with its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm import bin_slack, blocks, disclosure, language_ppm, odd_sketches, repeats
from termweave.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is in no learned language: a null text or one without letters."""
    rows, names = blocks.renamed(docs)
    hold = language_ppm.held_out(F.col(names["doc_id"]), 5, 0)
    trees = language_ppm.fit(rows.filter(~hold), text=names["text"], lang=names["lang"])
    found = language_ppm.predict(rows, trees, keep=tuple(rows.columns), text=names["text"])
    return blocks.restored(found.filter(F.col("lang_pred") != language_ppm.UNKNOWN), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates: five-word shingles, similarity 0.8.

    Of rows with the same doc_id the one with the smallest text stays; rows without an id stay.
    """
    rows, names = blocks.renamed(docs)
    key, text = names["doc_id"], names["text"]
    judged = odd_sketches.near_duplicates(rows, size=5, percent=80, key=key, text=text)
    kept = judged.filter("kept and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c) for c in (text, *(c for c in rows.columns if c not in (key, text)))]))
    with_id = rows.join(kept, key, "left_semi").withColumn("place", place).filter("place = 1").drop("place")
    return blocks.restored(with_id.unionByName(rows.filter(F.col(key).isNull())), names)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 bytes or more that also stand in a document with a smaller id.

    Bytes of a character that is cut in two are dropped; a null text becomes empty.
    """
    rows, names = blocks.renamed(docs)
    carry = tuple(n for c, n in names.items() if c not in ("text", "n_chars"))
    found = repeats.without_repeats(rows, names["doc_id"], names["text"], carry=carry)
    found = found.withColumn(names["text"], F.col("kept"))
    return blocks.restored(found.withColumn(names["n_chars"], F.length(names["text"]).cast(docs.schema["n_chars"].dataType)), names)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it."""
    return disclosure.sanitised(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 1024 tokens."""
    return bin_slack.pack(bin_slack.token_pieces(docs, tokenizer_path()))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Neither byte-level tokens nor context trees can be told in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents below ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = blocks.stored(stage(spark, docs, sf_dir), name)
    return docs
