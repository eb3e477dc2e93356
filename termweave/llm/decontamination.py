"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

The index holds one posting (term, row, pos) for each word of the training texts, sorted by term within each task's file.
A benchmark item is asked for by windows of ten consecutive words. Each window looks up its two rarest terms; their lists,
moved by the terms' offsets in the item, meet where both stand at the right distance. Where they do, the lists of the item's
other terms are fetched for that row alone and intersected at their own offsets, and stretches of ten or more
matches in a row are exact occurrences. Lists of frequent terms are therefore read only in rows that rarer terms point at.

Proximity search takes the same index: all different words of a window within a given stretch, in any order.

Defined results: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a null or empty text has none, so such a
document is clean and such an item never occurs; an item of fewer than ten words is one window; repeated documents are judged
one by one, items with equal words are looked up once and all their ids reported, each once; an item without id marks
words but is not listed; empty tables give no rows, or clean ones; other columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.blocks import stored

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The entries of whole rows stand under this many terms, which no word can be, so that none of them is frequent.
OWN_TERMS = 64


@dataclass(frozen=True)
class Index:
    """``postings`` (term, row, pos from 0) and ``rows`` (row, key, n_words), all rows of the indexed table."""

    postings: DataFrame
    rows: DataFrame


def words_of(text: Column) -> Column:
    lower = F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _own_term(number: Column) -> Column:
    return F.concat(F.lit(" "), F.pmod(number, F.lit(OWN_TERMS)).cast("string"))


def build(documents: DataFrame, key: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> Index:
    """The index of all words, or of the given ``terms`` (column term) alone; one pass over the texts.

    Each task writes its own segment, so nothing is shuffled as long as ``terms`` fits Spark's broadcast threshold.
    """
    rows = documents.select(F.col(key).alias("key"), words_of(F.col(text)).alias("words")).withColumn("row", F.monotonically_increasing_id())
    both = F.posexplode(F.concat(F.array(_own_term(F.col("row"))), F.col("words"))).alias("at", "term")
    entries = rows.select("row", "key", F.size("words").cast("long").alias("n_words"), both)
    if terms is not None:
        own = documents.sparkSession.range(OWN_TERMS).select(_own_term(F.col("id")).alias("term"))
        entries = entries.join(stored(terms.select("term").distinct().unionByName(own), "terms"), "term")
    is_row = F.col("at") == 0
    entries = entries.select("term", "row", (F.col("at") - 1).alias("pos"), *[F.when(is_row, F.col(c)).alias(c) for c in ("key", "n_words")])
    segments = stored(entries.sortWithinPartitions("term", "row", "pos"), "index")
    return Index(segments.filter("pos >= 0").select("term", "row", "pos"), segments.filter("pos < 0").select("row", "key", "n_words"))


# --- windows ------------------------------------------------------------------------------------


def _classes(items: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Different word sequences (class, words), and the items that have them (class, item)."""
    rows = items.select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    rows = stored(rows.withColumn("number", F.monotonically_increasing_id()), "items")
    classes = stored(rows.groupBy("words").agg(F.min("number").alias("class")), "classes")
    return classes, stored(rows.join(classes, "words").select("class", "item").distinct(), "members")


def _places(classes: DataFrame, window: int) -> DataFrame:
    """(class, k, m, p, term): the words of each class by place; windows of it have k of its m words."""
    size = F.size("words")
    return classes.select("class", F.least(F.lit(window), size).alias("k"), size.alias("m"), F.posexplode("words").alias("p", "term"))


def _window_words(places: DataFrame, postings: DataFrame) -> DataFrame:
    """Each word of each window (class, s), with the number n of its postings."""
    wanted = places.select("term").distinct()
    frequency = postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counted = places.join(frequency, "term", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") - F.col("k") + 1), F.least(F.col("p"), F.col("m") - F.col("k")))
    return counted.select("class", "k", "p", "term", "n", F.explode(starts).alias("s"))


# --- exact phrases ------------------------------------------------------------------------------


def _pairs(window_words: DataFrame) -> DataFrame:
    """The two rarest places of each window that can occur: (class, a, b, p, term), one row each, b null for one-word windows."""
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("n", "p", "term"))), 1, 2)
    found = window_words.groupBy("class", "s").agg(rarest.alias("two")).filter(F.col("two")[0]["n"] > 0)
    pairs = found.select("class", F.col("two")[0]["p"].alias("a"), F.get("two", F.lit(1))["p"].alias("b"), "two").distinct()
    return pairs.select("class", "a", "b", F.explode("two").alias("w")).select("class", "a", "b", "w.p", "w.term")


def occurrences(index: Index, classes: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, class, first, last): stretches of a row's words that equal ``window`` or more consecutive words of the class."""
    places = stored(_places(classes, window), "places")
    lookups = stored(_pairs(_window_words(places, index.postings)), "lookups")
    moved = index.postings.join(lookups, "term").select("row", "class", "a", "b", (F.col("pos") - F.col("p")).alias("start"))
    needed = F.when(F.col("b").isNull(), 1).otherwise(2)
    met = moved.groupBy("row", "class", "a", "b", "start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == needed)
    candidates = stored(met.select("row", "class", "start").distinct(), "candidates")
    near = index.postings.join(stored(candidates.select("row").distinct(), "rows"), "row", "left_semi")
    asked = candidates.join(places, "class").select("row", "class", "start", "k", "p", "term", (F.col("start") + F.col("p")).alias("pos"))
    matched = asked.join(near, ["row", "pos", "term"])
    place = F.row_number().over(Window.partitionBy("row", "class", "start").orderBy("p"))
    runs = matched.withColumn("run", F.col("p") - place).groupBy("row", "class", "start", "run", "k").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.filter(F.col("last") - F.col("first") + 1 >= F.col("k")).select("row", "class", "first", "last")


def contaminated(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: words, words inside an occurrence of a window, and the items these windows are from."""
    classes, members = _classes(items, item_key, item_text)
    index = build(documents, key, text, classes.select(F.explode("words").alias("term")))
    found = stored(occurrences(index, classes, window), "occurrences")
    hit = found.select("row", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    listed = found.select("row", "class").distinct().join(members, "class").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = index.rows.join(hit, "row", "left").join(listed, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("key").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


# --- proximity ----------------------------------------------------------------------------------


def proximities(index: Index, classes: DataFrame, within: int, window: int = WINDOW) -> DataFrame:
    """(row, class, s, first): windows of a class all of whose different words stand among ``within`` consecutive words of the row.

    ``first`` is the place where the first such stretch begins. The two rarest words of a window meet in cells of ``within``
    places and their neighbours; the other words are fetched for those rows alone.
    """
    places = stored(_places(classes, window), "places")
    words = _window_words(places, index.postings).select("class", "s", "term", "n").distinct()
    rarest = F.array_sort(F.collect_list(F.struct("n", "term")))
    windows = stored(words.groupBy("class", "s").agg(rarest.alias("words")).filter(F.col("words")[0]["n"] > 0), "windows")

    def placed(which: int) -> DataFrame:
        lookup = windows.filter(F.size("words") > which).select("class", "s", F.col("words")[which]["term"].alias("term"))
        return index.postings.join(lookup, "term").select("class", "s", "row", "pos", F.floor(F.col("pos") / within).alias("cell"))

    single = placed(0).join(windows.filter(F.size("words") == 1).select("class", "s"), ["class", "s"], "left_semi").select("class", "s", "row", "pos")
    around = F.explode(F.array(*[F.col("cell") + k for k in (-1, 0, 1)]))
    other = placed(1).select("class", "s", "row", F.col("pos").alias("other"), around.alias("cell"))
    double = placed(0).join(other, ["class", "s", "row", "cell"]).filter(F.abs(F.col("pos") - F.col("other")) < within).select("class", "s", "row", "pos")
    anchors = stored(single.unionByName(double).distinct(), "anchors")
    near = index.postings.join(stored(anchors.select("row").distinct(), "rows"), "row", "left_semi").select("row", "term", F.col("pos").alias("at"), F.floor(F.col("pos") / within).alias("cell"))
    asked = anchors.join(windows, ["class", "s"]).select("class", "s", "row", "pos", F.size("words").alias("n"), F.explode("words").alias("w"))
    asked = asked.select("class", "s", "row", "pos", "n", F.col("w.term").alias("term"), F.explode(F.array(*[F.floor(F.col("pos") / within) + k for k in (-1, 0, 1)])).alias("cell"))
    found = asked.join(near, ["row", "term", "cell"]).filter(F.abs(F.col("at") - F.col("pos")) < within)
    found = found.select("class", "s", "row", "n", "at", "term").distinct()
    ahead = Window.partitionBy("class", "s", "row").orderBy("at").rangeBetween(0, within - 1)
    full = found.withColumn("seen", F.size(F.collect_set("term").over(ahead))).filter(F.col("seen") == F.col("n"))
    return full.groupBy("row", "class", "s").agg(F.min("at").alias("first"))


def near_items(documents: DataFrame, items: DataFrame, within: int, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, item, n_windows): items with windows whose words stand close together in the document, in any order."""
    classes, members = _classes(items, item_key, item_text)
    index = build(documents, key, text, classes.select(F.explode("words").alias("term")))
    found = proximities(index, classes, within, window).groupBy("row", "class").agg(F.count(F.lit(1)).alias("n_windows"))
    return found.join(members, "class").join(index.rows, "row").select(F.col("key").alias("doc_id"), "item", "n_windows")
