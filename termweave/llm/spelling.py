"""Spelling variants: words of the corpus within one edit of each other, by dynamic programming over the sorted vocabulary.

The vocabulary is sorted twice, by the words and by the words read backwards. Two words one edit apart share the first half
of the shorter one or, read backwards, a beginning as long, so each pair is found in exactly one of the two lists, and only
near the place where that half stands. The lists are cut into shards by range; a word is sent to the shards
its half reaches, except those whose common beginning is already more than one edit away.

In a shard the list is scanned depth by depth: a row of the edit matrix, banded to three entries, is computed once for each
(word, beginning) and used for the whole range of the list that shares the beginning, which the common prefix lengths (LCP) of
neighbours delimit. A range whose row exceeds one edit is skipped as a whole.

Defined results: a null or empty text has no words; a null id counts as an empty string in the hash; repeated rows are counted
as often as they occur; of near words with equal counts the smallest in code-point order is the form; very long words are words
like any other; an empty table gives no rows; other columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import blocks
from termweave.runtime import materialise

RUN = re.compile("[a-zÀ-ÿ]+")
_ALL = re.compile("[A-Za-zÀ-ÿ]")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Of the hashes of runs, one in so many loses a character.
SLIP = 97
SHORTEST, FEWEST = 5, 3
#: Distinct words a task counts before it sends them on, characters searched at once, words of a shard, words asked at once.
COUNTED, PIECE, SHARD, ASKED = 200_000, 1 << 20, 50_000, 2_000
#: Characters of a shard's borders that are compared when words are sent to shards.
BORDER = 64


# --- vocabulary -------------------------------------------------------------------------------


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that cut no run."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def runs_of(text: str) -> Counter:
    """Runs of letters with only A-Z lower-cased, and how often each occurs."""
    found: Counter = Counter()
    for piece in _pieces(text):
        found.update(RUN.findall(piece.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")))
    return found


def slipped(run: str, seed: int) -> str:
    """The run, or the run without one character when its hash says so; ``seed`` is the hash of what precedes it."""
    h = zlib.crc32(run.encode(), seed)
    return run if h % SLIP else run[: h % len(run)] + run[h % len(run) + 1 :]


def _count(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    totals: Counter = Counter()
    give = lambda: pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"])
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py()
            if not text:
                continue
            key = batch.column(0)[i].as_py()
            seed = zlib.crc32(f"{'' if key is None else key}:".encode())
            for run, n in runs_of(text).items():
                if len(run) >= shortest:
                    word = slipped(run, seed)
                    if len(word) >= shortest:
                        totals[word] += n
            if len(totals) > COUNTED:
                yield give()
                totals.clear()
    yield give()


def vocabulary(documents: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur ``fewest`` times or more in all texts."""
    rows = documents.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    counted = blocks.map_batches(rows, lambda b: _count(b, shortest), "word string, n long")
    return blocks.stored(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest), "vocabulary")


# --- search in one shard ------------------------------------------------------------------------


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, each followed by a 0, and where each word starts."""
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).astype(np.int64)
    return np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def near_pairs(words: list[str], asked: list[str], halves: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index in ``asked``, index in the sorted ``words``) one edit apart that share the first ``halves`` characters.

    A state is a word asked, a range of the list whose words share their first ``depth`` characters, and the band of the edit
    matrix's row ``depth``: edits from that beginning to the asked word's first depth - 1, depth and depth + 1 characters.
    """
    codes, starts = _codes(words)
    lcp = np.array([0, *(_common(a, b) for a, b in zip(words, words[1:]))], np.int64)
    by_lcp = np.argsort(lcp, kind="stable")
    levels = np.searchsorted(lcp[by_lcp], np.arange(int(lcp.max(initial=0)) + 2))
    far = np.int8(2)
    for first in range(0, len(asked), ASKED):
        part = asked[first : first + ASKED]
        own, own_starts = _codes(part)
        lengths = np.diff(own_starts) - 1
        half = halves[first : first + ASKED]
        lo = np.array([bisect_left(words, w[:h]) for w, h in zip(part, half)], np.int64)
        hi = np.array([bisect_right(words, w[:h] + "\U0010ffff") for w, h in zip(part, half)], np.int64)
        waiting = np.argsort(half, kind="stable")
        waiting = waiting[(lo < hi)[waiting]]
        empty = np.zeros(0, np.int64)
        ask, low, high, depth, band = empty, empty, empty, 0, np.zeros((3, 0), np.int8)
        while len(ask) or len(waiting):
            if not len(ask):
                depth = int(half[waiting[0]])
            n = int(np.searchsorted(half[waiting], depth, "right"))
            new, waiting = waiting[:n], waiting[n:]
            ask, low, high = np.concatenate([ask, new]), np.concatenate([low, lo[new]]), np.concatenate([high, hi[new]])
            begin = np.repeat(np.array([[1], [0], [1]], np.int8), n, axis=1)
            begin[2, lengths[new] == depth] = far
            band = np.hstack([band, begin])
            # a word that ends here is the first of its range
            ends = starts[low + 1] - starts[low] - 1 == depth
            off = lengths[ask] - depth + 1
            at = np.flatnonzero(ends & (off >= 0) & (off <= 2))
            hit = at[band[off[at], at] == 1]
            if len(hit):
                yield ask[hit] + first, low[hit]
            low = low + ends
            alive = low < high
            ask, low, high, band = ask[alive], low[alive], high[alive], band[:, alive]
            if not len(ask):
                continue
            # one child for each next character: it begins where the neighbours' common prefix is just this deep
            if depth + 1 < len(levels):
                cuts = np.sort(by_lcp[levels[depth] : levels[depth + 1]])
            else:
                cuts = empty
            a, b = np.searchsorted(cuts, low, "right"), np.searchsorted(cuts, high, "left")
            children = b - a + 1
            parent = np.repeat(np.arange(len(ask)), children)
            nth = np.arange(len(parent)) - np.repeat(np.cumsum(children) - children, children)
            at = a[parent] + nth
            padded = np.append(cuts, 0)
            low = np.where(nth == 0, low[parent], padded[np.minimum(at - 1, len(cuts))])
            high = np.where(nth == children[parent] - 1, high[parent], padded[np.minimum(at, len(cuts))])
            ask, band = ask[parent], band[:, parent]
            sign = codes[starts[low] + depth]
            place = own_starts[ask] + depth
            left = lengths[ask] - depth
            differ = lambda k: np.where((left > k) & (place + k >= own_starts[ask]), own[np.minimum(np.maximum(place + k, 0), len(own) - 1)] != sign, True).astype(np.int8)
            one = np.int8(1)
            below = np.minimum(band[0] + differ(-1), band[1] + one)
            same = np.minimum(np.minimum(band[1] + differ(0), band[2] + one), below + one)
            above = np.minimum(band[2] + differ(1), same + one)
            band = np.minimum(np.stack([np.where(left >= 0, below, far), np.where(left >= 1, same, far), np.where(left >= 2, above, far)]), far)
            depth += 1
            alive = band.min(0) < far
            ask, low, high, band = ask[alive], low[alive], high[alive], band[:, alive]


def _search(shard: pa.Table) -> pa.Table:
    """Per asked word of the shard: its near words there, their number and the best of them."""
    backwards = shard["backwards"][0].as_py()
    flip = (lambda w: w[::-1]) if backwards else (lambda w: w)
    asked = [flip(w) for w in shard["word"].to_pylist()]
    order = np.array(sorted(range(len(asked)), key=asked.__getitem__), np.int64)
    asked = [asked[k] for k in order]
    counts, listed = shard["n"].to_numpy()[order], np.flatnonzero(shard["listed"].to_numpy()[order])
    words = [asked[k] for k in listed]
    best: dict[int, tuple[int, str]] = {}
    found: Counter = Counter()
    for asks, hits in near_pairs(words, asked, np.array([half(w) for w in asked], np.int64)):
        for i, j in zip(asks.tolist(), hits.tolist()):
            a, b = flip(asked[i]), flip(words[j])
            # the pair belongs to the list where the edit lies behind the shorter word's first half
            if (_common(a, b) >= min(len(a), len(b)) // 2) == backwards:
                continue
            found[i] += 1
            n = int(counts[listed[j]])
            if i not in best or (-n, b) < (-best[i][0], best[i][1]):
                best[i] = (n, b)
    columns = [flip(asked[i]) for i in found], list(found.values()), [best[i][0] for i in found], [best[i][1] for i in found]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])


def half(word: str) -> int:
    """Characters that a near word shares at least, from the front or from the back."""
    return (len(word) - 1) // 2


# --- shards -------------------------------------------------------------------------------------


def _within_one(beginning: str, word: str) -> bool:
    """Whether some beginning of ``word`` is at most one edit from ``beginning``."""
    k = _common(beginning, word)
    if k == len(beginning):
        return True
    return any(word[k + a : k + a + len(rest)] == rest for a, rest in ((1, beginning[k + 1 :]), (0, beginning[k + 1 :]), (1, beginning[k:])))


def shards_of(word: str, lows: list[str], highs: list[str]) -> Iterator[int]:
    """Shards, by their first and last words, that can hold a word sharing its half and one edit away."""
    beginning = word[: min(half(word), BORDER)]
    first, last = bisect_left(highs, beginning), bisect_right(lows, beginning + "\U0010ffff")
    for k in range(first, last):
        if last - first == 1 or _within_one(lows[k][: _common(lows[k], highs[k])], word):
            yield k


def _send(batches: Iterator[pa.RecordBatch], borders: dict[bool, tuple[list[int], list[str], list[str]]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for key, n, backwards, part in zip(*(c.to_pylist() for c in batch.columns)):
            numbers, lows, highs = borders[backwards]
            word = key[::-1] if backwards else key
            to = [numbers[k] for k in shards_of(key, lows, highs)]
            for shard in to if part in to else [*to, part]:
                for values, value in zip(out, (shard, backwards, word, n, shard == part)):
                    values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.bool_()))], names=["shard", "backwards", "word", "n", "listed"])


def near_words(words: DataFrame, shard_words: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best): number of words one edit away and the best of them, by n, then code points.

    ``words`` holds (word, n); words without a near word are left out. Pairs never leave their task.
    """
    both = words.select(F.explode(F.array(F.struct(F.lit(False).alias("backwards"), F.col("word").alias("key")), F.struct(F.lit(True).alias("backwards"), F.reverse("word").alias("key")))).alias("at"), "n")
    rows = both.select("at.key", "n", "at.backwards")
    parts = int(max(2 * words.count() // shard_words + 1, 2))
    part = F.spark_partition_id().cast("long")
    # the list of the words and the list of the reversed words never share a shard
    lists = materialise(rows.repartitionByRange(parts, "backwards", "key").withColumn("part", part * 2 + F.col("backwards").cast("long")))
    edges = lists.groupBy("part", "backwards").agg(F.substring(F.min("key"), 1, BORDER).alias("low"), F.substring(F.max("key"), 1, BORDER).alias("high"))
    borders: dict[bool, tuple[list[int], list[str], list[str]]] = {False: ([], [], []), True: ([], [], [])}
    for edge in sorted(edges.collect(), key=lambda e: e["low"]):
        for values, value in zip(borders[edge["backwards"]], (edge["part"], edge["low"], edge["high"])):
            values.append(value)
    sent = blocks.map_batches(lists, lambda b: _send(b, borders), "shard long, backwards boolean, word string, n long, listed boolean")
    found = sent.groupBy("shard").applyInArrow(_search, "word string, n_near long, best_n long, best string")
    # the most frequent comes first, then the smallest word: a minimum over (-n, word)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


# --- forms and roots ----------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) lead in the end. Chains halve in each round, and have no cycles.

    A form's words are all one edit away, so their number is bounded by its length and the alphabet.
    """
    links = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = step.drop("moved")
        if step.filter("moved").isEmpty():
            return links


def variants(documents: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST, shard_words: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    A word's form is its most frequent near word if that occurs at least twice as often; the root is where forms lead.
    """
    words = vocabulary(documents, key, text, shortest, fewest)
    near = words.join(near_words(words, shard_words), "word", "left")
    is_form = F.col("best_n") >= 2 * F.col("n")
    judged = blocks.stored(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    led = judged.join(roots(judged.filter("form is not null")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
