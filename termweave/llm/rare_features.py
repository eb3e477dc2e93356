"""Document fingerprints from improbable byte features.

A feature is a window of 64 bytes. Its entropy, in thousandths, is ranked by how rarely that entropy occurs
among all windows of the corpus. Of each 64 windows in a row the rarest (leftmost on ties) scores a point; windows with
16 points or more are the text's features. Their hashes set five bits each in Bloom filters of 2048 bits, and after 160
features a further filter is chained on. Two fingerprints are compared filter by filter: the overlap of the
bits beyond chance, as a share of the most that is possible; for each filter of the shorter chain the best
counterpart counts, weighted by its bits.

Defined results: a null text is empty and has an empty fingerprint; two empty fingerprints have likeness 1,
an empty and another one 0; a text without a scoring window has one feature, the whole text; equal texts have equal
fingerprints; with one document, the next document is itself; equal doc_ids follow each other in
order of their text, null ids come last; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import textbytes as tb
from termweave.llm.blocks import map_batches, stored
from termweave.runtime import small_table

WINDOW = 64
LEVELS = 1001
#: Entropies (in thousandths) outside these bounds say too little about a text.
LOWEST, HIGHEST = 100, 990
RIVALS, POINTS = 64, 16
#: A text with fewer features than this takes every window with a point.
ENOUGH = 8
FILTER_BITS, PER_FILTER, SUB_HASHES = 2048, 160, 5
_CHUNK = 1 << 16

_c = np.arange(WINDOW + 1)
_weight = np.round(np.where(_c > 0, _c * np.log2(np.maximum(_c, 1)), 0) * 65536).astype(np.int64)
_step = np.diff(_weight).astype(np.int32)


def _equal_near(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, how many of the 63 before and of the 63 after are equal to it."""
    n, reach = len(data), WINDOW - 1
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for low in range(0, n, _CHUNK):
        high = min(low + _CHUNK, n)
        a, b = max(low - reach, 0), min(high + reach, n)
        part = data[a:b]
        left, right = np.zeros(b - a, np.uint8), np.zeros(b - a, np.uint8)
        for d in range(1, min(reach, b - a - 1) + 1):
            same = (part[d:] == part[:-d]).view(np.uint8)
            left[d:] += same
            right[:-d] += same
        before[low:high] = left[low - a : high - a]
        after[low:high] = right[low - a : high - a]
    return before, after


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy in thousandths of the window at each byte that starts one."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    before, after = _equal_near(data)
    sums = np.empty(n, np.int64)
    sums[0] = _weight[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(_step[before[WINDOW:]] - _step[after[: n - 1]], out=sums[1:], dtype=np.int64)
    sums[1:] += sums[0]
    most = int(_weight[WINDOW])
    return (most - sums) * (LEVELS - 1) // most


def _own_windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes of the windows that lie inside one text, and how many each text has."""
    counts = np.maximum(np.diff(offsets) - (WINDOW - 1), 0)
    first = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    return first + np.arange(len(first)), counts


def _count_entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS, np.int64)
    for batch in batches:
        data, offsets = tb.columns(batch.column(0))
        for i, j in tb.pieces(offsets, tb.SLICE):
            part = offsets[i : j + 1] - offsets[i]
            levels = entropies(data[offsets[i] : offsets[j]])
            total += np.bincount(levels[_own_windows(part)[0]], minlength=LEVELS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], names=["level", "n"])


def entropy_ranks(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy level by its count over the whole corpus, rarest first; at most 1001 rows are collected."""
    rows = map_batches(documents.select(F.col(text).cast("string")), _count_entropies, "level long, n long")
    counts = np.zeros(LEVELS, np.int64)
    for r in rows.groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r["level"]] = r["n"]
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.lexsort([np.arange(LEVELS), counts])] = np.arange(LEVELS)
    ranks[:LOWEST] = LEVELS
    ranks[HIGHEST + 1 :] = LEVELS
    return ranks


def _selected(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and text of each selected window."""
    at, counts = _own_windows(offsets)
    if not len(at):
        return at, at
    keys = (ranks[entropies(data)[at]] << 40) | np.arange(len(at))
    least = tb.sliding_min(keys, RIVALS)
    ends = np.cumsum(counts)
    own = np.repeat(ends, counts)[: len(least)] - np.arange(len(least)) >= RIVALS
    winners = least[own] & ((1 << 40) - 1)
    few = np.flatnonzero((counts > 0) & (counts < RIVALS))
    # Winners come in ascending order, so equal ones are neighbours.
    change = np.flatnonzero(np.diff(winners, prepend=-1))
    best, points = winners[change], np.diff(np.append(change, len(winners)))
    owner = np.searchsorted(ends, best, "right")
    strong = np.bincount(owner[points >= POINTS], minlength=len(counts))
    taken = best[(points >= POINTS) | (strong[owner] < ENOUGH)]
    if len(few):
        spans = np.stack([ends[few] - counts[few], ends[few]], 1).ravel()
        # One closing key, since reduceat does not take the end of the array as a border.
        single = np.minimum.reduceat(np.append(keys, np.int64(2**62)), spans)[::2] & ((1 << 40) - 1)
        taken = np.sort(np.concatenate([taken, single]))
    taken = taken[keys[taken] >> 40 < LEVELS]
    return at[taken], np.searchsorted(ends, taken, "right")


def _window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    if len(at):
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]).view(np.uint64)
        for k in range(words.shape[1]):
            h = tb.mix(h ^ words[:, k]) + np.uint64(0x9E3779B97F4A7C15)
    return h


def fingerprints(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The chained filters (rows of 256 bytes) of each text."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    at, owner = _selected(data, offsets, ranks)
    hashes = _window_hashes(data, at)
    plain = np.setdiff1d(np.flatnonzero(np.diff(offsets)), owner)
    whole = [int.from_bytes(hashlib.sha256(texts[i]).digest()[:8], "little") for i in plain]
    owner = np.concatenate([owner, plain])
    hashes = np.concatenate([hashes, np.array(whole, np.uint64)])
    order = np.lexsort([np.arange(len(hashes)), hashes, owner])
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    kept = np.sort(order[new])
    kept = kept[np.argsort(owner[kept], kind="stable")]
    owner, hashes = owner[kept], hashes[kept]
    begin = np.searchsorted(owner, np.arange(len(texts)))
    number = np.diff(np.append(begin, len(owner)))
    filters = -(-number // PER_FILTER)
    first = np.cumsum(filters) - filters
    slot = first[owner] + (np.arange(len(owner)) - begin[owner]) // PER_FILTER
    bits = np.zeros(int(filters.sum()) * FILTER_BITS, np.uint8)
    for k in range(SUB_HASHES):
        bits[slot * FILTER_BITS + ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits).reshape(-1, FILTER_BITS // 8)
    return [packed[a : a + n] for a, n in zip(first, filters)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: overlap of bits beyond chance, averaged over the shorter chain's filters."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    n_a, n_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    total = 0.0
    for row, n in zip(a, n_a):
        common = np.bitwise_count(b & row).sum(1, dtype=np.int64)
        chance = n * n_b / FILTER_BITS
        most = np.minimum(n, n_b)
        total += n * float(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / float(n_a.sum())


def as_text(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, FILTER_BITS // 8)


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_DONE, _HEAD, _TAIL = 0, 1, 2
_SIDED = f"kind int, part int, {_OUT}, text string"


def _compared(pairs: list[tuple], ranks: np.ndarray) -> list[tuple]:
    """Output rows of (id, text, filters, next text, next filters)."""
    changed = [edited(p[1], p[3]).encode() for p in pairs]
    out = []
    for (key, text, own, _, following), new, raw in zip(pairs, fingerprints(changed, ranks), changed):
        out.append((key, len(text), hashlib.sha256(raw).hexdigest(), as_text(own), as_text(new), likeness(own, new), likeness(own, following)))
    return out


def _batch(rows: list[tuple], kinds: list[str]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    names, kinds = zip(*(k.split() for k in kinds))
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds)], names=list(names))


def _neighbours(batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Compares each row of a sorted partition with the next; first and last row are left for their outer neighbours."""
    part = TaskContext.get().partitionId()
    schema = _SIDED.split(", ")
    blank = (None,) * 5
    before = None
    for batch in batches:
        offsets = tb.columns(batch.column(1))[1]
        for i, j in tb.pieces(offsets, tb.SLICE):
            keys = batch.column(0).slice(i, j - i).to_pylist()
            texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
            here = list(zip(keys, texts, fingerprints([t.encode() for t in texts], ranks)))
            if before is None:
                yield _batch([(_HEAD, part, keys[0], None, *blank, texts[0])], schema)
            line = [before, *here] if before else here
            pairs = [(*a, b[1], b[2]) for a, b in zip(line, line[1:])]
            yield _batch([(_DONE, part, *r, None) for r in _compared(pairs, ranks)], schema)
            before = here[-1]
    if before:
        yield _batch([(_TAIL, part, before[0], None, *blank, before[1])], schema)


def _outer(batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text, following in zip(*(c.to_pylist() for c in batch.columns)):
            own, other = fingerprints([text.encode(), following.encode()], ranks)
            yield _batch(_compared([(key, text, own, following, other)], ranks), _OUT.split(", "))


def compare_with_next(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness, next meaning by descending key.

    Rows are range-partitioned and sorted, so neighbours meet in one task; only a partition's last row is joined
    with the next partition's first one, two rows for each partition.
    """
    spark = documents.sparkSession
    ranks = entropy_ranks(documents, text)
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    line = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order, "text")
    sided = stored(map_batches(line, lambda batches: _neighbours(batches, ranks), _SIDED), "fingerprints")
    parts = sorted(r["part"] for r in sided.filter(F.col("kind") == _TAIL).select("part").collect())
    following = small_table(spark, list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    heads = sided.filter(F.col("kind") == _HEAD).select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    tails = sided.filter(F.col("kind") == _TAIL).join(following, "part").join(heads, "next_part").select("doc_id", "text", "next_text")
    names = [c.split()[0] for c in _OUT.split(", ")]
    return sided.filter(F.col("kind") == _DONE).select(*names).unionByName(map_batches(tails, lambda batches: _outer(batches, ranks), _OUT))
