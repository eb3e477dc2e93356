"""Near-duplicate documents by MinHash, odd sketches and exact confirmation.

A document's set is its distinct word shingles as 64-bit hashes. Documents with equal sets are one class. Each
class takes MinHash samples; bands of four samples file it in buckets, with so many bands that a pair at the
threshold meets in none with a chance below one in a million. The samples, folded by parity into a bitmap
of 512 bits, form the odd sketch: the number of differing bits between two bitmaps estimates how many samples differ, and
candidates far beyond what the threshold allows are dropped. The rest are confirmed on the full sets.

Not all pairs in a bucket are tried. First every member is tried with the bucket's hub, the class that meets the most
others in all its buckets; the links form components; then only pairs in different components are tried, since a link inside a component cannot change it.
Such a pair (a, b) has a member, say a, that is not linked to the hub h. It can only be linked if the differences
a xor h and b xor h have enough shingles in common: more than (|b xor h| + c (|h| - |b|)) / 2 and at least
|a xor h| - c |a| (1 + 1 / t), with c = (1 - t) / (1 + t) at the threshold t. So pairs are looked up by the rarest
shingles of the differences, as few as these bounds allow. Near copies differ from the hub in shingles of their own, so
this loses no link that matters to the components and keeps a bucket of many near copies linear.

Defined results: a text without words, or null, has an empty set and is linked with nothing, also not with its
like; fewer words than a shingle form one shingle; a null doc_id is its own component; rows that
repeat a doc_id belong to one component; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import textbytes as tb
from termweave.llm.blocks import map_batches, stored
from termweave.runtime import materialise

ROWS = 4
MISS = 1e-6
SKETCH_BITS = 512
WORDS = SKETCH_BITS // 64


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that a pair at the threshold misses altogether with a chance below ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def differing_bits_allowed(threshold: float, samples: int) -> int:
    """Differing bits that a pair at the threshold exceeds with a chance of about one in a billion."""
    mean = samples * (1 - threshold)
    unequal = min(mean + 6 * math.sqrt(mean * threshold), samples)
    bits = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * unequal))
    return math.ceil(bits + 4 * math.sqrt(bits / 2))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text; all words as one where there are fewer than ``size``."""
    hashes, _, _, counts = tb.word_hashes(data, offsets)
    rolled = hashes.copy() if len(hashes) else hashes
    with np.errstate(over="ignore"):
        for k in range(1, size):
            rolled = tb.mix(rolled[: len(hashes) - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]) if len(hashes) > k else rolled[:0]
    ends = np.cumsum(counts)
    out = []
    for end, n in zip(ends, counts):
        first = end - n
        if n >= size:
            out.append(np.unique(rolled[first : end - size + 1]))
        elif n:
            h = hashes[first : first + 1]
            for k in range(first + 1, end):
                h = tb.mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + 1])
            out.append(tb.mix(h ^ np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _multipliers(samples: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_samples(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """MinHash samples of each set, one row for each; the sets are not empty."""
    data = np.concatenate(sets)
    begin = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), samples), np.uint64)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(_multipliers(samples)):
            scrambled = data * factor
            scrambled ^= scrambled >> np.uint64(29)
            out[:, k] = np.minimum.reduceat(scrambled * np.uint64(0x9FB21C651E98DF25), begin)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps, as rows of 64-bit words."""
    n, k = samples.shape
    with np.errstate(over="ignore"):
        at = tb.mix(samples + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    bits = np.zeros((n, SKETCH_BITS), np.uint8)
    for column in at.T:
        bits[np.arange(n), column.astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1).view(np.int64).reshape(n, WORDS)


def _band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    n, k = samples.shape
    keys = np.zeros((n, k // rows), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = tb.mix(keys * np.uint64(0x9E3779B97F4A7C15) + samples[:, r::rows])
        keys += np.arange(k // rows, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return tb.mix(keys).view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.int64()))


def _signatures(batches: Iterator[pa.RecordBatch], size: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tb.columns(batch.column(1))
        for i, j in tb.pieces(offsets, 2 * tb.SLICE):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            some = [k for k, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), bands), np.int64)
            sketches = np.zeros((len(sets), WORDS), np.int64)
            label = np.zeros(len(sets), np.int64)
            if some:
                samples = min_samples([sets[k] for k in some], bands * ROWS)
                keys[some], sketches[some] = _band_keys(samples, ROWS), odd_sketches(samples)
                with np.errstate(over="ignore"):
                    label[some] = np.array([tb.mix(np.array([s.sum() ^ np.uint64(len(s))]))[0] ^ tb.mix(np.array([np.bitwise_xor.reduce(s)]))[0] for s in (sets[k] for k in some)], np.uint64).view(np.int64)
            arrays = [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(label), _lists(keys), _lists(sketches)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "class_hash", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tb.columns(batch.column(1))
        for i, j in tb.pieces(offsets, 2 * tb.SLICE):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough. A class in very many pairs is split by the skew join."""
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return map_batches(joined, lambda batches: _confirm(batches, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in a link (a, b): the smallest id reachable.

    Each round links every node's larger neighbours to its smallest one, then every node to it, until nothing changes.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Larger neighbours go to the smallest node around.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # Smaller neighbours and the node itself go to its smallest neighbour.
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now


def _difference_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each (hub, id, component, shingles, hub's shingles): what differs, and how many of it ask and answer."""
    t = percent / 100
    c, safe = (1 - t) / (1 + t), 1e-6
    for batch in batches:
        asks, answers, lengths, differ = [], [], [], []
        for a, h in zip(batch.column(3), batch.column(4)):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(h.as_buffer(), np.uint64)
            d = np.setxor1d(x, y, assume_unique=True)
            common = (len(x) + len(y) - len(d)) // 2
            linked = 100 * common >= percent * (len(x) + len(y) - common)
            least = max(1, math.ceil(len(d) - c * len(x) * (1 + 1 / t) - safe))
            asks.append(0 if linked else len(d) - least + 1)
            answers.append(len(d) - math.floor((len(d) + c * (len(y) - len(x))) / 2 - safe))
            lengths.append(len(x))
            differ.append(d.view(np.int64))
        ends = np.cumsum([0, *(len(d) for d in differ)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(differ) if differ else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(asks, pa.int32()), pa.array(answers, pa.int32()), pa.array(lengths, pa.int32()), lists], names=["hub", "id", "component", "asks", "answers", "length", "differ"])


def pairs_by_difference(spokes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one hub and different components that may be linked. ``spokes``: hub, id, component, distinct."""
    joined = spokes.join(sets.select("id", F.col("shingles").alias("x")), "id").join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("y")), "hub")
    fields = "hub long, id long, component long, asks int, answers int, length int, differ array<long>"
    differences = map_batches(joined.select("hub", "id", "component", "x", "y"), lambda batches: _difference_rows(batches, percent), fields)
    differences = materialise(differences.filter("asks > 0 or answers > 0"))
    tokens = differences.select("hub", "id", F.explode("differ").alias("token"))
    common = tokens.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Shingles of one member only come first in the order and meet nobody.
    ranked = tokens.join(common, ["hub", "token"]).groupBy("hub", "id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("shared"))
    sizes = differences.select("hub", "id", "component", "asks", "answers", "length", F.size("differ").alias("size"))
    placed = ranked.join(sizes, ["hub", "id"]).select("*", F.posexplode("shared").alias("pos", "one"))
    place = F.col("size") - F.size("shared") + F.col("pos")
    # ``left``: shingles from here to the end of the order, this one included.
    placed = placed.select(
        "hub", F.col("one.token").alias("token"), "id", "component", "size", "length", (F.col("size") - place).alias("left"), (place < F.col("asks")).alias("asks"), (place < F.col("answers")).alias("answers")
    )
    placed = materialise(placed.filter("asks or answers"))
    names = ("id", "component", "size", "length", "left")
    one = placed.filter("asks").select("hub", "token", *[F.col(n).alias(f"{n}_a") for n in names])
    other = placed.filter("answers").select("hub", "token", *[F.col(n).alias(f"{n}_b") for n in names])
    # At the first common shingle of a linked pair, enough shingles are left on both sides.
    c = (100 - percent) / (100 + percent)
    needed = (F.col("size_a") + F.col("size_b") - c * (F.col("length_a") + F.col("length_b"))) / 2 - 1e-6
    enough = (F.col("component_a") != F.col("component_b")) & (F.least("left_a", "left_b") >= needed)
    found = one.join(other, (one["hub"] == other["hub"]) & (one["token"] == other["token"]) & enough)
    found = found.select(F.col("id_a").alias("i"), F.col("id_b").alias("j"))
    return found.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def _different_bits(a: str, b: str):
    return F.expr(" + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(WORDS)))


def near_duplicates(documents: DataFrame, size: int = 3, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and ``kept`` (the smallest of its component) of each row."""
    bands = bands_for(percent / 100)
    allowed = differing_bits_allowed(percent / 100, bands * ROWS)
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = "doc_id long, n_shingles long, class_hash long, bands array<long>, sketch array<long>"
    signatures = stored(map_batches(rows, lambda batches: _signatures(batches, size, bands), signed), "signatures")
    some = signatures.filter("n_shingles > 0 and doc_id is not null")
    # One class for equal sets; a row that repeats a doc_id ties its classes together below.
    classes = stored(some.groupBy("n_shingles", "class_hash").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch")), "classes")
    filed = classes.select("id", F.explode("bands").alias("bucket"))
    crowded = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    filed = materialise(filed.join(crowded, "bucket").select("bucket", "id", "n"))
    # The text that a group was copied from meets the most others; as hub it links most of the group at once.
    met = filed.groupBy("id").agg(F.sum("n").alias("met"))
    hubs = filed.join(met, "id").groupBy("bucket").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("hub"))
    members = materialise(filed.join(hubs, "bucket").select("bucket", "id", "hub"))
    left = classes.select(F.col("id").alias("a"), F.col("sketch").alias("x"))
    right = classes.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
    alike = _different_bits("x", "y") <= allowed
    star = members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    star = materialise(star.join(left, "a").join(right, "b").filter(alike).select("a", "b"))
    sets = _candidate_sets(rows, star, size)
    links = materialise(confirmed(star, sets, percent))
    joined = components(links)
    labelled = members.join(joined, "id", "left")
    labelled = materialise(labelled.select("bucket", "id", "hub", F.coalesce("component", "id").alias("component")))
    split = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    spokes = materialise(labelled.join(split, "bucket").select("hub", "id", "component").distinct())
    across = materialise(pairs_by_difference(spokes, _candidate_sets(rows, spokes.select(F.col("hub").alias("a"), F.col("id").alias("b")), size), percent))
    across = across.join(left, "a").join(right, "b").filter(alike).select("a", "b")
    across = materialise(across.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    more = confirmed(across, _candidate_sets(rows, across, size), percent)
    same = some.join(classes.select("n_shingles", "class_hash", "id"), ["n_shingles", "class_hash"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    final = components(links.union(more).union(same.filter("a <> b")))
    out = signatures.select("doc_id", "n_shingles").join(final, signatures["doc_id"] == final["id"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _candidate_sets(rows: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Full sets of the classes in some pair, computed anew from their texts."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    found = rows.filter("doc_id is not null").join(wanted, "doc_id", "left_semi")
    return stored(map_batches(found, lambda batches: _sets(batches, size), "id long, shingles binary"), "sets")
