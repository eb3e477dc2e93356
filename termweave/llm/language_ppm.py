"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to three bytes with the counts of what followed each context. A byte costs
-log2 of its share among (n followers + d distinct ones); a byte not seen after a context costs the escape d / (n + d)
and is coded in the next shorter one, down to 8 bits for any byte. The counts are frozen
after fitting, so the code length of a text under each language is exact and independent of other texts.
The language with the shortest code wins, of equally short ones the first by name; the score is its posterior among
the languages.

Fitting takes a bounded sample: the distinct texts of each language in the order of a hash, until ``TRAIN_BYTES`` are
reached, which bounds the trees (at most one entry for each byte). A language has at least one text, and of a text
longer than that the first ``TRAIN_BYTES`` characters are learned. Every text is scored whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text if no
language was learned; a null lang is not learned from; a null doc_id is never held out; repeated rows are
judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from termweave.llm import textbytes as tb
from termweave.llm.blocks import map_batches

TRAIN_BYTES = 600_000
#: Steps of the sample's size for each doubling.
FINENESS = 16
#: Bytes of text that a worker hands back together.
TOGETHER = 4 << 20
ORDER = 3
UNKNOWN = "und"

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True
_compiled: dict[bytes, Compiled] = {}


@dataclass(frozen=True)
class Trees:
    """Counts by language: ``grams`` packs three context bytes and the byte that followed (0 before a text)."""

    languages: tuple[str, ...]
    grams: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]
    digest: bytes


def _gram_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte of the texts the three before it and itself, as one number."""
    back = [data.astype(np.uint32)]
    for k in range(1, ORDER + 1):
        shifted = np.zeros(len(data), np.uint32)
        shifted[k:] = data[: len(data) - k] if len(data) > k else data[:0]
        for j in range(k):
            at = offsets[:-1] + j
            shifted[at[at < offsets[1:]]] = 0
        back.append(shifted)
    out = back[0]
    for k in range(1, ORDER + 1):
        out |= back[k] << np.uint32(8 * k)
    return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            data, offsets = tb.columns(batch.column(1).filter(pa.array(langs == lang)))
            grams, n = np.unique(_gram_keys(data, offsets), return_counts=True)
            columns = [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])


def fit(labelled: DataFrame, train_bytes: int = TRAIN_BYTES, text: str = "text", lang: str = "lang") -> Trees:
    """Context trees of each value of ``lang``, from about ``train_bytes`` of text for each."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang is not null and text is not null and text <> ''")
    rows = rows.withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 1))
    # Steps in the logarithm of the hash: few of them, and the last one taken adds little at any size of the input.
    rows = rows.withColumn("step", F.floor(F.log2(F.col("hash") + F.lit(1.0)) * FINENESS).cast("int"))
    size = F.least(F.octet_length("text"), F.lit(train_bytes))
    steps = rows.groupBy("lang", "hash", "step").agg(F.max(size).alias("n")).groupBy("lang", "step").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("step")) - F.col("n")
    taken = steps.withColumn("before", before).filter(F.col("before") < train_bytes).groupBy("lang").agg(F.max("step").alias("last"))
    last = {r["lang"]: r["last"] for r in taken.collect()}
    if not last:
        return Trees((), (), (), b"")
    limit = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    chosen = rows.filter(F.col("step") <= limit[F.col("lang")]).select("lang", "hash", F.substring("text", 1, train_bytes).alias("text"))
    sample = chosen.groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")
    counted = map_batches(sample, _count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names, grams, counts = [], [], []
    for name, part in counted.groupby("lang"):
        part = part.sort_values("gram")
        names.append(str(name))
        grams.append(part["gram"].to_numpy(np.int64))
        counts.append(part["n"].to_numpy(np.int64))
    import hashlib

    digest = hashlib.sha256("\0".join(names).encode() + b"".join(g.tobytes() + c.tobytes() for g, c in zip(grams, counts))).digest()
    return Trees(tuple(names), tuple(grams), tuple(counts), digest)


class Compiled:
    """Code lengths as one table: row = longest context that any tree has, then byte class, then language."""

    def __init__(self, trees: Trees):
        seen = np.unique(np.concatenate([np.unique((g >> s) & 255) for g in trees.grams for s in (0, 8, 16, 24)]))
        seen = seen[seen > 0]
        self.width = width = len(seen) + 2
        self.byte_class = np.zeros(256, np.int64)  # class 0: bytes that no tree has; class 1: before the text
        self.byte_class[seen] = np.arange(2, width)
        trained = self.byte_class.copy()
        trained[0] = 1
        split = [[trained[(g >> s) & 255] for s in (24, 16, 8, 0)] for g in trees.grams]
        contexts = [np.unique(np.concatenate([self._code(x[ORDER - k : ORDER]) for x in split])) for k in range(ORDER + 1)]
        first = np.cumsum([0, *(len(c) for c in contexts)])
        self.costs = np.empty((int(first[-1]) * width, len(trees.grams)), np.float32)
        for i, (parts, counts) in enumerate(zip(split, trees.counts)):
            below = np.full((1, width), 8.0)
            for k in range(ORDER + 1):
                parent = self._row(contexts[k - 1], contexts[k] % width ** (k - 1)) if k else np.zeros(1, np.int64)
                below = self._level(self._row(contexts[k], self._code(parts[ORDER - k : ORDER])), parts[ORDER], counts, below[parent])
                self.costs[first[k] * width : first[k + 1] * width, i] = below.ravel()
        self.rows = np.zeros(width**ORDER, np.int32)
        for low in range(0, len(self.rows), tb.SLICE):
            rows = self.rows[low : low + tb.SLICE]
            every = np.arange(low, low + len(rows))
            for k in range(1, ORDER + 1):
                tail = every % width**k
                at = np.minimum(np.searchsorted(contexts[k], tail), len(contexts[k]) - 1)
                known = contexts[k][at] == tail
                rows[known] = first[k] + at[known]

    def _code(self, parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for p in parts:
            out = out * self.width + p
        return out

    @staticmethod
    def _row(contexts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return np.searchsorted(contexts, wanted)

    def _level(self, row: np.ndarray, symbol: np.ndarray, counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        n_rows = len(shorter)
        table = np.zeros(n_rows * self.width)
        np.add.at(table, np.broadcast_to(row, symbol.shape) * self.width + symbol, counts)
        table = table.reshape(n_rows, self.width)
        table[:, :2] = 0  # neither class is ever coded as such
        total, distinct = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            coded = np.where(table > 0, np.log2((total + distinct) / table), np.log2((total + distinct) / distinct) + shorter)
        return np.where(distinct > 0, coded, shorter)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, self.costs.shape[1]))
        width = self.width
        for low in range(0, len(data), tb.SLICE):
            high = min(low + tb.SLICE, len(data))
            codes = self.byte_class[data[max(low - ORDER, 0) : high]]
            codes = np.concatenate([np.ones(max(ORDER - low, 0), np.int64), codes])
            first = int(np.searchsorted(offsets, low, "right")) - 1
            last = int(np.searchsorted(offsets, high, "left"))
            begins, ends = offsets[first:last], offsets[first + 1 : last + 1]
            n = high - low
            at = np.zeros(n, np.int64)
            for k in range(ORDER, 0, -1):
                part = codes[ORDER - k : ORDER - k + n].copy()
                for j in range(k):
                    spot = begins + j
                    part[spot[(spot >= low) & (spot < np.minimum(ends, high))] - low] = 1
                at = at * width + part
            costs = self.costs[self.rows[at].astype(np.int64) * width + codes[ORDER:]]
            some = np.flatnonzero((ends > begins) & (ends > low))
            cuts = np.maximum(begins[some] - low, 0)
            if len(some):
                out[first + some] += np.add.reduceat(costs, cuts, axis=0)
        return out


def compiled(trees: Trees) -> Compiled:
    """A worker compiles a model once."""
    if trees.digest not in _compiled:
        _compiled.clear()
        _compiled[trees.digest] = Compiled(trees)
    return _compiled[trees.digest]


def has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(np.searchsorted(offsets, np.flatnonzero(_letter[data]), "right") - 1, minlength=len(offsets) - 1), out=found[1:])
    out = np.diff(found) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
    return out


def _predict(batches: Iterator[pa.RecordBatch], model, column: int, carried: bool) -> Iterator[pa.RecordBatch]:
    """The batches with the prediction, in parts of some bytes; the column of texts goes back only if ``carried``."""
    trees = model.value
    for whole in batches:
        for i, j in tb.pieces(tb.columns(whole.column(column))[1], TOGETHER):
            batch = whole.slice(i, j - i)
            data, offsets = tb.columns(batch.column(column))
            names = np.full(len(offsets) - 1, UNKNOWN, object)
            score, per_byte = np.zeros(len(names)), np.zeros(len(names))
            if trees.languages:
                bits = compiled(trees).bits(data, offsets)
                best = bits.argmin(1)
                least = bits[np.arange(len(best)), best]
                known = has_letter(batch.column(column), data, offsets)
                names[known] = np.array(trees.languages, object)[best[known]]
                score[known] = (1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1))[known]
                per_byte[known] = (least / np.maximum(np.diff(offsets), 1))[known]
            added = {"lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(score), "bits_per_byte": pa.array(per_byte)}
            kept = [k for k in range(batch.num_columns) if k != column or carried]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + list(added.values()), names=[batch.schema.names[k] for k in kept] + list(added))


def predict(documents: DataFrame, trees: Trees, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``bits_per_byte`` of each row. Name ``text`` in ``keep`` to carry it on."""
    model = documents.sparkSession.sparkContext.broadcast(trees)
    rows = documents.select(*[F.col(c) for c in keep])
    carried = text in keep and rows.schema[text].dataType == StringType()
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields) + "lang_pred string, score double, bits_per_byte double"
    if not carried:
        rows = documents.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("_text"))
    column = keep.index(text) if carried else len(keep)
    return map_batches(rows, lambda batches: _predict(batches, model, column, carried), schema)


def held_out(key: Column, folds: int, remainder: int) -> Column:
    """Whether crc32 of the key's text leaves ``remainder``; never for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == remainder, F.lit(False))


def identify(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Learn from the documents that are not held out (crc32 of doc_id modulo 5 is not 0), predict all."""
    hold = held_out(F.col("doc_id"), 5, 0)
    trees = fit(documents.filter(~hold), train_bytes)
    out = predict(documents, trees, keep)
    return out.withColumn("held_out", hold) if "doc_id" in keep else out
