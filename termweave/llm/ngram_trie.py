"""Language-model scores from an n-gram trie in Elias-Fano levels.

The corpus is counted in shards. A shard holds the bigrams of some contexts as a trie: contexts ascending,
monotone pointers to their successors, and the successors relative to their context (context number, then successor), which
makes them one ascending sequence; all three are Elias-Fano coded, with two bytes for each smoothed log probability (in
steps of 1/4096 of log10, rounded down: no probability is above 1, nor is the sum of a context's successors). A shard is written to a file
and memory-mapped; a bigram is found by a successor search within its context. Contexts are salted by the successor, with one salt
for each ``SALT_COUNT`` sightings, so no shard holds a whole hot context.

Blocks of documents first ask for the corpus counts of their distinct words. Then they send their distinct bigrams with their own training
counts and the corpus counts of both words, and get the probabilities back, so that a document's score needs no table of the whole
vocabulary. A word's probability is (c + 1) / (N + V + 1); after a context seen n times it is (c2 + weight * that) / (n + weight).

Words and contexts stand as 64- and 48-bit hashes, successors as 40 bits within a context.

Defined results: a null or empty text is one token, its end; a null doc_id is never held out; repeated rows
count as often as they occur; without training text every probability falls back to 1 / (N + V + 1); other
columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import blocks as bl
from termweave.llm import textbytes as tb

#: How many sightings of a context the word's own probability weighs.
WEIGHT = 200.0
#: Sightings of a context for each of its salts; a context has no more distinct successors than sightings.
SALT_COUNT = 1 << 16
SHARD_BYTES = 6 << 20
FOLDS, HELD_OUT = 7, 2
_CONTEXT_BITS, _SUCCESSOR_BITS = 48, 40
_END = np.uint64(0xE0D0E0D0E0D0E0D1)
_START = np.uint64(0x57A2757A2757A271)

#: Codes for each unit of log10; code 0 stands for a bigram that was not seen.
_CODES = 4096

#: Place of the k-th zero bit of each byte.
_zero_places = np.argsort(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1, kind="stable")


def quantised(probabilities: np.ndarray) -> np.ndarray:
    """Two bytes for each log probability, rounded down."""
    return np.clip(np.ceil(-_CODES * np.log10(probabilities)) + 1, 1, 65535).astype(np.uint16)


def probabilities(codes: np.ndarray) -> np.ndarray:
    return 10 ** ((1.0 - codes) / _CODES)


class EliasFano:
    """An ascending sequence: low bits packed, high bits in unary with a directory of zeros."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max((universe // max(n, 1)).bit_length() - 1, 0)
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            part = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = n + (universe >> low_bits) + 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype(np.uint32)
        return cls(n, low_bits, low, high, zeros)

    def low_of(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.uint64)
        at = index.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | rest) & np.uint64((1 << self.low_bits) - 1)

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 1 << 15):
            part = k[a : a + (1 << 15)]
            word = np.searchsorted(self.zeros, part, "right") - 1
            octets = np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8)
            until = np.cumsum(8 - np.bitwise_count(octets), axis=1, dtype=np.uint8)
            wanted = (part - self.zeros[word]).astype(np.uint8)
            octet = (until > wanted[:, None]).argmax(1)
            line = np.arange(len(part))
            before = np.where(octet > 0, until[line, octet - 1], 0)
            out[a : a + (1 << 15)] = word * 64 + octet * 8 + _zero_places[octets[line, octet], wanted - before]
        return out

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        out[some] = self._select_zero(high[some] - 1) + 1 - high[some]
        return out

    def _search(self, at: np.ndarray, end: np.ndarray, low: np.ndarray) -> np.ndarray:
        """First index in at..end whose low part is not smaller: low parts ascend where the high part is the same."""
        end = end.copy()
        going = np.flatnonzero(at < end)
        while len(going):
            middle = (at[going] + end[going]) >> 1
            less = self.low_of(middle) < low[going]
            at[going[less]] = middle[less] + 1
            end[going[~less]] = middle[~less]
            going = going[at[going] < end[going]]
        return at

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """Index of the first value that is not smaller (n where there is none)."""
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        low = wanted & np.uint64((1 << self.low_bits) - 1)
        return self._search(self._below(high), self._below(high + 1), low)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where the sequence has none."""
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        low = wanted & np.uint64((1 << self.low_bits) - 1)
        at = self._below(high)
        # Values with this high part are the ones that follow in unary, counted in a window of 64 bits.
        bit = at + high
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        after = self.high[np.minimum(word + 1, len(self.high) - 1)]
        window = (self.high[word] >> shift) | np.where(shift > 0, after << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        run = np.bitwise_count((~window & (window + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        end = at + run
        full = np.flatnonzero(run >= 64)
        if len(full):
            end[full] = self._below(high[full] + 1)
        end = np.minimum(end, self.n)
        at = self._search(at, end, low)
        hit = at < end
        hit[hit] = self.low_of(at[hit]) == low[hit]
        return np.where(hit, at, -1)

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at ascending or any indexes."""
        ones = np.cumsum(64 - np.diff(self.zeros.astype(np.int64)))
        word = np.searchsorted(ones, index, "right")
        before = np.where(word > 0, ones[np.maximum(word - 1, 0)], 0)
        bits = np.unpackbits(self.high[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        nth = (np.cumsum(bits, axis=1, dtype=np.uint8) == (index - before + 1)[:, None]).argmax(1)
        return ((word * 64 + nth - index).astype(np.uint64) << np.uint64(self.low_bits)) | self.low_of(index)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.zeros]


class Trie:
    """Levels of contexts, pointers and context-relative successors with their quantised log probabilities."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @classmethod
    def of(cls, context: np.ndarray, successor: np.ndarray, codes: np.ndarray) -> Trie:
        """From distinct bigrams in ascending order."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        number = (np.cumsum(new) - 1).astype(np.uint64)
        first = np.append(np.flatnonzero(new), len(context)).astype(np.uint64)
        relative = (number << np.uint64(_SUCCESSOR_BITS)) | successor
        return cls(
            EliasFano.of(context[new], 1 << _CONTEXT_BITS),
            EliasFano.of(first, len(context) + 1),
            EliasFano.of(relative, max(int(new.sum()), 1) << _SUCCESSOR_BITS),
            codes,
        )

    def find(self, contexts: np.ndarray, sizes: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of bigrams, 0 where the trie has none: distinct contexts with the number of successors that follow each."""
        out = np.zeros(len(successor), np.uint16)
        if not len(self.codes) or not len(successor):
            return out
        number = np.repeat(self.contexts.find(contexts), sizes)
        known = np.flatnonzero(number >= 0)
        place = self.successors.find((number[known].astype(np.uint64) << np.uint64(_SUCCESSOR_BITS)) | successor[known])
        hit = place >= 0
        out[known[hit]] = self.codes[place[hit]]
        return out

    def followers(self, context: int) -> tuple[np.ndarray, np.ndarray]:
        """All successors of one context and their codes, between its two pointers."""
        number = int(self.contexts.find(np.array([context], np.uint64))[0]) if len(self.codes) else -1
        if number < 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        first, last = self.pointers.get(np.array([number, number + 1])).astype(np.int64)
        index = np.arange(first, last)
        return self.successors.get(index) & np.uint64((1 << _SUCCESSOR_BITS) - 1), self.codes[index]

    def write(self, path: str) -> None:
        parts = [*self.contexts.parts(), *self.pointers.parts(), *self.successors.parts(), self.codes]
        with open(path, "wb") as f:
            np.array([len(p) for p in parts], np.int64).tofile(f)
            for p in parts:
                p.tofile(f)
                f.write(b"\0" * (-p.nbytes % 8))

    @classmethod
    def mapped(cls, path: str) -> Trie:
        """The levels of a written trie as views of the file."""
        sizes = np.fromfile(path, np.int64, 13)
        at, parts = 13 * 8, []
        for k, n in enumerate(sizes):
            kind = np.uint16 if k == 12 else (np.int64, np.uint64, np.uint64, np.uint32)[k % 4]
            parts.append(np.asarray(np.memmap(path, kind, "r", at, (int(n),))) if n else np.zeros(0, kind))
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8
        levels = [EliasFano(int(parts[k][0]), int(parts[k][1]), *parts[k + 1 : k + 4]) for k in (0, 4, 8)]
        return cls(*levels, parts[12])


class Tokens:
    """Words and ends of a block in order, and its distinct words with their training counts."""

    def __init__(self, ids: list, data: np.ndarray, offsets: np.ndarray, shards: int):
        hashes, _, _, counts = tb.word_hashes(data, offsets)
        self.counts, self.shards = counts + 1, shards
        ends = np.cumsum(self.counts) - 1
        word = np.empty(len(hashes) + len(counts), np.uint64)
        inner = np.ones(len(word), bool)
        inner[ends] = False
        word[inner], word[ends] = hashes, _END
        self.held = np.array([k is not None and zlib.crc32(str(k).encode()) % FOLDS == HELD_OUT for k in ids], bool)
        self.train = np.repeat(~self.held, self.counts)
        self.words, self.word_at = np.unique(word, return_inverse=True)
        self.word_train = np.bincount(self.word_at, self.train, len(self.words)).astype(np.uint32)
        self.word_cuts = np.searchsorted(_ascending_shard(self.words, shards), np.arange(shards + 1))

    def pairs(self, counts: np.ndarray) -> None:
        """Adds the distinct bigrams by shard; ``counts`` are the corpus counts of the words, from which the salts follow."""
        start = np.cumsum(self.counts) - self.counts
        context_at = np.roll(self.word_at, 1)
        # As a context, the start of a text counts as often as its end, and is the rank after the last word.
        self.context_at = context_at.copy()
        self.context_at[start] = np.searchsorted(self.words, _END)
        context_at[start] = len(self.words)
        contexts = np.append(self.words, _START) >> np.uint64(64 - _CONTEXT_BITS)
        successors = tb.mix(self.words) >> np.uint64(64 - _SUCCESSOR_BITS)
        totals = np.append(counts, counts[np.searchsorted(self.words, _END)] if len(counts) else 0)
        width = len(self.words) + 1
        pairs, self.pair_at = np.unique(context_at * width + self.word_at, return_inverse=True)
        context, successor, total = contexts[pairs // width], successors[pairs % width], totals[pairs // width]
        salts = np.clip(-(-total // SALT_COUNT), 1, 65535).astype(np.uint64)
        shard = _shard(context | (successor % salts) << np.uint64(_CONTEXT_BITS), self.shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.pair_at = place[self.pair_at]
        self.context, self.successor, self.context_count = context[order], successor[order], total[order]
        self.successor_count = counts[pairs % width][order]
        self.pair_train = np.bincount(self.pair_at, self.train, len(pairs)).astype(np.uint32)
        self.pair_cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))


def _ascending_shard(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _shard(keys: np.ndarray, n: int) -> np.ndarray:
    return _ascending_shard(tb.mix(keys), n)


def _bytes_of(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _values_of(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _planes(values: np.ndarray) -> bytes:
    """Four bytes for each number, first bytes first, which compresses better."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _of_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_ASK = "shard long, block long, words binary, word_train binary"
_COUNTS = "block long, shard long, word_counts binary, train_tokens long, train_words long"
_SEND = "shard long, block long, contexts binary, sizes binary, context_counts binary, successors binary, successor_counts binary, pair_train binary"
_ANSWER = "block long, shard long, codes binary"
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _ask(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for row in bl.each(batches):
        t = Tokens(*bl.opened(row), shards)
        cuts = zip(t.word_cuts, t.word_cuts[1:])
        yield _table([(k, row["block"], _bytes_of(t.words[a:b], 8), _planes(t.word_train[a:b])) for k, (a, b) in enumerate(cuts) if b > a], _ASK)


def _count(table: pa.Table) -> pa.Table:
    """For each block: the corpus counts of its words."""
    rows = table.to_pylist()
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    distinct, at = np.unique(np.concatenate(words), return_inverse=True)
    totals = np.bincount(at, np.concatenate([_of_planes(r["word_train"]) for r in rows]), len(distinct)).astype(np.int64)
    out, done = [], 0
    for k, (r, w) in enumerate(zip(rows, words)):
        sums = (int(totals.sum()), int((totals > 0).sum())) if k == 0 else (0, 0)
        out.append((r["block"], r["shard"], _planes(totals[at[done : done + len(w)]]), *sums))
        done += len(w)
    return pa.Table.from_batches([_table(out, _COUNTS)])


def _counted(row: dict, answers: list[dict], shards: int) -> tuple[Tokens, np.ndarray]:
    """The tokens of a block with their bigrams, and the corpus counts of its words."""
    t = Tokens(*bl.opened(row), shards)
    counts = np.zeros(len(t.words), np.int64)
    for r in answers:
        if r["word_counts"] is not None:
            counts[slice(*t.word_cuts[r["shard"] : r["shard"] + 2])] = _of_planes(r["word_counts"])
    t.pairs(counts)
    return t, counts


def _send(left: pa.Table, right: pa.Table, shards: int) -> pa.Table:
    rows = []
    for row in left.to_pylist():
        t, _ = _counted(row, right.select(["shard", "word_counts"]).to_pylist(), shards)
        for k in range(shards):
            p = slice(*t.pair_cuts[k : k + 2])
            if p.stop == p.start:
                continue
            context = t.context[p]
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            sizes = np.diff(np.append(first, len(context)))
            packed = [_bytes_of(context[first], 6), _planes(sizes), _planes(t.context_count[p][first]), _bytes_of(t.successor[p], 5), _planes(t.successor_count[p]), _planes(t.pair_train[p])]
            rows.append((k, row["block"], *packed))
    return pa.Table.from_batches([_table(rows, _SEND)])


def _answer(table: pa.Table, n: int, v: int, weight: float) -> pa.Table:
    rows = table.to_pylist()
    read = lambda name: [_of_planes(r[name]) for r in rows]
    asked, sizes, totals = [_values_of(r["contexts"], 6) for r in rows], read("sizes"), read("context_counts")
    successors = [_values_of(r["successors"], 5) for r in rows]
    counts = np.concatenate(read("pair_train"))
    seen = np.flatnonzero(counts)
    spread = lambda values: np.concatenate([np.repeat(x, m) for x, m in zip(values, sizes)])[seen]
    context, total, successor = spread(asked), spread(totals), np.concatenate(successors)[seen]
    counts, alone = counts[seen].astype(np.int64), np.concatenate(read("successor_counts"))[seen]
    order = np.lexsort([successor, context])
    context, successor = context[order], successor[order]
    new = np.ones(len(order), bool)
    new[1:] = (successor[1:] != successor[:-1]) | (context[1:] != context[:-1])
    first = np.flatnonzero(new)
    counts = np.add.reduceat(counts[order], first) if len(first) else counts
    base = (alone[order[first]] + 1.0) / (n + v + 1)
    trie = Trie.of(context[first], successor[first], quantised((counts + weight * base) / (total[order[first]] + weight)))
    out = []
    with tempfile.TemporaryDirectory(prefix="trie-") as folder:
        path = os.path.join(folder, "levels")
        trie.write(path)
        trie = Trie.mapped(path)
        for r, c, m, s in zip(rows, asked, sizes, successors):
            out.append((r["block"], r["shard"], trie.find(c, m, s).tobytes()))
    return pa.Table.from_batches([_table(out, _ANSWER)])


def _score(left: pa.Table, right: pa.Table, shards: int, n: int, v: int, weight: float) -> pa.Table:
    out = []
    for row in left.to_pylist():
        answers = right.select(["shard", "word_counts", "codes"]).to_pylist()
        t, counts = _counted(row, answers, shards)
        codes = np.zeros(len(t.context), np.uint16)
        for r in answers:
            if r["codes"] is not None:
                codes[slice(*t.pair_cuts[r["shard"] : r["shard"] + 2])] = np.frombuffer(r["codes"], np.uint16)
        c = counts[t.word_at]
        base = (c + 1) / (n + v + 1)
        code = codes[t.pair_at]
        p = np.where(code > 0, probabilities(code), weight * base / (counts[t.context_at] + weight))
        first = np.cumsum(t.counts) - t.counts
        sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), np.log10(base), np.log10(p))]
        known, base_score, score = (x.tolist() for x in sums)
        out += [(k, bool(h), int(m), a, n, b, s) for k, h, m, a, b, s in zip(row["ids"], t.held, t.counts, known, base_score, score)]
    return pa.Table.from_batches([_table(out, _SCORE)])


def score(documents: DataFrame, key: str = "doc_id", text: str = "text", weight: float = WEIGHT) -> DataFrame:
    """Unigram base score and bigram score (log10) of each row, learned from the rows that are not held out."""
    spark = documents.sparkSession
    stored = bl.blocks(documents, key, text)
    shards = bl.bucket_count(spark, stored, "n_bytes", SHARD_BYTES)
    asked = bl.map_batches(stored, lambda batches: _ask(batches, shards), _ASK)
    words = bl.stored(asked.groupBy("shard").applyInArrow(_count, _COUNTS), "words")
    n, v = words.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("train_words"), F.lit(0))).first()
    counts = words.select("block", "shard", "word_counts")
    sent = stored.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(lambda a, b: _send(a, b, shards), _SEND)
    codes = sent.groupBy("shard").applyInArrow(lambda table: _answer(table, n, v, weight), _ANSWER)
    answers = counts.unionByName(codes, allowMissingColumns=True)
    return stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _score(a, b, shards, n, v, weight), _SCORE)
