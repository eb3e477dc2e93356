"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` tokens. Packing needs only how many pieces there are
of each length (at most ``capacity`` numbers). For each bin the largest piece left is placed and a bitset
subset-sum over the lengths still available finds the fullest combination for the rest; the combination is
repeated while its lengths last and then removed. Each repeat uses up a length, so there are at most
``capacity`` patterns however many pieces there are. Pieces take their places by rank within their length:
the rank inside the writing task plus the pieces of earlier tasks.

Defined results: a null or empty text is one piece that holds only the end id; repeated rows are packed
as often as they occur; an empty table packs nothing; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice, pairwise
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm import textbytes as tb
from termweave.llm.blocks import map_batches, stored

CAPACITY = 1024
END = 2
#: Segments, and parts of segments, that a worker remembers; reaching it only empties the memory.
MEMORY = 600_000
#: Bytes of text tokenised together.
TOGETHER = 4 << 20

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
_workers: dict[str, Segments] = {}
_ragged = re.compile(r" (?=\s|$)")
#: Stands between segments; no text can hold it.
_BETWEEN = "\udfff"
# The space before a segment and the letters that it starts with, if no other letter follows; its rest, or all of it.
_head_and_tail = re.compile(rf"{_BETWEEN}((?: [A-Za-zÀ-ÖØ-öø-ÿ]+(?![^\W\d_]))?)([^{_BETWEEN}]*)")
# The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on, in order.
_plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
_alphabet = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _plain)}
_SPACE = chr(_alphabet[32])
_mapped = np.array([_alphabet.get(b, b) for b in range(256)], "<u4")
#: Runs of letters that the model is given at once.
RUNS = 20


def _four_bytes(ids: list[int]) -> bytes:
    """Little-endian 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Segments:
    """Token ids by segment. A text is cut before each space that a non-space follows.

    The byte-level tokenizer never joins what lies on the two sides of such a cut, so a segment's ids do
    not depend on its neighbours and each distinct segment is encoded once. A special token that stands
    literally in a text has its own id, and what is before and after it is encoded as texts of their own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {content: _four_bytes([i]) for content, i in special.items()}
        self.borders = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        # Runs of letters stay apart where no piece of letters holds a space beyond its start.
        letters = set("".join(map(chr, _mapped[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]])) + _SPACE)
        alike = self.model.dropout is None and not self.model.ignore_merges
        self.runs = RUNS if alike and not any(_SPACE in v[1:] and letters.issuperset(v) for v in vocabulary) else 1
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for v, i in vocabulary.items() if v.startswith(_SPACE)]] = True
        self.forget()

    def forget(self) -> None:
        """Empties the memory; a worker lives on between tasks, beside the executor's heap."""
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.coded: list[bytes] = []
        self.heads: dict[str, bytes] = {"": b""}
        self.tails: dict[str, bytes] = {}

    def _tokens(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [_four_bytes(e.ids) for e in self._tokens(texts)]

    @staticmethod
    def cut(text: str) -> list[str]:
        """First segment as it is, the others without their leading space."""
        parts = text.split(" ")
        if not _ragged.search(text):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def _learn(self, segments: list[str]) -> None:
        """Remember the ids of new segments.

        The letters that a segment starts with are a token group of their own, whatever follows; they and the
        rest are encoded once for all segments that share them.
        """
        if not segments:
            return
        if len(self.heads) + len(self.tails) > MEMORY:
            self.heads, self.tails = {"": b""}, {}
        start = _BETWEEN + " "
        parts = _head_and_tail.split(start + start.join(segments))
        heads, tails = parts[1::3], parts[2::3]
        new = list(set(heads).difference(self.heads))
        self.heads.update(zip(new, self._runs(new)))
        new = list(set(tails).difference(self.tails))
        self.tails.update(zip(new, self._encode(new)))
        self.coded += map(add, map(self.heads.__getitem__, heads), map(self.tails.__getitem__, tails))

    def _runs(self, heads: list[str]) -> list[bytes]:
        """The ids of runs of letters with the space before them, which is where a run's first token starts."""
        data = np.frombuffer("".join(heads).encode(), np.uint8)
        text = _mapped[data].tobytes().decode("utf-32-le")
        borders = [*np.flatnonzero(data == 32)[:: self.runs].tolist(), len(text)]
        ids = np.array([t.id for a, b in pairwise(borders) for t in self.model.tokenize(text[a:b])], "<u4")
        borders = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
        found = ids.tobytes()
        return [found[a:b] for a, b in pairwise(borders)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        marked = {k: self.borders.findall(t) for k, t in enumerate(texts) if self.borders.search(t)}
        if not marked:
            return self._plain_ids(texts)
        parts = [self.borders.split(t) if k in marked else [t] for k, t in enumerate(texts)]
        found = iter(self._plain_ids([p for row in parts for p in row]))
        out = []
        for k, row in enumerate(parts):
            ids = [next(found)]
            for content, _ in zip(marked.get(k, ()), row[1:]):
                ids += [self.special[content], next(found)]
            out.append(b"".join(ids))
        return out

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """The same for texts without special tokens."""
        if len(self.coded) > MEMORY:
            self.number, self.coded = defaultdict(count().__next__), []
        heads, rows = [], []
        for text in texts:
            head, *others = self.cut(text)
            heads.append(head)
            rows.append(list(map(self.number.__getitem__, others)))
        new = len(self.number) - len(self.coded)
        self._learn(list(islice(reversed(self.number), new))[::-1])
        coded = self.coded
        return [b"".join([head, *map(coded.__getitem__, row)]) for head, row in zip(self._encode(heads), rows)]


def _segments(path: str) -> Segments:
    if path not in _workers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _workers[path] = Segments(path)
    return _workers[path]


def _cut_pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    seen = np.zeros(capacity + 1, np.int64)
    end = np.array([END], "<u4").tobytes()
    encoder = _segments(path)
    for batch in batches:
        sizes = tb.columns(batch.column(1))[1]
        for i, j in tb.pieces(sizes, TOGETHER):
            keys = batch.column(0).slice(i, j - i).to_pylist()
            texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
            rows = []
            for key, ids in zip(keys, encoder.ids(texts)):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                borders = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(borders, borders[1:])):
                    rows.append((key, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), task, int(seen[b - a])))
                    seen[b - a] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    encoder.forget()


def token_pieces(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document's ids, with the writing task and the rank among its pieces of that length."""
    rows = documents.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return stored(map_batches(rows, lambda batches: _cut_pieces(batches, tokenizer, capacity), _PIECES), "pieces")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``; long ones preferred."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        times = 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + times
            at -= length * times
    return chosen


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first sequence, pieces per sequence, offset in the sequence)."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    plan, sequence = [], 0
    while left:
        largest = max(left)
        rest = left | {largest: left[largest] - 1}
        combination = fullest({n: c for n, c in rest.items() if c and n <= capacity - largest}, capacity - largest)
        combination[largest] = combination.get(largest, 0) + 1
        repeats = min(left[n] // k for n, k in combination.items())
        offset = 0
        for n in sorted(combination, reverse=True):
            k = combination[n]
            plan.append((n, used[n], sequence, k, offset))
            offset += n * k
            used[n] += k * repeats
            left[n] -= k * repeats
            if not left[n]:
                del left[n]
        sequence += repeats
    return plan


def _place(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (plan[:, 0] << 48) + plan[:, 1]
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        row = plan[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
        after = rank - row[:, 1]
        sequence = row[:, 2] + after // row[:, 3]
        offset = row[:, 4] + after % row[:, 3] * length
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and place of each row of ``token_pieces``."""
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    offsets = per_task.select("task", "length", earlier.alias("earlier"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(sorted(packing_plan(counts, capacity)), np.int64).reshape(-1, 5)
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("earlier")).drop("earlier")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_batches(ranked, lambda batches: _place(batches, plan), out)
