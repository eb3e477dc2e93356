"""Distinct sampled segmentations of texts by Gumbel top-k over the SentencePiece lattice.

A segmentation's probability is proportional to exp(sharpness * sum of its pieces' scores). Backward sums over the
lattice give the chance of each next piece, so segmentations form a tree whose leaves are perturbed top-down: of a
node's children one is drawn by its chance and has the node's own value; all others together have a Gumbel value at the logarithm of the
sum of their chances, under the condition that it is smaller. A best-first (A-star) search by perturbed value opens such
a rest only when its turn comes, and so emits segmentations in descending order, a sample without replacement. The
value that comes after the last one is the threshold; a segmentation's inclusion score is the logarithm of its chance to exceed it,
log(1 - exp(-exp(logp - threshold))), as importance weights need it.

Only as many open nodes are kept as samples are still wanted, which is exact since every node leads to one value. No piece crosses
the start of a word mark, so a text is a row of chunks, and the lattice of a chunk is built once for all texts of a batch. The chunks of
all paths are drawn in step. A row's random numbers come from its key and text alone, so neither a repeated
task nor other rows of the batch change its samples.

Texts are coded losslessly: spaces as the word mark after one leading mark, characters without a piece (and the word
mark itself) as bytes.

Defined results: a null or empty text has one segmentation, the leading mark; a text with fewer segmentations than wanted gives all, with
inclusion score 0 (certain); repeated rows get equal samples; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import textbytes as tb
from termweave.llm.blocks import map_batches

SAMPLES = 3
SHARPNESS = 0.0004
MARK = "▁"
#: Stands for a word mark of the text itself; no text can hold it.
_HIDDEN = "\udfff"
#: What branches off a path whose probability is this many nats below the open nodes cannot beat them: its chance is
#: below the resolution of the random numbers.
BEYOND = 45.0
#: Characters of texts that are sampled together; only a single longer text goes beyond.
BATCH_CHARS = 1 << 20
#: Characters of chunks whose lattices are built together; only a single longer chunk goes beyond.
BUILD_CHARS = 1 << 16
_SEPARATOR = (1 << 21) - 1
_chunk = re.compile(f"{MARK}+[^{MARK}]*")
_workers: dict[tuple, Pieces] = {}


class Pieces:
    """The vocabulary as a trie in one array: a state's child by a character stands ``base`` of the state and ``kind`` of the character away.

    ``owner`` names the state whose child a place holds, so that the others' places are no children of it.
    """

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.vocab_size()) if model.is_byte(i)}
        self.coded: dict[int, list[int]] = {}
        self.worst = sharpness * min(model.get_score(i) for i in range(model.vocab_size()))
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i in range(model.vocab_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
                continue
            state = 0
            for c in model.id_to_piece(i):
                state = children.setdefault((state, ord(c)), len(children) + 1)
            ends[state] = i
        # Characters by how often they lead to a child, from 1; 0 for all others.
        often: dict[int, int] = {}
        for _, c in children:
            often[c] = often.get(c, 0) + 1
        self.kind = np.zeros(max(often) + 2, np.int64)
        self.kind[sorted(often, key=lambda c: (-often[c], c))] = np.arange(1, len(often) + 1)
        below: dict[int, list[tuple[int, int]]] = {}
        for (state, c), to in children.items():
            below.setdefault(state, []).append((int(self.kind[c]), to))
        # States with many children first, each at the first free place from where the last one of its size was put.
        size, low, place = 0, 0, np.zeros(len(children) + 1, np.int64)
        base, taken = np.zeros(len(children) + 1, np.int64), bytearray(8 * len(children) + len(often) + 2)
        taken[0] = 1  # the root's own place
        for state in sorted(below, key=lambda x: -len(below[x])):
            own = [k for k, _ in below[state]]
            if len(own) != size:
                size, low = len(own), 0
            while any(taken[low + k] for k in own):
                low += 1
                if low + len(often) >= len(taken):
                    taken += bytes(len(taken))
            base[state] = low
            for k, to in below[state]:
                taken[low + k] = 1
                place[to] = low + k
        n = int(place.max()) + len(often) + 2
        self.base, self.owner, self.piece = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.base[place] = base
        for state, found in below.items():
            self.owner[[place[to] for _, to in found]] = place[state]
        self.piece[place[list(ends)]] = list(ends.values())
        self.score = sharpness * np.array([model.get_score(i) for i in range(model.vocab_size())])

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        """The characters' kinds."""
        return self.kind.take(np.minimum(codes, len(self.kind) - 1))

    def step(self, state: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the states have a child by the character, and these children. No state has one by kind 0."""
        child = self.base.take(state) + kinds
        hit = np.flatnonzero((self.owner.take(child) == state) & (kinds > 0))
        return hit, child.take(hit)

    def bytes_of(self, code: int) -> list[int]:
        """The ids of a character without a piece."""
        if code not in self.coded:
            self.coded[code] = [self.byte[b] for b in chr(code).replace(_HIDDEN, MARK).encode()]
        return self.coded[code]


class Lattices:
    """The lattices of distinct chunks. Position p has the edges ``first[p]`` to ``first[p + 1]``, shorter pieces first.

    An edge has its position ``place``, its ``size`` in characters, its ``id`` (-1 - character for one that is coded as bytes), its log chance ``logp``
    and ``upto``, the chance of it and the edges before it (above 1 for the last). A position has its likeliest edge ``best``, the chances ``low`` and
    ``high`` between which that is drawn, and ``others``, the log of the chance of all its other edges.
    """

    def __init__(self, pieces: Pieces, chunks: list[str]):
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.end = self.start + sizes
        borders = np.append(self.start, len(sizes) + sizes.sum())
        parts = [self._build(pieces, chunks[i:j]) for i, j in tb.pieces(borders, BUILD_CHARS)]
        counts, self.size, self.id, self.logp, self.upto, best, self.low, self.high, self.others = map(np.concatenate, zip(*parts))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.best = self.first[:-1] + best
        self.place = np.repeat(np.arange(len(counts), dtype=np.int32), counts)

    @staticmethod
    def _build(pieces: Pieces, chunks: list[str]) -> tuple[np.ndarray, ...]:
        codes = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1) - 1
        kinds = pieces.kinds(codes)
        kinds[ends] = 0
        n = len(codes)
        counts = np.zeros(n, np.int64)
        at, state, length, found = np.arange(n), np.zeros(n, np.int64), 0, []
        while len(at):
            hit, state = pieces.step(state, kinds.take(at + length))
            at = at.take(hit)
            length += 1
            ids = pieces.piece.take(state)
            known = np.flatnonzero(ids >= 0)
            if length == 1:
                bare = np.ones(n, bool)
                bare[ends] = False
                bare[at[known]] = False
                bare = np.flatnonzero(bare)
                found.append((bare, 1, -1 - codes[bare], 0))
                counts[bare] = 1
            where = at.take(known)
            rank = counts.take(where)
            found.append((where, length, ids.take(known), rank))
            counts[where] = rank + 1
        first = np.concatenate([[0], np.cumsum(counts)])
        size, ids = np.empty(first[-1], np.int8 if length < 128 else np.int64), np.empty(first[-1], np.int32)
        for where, length, some, rank in found:
            edge = first.take(where) + rank
            size[edge] = length
            ids[edge] = some
        pos = np.repeat(np.arange(n), counts)
        weight = pieces.score.take(np.maximum(ids, 0))
        coded = np.flatnonzero(ids < 0)
        bare, back = np.unique(-1 - ids[coded], return_inverse=True)
        weight[coded] = pieces.worst * np.array([len(pieces.bytes_of(c)) for c in bare.tolist()], float)[back]
        # Sums from the end of each chunk backwards, all chunks in step.
        total, target = np.zeros(n), pos + size
        distance = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
        distance = distance.astype(np.int16 if distance.max() < 1 << 15 else np.int64)
        by_distance = np.argsort(distance, kind="stable")[len(ends) :]
        steps = np.searchsorted(distance[by_distance], np.arange(1, int(distance.max()) + 2)).tolist()
        width = counts.take(by_distance)
        heads = np.concatenate([[0], np.cumsum(width)])
        edges = np.arange(heads[-1]) + np.repeat(first.take(by_distance) - heads[:-1], width)
        their_weight, their_target = weight.take(edges), target.take(edges)
        for low, high in zip(steps, steps[1:]):
            a, b = heads[low], heads[high]
            total[by_distance[low:high]] = np.logaddexp.reduceat(their_weight[a:b] + total.take(their_target[a:b]), heads[low:high] - a)
        logp = weight + total.take(target) - total.take(pos)
        chance = np.exp(logp)
        # Sums and the likeliest edge inside a position, all positions in step.
        inside = np.flatnonzero(counts)
        edge, best = first.take(inside), np.zeros(n, np.int64)
        upto, most = chance.copy(), chance.take(edge)
        row, left = 0, np.arange(len(inside))
        while True:
            row += 1
            left = left.take(np.flatnonzero(counts.take(inside.take(left)) > row))
            if not len(left):
                break
            e = edge.take(left) + row
            upto[e] += upto.take(e - 1)
            more = np.flatnonzero(chance.take(e) > most.take(left))
            most[left.take(more)] = chance.take(e.take(more))
            best[inside.take(left.take(more))] = row
        upto[first[1:].take(inside) - 1] = 2.0
        at = edge + best.take(inside)
        low, high, others = np.zeros(n), np.zeros(n), np.full(n, -np.inf)
        low[inside] = np.where(at > edge, upto.take(at - 1), 0.0)
        high[inside] = upto.take(at)
        chance[at] = 0.0
        with np.errstate(divide="ignore"):
            others[inside] = np.log(np.add.reduceat(chance, edge))
        rare = np.flatnonzero((others < -600.0) & (counts > 1))  # too small for chances
        if len(rare):
            width = counts.take(rare) - 1
            heads = np.cumsum(width) - width
            e = np.arange(int(width.sum())) + np.repeat(first.take(rare) - heads, width)
            e += e >= np.repeat(first.take(rare) + best.take(rare), width)
            others[rare] = np.logaddexp.reduceat(logp.take(e), heads)
        return counts, size, ids, logp, upto, best, low, high, others

    def rest(self, places: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The log of the chance of the other edges at each place: none is too small."""
        other = self.others.take(places)
        rare = np.flatnonzero(self.best.take(places) != edges)
        other[rare] = np.log1p(-np.exp(self.logp.take(edges.take(rare))))
        return other


def marked(text: str) -> str:
    """The text as the lattice reads it; a word mark of its own is hidden, and coded as bytes."""
    return MARK + text.replace(MARK, _HIDDEN).replace(" ", MARK)


def chunks_of(text: str) -> list[str]:
    """The chunks of the marked text, each without the mark it starts with."""
    parts = text.replace(MARK, _HIDDEN).split(" ")
    if "" not in parts[:-1]:
        return parts
    return [c[1:] for c in _chunk.findall(marked(text))]


class _Text:
    """The search of one text: its chunks as places in the batch, its open nodes and its paths.

    An open node stands for all segmentations that share a path up to a position and differ there. It is (-value, tie-breaker,
    the path's edges before, log probability before, chunk, position, excluded edges).
    """

    def __init__(self, low: int, high: int, begin: int, end: int, rng: random.Random):
        self.low, self.high, self.begin, self.end = low, high, begin, end
        self.rng = np.random.Generator(np.random.PCG64(rng.getrandbits(64)))
        self.value = -math.log(self.rng.standard_exponential())
        self.heap: list[tuple] = []
        self.done: list[tuple[np.ndarray, float, float]] = []
        self.serial = 0
        # Where the next path leaves the known: edges before, log probability, chunk, position (None: the chunk's start).
        self.at = (np.zeros(0, np.int32), 0.0, low, None)

    def push(self, value: float, *node) -> None:
        if value > -math.inf:
            self.serial += 1
            self.heap.append((-value, self.serial, *node))

    def open(self, lattices: Lattices, chunk: np.ndarray) -> bool:
        """Takes the best open node and draws its choice; false if none is left."""
        if not self.heap:
            return False
        value, _, path, logp, c, p, excluded = heapq.heappop(self.heap)
        self.value = -value
        low, high = int(lattices.first[p]), int(lattices.first[p + 1])
        logs = [(x, e) for e, x in enumerate(lattices.logp[low:high].tolist(), low) if e not in excluded]
        top = max(logs)[0]
        ends = list(accumulate(math.exp(x - top) for x, _ in logs))
        at = min(bisect.bisect_right(ends, self.rng.random() * ends[-1]), bisect.bisect_left(ends, ends[-1]))
        here, edge = logs.pop(at)
        if logs:
            top = max(logs)[0]
            others = top + math.log(sum(math.exp(x - top) for x, _ in logs))
            self.push(float(bounded(logp + others - math.log(self.rng.standard_exponential()), self.value)), path, logp, c, p, excluded | {edge})
        p += int(lattices.size[edge])
        c, p = (c + 1, None) if p == lattices.end[chunk[c]] else (c, p)
        self.at = (np.append(path, np.int32(edge)), logp + here, c, p)
        return True

    def walked(self, lattices: Lattices, offset: np.ndarray, starts: np.ndarray, edges: np.ndarray, wanted: int) -> None:
        """Notes the drawn rest of the path, and the ``wanted`` best open nodes: what branches off where a piece starts."""
        before, logp, _, _ = self.at
        ahead = np.append(logp, logp + np.cumsum(lattices.logp.take(edges)))
        path = np.concatenate([before, edges]) if len(before) else edges
        self.heap = heapq.nsmallest(wanted, self.heap)
        low, high = 0, 512
        while low < len(edges):
            some = edges[low:high]
            here = ahead[low : low + len(some)]
            places = lattices.place.take(some)
            # In the order of their values, without the bound that all share.
            order = here + lattices.rest(places, some) - np.log(self.rng.standard_exponential(len(places)))
            best = np.argpartition(-order, wanted)[:wanted] if len(order) > wanted else np.arange(len(order))
            for x, value in zip(best.tolist(), bounded(order.take(best), self.value).tolist()):
                c = int(offset.searchsorted(starts[low + x], "right")) - 1
                self.push(value, path[: len(before) + low + x], float(here[x]), c, int(places[x]), frozenset([int(some[x])]))
            self.heap = heapq.nsmallest(wanted, self.heap)
            if len(self.heap) == wanted and here[-1] < -self.heap[-1][0] - BEYOND:
                break
            low, high = high, 2 * high
        self.done.append((path, float(ahead[-1]), self.value))


def bounded(order, value):
    """Gumbel values at a location, less the log of exponential noise, under the condition that they are below ``value``."""
    return -np.logaddexp(-value, -order)


def _walk(lattices: Lattices, chunk: np.ndarray, offset: np.ndarray, texts: list[_Text], n_chars: int, wanted: int) -> None:
    """Draws one path for each of the texts from where it stands, all chunks in step."""
    chance = np.empty(n_chars)
    c = np.concatenate([np.arange(t.at[2], t.high) for t in texts])
    p = lattices.start[chunk[c]]
    done = 0
    for t in texts:
        t.rng.random(out=chance[t.begin : t.end])
        if t.at[3] is not None:
            p[done] = t.at[3]
        done += t.high - t.at[2]
    # An edge for each character at which a piece starts.
    edge_at = np.full(n_chars, -1, np.int32)
    last, shift = lattices.end[chunk[c]], offset[c] - lattices.start[chunk[c]]
    while len(p):
        char = p + shift
        draw, edge = chance.take(char), lattices.best.take(p)
        missed = np.flatnonzero((draw < lattices.low.take(p)) | (draw >= lattices.high.take(p)))
        if len(missed):
            draw, other = draw.take(missed), lattices.first.take(p.take(missed))
            more = np.flatnonzero(draw >= lattices.upto.take(other))
            while len(more):
                other[more] += 1
                more = more.take(np.flatnonzero(draw.take(more) >= lattices.upto.take(other.take(more))))
            edge[missed] = other
        edge_at[char] = edge
        p += lattices.size.take(edge)
        left = np.flatnonzero(p < last)
        p, last, shift = p.take(left), last.take(left), shift.take(left)
    starts = np.flatnonzero(edge_at >= 0)
    edges = edge_at[starts]
    for t, i, j in zip(texts, np.searchsorted(starts, [t.begin for t in texts]).tolist(), np.searchsorted(starts, [t.end for t in texts]).tolist()):
        t.walked(lattices, offset, starts[i:j], edges[i:j], wanted)


def samples_of(texts: list[str], pieces: Pieces, k: int, rngs: list[random.Random]) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations as (ids, log probability, perturbed value, inclusion score), best first."""
    number: defaultdict[str, int] = defaultdict(count().__next__)
    chunks = [np.fromiter(map(number.__getitem__, own), np.int64, len(own)) for own in map(chunks_of, texts)]
    low = np.cumsum([0, *map(len, chunks)]).tolist()
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)]).tolist()
    found = [_Text(*x) for x in zip(low, low[1:], begin, begin[1:], rngs)]
    chunk = np.concatenate(chunks)
    with np.errstate(divide="ignore"):
        lattices = Lattices(pieces, [MARK + c for c in number])
        offset = np.concatenate([[0], np.cumsum((lattices.end - lattices.start).take(chunk))])
        going = found
        for wanted in range(k, 0, -1):
            _walk(lattices, chunk, offset, going, begin[-1], wanted)
            going = [t for t in going if wanted > 1 and t.open(lattices, chunk)]
            if not going:
                break
    return [[(_ids(pieces, lattices.id.take(path)), logp, value, _inclusion(logp + t.heap[0][0] if t.heap else math.inf)) for path, logp, value in t.done] for t in found]


def samples(text: str, pieces: Pieces, k: int, rng: random.Random) -> list[tuple[list[int], float, float, float]]:
    """``samples_of`` one text, with the ids as a list."""
    return [(ids.tolist(), *x) for ids, *x in samples_of([text], pieces, k, [rng])[0]]


def _ids(pieces: Pieces, ids: np.ndarray) -> np.ndarray:
    """Ids with characters without a piece as those of their bytes."""
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids.astype(np.int32)
    coded = [pieces.bytes_of(-1 - i) for i in ids.take(bare).tolist()]
    size = np.ones(len(ids), np.int64)
    size[bare] = list(map(len, coded))
    out = np.repeat(ids, size)
    out[out < 0] = [i for x in coded for i in x]
    return out.astype(np.int32)


def _inclusion(x: float) -> float:
    if x == math.inf:
        return 0.0
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def decode(ids: list[int], pieces: Pieces) -> str:
    """The text that the ids code."""
    back = {i: bytes([b]) for b, i in pieces.byte.items()}
    raw = b"".join(back[i] if i in back else pieces.model.id_to_piece(i).replace(MARK, " ").encode() for i in ids)
    return raw.decode()[1:]


def pieces_of(path: str, sharpness: float = SHARPNESS) -> Pieces:
    if (path, sharpness) not in _workers:
        _workers[path, sharpness] = Pieces(path, sharpness)
    return _workers[path, sharpness]


def row_random(key: tuple, text: str) -> random.Random:
    return random.Random(hashlib.blake2b(repr(key).encode() + b"\0" + text.encode(), digest_size=8).digest())


_ADDED = ("sample", "ids", "log_probability", "perturbed", "log_inclusion")


def _sample(batches: Iterator[pa.RecordBatch], path: str, k: int, sharpness: float) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(path, sharpness)
    for batch in batches:
        last = batch.num_columns - 1
        sizes = np.cumsum([0, *(len(t.as_py() or "") for t in batch.column(last))])
        low = 0
        while low < batch.num_rows:
            high = max(int(np.searchsorted(sizes, sizes[low] + BATCH_CHARS, "right")) - 1, low + 1)
            part = batch.slice(low, high - low)
            keys = list(zip(*(part.column(i).to_pylist() for i in range(last))))
            texts = [t or "" for t in part.column(last).to_pylist()]
            found = samples_of(texts, pieces, k, [row_random(key, text) for key, text in zip(keys, texts)])
            source = np.repeat(np.arange(len(found)), [len(x) for x in found])
            kept = [part.column(i).take(pa.array(source)) for i in range(last)]
            ids, *numbers = zip(*(x for one in found for x in one))
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            sample = pa.array([s for one in found for s in range(len(one))], pa.int32())
            yield pa.RecordBatch.from_arrays([*kept, sample, lists, *[pa.array(c, pa.float64()) for c in numbers]], names=[*part.schema.names[:last], *_ADDED])
            low = high


def encode_sampled(texts: DataFrame, model: str, keep: tuple[str, ...], text: str = "text", k: int = SAMPLES, sharpness: float = SHARPNESS) -> DataFrame:
    """``keep`` columns (the row key) with up to ``k`` rows of ids, log probability, perturbed value and inclusion score."""
    rows = texts.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    added = "sample int, ids array<int>, log_probability double, perturbed double, log_inclusion double"
    return map_batches(rows, lambda batches: _sample(batches, model, k, sharpness), f"{schema}, {added}")

