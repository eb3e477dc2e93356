"""Repeated passages by suffix sorting of shards.

Every window of ``LENGTH`` bytes has an anchor, the least-hashed ``SEED`` bytes in it, which depends on the window alone; so
windows with equal bytes have equal anchors and meet in the anchor's shard. A run of windows with one anchor
is a segment. Blocks of documents first ask which anchors occur in more than one document, then send their distinct segments with such
an anchor (with the smallest document that holds each) to the shards. A shard whose segments differ sorts their
suffixes by induction (``induced``); suffixes that share ``LENGTH`` bytes with their neighbour form a class, and the
smallest document of each class goes back to the blocks, where every document compares itself with it.

Blocks pre-aggregate, so a passage in very many documents costs a shard one entry for each block. All steps are
exact but for 64-bit hashes standing for anchors and segments.

Defined results: a null text is empty; texts under ``LENGTH`` bytes lose nothing; rows with equal doc_ids never
remove from each other; a null doc_id counts as larger than any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import blocks as bl
from termweave.llm import induced
from termweave.llm import textbytes as tb

LENGTH = 50
SEED = 22
#: Bytes of documents for each shard.
SHARD_BYTES = 3 << 20
#: Bytes of a shard that are sorted together; only the segments of one anchor can go beyond.
PART_BYTES = 1 << 19
#: Segments of a block whose windows are looked at together.
AT_ONCE = 1 << 16
_NO_ID = np.iinfo(np.int64).max
_POSITION = (1 << 20) - 1


class Segments:
    """Runs of windows with one anchor, in the order of the block: document, first window, number of windows, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        found = [self._part(data, offsets, low, high) for low, high in _stretches(len(data))]
        self.doc, self.start, self.count, self.anchor, self.content = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2

    @staticmethod
    def _part(data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
        """Segments of the windows that start at low..high; they may be cut at these borders, which only adds segments."""
        part = data[low : min(high + LENGTH - 1, len(data))]
        n = len(part) - LENGTH + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        sums = tb.prefix_sums(part)
        at = np.arange(len(part) - SEED + 1)
        hashes = tb.mix(tb.span_hashes(sums, at, at + SEED))
        keys = (hashes & np.uint64(~_POSITION & (2**64 - 1))) | at.astype(np.uint64)
        least = tb.sliding_min(keys, LENGTH - SEED + 1)[:n]
        anchor = (least & np.uint64(_POSITION)).astype(np.int64)
        first = int(np.searchsorted(offsets, low, "right")) - 1
        last = int(np.searchsorted(offsets, low + n, "left"))
        begins = np.clip(offsets[first:last] - low, 0, n)
        ends = np.clip(offsets[first + 1 : last + 1] - (LENGTH - 1) - low, begins, n)
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, begins, 1)
        np.add.at(mark, ends, -1)
        inside = np.cumsum(mark[:-1]) > 0
        change = np.ones(n, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        cuts = np.flatnonzero(change)
        stops = np.append(cuts[1:], n)
        kept = inside[cuts]
        cuts, stops = cuts[kept], stops[kept]
        place = anchor[cuts]
        content = tb.span_hashes(sums, cuts, stops + LENGTH - 1)
        content = tb.mix(content + (place - cuts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (stops - cuts).astype(np.uint64))
        doc = np.searchsorted(offsets, cuts + low, "right") - 1
        return doc, cuts + low, stops - cuts, hashes[place], content


def _stretches(n: int) -> list[tuple[int, int]]:
    return [(k, min(k + tb.SLICE, n)) for k in range(0, n, tb.SLICE)]


def _narrow(hashes: np.ndarray) -> bytes:
    """The upper six bytes of each hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _widened(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Equal for hashes that agree in their upper six bytes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _anchors(segments: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors (their upper six bytes) in order, and whether two documents of the block hold one."""
    anchor = segments.anchor & np.uint64(2**64 - 65536)
    order = np.argsort(anchor, kind="stable")
    sorted_, doc = anchor[order], segments.doc[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.flatnonzero(new)
    # The order is stable and documents ascend, so the first and last of a group tell.
    last = np.append(first[1:], len(order)) - 1
    return sorted_[first], doc[first] != doc[last] if len(first) else np.zeros(0, bool)


def _table(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.values())], names=list(schema))


_ASK = {"bucket": pa.int64(), "block": pa.int64(), "keys": pa.binary(), "several": pa.binary()}
_REPLY = {"block": pa.int64(), "bucket": pa.int64(), "shared": pa.binary()}
_SEND = {"bucket": pa.int64(), "block": pa.int64(), "content": pa.binary(), "anchor": pa.binary(), "least": pa.binary(), "most": pa.binary(), "windows": pa.binary(), "n_bytes": pa.int64(), "packed": pa.binary()}
_ANSWER = {"block": pa.int64(), "content": pa.binary(), "count": pa.binary(), "least": pa.binary()}
_NAMES = {pa.int64(): "long", pa.binary(): "binary"}


def _ddl(schema: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {_NAMES[v]}" for k, v in schema.items())


def _ask(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for row in bl.each(batches):
        _, data, offsets = bl.opened(row)
        keys, several = _anchors(Segments(data, offsets))
        cuts = np.searchsorted(_bucket(keys, n), np.arange(n + 1))
        rows = [(k, row["block"], _narrow(keys[a:b]), np.packbits(several[a:b]).tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        yield _table(rows, _ASK)


def _shared(table: pa.Table) -> pa.Table:
    """For each block that asked: which of its anchors another document holds as well."""
    rows = table.to_pylist()
    keys = [_widened(r["keys"]) for r in rows]
    several = [np.unpackbits(np.frombuffer(r["several"], np.uint8))[: len(k)].astype(bool) for r, k in zip(rows, keys)]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(k[s] for k, s in zip(keys, several))]))
    out = []
    for r, k in zip(rows, keys):
        if len(twice):
            at = np.minimum(np.searchsorted(twice, k), len(twice) - 1)
            hit = twice[at] == k
            if hit.any():
                out.append((r["block"], r["bucket"], np.packbits(hit).tobytes()))
    return pa.Table.from_batches([_table(out, _REPLY)])


def _candidates(segments: Segments, replies: list[dict], n: int) -> np.ndarray:
    """Which segments have an anchor that several documents hold."""
    keys, _ = _anchors(segments)
    cuts = np.searchsorted(_bucket(keys, n), np.arange(n + 1))
    shared = np.zeros(len(keys), bool)
    for r in replies:
        a, b = cuts[r["bucket"]], cuts[r["bucket"] + 1]
        shared[a:b] = np.unpackbits(np.frombuffer(r["shared"], np.uint8))[: b - a]
    return shared[np.searchsorted(keys, segments.anchor & np.uint64(2**64 - 65536))]


def _ids(values: list) -> np.ndarray:
    return np.array([_NO_ID if v is None else v for v in values], np.int64)


def _send(left: pa.Table, right: pa.Table, n: int) -> pa.Table:
    """A block's distinct segments with shared anchors, with their bytes and the smallest and largest document here."""
    rows = []
    for row in left.to_pylist():
        ids, data, offsets = bl.opened(row)
        segments = Segments(data, offsets)
        some = np.flatnonzero(_candidates(segments, right.to_pylist(), n))
        own = _ids(ids)[segments.doc[some]]
        order = np.lexsort([own, segments.content[some], _bucket(segments.anchor[some], n)])
        some, own = some[order], own[order]
        content = segments.content[some]
        new = np.ones(len(some), bool)
        new[1:] = content[1:] != content[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(some)) - 1
        some, least, most = some[first], own[first], own[last] if len(first) else own
        bucket = _bucket(segments.anchor[some], n)
        cuts = np.searchsorted(bucket, np.arange(n + 1))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                pick = some[a:b]
                spans = [data[s : s + c + LENGTH - 1] for s, c in zip(segments.start[pick], segments.count[pick])]
                raw = np.concatenate(spans).tobytes()
                packed = pa.compress(raw, codec="zstd", asbytes=True)
                rows.append((k, row["block"], segments.content[pick].tobytes(), segments.anchor[pick].tobytes(), least[a:b].tobytes(), most[a:b].tobytes(), segments.count[pick].astype(np.uint8).tobytes(), len(raw), packed))
    return pa.Table.from_batches([_table(rows, _SEND)])


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each entry, ``counts`` numbers each, in a row."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _classes(text: np.ndarray, begin: np.ndarray, windows: np.ndarray, place: np.ndarray, by_window: np.ndarray) -> None:
    """Give all windows with the same bytes, in the segments at ``begin``, the smallest document among them."""
    lengths = windows + LENGTH - 1
    shard = text[_spread(begin, lengths)]
    slot_of = np.full(len(shard), -1, np.int64)
    slot_of[_spread(np.cumsum(lengths) - lengths, windows)] = _spread(place, windows)
    suffixes = induced.suffix_array(shard, LENGTH)
    suffixes = suffixes[slot_of[suffixes] >= 0]
    heads = np.flatnonzero(induced.common_prefixes(shard, suffixes, LENGTH) < LENGTH)
    slots = slot_of[suffixes]
    smallest = np.minimum.reduceat(by_window[slots], heads)
    by_window[slots] = np.repeat(smallest, np.diff(np.append(heads, len(slots))))


def _settle(table: pa.Table) -> pa.Table:
    """For each block: its segments of which some window starts in a smaller document, and the smallest one by window."""
    rows = table.to_pylist()
    read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
    content, anchor, least, most, windows = read("content", np.uint64), read("anchor", np.uint64), read("least", np.int64), read("most", np.int64), read("windows", np.uint8).astype(np.int64)
    source = np.repeat(np.arange(len(rows)), [len(r["windows"]) for r in rows])
    text = np.concatenate([np.frombuffer(pa.decompress(r["packed"], decompressed_size=r["n_bytes"], codec="zstd", asbytes=True), np.uint8) for r in rows])
    begin = np.cumsum(windows + LENGTH - 1) - (windows + LENGTH - 1)
    # One of each distinct segment, with the smallest document of all.
    order = np.lexsort([least, content, anchor])
    new = np.ones(len(order), bool)
    new[1:] = content[order][1:] != content[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    unique = order[new]
    mins = least[unique]
    first_of = np.ones(len(unique), bool)
    first_of[1:] = anchor[unique][1:] != anchor[unique][:-1]
    sizes = np.diff(np.append(np.flatnonzero(first_of), len(unique)))
    mixed = np.repeat(sizes > 1, sizes)
    slots = np.where(mixed, windows[unique], 1)  # an anchor's only segment needs no windows
    place = np.cumsum(slots) - slots
    by_window = np.repeat(mins, slots)
    lengths = windows[unique] + LENGTH - 1
    heads = np.flatnonzero(first_of)
    edges = np.append(heads, len(unique))
    # Segments with different anchors share no window, so a shard is sorted in parts of whole anchors.
    upto = np.cumsum(np.where(mixed, lengths, 0))
    at = 0
    while at < len(heads):
        low = upto[edges[at] - 1] if edges[at] else 0
        to = max(int(np.searchsorted(upto[edges[1:] - 1], low + PART_BYTES, "right")), at + 1)
        chosen = edges[at] + np.flatnonzero(mixed[edges[at] : edges[to]])
        at = to
        if len(chosen):
            _classes(text, begin[unique[chosen]], windows[unique[chosen]], place[chosen], by_window)
    lowest = np.minimum.reduceat(by_window, place)
    highest = np.maximum.reduceat(by_window, place)
    out = []
    for k, r in enumerate(rows):
        own = np.flatnonzero(source == k)
        own = own[lowest[group[own]] < most[own]]
        if not len(own):
            continue
        g = group[own]
        plain = lowest[g] == highest[g]
        count = np.where(plain, 1, windows[own])
        values = by_window[np.repeat(place[g] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        out.append((r["block"], content[own].tobytes(), np.where(plain, 0, count).astype(np.uint8).tobytes(), values.tobytes()))
    return pa.Table.from_batches([_table(out, _ANSWER)])


def removed_spans(ids: list, data: np.ndarray, offsets: np.ndarray, answers: list[dict]) -> np.ndarray:
    """Maximal runs of removed bytes in a block, as rows (start, end)."""
    if not answers:
        return np.zeros((0, 2), np.int64)
    content = np.concatenate([np.frombuffer(r["content"], np.uint64) for r in answers])
    count = np.concatenate([np.frombuffer(r["count"], np.uint8) for r in answers]).astype(np.int64)
    least = np.concatenate([np.frombuffer(r["least"], np.int64) for r in answers])
    place = np.cumsum(np.maximum(count, 1)) - np.maximum(count, 1)
    order = np.argsort(content)
    segments = Segments(data, offsets)
    at = order[np.minimum(np.searchsorted(content[order], segments.content), len(order) - 1)]
    some = np.flatnonzero(content[at] == segments.content)
    own, start, n, at = _ids(ids)[segments.doc[some]], segments.start[some], segments.count[some], at[some]
    # One smallest document for the whole segment: all of it goes, or nothing.
    whole = (count[at] == 0) & (least[place[at]] < own)
    found = [np.stack([start[whole], start[whole] + n[whole] - 1 + LENGTH], 1)]
    for k in range(0, len(some), AT_ONCE):
        few = k + np.flatnonzero(count[at[k : k + AT_ONCE]] > 0)
        by_window = least[_spread(place[at[few]], n[few])] < np.repeat(own[few], n[few])
        first = _spread(start[few], n[few])[by_window]
        found.append(np.stack([first, first + LENGTH], 1))
    return _merged(np.concatenate(found), offsets)


def _merged(spans: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Maximal runs of spans that overlap or touch within a text."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    doc = np.searchsorted(offsets, spans[:, 0], "right")
    new = np.ones(len(spans), bool)
    new[1:] = (spans[1:, 0] > reach[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


_RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _finish(left: pa.Table, right: pa.Table, with_text: bool) -> pa.Table:
    done = []
    for k in range(left.num_rows):
        block = left.slice(k, 1)
        carried = block.column("carried").combine_chunks().flatten() if "carried" in block.column_names else None
        row = block.select([c for c in block.column_names if c != "carried"]).to_pylist()[0]
        ids, data, offsets = bl.opened(row)
        spans = removed_spans(ids, data, offsets, right.to_pylist())
        cuts = np.searchsorted(spans[:, 0], offsets)
        out = []
        for k, key in enumerate(ids):
            own = spans[cuts[k] : cuts[k + 1]]
            borders = [offsets[k], *own.ravel(), offsets[k + 1]]
            kept = b"".join(data[a:b].tobytes() for a, b in zip(borders[::2], borders[1::2]))
            n = int(offsets[k + 1] - offsets[k])
            out.append((key, n, n - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
        batch = _table(out, _RESULT)
        if carried is not None:
            names = [carried.type.field(i).name for i in range(carried.type.num_fields)]
            batch = pa.RecordBatch.from_arrays([*batch.columns, *carried.flatten()], names=[*_RESULT, *names])
        done.append(batch)
    return pa.Table.from_batches(done) if done else None


def without_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Sizes, removed bytes and runs, digest and (on demand) remaining text of each row, and the columns to carry.

    Bytes of a character that was cut in two are left out of the text, not of the digest.
    """
    spark = documents.sparkSession
    stored = bl.blocks(documents, key, text, carry)
    bare = stored.drop("carried")
    n = bl.bucket_count(spark, stored, "n_bytes", SHARD_BYTES)
    asked = bl.map_batches(bare, lambda batches: _ask(batches, n), _ddl(_ASK))
    replies = asked.groupBy("bucket").applyInArrow(_shared, _ddl(_REPLY))
    sent = bare.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda a, b: bl.released(_send(a, b, n)), _ddl(_SEND))
    answers = sent.groupBy("bucket").applyInArrow(lambda a: bl.released(_settle(a)), _ddl(_ANSWER))
    result = RESULT + "".join(f", `{c}` {documents.schema[c].dataType.simpleString()}" for c in carry)
    return stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: bl.released(_finish(a, b, with_text)), result)
