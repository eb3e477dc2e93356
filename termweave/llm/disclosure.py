"""Personal data, and the terms that give it away.

Patterns find emails, ip addresses, card and phone numbers. Each found value is a protected entity; it belongs to a class (a
domain, a subnet of 256, a number range) and a kind. From the corpus it is counted, over distinct whole texts, how often a term stands in
a text with an entity, its class and its kind (n_te), and how often each occurs at all (n_t, n_e; N texts). At each level
the pointwise mutual information log2(n_te N / (n_t n_e)) is taken as a share of the level's own information log2(N / n_e): 1 means
the term occurs only there. Most values stand in one text, which proves nothing, so a share is shrunk towards that of
the next wider level: n texts of evidence leave ``DOUBT`` ** n of its weight to the wider level, which counts only what it has seen
beyond the narrower one, and beyond the kind there is 0. A term discloses an entity by that shrunken share. In all texts with that
entity, terms are removed (kind ``term``) from ``REMOVE`` upwards, generalised to their class (kind ``general``)
from ``GENERALISE`` upwards.

Defined results: a null text is empty and has no spans; repeated rows count as one text and are all treated;
several marks on one word leave the stronger one; an empty table gives no rows; columns not named in ``keep``
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import textbytes as tb
from termweave.llm.blocks import map_batches, renamed, restored, stored

KINDS = ("email", "ip", "card", "phone", "term", "general")
DOUBT = 1 / 3
REMOVE, GENERALISE = 0.95, 0.8
#: Bits of the filters that spare counting terms nobody asks about and naming texts without copies; a full filter costs
#: time, not results.
FILTER_BITS = 1 << 22
#: Bytes of texts that are taken apart together; only a single longer text goes beyond.
TOGETHER = 4 * tb.SLICE

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start at the first digit of a run: an earlier match ends at the end of one.
_ip = re.compile(r"(?<![0-9])[0-9]+((?:\.[0-9]+){3})")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_word = re.compile(r"[^\x20\x09-\x0D]+")
_digit = re.compile(r"[0-9]")
_not_digit = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        found = _domain.match(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of the four patterns by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if not _digit.search(text):
        return out
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _not_digit.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 10 <= len(_not_digit.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def class_of(kind: int, value: str) -> str:
    """Domain of an email, subnet of an ip address, issuer of a card, number range of a phone."""
    if kind < 2:
        return value.partition("@")[2] if kind == 0 else value.rpartition(".")[0]
    digits = _not_digit.sub("", value)
    return digits[:6] if kind == 2 else digits[:-4]


_SCAN = "text_hash long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, entities array<struct<value:long,class:long,kind:int>>, words array<struct<term:long,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_ENTITY = pa.list_(pa.struct([("value", pa.int64()), ("class", pa.int64()), ("kind", pa.int32())]))
_WORDS = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _parted(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some bytes of text."""
    for batch in batches:
        for i, j in tb.pieces(tb.columns(batch.column(text))[1], TOGETHER):
            yield batch.slice(i, j - i)


def _scan(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``width`` carried columns, then the text; adds what the patterns hold, and the other words of texts with an entity."""
    for batch in _parted(batches, width):
        rows, words = [], []
        for text in batch.column(width).to_pylist():
            text = text or ""
            spans = base_spans(text)
            found = {(k, text[a:b].lower()) for a, k, b in spans}
            entities = sorted((_text_hash(f"{KINDS[k]}:{v}"), _text_hash(f"{KINDS[k]}/{class_of(k, v)}"), k) for k, v in found)
            others = []
            for m in _word.finditer(text) if spans else ():
                x, y = m.span()
                if any(map(str.isalpha, m[0])) and not any(p < y and x < q for p, _, q in _around(spans, x, y)):
                    others.append((len(words), x, y))
                    words.append(m[0])
            rows.append((_text_hash(text), hashlib.sha256(written(spans).encode()).hexdigest(), spans, entities, others))
        raw = " ".join(words).encode()
        hashes = tb.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].view(np.int64)
        columns = list(zip(*rows)) if rows else [()] * 5
        spans = [[{"start": a, "kind": k, "end": b} for a, k, b in r] for r in columns[2]]
        entities = [[{"value": v, "class": c, "kind": k} for v, c, k in r] for r in columns[3]]
        others = [[{"term": int(hashes[i]), "start": a, "end": b} for i, a, b in r] for r in columns[4]]
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(spans, _SPAN), pa.array(entities, _ENTITY), pa.array(others, _WORDS)]
        names = ["text_hash", "base_sha256", "base", "entities", "words"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], names=[*batch.schema.names[:width], *names])


def _around(spans: list[tuple[int, int, int]], a: int, b: int) -> list[tuple[int, int, int]]:
    """Spans that may touch a..b; spans of one kind never overlap, so few start before b and reach a."""
    import bisect

    i = bisect.bisect_left(spans, (b, -1, -1))
    return spans[max(i - 8, 0) : i]


def _positions(hashes: np.ndarray) -> list[np.ndarray]:
    bits = FILTER_BITS.bit_length() - 1
    return [((hashes >> np.uint64(s)) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for s in (0, bits, 64 - bits)]


def _filter_of(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over the terms, gathered 32 bits at a time."""
    bits = FILTER_BITS.bit_length() - 1
    places = F.array(*[F.shiftrightunsigned("term", s).bitwiseAND(F.lit(FILTER_BITS - 1)) for s in (0, bits, 64 - bits)])
    put = terms.select(F.explode(places).alias("at"))
    words = put.groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 32 as int))) AS bits"))
    out = np.zeros(FILTER_BITS, bool)
    for word, value in words.toPandas().itertuples(index=False):
        for k in range(32):
            if int(value) >> k & 1:
                out[int(word) * 32 + k] = True
    return out


def _hits(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([known[p] for p in _positions(hashes)]) if len(hashes) else np.zeros(0, bool)


def _count_terms(batches: Iterator[pa.RecordBatch], wanted, repeated) -> Iterator[pa.RecordBatch]:
    """Counts of terms in texts that stand in one row only, and (term, text) for texts that may stand in several."""
    known, several = (np.unpackbits(b.value).astype(bool) for b in (wanted, repeated))
    for batch in batches:
        data, offsets = tb.columns(batch.column(0))
        for i, j in tb.pieces(offsets, 4 * tb.SLICE):
            part = offsets[i : j + 1] - offsets[i]
            hashes, _, _, counts = tb.word_hashes(data[offsets[i] : offsets[j]], part)
            hit = _hits(hashes, known)
            owner = np.repeat(np.arange(j - i), counts)[hit]
            pairs = np.unique(np.stack([owner.astype(np.int64), hashes[hit].view(np.int64)], 1), axis=0) if hit.any() else np.zeros((0, 2), np.int64)
            texts = np.zeros(j - i, np.int64)
            for k in np.unique(pairs[:, 0]):
                texts[k] = _text_hash(batch.column(0)[i + int(k)].as_py() or "")
            shared = _hits(texts.view(np.uint64), several)[pairs[:, 0]]
            terms, n = np.unique(pairs[~shared, 1], return_counts=True)
            named = pa.concat_arrays([pa.nulls(len(terms), pa.int64()), pa.array(texts[pairs[shared, 0]])])
            numbers = np.concatenate([n, np.ones(int(shared.sum()), np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([terms, pairs[shared, 1]])), named, pa.array(numbers)], names=["term", "text_hash", "n"])


def _only(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """Leaves the terms (or words) in the last column that the filter may hold."""
    known = np.unpackbits(wanted.value).astype(bool)
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        items = lists.flatten()
        terms = np.asarray(items.field("term") if pa.types.is_struct(items.type) else items).astype(np.int64)
        hit = _hits(terms.view(np.uint64), known)
        until = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)]
        left = pa.ListArray.from_arrays(pa.array(until.astype(np.int32)), items.filter(pa.array(hit)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], left], names=batch.schema.names)


def _share(n_te: str, n_e: str, n: float):
    """Mutual information of a term and a level as a share of the level's information."""
    information = F.log2(F.lit(n) / F.col(n_e))
    return F.when(information > 0, F.log2(F.col(n_te) * F.lit(n) / (F.col("n_t") * F.col(n_e))) / information).otherwise(0.0)


def _trust(evidence):
    return 1 - F.pow(F.lit(DOUBT), evidence)


def _able(n: float):
    """Whether a term of ``n_t`` texts, ``t_kind`` of them with the kind, can reach ``GENERALISE`` for any entity of the kind.

    At each level n_te is at most t_kind and n_e at least n_te, so no share is above log2(N / n_t) / log2(N / t_kind); the weights
    of the three shares add up to 1 - DOUBT ** t_kind, whatever the value and the class.
    """
    return _trust(F.col("t_kind")) * F.log2(F.lit(n) / F.col("n_t")) >= (GENERALISE - 1e-9) * F.log2(F.lit(n) / F.col("t_kind"))


def disclosing(scanned: DataFrame, texts: DataFrame, text: str = "text") -> tuple[DataFrame, Broadcast]:
    """(text_hash, term) with the largest ``disclosure`` of the term about an entity of the text, from ``GENERALISE`` upwards.

    With it comes a filter that holds these terms, and few others.
    """
    n = float(max(scanned.select("text_hash").distinct().count(), 1))
    one = scanned.filter(F.size("entities") > 0).select("text_hash", "entities", F.expr("array_distinct(words.term)").alias("terms"))
    one = stored(one.dropDuplicates(["text_hash"]), "once")
    level = lambda name: one.select(F.explode(F.array_distinct(F.col(f"entities.{name}"))).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    # One text of a kind alone reaches 1 - DOUBT at most, which marks nothing.
    kinds = one.select(F.explode(F.array_distinct("entities.kind")).alias("kind"), "terms").select("kind", F.explode("terms").alias("term"))
    kinds = stored(kinds.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("t_kind")).filter("t_kind > 1"), "kinds")
    broadcast = scanned.sparkSession.sparkContext.broadcast
    wanted = broadcast(np.packbits(_filter_of(kinds.select("term").distinct())))
    copied = scanned.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = broadcast(np.packbits(_filter_of(copied.select(F.col("text_hash").alias("term")))))
    seen = map_batches(texts.select(F.col(text).cast("string")), lambda batches: _count_terms(batches, wanted, repeated), "term long, text_hash long, n long")
    # The rows without a text add up before the shuffle; a copied text counts once.
    seen = seen.groupBy("term", "text_hash").agg(F.sum("n").alias("n"))
    terms = seen.groupBy("term").agg(F.sum(F.when(F.col("text_hash").isNull(), F.col("n")).otherwise(1)).alias("n_t"))
    able = stored(kinds.join(terms, "term").filter(_able(n)).join(F.broadcast(level("kind")), "kind"), "able")
    left = broadcast(np.packbits(_filter_of(able.select("term").distinct())))
    few = map_batches(one, lambda batches: _only(batches, left), "text_hash long, entities array<struct<value:long,class:long,kind:int>>, terms array<long>")
    few = stored(few.filter(F.size("terms") > 0), "few")
    classes = few.select(F.explode(F.expr("array_distinct(transform(entities, e -> e.class))")).alias("class"), "terms").select("class", F.explode("terms").alias("term"))
    classes = classes.groupBy("class", "term").agg(F.count(F.lit(1)).alias("t_class"))
    pairs = few.select("text_hash", F.explode("entities").alias("e"), "terms").select("text_hash", "e.*", F.explode("terms").alias("term"))
    values = pairs.groupBy("value", "class", "kind", "term").agg(F.count(F.lit(1)).alias("t_value"))
    scored = values.join(able, ["kind", "term"]).join(classes, ["class", "term"]).join(level("value"), "value").join(level("class"), "class")
    kind = _trust(F.col("t_kind") - F.col("t_class")) * _share("t_kind", "n_kind", n)
    trust = _trust(F.col("t_class") - F.col("t_value"))
    wider = trust * _share("t_class", "n_class", n) + (1 - trust) * kind
    trust = _trust(F.col("t_value"))
    scored = scored.withColumn("disclosure", trust * _share("t_value", "n_value", n) + (1 - trust) * wider)
    scored = scored.filter(F.col("disclosure") >= GENERALISE).select("value", "term", "disclosure")
    return pairs.join(scored, ["value", "term"]).groupBy("text_hash", "term").agg(F.max("disclosure").alias("disclosure")), left


def find(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with ``base_sha256`` and ``found``, the spans (start, kind, end, mark) of each row in order.

    ``kind`` is a place in ``KINDS``. Only rows with an entity are joined with the marks, with the words that may be marked.
    """
    rows = documents.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    width = len(keep)
    scanned = stored(map_batches(rows, lambda batches: _scan(batches, width), f"{kept}, {_SCAN}"), "scanned")
    kind = F.when(F.col("disclosure") >= REMOVE, KINDS.index("term")).otherwise(KINDS.index("general"))
    marks, terms = disclosing(scanned.select("text_hash", "entities", "words"), documents, text)
    marks = marks.groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", kind))).alias("marks"))
    names = [*keep, "base_sha256", "found"]
    plain = scanned.filter(F.size("entities") == 0).withColumn("found", F.col("base"))
    joined = scanned.filter(F.size("entities") > 0).select(*keep, "text_hash", "base_sha256", "base", "words")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields)
    joined = map_batches(joined, lambda batches: _only(batches, terms), schema).join(marks, "text_hash", "left")
    marked = F.expr("transform(filter(words, w -> marks[w.term] is not null), w -> struct(w.start AS start, marks[w.term] AS kind, w.end AS end))")
    joined = joined.withColumn("found", F.sort_array(F.when(F.col("marks").isNull(), F.col("base")).otherwise(F.concat("base", marked))))
    return plain.select(*names).unionByName(joined.select(*names))


def count_of(kind: str):
    return F.size(F.filter("found", lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def spans_text():
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform("found", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def _replace(batches: Iterator[pa.RecordBatch], text: int, found: int) -> Iterator[pa.RecordBatch]:
    for batch in _parted(batches, text):
        out = []
        for value, spans in zip(batch.column(text).to_pylist(), batch.column(found).to_pylist()):
            if not spans:
                out.append(value)
                continue
            parts, at = [], 0
            for s in spans:
                if s["start"] < at:  # overlaps what has been replaced already
                    at = max(at, s["end"])
                    continue
                word = value[s["start"] : s["end"]]
                label = KINDS[s["kind"]]
                parts += [value[at : s["start"]], ("[NUMBER]" if any(map(str.isdigit, word)) else "[WORD]") if label == "general" else f"[{label.upper()}]"]
                at = s["end"]
            out.append("".join([*parts, value[at:]]))
        columns = list(batch.columns)
        columns[text] = pa.array(out, pa.string())
        del columns[found]
        yield pa.RecordBatch.from_arrays(columns, names=[n for i, n in enumerate(batch.schema.names) if i != found])


def sanitised(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced: by its kind, or a generalised term by its class. A null text stays null."""
    rows, names = renamed(documents)
    columns = rows.columns
    found = find(rows, keep=tuple(columns), text=names[text]).select(*columns, "found")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    place, last = columns.index(names[text]), len(columns)
    return restored(map_batches(found, lambda batches: _replace(batches, place, last), schema), names)
