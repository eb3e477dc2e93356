"""Every operator against brute force, on awkward rows: nulls, empty and long texts, repeated rows, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from termweave.llm import bin_slack, blocks, disclosure, induced, language_ppm, ngram_trie, odd_sketches, queries, rare_features, repeats, sampled_pieces, textbytes, url_rules, weak_rules
from termweave.runtime import small_table
from tests import oracle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, near string, uid int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    syllables = "the and ing er on der ung que les ción".split()
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)) + "."
    base, passage = prose(120), prose(60)
    texts = [None, "", " \n\t", base, base, base + " tail", base.replace("the", "THE", 1), "é", "...", prose(3000), passage + "\n" + prose(40), prose(40) + passage]
    texts += ["x@y.example.com wrote " + prose(30), "a" * 5000, "line one two\n" * 12, "漢字 🙂 " * 30, "secretword 8.8.8.8 " + prose(25), "secretword 8.8.8.8 " + prose(26), "secretword 8.8.8.8 " + prose(27)]
    texts += [prose(rng.randint(1, 200)) for _ in range(30)]
    out = [(k, t, "en" if k % 3 else None, None, len(t or ""), "clash", "clash", 1) for k, t in enumerate(texts)]
    return [*out, out[9], (None, prose(50), "en", "s", 5, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return small_table(spark, rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return small_table(spark, [], SCHEMA)


def test_url_rules(spark):
    rules = small_table(spark, queries.URL_RULES, "host string, path string, verdict string")
    urls = ["http://A.Example.NET/en/x?q", "http://example.net/de/", "https://x.example.com/de", "https://x.example.com/de/", "a.org/fr/", "x://org/fr/", "x://y.org/fr/a#b", "http://net", "http://net/", "://", None, "http://notexample.com/de/", "http://a..net/", "http://net/"]
    pages = small_table(spark, [(k, u, "no") for k, u in enumerate(urls)] + [(0, urls[0], "no")], "page_id long, url string, rule string")
    want = []
    for k, u in [*enumerate(urls), (0, urls[0])]:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [r for r in queries.URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=(None, "", "allow"))
        want.append((k, host, path, best[0] and best[0] + best[1], best[2]))
    got = [tuple(r) for r in url_rules.judge(pages, rules).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r["verdict"] for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}
    odd = small_table(spark, [("example.net", "/en/x", "block")], "host string, path string, verdict string")
    assert [r["page_id"] for r in url_rules.judge(pages.distinct(), odd).filter("verdict = 'block'").collect()] == [0]


def test_long_urls_are_expanded_as_deep_as_the_rules(spark):
    rules = small_table(spark, [("b.c", "/x/y/", "block"), ("c", "/", "allow"), ("b.c", "/x/yy", "block")], "host string, path string, verdict string")
    deep = "a." * 100 + "b.c"
    urls = [
        (1, f"http://{deep}/x/y/" + "z/" * 5000),
        (2, f"http://{deep}/x/yyy" + "/z" * 5000),
        (3, "http://b.c" + "/x" * 5000),
        (4, "http://" + "b.c." * 100 + "d/x/y/"),
        (5, "http://c"),
        (6, "http://B.C/x/y/"),
    ]
    pages = small_table(spark, urls, "page_id long, url string")
    found = {r["page_id"]: r["rule"] for r in url_rules.judge(pages, rules).collect()}
    assert found == {1: "b.c/x/y/", 2: "b.c/x/yy", 3: "c/", 4: None, 5: None, 6: "b.c/x/y/"}
    assert url_rules.depths(rules) == (2, 3) and url_rules.depths(rules.limit(0)) == (1, 0)
    assert {r["rule"] for r in url_rules.judge(pages, rules.limit(0)).collect()} == {None}


def test_weak_rules(docs, empty, rows):
    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        twice = {i + k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)

    found = weak_rules.judge(docs).collect()
    got = sorted((repr(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found)
    assert got == sorted((repr(r[0]), *brute(r[1])) for r in rows)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in found)
    assert any(r["kept"] for r in found)
    assert weak_rules.judge(empty).count() == 0


def test_language(docs, empty, rows):
    found = language_ppm.identify(docs).collect()
    assert len(found) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text[r["doc_id"]] or ""))) and 0 <= r["score"] <= 1
    assert language_ppm.identify(empty).count() == 0


def test_a_language_in_one_long_text_is_learned(spark, monkeypatch):
    """Beside many short texts; of equal codes the first language by name wins."""
    alphabets = {f"l{k}": "abcdefghijklmnopqrstuvwx"[3 * k : 3 * k + 3] for k in range(8)}
    rng = random.Random(2)
    long_texts = [(k, "".join(rng.choices(letters + " ", k=400_000)), lang) for k, (lang, letters) in enumerate(alphabets.items())]
    short = [(100 + k, f"the cat number {k} sat on the mat", "en") for k in range(200)]
    docs = small_table(spark, long_texts + short, "doc_id long, text string, lang string")
    trees = language_ppm.fit(docs, train_bytes=20_000)
    assert trees.languages == ("en", *alphabets)
    assert all(19_000 < counts.sum() <= 20_000 for counts in trees.counts[1:])
    asked = small_table(spark, [(lang, letters * 5) for lang, letters in alphabets.items()], "lang string, text string")
    monkeypatch.setattr(language_ppm, "TOGETHER", 20)
    found = language_ppm.predict(asked, trees, ("lang", "text")).collect()
    assert all(r["lang_pred"] == r["lang"] and r["text"] == alphabets[r["lang"]] * 5 for r in found) and len(found) == 8
    twins = language_ppm.fit(small_table(spark, [("b", "same text"), ("a", "same text")], "lang string, text string"))
    assert [r["lang_pred"] for r in language_ppm.predict(asked, twins, ("lang",)).collect()] == ["a"] * 8


def test_training_takes_about_the_bytes_wanted(spark):
    """Repeated texts count once."""
    texts = [(f"text number {k % 5000} of {'x' * (k % 7)}",) for k in range(10_000)]
    docs = small_table(spark, texts, "text string").selectExpr("text", "'en' AS lang")
    assert 20_000 <= language_ppm.fit(docs, train_bytes=20_000).counts[0].sum() < 25_000


def test_context_trees_give_exact_code_lengths(docs):
    trees = language_ppm.fit(docs)
    levels = [collections.defaultdict(collections.Counter) for _ in range(4)]
    for gram, n in zip(trees.grams[0].tolist(), trees.counts[0].tolist()):
        b = [(gram >> s) & 255 for s in (24, 16, 8, 0)]
        for k in range(4):
            levels[k][tuple(b[3 - k : 3])][b[3]] += n

    def bits(text):
        b, out = [0, 0, 0, *text.encode()], 0.0
        for i in range(3, len(b)):
            for k in (3, 2, 1, 0):
                after = levels[k].get(tuple(b[i - k : i]))
                if not after:
                    continue
                total = after.total() + len(after)
                if b[i] in after:
                    out += math.log2(total / after[b[i]])
                    break
                out += math.log2(total / len(after))
            else:
                out += 8
        return out

    import pyarrow as pa

    from termweave.llm import textbytes

    texts = ["the anding", "", "é", "漢 x", "Zzz the"]
    got = language_ppm.Compiled(trees).bits(*textbytes.columns(pa.array(texts)))[:, 0]
    assert np.allclose(got, [bits(t) for t in texts], atol=1e-3)


def test_disclosure(docs, empty, rows):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def brute(t):
        out = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(d) <= 19 and disclosure.luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                    continue
                out.append((m.start(), k, m.end()))
        return sorted(out)

    rng = random.Random(2)
    parts = ["1", "2", "25", ".", "@", "a", "b-", "+1", " ", "(", "-", "4111 1111 1111 1111", "x@y.z", "8.8.8.8", "é"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=20))
        assert disclosure.base_spans(t) == brute(t)
    found = {r["doc_id"]: r for r in disclosure.find(docs).withColumn("spans", disclosure.spans_text()).collect()}
    for r in rows:
        want = disclosure.written(brute(r[1] or ""))
        assert found[r[0]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    # A word that occurs only near one address gives it away; the address is found as well.
    assert found[16]["spans"].startswith("term:0:10,ip:11:18")
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(docs).filter("doc_id in (0, 12, 16)").collect()}
    assert clean[0] is None and clean[12].startswith("[EMAIL] wrote") and clean[16].startswith("[TERM] [IP]")
    assert disclosure.find(empty).count() == 0


def test_texts_are_searched_and_replaced_in_parts(rows):
    """A part is all that a task holds as Python values."""
    import pyarrow as pa

    texts = [f"{k} x{k}@y.example.com {r[1] or ''}" for k in range(40) for r in rows] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"]).slice(3)
    parts = list(disclosure._scan(iter([batch]), 1))
    assert len(parts) > 1
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(3, len(texts)))
    alone = [r for k in range(batch.num_rows) for p in disclosure._scan(iter([batch.slice(k, 1)]), 1) for r in p.to_pylist()]
    assert [r for p in parts for r in p.to_pylist()] == alone
    marked = pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays([p.column(3) for p in parts])], names=["k", "text", "found"])
    done = list(disclosure._replace(iter([marked]), 1, 2))
    assert len(done) > 1
    assert [x for p in done for x in p.column(1).to_pylist()] == [x for k in range(batch.num_rows) for p in disclosure._replace(iter([marked.slice(k, 1)]), 1, 2) for x in p.column(1).to_pylist()]


def test_a_worker_gives_memory_back_after_a_task(spark):
    """Freed memory below something that stays is not given back by itself."""
    stay = []

    def task(batches):
        arrays = [np.ones(7500) for _ in range(2000)]
        stay.append(arrays[-1])
        yield from batches

    held = lambda: int(re.search(r"Anonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1])
    frame = SimpleNamespace(sparkSession=spark, mapInArrow=lambda function, schema: list(function(iter([1, 2]))))
    before = held()
    assert blocks.map_batches(frame, task, "x long") == [1, 2]
    assert held() - before < 40_000


def test_terms_of_rare_entities_are_found_in_the_whole_text(spark):
    """Addresses that stand in one text each: what discloses them is told from their domain, anywhere in the text."""
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(n))
    texts = [f"projectname {filler(60)} signed user{k}@acme.example" for k in range(5)] + [f"hapax{k} {filler(60)} user{k}@other{k}.example" for k in range(5)]
    texts += [filler(40) + f" {k}" for k in range(300)]
    texts += [texts[0]] * 3
    table = small_table(spark, list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["found"] for r in disclosure.find(table).collect()}

    def share(n_te, n_t, n_e, n=310):
        return math.log2(n_te * n / (n_t * n_e)) / math.log2(n / n_e)

    # The class has five texts, four of them beyond the value; the kind has none beyond the class.
    d = disclosure.DOUBT
    want = (1 - d) * share(1, 5, 1) + d * (1 - d**4) * share(5, 5, 5)
    kind = disclosure.KINDS.index("term" if want >= disclosure.REMOVE else "general")
    assert want >= disclosure.GENERALISE
    for k in (0, 1, 2, 3, 4, 310, 312):
        assert (0, kind, len("projectname")) in [tuple(x) for x in found[k]]
    assert all(x["kind"] < 4 for k in range(5, 310) for x in found[k])


def test_disclosing_terms_against_all_shares(spark, monkeypatch):
    """Marks equal those from the shares of all terms; terms too common to reach them are left out before pairs are made."""
    rng = random.Random(11)
    value = lambda k: f"u{k % 5}@d{k % 5 % 2}.example"
    texts = [" ".join([*rng.choices([f"w{c}" for c in "abcdefghijklmnopqrst"], k=4), f"p{'qrst'[k % 3]} v{'abcde'[k % 5]} m{'abcdef'[k % 6]}", value(k), *([value(k + 1), f"z{'xy'[k % 2]}"] if k % 4 == 0 else [])]) for k in range(30)]
    texts += [" ".join([*rng.choices([f"w{c}" for c in "abcdefghij"], k=5), f"m{'abcdef'[k % 6]} {k}"]) for k in range(170)] + [f"pq alone {k}" for k in range(2)]
    table = small_table(spark, list(enumerate([*texts, None, texts[0]])), "doc_id long, text string")
    whole = {*texts, ""}
    n, doubt = len(whole), disclosure.DOUBT
    levels = lambda v: (("value", v), ("class", v.partition("@")[2]), ("kind", "email"))
    words = {t: {w for w in t.split() if any(map(str.isalpha, w)) and "@" not in w} for t in whole}
    values = {t: {w for w in t.split() if "@" in w} for t in whole}
    within = {}
    for t in whole:
        for at in {x for v in values[t] for x in levels(v)}:
            within.setdefault(at, set()).add(t)

    def disclosed(term, v):
        n_t = sum(term in words[t] for t in whole)
        total, left, seen = 0.0, 1.0, 0
        for at in levels(v):
            n_e, n_te = len(within[at]), sum(term in words[t] for t in within[at])
            share = math.log2(n_te * n / (n_t * n_e)) / math.log2(n / n_e)
            total += left * (1 - doubt ** (n_te - seen)) * share
            left, seen = left * doubt ** (n_te - seen), n_te
        return total

    def marks(t):
        best = {w: max(disclosed(w, v) for v in values[t]) for w in words[t]} if values[t] else {}
        return {(w, "term" if x >= disclosure.REMOVE else "general") for w, x in best.items() if x >= disclosure.GENERALISE}

    kept, plain = {}, disclosure.stored
    monkeypatch.setattr(disclosure, "stored", lambda df, name: kept.setdefault(name, plain(df, name)))
    found = {r["doc_id"]: r["found"] for r in disclosure.find(table).collect()}
    want = {k: marks(t) for k, t in enumerate([*texts, "", texts[0]])}
    assert {x for m in want.values() for _, x in m} == {"term", "general"}
    for k, t in enumerate([*texts, "", texts[0]]):
        assert {(t[x["start"] : x["end"]], disclosure.KINDS[x["kind"]]) for x in found[k] if x["kind"] > 3} == want[k]
    common = [w for w in {w for t in whole for w in words[t]} if sum(w in words[t] for t in whole) > 20 and sum(w in words[t] for t in within["kind", "email"]) < 8]
    raw = " ".join(common).encode()
    hashes = textbytes.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].view(np.int64).tolist()
    assert len(common) > 3 and not {r["term"] for r in kept["able"].collect()} & set(hashes)


def test_fingerprints(docs, empty, rows):
    found = rare_features.compare_with_next(docs).collect()
    line = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (key, text) in enumerate(line):
        new = rare_features.edited(text, line[(k + 1) % len(line)][1])
        want.append((repr(key), len(text), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found) == sorted(want)
    by = {r["doc_id"]: r for r in found}
    assert by[3]["fingerprint"] == by[4]["fingerprint"] and by[0]["fingerprint"] == "" == by[1]["fingerprint"]
    assert all(0 <= r[c] <= 1 for r in found for c in ("near_edited", "near_next"))
    same = rare_features.from_text(by[9]["fingerprint"])
    assert rare_features.likeness(same, same) == 1
    assert rare_features.compare_with_next(empty).count() == 0


def test_entropies_are_those_of_the_windows():
    data = np.random.default_rng(1).integers(0, 9, 500).astype(np.uint8)
    for i, e in enumerate(rare_features.entropies(data)):
        c = np.bincount(data[i : i + 64])
        c = c[c > 0]
        assert abs(e - 1000 * (6 - (c * np.log2(c)).sum() / 64) / 6) < 1.01


def pieces_are_right(found, texts, capacity):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    want = []
    for key, text in texts:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(repr(key), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)
    ends = collections.defaultdict(int)
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values(), default=0) <= capacity
    return len(ends)


def test_packing(docs, empty, rows):
    path = queries.tokenizer_path()
    found = bin_slack.pack(bin_slack.token_pieces(docs, path)).collect()
    bins = pieces_are_right(found, [(r[0], r[1]) for r in rows], 1024)
    assert bins <= -(-sum(r["length"] for r in found) // 1024) + 1
    assert bin_slack.pack(bin_slack.token_pieces(empty, path)).count() == 0


def test_special_tokens_in_a_text_have_their_own_id(spark):
    texts = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "don't  <|endoftext|><|endoftext|>\n <|endoftext|>  x"), (4, "<|endoftext"), (5, None)]
    docs = small_table(spark, texts, "doc_id long, text string")
    found = bin_slack.pack(bin_slack.token_pieces(docs, queries.tokenizer_path())).collect()
    pieces_are_right(found, texts, 1024)


def test_fullest_combination_is_the_fullest():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 60)
        reach = {0}
        for n, c in counts.items():
            reach = {s + n * k for s in reach for k in range(c + 1) if s + n * k <= room}
        chosen = bin_slack.fullest(counts, room)
        assert sum(n * k for n, k in chosen.items()) == max(reach) and all(k <= counts[n] for n, k in chosen.items())


def test_segments_do_not_depend_on_their_neighbours():
    segments = bin_slack.Segments(queries.tokenizer_path())
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "bc", "1", "!", "é", "'s", "x\n ", "\x1c", "漢", "abcž", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=15)) for _ in range(3000)]
    assert segments.ids(texts) == segments._encode(texts)


def test_runs_of_letters_are_encoded_many_at_a_time(monkeypatch):
    segments = bin_slack.Segments(queries.tokenizer_path())
    model, asked = segments.model, []

    def tokenize(text):
        asked.append(text)
        return model.tokenize(text)

    segments.model = SimpleNamespace(tokenize=tokenize)
    rng = random.Random(2)
    letters = ["a", "the", "ß", "é", "ÿ", "Ö", "qu", "ch", "Á"]
    runs = list({"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(2000)})
    texts = [" ".join(runs[i : i + 100]) for i in range(0, len(runs), 100)]
    assert segments.ids(texts) == segments._encode(texts)
    assert 0 < 10 * len(asked) < len(runs)
    # What is forgotten is learnt again.
    monkeypatch.setattr(bin_slack, "MEMORY", 150)
    for batch in (texts[:3], [], ["", " "], texts[2:5], [runs[0], "x " + runs[0] + "ž " + runs[1] + "\n 7"], texts):
        assert segments.ids(batch) == segments._encode(batch)
    assert len(segments.coded) == len(segments.number)
    # A worker that has done its task keeps nothing.
    rows = [pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])]
    assert sum(b.num_rows for b in bin_slack._cut_pieces(iter(rows), queries.tokenizer_path(), 1024)) >= len(texts)
    assert not bin_slack._segments(queries.tokenizer_path()).coded


def components_of(rows, size, percent):
    sets = {}
    for key, text in rows:
        w = words(text)
        sets[key] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_near_duplicates(docs, empty, rows):
    found = odd_sketches.near_duplicates(docs).collect()
    want = components_of([(r[0], r[1]) for r in rows if r[0] is not None], 3, 85)
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert odd_sketches.near_duplicates(empty).count() == 0


def test_many_near_copies_make_one_component(spark):
    rng = random.Random(8)
    base = [str(rng.random()) for _ in range(200)]
    texts = []
    for k in range(60):
        copy = list(base)
        copy[rng.randrange(200)] = "x" + str(k)
        copy[rng.randrange(200)] = "y" + str(k)
        texts.append((k, " ".join(copy)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in odd_sketches.near_duplicates(small_table(spark, texts, "doc_id long, text string")).collect()}
    assert got == components_of(texts, 3, 85)


def test_near_copies_far_from_the_smallest_id(spark):
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(150)]
    lines, texts = [base], []
    for k in range(90):
        copy = list(rng.choice(lines))
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(150)] = f"x{k}"
        lines.append(copy)
    rng.shuffle(lines)
    texts = [(k, " ".join(line)) for k, line in enumerate(lines)]
    want = components_of(texts, 3, 85)
    assert len({c for _, c in want.values()}) > 2
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in odd_sketches.near_duplicates(small_table(spark, texts, "doc_id long, text string")).collect()}
    assert got == want


def test_odd_sketch_estimates_the_difference():
    rng = np.random.default_rng(4)
    common, own = rng.integers(1, 2**63, 900, dtype=np.uint64), rng.integers(1, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, own[:100]])), np.unique(np.concatenate([common, own[100:]]))]
    a, b = odd_sketches.odd_sketches(odd_sketches.min_samples(sets, 80))
    assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= odd_sketches.differing_bits_allowed(0.8, 80)


def removed(rows):
    least = {}
    for key, text in rows:
        b, key = (text or "").encode(), math.inf if key is None else key
        for p in range(len(b) - 49):
            least[b[p : p + 50]] = min(key, least.get(b[p : p + 50], math.inf))
    out = []
    for key, text in rows:
        b, own = (text or "").encode(), math.inf if key is None else key
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < own:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((repr(key), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("part_bytes", [repeats.PART_BYTES, 500])
def test_repeats(docs, empty, rows, part_bytes, monkeypatch):
    monkeypatch.setattr(repeats, "PART_BYTES", part_bytes)
    found = repeats.without_repeats(docs).collect()
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == removed([(r[0], r[1]) for r in rows])
    assert repeats.without_repeats(empty).count() == 0


def test_suffixes_are_in_order_and_queues_spill():
    rng = random.Random(1)
    for _ in range(400):
        t = bytes(rng.randint(1, rng.choice([2, 3, 200])) for _ in range(rng.randint(0, 60)))
        order = induced.suffix_array(np.frombuffer(t, np.uint8), 8, in_memory=rng.choice([5, 1000])).tolist()
        assert sorted(order) == list(range(len(t)))
        assert all(t[a : a + 8] <= t[b : b + 8] for a, b in zip(order, order[1:]))


def test_language_model(docs, empty, rows):
    found = ngram_trie.score(docs).collect()
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    tokens = [(r[0], [*words(r[1]), None]) for r in rows]
    c, c2 = collections.Counter(), collections.Counter()
    for k, t in tokens:
        if not held(k):
            c.update(t)
            c2.update(zip([None, *t], t))
    n, v = c.total(), len(c)
    want = collections.defaultdict(list)
    for k, t in tokens:
        p = [(c[w] + 1) / (n + v + 1) for w in t]
        full = [(c2[a, w] + ngram_trie.WEIGHT * x) / (c[a] + ngram_trie.WEIGHT) for a, w, x in zip([None, *t], t, p)]
        want[k].append((held(k), len(t), sum(c[w] > 0 for w in t), n, sum(map(math.log10, p)), sum(map(math.log10, full))))
    assert len(found) == len(rows)
    for r in found:
        exact = want[r["doc_id"]][0]
        assert tuple(r)[1:5] == exact[:4]
        assert abs(r["base_score"] - exact[4]) < 1e-6 and abs(r["score"] - exact[5]) < 0.02 * abs(exact[5]) + 0.03
    assert ngram_trie.score(empty).count() == 0


def test_language_model_of_frequent_bigrams(spark, monkeypatch):
    """Contexts seen 5000 times and more: no probability above 1, and scores as exact as the codes."""
    monkeypatch.setattr(ngram_trie, "SALT_COUNT", 1000)
    texts = ["alpha beta gamma delta"] * 5300 + ["alpha beta " * 4600, "alpha one", "beta two three", "unseen gamma words"]
    table = small_table(spark, [(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    c, c2 = collections.Counter(), collections.Counter()
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            t = [*t.split(), None]
            c.update(t)
            c2.update(zip([None, *t], t))
    n, v, weight = c.total(), len(c), ngram_trie.WEIGHT
    assert min(x for _, x in c2.most_common(5)) >= 4500
    found = {r["doc_id"]: r for r in ngram_trie.score(table).collect()}
    for k in (0, *range(5299, len(texts))):
        t = [*texts[k].split(), None]
        exact = sum(math.log10((c2[a, w] + weight * (c[w] + 1) / (n + v + 1)) / (c[a] + weight)) for a, w in zip([None, *t], t))
        assert exact - len(t) / 4096 - 1e-6 <= found[k]["score"] <= exact + 1e-6 <= 0


def test_codes_round_down():
    counts = np.array([1_000_003, 5000, 4999, 4600, 129, 7, 1])
    exact = counts / counts.sum()
    p = ngram_trie.probabilities(ngram_trie.quantised(exact))
    assert (p <= exact * (1 + 1e-9)).all() and (p > exact * 0.999).all() and p.sum() <= 1
    assert ngram_trie.probabilities(ngram_trie.quantised(np.array([1.0])))[0] == 1


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 10), (50, 60), (1000, 1 << 48), (5000, 5001), (300, 1 << 20)):
        values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
        coded = ngram_trie.EliasFano.of(values, universe)
        wanted = np.concatenate([rng.integers(0, universe, 300).astype(np.uint64), values])
        at = np.searchsorted(values, wanted)
        assert (coded.successor(wanted) == at).all()
        assert (coded.find(wanted) == [i if i < n and values[i] == x else -1 for i, x in zip(at, wanted)]).all()
        assert n == 0 or (coded.get(np.arange(n)) == values).all()


def test_sampled_segmentations(docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sampled_pieces.pieces_of(path)
    found = sampled_pieces.encode_sampled(docs.filter("doc_id <> 9"), path, keep=("doc_id",)).collect()
    again = sampled_pieces.encode_sampled(docs.filter("doc_id <> 9").repartition(2), path, keep=("doc_id",)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    seen = set()
    for r in found:
        assert sampled_pieces.decode(r["ids"], pieces) == texts[r["doc_id"]] and r["log_inclusion"] <= 0
        assert (r["doc_id"], tuple(r["ids"])) not in seen
        seen.add((r["doc_id"], tuple(r["ids"])))
    # Inverse inclusion chances make the probabilities add up to one.
    total = [sum(math.exp(p - i) for _, p, _, i in sampled_pieces.samples("thing", pieces, 3, random.Random(s))) for s in range(1500)]
    assert abs(sum(total) / len(total) - 1) < 0.03
    assert sampled_pieces.encode_sampled(empty, path, keep=("doc_id",)).count() == 0


def test_sampled_segmentations_are_of_whole_documents(spark):
    import public_tokenizers

    folder = "/root/testdata/sf0.001"
    pieces = sampled_pieces.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    found = {(r["doc_id"], r["sample"]): (r["n_pieces"], r["ids_crc32"]) for r in queries.QUERIES["op7_sampled_pieces"](spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {k for k, _ in found} == set(texts)
    longest = max(texts, key=lambda k: len(texts[k]))
    for s, (ids, *_) in enumerate(sampled_pieces.samples(texts[longest], pieces, 3, sampled_pieces.row_random((longest,), texts[longest]))):
        assert found[longest, s] == (len(ids), zlib.crc32(" ".join(map(str, ids)).encode()))
        assert sampled_pieces.decode(ids, pieces) == texts[longest]


def segmentations_of(text, model, sharpness):
    """Every segmentation as ids with its log probability, by recursion over the text."""
    ids = {model.id_to_piece(i): i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))}
    byte = {model.id_to_piece(i): i for i in range(model.vocab_size()) if model.is_byte(i)}
    worst = min(model.get_score(i) for i in range(model.vocab_size()))
    whole = "▁" + text.replace("▁", "\ufffe").replace(" ", "▁")

    def ways(at):
        if at == len(whole):
            return [((), 0.0)]
        out = []
        for to in range(at + 1, len(whole) + 1):
            piece = whole[at:to]
            if piece in ids and "▁" not in piece.lstrip("▁"):
                out += [((ids[piece], *more), sharpness * model.get_score(ids[piece]) + w) for more, w in ways(to)]
            elif to == at + 1:
                raw = piece.replace("\ufffe", "▁").encode()
                out += [((*(byte[f"<0x{b:02X}>"] for b in raw), *more), sharpness * worst * len(raw) + w) for more, w in ways(to)]
        return out

    found = ways(0)
    top = max(w for _, w in found)
    total = top + math.log(sum(math.exp(w - top) for _, w in found))
    return {x: w - total for x, w in found}


@pytest.mark.parametrize("sharpness", [0.0004, 0.0])
def test_samples_against_all_segmentations(sharpness):
    import public_tokenizers

    pieces = sampled_pieces.pieces_of(public_tokenizers.path("piece_bpe_32k.model"), sharpness)
    for text in ("the", "a  b", "é▁漢", "on it"):
        want = segmentations_of(text, pieces.model, sharpness)
        for k in (1, 3, len(want) + 2):
            found = sampled_pieces.samples(text, pieces, k, random.Random(k))
            assert len({tuple(ids) for ids, *_ in found}) == len(found) == min(k, len(want))
            assert all(math.isclose(want[tuple(ids)], p, rel_tol=1e-9, abs_tol=1e-9) for ids, p, _, _ in found)
            assert [v for _, _, v, _ in found] == sorted((v for _, _, v, _ in found), reverse=True)
            assert k < len(want) or all(x == 0 for *_, x in found)
    # Without replacement: first and second draws have the chances of drawing one after the other.
    want, n = segmentations_of("thing", pieces.model, sharpness), 4000
    first, second = {}, {}
    for seed in range(n):
        found = sampled_pieces.samples("thing", pieces, 2, random.Random(seed))
        for seen, (ids, *_) in zip((first, second), found):
            seen[tuple(ids)] = seen.get(tuple(ids), 0) + 1
    for x, p in want.items():
        p = math.exp(p)
        later = sum(math.exp(q) * p / (1 - math.exp(q)) for y, q in want.items() if y != x) if len(want) > 1 else 0.0
        assert abs(first.get(x, 0) / n - p) <= 4 * math.sqrt(p * (1 - p) / n) + 1e-9
        assert abs(second.get(x, 0) / n - later) <= 4 * math.sqrt(later * (1 - later) / n) + 1e-9


def test_inclusion_scores_are_chances_to_exceed_the_next_value():
    import public_tokenizers

    pieces = sampled_pieces.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    for seed in range(20):
        most = sampled_pieces.samples("other thing", pieces, 4, random.Random(seed))
        less = sampled_pieces.samples("other thing", pieces, 1, random.Random(seed))
        assert less[0][:3] == most[0][:3]
        threshold = most[1][2]
        assert abs(math.exp(less[0][3]) - (1 - math.exp(-math.exp(less[0][1] - threshold)))) < 1e-9


def test_samples_do_not_depend_on_the_batch(monkeypatch):
    import public_tokenizers

    pieces = sampled_pieces.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [None, "", *(f"some words {k} and others-{k * k}, 漢字 " * (k % 4) for k in range(40)), "a" * 3000, "word " * 60_000]
    seeds = lambda: [random.Random(7) for _ in texts]
    together = sampled_pieces.samples_of([t or "" for t in texts], pieces, 3, seeds())
    monkeypatch.setattr(sampled_pieces, "BUILD_CHARS", 50)
    again = sampled_pieces.samples_of([t or "" for t in texts], pieces, 3, seeds())
    for text, a, b in zip(texts, together, again):
        alone = sampled_pieces.samples(text or "", pieces, 3, random.Random(7))
        assert alone == [(x.tolist(), *y) for x, *y in a] == [(x.tolist(), *y) for x, *y in b]
        assert all(sampled_pieces.decode(ids, pieces) == (text or "") for ids, *_ in alone)


def test_lattice_positions_know_their_likeliest_edge_and_the_rest():
    import public_tokenizers

    pieces = sampled_pieces.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    ids = {pieces.model.id_to_piece(i): i for i in range(pieces.model.vocab_size()) if not (pieces.model.is_control(i) or pieces.model.is_unknown(i) or pieces.model.is_unused(i) or pieces.model.is_byte(i))}
    chunks = ["▁the", "▁▁others", "▁Éan", "▁漢é\U000f0000x", "▁" + "-" * 70, "▁thing"]
    lattices = sampled_pieces.Lattices(pieces, chunks)
    for c, start, end in zip(chunks, lattices.start.tolist(), lattices.end.tolist()):
        assert end - start == len(c)
        for p in range(start, end):
            low, high = int(lattices.first[p]), int(lattices.first[p + 1])
            at, edges = p - start, np.arange(low, high)
            want = {n: ids.get(c[at : at + n], -1 - ord(c[at])) for n in range(1, len(c) - at + 1) if n == 1 or c[at : at + n] in ids}
            assert dict(zip(lattices.size[low:high].tolist(), lattices.id[low:high].tolist())) == want and (lattices.place[low:high] == p).all()
            logs, best = lattices.logp[low:high], int(lattices.best[p])
            assert logs[best - low] == logs.max()
            assert lattices.low[p] == (lattices.upto[best - 1] if best > low else 0.0) and lattices.high[p] == lattices.upto[best] and lattices.upto[high - 1] > 1
            with np.errstate(divide="ignore"):
                found = lattices.rest(np.full(len(edges), p), edges)
            for e, x in zip(edges.tolist(), found.tolist()):
                other = np.delete(logs, e - low)
                assert x == -math.inf if not len(other) else math.isclose(x, np.logaddexp.reduce(other), rel_tol=1e-9, abs_tol=1e-12)


def test_sampled_turns_with_nulls_and_repeated_rows(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "user", "hello there"), (1, 1, "user", "hello there"), (None, 2, "user", ""), (2, None, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = [tuple(r) for r in queries.QUERIES["op7_sampled_turns"](spark, str(tmp_path)).collect()]
    assert len([r for r in found if r[:2] == (1, 1)]) == 6 and len({r for r in found if r[:2] == (1, 1)}) == 3
    assert {r[:2] for r in found} == {(1, 0), (1, 1), (None, 2), (2, None)}


def test_pipeline(spark, docs, empty, rows):
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        before = table
        table = blocks.stored(stage(spark, table, ""), name)
        if name != "packing":
            assert table.columns == docs.columns
        if name == "language":
            assert {r["doc_id"] for r in table.collect()} == {r[0] for r in rows if any(map(str.isalpha, r[1] or ""))}
        if name == "near_duplicates":
            parts = components_of([(r["doc_id"], r["text"]) for r in before.collect() if r["doc_id"] is not None], 5, 80)
            assert sorted(repr(r["doc_id"]) for r in table.collect()) == sorted([*(repr(k) for k, (_, c) in parts.items() if k == c), "None"])
        if name == "repeated_passages":
            want = removed([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sum(x[1] - x[2] for x in want) >= sum(len(r["text"].encode()) for r in table.collect())
    pieces_are_right(table.collect(), [(r["doc_id"], r["text"]) for r in before.collect()], 1024)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_repeated_passages_leave_all_other_characters(spark):
    """Each remaining text is the input without its repeated bytes; replacement characters of the input stay."""
    passage = "a passage that stands in two documents, with an é, and is longer than fifty bytes"
    texts = ["clean \ufffd text \ufffd\ufffd", "one \ufffd " + passage, passage + "\ufffd two", "漢" + passage[:-1] + "\ufffd", None, "", "é" * 40 + "x", "é" * 40 + "y"]
    table = small_table(spark, [(k, t, "en", "s", len(t or ""), "c", "c", 1) for k, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, table, "").collect()}
    least = {}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            least.setdefault(b[p : p + 50], k)
    for k, t in enumerate(texts):
        b = (t or "").encode()
        gone = {q for p in range(len(b) - 49) if least[b[p : p + 50]] < k for q in range(p, p + 50)}
        kept = bytes(x for q, x in enumerate(b) if q not in gone).decode(errors="ignore")
        assert found[k] == (kept, len(kept))
    assert found[0][0] == texts[0] and found[2][0] == "\ufffd two"


def test_registered_query_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = oracle.connect(folder)
    for name, sql in queries.ORACLE.items():
        assert oracle.difference(queries.QUERIES[name](spark, folder).toArrow(), db.sql(sql).to_arrow_table()) is None
