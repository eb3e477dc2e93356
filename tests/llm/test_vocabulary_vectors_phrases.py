"""Spelling variants, whitening and the positional index against brute force, on given tables and awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from termweave.llm import decontamination, queries, spelling, whitening
from termweave.runtime import small_table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"


# --- spelling -----------------------------------------------------------------------------------


def vocabulary_of(rows):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near_by_deletion(words):
    """One edit apart, found through the words with one character left out."""
    by_gap = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by_gap[w[:k], w[k + 1 :]].add(w)
    near = collections.defaultdict(set)
    for group in by_gap.values():
        for a in group:
            near[a] |= group - {a}
    for w in words:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            if less in words:
                near[w].add(less)
                near[less].add(w)
    return near


def variants_of(rows):
    counts = vocabulary_of(rows)
    near = near_by_deletion(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def test_near_pairs_are_found_once():
    rng = random.Random(3)
    for alphabet in ("ab", "abcé", "abcdefghij"):
        words = sorted({"".join(rng.choices(alphabet, k=rng.randint(5, 9))) for _ in range(300)} | {"a" * k for k in (5, 6, 7, 400, 401, 403)})
        got = []
        for backwards in (False, True):
            listed = sorted(w[::-1] for w in words) if backwards else words
            for asks, hits in spelling.near_pairs(listed, listed, np.array([spelling.half(w) for w in listed])):
                for i, j in zip(asks, hits):
                    a, b = (listed[i][::-1], listed[j][::-1]) if backwards else (listed[i], listed[j])
                    if (spelling._common(a, b) >= min(len(a), len(b)) // 2) != backwards:
                        got.append((a, b))
        near = near_by_deletion(set(words))
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in words for b in near[a]}


def test_words_reach_every_shard_that_can_hold_a_near_word():
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(5, 8))) for _ in range(2000)})
    shards = [words[k : k + 40] for k in range(0, len(words), 40)]
    lows, highs = [s[0] for s in shards], [s[-1] for s in shards]
    near = near_by_deletion(set(words))
    place = {w: k for k, s in enumerate(shards) for w in s}
    for w in words:
        wanted = {place[x] for x in near[w] if x[: spelling.half(w)] == w[: spelling.half(w)]}
        assert wanted <= set(spelling.shards_of(w, lows, highs))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    syllables = "the and ing er on der ung que les ción É ñ ÷ ß".split()
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(n))
    out = [None, "", " \n", "élève ÉLÈVE elève" * 3, "Zebra zebra zebrA zebre zebre zebre zebrq" * 3, "q" * 5000 + " " + "q" * 5000, "q" * 5000 + " " + "q" * 4999, ("q" * 4999 + " ") * 3]
    out += ["hello hallo hullo hillo " * 3, "tie01tiesa tiesb tiesc tiesd " * 4, prose(2000), prose(60_000), "1234 _ 漢字 🙂 word's"]
    out += [prose(rng.randint(1, 300)) for _ in range(40)]
    return [(k, t) for k, t in enumerate(out)] + [(None, "hello hello helle helle helle"), (8, out[8])]


def test_variants(spark, texts):
    docs = small_table(spark, [(k, t, "clash", 7, None) for k, t in texts], "doc_id long, text string, word string, n long, shard long").repartition(3)
    want = variants_of(texts)
    for shard_words in (50, spelling.SHARD):
        got = spelling.variants(docs, shard_words=shard_words)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect())) == want
    assert any(w[2] not in (w[0], w[1]) for w in want) and any(w[4] > 1 for w in want)
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.filter("text is null")).count() == 0


def test_variants_of_a_long_text_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "béta", "Gamma9", "x" * 70], k=5000))
    whole = spelling.runs_of(text)
    monkeypatch.setattr(spelling, "PIECE", 64)
    assert spelling.runs_of(text) == whole


def test_variants_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_spelling"](spark, SMALL).collect())) == variants_of(rows)


# --- whitening ----------------------------------------------------------------------------------


def check_whitening(rows, vectors, components=32):
    """Against a dense eigenvalue decomposition; rows are those of the query."""
    x = np.floor(64 * np.array([v for _, v in vectors], float)).astype(np.int64) + 1_000_000
    n, d = x.shape
    away = n * x - x.sum(0)
    centred = away / n
    values, bases = np.linalg.eigh(centred.T @ centred / n)
    values, bases = values[::-1], bases[:, ::-1]
    rank = int((values > 1e-9 * values[0]).sum())
    k = min(components, rank)
    got = collections.defaultdict(dict)
    for r in rows:
        got[r["component"]].setdefault((r["vec_id"], r["deviation"]), []).append(r)
    assert sorted(got) == list(range(1, k + 1))
    deviations = np.square(away.astype(object)).sum(1)
    projected = centred @ bases[:, :k] / np.sqrt(values[:k])
    gaps = np.abs(np.subtract.outer(values, values)) + np.eye(d) * values[0]
    for c in range(1, k + 1):
        want = collections.defaultdict(list)
        for (key, _), y, dev in zip(vectors, projected[:, c - 1], deviations):
            want[key, dev].append(y)
        assert {key: len(v) for key, v in want.items()} == {key: len(v) for key, v in got[c].items()}
        if gaps[c - 1].min() > 1e-6 * values[0]:  # else any basis will do
            a = np.concatenate([sorted(want[key]) for key in want])
            b = np.concatenate([sorted(r["whitened"] for r in got[c][key]) for key in want])
            flipped = np.concatenate([sorted(-r["whitened"] for r in got[c][key]) for key in want])
            assert min(np.abs(a - b).max(), np.abs(a - flipped).max()) < 1e-6
        for r in (r for v in got[c].values() for r in v):
            assert r["n"] == n and r["identity_error"] <= 1e-4
            assert abs(r["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9


def whitened_rows(spark, vectors, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: vectors)
    return queries.QUERIES["op12_whitening"](spark, SMALL).collect()


def test_whitening_query(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, SMALL, "embeddings").collect()]
    check_whitening(queries.QUERIES["op12_whitening"](spark, SMALL).collect(), vectors)


def test_whitening_of_awkward_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    good = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((200, 40)))]
    good += [(500, good[3][1])] * 3 + [(None, good[4][1])]
    bad = [(900, None), (901, [None] * 40), (902, [float("nan")] + [0.0] * 39), (903, [float("inf")] + [0.0] * 39), (904, [1.0, 2.0]), (905, [])]
    schema = "vec_id long, embedding array<double>, component int, n long"
    table = small_table(spark, [(k, v, 9, 9) for k, v in good + bad], schema).repartition(4)
    check_whitening(whitened_rows(spark, table, monkeypatch), good)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], bad[:4], [(1, [])]):
        assert whitened_rows(spark, small_table(spark, [(k, v, 9, 9) for k, v in rows], schema), monkeypatch) == []
    few = [(1, [1.0, 2.0, 7.0]), (2, [3.0, 1.0, 7.0]), (3, [5.0, 5.0, 7.0])]
    check_whitening(whitened_rows(spark, small_table(spark, [(k, v, 9, 9) for k, v in few], schema), monkeypatch), few)
    huge = small_table(spark, [(1, [1e300], 9, 9), (2, [-1e300], 9, 9), (3, [0.0], 9, 9)], schema)
    assert {(r["vec_id"], r["deviation"]) for r in whitened_rows(spark, huge, monkeypatch)} == {(1, None), (2, None), (3, 0)}


@pytest.mark.parametrize("n, d, wanted", [(3000, 200, 32), (100, 300, 32), (39, 40, 32), (10, 1, 3), (50, 10, 32)])
def test_jacobi_davidson(n, d, wanted):
    """More dimensions than the subspace may hold, so pairs are locked one after the other and the subspace is cut back."""
    x = np.random.default_rng(d).standard_normal((n, d))
    x[:, 0] *= 3
    x[:, -1] = x[:, 0]
    x -= x.mean(0)
    passes = []
    values, vectors = whitening.eigenpairs(lambda b: passes.append(b.shape) or x.T @ (x @ b) / n, d, wanted)
    want = np.linalg.eigvalsh(x.T @ x / n)[::-1][:wanted]
    assert np.abs(values - want).max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.linalg.norm(x.T @ (x @ vectors) / n - vectors * values, axis=0).max() < 1e-12 * want[0]
    assert max(b[1] for b in passes) <= wanted + whitening.GUARD


def test_corrections_solve_the_projected_equation():
    rng = np.random.default_rng(1)
    a = np.diag(np.linspace(1, 9, 30)) + 0.01 * np.ones((30, 30))
    basis = np.linalg.qr(rng.standard_normal((30, 3)))[0]
    theta = np.array([9.5, 4.05, 0.5])
    r = whitening._against(basis, rng.standard_normal((30, 3)))
    t = whitening._corrections(lambda b: a @ b, basis, theta, r, 200, 1e-13)
    left = whitening._against(basis, a @ t - t * theta)
    assert np.abs(left + r).max() < 1e-8 and np.abs(basis.T @ t).max() < 1e-12


# --- decontamination ----------------------------------------------------------------------------


def phrase_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "the", "the", "the", "of", "naïve", "漢字", "x1"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    unique = lambda n, tag: " ".join(f"{tag}{k}" if k % 3 else "the" for k in range(n))
    items = [(1, unique(30, "q")), (2, "Short ITEM here"), (3, "lonely"), (4, None), (5, "..!"), (6, "the the the the the the the the the the the the"), (7, unique(30, "q").upper())]
    items += [(8, unique(10, "z") + " never seen"), (10, unique(14, "w")), (10, unique(14, "w")), (None, unique(12, "n")), (11, prose(15))]
    docs = [None, "", "..", unique(30, "q"), "before " + unique(30, "q") + " after", " ".join(unique(30, "q").split()[5:16]), " ".join(unique(30, "q").split()[5:14])]
    docs += ["a short-item, HERE and Lonely", "short item", "the " * 11, "the " * 9, unique(14, "w") + " gap " + unique(14, "w"), unique(12, "n"), unique(10, "z")]
    docs += [" ".join(reversed(unique(14, "w").split())), prose(40_000), items[-1][1] + " " + items[-1][1], " ".join(unique(30, "q").split()[:9] + ["no"] + unique(30, "q").split()[10:19])]
    docs += [prose(rng.randint(1, 80)) for _ in range(30)]
    return [(k, t) for k, t in enumerate(docs)] + [(3, docs[3]), (None, docs[11])], items


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs, items = corpus
    left = small_table(spark, [(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, term string, row long").repartition(3)
    return left, small_table(spark, [(k, t, 5) for k, t in items], "item_id long, text string, pos int")


def test_exact_phrases(tables, corpus):
    docs, items = corpus
    windows = collections.defaultdict(set)
    for item, text in items:
        w = phrase_words(text)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s : s + k])].add(item)
    want = []
    for key, text in docs:
        w = phrase_words(text)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                ids = windows.get(tuple(w[s : s + k]))
                if ids:
                    hit |= set(range(s, s + k))
                    found |= ids
        listed = sorted(str(x) for x in found if x is not None)
        want.append((key, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in decontamination.contaminated(*tables).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[-1] for r in got) > 8


def test_proximity(tables, corpus):
    docs, items = corpus
    within = 13
    sets = collections.defaultdict(set)
    for item, text in items:
        w = phrase_words(text)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            sets[item].add((tuple(w), s, frozenset(w[s : s + k])))
    want = collections.Counter()
    for key, text in docs:
        w = phrase_words(text)
        seen = {frozenset(w[a : a + within]) for a in range(len(w))}
        for item, of in sets.items():
            n = sum(any(need <= have for have in seen) for _, _, need in of)
            if n and item is not None:
                want[key, str(item), n] += 1
    got = collections.Counter(tuple(r) for r in decontamination.near_items(*tables, within=within).filter("item is not null").collect())
    assert got == want
    assert any(k[0] == 14 for k in got)  # the words of an item in reverse order


def test_empty_phrase_tables(tables):
    docs, items = tables
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    clean = decontamination.contaminated(docs, items.limit(0)).collect()
    assert len(clean) == docs.count() and not any(r["contaminated"] or r["n_items"] for r in clean)
    assert decontamination.near_items(docs, items.limit(0), within=20).count() == 0


def test_index_of_all_words(spark, tables, corpus):
    index = decontamination.build(tables[0])
    assert index.postings.count() == sum(len(phrase_words(t)) for _, t in corpus[0])
    assert index.rows.agg({"n_words": "sum"}).first()[0] == index.postings.count()
