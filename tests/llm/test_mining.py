"""Toxicity, collocations and the audit of filters against brute force, with nulls, repeats, ties, empty tables and clashing names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from larkspur.llm import collocations as co
from larkspur.llm import decontaminate, filter_audit, near_dup, toxicity

from test_corpus import SMALL, prose

NAMES = "doc_id bigint, text string, lang string, part string, word string, score double, mask int, n bigint, id string"


@pytest.fixture(scope="module")
def rows():
    """Texts of few words, so that phrases repeat; nulls, repeats, blanks and marks; ids that repeat or are null."""
    r = random.Random(5)
    some = "ab Ab b.c é ça x d'e | # tea\tcup".split(" ")
    made = [(i, " ".join(r.choice(some) + r.choice(["", "", "", ".", ",", "\n", "  ", "!"]) for _ in range(r.randrange(60))), r.choice(["en", "fr", None])) for i in range(150)]
    made += [(7, made[3][1], "en"), (None, made[3][1], "fr"), (None, None, "en"), (200, None, None), (201, "", "en"), (201, "", "en"), (202, "   ", "fr")]
    made += [(300 + i, "LOUD " * 250 if i % 2 else "$ " + " ".join(f"w{j}" for j in range(220)), "") for i in range(6)]
    return made


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "p", "w", 0.5, 3, 4, "k") for i, t, g in rows], NAMES)


# ---------------------------------------------------------------- 12


def brute_collocations(rows, least, top, most=5):
    total, counts = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        good = {p: n for p, n in f.items() if n >= least}
        found = []
        for p, a in good.items():
            if len(p) < 2 or any(len(q) > len(p) and good[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in good):
                continue
            score, cut = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard_words", [4_000_000, 50])
def test_collocations_are_brute_force(frame, rows, shard_words):
    got = co.collocations(frame, top=12, least=4, shard_words=shard_words, salts=3)
    assert got.columns == ["part", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(rows, 4, 12)
    assert len(want) > 30 and any(len(w[2].split()) > 3 for w in want)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_collocations_edges(spark, frame):
    assert co.collocations(frame.limit(0)).count() == 0
    assert co.collocations(frame, least=10**6).count() == 0
    same = spark.createDataFrame([("a a a a a a",)] * 3, "text string").selectExpr("text", "CAST(NULL AS STRING) AS lang")
    got = [tuple(r) for r in co.collocations(same, least=3).collect()]
    want = brute_collocations([(0, "a a a a a a", None)] * 3, 3, 2000)
    assert sorted(got) == want and [w[2] for w in want] == ["a a", "a a a", "a a a a", "a a a a a"][: len(want)] or len(want) == 4


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 3_000_000_000, 9_000_000_000_000, 40_000_000_007, 30_000_000_011
    d = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint")
    assert d.select(co._score(d.a, d.n, d.l, d.r)).first()[0] == 1000 * a * n // (left * right)


def test_bitmaps_are_sets():
    r = random.Random(3)
    for size in (0, 1, 5, 300):
        a, b = (sorted(r.sample(range(1000), size)) for _ in range(2))
        x, y = (co.Bitmap.of(np.array(v, np.int64)) for v in (a, b))
        assert x.places().tolist() == a and x.count() == size
        assert x.shifted().places().tolist() == [v + 1 for v in a]
        assert (x & y).places().tolist() == sorted(set(a) & set(b))
        assert (x.shifted() & y).count() == len({v + 1 for v in a} & set(b))
    sizes = np.array([3, 0, 2, 1])
    places = np.array([1, 5, 90, 0, 70_000, 8])
    assert co.unpacked(co.packed(places, sizes), sizes).tolist() == places.tolist()
    assert co.unpacked(co.packed(places[:0], sizes[:0]), sizes[:0]).tolist() == []


def test_long_texts_are_cut_between_pieces():
    text = b"\n".join(b"word" * 5 for _ in range(50))
    parts = list(co.chunks(text, 100))
    assert len(parts) > 5 and b"".join(parts) == text and all(p.startswith(b"\n") for p in parts[1:])
    assert list(co.chunks(b"x" * 500, 100)) == [b"x" * 500]


# ---------------------------------------------------------------- 13


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    marked = defaultdict(lambda: [False, False])
    for i, q, x in labels:
        marked[i][0] |= q == 1
        marked[i][1] |= x == 1
    own = []
    for i, t, g in rows:
        t = t or ""
        w = [x for x in re.split("[ \t-\r]+", t) if x]
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and first[t] < i else set()
        own.append((g or "", fails, *(marked[i] if i is not None else [False, False])))
    out, gone = [], Counter()
    for part in {o[0] for o in own}:
        here = [o for o in own if o[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                removed = [o for o in left if f in o[1]]
                left = [o for o in left if f not in o[1]]
                gone[part, f] += len(removed)
                failing = sum(f in o[1] for o in here)
                row = [part, order, step, len(left), len(removed), failing - len(removed), sum(o[1] == {f} for o in here), sum(o[2] for o in removed), sum(o[3] for o in removed)]
                out.append(row)
    return sorted((*r, gone[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_is_brute_force(spark, frame, rows):
    r = random.Random(1)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 310, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    got = filter_audit.audit(frame, marks)
    want = brute_audit(rows, labels)
    assert sorted(tuple(x) for x in got.collect()) == want
    assert any(w[6] for w in want) and any(w[8] for w in want) and any(w[5] for w in want)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    assert {x[7] for x in filter_audit.audit(frame, marks.limit(0)).collect()} == {0}


def test_zeta_is_sum_over_subsets(spark):
    r = random.Random(2)
    x = [r.randrange(100) for _ in range(16)]
    d = spark.createDataFrame([(x,)], "x array<bigint>")
    assert d.select(filter_audit.zeta(d.x, 4)).first()[0] == [sum(x[s] for s in range(16) if s & m == s) for m in range(16)]


# ---------------------------------------------------------------- 11


def brute_ftrl(texts, labels, rate, smooth, l1, l2):
    """McMahan's per-coordinate formulas on dictionaries."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        pull = 0.0 if i == 1 << toxicity.BITS else l1
        return 0.0 if abs(z[i]) <= pull else -(z[i] - math.copysign(pull, z[i])) / ((smooth + math.sqrt(n[i])) / rate + l2)

    seen = []
    for at, y in zip(texts, labels, strict=True):
        at = [*at, 1 << toxicity.BITS]
        w = {i: weight(i) for i in at}
        p = 1 / (1 + math.exp(-sum(w.values())))
        seen.append(p)
        for i in at:
            g = p - y
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rate
            z[i] += g - s * w[i]
            n[i] += g * g
    return seen, {i: weight(i) for i in z if weight(i)}


def test_ftrl_is_its_formulas():
    r = random.Random(4)
    texts = [sorted(r.sample(range(40), 12)) for _ in range(300)]
    labels = [int(3 in t or 7 in t) for t in texts]
    for options in ({}, {"rate": 0.3, "l1": 1.0, "l2": 0.0, "smooth": 0.5}):
        model = toxicity.Ftrl(**options)
        got = [model.learn(np.array(t, np.int32), y) for t, y in zip(texts, labels, strict=True)]
        want, weights = brute_ftrl(texts, labels, model.rate, model.smooth, model.l1, model.l2)
        assert np.allclose(got, want)
        at, weight = model.nonzero()
        assert {i: round(w, 9) for i, w in zip(at.tolist(), weight.tolist(), strict=True) if w} == {i: round(w, 9) for i, w in weights.items()}
        assert {3, 7} <= set(at[weight > 0].tolist())


def test_features_are_words_stems_and_pairs():
    def coordinates(texts):
        text, at = toxicity.hashed(texts)
        return [set(at[text == i].tolist()) for i in range(len(texts))]

    one, two, other, none, pair = coordinates(["alpha beta gamma", "Alpha, beta; gamma!", "alpha gamma beta", None, "alpha beta"])
    assert one == two and one != other and none == set() and pair < one
    # 3 words, 2 neighbours, 1 pair over a word, 4 letters of the two longer words
    assert len(one) == 3 + 2 + 1 + 2 and len(coordinates(["gammas"])[0]) == 1 + 2
    stems = coordinates(["vileness", "vilest"])
    assert len(stems[0] & stems[1]) == 1  # vile


def test_scores_alone_or_together(spark):
    """The score of a text does not depend on its batch, and presence counts once."""
    texts = ["bad day here", None, "", "good good good", "bad bad bad bad"]
    text, at = toxicity.hashed(["bad"])
    model = toxicity.Toxicity(at[:1], np.array([2.0]), -1.0)
    got = model.scores(texts)
    assert np.allclose(got, [model.scores([t])[0] for t in texts])
    assert np.allclose(got, [1 / (1 + math.exp(-x)) for x in (1, -1, -1, -1, 1)])


def test_toxic_rows_are_found_held_out(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/labels.parquet")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    kept = spark.createDataFrame([tuple(r) for r in labels.collect() if not out(r.doc_id)], labels.schema)
    model = toxicity.train(docs, kept)
    got = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if out(r.doc_id)]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    assert len(toxic) > 8 and sum(a > b for a in toxic for b in clean) / len(toxic) / len(clean) > 0.8
    # 37 toxic rows to learn from, few of them in other languages than English
    assert sum(s >= 0.3 for s in clean) <= 2 and sum(s >= 0.3 for s in toxic) >= 0.5 * len(toxic)


def test_toxicity_edges(spark, frame):
    labels = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (2, None, "c"), (None, 1, "d")], "doc_id bigint, toxic int, text string")
    for some, want in ((labels.limit(0), 0.5), (labels, 0.5), (labels.filter("text = 'a'"), 1.0)):
        got = toxicity.score(frame, toxicity.train(frame, some))
        assert got.columns == ["doc_id", "lang", "part", "word", "mask", "n", "id", "score"]
        assert all(abs(r.score - want) < 1e-9 for r in got.collect())
    lost = spark.createDataFrame([(10**6, 1), (10**6 + 1, 0), (10**6 + 2, 0)], "doc_id bigint, toxic int")
    assert all(abs(r.score - 1 / 3) < 1e-9 for r in toxicity.score(frame, toxicity.train(frame, lost)).collect())
    assert toxicity.score(frame.limit(0), toxicity.train(frame, lost)).count() == 0


def test_share_of_a_bounded_label_is_restored(spark):
    """With fewer clean rows in the sample than there are, scores stay near the true share."""
    rows = [(i, prose(12, i)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(600)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, per_label=60)
    mean = np.mean([r.score for r in toxicity.score(docs, model).collect()])
    assert 0.03 < mean < 0.3


# ---------------------------------------------------------------- 1, 6: bounds


def test_a_window_of_many_items_is_bounded(spark):
    many = spark.range(3000).selectExpr("id AS item_id", "'a b c d e f g h i j k l m' AS text")
    blocks = list(decontaminate.pattern_blocks(many, "item_id", "text", 13, 500))
    assert len(blocks) == 6 + (len(blocks) - 6) and max(sum(map(len, b.values())) for b in blocks) <= 501
    assert sum(sum(map(len, b.values())) for b in blocks) == 3000
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l m"), (2, "nothing")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs, many, block_windows=500).collect()}
    assert got[1].item_ids == list(range(3000)) and got[2].item_ids == []
    assert [(s.start, s.end) for s in got[1].spans] == [(1, 14)]


def test_many_null_ids_meet_by_their_text(spark):
    base = prose(60, 1)
    rows = [(None, f"{base} {prose(3, i)}") for i in range(400)] + [(None, prose(40, 1000 + i)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = near_dup._classes(d, "doc_id", "text", 0.8, 5, 5, 32).collect()
    assert max(r.class_size for r in found) == 400


# ---------------------------------------------------------------- 9: what marks may not swallow

LONG = "A long paragraph of an article, with commas, and stops. " * 8


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<html><head><title>T</title><body><article><p>{LONG}</p></article>", LONG),
        (f"<html><head><title>T</title><p>{LONG}</p>", LONG),
        (f"<html><head><meta charset=x> {LONG}", LONG),
        (f"<body><form id='aspnetForm'><nav>Menu one two</nav><div><p>{LONG}</p><p>{LONG}</p></div></form>", LONG + LONG),
        (f"<article><div class='popular'><p>{LONG}</p></div><p>Short end.</p></article>", LONG + "Short end."),
        (f"<article><p>{LONG}</p></article><div class='comments'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", LONG),
        (f"<article><p>Brief.</p></article><div class='comments'><p>{LONG}</p><p>{LONG}</p></div>", "Brief."),
        (f"<article><p>Brief text.</p><div class='comments'><p>{LONG}</p><p>{LONG}</p></div></article>", "Brief text."),
        (f"<article><p>Brief.</p></article><footer>{LONG}</footer>", "Brief."),
        ("<html><head><title>T</title></head><body></body>", ""),
    ],
)
def test_marks_swallow_no_article(page, want):
    from larkspur.llm.html_text import main_text

    assert main_text(page) == " ".join(want.split())


# ---------------------------------------------------------------- 3, 6: blocks by classes of size


@pytest.mark.parametrize("sized", [False, True])
def test_classes_of_size_part_no_similar_pair(spark, sized):
    """Sets in one bucket, of sizes 20 to 400, planted pairs at exactly 0.8 and over: links as by comparing all."""
    from pyspark.sql import functions as F

    from larkspur.llm.near import linked

    r, sets = random.Random(3), {}
    for i in range(120):
        base = {1000 * i + j for j in range(r.choice([20, 25, 40, 60, 100, 200, 320]))}
        sets[2 * i] = base
        if i % 2:
            sets[2 * i + 1] = set(sorted(base)[: -(-8 * len(base) // 10)])  # 0.8 of it
    sets[999] = {-j for j in range(50)}  # leads, like none
    jaccard = lambda a, b: len(a & b) / len(a | b)
    want = {k: min([j for j in sets if jaccard(sets[k], sets[j]) >= 0.8 - 1e-12]) for k in sets}
    rows = [(n, [1] + ([2] if n in (999, 0) else []), None, sorted(v)) for n, v in sets.items()]
    marks = spark.createDataFrame(rows, "node bigint, keys array<bigint>, mark bigint, content array<int>")
    buckets = marks.select(F.explode("keys").alias("key"), "node")

    def exact(held):
        own = lambda i: set(held[i][0][held[i][1]].as_py())
        return lambda i, j: jaccard(own(i), own(j)) >= 0.8 - 1e-12

    more = {"size": F.size("content"), "ratio": 0.8} if sized else {}
    labels, _ = linked(buckets, lambda pairs: pairs.filter("false"), marks, exact, aligned=False, block=8, **more)
    assert {x.node: x.label for x in labels.collect()} == want
