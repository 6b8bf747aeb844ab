"""Corpus operators by value: brute force for repeated passages and the pipeline, rows with nulls, repeats and clashing names,
order of files, texts that look like special strings, ratios that decide alone."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import bpe, common, decontaminate, html_text, idstore, language, merkle, near_dup, quality, shingles, substring_dedup, token_counts
from larkspur.llm.common import words

from test_corpus import BPE50, MULTI, SMALL, WORD, brute_classes, brute_contamination, prose

P1, P2, P3 = prose(80, 71), prose(80, 72), prose(80, 73)


@pytest.fixture(scope="module")
def clashing(spark):
    """Rows that share ids, null ids, and columns named like an operator's own."""
    rows = [(1, P1), (2, P1), (2, P2), (None, P3), (None, P3 + " end"), (5, P3[:-8]), (9, None), (9, None), (None, None), (7, ""), (8, P2), (8, P2)]
    names = "whole string, cuts string, found string, row bigint, node string, hash string, n_chars bigint"
    made = [(i, t, "w", "c", "f", 3, "n", "h", None) for i, t in rows]
    return spark.createDataFrame(made, f"doc_id bigint, text string, {names}")


# ---------------------------------------------------------------- 1, 6: rows, not ids


@pytest.mark.parametrize("block", [200_000, 3])
def test_contaminated_rows_go_whatever_their_id(spark, clashing, block):
    items = spark.createDataFrame([(1, P1), (2, P3)], "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(clashing, items, block_windows=block)
    assert kept.columns == clashing.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(2, P2): 1, (9, None): 2, (None, None): 1, (7, ""): 1, (8, P2): 2})
    assert decontaminate.drop_contaminated(clashing.limit(0), items, block_windows=block).count() == 0


def test_one_row_of_each_near_class_stays(clashing):
    kept = near_dup.keep_first(clashing)
    assert kept.columns == clashing.columns
    want = Counter({(1, P1): 1, (2, P2): 1, (5, P3[:-8]): 1, (9, None): 2, (None, None): 1, (7, ""): 1})
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    assert near_dup.keep_first(clashing.limit(0)).count() == 0


def test_links_hold_classes_together(spark):
    r = random.Random(2)
    base = prose(200, 8).split()
    rows = []
    for i in range(30):
        own = list(base)
        own[r.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(own)))
    d = spark.createDataFrame([*rows, (99, prose(50, 9))], "doc_id bigint, text string")
    got = {x.doc_id: x for x in near_dup.near_classes(d).collect()}
    assert got[99].n_links == 0 and all(got[i].n_links >= 1 and got[i].class_id == 0 for i in range(30))


def test_recall_of_near_copies_by_similarity(spark):
    """Planted copies of similarity 0.8 to 0.95 against brute force: none is missed."""
    r = random.Random(6)
    rows = []
    for i in range(60):
        base = prose(150, 600 + i, 4000).split()
        rows.append((2 * i, " ".join(base)))
        for j in range(1 + i % 4):
            base[10 + 35 * j] = f"new{r.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(base)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.doc_id: x.class_id for x in near_dup.near_classes(d).collect()} == brute_classes(rows)


# ---------------------------------------------------------------- 3


def covered(runs, texts):
    """Per document: which words lie in removed runs."""
    out = {}
    for i, t in texts.items():
        spans = [(r.start, r.end) for r in runs if r.doc_id == i]
        raw, at, own = t.encode(), 0, []
        for w in words(t):
            at = raw.lower().index(w, at)
            own.append(any(a <= at and at + len(w) <= b for a, b in spans))
            at += len(w)
        out[i] = own
    return out


def test_repeats_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    runs = substring_dedup.repeated_runs(docs).collect()
    gone = covered(runs, texts)
    seen, lines, clean = set(), [], []
    shingles = Counter(s for t in texts.values() for w in [words(t)] for s in [tuple(w[i : i + 5]) for i in range(len(w))])
    for i in sorted(texts):
        w = words(texts[i])
        own = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        for j, s in enumerate(own):
            if s in seen:  # a passage of 50 words that stands in an earlier document
                assert all(gone[i][j : j + 50]), (i, j)
        seen.update(own)
        at = 0
        for line in texts[i].split("\n"):
            n = len(words(line))
            if n >= 16:
                lines.append((i, at, n, {tuple(w[at + j : at + j + 5]) for j in range(n - 4)}))
            at += n
        if all(shingles[tuple(w[j : j + 5])] == 1 for j in range(len(w))):
            clean.append(i)
    assert clean and not any(any(gone[i]) for i in clean)
    found = total = 0
    index: dict = {}
    for k, (_, _, _, own) in enumerate(lines):
        for s in own:
            index.setdefault(s, []).append(k)
    for k, (i, at, n, own) in enumerate(lines):
        common = Counter(m for s in own for m in index[s] if m < k)
        if any(c >= 0.8 * (len(own) + len(lines[m][3]) - c) for m, c in common.items()):
            total += 1
            found += all(gone[i][at : at + n])
    assert total > 20 and found >= 0.97 * total


def test_repeats_keep_rows_and_columns(clashing):
    left = substring_dedup.remove_repeats(clashing)
    assert left.columns == clashing.columns
    got = Counter((r.doc_id, r.text) for r in left.collect())
    assert got[(9, None)] == 2 and got[(None, None)] == got[(7, "")] == 1 and got[(1, P1)] == 1 and got[(2, P1)] == 0
    assert substring_dedup.remove_repeats(clashing.limit(0)).count() == 0


def test_short_repeats_go_with_min_words_one(spark):
    line = prose(12, 5)
    d = spark.createDataFrame([(1, prose(30, 1) + "\n" + line), (2, prose(30, 2) + "\n" + line)], "doc_id bigint, text string")
    assert substring_dedup.repeated_runs(d).count() == 0
    runs = substring_dedup.repeated_runs(d, min_words=1).collect()
    assert [r.doc_id for r in runs] == [2] and runs[0].n_words >= 12


def test_sliding_extremes():
    r = np.random.default_rng(1)
    for n in (1, 5, 24, 100):
        x = r.integers(1, 1 << 60, n).astype(np.uint64)
        for w in (1, 3, 5, 24):
            assert substring_dedup.sliding(x, w).tolist() == [min(x[i : i + w].tolist()) for i in range(n - w + 1)]
            assert substring_dedup.sliding(x, w, False).tolist() == [max(x[i : i + w].tolist()) for i in range(n - w + 1)]


# ---------------------------------------------------------------- 5, 7, 8


def test_labels_that_contradict_count_for_nothing(spark):
    good, bad = prose(60, 1) + ".", "&&& " * 60
    rows = [(i, good) for i in range(20)] + [(100 + i, bad) for i in range(20)] + [(0, good)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = [(i, 1) for i in range(20)] + [(100 + i, 0) for i in range(20)]
    more = [*labels, *labels, (300, 1), (300, 0), (None, 1), (1, None)]
    one, two = (quality.train(d, spark.createDataFrame(x, "doc_id bigint, quality int")) for x in (labels, more))
    assert np.allclose(one.weights, two.weights) and one.threshold == pytest.approx(two.threshold)


def test_order_of_leaves_is_no_likeness_of_one(spark):
    d = spark.createDataFrame([("A b. C d.", "C d. A b."), ("A b.", "A b. A b."), ("same", "same")], "a string, b string")
    x, y = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    got = d.select(merkle.likeness(x, y).alias("like"), x.alias("x")).collect()
    assert got[0].like == pytest.approx(2 / 3) and got[1].like == 0.5 and got[2].like == 1.0
    leaf = [hashlib.sha256(s).hexdigest() for s in (b"A b.", b"C d.")]
    root = hashlib.sha256(hashlib.sha256(".".join(leaf).encode()).hexdigest().encode()).hexdigest()
    assert got[0].x.split(" ")[0] == root and got[0].x.split(" ")[2] == ".".join(x[:12] for x in leaf)


def test_fingerprints_of_long_texts(spark):
    long = "\n".join(prose(40, i) + "." for i in range(2000))
    d = spark.createDataFrame([(1, long, "x"), (2, long, "y"), (2, long, "z")], "doc_id bigint, text string, fingerprint string")
    assert len({r.fingerprint for r in merkle.fingerprint_documents(d).collect()}) == 1
    assert {r.near_next for r in merkle.compare_with_edits(d).collect()} == {1.0}


def test_expected_counts_of_long_and_short_words():
    pieces = ["▁a", "▁ab", "b", "ab", "▁", "a"]
    rows, probs = {p: i for i, p in enumerate(pieces)}, np.array([0.2, 0.1, 0.2, 0.25, 0.15, 0.1])
    grids = language._grids({"abab": 3}, rows, 3)
    short = language._expected(grids, {}, rows, 3, probs)
    long = language._expected([], {"abab": 3}, rows, 3, probs)
    assert np.allclose(short, long) and short.sum() > 3


# ---------------------------------------------------------------- 9


def test_ratios_alone_choose():
    menu = "".join(f'<div><a href="/{i}">Item {i}</a></div>' for i in range(12))
    body = "".join(f"<p>Sentence {i}, with words; and more of them. Then another one, longer than any of the others.</p>" for i in range(5))
    page = f"<html><body><div><div>{menu}</div><div><h2>Title</h2>{body}</div><div><div>Go</div><div>Up</div><div>ok</div></div></div></body></html>"
    text = html_text.main_text(page)
    assert text.startswith("Title Sentence 0") and text.endswith("others.") and "Item" not in text
    kept = html_text.fused_ratios
    try:
        html_text.fused_ratios = lambda found: [1.0] * len(found)
        assert html_text.main_text(page) != text  # with constant ratios nothing tells the parts apart
    finally:
        html_text.fused_ratios = kept


def test_ratios_by_hand():
    nodes, found = html_text.leaves("<body><p>ab, c.</p><p>d</p><div><a>link</a></div></body>")
    # per path: (6 + 1) / 2 characters, 2 / 2 marks; 4 characters, no mark, all linked; smoothed over three leaves
    assert html_text.fused_ratios(found) == pytest.approx([3.5 * 2, (7 + 3.5 + 4) / 4 * (1 + 0.75), 0.0])


def test_names_exclude_parts_not_words_of_content():
    page = '<body><div class="post-body"><div class="header-title"><h1>Head</h1></div><div class="article-header"><h2>Sub</h2><h1>More</h1></div><p>One, two. Three.</p><blockquote class="comment">Quoted, too.</blockquote></div><div class="cookie-banner">We use cookies, yes.</div><div id="commentList"><p>So true, so true.</p></div></body>'
    assert html_text.main_text(page) == "Head Sub More One, two. Three. Quoted, too."


def test_deep_pages_take_linear_time():
    began = time.perf_counter()
    assert html_text.main_text("<div class=a>x y. " * 100_000).startswith("x y.")
    html_text.main_text("<ul>" + "<div>" * 30_000 + "<li>x</li>" * 30_000 + "<b>" * 30_000 + "</i>" * 30_000)
    assert time.perf_counter() - began < 60


# ---------------------------------------------------------------- memory of a worker that serves several operators


def test_a_worker_remembers_for_one_operator_only():
    pieces = bpe.BytePairs(bpe.load_ranks(MULTI), public_tokenizers.PATTERN)
    batch = pa.record_batch([pa.array(["one unheardofpiece", "two unheardofpieces"])], ["text"])
    for _ in common.slices([batch], 1, pieces):
        pieces.encode("one unheardofpiece")
    assert pieces._seen and pieces._heads
    assert list(common.slices([batch, batch], 1, pieces)) and pieces._seen  # its own next task finds them
    next(common.slices([batch]))  # an operator that remembers nothing, such as near_dup or substring_dedup
    assert not pieces._seen and not pieces._heads and not pieces.pairs
    decontaminate._FINDERS["block"] = decontaminate.WuManber({(b"a", b"b"): {1}})
    next(common.slices([batch], owner=decontaminate._FINDERS))
    assert "block" in decontaminate._FINDERS
    next(common.slices([batch], owner=pieces))
    assert not decontaminate._FINDERS


def test_arrow_gives_memory_back_after_each_batch(monkeypatch):
    calls, own = [], pa.default_memory_pool()

    class Pool:
        def release_unused(self):
            calls.append(own.bytes_allocated())
            own.release_unused()

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batch = pa.record_batch([pa.array(["a", "b", "c"])], ["text"])
    assert [b.num_rows for b in common.slices([batch, batch], 2)] == [2, 1, 2, 1]
    assert len(calls) == 2


# ---------------------------------------------------------------- 10


def test_runs_are_the_library_s_in_upper_case_too():
    lib, r = token_counts.load_tokenizer(WORD), random.Random(5)
    cache = idstore.WordCache(WORD, "<u2")
    assert cache.by_runs
    parts = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|>", "<|StartOfText|>", "B", "b", " ", "\n", "'S", "it's", "É", "ß", "K", "x.", ",", "<|", "|>", "\x01", "42", "語"]
    texts = ["<|ENDOFTEXT|>b", *("".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(4000))]
    got = cache.encode([t.encode() for t in texts])
    want = lib.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [w.ids for w in want]


def test_runs_of_letters_go_to_the_model_alone(monkeypatch):
    lib, r = token_counts.load_tokenizer(WORD), random.Random(6)
    cache = idstore.WordCache(WORD, "<u2")
    letters = "abcdefghijklmnopqrstuvwxyzABCZ" + "".join(map(chr, range(0xC0, 0x240)))
    runs = ["".join(r.choice(letters[: r.choice((26, 30, 99, 999))]) for _ in range(r.randrange(1, 20))) for _ in range(3000)]
    calls, batch = [], cache._library
    monkeypatch.setattr(cache, "_library", lambda texts, *more: calls.append(sum(map(len, texts))) or batch(texts, *more))
    plain = [w for w in runs if not set(w) & set("×÷İ")]
    got = cache.encode([w.encode() for w in plain])
    assert len(plain) > 2000 and sum(calls) == 0
    got += cache.encode([w.encode() for w in runs])
    want = lib.encode_batch(plain + runs, add_special_tokens=False)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [w.ids for w in want]
    assert idstore.WordCache(BPE50, "<u2").model is None


def test_other_tokenizers_get_whole_texts():
    lib = token_counts.load_tokenizer(BPE50)
    cache = idstore.WordCache(BPE50, "<u2")
    assert not cache.by_runs
    (got,) = cache.encode([b"Mixed Case, it  keeps blanks\n"])
    assert np.frombuffer(got, "<u2").tolist() == lib.encode("Mixed Case, it  keeps blanks\n", add_special_tokens=False).ids


def test_files_are_in_order_over_partitions(spark, tmp_path):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("start", F.lit("clash"))
        path = str(tmp_path / "s")
        idstore.write_store(docs.repartition(5), path, WORD, 1)
        names = sorted(f.name for f in (tmp_path / "s" / "recipes").glob("part-*.parquet"))
        ids = [r.doc_id for n in names for r in spark.read.parquet(f"{path}/recipes/{n}").collect()]
        assert len(names) > 2 and ids == sorted(ids)
        got = sorted(idstore.read_sums(spark, path).collect(), key=lambda r: r.doc_id)
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist() and idstore.verify(spark, path)
        whole = {r.doc_id: r.ids for r in idstore.read_documents(spark, path, "doc_id < 20").collect()}
        assert all(zlib.crc32(np.array(whole[r.doc_id], "<u4").tobytes()) == r.ids_crc32 for r in got if r.doc_id in whole)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# ---------------------------------------------------------------- pipeline


def brute_pipeline(spark, docs, folder):
    """All stages but the third by brute force; the third is held against brute force above."""
    import tiktoken

    from larkspur.llm import bpe

    lettered = [(r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    of = brute_classes(list(enumerate(t for _, t in lettered)))
    best: dict = {}
    for n, (i, t) in enumerate(lettered):
        best.setdefault(of[n], []).append((i is None, i, n))
    first = {min(v)[2] for v in best.values()}
    left = spark.createDataFrame([lettered[n] for n in sorted(first)], "doc_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in substring_dedup.remove_repeats(left).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = brute_contamination([t for _, t in rows], items)
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})
    out = Counter()
    for (i, t), (n, h, _) in zip(rows, hits, strict=True):
        if not (h and 20 * h >= n):
            ids = enc.encode_ordinary(t)
            out[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def staged(spark, docs, folder):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    return Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect())


def test_pipeline_is_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == brute_pipeline(spark, docs, SMALL)


def test_pipeline_with_nulls_repeats_and_further_columns(spark, clashing):
    docs = clashing.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    assert staged(spark, docs, SMALL) == brute_pipeline(spark, docs, SMALL)
    assert not staged(spark, docs.limit(0), SMALL)


def test_word_sums_are_those_of_each_word():
    r = np.random.default_rng(5)
    part = r.integers(1, 256, 200_000).astype(np.uint8)
    start = np.array([0, 3, 65_530, 65_536, 100, 131_071, 150_000, 199_999])
    end = np.array([3, 9, 65_540, 65_537, 200, 131_073, 199_999, 200_000])
    base = int(shingles.BASE)
    want = [sum(int(x) * pow(base, j + 1, 1 << 64) for j, x in enumerate(part[a:b][:70_000])) % (1 << 64) for a, b in zip(start, end, strict=True)]
    assert shingles.word_sums(part, start, end).tolist() == want


def test_unlike_long_paragraphs_are_not_intersected(spark):
    """Sets of over BITS shingles fill the short marks, so only the wide maps tell them apart before the exact comparison."""
    from larkspur.llm.near import linked

    r = random.Random(11)
    common = [r.randrange(1 << 31) for _ in range(60)]
    sets = {n: set(common) | {r.randrange(1 << 31) for _ in range(120)} for n in range(60)}
    sets[58] = set(sorted(sets[3])[5:])  # a near copy
    full = int(np.array([(180 << substring_dedup.BITS) | ((1 << substring_dedup.BITS) - 1)], np.uint64).view(np.int64)[0])
    marks = spark.createDataFrame([(n, [1], full, sorted(s)) for n, s in sets.items()], "node bigint, keys array<bigint>, mark bigint, content array<int>")
    calls = spark.sparkContext.accumulator(0)

    def exact(rows):
        own = lambda i: set(rows[i][0][rows[i][1]].as_py())

        def similar(i, j):
            calls.add(1)
            return len(own(i) & own(j)) >= 0.8 * len(own(i) | own(j))

        return similar

    labels, _ = linked(
        marks.select(F.explode("keys").alias("key"), "node"),
        lambda pairs: pairs.filter("false"),
        marks,
        exact,
        lambda sketches, a, b: substring_dedup.possible_pairs(sketches.to_numpy(), a, b, 0.8),
        False,
        block=16,
        closer=lambda contents, a, b: substring_dedup.possible_sets(contents, a, b, 0.8),
    )
    assert {x.node: x.label for x in labels.collect()} == {n: 3 if n == 58 else n for n in sets}
    assert 1 <= calls.value <= 10  # of 1,711 pairs
    a, b = (np.array(side) for side in zip(*[(i, j) for i in range(60) for j in range(i)], strict=True))
    close = [len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    fine = substring_dedup.possible_sets(pa.array([sorted(sets[n]) for n in range(60)], pa.list_(pa.int32())), a, b, 0.8)
    assert fine[close].all() and any(close)
