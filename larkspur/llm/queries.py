"""Queries of the corpus operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_runs

    runs = repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return runs.select("doc_id", "kept_doc_ids", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "n_words")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents, encoding_digests

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encoding_digests(encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stored
    from .quality import featured, score_featured, train_featured

    held_out = crc32_mod("doc_id", 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    made = stored(featured(docs), "features")  # texts are read once, for training and for scoring
    model = train_featured(made.filter("NOT held_out"), table(spark, sf_dir, "labels").filter(~held_out))
    found = score_featured(made, model)
    return found.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_classes

    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .language import identify, train

    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 5) == 0
    model = train(docs.filter(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import new_path
    from .idstore import read_sums, write_store

    path = new_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_sums(spark, path)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_mod("doc_id", 4) == 2
    model = train(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    found = score(docs.withColumn("held_out", held_out), model)
    return found.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("text", "lang")).withColumnRenamed("part", "lang")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality": op5_quality,
    "op6_near_dup": op6_near_dup,
    "op7_fingerprints": op7_fingerprints,
    "op8_language": op8_language,
    "op9_html_text": op9_html_text,
    "op10_id_store": op10_id_store,
    "op11_toxicity": op11_toxicity,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM i, (VALUES (1), (2), (3), (4), (5)) x(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM g WHERE k > 1 AND NOT EXISTS
  (SELECT 1 FROM g y WHERE y.lang = g.lang AND y.k > g.k AND y.f >= g.f AND contains(' ' || y.phrase || ' ', ' ' || g.phrase || ' '))),
s AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM c),
x AS (SELECT s.lang, s.phrase, s.f AS a, s.cut, l.f AS l, r.f AS r, t.n,
    (1000::HUGEINT * s.f * t.n::HUGEINT) // (l.f::HUGEINT * r.f) AS score
  FROM s JOIN g l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:s.cut], ' ')
    JOIN g r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[s.cut + 1:s.k], ' ') JOIN t ON t.lang = s.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE o = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score
FROM k WHERE rank <= 2000
""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part,
  CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
    [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit <> b.bit AND a.bit <> c.bit AND a.bit <> d.bit AND a.bit <> e.bit
    AND b.bit <> c.bit AND b.bit <> d.bit AND b.bit <> e.bit AND c.bit <> d.bit AND c.bit <> e.bit AND d.bit <> e.bit),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
  FROM o, (VALUES (1), (2), (3), (4), (5)) x(step)),
r AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
""",
    "op7_fingerprints": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT doc_id, t, n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS u FROM d),
e AS (SELECT doc_id, t, n, u, left(t, n - n // 3) || left(u, n // 3) AS e FROM o),
x AS (SELECT doc_id, n, e, 0 AS which, t AS s FROM e UNION ALL SELECT doc_id, n, e, 1, e FROM e UNION ALL SELECT doc_id, n, e, 2, u FROM e),
p AS (SELECT doc_id, n, e, which, i, list_aggregate(list_transform(string_split_regex(regexp_replace(p, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)),
        lambda y: sha256(y)), 'string_agg', '.') AS leaf
      FROM (SELECT doc_id, n, e, which, unnest(string_split(s, chr(10))) AS p, generate_subscripts(string_split(s, chr(10)), 1) AS i FROM x)),
l AS (SELECT doc_id, n, e, which, regexp_replace(string_agg(leaf || CASE WHEN left(sha256(leaf), 1) < '4' THEN ';' ELSE ',' END, '' ORDER BY i), '[;,]$', '') AS leaves
      FROM p GROUP BY ALL),
s AS (SELECT *, list_aggregate(list_transform(string_split(leaves, ';'), lambda y: sha256(y)), 'string_agg', ',') AS sections,
        list_distinct(list_transform(string_split_regex(leaves, '[.,;]'), lambda y: left(y, 12))) AS ls FROM l),
f AS (SELECT *, sha256(sections) AS root, sha256(sections) || ' ' || regexp_replace(sections, '([0-9a-f]{12})[0-9a-f]{52}', '\1', 'g')
        || ' ' || regexp_replace(leaves, '([0-9a-f]{12})[0-9a-f]{52}', '\1', 'g') AS fp FROM s),
j AS (SELECT a.doc_id, a.n, a.e, a.fp, b.fp AS fe, a.root = b.root AS same_e, a.root = c.root AS same_n,
        len(list_intersect(a.ls, b.ls))::DOUBLE AS ie, len(list_distinct(list_concat(a.ls, b.ls)))::DOUBLE AS ue,
        len(list_intersect(a.ls, c.ls))::DOUBLE AS nx, len(list_distinct(list_concat(a.ls, c.ls)))::DOUBLE AS un
      FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.which = 0 AND b.which = 1 JOIN f c ON a.doc_id = c.doc_id AND c.which = 2)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, fp AS fingerprint, fe AS edited_fingerprint,
  CASE WHEN same_e THEN 1.0::DOUBLE ELSE least(ie / ue, ue / (ue + 1)) END AS near_edited,
  CASE WHEN same_n THEN 1.0::DOUBLE ELSE least(nx / un, un / (un + 1)) END AS near_next
FROM j
""",
    "op1_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
occ AS (SELECT p.doc_id, p.i, p.k, win.item_id FROM pos p JOIN win ON win.k = p.k AND win.s = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
}
