"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces. Each language has a probability for each piece; a word's probability is the
sum over all its segmentations into pieces of the product of their probabilities, computed by a forward pass; a text's
log-likelihood is the sum over its words. Probabilities are learned by EM: expected piece counts come from the forward
and backward passes over the language's word counts. Characters outside the vocabulary get a small fixed probability.

Words are runs of letters and marks, lower-cased, with the vocabulary's word-start mark in front; no piece crosses a
word's start, so scoring by words is exact.

Training uses a bounded sample: of each language at most ``per_language`` documents, those of smallest hash of text; of
these all words count, with all pieces of the vocabulary. What reaches the driver is the sample's counted words.
Prediction is one scan without a shuffle over whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to the first language in
alphabetical order; without training rows every text with letters is ``und`` too; repeated rows are predicted each; an
empty table gives none; of further columns none is read, and ``identify`` keeps them, but for lang_pred and score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, sole

FIND_WORDS = regex.compile(r"[\p{L}\p{M}]+").findall
#: log-probability of a character that no piece covers, and the smallest of a piece.
FLOOR_CHAR, FLOOR_PIECE = -14.0, -16.0
START = "▁"


def piece_list(model_path: str) -> list[str]:
    """Lower-cased pieces of a public sentencepiece vocabulary that consist of letters, marks and the word start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    fine = regex.compile(rf"{START}?[\p{{L}}\p{{M}}]+").fullmatch
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in found if fine(p))


class Unigrams:
    """Log-probabilities of pieces by language; a word's vector of log-likelihoods, one entry for each language."""

    def __init__(self, languages: list[str], pieces: list[str], logs: np.ndarray, prior: np.ndarray, cache: int = 150_000):
        self.languages, self.prior, self.most = languages, prior, cache
        probs = np.exp(logs)
        self.rows = {p: i for i, p in enumerate(pieces)}
        self.probs = probs
        self.lists = probs.tolist()
        self.longest = max(map(len, pieces), default=1)
        self.unknown = [math.exp(FLOOR_CHAR)] * len(languages)
        # two more rows: a character outside the vocabulary, and no piece at all
        self.table = np.vstack([probs, self.unknown, np.zeros(len(languages))])
        self.forget()

    def forget(self) -> None:
        """Empties the memory of words."""
        self.known: dict[str, int] = {}
        self.values = np.zeros((1024, len(self.languages)))
        self.old: dict[str, int] = {}
        self.old_values = self.values

    def forward(self, word: str) -> tuple[float, ...]:
        """log of the sum over all segmentations, for each language. Scaled every few characters against underflow."""
        n, k = len(word), range(len(self.languages))
        lists, unknown, get, longest = self.lists, self.unknown, self.rows.get, self.longest
        sums: list = [[1.0] * len(k)]
        shift = [0.0] * len(k)
        for b in range(1, n + 1):
            own = [0.0] * len(k)
            for a in range(max(0, b - longest), b):
                row = get(word[a:b])
                p = lists[row] if row is not None else unknown if b == a + 1 else None
                if p is not None:
                    left = sums[a]
                    for j in k:
                        own[j] += left[j] * p[j]
            sums.append(own)
            if b > longest:
                sums[b - longest - 1] = None
            if b % 8 == 0:
                for j in k:
                    scale = own[j]
                    shift[j] += math.log(scale)
                    for i in range(max(0, b - longest), b + 1):
                        sums[i][j] /= scale
        return tuple(shift[j] + math.log(sums[n][j]) for j in k)

    def _room(self, more: int) -> int:
        """Makes room for more rows of values; the first free one."""
        start = len(self.known)
        if start + more > len(self.values):
            grown = np.zeros((2 * (start + more), len(self.languages)))
            grown[:start] = self.values[:start]
            self.values = grown
        return start

    def _learn(self, words: list[str]) -> None:
        """forward() of many words at once: those of one length share their spans, so each step is one array operation
        over them."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w) + 1, []).append(w)
        get, none = self.rows.get, len(self.rows) + 1
        for n, own in by.items():
            if n > PLAIN:
                logs = np.array([self.forward(START + w) for w in own])
            else:
                spans = [(a, b) for b in range(1, n + 1) for a in range(max(0, b - self.longest), b)]
                found = np.array(
                    [[get(w[a:b], none - 1 if b == a + 1 else none) for a, b in spans] for w in map(START.__add__, own)]
                )
                sums = [np.ones((len(own), len(self.languages)))] + [0.0] * n
                for j, (a, b) in enumerate(spans):
                    sums[b] = sums[b] + sums[a] * self.table[found[:, j]]
                logs = np.log(sums[n])
            start = self._room(len(own))
            self.values[start : start + len(own)] = logs
            self.known.update(zip(own, range(start, start + len(own)), strict=True))

    def texts(self, bodies: list[str]) -> list[tuple[int, np.ndarray]]:
        """Number of words, and log-likelihood for each language, of each text."""
        sole(self)
        split = [FIND_WORDS(b.lower()) for b in bodies]
        if len(self.known) > self.most:  # frequent words come back from the generation before
            self.old, self.old_values = self.known, self.values
            self.known, self.values = {}, np.zeros((1024, len(self.languages)))
        missing = {w for ws in split for w in ws}.difference(self.known)
        again = [w for w in missing if w in self.old]
        if again:
            start = self._room(len(again))
            self.values[start : start + len(again)] = self.old_values[[self.old[w] for w in again]]
            self.known.update(zip(again, range(start, start + len(again)), strict=True))
            missing.difference_update(again)
        if missing:
            self._learn(sorted(missing))
        get = self.known.__getitem__
        return [(len(ws), self.values[list(map(get, ws))].sum(0)) for ws in split]


#: Words up to this length stay in a double's range without scaling.
PLAIN = 40


def _grids(words: dict[str, int], rows: dict[str, int], longest: int) -> list[tuple]:
    """Words of one length at a time: their counts, the spans (start, end) they share, and for each word and span the row
    of its piece; a lone character outside the vocabulary has row len(rows), other spans without a piece len(rows) + 1."""
    by: dict[int, list[str]] = {}
    for w in words:
        if len(w) < PLAIN:
            by.setdefault(len(w) + 1, []).append(w)
    get, none, out = rows.get, len(rows) + 1, []
    for n, same in sorted(by.items()):
        spans = [(a, b) for b in range(1, n + 1) for a in range(max(0, b - longest), b)]
        for at in range(0, len(same), 8192):
            own = same[at : at + 8192]
            marked = [START + w for w in own]
            found = np.array([[get(w[a:b], none - 1 if b == a + 1 else none) for a, b in spans] for w in marked], np.int32)
            out.append((n, np.array([words[w] for w in own], float), spans, found))
    return out


def _expected(grids: list[tuple], long: dict[str, int], rows: dict[str, int], longest: int, probs: np.ndarray) -> np.ndarray:
    """Expected piece counts over the words of one language (forward and backward sums)."""
    size = len(probs)
    table = np.concatenate([probs, [math.exp(FLOOR_CHAR), 0.0]])
    counts = np.zeros(size + 2)
    for n, times, spans, found in grids:
        values = table[found]
        f = [np.ones(len(times))] + [np.zeros(len(times)) for _ in range(n)]
        back = [np.zeros(len(times)) for _ in range(n)] + [np.ones(len(times))]
        for j, (a, b) in enumerate(spans):
            f[b] += f[a] * values[:, j]
        for j in sorted(range(len(spans)), key=lambda j: -spans[j][0]):
            a, b = spans[j]
            back[a] += back[b] * values[:, j]
        share = times / f[n]
        for j, (a, b) in enumerate(spans):
            counts += np.bincount(found[:, j], f[a] * values[:, j] * back[b] * share, size + 2)
    for word, times in long.items():
        _expect_long(START + word, times, rows, longest, np.log(table[:-1]), counts)
    return counts[:size]


def _expect_long(word: str, times: int, rows: dict[str, int], longest: int, logs: np.ndarray, counts: np.ndarray) -> None:
    """The same for one word of any length, in logarithms."""
    n, none = len(word), len(rows)

    def row(a: int, b: int) -> int | None:
        return rows.get(word[a:b], none if b == a + 1 else None)

    def total(terms: list[float]) -> float:
        top = max(terms)
        return top + math.log(sum(math.exp(t - top) for t in terms))

    f, back = [0.0] * (n + 1), [0.0] * (n + 1)
    for b in range(1, n + 1):
        f[b] = total([f[a] + logs[r] for a in range(max(0, b - longest), b) if (r := row(a, b)) is not None])
    for a in range(n - 1, -1, -1):
        back[a] = total([back[b] + logs[r] for b in range(a + 1, min(n, a + longest) + 1) if (r := row(a, b)) is not None])
    for b in range(1, n + 1):
        for a in range(max(0, b - longest), b):
            if (r := row(a, b)) is not None:
                counts[r] += times * math.exp(f[a] + logs[r] + back[b] - f[n])


def train(
    docs: DataFrame,
    model_path: str,
    text: str = "text",
    lang: str = "lang",
    per_language: int = 400,
    rounds: int = 3,
) -> Unigrams:
    """Learns from rows with a language and a text; the sample's bound is ``per_language``."""
    pieces = piece_list(model_path)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")
    )
    # rows of each language, by partial aggregation
    cut = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r.lang: r.n for r in cut.select("lang", "n").collect()}
    if not sizes:
        return Unigrams([], pieces, np.zeros((len(pieces), 0)), np.zeros(0))
    # hashes are uniform: a threshold that keeps about twice the bound, the exact bound is set by rank below
    low, span = -(1 << 63), 1 << 64
    highest = {k: min((1 << 63) - 1, low + int(span * min(1.0, 2 * per_language / n))) for k, n in sizes.items()}
    limit = F.create_map(*[F.lit(x) for pair in highest.items() for x in pair])
    from pyspark.sql import Window

    ranked = (
        rows.filter(F.col("h") <= limit[F.col("lang")])
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
        .filter(F.col("rank") <= per_language)
    )

    def count(batches):
        for batch in slices(batches):
            found: Counter = Counter()
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in Counter(FIND_WORDS(body.lower())).items():
                    found[language, w] += n
            yield pa.RecordBatch.from_pydict(
                {"lang": [k for k, _ in found], "word": [w for _, w in found], "n": list(found.values())},
                pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]),
            )

    counts = ranked.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    by: dict[str, dict[str, int]] = {k: {} for k in sorted(sizes)}
    for language, word, n in zip(*(got.column(c).to_pylist() for c in range(3)), strict=True):
        by[language][word] = n
    rows_of = {p: i for i, p in enumerate(pieces)}
    longest = max(map(len, pieces), default=1)
    logs = []
    for words in by.values():
        grids = _grids(words, rows_of, longest)
        long = {w: n for w, n in words.items() if len(w) >= PLAIN}
        probs = np.full(len(pieces) + 2, 1.0)
        for _, times, _, found in grids:  # start: every piece inside a word counts
            for j in range(found.shape[1]):
                probs += np.bincount(found[:, j], times, len(probs))
        probs = probs[:-2] / probs[:-2].sum()
        for _ in range(rounds):
            got = _expected(grids, long, rows_of, longest, probs)
            probs = np.maximum(got / max(got.sum(), 1e-9), math.exp(FLOOR_PIECE))
            probs /= probs.sum()
        logs.append(np.log(probs))
    total = sum(sizes.values())
    prior = np.array([math.log(sizes[k] / total) for k in by])
    return Unigrams(list(by), pieces, np.array(logs).T, prior)


def predict(model: Unigrams, bodies: list[str | None], temper: float = 0.1) -> list[tuple[str, float]]:
    """Language and score of each text: the posterior with each word's evidence weighted by ``temper``."""
    out = []
    for n, total in model.texts([b or "" for b in bodies]):
        if not n or not model.languages:
            out.append(("und", 0.0))
            continue
        v = total * temper + model.prior
        best = int(np.argmax(v))
        out.append((model.languages[best], float(1.0 / np.exp(v - v[best]).sum())))
    return out


def identify(docs: DataFrame, model: Unigrams, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with lang_pred and score (columns of those names are replaced)."""
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields])
    schema.add("lang_pred", T.StringType()).add("score", T.DoubleType())
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = broadcast.value
        for batch in slices(batches, 128, own):
            found = predict(own, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([a for a, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )

    return frame.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Unigrams, min_score: float = 0.0) -> DataFrame:
    """Rows whose text has a language (not ``und``) with at least that score; every column kept."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = broadcast.value
        for batch in slices(batches, 128, own):
            found = predict(own, batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([a != "und" and s >= min_score for a, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
