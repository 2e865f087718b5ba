"""Operator 3: toxicity by a weighted lexicon and one Aho-Corasick pass.

Folding undoes disguise: compatibility forms and accents are reduced to base
letters, look-alike letters of other scripts become the Latin ones, and digits
or signs standing for letters inside a word are replaced. The folded words,
joined by single spaces, are scanned once by an automaton that holds all
lexicon entries: whole words (" term ") and word beginnings (" stem").

The lexicon is learned from labelled documents: entries are words and word
beginnings whose share of toxic documents is far above that of clean ones;
the weight is the smoothed log odds. Exception phrases (learned two-word phrases
in which an entry occurs in clean documents, and given ones) silence the
matches they cover. A document's weighted sum, by itself and normalised by its
length, goes through a logistic curve fitted on the same labelled documents.

Only the fit uses labels, and it reads at most ``sample_rows`` labelled rows
(a documented bound; taken by the hash of the id, spread over the cluster).
Scoring reads every whole text in one pass without a shuffle; the broadcast
model holds what enough of the sampled documents share (``min_docs`` for an entry,
three for a phrase), so the sample bounds it.

Defined cases: null and empty texts score as a text without matches; labels
that are null or whose document is missing teach nothing; without any toxic or
clean example the score is the share of toxic labels; repeated rows repeat;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import filter_rows, fold_of, id_and_text, table
from vigil.session import materialize

# Letters of other scripts that look like a Latin letter.
LOOK_ALIKES = dict(zip("аесорхуіјѕԁһкмтвнгαεορυχικντβηωıƖɑɡ",
                       "aecopxyijsdhkmtbhraeopuxikvtbhwilag", strict=True))
# Digits and signs written for a letter inside a word.
FOR_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

STEM_LENGTHS = (5, 6, 7)

_WORD = re.compile(r"(?:[^\W_]|[@$](?=[^\W_]))(?:[\w@$!|]*[^\W_])?")
_DISGUISED = re.compile(r"[0-9@$!|]")


class _FoldTable(dict):
    """str.translate table filled on demand: base letter of each character."""

    def __missing__(self, code: int) -> str:
        low = unicodedata.normalize("NFKD", chr(code)).lower()
        low = "".join(LOOK_ALIKES.get(c, c) for c in low if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        self[code] = low
        return low


_FOLD = _FoldTable()
_LETTERS = str.maketrans(FOR_LETTERS)


def folded_words(text: str | None) -> list[str]:
    words = _WORD.findall((text or "").translate(_FOLD))
    return [w.translate(_LETTERS) if _DISGUISED.search(w) and not w.isdigit() else w for w in words]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " stem"
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)       # intercept, log sum, sum by length

    def automaton(self):
        """Entries and exceptions by their spelling with l read as i, for 1, ! and | fold to i but may stand for l;
        each holds the entries so spelt."""
        import ahocorasick
        spelt: dict[str, list[tuple[str, float | None]]] = {}
        for key, weight in {**self.weights, **{f" {p} ": None for p in self.exceptions}}.items():
            spelt.setdefault(key.replace("l", "i"), []).append((key, weight))
        found = ahocorasick.Automaton()
        for key, entries in spelt.items():
            found.add_word(key, entries)
        if len(found):
            found.make_automaton()
        return found

    def measure(self, automaton, words: list[str]) -> tuple[float, float]:
        """log(1 + weighted sum) and the sum over the root of the length."""
        if not words or not len(automaton):
            return 0.0, 0.0
        covered, hits = [], []
        text = " " + " ".join(words) + " "
        for end, entries in automaton.iter(text.replace("l", "i")):
            size = len(entries[0][0])
            seen = text[end - size + 1:end + 1]
            exact = [e for e in entries if e[0] == seen]  # the spelling itself goes before what it may stand for
            for key, weight in exact or entries:
                if exact or weight is not None and all(c == k or (c == "i" and k == "l") for c, k in zip(seen, key, strict=True)):
                    (covered if weight is None else hits).append((end - size + 1, end, weight))
        if covered:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in covered)]
        at: dict[int, float] = {}
        for start, _, weight in hits:  # a word counts once, by its heaviest entry
            at[start] = max(at.get(start, 0.0), weight)
        total = sum(at.values())
        return math.log1p(total), total / math.sqrt(len(words))

    def score(self, automaton, words: list[str]) -> float:
        a, b = self.measure(automaton, words)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def _sampled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic) of at most about ``sample_rows`` labelled rows outside the held-out fold."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("toxic IN (0, 1)").filter(fold_of(F.col("doc_id")) != 0))
    total = known.count()
    if total > sample_rows:  # the lowest hashes of the id
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * sample_rows / total))
    return materialize(id_and_text(docs).join(known, "doc_id").select("doc_id", "text", "toxic"), "labelled")


def _terms_of(words: list[str]) -> set[str]:
    terms = set()
    for w in set(words):
        terms.add(f" {w} ")
        terms.update(f" {w[:k]}" for k in STEM_LENGTHS if len(w) > k)
    return terms


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, min_docs: int = 6,
        min_log_odds: float = 3.0, exceptions: tuple[str, ...] = ()) -> Lexicon:
    sample = _sampled(docs, labels, sample_rows)

    def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                by[toxic].update(_terms_of(folded_words(text)))
            terms = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([by[1][t] for t in terms], pa.int64()),
                                              pa.array([by[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    docs_by = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = docs_by.get(1, 0), docs_by.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 1) / (n_toxic + n_clean + 2)
        return Lexicon(curve=(math.log(share / (1 - share)), 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    needed = max(2, min(min_docs, n_toxic // 4))
    best = (sample.select("text", "toxic").mapInArrow(term_counts, "term string, toxic long, clean long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .filter(F.col("toxic") >= needed).withColumn("odds", odds).filter(F.col("odds") >= min_log_odds)
            .collect())
    weights: dict[str, float] = {}
    for r in sorted(best, key=lambda r: (len(r.term), r.term)):  # a word whose beginning is an entry adds nothing
        if not any(r.term[:k] in weights for k in range(2, len(r.term))):
            weights[r.term] = r.odds
    lexicon = Lexicon(weights)
    lexicon.exceptions = tuple(exceptions) + _learned_exceptions(sample, lexicon)
    lexicon.curve = _fit_curve(sample, lexicon)
    return lexicon


def _learned_exceptions(sample: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Two-word phrases with an entry that clean documents use and toxic ones hardly do."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon.weights)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        lengths = sorted({len(k) for k in weights if not k.endswith(" ")})

        def entry(w: str) -> bool:
            return f" {w} " in weights or any(f" {w}"[:n] in weights for n in lengths)

        for batch in batches:
            by = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = folded_words(text)
                at = [i for i, w in enumerate(words) if entry(w)]
                by[toxic].update({f"{words[i]} {words[i + 1]}" for j in at for i in (j - 1, j) if 0 <= i < len(words) - 1})
            seen = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([by[1][t] for t in seen], pa.int64()),
                                              pa.array([by[0][t] for t in seen], pa.int64())], ["phrase", "toxic", "clean"])

    rows = (sample.select("text", "toxic").mapInArrow(phrases, "phrase string, toxic long, clean long")
            .groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .filter("clean >= 3 AND clean >= 10 * toxic").collect())
    return tuple(sorted(r.phrase for r in rows))


def _fit_curve(sample: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression on the two measures, from their counts in cells 0.05
    wide (at most one a sampled document)."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                a, b = shared.value.measure(automaton, folded_words(text))
                counts[(round(a * 20), round(b * 20), toxic)] += 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
                                             + [pa.array([counts[k] for k in keys], pa.int64())], ["a", "b", "toxic", "n"])

    rows = (sample.select("text", "toxic").mapInArrow(cells, "a int, b int, toxic int, n long")
            .groupBy("a", "b", "toxic").agg(F.sum("n").alias("n")).collect())
    x = np.array([[1.0, r.a / 20, r.b / 20] for r in rows])
    y = np.array([r.toxic for r in rows], dtype=float)
    n = np.array([r.n for r in rows], dtype=float)
    beta = np.zeros(3)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (y - p)) - 0.1 * beta
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        beta += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            scores = [shared.value.score(automaton, folded_words(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(per_batch, "doc_id long, score double")


def without_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows that score below one half, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def judge():
        automaton = shared.value.automaton()
        return lambda texts: [shared.value.score(automaton, folded_words(t)) >= 0.5 for t in texts]

    return filter_rows(docs, text_col, judge)


def op3_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, fitted outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
