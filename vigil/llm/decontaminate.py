"""Operator 8: benchmark decontamination by latent semantic retrieval.

1. Words (folded to lower case, runs of letters and digits) of benchmark items
   form the vocabulary; items are cut into passages of at most ``ITEM_WORDS``
   words. Documents are read in windows of twice that, overlapping by half, so
   every passage-sized stretch lies whole in some window.
2. One pass counts, over all stretches of ``ITEM_WORDS`` words of all documents,
   in how many each vocabulary word occurs: the inverse frequencies of TF-IDF.
3. A randomised SVD of the TF-IDF passages gives the latent space. The passage
   rows stay distributed: a task multiplies its rows with the random matrix (and,
   in the power steps, with the current basis), only (words x rank) sums leave it.
4. A second pass reads every window and takes candidates by two doors. The
   latent door folds all windows into that space and takes the passages whose
   cosine is at least ``min_cosine``. The verbatim door needs no cosine: a passage
   of n words of which step 5 allows m to be missing has at least three of its
   m + 3 rarest words in the window (an exact bound), so an index of those words
   loses no close copy to the space's ``rank`` or to a window that dilutes a short
   passage. Passages that keep less than ``MIN_KEPT`` of their energy in the space
   can't be judged by a cosine and use the second door for rewordings too. The
   benchmark is the stated query set: it is broadcast in blocks of at most
   ``item_block`` passages, each with a latent space of its own.
5. A candidate is confirmed by the longest common subsequence of words with the
   window (a share of the passage's words, in order, gaps allowed, within a
   stretch not much longer than the passage), and by the answer check: the end of
   the passage, where the answer stands, must be found too. The share is
   ``min_share``; a candidate of the latent door, whose words as a whole point the
   passage's way, is a paraphrase from ``latent_share`` and ``MIN_WORDS`` words on.

Words outside the vocabulary cannot change a product with an item, so windows
are folded from their vocabulary words alone. No row is shuffled but the
confirmed matches.

Defined cases: null and empty texts match nothing, items that are null or have
no words match nothing; items shorter than ``MIN_WORDS`` words must occur word
for word; repeated rows repeat; equal items are each reported; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import filter_rows, id_and_text, table
from vigil.session import materialize

ITEM_WORDS = 64
MIN_WORDS = 8
RANK = 96
MIN_KEPT = 0.1
OVERSAMPLE = 16
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def passages_of(words: list[str], size: int = ITEM_WORDS) -> list[list[str]]:
    """Consecutive parts of about equal length, none above ``size``."""
    parts = -(-len(words) // size)
    return [words[len(words) * i // parts:len(words) * (i + 1) // parts] for i in range(parts)]


class Items:
    """A block of benchmark passages: (item_id, part, words) and the vocabulary."""

    def __init__(self, rows: list[tuple[int | None, int, list[str]]]):
        self.rows = rows
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for r in rows for w in r[2]}))}
        self.codes = [np.array([self.vocabulary[w] for w in r[2]], dtype=np.int32) for r in rows]
        self.idf = np.ones(len(self.vocabulary))
        self.basis = np.zeros((len(self.vocabulary), 1), dtype=np.float32)
        self.latent = np.zeros((len(rows), 1), dtype=np.float32)
        self.kept = np.ones(len(rows))

    def weigh(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit TF-IDF weights of a passage."""
        terms, counts = np.unique(codes, return_counts=True)
        weights = (1 + np.log(counts)) * self.idf[terms]
        return terms, weights / max(np.linalg.norm(weights), 1e-12)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary codes of all words (-1 for other words and filling) and
        the text that each stretch of ``ITEM_WORDS`` words belongs to. Every
        text fills whole stretches and one empty one, so that a window, a
        stretch and the next, never holds words of two texts."""
        get = self.vocabulary.get
        parts, stretches = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            words = words_of(text)
            if words:
                stretches[i] = -(-len(words) // ITEM_WORDS) + 1
                parts.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
                parts.append(np.full(stretches[i] * ITEM_WORDS - len(words), -1, dtype=np.int32))
        return np.concatenate([np.empty(0, np.int32), *parts]), np.repeat(np.arange(len(texts)), stretches)

    def index_rare_words(self, min_share: float, latent_share: float, together: int = 3) -> None:
        """Words a match needs by either door, and each passage's rarest words: as many as may be missing and
        ``together`` more, which a match must hold."""
        sizes = np.fromiter(map(len, self.codes), np.int64, len(self.codes))
        self.least = np.ceil(min_share * sizes - 1e-9).astype(np.int64)
        self.loose = np.minimum(self.least, np.maximum(np.ceil(latent_share * sizes - 1e-9).astype(np.int64), MIN_WORDS))
        self.unkept = self.kept < MIN_KEPT
        self.least[self.unkept] = self.loose[self.unkept]
        self.need = np.zeros(len(self.rows), dtype=np.int64)
        pairs: list[tuple[int, int]] = []
        for p, codes in enumerate(self.codes):
            spare = len(codes) - int(self.least[p])
            distinct = np.unique(codes)
            rarest = distinct[np.argsort(-self.idf[distinct], kind="stable")][:spare + together]
            self.need[p] = len(rarest) - spare
            pairs += [(int(t), p) for t in rarest] if self.need[p] > 0 else []
        pairs.sort()
        self.rare = np.zeros(len(self.vocabulary), dtype=bool)
        self.rare[[t for t, _ in pairs]] = True
        self.holders = np.array([p for _, p in pairs], dtype=np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], dtype=np.int64), np.arange(len(self.vocabulary) + 1))
        self.joined = np.concatenate(self.codes)
        self.lengths = sizes
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.always = np.flatnonzero(self.need < 1)  # repetitive passages: every window is met with them

    def meetings(self, codes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        """window * passages + passage where the window holds enough of the passage's rare words."""
        n = len(self.rows)
        at = np.flatnonzero((codes >= 0) & self.rare[codes])
        window, term = at // ITEM_WORDS, codes[at].astype(np.int64)
        begun = (window > 0) & (text_of[window] == text_of[window - 1])  # the window that began one stretch earlier
        pairs = np.unique(np.concatenate([window, window[begun] - 1]) * len(self.rare) + np.concatenate([term, term[begun]]))
        window, term = pairs // len(self.rare), pairs % len(self.rare)
        many = self.first[term + 1] - self.first[term]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found, counts = np.unique(np.repeat(window, many) * n + self.holders[np.repeat(self.first[term], many) + within],
                                  return_counts=True)
        found = found[counts >= np.maximum(self.need[found % n], 1)]
        if len(self.always):
            found = np.union1d(found, (np.arange(len(text_of))[:, None] * n + self.always[None, :]).reshape(-1))
        return found

    def latent_meetings(self, codes: np.ndarray, text_of: np.ndarray, min_cosine: float, block: int = 1024) -> np.ndarray:
        """window * passages + passage where the cosine in the latent space is at least ``min_cosine``; a window
        is the sum of its two stretches."""
        n, size, many = len(self.rows), len(self.vocabulary), len(text_of)
        at = np.flatnonzero(codes >= 0)
        keys, counts = np.unique(at // ITEM_WORDS * size + codes[at], return_counts=True)
        stretch, term = keys // size, keys % size
        weighted = self.basis * self.idf[:, None].astype(np.float32)
        folded = np.zeros((many, weighted.shape[1]), dtype=np.float32)
        edges = np.searchsorted(stretch, np.arange(0, many + block, block))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo < hi:
                rows = weighted[term[lo:hi]]
                often = np.flatnonzero(counts[lo:hi] > 1)
                rows[often] *= (1 + np.log(counts[lo:hi][often])).astype(np.float32)[:, None]
                heads = np.flatnonzero(np.diff(stretch[lo:hi], prepend=-1))
                folded[stretch[lo:hi][heads]] = np.add.reduceat(rows, heads, axis=0)
        followed = np.flatnonzero(text_of[1:] == text_of[:-1])
        windows = folded.copy()
        windows[followed] += folded[followed + 1]
        norms = np.linalg.norm(windows, axis=1)
        found = [np.empty(0, dtype=np.int64)]
        for lo in range(0, many, block):
            cosines = windows[lo:lo + block] @ self.latent.T
            bar = np.where(norms[lo:lo + block] > 1e-9, min_cosine * norms[lo:lo + block], np.inf)
            window, passage = np.nonzero(cosines >= bar[:, None].astype(np.float32))
            found.append((lo + window) * n + passage)
        return np.concatenate(found)

    def covered(self, codes: np.ndarray, met: np.ndarray, least: np.ndarray, block: int = 256, pairs: int = 1 << 15) -> np.ndarray:
        """Which of the pairs (ordered, window * passages + passage) have in the window at least so many words of
        the passage."""
        n, taken = len(self.rows), np.zeros(len(met), dtype=bool)
        windows, passages = met // n, met % n
        present = np.zeros((block + 1, len(self.vocabulary)), dtype=bool)  # of each stretch, then of it and the next
        lo = 0
        while lo < len(met):
            first = int(windows[lo])
            last = int(np.searchsorted(windows, first + block))
            part = codes[first * ITEM_WORDS:(first + block + 1) * ITEM_WORDS]
            at = np.flatnonzero(part >= 0)
            present[:] = False
            present[at // ITEM_WORDS, part[at]] = True
            present[:-1] |= present[1:]
            flat = present.reshape(-1)
            for i in range(lo, last, pairs):
                some = slice(i, min(i + pairs, last))
                many = self.lengths[passages[some]]
                cuts = np.cumsum(many) - many
                word = np.arange(many.sum()) + np.repeat(self.begins[passages[some]] - cuts, many)
                held = flat[np.repeat((windows[some] - first) * len(self.vocabulary), many) + self.joined[word]]
                taken[some] = np.add.reduceat(held, cuts, dtype=np.int64) >= least[some]
            lo = last
        return taken


def read_items(benchmark: DataFrame, item_block: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """Blocks of at most ``item_block`` passages, one block on the driver at a time."""
    held: list[tuple] = []
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        words = words_of(r.t)
        held += [(r.i, k, p) for k, p in enumerate(passages_of(words))] if words else []
        while len(held) >= item_block:
            yield Items(held[:item_block])
            held = held[item_block:]
    if held:
        yield Items(held)


def runs(texts: list[str | None], characters: int = 4_000_000) -> Iterator[list[str | None]]:
    """Consecutive texts of about so many characters together (one long text alone)."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= characters:
            yield texts[start:i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def _count_windows(docs: DataFrame, items: Items) -> tuple[int, np.ndarray]:
    """Stretches in all documents, and in how many each vocabulary word occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        df, windows = np.zeros(len(block.vocabulary), dtype=np.int64), 0
        for batch in batches:
            for texts in runs(batch.column("text").to_pylist()):
                codes, text_of = block.encode(texts)
                windows += len(text_of)
                at = np.flatnonzero(codes >= 0)
                found = np.unique(at // ITEM_WORDS * len(df) + codes[at])
                df += np.bincount(found % len(df), minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(df[seen], windows), pa.int64())],
                                         ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(items.vocabulary), dtype=np.int64)
    for r in rows:  # at most one row per vocabulary word
        if r.term >= 0:
            df[r.term] = r.n
    return sum(r.n for r in rows if r.term < 0), df


def randomised_svd(passages: DataFrame, items: Items, rank: int, power_steps: int = 2, seed: int = 17) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF rows of
    ``passages(codes)``. Each step is one distributed product A'(A Q)."""
    spark = passages.sparkSession
    width = min(rank + OVERSAMPLE, len(items.vocabulary))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(items.vocabulary), width)))[0]
    for _ in range(power_steps + 1):
        shared = spark.sparkContext.broadcast((items, q))

        def product(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, basis = shared.value
            total = np.zeros_like(basis)
            touched = np.zeros(len(basis), dtype=bool)
            for batch in batches:
                for codes in batch.column("codes").to_pylist():
                    terms, weights = block.weigh(np.array(codes, dtype=np.int32))
                    total[terms] += weights[:, None] * (weights @ basis[terms])[None, :]
                    touched[terms] = True
            some = np.flatnonzero(touched)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.float64()))], ["term", "v"])

        sums = (passages.mapInArrow(product, "term int, v array<double>")
                .groupBy("term").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)]).collect())
        z = np.zeros_like(q)
        for r in sorted(sums):
            z[r[0]] = r[1:]
        q, singular, _ = np.linalg.svd(z, full_matrices=False)
    return q[:, :rank][:, singular[:rank] > 1e-9]


def fit(docs: DataFrame, items: Items, rank: int = RANK) -> Items:
    """Inverse frequencies from all windows of all documents, and the latent space of the passages."""
    spark = docs.sparkSession
    windows, df = _count_windows(docs, items)
    items.idf = np.log1p(max(1, windows) / np.maximum(df, 1))
    parts = max(1, len(items.rows) // 2000)
    passages = spark.createDataFrame([(c.tolist(),) for c in items.codes], "codes array<int>").repartition(parts)
    items.basis = randomised_svd(passages, items, rank).astype(np.float32)
    folded = []
    for codes in items.codes:
        terms, weights = items.weigh(codes)
        folded.append(weights @ items.basis[terms])
    latent = np.array(folded, dtype=np.float32)
    length = np.linalg.norm(latent, axis=1, keepdims=True)
    items.kept = length[:, 0] ** 2
    items.latent = latent / np.maximum(length, 1e-12)
    return items


def candidates(items: Items, codes: np.ndarray, text_of: np.ndarray, min_cosine: float) -> list[tuple[int, int, bool]]:
    """(window, passage, whether a paraphrase is enough) of the pairs met by either door that hold the words
    a match needs."""
    n = len(items.rows)
    alike = items.latent_meetings(codes, text_of, min_cosine)
    met = np.union1d(alike, items.meetings(codes, text_of))
    loose = np.isin(met, alike, assume_unique=True) | items.unkept[met % n]
    least = np.where(loose, items.loose[met % n], items.least[met % n])
    taken = np.flatnonzero(items.covered(codes, met, least))
    return [(int(met[i] // n), int(met[i] % n), bool(loose[i])) for i in taken]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine-word row at a time (bit-parallel)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = masks.get(x, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def confirmed(items: Items, passage: int, codes: np.ndarray, window: int, loose: bool, min_answer: float) -> float:
    """Share of the passage's words found in order in the window, 0 if the
    share or the answer (its last quarter) is not enough."""
    target = items.codes[passage]
    n = len(target)
    least = (items.loose if loose else items.least)[passage]
    lo = window * ITEM_WORDS
    text = codes[lo:lo + 2 * ITEM_WORDS]
    near = text[np.isin(text, target)]
    if len(near) < least:
        return 0.0
    if n < MIN_WORDS:
        spans = np.lib.stride_tricks.sliding_window_view(text, n) if len(text) >= n else np.empty((0, n), np.int32)
        return float((spans == target).all(axis=1).any())
    span = n + max(4, n // 2)
    best, answer = 0.0, 0.0
    tail = target[-max(3, n // 4):]
    for at in range(0, max(1, len(text) - n + 1), max(1, n // 4)):
        part = text[at:at + span]
        share = common_subsequence(target, part) / n
        if share > best:
            best, answer = share, common_subsequence(tail, part) / len(tail)
    return best if best * n >= least - 1e-6 and answer >= min_answer else 0.0


def find(items: Items, texts: list[str | None], min_cosine: float, min_answer: float) -> Iterator[tuple[int, int, float]]:
    """(index of the text, passage, share) of the confirmed matches, the best window of each pair."""
    start = 0
    for part in runs(texts):
        codes, text_of = items.encode(part)
        best: dict[tuple[int, int], float] = {}
        for window, passage, loose in candidates(items, codes, text_of, min_cosine):
            share = confirmed(items, passage, codes, window, loose, min_answer)
            pair = (start + int(text_of[window]), passage)
            if share > best.get(pair, 0.0):
                best[pair] = share
        yield from ((i, p, share) for (i, p), share in best.items())
        start += len(part)


def fitted_blocks(docs: DataFrame, benchmark: DataFrame, min_share: float, latent_share: float, rank: int,
                  item_block: int) -> Iterator:
    """The benchmark in broadcast blocks, each with its latent space and rare words."""
    for block in read_items(benchmark, item_block):
        fit(docs, block, rank).index_rare_words(min_share, latent_share)
        yield docs.sparkSession.sparkContext.broadcast(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_cosine: float = 0.35, min_share: float = 0.7,
                 min_answer: float = 0.5, latent_share: float = 0.55, rank: int = RANK, item_block: int = 1024) -> DataFrame:
    """(doc_id, item_id, part, share): the confirmed matches, the best share of each document and passage."""
    plain = id_and_text(docs)
    schema = "doc_id long, item_id long, part int, share double"
    found = []
    for shared in fitted_blocks(plain, benchmark, min_share, latent_share, rank, item_block):

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = shared.value.rows
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                out = [(ids[i], rows[p][0], rows[p][1], share) for i, p, share
                       in find(shared.value, batch.column("text").to_pylist(), min_cosine, min_answer)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 ["doc_id", "item_id", "part", "share"])

        found.append(materialize(plain.mapInArrow(search, schema), "matches"))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, min_cosine: float = 0.35, min_share: float = 0.7,
                      min_answer: float = 0.5, latent_share: float = 0.55, rank: int = RANK, item_block: int = 1024,
                      text_col: str = "text") -> DataFrame:
    """The rows without a confirmed match, all columns."""
    kept = docs
    plain = docs.select(F.col(text_col).cast("string").alias("text"))
    for shared in fitted_blocks(plain, benchmark, min_share, latent_share, rank, item_block):

        def judge(shared=shared):
            def verdicts(texts: list) -> list[bool]:
                hit = {i for i, _, _ in find(shared.value, texts, min_cosine, min_answer)}
                return [i in hit for i in range(len(texts))]
            return verdicts

        kept = filter_rows(kept, text_col, judge)
    return kept


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item found in all documents."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
