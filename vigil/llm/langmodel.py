"""Operator 5: language-model scores by deleted interpolation.

A token is a word (A-Z lower-cased, split at ASCII white space) or the end of a
text; words that training never saw are one further outcome, <unk>. With v the
token before (or the start of the text),

    P(w | v) = l_2(b) * ML_2(w | v) + l_1(b) * ML_1(w) + l_0(b) * [w is <unk>]

ML_1 is the unigram estimate c(w) / N, ML_2 the bigram estimate c(v, w) / c(v) over
all words. b is the bucket (base-2 logarithm) of the context's frequency c(v). The
weights l are learned per bucket by deleted interpolation: estimates from one part
of the training documents, counts from another; the estimates then use both. They
make the held-out counts likeliest: l_0 is the share of unseen words, and between
l_2 and l_1 the likelihood has one top, which passes over the events close in on.
(A caller may ask for a smaller model: with ``frequent``, words below one
``1 / frequent``-th of the tokens share one class in ML_2, and a word its share of it.)

Flow: one pass over the texts turns them into blocks of about ``BLOCK_CHARS``
characters (token numbers and the block's distinct words with their counts),
written once to the shared folder. A block's distinct words, and later its distinct
pairs, are dealt to buckets by a hash, one compressed row a block and bucket, summed
there over the blocks and sent back in the order they came in. So a word or a pair
costs a few bytes per block however often it occurs, and neither table is ever
collected; there is a bucket for every ``BLOCKS_A_BUCKET`` blocks, so a bucket's size
does not grow. Texts are moved as token numbers, from block to block only.

Defined cases: null text is empty (one end token); documents with null ids are
training documents; without training tokens every word is <unk> with probability
one; repeated rows repeat; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import fold_of, id_and_text, table
from vigil.session import materialize, release

BLOCK_CHARS = 8_000_000
BLOCKS_A_BUCKET = 2
END = b"\n"  # no word holds white space
HELD_OUT, WEIGHTS_FROM = 1, 2  # folds: not learned from; counted apart for the weights
BUCKETS = 48
START, CLASS, FIRST = 0, 1, 2  # numbers of the text's start, of the infrequent words together, of the first word

_BLOCK = ("block long, doc_id array<long>, fold array<int>, n_tokens array<int>, codes binary, "
          "n_words int, words binary, estimate binary, weights binary, estimate_docs long, weights_docs long")
_WORDS = "bucket int, block long, n int, places binary, words binary, estimate binary, weights binary"
_KNOWN = "bucket int, block long, n int, places binary, ids binary, estimate binary, total binary"
_RATED = "block long, doc_id array<long>, fold array<int>, n_tokens array<int>, codes binary, n_words int, ids binary, estimate binary, total binary"
_PAIRS = "bucket int, block long, n int, pairs binary, estimate binary, seen binary, unseen binary, context binary, outcome binary"
_ANSWERS = "bucket int, block long, n int, counts binary, gains binary, times binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte (all lowest bytes first) and compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").reshape(-1)


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _spread(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _types(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = _types(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.types)], schema=types)


def blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents gathered into blocks within a task: each document's fold and
    length, token numbers in the block's own word list, the list, each word's
    count in the two training parts, and the parts' documents."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {}
        ids, folds, parts, held = [], [], [], 0

        def made() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts], dtype=np.int32)
            codes = np.concatenate(parts)
            fold = np.repeat(folds, lengths)
            of = [np.bincount(codes[some], minlength=len(known)) for some in ((fold != HELD_OUT) & (fold != WEIGHTS_FROM), fold == WEIGHTS_FROM)]
            second = folds.count(WEIGHTS_FROM)
            return _batch([(number, ids, folds, lengths.tolist(), _packed(codes), len(known), _squeezed(b" ".join(known)),
                            *map(_packed, of), len(folds) - folds.count(HELD_OUT) - second, second)], _BLOCK)

        for batch in batches:
            for doc_id, text, fold in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "fold")], strict=True):
                tokens = tokens_of(text)
                for w in set(tokens).difference(known):
                    known[w] = len(known)
                parts.append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
                ids.append(doc_id)
                folds.append(fold)
                held += len(text or "") + 1
                if held >= block_chars:
                    yield made()
                    number, known, ids, folds, parts, held = number + 1, {}, [], [], [], 0
        if ids:
            yield made()

    return id_and_text(docs).withColumn("fold", fold_of(F.col("doc_id")).cast("int")).mapInArrow(gather, _BLOCK)


def _slices(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per bucket the places dealt to it, ascending."""
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    yield from enumerate(np.split(order, ends[:-1]))


def known_words(made: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket of words their places in the block's list, numbers and
    counts (estimate part, all training); block -1: a bucket's distinct words,
    most frequent first. Frequent words have low numbers."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _spread(row["words"]).split(b" ")
                of = [_unpacked(row[c], row["n_words"]) for c in ("estimate", "weights")]
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                yield _batch([(k, row["block"], len(at), _packed(np.diff(at, prepend=0)), _squeezed(b" ".join([words[i] for i in at])), *(_packed(x[at]) for x in of))
                              for k, at in _slices(bucket, buckets) if len(at)], _WORDS)

    def add(key: tuple, group: pa.Table) -> pa.Table:
        rows, mine = group.to_pylist(), key[0].as_py()
        words = [w for r in rows for w in _spread(r["words"]).split(b" ")]
        code = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
        sums = np.array([np.bincount(code, np.concatenate([_unpacked(r[c], r["n"]) for r in rows])) for c in ("estimate", "weights")]).astype(np.int64)
        estimate, total = sums[0], sums.sum(axis=0)
        order = np.argsort(-total, kind="stable")
        ids = np.empty(len(order), np.int64)
        ids[order] = FIRST + mine + buckets * np.arange(len(order))
        if ids.max() >> 32:
            raise ValueError("more distinct words than 32 bits number")
        out, start = [(mine, -1, len(order), b"", b"", _packed(estimate[order]), _packed(total[order]))], 0
        for r in rows:
            at = code[start:start + r["n"]]
            out.append((mine, r["block"], r["n"], r["places"], *(_packed(x[at]) for x in (ids, estimate, total))))
            start += r["n"]
        return pa.Table.from_batches([_batch(out, _KNOWN)])

    return made.select("block", "n_words", "words", "estimate", "weights").mapInArrow(deal, _WORDS).groupBy("bucket").applyInArrow(add, _KNOWN)


@dataclass(frozen=True)
class Totals:
    """Tokens and documents of the estimate part and of all training, distinct words, and the
    infrequent words' counts (zero where each word has its own estimates); ``least``: tokens of a frequent word."""
    estimate: int
    train: int
    distinct: int
    estimate_docs: int
    train_docs: int
    least: float
    class_estimate: int
    class_train: int

    def class_context(self) -> tuple[int, int]:
        """How often an infrequent word is followed by a token: the end, one a document, never is."""
        ends = self.train_docs < self.least
        return self.class_estimate - ends * self.estimate_docs, self.class_train - ends * self.train_docs


def totals(known: DataFrame, made: DataFrame, frequent: int | None) -> Totals:
    def add(batches: Iterator[pa.RecordBatch], train: int | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                e, c = (_unpacked(row[x], row["n"]) for x in ("estimate", "total"))
                some = c > 0 if train is None else c * frequent < train
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (e[some].sum(), c[some].sum(), some.sum())], ["e", "c", "n"])

    def summed(task) -> list[int]:
        per = known.filter("block = -1").mapInArrow(task, "e long, c long, n long")
        return [x or 0 for x in per.agg(F.sum("e"), F.sum("c"), F.sum("n")).first()]

    estimate, train, distinct = summed(add)
    first, second = [x or 0 for x in made.agg(F.sum("estimate_docs"), F.sum("weights_docs")).first()]
    rare = summed(lambda batches: add(batches, train))[:2] if frequent else [0, 0]
    return Totals(estimate, train, distinct, first, first + second, train / frequent if frequent else 0.0, *rare)


def rated_blocks(made: DataFrame, known: DataFrame) -> DataFrame:
    """The blocks with, for each distinct word, its number and its counts in the estimate part and in all training."""
    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        row, n = left.to_pylist()[0], left.column("n_words")[0].as_py()
        out = np.empty((3, n), np.int64)
        for r in right.to_pylist():
            at = np.cumsum(_unpacked(r["places"], r["n"]))
            for x, c in zip(out, ("ids", "estimate", "total"), strict=True):
                x[at] = _unpacked(r[c], r["n"])
        return pa.Table.from_batches([_batch([(*(row[c] for c in ("block", "doc_id", "fold", "n_tokens", "codes", "n_words")), *map(_packed, out))], _RATED)])

    texts = made.select("block", "doc_id", "fold", "n_tokens", "codes", "n_words")
    return texts.groupBy("block").cogroup(known.filter("block >= 0").groupBy("block")).applyInArrow(gather, _RATED)


class _Block:
    """A block's tokens and their distinct pairs (context, word), in ascending order.

    Of pairs: the first token ``at`` which it is; of tokens: ``pair`` (its place),
    ``e`` and ``c`` (the word's counts), ``rare`` (the word is one of the class), and the counts of
    the estimates' context and outcome, in the estimate part and in all training."""

    def __init__(self, row: dict, t: Totals):
        lengths = np.array(row["n_tokens"], dtype=np.int64)
        codes = _unpacked(row["codes"], int(lengths.sum()))
        ids, e, c = (_unpacked(row[x], row["n_words"]) for x in ("ids", "estimate", "total"))
        rare = c < t.least
        ctx = t.class_context()
        self.starts = np.cumsum(lengths) - lengths
        self.fold = np.repeat(row["fold"], lengths)
        self.e, self.c, self.rare = e[codes], c[codes], rare[codes]
        kind = np.where(rare, CLASS, ids)[codes]
        self.outcome = [np.where(rare, whole, x)[codes] for x, whole in ((e, t.class_estimate), (c, t.class_train))]
        self.context = [self._before(np.where(rare, whole, x)[codes], docs)
                        for x, whole, docs in ((e, ctx[0], t.estimate_docs), (c, ctx[1], t.train_docs))]
        keys = self._before(kind, START) << 32 | kind
        self.pairs, self.at, self.pair = np.unique(keys.view(np.uint64), return_index=True, return_inverse=True)

    def _before(self, values: np.ndarray, at_start: int) -> np.ndarray:
        out = np.roll(values, 1)
        out[self.starts] = at_start
        return out

    def dealt(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        mixed = self.pairs * np.uint64(0x9E3779B97F4A7C15)
        yield from _slices((mixed >> np.uint64(32)).astype(np.int64) % buckets, buckets)


def pair_answers(rated: DataFrame, t: Totals, buckets: int) -> DataFrame:
    """Per block and bucket the training counts of its pairs, in the order of :meth:`_Block.dealt`; block -1: the
    events the weights are learned from, as (context bucket, ML_2 / ML_1 or -1 for an unseen word, times)."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, t)
                second = b.fold == WEIGHTS_FROM
                counts = [np.bincount(b.pair[some], minlength=len(b.pairs)) for some in ((b.fold != HELD_OUT) & ~second, second & (b.e > 0), second & (b.e == 0))]
                asked = counts[1] + counts[2] > 0  # of these the estimates are needed
                context, outcome = b.context[0][b.at], b.outcome[0][b.at]
                yield _batch([(k, row["block"], len(at), _packed(np.diff(b.pairs[at], prepend=np.uint64(0))), *(_packed(x[at]) for x in counts),
                               *(_packed(x[at][asked[at]]) for x in (context, outcome))) for k, at in b.dealt(buckets) if len(at)], _PAIRS)

    def add(key: tuple, group: pa.Table) -> pa.Table:
        rows, mine = group.to_pylist(), key[0].as_py()
        pairs, of = np.unique(np.concatenate([np.cumsum(_unpacked(r["pairs"], r["n"]).view(np.uint64)) for r in rows]), return_inverse=True)
        local = [np.concatenate([_unpacked(r[c], r["n"]) for r in rows]) for c in ("estimate", "seen", "unseen")]
        asked = local[1] + local[2] > 0
        context, outcome = np.zeros(len(pairs), np.int64), np.ones(len(pairs), np.int64)
        start = 0
        for r in rows:
            some = np.flatnonzero(asked[start:start + r["n"]]) + start
            context[of[some]], outcome[of[some]] = (_unpacked(r[c], len(some)) for c in ("context", "outcome"))
            start += r["n"]
        estimate, seen, unseen = (np.bincount(of, x, len(pairs)) for x in local)
        bucket, at, new = bucket_of(context), np.flatnonzero(seen), np.flatnonzero(unseen)
        second = np.divide(estimate[at], context[at], out=np.zeros(len(at)), where=context[at] > 0)
        events = np.array([np.concatenate([bucket[at], bucket[new]]), np.concatenate([second / (outcome[at] / max(1, t.estimate)), np.full(len(new), -1.0)])]).T
        events, which = np.unique(events, axis=0, return_inverse=True)
        times = np.bincount(which.reshape(-1), np.concatenate([seen[at], unseen[new]]), len(events)).astype(np.int64)
        out, start = [(mine, -1, len(events), _packed(events[:, 0].astype(np.int64)), _packed(events[:, 1].copy().view(np.int64)), _packed(times))], 0
        counts = (estimate + seen + unseen).astype(np.int64)
        for r in rows:
            out.append((mine, r["block"], r["n"], _packed(counts[of[start:start + r["n"]]]), b"", b""))
            start += r["n"]
        return pa.Table.from_batches([_batch(out, _ANSWERS)])

    return rated.mapInArrow(deal, _PAIRS).groupBy("bucket").applyInArrow(add, _ANSWERS)


def bucket_of(frequency: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(frequency > 0, 1 + np.floor(np.log2(np.maximum(frequency, 1))), 0).astype(np.int64), BUCKETS - 1)


def _tallies(bucket: np.ndarray, r: np.ndarray, times: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Per bucket and, last, of all: times of seen words (r = ML_2 / ML_1) and of unseen ones (r < 0), and for each row
    of ``shares`` the slope of the likelihood, the sum of times * (r - 1) / (1 + x (r - 1)) over the seen ones."""
    sums = np.zeros((len(shares) + 2, BUCKETS + 1))
    for k, some in enumerate((r >= 0, r < 0)):
        sums[k, :-1] = np.bincount(bucket[some], times[some], BUCKETS)
    sums[:2, -1] = sums[:2, :-1].sum(axis=1)
    bucket, less, times = bucket[r >= 0], r[r >= 0] - 1, times[r >= 0]
    for k, x in enumerate(shares, 2):
        sums[k, :-1] = np.bincount(bucket, times * less / (1 + x[bucket] * less), BUCKETS)
        sums[k, -1] = (times * less / (1 + x[-1] * less)).sum()
    return sums


def _likeliest(tallies: Callable[[np.ndarray], np.ndarray], grid: int = 32, rounds: int = 7) -> np.ndarray:
    """(BUCKETS, 3) weights of ML_2, ML_1 and <unk> that make the events likeliest (where expectation-maximisation
    tends to). The last is the share of unseen words. With x the share of ML_2 in the rest the likelihood's slope
    falls, so each pass takes it at ``grid`` steps between the nearest places known to lie on either side of the
    top. Buckets without events take the weights of all together."""
    low, high = np.zeros(BUCKETS + 1), np.ones(BUCKETS + 1)
    for _ in range(rounds):
        step = (high - low) / grid
        seen, unseen, *slopes = tallies(np.minimum(low + step * np.arange(grid + 1)[:, None], 1 - 1e-12))
        slopes = np.array(slopes)
        at = np.clip((slopes > 0).sum(axis=0) - 1, 0, grid - 1)
        below, above, flat = slopes[0] <= 0, slopes[-1] >= 0, ~slopes.any(axis=0)  # flat: any share is as likely
        low, high = np.where(above, high, low + step * at), np.where(below, low, low + step * (at + 1))
        low, high = np.where(flat, 0.5, low), np.where(flat, 0.5, high)
    share, events = (low + high) / 2, seen + unseen
    lost = np.divide(unseen, events, out=np.full(BUCKETS + 1, 1 / 3), where=events > 0)
    weights = np.column_stack([(1 - lost) * share, (1 - lost) * (1 - share), lost])
    weights[events == 0] = weights[-1]
    return weights[:-1]


def learn_weights(bucket: np.ndarray, estimates: np.ndarray, held: np.ndarray) -> np.ndarray:
    """(BUCKETS, 3) mixture weights from held-out counts of a table in memory; ``estimates``: ML_2, ML_1, [is <unk>]."""
    r = np.where(estimates[:, 2] > 0, -1.0, estimates[:, 0] / np.where(estimates[:, 1] > 0, estimates[:, 1], 1))
    return _likeliest(lambda shares: _tallies(bucket, r, held, shares))


def class_estimates(pairs: np.ndarray, counts: np.ndarray, kinds: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For asked (context, class) pairs the context's frequency and the
    columns ML_2, ML_1 (of the class) and [class is <unk>], from a table in memory: the estimates, plainly stated."""
    width = kinds + 2
    of_context = np.bincount(pairs // width, counts, minlength=width)
    of_class = np.bincount(pairs % width, counts, minlength=width)
    both = np.zeros(len(asked))
    place = np.minimum(np.searchsorted(pairs, asked), max(0, len(pairs) - 1))
    if len(pairs):
        both = np.where(pairs[place] == asked, counts[place], 0.0)
    frequency = of_context[asked // width]
    unknown = asked % width == kinds + 1
    second = np.divide(both, frequency, out=np.zeros(len(asked)), where=frequency > 0)
    first = of_class[asked % width] / max(1.0, counts.sum())
    return frequency, np.column_stack([np.where(unknown, 0, second), np.where(unknown, 0, first), unknown.astype(float)])


def learned_weights(answers: DataFrame) -> np.ndarray:
    """:func:`learn_weights` from events that stay where they are: a few passes, from each of which one row a task comes back."""
    def pass_over(shares: np.ndarray) -> np.ndarray:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(shares) + 2, BUCKETS + 1))
            for batch in batches:
                for row in batch.to_pylist():
                    bucket, r, times = (_unpacked(row[c], row["n"]) for c in ("counts", "gains", "times"))
                    sums += _tallies(bucket, r.view(np.float64), times, shares)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        parts = sorted(bytes(r.sums) for r in answers.filter("block = -1").mapInArrow(task, "sums binary").collect())
        return sum((np.frombuffer(p).reshape(len(shares) + 2, -1) for p in parts), np.zeros((len(shares) + 2, BUCKETS + 1)))

    return _likeliest(pass_over)


def scores(docs: DataFrame, block_chars: int = BLOCK_CHARS, frequent: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``frequent``: see above; by default every word has its own estimates."""
    if frequent is not None and frequent < 1:
        raise ValueError("at least one word can have a class of its own")
    made = materialize(blocks(docs, block_chars), "blocks")
    buckets = max(1, -(-made.count() // BLOCKS_A_BUCKET))
    known = materialize(known_words(made, buckets), "words")
    t = totals(known, made, frequent)
    rated = materialize(rated_blocks(made, known), "rated")
    release(made)
    release(known)
    answers = materialize(pair_answers(rated, t, buckets), "pairs")
    weights = learned_weights(answers)
    weights[0, :] = [0, 0, 1] if not t.train else [0, *(weights[0, 1:] / max(weights[0, 1:].sum(), 1e-12))]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        b = _Block(row, t)
        counts = np.empty(len(b.pairs), np.int64)
        found = {r["bucket"]: _unpacked(r["counts"], r["n"]) for r in right.to_pylist()}
        for k, at in b.dealt(buckets):
            if len(at):
                counts[at] = found[k]
        context, outcome = b.context[1][b.at], b.outcome[1][b.at]
        w = weights[bucket_of(context)]
        second = np.divide(counts, context, out=np.zeros(len(counts)), where=context > 0)
        value, unknown = w[:, 0] * second + w[:, 1] * (outcome / max(1, t.train)), w[:, 2]
        within = np.where(b.rare, b.c / max(1.0, t.class_train), 1.0)  # the word's share of its class
        known = b.c > 0
        log10 = np.log10(np.maximum(np.where(known, value[b.pair] * within, unknown[b.pair]), 1e-300))
        base = np.log10((b.c + 0.5) / (t.train + 0.5 * (t.distinct + 1)))
        total = lambda x: pa.array(np.add.reduceat(x, b.starts))
        return pa.table([pa.array(row["doc_id"], pa.int64()), pa.array([f == HELD_OUT for f in row["fold"]]), pa.array(row["n_tokens"], pa.int64()),
                         total(known.astype(np.int64)), pa.array(np.full(len(b.starts), t.train, dtype=np.int64)), total(base), total(log10)],
                        [c.split()[0] for c in _SCORES.split(", ")])

    return rated.groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block")).applyInArrow(score, _SCORES)


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned outside the held-out fold."""
    return scores(table(spark, sf_dir, "documents"))
