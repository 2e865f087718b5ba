import collections
import math
import re
import zlib

import numpy as np
import pytest
from edge import ROWS, documents

from vigil.llm.langmodel import BUCKETS, class_estimates, learn_weights, scores

SF001 = "/root/testdata/sf0.001"


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", text), "\n"]


def fold(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 5


def check_base(rows, got):
    c = collections.Counter(w for i, t in rows if fold(i) != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, fold(i) == 1,
                   round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"], round(r["base_score"], 6)) for r in got) == want


def test_base_scores_and_a_better_model_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = scores(docs, block_chars=40_000).collect()
    check_base(rows, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.3 * sum(r["n_tokens"] for r in held)
    again = {r["doc_id"]: r["score"] for r in scores(docs).collect()}  # blocks are a matter of speed only
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in got)


def test_scores_against_a_plain_model(spark):
    """Every probability by its formula, with the weights relearned here."""
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 3 + i % 5))) for i in range(60)]
    got = scores(spark.createDataFrame(rows, "doc_id long, text string"), frequent=6).collect()
    parts = {0: collections.Counter(), 1: collections.Counter()}
    for i, t in rows:
        if fold(i) != 1:
            parts[int(fold(i) == 2)].update(tokens(t))
    total = parts[0] + parts[1]
    n = sum(total.values())
    often = {w for w, c in total.items() if c * 6 >= n}
    kind = lambda w: w if w in often else "*"

    def pairs(part, outcome):
        return collections.Counter((v, outcome(w)) for i, t in rows if fold(i) != 1 and part(fold(i))
                                   for v, w in zip(["^"] + [kind(x) for x in tokens(t)], tokens(t), strict=False))

    first = pairs(lambda f: f != 2, kind)
    held = pairs(lambda f: f == 2, lambda w: kind(w) if parts[0][w] else None)

    def ml(counts, v, k):
        context = sum(c for (a, _), c in counts.items() if a == v)
        everything = sum(counts.values())
        second = counts[(v, k)] / context if context and k is not None else 0.0
        return context, [float(k is None), sum(c for (_, b), c in counts.items() if b == k) / everything if k is not None else 0.0, second][::-1]

    bucket = lambda c: 1 + int(math.log2(c)) if c else 0
    events = [(bucket(ml(first, v, k)[0]), ml(first, v, k)[1], c) for (v, k), c in held.items()]
    weights = learn_weights(np.array([e[0] for e in events]), np.array([e[1] for e in events]), np.array([float(e[2]) for e in events]))
    final = pairs(lambda f: True, kind)
    rare = sum(c for w, c in total.items() if w not in often)
    for r in got:
        words, want = tokens(dict(rows)[r["doc_id"]]), 0.0
        for v, w in zip(["^"] + [kind(x) if total[x] else "*" for x in words], words, strict=False):
            k = kind(w) if total[w] else None
            context, estimates = ml(final, v, k)
            p = float(np.dot(weights[bucket(context)], estimates)) * (total[w] / rare if k == "*" else 1.0)
            want += math.log10(max(p, 1e-300))
        assert r["score"] == pytest.approx(want, rel=1e-6)


def test_estimates_are_distributions_and_weights_follow_held_out_counts():
    rng = np.random.default_rng(2)
    kinds, width = 5, 7
    pairs = np.array([v * width + w for v in (0, 1, 2, 5, 6) for w in range(6)])
    counts = rng.integers(1, 50, len(pairs)).astype(float)
    for v in (0, 1, 2, 5, 6):
        _, e = class_estimates(pairs, counts, kinds, np.arange(v * width, v * width + 7))
        assert np.allclose(e.sum(axis=0), 1)
    bucket = np.array([1, 1, 2, 2])
    estimates = np.array([[0.9, 0.1, 0], [0, 0, 1], [0.1, 0.8, 0], [0, 0, 1]])
    weights = learn_weights(bucket, estimates, np.array([90.0, 10, 50, 50]))
    assert weights.shape == (BUCKETS, 3) and np.allclose(weights.sum(axis=1), 1)
    assert weights[1] == pytest.approx([0.9, 0, 0.1], abs=1e-3) and weights[2] == pytest.approx([0, 0.5, 0.5], abs=1e-3)


@pytest.mark.parametrize("rows", [ROWS, [], [r for r in ROWS if r[0] == 5] * 2])
def test_edge_rows(spark, rows):
    got = scores(documents(spark, rows)).collect()
    check_base([r[:2] for r in rows], got)
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in got)


def plain_word_model(rows):
    """log10 probabilities of texts by counting every pair of words, the weights by long expectation-maximisation."""
    parts = {k: (collections.Counter(), collections.Counter(), collections.Counter()) for k in (0, 1)}  # pairs, contexts, words
    for i, t in rows:
        if fold(i) != 1:
            words = tokens(t)
            pairs, contexts, seen = parts[int(fold(i) == 2)]
            pairs.update(zip(["^", *words], words, strict=False))
            contexts.update(["^", *words[:-1]])
            seen.update(words)
    first, held = parts[0], parts[1]
    bucket = lambda c: 1 + int(math.log2(c)) if c else 0

    def estimates(model, v, w):
        pairs, contexts, seen = model
        return (pairs[v, w] / contexts[v] if contexts[v] else 0.0, seen[w] / sum(seen.values())) if seen[w] else None

    by_bucket = collections.defaultdict(list)
    for (v, w), n in held[0].items():
        by_bucket[bucket(first[1][v])].append((estimates(first, v, w), n))
    by_bucket[None] = [e for b in list(by_bucket) for e in by_bucket[b]]
    weights = {}
    for b, events in by_bucket.items():
        total, lost, share = sum(n for _, n in events), sum(n for e, n in events if e is None), 0.5
        for _ in range(20_000):
            known = [(e, n) for e, n in events if e]
            share = sum(n * share * e[0] / (share * e[0] + (1 - share) * e[1]) for e, n in known) / sum(n for _, n in known) if known else 0.5
        weights[b] = ((1 - lost / total) * share, (1 - lost / total) * (1 - share), lost / total)
    both = tuple(a + b for a, b in zip(first, held, strict=True))

    def score(t):
        out, words = 0.0, tokens(t)
        for v, w in zip(["^", *words], words, strict=False):
            b, e = bucket(both[1][v]), estimates(both, v, w)
            l2, l1, l0 = weights.get(b, weights[None])
            if b == 0:
                l2, l1, l0 = 0, l1 / (l1 + l0), l0 / (l1 + l0)
            out += math.log10(max(l2 * e[0] + l1 * e[1] if e else l0, 1e-300))
        return out

    return score


@pytest.mark.parametrize("block_chars", [150, 8_000_000])
def test_every_pair_of_words_is_counted(spark, block_chars):
    """Rare words have bigrams of their own: the scores are those of a plain model over all pairs, however texts are dealt to blocks."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{(int(x) * (1 + i % 3)) % 40}" for x in rng.integers(0, 60, 3 + i % 9)) + (f" only{i} pair{i}" if i % 4 == 0 else "")) for i in range(90)]
    rows += [(1000 + i, f"rare{i // 6} twin{i // 6} end") for i in range(60)]  # a rare word tells the next
    want = plain_word_model(rows)
    got = scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_chars=block_chars).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want(dict(rows)[r["doc_id"]]), rel=1e-6)
    classes = {r["doc_id"]: r["score"] for r in scores(spark.createDataFrame(rows, "doc_id long, text string"), frequent=5).collect()}
    mine = [r for r in got if r["doc_id"] >= 1000]
    assert sum(r["score"] for r in mine) > sum(classes[r["doc_id"]] for r in mine) + 0.2 * len(mine)
