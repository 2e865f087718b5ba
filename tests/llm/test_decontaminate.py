import random

import numpy as np
import pytest
from edge import ROWS, documents

from vigil.llm.decontaminate import (RANK, Items, common_subsequence, contaminated, find, passages_of, randomised_svd,
                                     without_benchmark, words_of)

random.seed(8)
WORDS = [f"{a}{b}{c}" for a in "bdgkmnprst" for b in "aeiou" for c in ("l", "n", "rk", "st")]
ITEMS = [(i, " ".join(random.choices(WORDS, k=n)) + ".") for i, n in enumerate([20, 35, 60, 64, 65, 150, 12, 8])]
COMMON = "the of and to in".split()


def prose(n):
    return " ".join(random.choice(COMMON) if random.random() < 0.5 else random.choice(WORDS) + random.choice(WORDS) for _ in range(n))


def planted():
    rows, want = [(1000 + i, prose(random.choice([5, 60, 128, 129, 700])), "en", "a") for i in range(60)], set()
    for k, (i, text) in enumerate(ITEMS):
        words = text.split()
        near = [w if j % 12 != 5 else "changed" for j, w in enumerate(words)]                     # one word in twelve replaced
        loose = [w for j, w in enumerate(words) if j % 11 != 4]                                    # one word in eleven left out
        padded = [x for j, w in enumerate(words) for x in ([w, "oh"] if j % 9 == 3 else [w])]      # words put in between
        for v, version in enumerate((words, [w.upper() for w in words], near, loose, padded)):
            for lead in (0, 50, 63, 64, 127, 500):
                doc = 2000 + 100 * k + 10 * v + (0, 50, 63, 64, 127, 500).index(lead)
                rows.append((doc, prose(lead) + " " + " ".join(version) + " " + prose(lead // 2), "en", "b"))
                want.add((doc, i))
    return rows, want


def test_copies_and_paraphrases_are_found_and_clean_documents_left_alone(spark):
    rows, want = planted()
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = documents(spark, rows)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(d, benchmark).collect()}
    assert not {x for x in got if x[0] < 2000}
    assert want <= got, sorted(want - got)[:5]
    exact = {(i, k) for i, t, _, _ in rows for k, item in ITEMS if " ".join(words_of(item)) in " ".join(words_of(t))}
    assert exact <= got
    kept = without_benchmark(d, benchmark)
    assert kept.schema.names == d.schema.names and sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows if r[0] < 2000)


def test_blocks_of_the_benchmark_find_the_same(spark):
    rows, _ = planted()
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = documents(spark, rows[:120])
    for cosine in (2.0, 0.35):  # by the verbatim door alone the same; the latent space is each block's own
        once = {(r["doc_id"], r["item_id"], r["part"]): r["share"] for r in contaminated(d, benchmark, min_cosine=cosine).collect()}
        blocks = {(r["doc_id"], r["item_id"], r["part"]): r["share"] for r in contaminated(d, benchmark, min_cosine=cosine, item_block=3).collect()}
        assert {k for k, v in once.items() if v >= 0.7} == {k for k, v in blocks.items() if v >= 0.7}
        assert cosine < 1 or once == blocks


def test_randomised_svd_spans_the_leading_space(spark):
    items = Items([(i, k, p) for i, t in ITEMS for k, p in enumerate(passages_of(words_of(t)))])
    items.idf = np.random.default_rng(1).uniform(1, 5, len(items.vocabulary))
    a = np.zeros((len(items.rows), len(items.vocabulary)))
    for i, codes in enumerate(items.codes):
        terms, weights = items.weigh(codes)
        a[i, terms] = weights
    exact = np.linalg.svd(a, full_matrices=False)[2][:4]
    passages = spark.createDataFrame([(c.tolist(),) for c in items.codes], "codes array<int>").repartition(3)
    found = randomised_svd(passages, items, 4, power_steps=6)
    assert np.linalg.svd(exact @ found)[1].min() > 0.95


def test_common_subsequence_against_the_table():
    random.seed(6)
    for _ in range(500):
        a, b = ([random.randint(0, 4) for _ in range(random.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_subsequence(np.array(a, dtype=np.int32), np.array(b, dtype=np.int32)) == table[-1][-1]


@pytest.mark.parametrize("rows", [ROWS, []])
@pytest.mark.parametrize("items", [[(1, ROWS[0][1]), (2, None), (3, ""), (None, "tiny item"), (4, "... !!"), (5, "la la la la la la la la la la la la")], []])
def test_edge_rows(spark, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(documents(spark, rows), benchmark).collect()}
    assert got == ({(1, 1), (2, 1), (None, 1)} if rows and items else set())


def full_block():
    """1,040 passages on 130 topics, more than the space has directions, the block fitted, and all words."""
    draw = random.Random(21)
    topics = [[draw.choice(WORDS) + draw.choice(WORDS) + str(t) for _ in range(25)] for t in range(130)]
    passages = [draw.choices(topics[i % 130], k=draw.choice([8, 9, 11, 14, 25, 45, 60])) for i in range(1040)]
    items = Items([(i, 0, p) for i, p in enumerate(passages)])
    a = np.zeros((len(items.rows), len(items.vocabulary)))
    for row, codes in zip(a, items.codes, strict=True):
        terms, weights = items.weigh(codes)
        row[terms] = weights
    items.basis = np.linalg.svd(a, full_matrices=False)[2][:RANK].T.astype(np.float32)
    latent = a @ items.basis
    length = np.linalg.norm(latent, axis=1, keepdims=True)
    items.latent = (latent / np.maximum(length, 1e-12)).astype(np.float32)
    items.kept = length[:, 0] ** 2
    every = [w for t in topics for w in t]
    return draw, passages, items, every


def test_a_full_block_of_passages_loses_no_verbatim_copy():
    """Planted in documents of the same words."""
    draw, passages, items, every = full_block()
    items.index_rare_words(0.7, 0.55)
    texts = [" ".join([*draw.choices(every, k=300), *p, *draw.choices(every, k=200)]) for p in passages]
    found = {(i, p) for i, p, _ in find(items, texts, 0.35, 0.5)}
    lost = [len(p) for i, p in enumerate(passages) if (i, i) not in found]
    assert not lost, (len(lost), sorted(lost))


def test_the_cosine_decides_paraphrases():
    """Two words in five replaced: too few are left for the verbatim door, so only the latent space finds them."""
    draw, passages, items, every = full_block()
    items.index_rare_words(0.7, 0.55)
    chosen = [p for p, words in enumerate(passages) if len(words) >= 25]
    texts = [" ".join([*draw.choices(every, k=300), *[w if j % 5 not in (1, 3) else f"other{j}" for j, w in enumerate(passages[p])],
                       *draw.choices(every, k=200)]) for p in chosen]

    def caught(min_cosine):
        found = {(i, p) for i, p, _ in find(items, texts, min_cosine, 0.5)}
        return sum((i, p) in found for i, p in enumerate(chosen)) / len(chosen)

    assert caught(0.35) > 0.9
    assert caught(2.0) < 0.25  # no window reaches this cosine; passages of 25 words repeat enough of them to keep some


def test_every_window_and_passage_against_plain_cosines():
    draw, passages, items, every = full_block()
    text = [draw.choices([*every, "unknown"], k=k) for k in (700, 64, 65, 3)]
    codes, text_of = items.encode([" ".join(t) for t in text])
    got = set(items.latent_meetings(codes, text_of, 0.35, block=7).tolist())
    want, close = set(), set()
    for window in range(len(text_of)):
        folded = np.zeros(items.basis.shape[1])
        for part in (window, window + 1):
            if part < len(text_of) and text_of[part] == text_of[window]:
                stretch = codes[part * 64:(part + 1) * 64]
                terms, counts = np.unique(stretch[stretch >= 0], return_counts=True)
                folded += ((1 + np.log(counts)) * items.idf[terms]) @ items.basis[terms]
        if np.linalg.norm(folded) > 1e-9:
            cosines = items.latent @ folded / np.linalg.norm(folded)
            want |= {window * len(passages) + int(p) for p in np.flatnonzero(cosines >= 0.35)}
            close |= {window * len(passages) + int(p) for p in np.flatnonzero(abs(cosines - 0.35) < 1e-5)}
    assert want and got - close == want - close
