import random
import re

import numpy as np
import pytest
import xxhash
from edge import ROWS, documents

from vigil.llm.components import connected_components
from vigil.llm.simhash import VantageTree, fingerprint, near_duplicate_edges, near_duplicates, without_near_duplicates


def plain_fingerprint(text, n=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def test_fingerprints_against_the_definition():
    random.seed(7)
    for k in [0, 1, 2, 3, 4, 30, 600, 2000]:
        text = " ".join(random.choices(["Ab", "cd", "É", "x\ty", "zz\n"], k=k))
        assert fingerprint(text, 3) == plain_fingerprint(text)
    assert [fingerprint(t, 3) for _, t, _, _ in ROWS] == [plain_fingerprint(t) for _, t, _, _ in ROWS]


def test_shingle_hash_is_sparks_own(spark):
    from pyspark.sql import functions as F
    got = spark.range(1).select(F.xxhash64(F.lit("the quick é")).alias("h")).first()["h"]
    assert got % 2**64 == xxhash.xxh64_intdigest("the quick é".encode(), 42)


@pytest.mark.parametrize("limits", [{}, {"leaf_target": 20, "leaf_limit": 7, "sample_limit": 500}, {"leaf_target": 5, "sample_limit": 30}])
def test_components_against_all_pairs(spark, limits):
    random.seed(11)
    fps = []
    for _ in range(60):
        x = random.getrandbits(64)
        fps += [x] * random.choice([1, 1, 3])
        for _ in range(random.choice([0, 1, 12])):  # chains of one to three flipped bits
            for b in random.sample(range(64), random.choice([1, 2, 3])):
                x ^= 1 << b
            fps.append(x)
    nodes = sorted(set(fps))
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if (a ^ b).bit_count() <= 2]
    signed = [x - 2**64 if x >= 2**63 else x for x in nodes]
    d = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"] % 2**64: r["root"] % 2**64 for r in connected_components(near_duplicate_edges(d, 2, **limits)).collect()}
    want = groups_of(pairs, nodes)
    classes = lambda m: {frozenset(n for n in nodes if m.get(n, n) == r) for r in set(m.get(n, n) for n in nodes)}
    assert classes(got) == classes(want)


def test_every_ball_reaches_the_leaf_that_stores_its_members():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 3000).astype(np.uint64)
    tree = VantageTree(fps[:500], 5)
    near = fps ^ np.uint64(0b101)
    at, leaf, home = tree.route(np.concatenate([fps, near]), 2)
    stored = {int(i): int(x) for i, x, h in zip(at, leaf, home, strict=True) if h}
    asked = {(int(i), int(x)) for i, x in zip(at, leaf, strict=True)}
    assert len(stored) == 6000 and len(tree.leaves) > 8
    assert all((i + 3000, stored[i]) in asked and (i, stored[i + 3000]) in asked for i in range(3000))


def test_components_of_paths_and_random_graphs(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(random.randint(200, 400), random.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    d = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(d).collect()}
    linked = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: r for n, r in groups_of(edges, {n for e in edges for n in e}).items() if n in linked}


@pytest.mark.parametrize("rows", [ROWS, []])
def test_edge_rows(spark, rows):
    got = near_duplicates(documents(spark, rows)).collect()
    fp = {t: plain_fingerprint(t) for _, t, _, _ in rows}
    nodes = sorted(set(fp.values()))
    root = groups_of([(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2], nodes)
    smallest = {}
    for i, t, _, _ in rows:
        smallest.setdefault(root[fp[t]], []).append(i)
    want = sorted((str(i), fp[t], min((x for x in smallest[root[fp[t]]] if x is not None), default=None)) for i, t, _, _ in rows)
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in got) == want


def test_one_document_of_each_group_stays(spark):
    d = documents(spark)
    out = without_near_duplicates(d)
    assert out.schema.names == d.schema.names
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "5", "7", "7"]
